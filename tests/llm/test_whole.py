"""Places where an operator once did less than the whole job."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_contracts import SCHEMA, bench, docs, prose

from bidlake.llm import decontam, langid, line_dedup, packing


def test_line_dedup_with_earlier_excerpts(spark):
    """B and C share a passage of which A, earlier, holds 25 to 49 words; periods."""
    r = random.Random(11)
    texts = []
    for size, part in [(51, 40), (55, 40), (60, 49), (70, 49), (75, 25), (90, 49)] * 8:
        p = prose(r, size, 10**6).split()
        at = r.randrange(size - part + 1)
        excerpt = " ".join(p[at : at + part])
        texts += [f"{prose(r, 30, 10**6)} {x} {prose(r, 30, 10**6)}" for x in (excerpt, " ".join(p), " ".join(p))]
    for period in (1, 2, 7, 12, 13, 30):
        unit = prose(r, period, 10**6)
        texts += [f"{prose(r, 20, 10**6)} {' '.join([unit] * (n // period))} {prose(r, 20, 10**6)}" for n in (60, 110, 300)]
    gone = line_dedup.brute_force(list(enumerate(texts)))
    for row in line_dedup.dedup(docs(spark, texts)).collect():
        kept = [w for p, w in enumerate(texts[row["doc_id"]].split()) if p not in gone[row["doc_id"]]]
        assert row["text"].split() == kept


def test_packing_scores_all_terms():
    """Neighbours of seeds of hundreds of terms in the order of BM25 over all of them."""
    r = np.random.default_rng(2)
    weight = 1 / np.arange(1, 3001)
    made = [(i, r.choice(3000, n, p=weight / weight.sum()).astype("<u2")) for i, n in enumerate(r.integers(300, 1500, 60))]
    df = np.bincount(np.concatenate([np.unique(d) for _, d in made]), minlength=3001)
    idf, mean = np.log(1 + (60 - df + 0.5) / (df + 0.5)), float(np.mean([len(d) for _, d in made]))
    shard = packing.Shard(made, idf, mean, 2048)
    tf = np.stack([np.bincount(d, minlength=3001) for _, d in made]).astype(float)
    size = np.array([[len(d)] for _, d in made])
    bm25 = idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * size / mean))
    for seed in range(60):
        free = np.arange(60) != seed
        score = bm25[:, tf[seed] > 0].sum(axis=1)
        got = list(shard.neighbours(seed, free))
        assert len(got) == 59 and np.all(np.diff(score[got]) <= 1e-9)


def test_decontamination_of_null_and_repeated_ids(spark):
    r = random.Random(12)
    item = prose(r, 12)
    dirty, clean = f"{prose(r, 20, 10**6)} {item} {prose(r, 20, 10**6)}", prose(r, 60, 10**6)
    rows = [(None, dirty), (None, clean), (None, None), (1, clean), (1, dirty), (1, dirty), (2, clean)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    b = bench(spark, [(5, item)])
    cut = dirty.replace(f"{item} ", "")
    for most in (10**6, 0):
        got = sorted((str(x["doc_id"]), x["n_words"], x["n_hit"], x["items"]) for x in decontam.scan(d, b, max_broadcast=most).collect())
        assert got == sorted((str(i), len((t or "").split()), 12 * (t == dirty), ["5"] * (t == dirty)) for i, t in rows)
        left = sorted((str(x["doc_id"]), str(x["text"])) for x in decontam.remove(d, b, max_broadcast=most).collect())
        assert left == sorted((str(i), cut if t == dirty else str(t)) for i, t in rows)


def test_packing_is_the_same_under_any_partitions(spark, sf_dir, monkeypatch):
    """Shards depend on the documents alone, and their rests are joined: few short sequences."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 30_000)
    monkeypatch.setattr(packing, "SHARD_DOCS", 64)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = random.Random(8)
    d = given.unionByName(spark.createDataFrame([(10**6 + i % 90, prose(r, 20)) for i in range(300)] + [(7, "the same text")] * 200, "doc_id long, text string"))
    seen = []
    for parts in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        monkeypatch.setattr(packing, "MAX_BROADCAST_BYTES", 10**6 if parts == "4" else 0)  # either way
        try:
            rows = packing.pack(d.repartition(int(parts))).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        seen.append(sorted(map(tuple, rows), key=repr))
    assert seen[0] == seen[1]
    size = {}
    for row in rows:
        size[row["sequence_id"]] = size.get(row["sequence_id"], 0) + row["length"]
    # Whatever the number of shards, all are full but for the powers of two of one rest.
    short = sorted(n for n in size.values() if n < 2048)
    assert len(size) > 100 and len(short) <= 11 and len(set(short)) == len(short)


def test_pii_of_repeated_rows(spark):
    """Equal rows cost what their number costs: contexts are looked for once."""
    from bidlake.llm import pii

    text = "\n".join(f"write to someone{i}@example.org about matter number {i}" for i in range(40))
    one = pii._based(docs(spark, [text]))
    many = pii._based(docs(spark, [text]).withColumn("copies", F.explode(F.sequence(F.lit(1), F.lit(300)))))
    assert pii._contexts(one, pii.REACH).count() == pii._contexts(many, pii.REACH).count()
    assert pii.find(docs(spark, [text] * 3).withColumn("doc_id", F.lit(4).cast("long"))).count() == 3


def test_decontamination_of_a_hot_window(spark):
    """A window in most documents is dealt to several tasks, with the rows of the broadcast way."""
    r = random.Random(13)
    hot = prose(r, 12)
    d = docs(spark, [f"{prose(r, 8, 10**6)} {hot} {prose(r, 8, 10**6)}" if i % 3 else prose(r, 30, 10**6) for i in range(400)])
    b = bench(spark, [(1, hot), (2, f"{hot} and more"), (3, prose(r, 15))])
    both = [sorted((x["doc_id"], x["n_hit"], x["items"]) for x in decontam.scan(d, b, max_broadcast=most).collect()) for most in (10**6, 0)]
    assert both[0] == both[1] and sum(x[1] > 0 for x in both[0]) == 266


def test_archives_of_a_hot_payload(spark):
    """A third of all pages are one payload, another third have none."""
    from bidlake.llm import warc

    big = "x" * 1500
    pages = spark.createDataFrame([(i, f"u{i}", [big, None, f"{big}{i}"][i % 3]) for i in range(600)], "page_id long, url string, html string")
    got = {x["page_id"]: x["refers_to"] for x in warc.decided(pages).select("page_id", "refers_to").collect()}
    assert got == {i: 597 if i % 3 == 0 and i != 597 else None for i in range(600)}


def test_licence_headers_among_other_words(spark):
    """A header with 0 to 40 rare words on either side is found; clean lines are not."""
    from bidlake.llm import licenses

    r = random.Random(15)

    def rare(n):
        return " ".join(f"q{r.randrange(10**7)}x" for _ in range(n))

    headers = [("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Released under the MIT License."), ("Proprietary", "All rights reserved.")]
    rows, want = [], {}
    for a in (0, 4, 8, 12, 16, 17, 24, 40):
        for b in (0, 1, 9, 18, 40):
            for name, header in headers:
                path = f"/p/{a}/{b}/{name}/f"
                rows.append((path, f"{rare(a)} {header} {rare(b)}"))
                want[path] = name
    rows.append(("/long/f", f"{rare(3000)} {headers[0][1]} {rare(3000)}"))
    want["/long/f"] = "Apache-2.0"
    rows += [(f"/clean/{i}", f"the {rare(12)} rights of {rare(3)} version {rare(2)}\n{rare(30)} under the terms") for i in range(40)] + [("/clean/x", "the rights reserved by the members")]
    got = {x["path"]: (x["license"], x["cosine"]) for x in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    found = [p for p, name in want.items() if got[p][0] == name and got[p][1] > 0.99]
    assert len(found) >= 0.95 * len(want) and not any(got[p][0] for p in got if p.startswith("/clean"))


def test_languages_are_learned_from_all_documents(spark, monkeypatch):
    """The start's sample shows half of what each language is written in."""
    r = random.Random(5)
    write = lambda letters: "".join(r.choice(letters) for _ in range(1500))
    kinds = [("a", "abcd "), ("b", "pqrs "), ("a", "ghij "), ("b", "wxyz ")]
    rows = [(i, write(kinds[i % 4][1]), kinds[i % 4][0]) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    some = [(lang, str(i), [text[:200], text[300:500]]) for i, text, lang in rows[:120] if i % 4 < 2]
    monkeypatch.setattr(langid, "sampled", lambda labelled: some)
    apart = [(text, lang) for i, text, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2 and i % 4 > 1]
    started = langid.train([(t, lang) for lang, _, texts in some for t in texts]).documents([t for t, _ in apart])
    assert sum(x[0] == lang for x, (_, lang) in zip(started, apart, strict=True)) < 0.9 * len(apart)
    net = langid.fit(d)
    assert [x[0] for x in net.documents([t for t, _ in apart])] == [lang for _, lang in apart]
    again = langid.fit(d.unionByName(d).repartition(7))
    assert all(np.array_equal(net.p[k], again.p[k]) for k in net.p)


def test_bound_of_no_language_counts_all(spark):
    d = spark.range(4000).select((F.col("id") / 4000).alias("none"))
    assert langid.none_limit(d) == 0.9498  # 3800 of 4000 are 0.94975 or less
    assert langid.none_limit(d.where("none < 0.1")) == langid.none_limit(d.where("none > 1")) == langid.LEAST_NONE
