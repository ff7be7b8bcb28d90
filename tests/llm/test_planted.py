"""Planted cases: hosts that fail, terms that disclose, licences, rows of one id, and the
ways beyond the bounds on what is broadcast."""

import random
import zlib

import numpy as np
import pytest
from compare import check, rows_of, sql_rows
from test_contracts import SCHEMA, base_spans, bench, docs, prose

from bidlake.llm import common, decontam, host_rules, licenses, line_dedup, ngram_join, packing, pii, tokens, warc
from bidlake.llm.queries import ORACLE_SQL, QUERIES


def planted(spark, sf_dir, tmp_path, rows):
    """A folder like the given one, with these documents."""
    import os

    for name in os.listdir(sf_dir):
        if not name.startswith("documents"):
            os.symlink(f"{sf_dir}/{name}", f"{tmp_path}/{name}")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).toPandas().astype({"doc_id": "int64", "n_chars": "int32"}).to_parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_failing_hosts_against_sql(spark, sf_dir, tmp_path):
    r = random.Random(20)
    fine = lambda: prose(r, 80, 10**6)
    rows = [(i, fine(), "en", f"h{i % 9}", 0) for i in range(270)]
    rows += [(1000 + i, " ".join(["#$%"] * 20) + " " + fine(), "en", "symbols", 0) for i in range(30)] + [(1100, fine(), "en", "symbols", 0)]
    rows += [(1200 + i, "\n".join([f"same line {i}"] * 40 + [fine()]), "en", "lines", 0) for i in range(20)] + [(1300, fine(), "en", "lines", 0), (1301, fine(), None, None, 0)]
    sf = planted(spark, sf_dir, tmp_path, rows)
    check(spark, QUERIES["op2_host_rules"], ORACLE_SQL["op2_host_rules"], sf)
    got = {x["doc_id"]: x for x in QUERIES["op2_host_rules"](spark, sf).collect()}
    assert [got[i]["host_failed"] and not got[i]["base_failed"] and not got[i]["kept"] for i in (1100, 1300)] == [True, True]
    assert all(got[i]["kept"] for i in range(270)) and got[1301]["kept"]


def test_disclosing_terms_against_sql(spark, sf_dir, tmp_path):
    r = random.Random(21)
    text = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "the", "and"]) for _ in range(n))
    rows = [(i, f"{text(20)}\n{text(4)} Zebulon at zeb{i % 3}@x.org {text(4)}\n{text(9)}", "en", "s", 0) for i in range(12)]
    rows += [(100 + i, f"{text(30)} call Quillon +1 (377) 555-0271 {text(3)}", "en", "s", 0) for i in range(5)] + [(200 + i, text(40), "en", "s", 0) for i in range(200)]
    rows += [(500 + i, "one text Lonely, 10.1.2.3, copied", "en", "s", 0) for i in range(5)]
    sf = planted(spark, sf_dir, tmp_path, rows)
    check(spark, QUERIES["op10_pii"], ORACLE_SQL["op10_pii"], sf)
    got = {x["doc_id"]: x["spans"] for x in QUERIES["op10_pii"](spark, sf).collect()}
    assert all("term:" in got[i] for i in range(100, 105)) and not any("term:" in got[500 + i] for i in range(5))
    assert all(got[200 + i] == "" for i in range(200))
    d = spark.read.parquet(f"{sf}/documents.parquet")
    one, other = (sorted(map(str, pii.find(d, most=most).collect())) for most in (10**6, 0))
    assert one == other  # broadcast or not


def test_pii_in_long_texts(spark):
    """Many spans on one line or on lines of their own, with the words between."""
    for sep in (" ", "\n"):
        text = sep.join(f"name{i} m{i}@x.org" for i in range(3000))
        got = pii.find(docs(spark, [text])).first()
        assert [tuple(s) for s in got["base"]] == base_spans(text)
    assert pii.find(docs(spark, ["a@b.c " * 700])).first()["base"][-1]["start"] == 699 * 6


MIT = dict((len(t), t) for n, t in licenses.TEMPLATES if n == "MIT")[max(len(t) for n, t in licenses.TEMPLATES if n == "MIT")]


def test_licence_files(spark):
    w = MIT.split()
    wrapped = "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))
    apache = "Licensed under the Apache License, Version 2.0."
    r = random.Random(22)
    rows = [("/m/LICENSE", "Copyright (c) 2020 Somebody\n\n" + wrapped), ("/m/x.py", "code"), ("/m/a/b/y.py", None), ("/n/z.js", f"{prose(r, 30)} {apache} {prose(r, 40)}"), ("/n/w.js", "x"), (None, wrapped), ("/k/twice", apache), ("/k/twice", "other text"), ("/k/v", "x")]
    rows += [(f"/hot/{i}", prose(r, 5)) for i in range(50)]
    out = licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    got = {x["path"]: (x["license"], x["via"]) for x in out}
    assert len(out) == len(rows)
    assert got["/m/LICENSE"] == ("MIT", "own") and got["/m/x.py"] == got["/m/a/b/y.py"] == ("MIT", "inherited")
    assert got["/n/z.js"] == ("Apache-2.0", "own") and got["/n/w.js"] == (None, None) and got[None] == (None, None)
    assert [x["license"] for x in out if x["path"] == "/k/twice"] == ["Apache-2.0"] * 2 and got["/k/v"] == ("Apache-2.0", "inherited")


def test_rows_of_one_id(spark):
    """Different texts under one id, repeated rows and null ids, in either kind of join."""
    r = random.Random(23)
    shared, clean = prose(r, 60, 10**6), prose(r, 80, 10**6)
    later = f"{prose(r, 20, 10**6)} {shared}"
    rows = [(1, shared), (2, later), (2, clean), (2, later), (None, shared), (3, None), (4, f"{shared} tail"), (4, f"{shared} end")]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    for most in (64_000_000, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, "MAX_BROADCAST_BYTES", most)
            got = sorted((str(x["doc_id"]), str(x["text"]), x["n_removed"]) for x in line_dedup.dedup(d).collect())
            want = [("1", shared, 0), ("2", later.replace(shared, ""), 60), ("2", clean, 0), ("2", later.replace(shared, ""), 60), ("None", shared, 0), ("3", "None", 0), ("4", "tail", 60), ("4", "end", 60)]
            assert got == sorted(want)
            near = [(x["doc_id"], x["class_id"], x["copy_of"], x["n_links"]) for x in ngram_join.join(d).collect()]
            assert sorted(near) == sorted([(1, 1, 1, 2), (2, 2, 2, 1), (2, 2, 2, 0), (2, 2, 2, 1), (3, 3, 3, 0), (4, 1, 4, 2), (4, 1, 4, 2)])
            left = sorted((str(x["doc_id"]), str(x["text"])) for x in ngram_join.keep_one(d).collect())
            assert left == sorted((str(i), str(t)) for i, t in rows if i != 4)


def test_repeated_lines(spark):
    """Runs of three short lines go, one or two lines stay; lines of white space don't count."""
    run = "a b\nc d e\nf"
    texts = [f"one two\n{run}\nthree", f"four\n a  b\n\nc d e \n f\nfive", "a b\nc d e\nsix", f"{run}\n{run}", "\n".join(["x"] * 9)]
    gone = line_dedup.brute_force(list(enumerate(texts)))
    got = {x["doc_id"]: x for x in line_dedup.dedup(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["text"].split() == [w for p, w in enumerate(t.split()) if p not in gone[i]] and got[i]["n_removed"] == len(gone[i])
    assert got[1]["text"].split() == ["four", "five"] and got[2]["text"] == texts[2] and got[0]["n_removed"] == 0
    r = random.Random(24)
    many = ["\n".join(r.choice(["u v", "w", "x y z", "t", f"n{r.randrange(40)}"]) for _ in range(r.randrange(1, 30))) for _ in range(60)]
    gone = line_dedup.brute_force(list(enumerate(many)))
    for x in line_dedup.dedup(docs(spark, many)).collect():
        assert x["n_removed"] == len(gone[x["doc_id"]])


def test_salted_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 1 / 8)
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 5}") for i in range(90)] + [(99, "alone")], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    sizes = left.groupBy("k").count().withColumnRenamed("count", "n")
    for how in ("inner", "left"):
        got = common.salted(left, right, sizes, ["k"], 91, by=["i"], how=how)
        assert sorted(map(str, got.select("i", "k", "v").collect())) == sorted(map(str, left.join(right, "k", how).select("i", "k", "v").collect()))


def test_bm25_against_brute_force():
    r = np.random.default_rng(25)
    weight = 1 / np.arange(1, 2001)
    made = [(i, r.choice(2000, n, p=weight / weight.sum()).astype("<u2")) for i, n in enumerate(r.integers(20, 900, 300))]
    tf = np.stack([np.bincount(d, minlength=2001) for _, d in made]).astype(float)
    df = (tf > 0).sum(0)
    idf, size = np.log(1 + (300 - df + 0.5) / (df + 0.5)), tf.sum(1, keepdims=True)
    mean = float(size.mean())
    bm25 = idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * size / mean))
    shard = packing.Shard(made, idf, mean, 2048)
    assert shard.common.any() and not shard.common.all()
    for seed in [*range(0, 300, 7), 299, 3]:
        assert np.allclose(shard.scores(seed), bm25[:, tf[seed] > 0].sum(1), rtol=1e-4, atol=1e-4)


def test_ids_are_those_of_tokenizers(spark, sf_dir):
    """Whole texts of every table that has some."""
    from tokenizers import Tokenizer

    files = tokens.default_files()
    t = Tokenizer.from_file(files[1])
    t.encode_special_tokens = True
    enc = tokens.encoder(*files)
    texts = [x[0] for table, c in (("documents", "text"), ("conversations", "text"), ("benchmark", "text"), ("pages", "html")) for x in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(c).collect()]
    r = random.Random(26)
    texts += ["".join(r.choice(["a", " ", "\n", "é", "日", "😀", "1", "'s", " ", "\t", "_", "İ", "​"]) for _ in range(r.randrange(60))) for _ in range(3000)]
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    for text, w in zip(texts, want, strict=True):
        assert enc.ids(text or "") == w.ids


def test_warc_is_whole(spark, tmp_path):
    import io

    record = warc.record_bytes(1, "u", b"x", "0" * 40, 1, None)
    squeeze = zlib.compressobj(wbits=31)
    data = squeeze.compress(record) + squeeze.flush(zlib.Z_SYNC_FLUSH)  # all of the record, no end
    with pytest.raises(ValueError):
        list(warc.Records(warc.inflated(io.BytesIO(data))))
    with pytest.raises(ValueError):
        warc.complete("a", 3, 4)
    big = "z" * 2000
    pages = spark.createDataFrame([(5, "u", big), (5, "v", big), (4, "u", big), (None, "u", big)], "page_id long, url string, html string")
    got = sorted((str(x["page_id"]), x["record_type"], x["refers_to"]) for x in warc.round_trip(pages).collect())
    assert got == [("4", "revisit", 5), ("5", "response", None), ("5", "response", None), ("None", "revisit", 5)]


def test_decontamination_beyond_the_bound_on_the_tables(spark, sf_dir):
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one, other = (sorted(map(str, decontam.scan(d, b, max_broadcast=most).collect())) for most in (10**6, 0))
    assert one == other


def test_near_copies_at_the_threshold(spark):
    """Pairs and clusters near 0.8, many words of which are common."""
    r = random.Random(27)
    texts = []
    for _ in range(60):
        w = prose(r, r.randrange(60, 300)).split()
        texts.append(" ".join(w))
        for _ in range(r.randrange(4)):
            v = list(w)
            for _ in range(max(1, len(v) // r.randrange(35, 70))):
                v[r.randrange(len(v))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(v))
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in ngram_join.join(docs(spark, texts)).collect()}
    assert got == ngram_join.brute_force(list(enumerate(texts)))


def test_sql_of_line_dedup_is_the_brute_force(spark, sf_dir, tmp_path):
    r = random.Random(28)
    p = [prose(r, n, 10**6) for n in (49, 50, 51, 120)]
    texts = [f"{prose(r, 9, 10**6)}\n{x} {prose(r, 5, 10**6)}\n\na\nb\nc d" for x in p for _ in "ab"] + ["", None]
    sf = planted(spark, sf_dir, tmp_path, [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)])
    gone = line_dedup.brute_force([(i, t) for i, t in enumerate(texts) if t])
    columns, rows = sql_rows(ORACLE_SQL["op8_line_dedup"], sf)
    got = {x[0]: x[1] for x in rows_of(columns, rows)}
    assert [got[i] for i in range(len(texts))] == [len(gone.get(i, ())) for i in range(len(texts))]
