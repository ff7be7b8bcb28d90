"""Every stage of the pipeline on planted documents, and all of them in a row."""

import random
import re

from test_contracts import SCHEMA, check_pieces

import corpus_pipeline as cp

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def english(r, n):
    words = "the and of in that for with was on are this have from they which their one had not but what all were when we there can an your each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    made = [w if r.random() < 0.6 else w[0] + r.choice(words) + r.choice(["ing", "ed", "ly", "tion"]) for w in r.choices(words, k=n)]
    return ". ".join(" ".join(made[i : i + 9]) for i in range(0, n, 9)) + "."


def planted(spark, sf_dir):
    """(documents, kinds: name -> ids, texts)"""
    r = random.Random(31)
    items = [x["text"] for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if x["text"]]
    long = [t for t in items if len(t.split()) >= 14]
    rows, kinds = [], {k: [] for k in ("clean", "exact", "near", "passage", "benchmark", "junk")}

    def add(kind, text, lang="en"):
        kinds[kind].append(len(rows))
        rows.append((len(rows), text, lang, "s", len(text or "")))

    for _ in range(60):
        add("clean", english(r, r.randrange(120, 400)))
    for i in range(12):
        add("exact", rows[i][1])
    for i in range(12, 24):
        w = rows[i][1].split()
        for _ in range(2):
            w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
        add("near", " ".join(w))
    for i in range(24, 34):
        w = rows[i][1].split()[20:90]
        add("passage", f"{english(r, 120)} {' '.join(w)} {english(r, 90)}")
    for i in range(10):
        add("benchmark", f"{english(r, 90)} {long[i % len(long)]} {english(r, 90)}")
    for t in (None, "", "123 456", " \n"):
        add("junk", t)
    return rows, kinds, long


def as_docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_on_planted_documents(spark, sf_dir):
    rows, kinds, long = planted(spark, sf_dir)
    docs = as_docs(spark, rows)
    text = dict((i, t) for i, t, *_ in rows)

    after = {x["doc_id"]: x["text"] for x in cp.identify_language(spark, docs, sf_dir).collect()}
    assert set(after) == set(text) - set(kinds["junk"]) and all(after[i] == text[i] for i in after)

    letters = docs.where("text is not null and text <> ''")
    after = {x["doc_id"]: x["text"] for x in cp.remove_repeats(spark, letters, sf_dir).collect()}
    assert not set(kinds["exact"]) & set(after) and len(set(kinds["near"]) & set(after)) <= 4
    assert all(after[i] == text[i] for i in kinds["clean"] + kinds["junk"][2:])
    for i, p in zip(kinds["passage"], range(24, 34), strict=True):
        assert " ".join(text[p].split()[20:90]) not in after[i] and len(after[i].split()) == len(text[i].split()) - 70

    after = cp.remove_near_copies(spark, docs, sf_dir)
    assert after.columns == COLUMNS
    left = {x["doc_id"] for x in after.collect()}
    assert not set(kinds["exact"]) & left and len(set(kinds["near"]) & left) <= 1 and set(kinds["clean"] + kinds["passage"]) <= left

    after = {x["doc_id"]: x["text"] for x in cp.remove_benchmarks(spark, docs, sf_dir).collect()}
    for i, t in zip(kinds["benchmark"], long * 10, strict=False):
        assert t not in after[i] and len(after[i].split()) >= 180
    assert all(after[i] == text[i] for i in kinds["clean"])

    assert check_pieces(cp.pack_sequences(spark, docs, sf_dir).collect(), [t for _, t, *_ in rows]) == 0


def test_pipeline_end_to_end(spark, sf_dir, tmp_path):
    import os

    rows, kinds, long = planted(spark, sf_dir)
    os.symlink(f"{sf_dir}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    as_docs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = cp.run(spark, str(tmp_path)).collect()
    size = {}
    for p in pieces:
        size[p["doc_id"]] = p["doc_tokens"]
    assert set(kinds["clean"]) <= set(size) and set(kinds["passage"] + kinds["benchmark"]) <= set(size)
    assert not set(kinds["exact"] + kinds["junk"]) & set(size) and len(set(kinds["near"]) & set(size)) <= 1
    assert min(size.values()) > 1  # no document is its end token alone
    assert [name for name, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "packing"]


def test_empty_and_odd_documents(spark, sf_dir):
    empty = as_docs(spark, [])
    odd = as_docs(spark, [(None, "words without an id at all", None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "x", "en", "s", 1), (3, "y z", "en", "s", 3), (4, "long " * 5000, "en", "s", 25000), (4, "long " * 5000, "en", "s", 25000)])
    odd = odd.withColumns({c: odd["doc_id"] for c in ("runs", "__id", "row", "hash", "language")})
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        out = stage(spark, odd, sf_dir)
        assert out.count() > 0 and (out.columns == odd.columns or re.match("doc_id", out.columns[0]))


def test_gibberish_is_in_no_language(spark, sf_dir):
    """Letters in random order go, documents of the given table stay."""
    r = random.Random(23)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 200").select(*COLUMNS)
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(400)) for _ in range(10)]
    made = spark.createDataFrame([(10**6 + i, t, None, "s", 400) for i, t in enumerate(junk)], SCHEMA)
    left = {x["doc_id"] for x in cp.identify_language(spark, given.unionByName(made), sf_dir).select("doc_id").collect()}
    assert len([i for i in left if i >= 10**6]) <= 1
    assert {x["doc_id"] for x in given.collect()} <= left
