"""Places where a job once did less than the whole."""

import random
from pathlib import Path

import pytest
from test_jobs import sequential

from bidlake.operators import identity
from bidlake.sources.tables import work_root


def clusters(spark, records, keys, library):
    """What cluster_batch says, and how many tables it wrote."""
    root = Path(work_root(spark).removeprefix("file://"))
    before = len(list(root.glob("cluster-*")))
    got = identity.cluster_batch(
        spark.createDataFrame([(i, c) for c, i in records], "record_id long, created_at long"), spark.createDataFrame([(i, t, k) for i, ks in keys.items() for t, k in ks], "record_id long, tier int, key string"),
        spark.createDataFrame([(t, k, v) for (t, k), v in library.items()], "tier int, key string, item_id string"),
    )
    return {x["record_id"]: (x["item_id"], x["verdict"]) for x in got.collect()}, len(list(root.glob("cluster-*"))) - before


def test_batch_clusters_in_few_rounds(spark):
    """A chain of 2,000 records, each sharing a key with the one before."""
    n = 2000
    order = list(range(n))
    random.Random(3).shuffle(order)
    records = [(i, order[i]) for i in range(n)]
    keys = {order[i]: {(1, f"k{i}"), (1, f"k{i + 1}")} for i in range(n)}
    got, rounds = clusters(spark, records, keys, {(2, "none"): "lib"})
    assert got == sequential(records, keys, {}) and rounds < 15


@pytest.mark.parametrize("seed", range(3))
def test_batch_clusters_with_many_failures(spark, seed):
    """Long chains, library items, placeholder keys and records that meet two items."""
    r = random.Random(seed)
    records = [(r.randrange(200), i) for i in range(400)]
    keys = {i: {(r.choice((1, 1, 2, 3)), f"k{(i // 7 * 3 + r.randrange(9)) % 150}") for _ in range(r.randrange(4))} for _, i in records}
    library = {(r.choice((1, 2, 3)), f"k{r.randrange(150)}"): f"lib{i % 5}" for i in range(12)}
    got, _ = clusters(spark, records, keys, library)
    want = sequential(records, keys, library)
    assert sum(v == "FAILED" for _, v in want.values()) > 20
    assert got == want


def test_batch_clusters_in_a_long_chain(spark):
    """Each record shares a key with the one before; from the 36th on one fails."""
    n = 38
    records = [(i, i) for i in range(n)]
    keys = {i: {(1, f"k{i}"), (1, f"k{i + 1}")} for i in range(n)}
    keys[35].add((1, "other"))
    library = {(1, "other"): "lib"}
    got = identity.cluster_batch(
        spark.createDataFrame(records, "record_id long, created_at long"), spark.createDataFrame([(i, t, k) for i, ks in keys.items() for t, k in ks], "record_id long, tier int, key string"),
        spark.createDataFrame([(t, k, v) for (t, k), v in library.items()], "tier int, key string, item_id string"),
    )
    assert {x["record_id"]: (x["item_id"], x["verdict"]) for x in got.collect()} == sequential(records, keys, library)


def test_contains_join_where_every_piece_is_common(spark, monkeypatch):
    """Words that most texts share, in orders of their own: what is joined stays near the hits."""
    from bidlake.operators import search

    r = random.Random(4)
    words = [f"{a}{b}" for a in ("steel", "brass", "plain", "round") for b in ("ring", "tube", "lamp", "bolt")]
    texts = [" ".join(r.sample(words, 10)) for _ in range(400)]
    queries = [" ".join(r.choice(texts).split()[2:5]) for _ in range(40)] + ["steelring", "no such words here"]
    seen = []
    write = search.written

    def counted(df, name):
        out = write(df, name)
        if name == "contains-rare":
            seen.append(out.where("not more").selectExpr("query_id", "c").agg({"c": "sum"}).first()[0] or 0)
        return out

    monkeypatch.setattr(search, "written", counted)
    q, t = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    got = {(x[0], x[1]) for x in search.contains_join(q, t, common=8).collect()}
    want = {(i, j) for i, a in enumerate(queries) for j, b in enumerate(texts) if a in b}
    assert got == want and sum(seen) <= 3 * len(want)


def test_rates_of_a_hot_source(spark):
    """Half of all runs are of one source: its groups are minutes, and the sums are those of a loop."""
    import datetime

    from pyspark.sql import functions as F

    from bidlake.sources import feed

    r = random.Random(6)
    start = datetime.datetime(2024, 3, 1, 23, 0)
    rows = [(i, r.choice([1, 1, 1, 2, 3, None]), start + datetime.timedelta(seconds=r.randrange(7200)), r.randrange(9), r.choice([1, 2, None])) for i in range(600)]
    runs = spark.createDataFrame(rows, "id long, source_id long, created_at timestamp, requested int, reserved int")
    for key in ("spark.sql.adaptive.coalescePartitions.enabled",):
        spark.conf.set(key, "false")
    try:
        got = feed.rate_usage(runs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    some = lambda v: sum(x for x in v if x is not None) if any(x is not None for x in v) else None
    for x in got:
        minute = [b[4] for b in rows if b[1] == x["source_id"] and 0 <= (x["created_at"] - b[2]).total_seconds() <= 60]
        day = [b[3] for b in rows if b[1] == x["source_id"] and b[2].date() == x["created_at"].date() and (b[2], b[0]) <= (x["created_at"], x["id"])]
        assert (x["minute_usage"], x["day_usage"]) == (some(minute), some(day))
    assert len(got) == 600 and len({x["task"] for x in got if x["source_id"] == 1}) == 4


def test_nearest_vectors_by_cells(spark):
    """Clustered vectors with filters, ties, repeats and vectors without length: the rows of all
    pairs, from less than half of them."""
    import numpy as np

    from bidlake.operators import vectors

    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 8)) * 3
    made = [(int(i), [float(x) for x in centres[i % 12] + r.normal(size=8) * 0.3], "ab"[i % 2]) for i in range(600)]
    made += [(600 + i, made[i][1], "a") for i in range(20)] + [(700, [0.0] * 8, "a"), (701, [0.0] * 8, "b")]
    items = spark.createDataFrame(made, "item_id long, vector array<double>, type string")
    asked = [(i, v, None if i % 3 else "a") for i, v, _ in made[::25]] + [(9000, [0.0] * 8, "b"), (9001, [float(x) for x in -centres[0]], "zz")]
    q = spark.createDataFrame(asked, "query_id long, vector array<double>, type string")
    rows = lambda df: sorted((x["query_id"], x["rank"], x["item_id"], round(x["similarity"], 9)) for x in df.collect())
    for k in (3, 80):
        assert rows(vectors.vector_topk(q, items, k, ["type"], cells=12)) == rows(vectors.vector_topk(q, items, k, ["type"], cells=0))
    plain = q.where("type is null")
    assert vectors.compared_share(plain, items, 3, 12) < 0.5
