"""Shards by rendezvous hashing: the draw's law, moves, slots and odd rows."""

import zlib
from collections import Counter

from pyspark.sql import functions as F
from test_contracts import ODD, docs, odd_docs

from bidlake.llm import sharding


def test_weights_and_moves(spark):
    """Shards get rows by weight; a new shard takes from all and gives nothing back, one that
    goes gives only its own."""
    d = spark.range(20000).withColumnRenamed("id", "doc_id")
    old = {3: 1.0, 5: 2.0, 8: 0.5, 9: 1.5}
    both = sharding.reassign(d, old, {11: 1.0})
    n = Counter(r["shard"] for r in both.select("shard").collect())
    assert all(abs(n[s] / 20000 - w / 5) < 0.015 for s, w in old.items())
    moved = both.where("shard <> grown_shard").select("shard", "grown_shard").collect()
    assert {r["grown_shard"] for r in moved} == {11} and {r["shard"] for r in moved} == set(old)
    assert abs(len(moved) / 20000 - 1 / 6) < 0.015
    # The same as an assignment of its own, and what goes leaves the others where they are.
    again = sharding.assign(both, {**old, 11: 1.0}, name="again")
    assert again.where("again <> grown_shard").isEmpty()
    fewer = sharding.assign(both, {s: w for s, w in old.items() if s != 5}, name="fewer")
    assert fewer.where("shard <> 5 and shard <> fewer").isEmpty()
    assert sharding.moves(both.withColumn("size", F.lit(16))).agg(F.sum("rows")).first()[0] == len(moved)


def test_slots_of_odd_rows(spark):
    """A third of all rows equal; nulls, empty and long texts; no row lost, no slot twice."""
    d = odd_docs(spark).unionByName(docs(spark, ["the same"] * 600).withColumn("doc_id", F.lit(77).cast("long")), allowMissingColumns=True)
    src = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in d.collect())
    seen = []
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = sharding.number(d, {0: 1.0, 1: 1.0, 2: 3.0}, {3: 1.0}).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == src
        for shard in {r["shard"] for r in got}:
            assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
        seen.append(sorted(map(repr, got)))
    assert seen[0] == seen[1]
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert sharding.number(d.limit(0), {0: 1.0}, {1: 1.0}).count() == 0


def test_written_shards(spark, tmp_path):
    d = docs(spark, [*ODD, *(f"text {i}" for i in range(200))])
    sharding.write_shards(d, f"file://{tmp_path}/shards", {s: 1.0 for s in range(5)})
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.select(*d.columns).exceptAll(d).isEmpty() and back.count() == d.count()
    assert sharding.assign(back.drop("shard"), {s: 1.0 for s in range(5)}, name="want").join(back.select("doc_id", "shard"), "doc_id").where("want <> shard").isEmpty()
