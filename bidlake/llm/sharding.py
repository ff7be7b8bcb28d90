"""Records into weighted shards by rendezvous hashing.

Every shard draws a number for the record's key, and the largest wins: u is uniform over
(0, 1) by the digest of key and shard, and -weight / ln(u) is largest for a shard with a
chance proportional to its weight.  Key and shards alone decide, so a record is where it
was as long as its shard is there, and a new shard takes records only into itself: of n
equal shards one more takes a share of 1 / (n + 1) and nothing else moves.  The draw is a
column of the row, hence no shuffle; numbers within the shards come from one range shuffle
of narrow rows, in which no key has to stay together.

Defined results: the key is the id as text, and rows without an id share the key ''; a null
text has no bytes, hence a size of 16, and the checksum of nothing, 0; rows of one id go to one
shard and have slots of their own, equal rows too; slots follow (id, checksum, size); an
empty table gives no rows; texts of any length count whole.  Of two shards with equal draws
the smaller number wins.  Only doc_id and text are read for ``number``; ``assign`` keeps all
columns and replaces one of the name it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: The shards of the registered query, of one weight.
SHARDS = 40
#: What a record takes besides its text.
OVERHEAD = 16
#: Narrow rows that one task of the numbering sorts, about.
PART_ROWS = 1 << 20
#: Files of a shard hold so many bytes of text, about.
FILE_BYTES = 256_000_000
#: Hexadecimal digits of the digest that make the draw: 52 bits, what a double holds.
DIGITS = 13


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """The shard's number for the key; the largest wins."""
    digest = F.substring(F.md5(F.concat_ws(":", key, shard.cast("string"))), 1, DIGITS)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -weight / F.ln(u)


def winner(key: Column, weights: dict[int, float]) -> Column:
    """(draw, other): the largest draw among the shards; other is minus the shard."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("there must be shards, each with a weight above 0")
    shards = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(weights.items())])
    return F.array_max(F.transform(shards, lambda s: F.struct(draw(key, s["shard"], s["weight"]).alias("draw"), (-s["shard"]).alias("other"))))


def key_of(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def assign(docs: DataFrame, weights: dict[int, float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """Adds the shard of each row, by the column ``key``."""
    return docs.withColumn(name, -winner(key_of(key), weights)["other"])


def reassign(docs: DataFrame, old: dict[int, float], new: dict[int, float], key: str = "doc_id") -> DataFrame:
    """Adds ``shard`` under the old shards and ``grown_shard`` under those and the new ones;
    the old ones draw once."""
    k = key_of(key)
    best = docs.withColumns({"__best": winner(k, old), "__new": winner(k, new)})
    grown = -F.greatest("__best", "__new")["other"]
    return best.withColumns({"shard": -F.col("__best.other"), "grown_shard": grown}).drop("__best", "__new")


def moves(placed: DataFrame) -> DataFrame:
    """(shard, grown_shard, rows, bytes) of the rows that change their shard."""
    return placed.where("shard <> grown_shard").groupBy("shard", "grown_shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def number(docs: DataFrame, old: dict[int, float], new: dict[int, float]) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard): slots are 0, 1, 2 .. in each shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # Written, so that what tells equal rows apart is fixed.
    placed = written(reassign(narrow, old, new).withColumn("row", F.monotonically_increasing_id()), "shards-placed")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // PART_ROWS))
    order = ["shard", "doc_id", "text_crc32", "size", "row"]
    laid = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = written(laid.drop("row").withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "shards-laid")
    # A shard's rows of a part are neighbours, so a slot is where the part's rows of the
    # shard begin and how far in the row stands.
    runs = laid.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("shard", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return laid.join(runs, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, folder: str, weights: dict[int, float], key: str = "doc_id") -> None:
    """The documents under shard=<number>/ folders, in files of about FILE_BYTES: a large
    shard's rows are dealt to several tasks by their place in the input."""
    placed = assign(docs, weights, key)
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + OVERHEAD)).first()[0] or 0
    files = max(1, -(-total // (FILE_BYTES * len(weights))))
    deal = F.pmod(F.monotonically_increasing_id(), F.lit(files)) if files > 1 else F.lit(0)
    dealt = placed.withColumn("__deal", deal).repartition(min(files * len(weights), 100_000), "shard", "__deal").drop("__deal")
    dealt.write.partitionBy("shard").parquet(folder)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    equal = {s: 1.0 for s in range(SHARDS)}
    out = number(spark.read.parquet(f"{sf_dir}/documents.parquet"), equal, {SHARDS: 1.0})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


ORACLE = f"""
WITH poly AS (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
texts AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
octets AS MATERIALIZED (SELECT id, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM texts),
sums AS MATERIALIZED (SELECT id, xor(4294967295, list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295)) AS text_crc32 FROM octets, poly),
draws AS (SELECT id, s, -1 / ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || s), 1, {DIGITS}) AS BIGINT) + 0.5::DOUBLE) / {float(16**DIGITS)}::DOUBLE) AS draw FROM texts, range({SHARDS + 1}) r(s)),
best AS (SELECT id, arg_max(s, (draw, -s)) FILTER (s < {SHARDS}) AS shard, arg_max(s, (draw, -s)) AS grown_shard FROM draws GROUP BY id),
placed AS (SELECT doc_id, CAST(octet_length(encode(text)) + {OVERHEAD} AS BIGINT) AS size, text_crc32, shard, grown_shard FROM texts JOIN sums USING (id) JOIN best USING (id))
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard FROM placed
"""
