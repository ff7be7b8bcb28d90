"""Exact token counts of a corpus.

Documents are aggregated to a histogram by encoded length.  From its suffix sums
every question about a context limit is answered without another pass: how many
documents and tokens there are, quantiles of the length, and how many tokens
remain when each document is truncated to the limit.

Defined results: a null or empty text has 0 tokens and is counted; repeated rows
each count, as do rows of one or of no id; an empty table gives an empty histogram.  Texts
are encoded whole, whatever their length.  Only ``text`` is read, so extra columns can't
clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import default_files, encoder

#: Lengths per block of the suffix sums: blocks are summed first, then lengths
#: within a block, so no task needs the whole histogram.
BLOCK = 1024


def lengths(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """One row (n_tokens) per document."""
    small_batches(docs.sparkSession)
    files = files or default_files()

    def count(batches):
        enc = encoder(*files)
        for batch in batches:
            n = [len(enc.ids(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens long")


def histogram(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """(n_tokens, docs): how many documents have exactly this length; written, since
    what is asked of it reads it several times."""
    return written(lengths(docs, files).groupBy("n_tokens").agg(F.count("*").alias("docs")), "token-histogram")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L that occurs: docs and tokens of exactly L; docs_ge and tokens_ge
    of L or more; docs_total and tokens_total; truncated_total, the tokens that
    remain under a limit of L; and rank_le, the documents of at most L tokens."""
    hist = hist.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(everything).alias("docs_total"), F.sum("t").over(everything).alias("tokens_total"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = hist.join(blocks, "block").select(
        "n_tokens", "docs", "tokens", (F.sum("docs").over(within) + F.col("d_after")).alias("docs_ge"),
        (F.sum("tokens").over(within) + F.col("t_after")).alias("tokens_ge"), "docs_total", "tokens_total",
    )
    return sums.select(
        "*", (F.col("tokens_total") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        (F.col("docs_total") - F.col("docs_ge") + F.col("docs")).alias("rank_le"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit (any number, not only lengths that occur): documents that
    fit, documents cut, tokens kept under truncation, and tokens in all."""
    # One wide aggregate over the histogram, unfolded into a row per limit.
    over, n, docs = (lambda x: F.col("n_tokens") > x), F.col("n_tokens"), F.col("docs")
    rows = [
        F.struct(
            F.lit(int(x)).cast("long").alias("max_tokens"),
            F.sum(F.when(over(x), 0).otherwise(docs)).alias("docs_fit"), F.sum(F.when(over(x), docs).otherwise(0)).alias("docs_cut"),
            F.sum(F.when(over(x), docs * int(x)).otherwise(n * docs)).alias("tokens_kept"), F.sum(n * docs).alias("tokens_total"),
        )
        for x in limits
    ]
    return sums.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def quantiles(sums: DataFrame, at: list[float]) -> DataFrame:
    """Per probability p: the smallest length L with at least p of all documents at
    most L tokens long."""
    rank = lambda p: F.min(F.when(F.col("rank_le") >= F.lit(p) * F.col("docs_total"), F.col("n_tokens")))
    wide = sums.agg(F.array(*[F.struct(F.lit(float(p)).alias("p"), rank(p).alias("n_tokens")) for p in at]).alias("q"))
    return wide.select(F.inline("q"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))
