"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the docs of the next.  All but the last return the
columns of documents.

Defined results of every stage: columns pass through under any name (the last returns its
own); rows of one id and different texts are documents of their own, rows equal in id and
text come out alike; an empty table gives no rows; texts are read whole, whatever their
length.  What is null, empty or tied is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm import decontam, langid, line_dedup, ngram_join, packing
from bidlake.llm.common import written

#: A document goes if more than this share of its words stands in earlier documents, in
#: runs of 25 words or more or whole lines: what is left of a copy is where it was changed.
MOST_REPEATED = 0.7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts that are null or have no letter go, and those
    of which the network finds more to be of no language than it finds in 19 of 20 of all labelled
    held-out documents, three quarters of the text at least; texts of fewer than 100
    bytes say too little for that and stay. Learned from the documents themselves;
    documents without an id or a label are judged like others; where no document has a label
    all go, since no language is learned."""
    net = langid.fit(docs, none=True)
    judged = docs.withColumn("__language", langid.predictor(spark, net)(F.col("text").cast("string")))
    fits = (F.col("__language.lang_pred") != "und") & (F.col("__language.none") <= net.none_limit)
    return judged.where(fits).select(*docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that stand in an earlier one (by id); those
    that for the most part repeat earlier ones go. A null or empty text has
    nothing to lose and stays, as does a document without an id."""
    words = F.size(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cleaned = line_dedup.dedup(docs)
    gone = (F.col("n_removed") > 0) & (F.col("n_repeated") > MOST_REPEATED * (F.col("n_removed") + words))
    return cleaned.where(~gone).select(*docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; a document
    without words or without an id stays."""
    return ngram_join.keep_one(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those of which more than half the words are
    such go. Null and empty texts stay, null ids are cut like others."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens; a null or empty text is its end token."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeats),
    ("ngram_join", remove_near_copies),
    ("decontamination", remove_benchmarks),
    ("packing", pack_sequences),
]

#: SQL can't say a trained network or greedy packing; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
