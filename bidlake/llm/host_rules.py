"""Quality rules with host verdicts.

Each document is measured and held against a few rules.  The failures of each
rule are summed by host, every host's rate is shrunk towards the corpus by a beta
prior fitted to all hosts (method of moments), and a host whose shrunk rate
exceeds ``host_limit`` for any rule fails as a whole; its verdict is joined back
to its documents.  A document is kept if it passes the base rules and its host
passes.

Defined results: a null or empty text has no words and fails the base rules; a
document without a host is judged by itself; repeated rows, and rows of one id, each
count and are each measured; a null id stays null; a shrunk rate equal to the limit
passes; an empty table gives an empty result.  Words are runs without ASCII white space;
texts are measured whole, whatever their length.  Only the named columns are read, so
extra ones can't clash.

One host may hold most rows: hosts are aggregated before any shuffle, and their verdicts,
a row each, are joined by the optimizer's choice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written

HOST_LIMIT = 0.5

#: Rule name -> when a document fails it, on the measured columns.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 10 * n_words)",
}

_NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    blanks = len(data) - len(data.translate(None, _BLANKS))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in data.split(b"\n"):
        if line.strip(_BLANKS):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), len(text) - blanks, symbols, dup, repeated_words(words), lines


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 2_000_000:  # three numbers no longer fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the measured numbers, a row per document."""
    small_batches(docs.sparkSession)

    def measure(batches):
        for batch in batches:
            got = [measure_text(t) for t in batch.column(2).to_pylist()]
            cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *cols], names=["doc_id", "host", *_NUMBERS])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(measure, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _NUMBERS))


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n, fails: an array in the order of RULES), a row per host."""
    fails = [F.count_if(F.expr(cond)).alias(name) for name, cond in RULES.items()]
    return measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), *fails)


def beta_prior(hosts: int, n: int, fails: int, squares: float, n2: float) -> tuple[float, float]:
    """(a, b) of the prior by moments, from sums over hosts: hosts, documents n,
    failures, fails**2 / n, and n**2.  Without spread between hosts the prior is as
    strong as the corpus; it is never weaker than one document."""
    if not n:
        return 0.5, 0.5
    mean = fails / n
    noise = mean * (1 - mean)
    if hosts < 2 or not noise:
        strength = float(n)
    else:
        spread = (squares - n * mean * mean - (hosts - 1) * noise) / (n - n2 / n)
        strength = float(n) if spread <= noise / (n + 1.0) else max(1.0, noise / spread - 1.0)
    return mean * strength, (1 - mean) * strength


def host_verdicts(rates: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_failed, rate_<rule>): shrunk rates and the verdict, a row per host."""
    sums = [F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2")]
    for r in RULES:
        sums += [F.sum(r).alias(f"x_{r}"), F.sum(F.col(r).cast("double") * F.col(r) / F.col("n")).alias(f"s_{r}")]
    total = rates.agg(*sums).first()  # one row, whatever the number of hosts
    shrunk = []
    for r in RULES:
        a, b = beta_prior(total["hosts"], total["n"] or 0, total[f"x_{r}"] or 0, total[f"s_{r}"] or 0.0, total["n2"] or 0.0)
        shrunk.append(((F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b))).alias(f"rate_{r}"))
    out = rates.select("host", *shrunk)
    return out.withColumn("host_failed", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > host_limit)


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: doc_id, host, the measured numbers, base_failed, host_failed, kept."""
    measured = written(measures(docs, key, text, host), "measures")  # narrow; read for the rates and again for the verdicts
    verdicts = host_verdicts(host_rates(measured), host_limit).select(F.col("host").alias("__host"), "host_failed")
    joined = measured.join(verdicts, F.col("host") == F.col("__host"), "left").drop("__host")
    base = F.expr(f"({RULES['few_words']}) or ({RULES['repeats']})")
    host_failed = F.coalesce("host_failed", F.lit(False))
    return joined.select("doc_id", "host", *_NUMBERS, base.alias("base_failed"), host_failed.alias("host_failed"), (~base & ~host_failed).alias("kept"))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


def _oracle() -> str:
    blank = r"[\x20\x09-\x0D]"
    rate = []
    for r in RULES:
        strength = f"CASE WHEN h < 2 OR x_{r} = 0 OR x_{r} = nn THEN nn ELSE CASE WHEN v_{r} <= q_{r} / (nn + 1.0) THEN nn ELSE greatest(1.0, q_{r} / v_{r} - 1.0) END END"
        rate.append(f"({r} + (x_{r} / nn) * ({strength})) / (n + ({strength}))")
    return rf"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(string_split_regex(text, '{blank}+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
nr AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{blank}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(nr.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
      FROM w LEFT JOIN nr USING (doc_id)),
f AS (SELECT *, ({RULES['few_words']}) OR ({RULES['repeats']}) AS base_failed FROM m),
r AS (SELECT host, count(*) AS n, {', '.join(f'CAST(count(*) FILTER (WHERE {c}) AS DOUBLE) AS {r}' for r, c in RULES.items())} FROM m WHERE host IS NOT NULL GROUP BY host),
s AS (SELECT count(*) AS h, CAST(sum(n) AS DOUBLE) AS nn, sum(CAST(n AS DOUBLE) * n) AS n2, {', '.join(f'sum({r}) AS x_{r}, sum({r} * {r} / n) AS s_{r}' for r in RULES)} FROM r),
p AS (SELECT *, {', '.join(f'(x_{r} / nn) * (1 - x_{r} / nn) AS q_{r}, (s_{r} - nn * (x_{r} / nn) * (x_{r} / nn) - (h - 1) * ((x_{r} / nn) * (1 - x_{r} / nn))) / (nn - n2 / nn) AS v_{r}' for r in RULES)} FROM s),
v AS (SELECT host, greatest({', '.join(rate)}) > {HOST_LIMIT} AS host_failed FROM r, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(host_failed, false) AS kept, coalesce(host_failed, false) AS host_failed
FROM f LEFT JOIN v USING (host)
"""


ORACLE = _oracle()
