"""Shared helpers of the corpus operators: tables, work folders, word hashing."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import work_root, written

__all__ = ["FOLD", "join_lists", "keyed", "list_fields", "mix64", "new_folder", "powers", "salted", "small_batches", "window_hashes", "word_bounds", "word_hashes", "written"]

#: Rows and bytes per Arrow batch handed to a Python worker.  Texts may be long, so
#: batches are kept small; this bounds a worker's memory, not the work done.
ARROW_ROWS, ARROW_BYTES = 512, 16_000_000

#: ASCII upper case to lower, every ASCII byte that is no letter or digit to a
#: blank, every other byte (all of a non-ASCII character) as it is.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the cluster's shared one."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): th is a hash of the text, so that rows of one id and
    different texts are told apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


#: Bytes of (id, list) rows, about, up to which that side of a join is broadcast.
MAX_BROADCAST_BYTES = 64_000_000


def join_lists(docs: DataFrame, lists: DataFrame, size: Column, how: str = "inner", most: int | None = None) -> DataFrame:
    """docs (doc_id, th, ...) joined to lists (__id, __th, ...), which are tables in a
    folder already.  ``size`` is about the bytes of a row; while their sum is within the
    bound the lists are broadcast and the texts stay where they are, beyond it the join is
    shuffled."""
    total = lists.agg(F.sum(size + 64)).first()[0] or 0
    small = total <= (MAX_BROADCAST_BYTES if most is None else most)
    return docs.join(F.broadcast(lists) if small else lists, (F.col("doc_id") == F.col("__id")) & (F.col("th") == F.col("__th")), how)


#: A key with more than this share of the rows is dealt to several tasks.
HOT = 1 / 2000


def salted(left: DataFrame, right: DataFrame, sizes: DataFrame, keys: list[str], total: int, by: list[str], how: str = "inner") -> DataFrame:
    """left joined to right on keys, where no key brings more than about HOT of the
    rows of left into one task.  sizes (*keys, n), a table in a folder: the rows of left
    with each key.  The keys above that share are 1 / HOT at most, hence broadcast; left
    deals their rows by a hash of the columns ``by`` and right repeats its row for each
    deal, at most 2 / HOT times in all.  ``right`` is read twice where there are such keys."""
    share = max(1.0, total * HOT)
    salts = F.ceil(F.col("n") / share).cast("int").alias("__salts")
    hot = sizes.where(F.col("n") > share).select(*keys, salts)
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    dealt = F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("__salts")).cast("int")).alias("__salt")
    left = left.join(hot, keys, "left").select(*left.columns, dealt)
    every = right.join(hot, keys, "left_anti").withColumn("__salt", F.lit(0))
    every = every.unionByName(right.join(hot, keys).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts"))
    return left.join(every, [*keys, "__salt"], how).drop("__salt")


def small_batches(spark: SparkSession) -> None:
    """Batches for texts: a session that asks for smaller ones keeps them."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def list_fields(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of lists of structs as offsets and one array per field; a null list is an
    empty one."""
    values = column.values
    return column.offsets.to_numpy(), {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}


_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> _S33)
    x = x * _MIX1
    x ^= x >> _S33
    x *= _MIX2
    x ^= x >> _S33
    return x


_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_POW = np.array([pow(_BASE, i, 1 << 64) for i in range(65)], dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of the base modulo 2**64 for exponents 0 .. n-1."""
    global _POW
    while len(_POW) < n:
        _POW = np.concatenate([_POW, _POW * np.uint64(pow(_BASE, len(_POW), 1 << 64))])
    return _POW[:n]


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the runs without ASCII white space."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = np.ones(len(data) + 2, bool)
    np.take(_IS_SPACE, np.frombuffer(data, np.uint8), out=space[1:-1], mode="clip")
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


#: Bytes whose words are hashed in one go: it bounds the memory for long texts.
HASHED = 1 << 16
_INVERSE = np.array([pow(_BASE, -i, 1 << 64) for i in range(2)], dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    """What ``powers`` has to be multiplied by to give 1 modulo 2**64, for exponents 0 .. n-1."""
    global _INVERSE
    while len(_INVERSE) < n:
        _INVERSE = np.concatenate([_INVERSE, _INVERSE * np.uint64(pow(_BASE, -len(_INVERSE), 1 << 64))])
    return _INVERSE[:n]


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, many words at once: a polynomial in its bytes, as the
    difference of two running sums over all bytes, brought back to the word's first place."""
    out = np.zeros(len(start), np.uint64)
    raw = np.frombuffer(data, np.uint8)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + HASHED)))
        first = int(start[lo])
        sums = np.zeros(int(end[hi - 1]) - first + 1, np.uint64)
        term = raw[first : first + len(sums) - 1].astype(np.uint64)
        term += np.uint64(1)
        term *= powers(len(term))
        np.cumsum(term, out=sums[1:])
        place = start[lo:hi] - first
        out[lo:hi] = mix64((sums[end[lo:hi] - first] - sums[place]) * _inverse_powers(int(place[-1]) + 1)[place])
        lo = hi
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` words (empty if there are fewer): a polynomial
    in the words, put together from runs of powers of two."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    total, done, run, size = None, 0, words, 1
    while done < k:
        if k & size:
            part = run[done : done + n]
            total = part if total is None else total * np.uint64(pow(_BASE, size, 1 << 64)) + part
            done += size
        if done < k:
            run = run[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + run[size:]
            size *= 2
    return mix64(total)
