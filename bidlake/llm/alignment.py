"""Which tokens of two tokenizers stand for the same places, counted over a corpus.

Texts are encoded by a byte-level BPE vocabulary (A) and by a piece model (B).  Where an A
and a B token end at the same byte they are linked, and those places cut both sides into
groups.  How often a pair of ids is linked in the corpus can't be kept in a task's memory, so
it is counted outside of it:

1. Each task gathers the (pair, document, links) records of many documents, sorts them side by
   side (all of a B id, within it by A id), cuts them by radix of the B id, and hands on each
   cut as a zstd run of a table in the shared folder, with the pairs' sums beside it.
2. Per radix the sums of all runs are merged by a k-way heap, in two rounds, so that
   no task opens more than FAN runs at once.  Since a B id's pairs come one after the other,
   its largest count is known when it ends.
3. Per radix, dealt to several tasks by run where there is much, the records stream past the
   counts, both in the same order; what each run's documents gain goes back as one row
   per run, where it is added up.

A pair in every document is one entry per run in step 2 and one record per document,
dealt by runs, in step 3.  Tasks hold the distinct pairs of a radix (RADIXES of them), FAN
runs, and one run's documents.

Defined results: a text that is null or empty, or whose tokens' bytes joined are not a space
and the text for either side (a control character, U+2581 in the text), has no tokens: zeros and
''.  Each row is a document, repeated rows and null ids too; ties for a B id's largest count
are all best; an empty table gives no rows; texts are encoded whole, whatever their length.
Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import default_files, encoder

#: Links of the documents whose records make one run, about.
RUN_LINKS = 1 << 20
#: Cuts of a run by the B id; runs that are merged at once; bytes of records a task streams.
RADIXES, FAN, TASK_BYTES = 64, 256, 128_000_000
#: Bits of a record's key: the pair before the document's place in its run.
A_BITS, PLACE_BITS = 20, 24

_L = pa.int64()
DOC_FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_DOC = pa.struct([(f, pa.string() if f == "groups_sha256" else _L) for f in DOC_FIELDS])
RUN = pa.schema([("run", _L), ("radix", pa.int32()), ("pairs", pa.binary()), ("records", pa.binary()), ("n", _L), ("docs", pa.list_(_DOC))])
RESULT = pa.schema([*((f, _L) for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
_DOCS_DDL = "array<struct<" + ", ".join(f"{f}: {'string' if f == 'groups_sha256' else 'long'}" for f in DOC_FIELDS) + ">>"
RUN_DDL = f"run long, radix int, pairs binary, records binary, n long, docs {_DOCS_DDL}"
RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers, with each id's bytes and the text of ids before each separator."""

    def __init__(self, files: tuple[str, str], model: str):
        import base64

        import sentencepiece

        self.a, self.b = encoder(*files), sentencepiece.SentencePieceProcessor(model_file=model)
        with open(files[0], "rb") as f:
            ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        self.a_bytes = [ranks.get(i, b"") for i in range(self.a.size)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        top = max(len(self.a_bytes), len(self.b_bytes))
        self.words = [f"{i}{by}" for by in ",|;" for i in range(top)]
        self.top = top

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none where the bytes are not those of the text."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        whole = (" " + text).encode("utf-8", "surrogatepass")
        a, b = self.a.ids(" " + text), self.b.encode(text)
        for ids, table in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join(map(table.__getitem__, ids)) != whole:
                return none
        return np.array(a, np.int64), np.array(b, np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last A and the last B token of each group."""
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        return np.searchsorted(end_a, both), np.searchsorted(end_b, both)

    def said(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3: the groups' ids."""
        code = np.concatenate([a, b])
        code[last_a] += self.top
        code[len(a) + last_b] += 2 * self.top
        # An A token of group g comes after all tokens of the groups before, then g's B tokens.
        order = np.empty(len(code), np.int64)
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        order[: len(a)] = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
        order[len(a) :] = np.arange(len(b)) + (last_a + 1)[group_b]
        line = np.empty(len(code), np.int64)
        line[order] = code
        return "".join(map(self.words.__getitem__, line.tolist()))[:-1]


@lru_cache(2)
def tokenizers(files: tuple[str, str], model: str) -> Pair:
    """One pair per worker process."""
    return Pair(files, model)


def pack(*arrays: np.ndarray) -> bytes:
    """A zstd block of 64-bit numbers, each array as steps from one to the next."""
    raw = b"".join(np.diff(a.astype(np.int64), prepend=0).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(block: bytes, n: int) -> list[np.ndarray]:
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    return [np.cumsum(a) for a in np.frombuffer(raw, np.int64).reshape(n, -1)]


def runs(docs: DataFrame, files: tuple[str, str], model: str) -> DataFrame:
    """The rows of RUN: per run and radix the pairs with their sums and the records, and per run
    one row (radix -1) of its documents."""
    small_batches(docs.sparkSession)

    def write(batches):
        pair = tokenizers(files, model)
        number = TaskContext.get().partitionId() << 32
        kept, keys, links = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = pair.tokens(text)
                sha = ""
                if len(a):
                    last_a, last_b = pair.groups(a, b)
                    sha = hashlib.sha256(pair.said(a, b, last_a, last_b).encode()).hexdigest()
                    keys.append((b[last_b] << A_BITS | a[last_a]) << PLACE_BITS | len(kept))
                    links += len(last_a)
                n = len(last_a) if len(a) else 0
                # No token is without bytes, so a place where both end is one link.
                kept.append((doc_id, len(a), len(b), n, n, sha))
                if links >= RUN_LINKS or len(kept) == 1 << PLACE_BITS:
                    yield from run(number, kept, keys)
                    kept, keys, links, number = [], [], 0, number + 1
        if kept:
            yield from run(number, kept, keys)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(write, RUN_DDL)


def run(number: int, kept: list[tuple], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    rows = [{"run": number, "radix": -1, "pairs": None, "records": None, "n": len(kept), "docs": [dict(zip(DOC_FIELDS, k, strict=True)) for k in kept]}]
    key, links = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    pairs = key >> PLACE_BITS
    radix = pairs >> A_BITS & RADIXES - 1
    for r in np.unique(radix).tolist():
        at = radix == r
        some, place, n = pairs[at], key[at] & (1 << PLACE_BITS) - 1, links[at]
        first = np.flatnonzero(np.diff(some, prepend=-1))
        rows.append({"run": number, "radix": r, "pairs": pack(some[first], np.add.reduceat(n, first)), "records": pack(some, place, n), "n": len(some), "docs": None})
    yield pa.RecordBatch.from_pylist(rows, schema=RUN)


def merged(blocks: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, sum) in order, by a heap over the heads of sorted runs."""
    heads = heapq.merge(*[zip(*(c.tolist() for c in unpack(b, 2)), strict=True) for b in blocks])
    for pair, same in groupby(heads, key=itemgetter(0)):
        yield pair, sum(n for _, n in same)


def merge(sums: DataFrame) -> DataFrame:
    """(radix, pairs): the runs of each radix within a partition, which come sorted by
    radix, as one; runs that wait are merged whenever FAN of them are there."""

    def write(batches):
        radix, waiting = None, []
        for batch in batches:
            for r, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if waiting and (r != radix or len(waiting) == FAN):
                    block_now = pack(*columns(merged(waiting), 2)) if len(waiting) > 1 else waiting[0]
                    if r != radix:
                        yield _one(radix, block_now)
                    waiting = [block_now] if r == radix else []
                radix = r
                waiting.append(block)
        if waiting:
            yield _one(radix, pack(*columns(merged(waiting), 2)) if len(waiting) > 1 else waiting[0])

    return sums.select("radix", "pairs").mapInArrow(write, "radix int, pairs binary")


def _one(radix: int, block: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([block], pa.binary())], names=["radix", "pairs"])


def columns(rows: Iterator[tuple], n: int) -> list[np.ndarray]:
    got = np.fromiter((v for row in rows for v in row), np.int64).reshape(-1, n)
    return [got[:, i] for i in range(n)]


def best(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 where the count is the largest of the pair's B id; pairs in order, a B id's together."""
    side = pairs >> A_BITS
    first = np.flatnonzero(np.diff(side, prepend=-1))
    top = np.maximum.reduceat(counts, first) if len(first) else counts
    return (counts == np.repeat(top, np.diff(np.append(first, len(side))))).astype(np.int64)


def pair_counts(table: DataFrame) -> DataFrame:
    """(radix, pairs): one block of all pairs and their links in the corpus per radix."""
    spark = table.sparkSession
    sums = table.where("radix >= 0").select("run", "radix", "pairs")
    deals = max(1, -(-sums.groupBy("radix").count().agg(F.max("count")).first()[0] // FAN)) if not sums.isEmpty() else 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(RADIXES * deals, 100_000))
    dealt = sums.withColumn("deal", F.pmod(F.xxhash64("run"), F.lit(deals))).repartition(parts, "radix", "deal").sortWithinPartitions("radix", "deal", "run")
    return written(merge(merge(dealt).repartition(RADIXES, "radix").sortWithinPartitions("radix")), "alignment-counts")


def counts(blocks: DataFrame) -> DataFrame:
    """(b, a, links, best) of every pair in the corpus, from the blocks of pair_counts."""

    def write(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                p, n = unpack(block, 2)
                yield pa.RecordBatch.from_arrays([pa.array(p >> A_BITS), pa.array(p & (1 << A_BITS) - 1), pa.array(n), pa.array(best(p, n) == 1)], names=["b", "a", "links", "best"])

    return blocks.select("pairs").mapInArrow(write, "b long, a long, links long, best boolean")


def gains(table: DataFrame, blocks: DataFrame) -> DataFrame:
    """(run, gain): per run and radix the places of its documents, their links that are best,
    and the sums of their links' counts."""
    spark = table.sparkSession
    records = table.where("radix >= 0").select("radix", "run", "records")
    size = records.groupBy("radix").agg(F.sum(F.octet_length("records")).alias("b")).agg(F.max("b")).first()[0] or 0
    deals = max(1, -(-size // TASK_BYTES))
    dealt = records.withColumn("deal", F.pmod(F.xxhash64("run"), F.lit(deals)).cast("int"))
    everywhere = blocks.select("radix", F.lit(-1).cast("long").alias("run"), F.col("pairs").alias("records"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(RADIXES * deals, 100_000))
    laid = everywhere.unionByName(dealt).repartition(parts, "radix", "deal").sortWithinPartitions("radix", "deal", "run")

    def stream(batches):
        p = n = top = np.zeros(0, np.int64)
        for batch in batches:
            for r, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r == -1:  # the radix's counts come before its runs
                    p, n = unpack(block, 2)
                    top = best(p, n)
                    continue
                pairs, place, links = unpack(block, 3)
                at = np.searchsorted(p, pairs)
                where, back = np.unique(place, return_inverse=True)
                won = np.bincount(back, links * top[at], len(where)).astype(np.int64)
                total = np.zeros(len(where), np.int64)
                np.add.at(total, back, links * n[at])
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([pack(where, won, total)], pa.binary())], names=["run", "gain"])

    return laid.select("run", "records").mapInArrow(stream, "run long, gain binary")


def align(docs: DataFrame, files: tuple[str, str] | None = None, model: str | None = None) -> DataFrame:
    """One row per document, the columns of RESULT."""
    table = written(runs(docs, files or default_files(), model or piece_model()), "alignment-runs")
    given = gains(table, pair_counts(table))
    whole = table.where("radix = -1").select("run", "docs", F.lit(None).cast("binary").alias("gain"))
    both = whole.unionByName(given.select("run", F.lit(None).cast(_DOCS_DDL).alias("docs"), "gain"))
    many = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(whole.count(), 100_000))
    # A run's documents come before what they gain.
    laid = both.repartition(many, "run").sortWithinPartitions("run", F.col("gain").isNotNull())

    def add(batches):
        rows: list = []
        won = total = np.zeros(0, np.int64)
        for batch in batches:
            for listed, gain in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if gain is None:
                    yield from flat(rows, won, total)
                    rows, won, total = listed, np.zeros(len(listed), np.int64), np.zeros(len(listed), np.int64)
                else:
                    where, w, t = unpack(gain, 3)
                    won[where] += w
                    total[where] += t
        yield from flat(rows, won, total)

    return laid.mapInArrow(add, RESULT_DDL)


def flat(rows: list, won: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    if rows:
        own = {f: [r[f] for r in rows] for f in DOC_FIELDS}
        own |= {"n_best": won, "count_sum": total}
        yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) for f in RESULT], schema=RESULT)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
