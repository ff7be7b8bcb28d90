"""Lexical retrieval packing.

Documents become token ids once.  They are laid out by a minhash of their ids, so
that texts with words in common stand side by side, and cut into shards: a document
belongs to the shard in which the sum of the sizes before it lies, so shards depend on the
documents alone, not on the number of tasks.  Each shard has a BM25 inverted index over ids,
with document frequencies of the whole corpus.  All terms of a seed document retrieve unused
neighbours, which fill its window one after the other; the one that crosses the
end is cut there and its rest stays in the pool.  Documents longer than a window
fill windows of their own first.  What a shard has left, less than a window, is joined to what
the shards beside it have left; only the end of a group of GROUP shards becomes
sequences of power-of-two lengths, so nothing is padded.

Defined results: a null or empty text is just its end token; repeated rows are
documents of their own, as are rows of one id and different texts; a null id stays null;
an empty table gives no pieces; texts are encoded whole, whatever their length.  Each id
lies in exactly one piece.  Of equally good neighbours the earlier in the layout comes
first.  Only ``doc_id`` and ``text`` are read, so extra columns can't clash.  Sequence ids hold the number of
the shard or group, so a lost task that runs again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_BYTES, mix64, small_batches, written
from .tokens import default_files, encoder

WINDOW = 2048
END = 1
#: Bounds of a shard: what a task holds at once.
SHARD_DOCS, SHARD_TOKENS = 2048, 2_000_000
#: Shards whose rests are packed together.
GROUP = 1024
#: Tokens that a task packs, about, and bytes of a document's place.
PART_TOKENS = 64_000_000
PLACE_BYTES = 64
K1, B = 1.2, 0.75
#: Terms that more documents of a shard have are scored by a product of matrices, for so
#: many seeds at once; the others by their postings.
COMMON, SEEDS = 64, 256

PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
PIECES_DDL = ", ".join(f"{n} long" for n in PIECES.names)
#: A piece with its shard, and the ids of those whose sequence isn't full.
FILLED = pa.schema([*PIECES, pa.field("shard", pa.int64()), pa.field("ids", pa.binary())])
FILLED_DDL = f"{PIECES_DDL}, shard long, ids binary"


def tokenised(docs: DataFrame, files: tuple[str, str] | None = None, end: int = END) -> DataFrame:
    """(doc_id, n, ids, route): ids as little-endian unsigned 16-bit numbers (32-bit
    where the vocabulary needs them), the end id included; route is a minhash."""
    small_batches(docs.sparkSession)
    files = files or default_files()

    def encode(batches):
        enc = encoder(*files)
        kind = "<u2" if enc.size <= 1 << 16 else "<u4"
        ranks = [mix64(np.arange(enc.size + 1, dtype=np.uint64) + np.uint64(s << 32)) >> np.uint64(48) for s in (1, 2, 3, 4)]
        for batch in batches:
            n, ids, route = [], [], []
            for text in batch.column(1).to_pylist():
                got = np.array([*(enc.ids(text) if text else ()), end], kind)
                key = 0
                for r in ranks:
                    key = key << 16 | int(r[got].min())
                n.append(len(got))
                ids.append(got.tobytes())
                route.append(key - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(route, pa.int64())], names=["doc_id", "n", "ids", "route"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(encode, "doc_id long, n long, ids binary, route long")


def document_frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    """Documents with each id: a vector as long as the vocabulary."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def count(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total[np.unique(np.frombuffer(ids, kind))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "df"])

    rows = tokens.select("ids").mapInArrow(count, "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size + 1, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return out


class Shard:
    """A BM25 index over some documents' ids, and the greedy filling of windows."""

    def __init__(self, docs: list[tuple[int, np.ndarray]], idf: np.ndarray, mean: float, window: int):
        self.docs, self.idf, self.window = docs, idf, window
        size = np.array([len(ids) for _, ids in docs])
        both, tf = np.unique(np.repeat(np.arange(len(docs)) << 32, size) | np.concatenate([ids for _, ids in docs]).astype(np.int64), return_counts=True)
        owner, term = both >> 32, both & 0xFFFFFFFF
        self.terms = np.split(term, np.searchsorted(owner, np.arange(1, len(docs))))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / mean))
        order = np.argsort(term, kind="stable")
        self.key, first, df = np.unique(term[order], return_index=True, return_counts=True)
        self.first = np.append(first, len(term))
        self.owner, self.weight = owner[order], weight[order].astype(np.float32)
        # Frequent terms: which documents have them, and with what weight.
        self.common = df > COMMON
        column = np.cumsum(self.common) - 1
        row = np.repeat(np.arange(len(df)), df)
        often = self.common[row]
        self.table = np.zeros((len(docs), int(self.common.sum())), np.float32)
        self.table[self.owner[often], column[row[often]]] = self.weight[often]
        self.scored = (0, np.zeros((0, 0), np.float32))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all terms of the seed."""
        begin, block = self.scored
        if not begin <= seed < begin + len(block):
            some = self.table[seed : seed + SEEDS]
            begin, block = self.scored = (seed, (some > 0).astype(np.float32) @ self.table.T)
        at = np.searchsorted(self.key, self.terms[seed])
        at = at[~self.common[at]]
        size = self.first[at + 1] - self.first[at]
        rows = np.arange(size.sum()) + np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(at) else np.zeros(0, np.int64)
        return block[seed - begin] + np.bincount(self.owner[rows], self.weight[rows], minlength=len(self.docs))

    def neighbours(self, seed: int, free: np.ndarray) -> Iterator[int]:
        """Free documents by falling score; without a common term in order."""
        score = self.scores(seed)
        found = np.flatnonzero(free & (score > 0))
        yield from found[np.argsort(-score[found], kind="stable")].tolist()
        yield from np.flatnonzero(free & (score <= 0)).tolist()

    def sequences(self) -> Iterator[list[tuple[int, int, int]]]:
        """Each sequence: (document's place, start, length) of its pieces; the last one may be
        shorter than the window."""
        window, n = self.window, len(self.docs)
        start, left = np.zeros(n, np.int64), np.array([len(ids) for _, ids in self.docs])
        for i in np.flatnonzero(left >= window).tolist():
            for _ in range(left[i] // window):
                yield [(i, int(start[i]), window)]
                start[i] += window
            left[i] %= window
        free = left > 0
        for seed in range(n):
            while free[seed]:
                pieces, space = [], window

                def take(i: int, space: int) -> int:
                    k = int(min(space, left[i]))
                    pieces.append((i, int(start[i]), k))
                    start[i] += k
                    left[i] -= k
                    free[i] = left[i] > 0
                    return space - k

                space = take(seed, space)
                if space and free.any():
                    for i in self.neighbours(seed, free):
                        space = take(i, space)
                        if not space:
                            break
                yield pieces


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces cut into sequences of falling powers of two."""
    rest = sum(p[2] for p in pieces)
    queue = list(reversed(pieces))
    while rest:
        size = 1 << (rest.bit_length() - 1)
        rest -= size
        out = []
        while size:
            i, start, k = queue.pop()
            cut = min(k, size)
            out.append((i, start, cut))
            size -= cut
            if cut < k:
                queue.append((i, start + cut, k - cut))
        yield out


def pack(docs: DataFrame, files: tuple[str, str] | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece, the columns of PIECES."""
    files = files or default_files()
    tokens = tokenised(docs, files, end).withColumns({"crc": F.crc32("ids"), "row": F.monotonically_increasing_id()})
    tokens = written(tokens, "packing-tokens")
    size = encoder(*files).size
    kind = "<u2" if size <= 1 << 16 else "<u4"
    total = tokens.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), F.sum("n").alias("tokens")).first()
    df = document_frequencies(tokens, size)
    idf = np.log(1 + (total["docs"] - df + 0.5) / (df + 0.5))  # as long as the vocabulary
    shared, mean = docs.sparkSession.sparkContext.broadcast(idf), total["mean"] or 1.0

    def measure(batches):
        # Where each document begins in its part, in units of which a shard holds SHARD_TOKENS.
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.maximum(batch.column("n").to_numpy(), -(-SHARD_TOKENS // SHARD_DOCS))
            after = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), part, np.int64)), pa.array(after - n), pa.array(after)], names=["row", "part", "before", "after"])
            before = int(after[-1]) if len(after) else before

    # Rows are put in order without their ids.  A range layout splits even a run of equal
    # documents, so no part is too large.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total["tokens"] or 0) // PART_TOKENS))
    order = ["route", "doc_id", "n", "crc", "row"]
    laid = tokens.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("row", "n")
    laid = written(laid.mapInArrow(measure, "row long, part long, before long, after long"), "packing-layout")
    ends = laid.groupBy("part").agg(F.max("after").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    ends = ends.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("from"))
    places = laid.join(F.broadcast(ends), "part").select("row", (F.col("from") + F.col("before")).alias("at"))
    # Few places are broadcast, so that ids are shuffled once; many are joined.
    small = total["docs"] * PLACE_BYTES <= MAX_BROADCAST_BYTES
    placed = tokens.join(F.broadcast(places) if small else places, "row").withColumn("shard", F.floor(F.col("at") / SHARD_TOKENS))

    def fill(batches):
        for shard, held in by_shard(batches, kind):
            index = Shard(held, shared.value, mean, window)
            yield _filled(shard, [[(held[i][0], start, held[i][1][start : start + k], len(held[i][1])) for i, start, k in pieces] for pieces in index.sequences()], window)

    filled = written(placed.repartition(parts, "shard").sortWithinPartitions("shard", "at").select("doc_id", "ids", "shard").mapInArrow(fill, FILLED_DDL), "packing-filled")

    def join_rests(batches):
        group, rest = None, []
        for batch in batches:
            for g, doc_id, start, n, ids in zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "start", "doc_tokens", "ids")), strict=True):
                if g != group and rest:
                    yield _rests(group, rest, window)
                    rest = []
                group = g
                rest.append((doc_id, start, np.frombuffer(ids, kind), n))
        if rest:
            yield _rests(group, rest, window)

    rests = filled.where("ids is not null").withColumn("group", F.floor(F.col("shard") / GROUP))
    rests = rests.repartition("group").sortWithinPartitions("group", "shard", "sequence_id", "offset")
    ends = rests.select("group", "doc_id", "start", "doc_tokens", "ids").mapInArrow(join_rests, FILLED_DDL)
    return filled.where("ids is null").unionByName(ends).select(*PIECES.names)


def _filled(shard: int, sequences: list[list[tuple]], window: int) -> pa.RecordBatch:
    """The pieces (doc_id, start, ids, tokens of the document) of a shard's sequences."""
    rows = []
    for number, pieces in enumerate(sequences):
        full, offset = sum(len(p[2]) for p in pieces) == window, 0
        for doc_id, start, ids, n in pieces:
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, (shard << 32) + number, offset, shard, None if full else ids.tobytes()))
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(FILLED)], schema=FILLED)


def _rests(group: int, rest: list[tuple], window: int) -> pa.RecordBatch:
    """Windows from the rests of a group of shards, in their order; the last becomes powers of two."""
    pieces, out, space = [], [], window
    for i, (_, _, ids, _) in enumerate(rest):
        at = 0
        while at < len(ids):
            k = min(space, len(ids) - at)
            pieces.append((i, at, k))
            at, space = at + k, space - k
            if not space:
                out.append(pieces)
                pieces, space = [], window
    if pieces:
        out += powers_of_two(pieces)
    named = [[(rest[i][0], rest[i][1] + at, rest[i][2][at : at + k], rest[i][3]) for i, at, k in s] for s in out]
    # Beyond all numbers of shards.
    return _filled((1 << 30) + group, named, window)


def by_shard(batches, kind: str) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
    """(shard, its documents in order); a task has whole shards, one after the other."""
    now, held = None, []
    for batch in batches:
        for doc_id, ids, shard in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            held.append((doc_id, np.frombuffer(ids, kind)))
    if held:
        yield now, held


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
