"""Benchmark decontamination.

Every benchmark item is cut into windows of ``n`` normalised words (an item of
fewer words, but not none, is one window).  While the windows fit a checked
bound they are broadcast as a hash set and every training token window is
looked up in it; beyond the bound both sides are joined on the window hash.
Either way the words of a window are compared before it counts, so a hash
collision never marks anything, and both ways give the same rows.

Defined results: a null or empty text has no words and is clean; an item
without words has no window; repeated windows and repeated items all count as
items of their own id; items without an id are ignored; documents without an id
are scanned and cut like others, rows of one id and different texts are kept
apart and repeated rows come out alike; an empty table gives no rows, an empty
benchmark marks nothing.  Texts are scanned whole, whatever their length.  ``scan`` reads
only doc_id, item_id and text; ``remove`` passes all columns through under any name.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, salted, small_batches, window_hashes, word_bounds, word_hashes, written

N = 10
#: Windows that are broadcast at most: of each a hash, the place of its words and its
#: item, 24 bytes, and the items' words.
MAX_BROADCAST_WINDOWS = 1_000_000

SCAN = "doc_id long, row string, n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>"


def fold_words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def item_windows(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    if len(words) <= n:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def folded(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The folded text, where its words start and end, and their hashes."""
    data = text.encode().translate(FOLD) if text else b""
    start, end = word_bounds(data)
    return data, start, end, word_hashes(data, start, end)


class WindowSet:
    """The benchmark's windows: for each length the sorted hashes, with the item and the
    place of each, and the items' words to verify hits."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.names = [i for i, _ in items]
        self.texts = [folded(t)[:3] for _, t in items]
        by: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for code, (_, text) in enumerate(items):
            words = folded(text)[3]
            if len(words):
                length = min(n, len(words))
                h = window_hashes(words, length)
                by.setdefault(length, []).append((h, np.full(len(h), code), np.arange(len(h))))
        self.lengths = {}
        for length, rows in sorted(by.items()):
            h, code, at = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(h, kind="stable")
            self.lengths[length] = (h[order], code[order].astype(np.int32), at[order].astype(np.int32))

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, the places of every verified window, and their items."""
        data, start, end, words = folded(text)
        spans, found = [], set()
        for length, (table, code, at) in self.lengths.items():
            h = window_hashes(words, length)
            if not len(h):
                continue
            place = np.minimum(np.searchsorted(table, h), len(table) - 1)
            for p in np.flatnonzero(table[place] == h).tolist():
                want = data[start[p] : end[p + length - 1]].split()
                j = int(place[p])
                while j < len(table) and table[j] == h[p]:
                    item, i = int(code[j]), int(at[j])
                    other, a, b = self.texts[item]
                    if other[a[i] : b[i + length - 1]].split() == want:
                        spans.append((p, p + length))
                        found.add(self.names[item])
                    j += 1
        return len(words), spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan_broadcast(docs: DataFrame, bench: list[tuple[str, str | None]], n: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(bench, n))

    def scan(batches):
        windows = shared.value
        for batch in batches:
            rows = []
            for doc_id, text, row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n_words, spans, items = windows.hits(text)
                rows.append(_scanned(doc_id, row, n_words, spans, items))
            yield _batch(rows)

    return docs.mapInArrow(scan, SCAN)


def _scanned(doc_id, row: str, n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    spans = merged(spans)
    return doc_id, row, n_words, sum(b - a for a, b in spans), sorted(items), [{"start": a, "stop": b} for a, b in spans]


_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


_WINDOW = "key string, len int, hash long, pos int, words string"


def _windows(rows: DataFrame, lengths: list[int] | None, n: int) -> DataFrame:
    """The columns of _WINDOW for (key, text): every window of the lengths, or, for items
    (None), of n or all of their words; words only for items."""

    def cut(batches):
        for batch in batches:
            keys, sizes, hashes, at, words = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
            for key, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                data, start, end, of = folded(text)
                for length in lengths if lengths is not None else [min(n, len(of))] if len(of) else []:
                    h = window_hashes(of, length)
                    keys += [key] * len(h)
                    sizes += [length] * len(h)
                    hashes.append(h)
                    at.append(np.arange(len(h)))
                    words += [None] * len(h) if lengths is not None else [" ".join(data[start[i] : end[i + length - 1]].decode().split()) for i in range(len(h))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(words, pa.string())], names=["key", "len", "hash", "pos", "words"])

    return rows.mapInArrow(cut, _WINDOW)


def _scan_join(docs: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    """The way beyond the broadcast bound: a shuffled join on the hash of the window; then
    the words are compared where the text is."""
    items = _windows(bench.select("item_id", "text"), None, n).select(F.col("key").alias("item_id"), "len", "hash", "words").distinct()
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # n values at most
    windows = _windows(docs.dropDuplicates(["row"]).select("row", "text"), lengths or [n], n).drop("words")
    # How often each item's window stands in the documents; a frequent one is dealt to several tasks.
    sizes = written(windows.groupBy("len", "hash").agg(F.count("*").alias("n")).join(items.select("len", "hash").distinct(), ["len", "hash"]), "decontam-windows")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hit = salted(windows, items, sizes, ["len", "hash"], total, by=["key", "pos"])
    per = hit.groupBy(F.col("key").alias("__row")).agg(F.collect_list(F.struct("pos", "len", "item_id", "words")).alias("likely"))

    def verify(batches):
        for batch in batches:
            rows = []
            for doc_id, text, row, likely in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = fold_words(text)
                good = [x for x in likely or [] if b" ".join(words[x["pos"] : x["pos"] + x["len"]]) == x["words"].encode()]
                rows.append(_scanned(doc_id, row, len(words), [(x["pos"], x["pos"] + x["len"]) for x in good], {x["item_id"] for x in good}))
            yield _batch(rows)

    return docs.join(per, F.col("row") == F.col("__row"), "left").select("doc_id", "text", "row", "likely").mapInArrow(verify, SCAN)


def _row() -> Column:
    """What tells rows apart, null ids and texts of one id included."""
    return F.concat_ws(":", F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))


def scan(docs: DataFrame, bench: DataFrame, n: int = N, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Per document: doc_id, row (id and hash of the text), n_words, n_hit, items (ids of items with occurring
    windows, as strings, sorted) and spans (merged word ranges that are hit)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row().alias("row"))
    bench = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    # An upper bound of windows and of the text the driver would hold, from one small aggregate.
    size = bench.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0)).alias("chars"), F.count("*").alias("rows")).first()
    if size["chars"] // 2 + size["rows"] <= max_broadcast:
        return _scan_broadcast(docs, [(r[0], r[1]) for r in bench.collect()], n)
    return _scan_join(docs, bench, n)


def remove(docs: DataFrame, bench: DataFrame, n: int = N, drop_share: float = 0.5, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """Documents without benchmark text, all columns kept: hit spans are cut out
    of the text; a document of whose words more than ``drop_share`` are hit goes.
    ``n_chars``, where it exists, follows the new text."""
    small_batches(docs.sparkSession)
    found = scan(docs, bench, n, max_broadcast).where("n_hit > 0").groupBy(F.col("row").alias("__row")).agg(F.first("spans").alias("__spans"), F.first(F.col("n_hit") / F.col("n_words")).alias("__share"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all"), _row().alias("__of"), F.col("text").cast("string").alias("__text"))
    hit = rows.join(found, F.col("__of") == F.col("__row"), "left").where(~F.coalesce(F.col("__share") > drop_share, F.lit(False)))
    cut = F.col("__spans").isNotNull()
    hit = hit.withColumn("__new", F.when(cut, _cut(F.when(cut, F.col("__text")), "__spans")))
    new = {"text": F.when(cut, F.col("__new")).otherwise(F.col("__all.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__all.n_chars"))
    return hit.select(*[(new[c] if c in new else F.col(f"__all.`{c}`")).alias(c) for c in docs.columns])


@F.pandas_udf(T.StringType())
def _cut(text, spans):
    return text.combine(spans, lambda t, s: t if s is None else cut_spans(t, [(x["start"], x["stop"]) for x in s]))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given ranges of folded words and the blank after each."""
    data = text.encode()
    start, end = word_bounds(data.translate(FOLD))
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : start[a]])
        at = int(start[b]) if b < len(start) else int(end[b - 1])
    return b"".join([*out, data[at:]]).decode(errors="ignore")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], bench: list[tuple], n: int = N) -> list[tuple]:
    """The contract, word by word (for tests)."""
    out = []
    for doc_id, text in docs:
        words, hit, items = fold_words(text), set(), set()
        for item_id, item in bench:
            for w in item_windows(fold_words(item), n):
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        items.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
