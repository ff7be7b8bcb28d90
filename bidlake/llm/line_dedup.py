"""Deletion of lines and passages that repeat, found by winnowing.

A text is read as two rows of units: its lines (those with words; white space does not
count) and its words.  Of every ``LINES`` neighbouring line hashes the smallest is a
fingerprint, so a run of ``LINES`` lines in two places is sure to share one.  Passages
may also begin and end in the middle of lines, which no line hash shows; for them the
hashed unit is the run of ``K`` words from each word, and of every ``W`` neighbouring
hashes the smallest is a fingerprint: a run of K + W - 1 words is sure to share one.

Both kinds then take the same way.  The earliest place (doc_id, hash of the text,
position) of a fingerprint is its origin; other places are joined to it, the units
around both are compared and the match is extended both ways as far as they agree.  The
origin may hold less of a run than two later texts share: runs around fingerprints that
this leaves open are hashed whole, to 128 bits, and each is joined to its own earliest
place.  Deleted is what lies in a run of ``LINES`` lines or of ``min_words``
words that also stands at an earlier place, and nothing else, so the first copy stays.

Defined results: a null text stays null and an empty one empty; documents without an
id are left as they are; rows equal in id and text are one document and come out
alike, rows of one id and different texts are documents of their own, in the order of
the texts' hashes; a document that only repeats others ends with no words but stays a
row; texts are read whole, whatever their length; ties of position do not occur; an empty
table gives no rows.  Columns other than doc_id, text and n_chars pass through under any
name, but for n_removed, n_runs and n_repeated, which the result's own replace.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, join_lists, keyed, list_fields, mix64, powers, salted, small_batches, window_hashes, word_bounds, word_hashes, written

WORDS, LINES_KIND = 0, 1
K, W = 25, 26
LINES = 3
MIN_WORDS = K + W - 1
#: (units hashed together, hashes in a window) of each kind.
SHAPE = {WORDS: (K, W), LINES_KIND: (1, LINES)}
#: Units of an origin that are compared as one piece.
BLOCK = 256
_ID = "doc_id long, th long"
_PLACE = ["doc_id", "th", "kind"]
_ORIGIN = ["odoc", "oth", "kind", "oblock"]


class Units:
    """The word and line hashes of some texts one after the other, and where each text's
    and each word's place is."""

    def __init__(self, texts: list[str | None]):
        data = [t.encode() if t else b"" for t in texts]
        self.offset = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
        joined = b"\n".join(data)
        self.start, self.end = word_bounds(joined)
        self.joined = joined
        breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
        first = np.unique(np.append(0, np.searchsorted(self.start, breaks)))
        first = first[first < len(self.start)]
        #: First word of each line that has one, and the number of words.
        self.first = np.append(first, len(self.start))
        at = np.searchsorted(self.start, self.offset)
        #: First unit of each text, and the number of units.
        self.at = {WORDS: at, LINES_KIND: np.searchsorted(first, at)}

    @cached_property
    def units(self) -> dict[int, np.ndarray]:
        words, first = word_hashes(self.joined, self.start, self.end), self.first[:-1]
        lines = words
        if len(words):
            place = np.arange(len(words)) - np.repeat(first, np.diff(self.first))
            lines = mix64(np.add.reduceat(words * powers(int(place.max()) + 1)[place], first))
        return {WORDS: words, LINES_KIND: lines}

    def of(self, kind: int, i: int) -> np.ndarray:
        return self.units[kind][self.at[kind][i] : self.at[kind][i + 1]]

    def words(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the words of a text, in its bytes."""
        a, b = self.at[WORDS][i : i + 2]
        return self.start[a:b] - self.offset[i], self.end[a:b] - self.offset[i]

    def word_spans(self, kind: int, i: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if kind == WORDS:
            return spans
        first = self.first[self.at[kind][i] :] - self.at[WORDS][i]
        return [(int(first[a]), int(first[b])) for a, b in spans]


#: Characters of texts that are read together.
TOGETHER = 1 << 18


def together(texts: list[str | None]):
    """(first, Units) of texts up to the bound, or of one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > TOGETHER:
            yield lo, Units(texts[lo:i])
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, Units(texts[lo:])


def least(kind: int, min_words: int = MIN_WORDS) -> int:
    """Units of a run that is deleted."""
    return LINES if kind == LINES_KIND else max(min_words, MIN_WORDS)


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every window of w values."""
    size, out = 1, x
    while size * 2 <= w:
        out = f(out[:-size], out[size:])
        size *= 2
    return out if size == w else f(out[: len(x) - w + 1], out[w - size :])


def winnowed(units: np.ndarray, at: np.ndarray, length: int, k: int, w: int) -> tuple[np.ndarray, ...]:
    """(hash, text, place, thin, first, last) of the window minima of texts whose units
    lie between the bounds ``at``.  thin: equal ones of the text were left out; first and
    last: the starts of the runs of ``length`` units of which a fingerprint is the
    smallest hash, last < first where there is none."""
    if len(units) < k + w - 1:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, bool, np.int64, np.int64))
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    h = window_hashes(units, k)
    lowest = _slide(h, w, np.minimum)
    whole = of[: len(lowest)] == of[k + w - 2 :]  # windows within one text
    edge = np.zeros(w - 1, np.uint64)
    most = _slide(np.concatenate([edge, np.where(whole, lowest, 0), edge]), w, np.maximum)
    every = np.flatnonzero((most == h) & (h > 0))
    place, thin = every, np.zeros(len(every), bool)
    mark = h[every] ^ mix64(of[every].astype(np.uint64) + np.uint64(1))
    _, back, count = np.unique(mark, return_inverse=True, return_counts=True)
    if len(count) < len(mark):
        again = count[back] > 1
        kept = np.concatenate([thinned(h, every[again & (of[every] == i)], w // 2) for i in np.unique(of[every][again])])
        gone = again & ~np.isin(every, kept)
        place = every[~gone]
        thin = np.isin(mark[~gone], mark[gone])
    ok = whole
    if length > k + w - 1:
        ok = np.zeros(len(lowest), bool)
        ok[: max(0, len(units) - length + 1)] = of[: max(0, len(units) - length + 1)] == of[length - 1 :]
    start = place[:, None] - np.arange(w - 1, -1, -1)
    good = (start >= 0) & (start < len(lowest))
    start = np.clip(start, 0, len(lowest) - 1)
    good &= ok[start] & (lowest[start] == h[place][:, None])
    some, row = good.any(1), np.arange(len(place))
    first = np.where(some, start[row, good.argmax(1)], place + 1)
    last = np.where(some, start[row, w - 1 - good[:, ::-1].argmax(1)], place)
    text = of[place]
    return h[place], text, place - at[text], thin, first - at[text], last - at[text]


def thinned(h: np.ndarray, at: np.ndarray, apart: int) -> np.ndarray:
    """Of equal fingerprints in one text, those at least ``apart`` units apart: text of
    a short period would else have one at every repeat, each at another distance from
    the origin.  A window still holds one where the period is short."""
    last: dict[int, int] = {}
    kept = []
    for p, value in zip(at.tolist(), h[at].tolist(), strict=True):
        if p - last.get(value, -apart) >= apart:
            last[value] = p
            kept.append(p)
    return np.array(kept, np.int64)


def runs_of(h: np.ndarray, places: np.ndarray, thin: np.ndarray, settled: np.ndarray, length: int, k: int, w: int) -> np.ndarray:
    """The starts of the runs of ``length`` units outside the settled spans of which
    one of the places is the smallest of the hashes h, or any with its hash where it is
    thin."""
    n = len(h) + k - length
    if n < 1 or not len(places):
        return np.zeros(0, np.int64)
    lowest = _slide(h, w, np.minimum)[:n]
    wanted = np.isin(lowest, h[places[thin]]) if thin.any() else np.zeros(n, bool)
    start = places[:, None] - np.arange(w)
    inside = (start >= 0) & (start < n)
    start = np.clip(start, 0, n - 1)
    wanted[start[inside & (lowest[start] == h[places][:, None])]] = True
    for a, b in settled.tolist():
        wanted[a : max(a, b - length + 1)] = False
    return np.flatnonzero(wanted)


def _columns(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """Arrays of several texts, one after the other, as a batch of these columns."""
    kinds = {"long": np.int64, "int": np.int32, "byte": np.int8, "boolean": bool}
    names, types = zip(*(c.split() for c in ddl.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, kinds[t]), *(r[i] for r in rows)]).astype(kinds[t])) for i, t in enumerate(types)], names=list(names))


_PRINTS = f"hash long, {_ID}, place long"
_RUNS = f"hash long, hash2 long, {_ID}, place long"
_SECOND = np.uint64(0x5851F42D4C957F2D)


def packed(pos: np.ndarray, first: np.ndarray, last: np.ndarray, thin: np.ndarray, kind: int) -> np.ndarray:
    """A fingerprint's place and what goes with it in one number, in the order of places."""
    return pos << 16 | (pos + 1 - first) << 10 | (pos - last) << 4 | thin.astype(np.int64) << 1 | kind


def unpacked(rows: DataFrame) -> DataFrame:
    """place as kind, pos, thin, first and last."""
    part = lambda by, mask: F.shiftright("place", by).bitwiseAND(mask).cast("int")
    rows = rows.withColumns({"kind": part(0, 1), "thin": part(1, 1) == 1, "pos": F.shiftright("place", 16).cast("int"), "__a": part(10, 63), "__b": part(4, 63)})
    return rows.withColumns({"first": F.col("pos") + 1 - F.col("__a"), "last": F.col("pos") - F.col("__b")}).drop("place", "__a", "__b")


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of _PRINTS; positions count units of the kind."""

    def winnow(batches):
        for batch in batches:
            ids, ths, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            for lo, units in together(batch.column(2).to_pylist()):
                for kind, (k, w) in SHAPE.items():
                    h, text, pos, thin, first, last = winnowed(units.units[kind], units.at[kind], least(kind, min_words), k, w)
                    rows.append((h.view(np.int64), ids[lo + text], ths[lo + text], packed(pos, first, last, thin, kind)))
            yield _columns(rows, _PRINTS)

    return docs.mapInArrow(winnow, _PRINTS)


def _matches(runs: dict[str, np.ndarray], lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(kind, a, b): the matches of one document, whose runs are rows lo .. hi.  Pieces of one
    match are joined before any bound is applied, so runs of different matches don't add up."""
    by: dict[tuple[int, int, int, int], list[list[int]]] = {}
    for *match, a, b in sorted(zip(*(runs[c][lo:hi].tolist() for c in ("kind", "odoc", "oth", "diag", "a", "b")), strict=True)):
        at = by.setdefault(tuple(match), [])
        if at and a <= at[-1][1]:
            at[-1][1] = max(b, at[-1][1])
        else:
            at.append([a, b])
    return [(kind, a, b) for (kind, *_), at in by.items() for a, b in at]


def _merged_runs(matches: list[tuple[int, int, int]], min_words: int) -> dict[int, list[tuple[int, int]]]:
    """Per kind the spans of one document in matches of min_words words or LINES lines."""
    bound = {WORDS: min_words, LINES_KIND: LINES}
    return {kind: merged((a, b) for of, a, b in matches if of == kind and b - a >= bound[kind]) for kind in SHAPE}


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _unsettled(marked: DataFrame, runs: DataFrame, min_words: int) -> DataFrame:
    """(__id, __th, places: (kind, pos, thin), spans: (kind, a, b)): per document the
    fingerprints whose runs are still open, and the spans that are settled.  A run around
    a fingerprint's origin is the earliest of its kind, and those equal to it are
    settled, unless fingerprints were left out."""
    triple = lambda names: T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in names.split()]))
    schema = T.StructType([T.StructField("__id", T.LongType()), T.StructField("__th", T.LongType()), T.StructField("places", triple("kind pos thin")), T.StructField("spans", triple("kind a b"))])

    def left_open(batches):
        for batch in batches:
            at, p = list_fields(batch.column(2))
            runs_at, runs = list_fields(batch.column(3))
            ids, ths, places, spans = [], [], [], []
            for i, (doc_id, th) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                settled = _merged_runs(_matches(runs, runs_at[i], runs_at[i + 1]), min_words)
                mine = {c: v[at[i] : at[i + 1]] for c, v in p.items()}
                keep = np.zeros(len(mine["pos"]), bool)
                for kind, found in settled.items():
                    starts, ends = np.array([a for a, _ in found] or [0]), np.array([b for _, b in found] or [0])
                    j = np.searchsorted(starts, mine["first"], "right") - 1
                    covered = (j >= 0) & (ends[j] >= mine["last"] + least(kind, min_words))
                    keep |= (mine["kind"] == kind) & (mine["thin"].astype(bool) | ((mine["last"] >= mine["first"]) & ~covered))
                if keep.any():
                    ids.append(doc_id)
                    ths.append(th)
                    places.append([{"kind": k, "pos": x, "thin": int(t)} for k, x, t in zip(*(mine[c][keep].tolist() for c in ("kind", "pos", "thin")), strict=True)])
                    spans.append([{"kind": k, "a": a, "b": b} for k, s in settled.items() for a, b in s])
            of = lambda names: pa.list_(pa.struct([(n, pa.int32()) for n in names.split()]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(places, of("kind pos thin")), pa.array(spans, of("kind a b"))], names=["__id", "__th", "places", "spans"])

    asked = marked.where(F.col("thin") | _elsewhere()).groupBy("doc_id", "th").agg(F.collect_list(F.struct("kind", "pos", F.col("thin").cast("int").alias("thin"), "first", "last")).alias("places"))
    both = asked.join(_by_document(runs), (F.col("doc_id") == F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    return both.select("doc_id", "th", "places", "runs").mapInArrow(left_open, schema)


def open_runs(docs: DataFrame, unsettled: DataFrame, min_words: int) -> DataFrame:
    """The columns of _RUNS for the runs that are still open: two hashes of each, from
    unlike hashes of its units."""

    def emit(batches):
        for batch in batches:
            at, places = list_fields(batch.column(3))
            spans_at, spans = list_fields(batch.column(4))
            rows = []
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, units in together(batch.column(2).to_pylist()):
                hashes = {kind: window_hashes(units.units[kind], k) for kind, (k, _) in SHAPE.items()}
                whole = {kind: (window_hashes(u, least(kind, min_words)), window_hashes(mix64(u ^ _SECOND), least(kind, min_words))) for kind, u in units.units.items()}
                for j in range(len(units.offset) - 1):
                    i = lo + j
                    p, s = ({c: v[o[i] : o[i + 1]] for c, v in f.items()} for o, f in ((at, places), (spans_at, spans)))
                    for kind in np.unique(p["kind"]).tolist():
                        mine, done = p["kind"] == kind, s["kind"] == kind
                        a, b = units.at[kind][j], units.at[kind][j + 1] - SHAPE[kind][0] + 1
                        pos = runs_of(hashes[kind][a : max(a, b)], p["pos"][mine], p["thin"][mine] > 0, np.stack([s["a"][done], s["b"][done]], 1), least(kind, min_words), *SHAPE[kind])
                        none = np.zeros(len(pos), np.int64)
                        one, two = (x[units.at[kind][j] + pos].view(np.int64) for x in whole[kind])
                        rows.append((one, two, none + ids[i], none + ths[i], packed(pos, pos, pos, none, kind)))
            yield _columns(rows, _RUNS)

    size = 12 * (F.size("places") + F.size("spans"))
    return join_lists(docs, unsettled, size).select("doc_id", "th", "text", "places", "spans").mapInArrow(emit, _RUNS)


_REGION = f"odoc long, oth long, kind int, oblock int, {_ID}, diag int, side int, first int, units binary"


def _regions(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The 32-bit unit hashes of the wanted ranges; wanted: doc_id, th, kind, odoc, oth,
    oblock, diag, side, lo, hi, of which a document has no more than it has fingerprints."""
    fields = ["odoc", "oth", "kind", "oblock", "diag", "side", "lo", "hi"]
    lists = wanted.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct(*fields)).alias("ranges"))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def emit(batches):
        for batch in batches:
            at, r = list_fields(batch.column(3))
            rows = []
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, units in together(batch.column(2).to_pylist()):
                short = {kind: (x >> np.uint64(32)).astype("<u4") for kind, x in units.units.items()}
                for j in range(len(units.offset) - 1):
                    i = begin + j
                    of = {kind: x[units.at[kind][j] : units.at[kind][j + 1]] for kind, x in short.items()}
                    for odoc, oth, kind, oblock, diag, side, lo, hi in zip(*(r[f][at[i] : at[i + 1]].tolist() for f in fields), strict=True):
                        lo = max(0, lo)
                        rows.append((odoc, oth, kind, oblock, ids[i], ths[i], diag, side, lo, of[kind][lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in _REGION.split(", ")])

    lists = written(lists, "dedup-lists")
    return join_lists(docs, lists, F.size("ranges") * 40).select("doc_id", "th", "text", "ranges").mapInArrow(emit, _REGION)


def equal_runs(a: np.ndarray, b: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, from, to) of the places in which a and b, rows of values between the bounds
    ``at``, are equal throughout, for at least k[row] places."""
    size = np.diff(at)
    # A place that is not equal behind each row.
    same = np.zeros(len(a) + len(size) + 1, np.int8)
    same[np.arange(1, len(a) + 1) + np.repeat(np.arange(len(size)), size)] = a == b
    edge = np.flatnonzero(np.diff(same))
    s, e = edge[::2], edge[1::2]
    begin = at[:-1] + np.arange(len(size))
    row = np.searchsorted(begin, s, "right") - 1
    long = e - s >= k[row]
    return row[long], (s - begin[row])[long], (e - begin[row])[long]


def _pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of binary arrays of 32-bit values: all values, and the bounds of each row's."""
    pieces = column.to_pylist()
    return np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(np.array([0, *(len(x) // 4 for x in pieces)]))


_RUN = f"{_ID}, kind int, odoc long, oth long, diag int, a int, b int"


def _verified(pairs: DataFrame) -> DataFrame:
    """The columns of _RUN: ranges of a document equal to its origin's, shifted by diag."""

    def compare(batches):
        for batch in batches:
            doc_id, th, kind, odoc, oth, diag, first, ofirst = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 5, 6, 8))
            (x, x_at), (y, y_at) = _pieces(batch.column(7)), _pieces(batch.column(9))
            shift = ofirst + diag  # where the origin's piece starts in the document
            lo = np.maximum(first, shift)
            size = np.maximum(0, np.minimum(first + np.diff(x_at), shift + np.diff(y_at)) - lo)
            at = np.append(0, np.cumsum(size))
            place = np.arange(at[-1]) - np.repeat(at[:-1], size)
            k = np.where(kind == LINES_KIND, SHAPE[LINES_KIND][0], SHAPE[WORDS][0])
            row, a, b = equal_runs(x[np.repeat(x_at[:-1] + lo - first, size) + place], y[np.repeat(y_at[:-1] + lo - shift, size) + place], at, k)
            yield _columns([(doc_id[row], th[row], kind[row], odoc[row], oth[row], diag[row], lo[row] + a, lo[row] + b)], _RUN)

    return pairs.select("doc_id", "th", "kind", "odoc", "oth", "diag", "first", "units", "ofirst", "ounits").mapInArrow(compare, _RUN)


def _elsewhere() -> Column:
    return (F.col("doc_id") != F.col("odoc")) | (F.col("th") != F.col("oth")) | (F.col("pos") != F.col("opos"))


def _compared(docs: DataFrame, later: DataFrame, min_words: int) -> DataFrame:
    """The columns of _RUN: what is equal around the places of later (doc_id, th, kind, pos,
    odoc, oth, opos)."""
    lines = F.col("kind") == LINES_KIND
    margin, width = F.when(lines, least(LINES_KIND)).otherwise(least(WORDS, min_words)), F.when(lines, 1).otherwise(K)
    oblock = F.floor(F.col("opos") / BLOCK).cast("int").alias("oblock")
    matches = later.groupBy(*_PLACE, "odoc", "oth", oblock, (F.col("pos") - F.col("opos")).alias("diag")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    matches = written(matches.withColumn("lo", F.col("lo") - margin).withColumn("hi", F.col("hi") + width + margin), "dedup-matches")
    asked = written(matches.groupBy(*_ORIGIN).agg(F.min(F.col("lo") - F.col("diag")).alias("lo"), F.max(F.col("hi") - F.col("diag")).alias("hi"), F.count("*").alias("n")), "dedup-asked")
    # One pass over the texts gives both sides; repeated rows give the same piece again.
    wanted = matches.withColumn("side", F.lit(0)).unionByName(asked.select(F.col("odoc").alias("doc_id"), F.col("oth").alias("th"), *_ORIGIN, F.lit(0).alias("diag"), F.lit(1).alias("side"), "lo", "hi"))
    regions = written(_regions(docs, wanted), "dedup-regions")
    there = regions.where("side = 1").select(*_ORIGIN, F.col("first").alias("ofirst"), F.col("units").alias("ounits")).dropDuplicates(_ORIGIN)
    pairs = salted(regions.where("side = 0").drop("side"), there, asked.select(*_ORIGIN, "n"), _ORIGIN, matches.count(), by=["doc_id", "th", "diag"])
    return written(_verified(pairs).distinct(), "dedup-equal")


def _by_document(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("kind", "odoc", "oth", "diag", "a", "b")).alias("runs"))


_MARKED = f"{_ID}, place long, odoc long, oth long, opos int, any_thin boolean"
#: Rows by which keys that many rows have are found, and rows that are looked through together.
LOOKED_AT, TOGETHER_ROWS = 200_000, 1 << 14


def _last(keys: list[np.ndarray]) -> int:
    """Where the rows of the last key begin."""
    return max(int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1]) for key in keys)


def _shared_keys(columns: list[np.ndarray], n_keys: int) -> list[np.ndarray]:
    """The columns of _MARKED for rows (keys, doc_id, th, place) that lie together by key."""
    doc_id, th, place = columns[n_keys:]
    new = np.ones(len(place), bool)
    new[1:] = False
    for key in columns[:n_keys]:
        new[1:] |= key[1:] != key[:-1]
    start = np.flatnonzero(new)
    count = np.diff(start, append=len(place))
    thin = np.maximum.reduceat(place >> 1 & 1, start) > 0
    some = (count > 1) | thin
    rows, count, thin = np.flatnonzero(np.repeat(some, count)), count[some], thin[some]
    doc_id, th, place, of = doc_id[rows], th[rows], place[rows], np.repeat(np.arange(len(count)), count)
    order = np.lexsort((place, th, doc_id, of))
    first = order[np.cumsum(count) - count][of]
    odoc, oth, opos, thin = doc_id[first], th[first], place[first] >> 16, thin[of]
    keep = thin | (doc_id != odoc) | (th != oth) | (place >> 16 != opos)
    return [x[keep] for x in (doc_id, th, place, odoc, oth, opos, thin)]


def _by_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of _MARKED; the rows of a key go through one task."""

    def batch(columns: list[np.ndarray]) -> pa.RecordBatch:
        return _columns([tuple(columns)], _MARKED)

    def mark(batches):
        held, n, enough = [], 0, TOGETHER_ROWS
        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            n += b.num_rows
            if n >= enough:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                # The last key's rows may go on.
                last = _last(columns[: len(keys)])
                if last:
                    yield batch(_shared_keys([c[:last] for c in columns], len(keys)))
                held, n = [[c[last:] for c in columns]], n - last
                enough = TOGETHER_ROWS + 2 * n
        if n:
            yield batch(_shared_keys([np.concatenate(c) for c in zip(*held, strict=True)], len(keys)))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(mark, _MARKED)


def _marked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (keys, doc_id, th, place), a table in a folder, those whose keys also stand at an
    earlier place, with the earliest one, and all rows of keys of which some are thin.  Keys
    that many rows have, found among about LOOKED_AT rows by chance, are summed up
    in part before they meet and their few origins broadcast; each row of another key is
    shuffled once."""
    total = rows.count()
    often = rows.sample(LOOKED_AT / total, 7) if total > LOOKED_AT else rows
    hot = written(often.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > LOOKED_AT * HOT / 2).select(*keys), "dedup-hot")
    rows = rows.select(*keys, "doc_id", "th", "place")
    if hot.isEmpty():
        return _places(_by_key(rows, keys))
    mine = rows.join(F.broadcast(hot), keys)
    first, thin = F.min(F.struct("doc_id", "th", "place")).alias("o"), F.max(F.shiftright("place", 1).bitwiseAND(1)).alias("thin")
    origins = written(mine.groupBy(*keys).agg(first, thin), "dedup-origins")
    origins = origins.select(*keys, F.col("o.doc_id").alias("odoc"), F.col("o.th").alias("oth"), F.shiftright("o.place", 16).cast("int").alias("opos"), (F.col("thin") == 1).alias("any_thin"))
    met = mine.join(F.broadcast(origins), keys).drop(*keys)
    met = met.where(F.col("any_thin") | (F.col("doc_id") != F.col("odoc")) | (F.col("th") != F.col("oth")) | (F.shiftright("place", 16) != F.col("opos")))
    return _places(_by_key(rows.join(F.broadcast(hot), keys, "left_anti"), keys).unionByName(met))


def _places(marked: DataFrame) -> DataFrame:
    return unpacked(marked).drop("thin").withColumnRenamed("any_thin", "thin")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __th, runs: array of (kind, odoc, oth, diag, a, b)) for documents with a
    match to an earlier place; __th is the hash of the text."""
    small_batches(docs.sparkSession)
    docs = keyed(docs).where("doc_id is not null and text is not null")
    prints = written(fingerprints(docs, min_words), "dedup-prints")
    marked = written(_marked(prints, ["hash"]), "dedup-marked")
    runs = _compared(docs, marked.where(_elsewhere()), min_words)
    whole = written(open_runs(docs, written(_unsettled(marked, runs, min_words), "dedup-open"), min_words), "dedup-whole")
    later = _marked(whole, ["hash", "hash2"]).where(_elsewhere())
    length = F.when(F.col("kind") == LINES_KIND, least(LINES_KIND)).otherwise(least(WORDS, min_words))
    more = later.select("doc_id", "th", "kind", "odoc", "oth", (F.col("pos") - F.col("opos")).alias("diag"), F.col("pos").alias("a"), (F.col("pos") + length).alias("b"))
    return _by_document(runs.unionByName(more))


def cut(text: str, spans: list[tuple[int, int]], start: np.ndarray | None = None, end: np.ndarray | None = None) -> str:
    """The text without the words of the spans and the white space after each."""
    data = text.encode()
    if start is None:
        start, end = word_bounds(data)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : start[a]])
        at = int(start[b]) if b < len(start) else int(end[b - 1])
    return b"".join([*out, data[at:]]).decode()


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of docs, text without later repeats (n_chars follows it, where it
    exists), and n_removed (words), n_runs and n_repeated: words in all verified matches to
    earlier places, of ``K`` words or more, a lower bound of what is not new."""
    found = written(repeats(docs, min_words), "dedup-runs")
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("n_runs", T.LongType()), T.StructField("n_repeated", T.LongType())])

    @F.arrow_udf(kind)
    def clean(text: pa.Array, runs: pa.Array) -> pa.Array:
        at, of = list_fields(runs)
        given = text.to_pylist()
        texts, removed, count, repeated = list(given), [0] * len(given), [0] * len(given), [0] * len(given)
        spans_of = lambda units, found, j, least: merged(x for k, s in _merged_runs(found, least).items() for x in units.word_spans(k, j, s))
        for lo, units in together(given):
            for j in range(len(units.offset) - 1):
                i = lo + j
                found = _matches(of, at[i], at[i + 1])
                if not found:
                    continue
                spans = spans_of(units, found, j, min_words)
                repeated[i] = sum(b - a for a, b in spans_of(units, found, j, K))
                if spans:
                    texts[i], removed[i], count[i] = cut(given[i], spans, *units.words(j)), sum(b - a for a, b in spans), len(spans)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(repeated, pa.int64())], names=["text", "n_removed", "n_runs", "n_repeated"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    joined = join_lists(rows, found, F.size("runs") * 40, "left")
    joined = joined.withColumn("__new", clean(F.when(F.col("runs").isNotNull(), F.col("__row.text").cast("string")), "runs"))
    changed = F.coalesce(F.col("__new.n_runs") > 0, F.lit(False))
    new = {"text": F.when(changed, F.col("__new.text")).otherwise(F.col("__row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("__new.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    zero = F.lit(0).cast("long")
    counts = ["n_removed", "n_runs", "n_repeated"]
    return joined.select(*[(new[c] if c in new else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns if c not in counts], *[F.coalesce(F.col(f"__new.{c}"), zero).alias(c) for c in counts])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_removed", "n_runs", "text")


def brute_force(docs: list[tuple[int, str]], min_words: int = MIN_WORDS, lines: int = LINES) -> dict[int, set[int]]:
    """Words that must go: those inside a run of min_words words or of so many lines that
    also stands at an earlier place (for tests)."""
    first: dict[tuple, tuple[int, int]] = {}
    gone: dict[int, set[int]] = {i: set() for i, _ in docs}
    for i, text in sorted(docs):
        w = text.split()
        of = [line.split() for line in text.split("\n") if line.split()]
        at = [0]
        for line in of:
            at.append(at[-1] + len(line))
        for size, units, place in ((min_words, w, range(len(w) + 1)), (lines, [tuple(x) for x in of], at)):
            for p in range(len(units) - size + 1):
                g = (size, *units[p : p + size])
                if g in first:
                    gone[i] |= set(range(place[p], place[p + size]))
                else:
                    first[g] = (i, p)
    return gone


#: Windows of 50 words and of 3 lines that stand at an earlier place; text as pieces of
#: a word and the white space behind it.
ORACLE = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS piece FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, no, array_to_string(lw, ' ') AS line, CAST(sum(len(lw)) OVER (PARTITION BY doc_id ORDER BY no) - len(lw) AS BIGINT) AS a, CAST(sum(len(lw)) OVER (PARTITION BY doc_id ORDER BY no) AS BIGINT) AS b
      FROM (SELECT doc_id, no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d))) WHERE len(lw) > 0),
lr AS (SELECT doc_id, a, {', '.join(f'lead(line, {i}) OVER o AS l{i}' for i in range(LINES))}, lead(b, {LINES - 1}) OVER o AS b FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
runs AS (SELECT doc_id, a, a + {MIN_WORDS} AS b, 'w' || array_to_string(w[a + 1:a + {MIN_WORDS}], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - {MIN_WORDS})) AS a FROM d WHERE len(w) >= {MIN_WORDS})
         UNION ALL SELECT doc_id, a, b, 'l' || {' || chr(10) || '.join(f'l{i}' for i in range(LINES))} FROM lr WHERE b IS NOT NULL),
late AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, a) AS r FROM runs) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(a, b - 1)) AS p FROM late)),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p0 IS NULL OR p0 < p - 1) AS n_runs, max(p) AS top FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS p0 FROM gone) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(t, '' ORDER BY p) AS t FROM (SELECT doc_id, unnest(piece) AS t, unnest(generate_series(0, len(piece) - 1)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM n)) x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       CASE WHEN n.doc_id IS NULL THEN documents.text ELSE regexp_extract(documents.text, '^[\x20\x09-\x0D]*') || coalesce(kept.t, '') || CASE WHEN top = len(w) - 1 THEN regexp_extract(documents.text, '[\x20\x09-\x0D]*$') ELSE '' END END AS text
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
