"""Similarity join of word shingles by the chosen-path method.

A document is its set of five-word shingles.  Documents with equal sets are one
class and stand in the join once, by the smallest (id, hash of the text).  Each run samples
about 1 / threshold shingles of every set with a hash that all documents share, so
similar sets choose the same ones; every choice is a bucket.  Buckets of more
than ``BLOCK`` sets are split again by shingles sampled anew, up to ``DEPTH`` times.
What remains is compared pair by pair: small buckets at once, larger ones as
pairs of blocks in different tasks, so no pair is skipped.  The number of runs
makes a pair that is exactly at the threshold meet with the target recall, even
where its bucket is split to the last level (it is higher above the threshold).

A pair counts in the first bucket that both sets are in, so links are counted
once without listing pairs; only counts and the edges of spanning trees leave a
task.  Groups are the connected components of the links.

Defined results: words are runs of letters and digits, A-Z in lower case, other
characters beyond ASCII as they are; a text of one to four words is a single
shingle; a text without words (null, empty, only signs) is a class of its own
without links; documents without an id get no row; rows of one id and different texts
are documents of their own, repeated rows are copies of each other; texts are read
whole, whatever their length, but sets travel only to buckets where they may find a
partner; an empty table gives no rows.  Only doc_id and text are read (``keep_one`` passes
the rest through), so no other column can clash.  Sets are compared by 32-bit hashes of
their shingles.

What grows faster than the input: m different texts that are all near copies of each
other have about m * m / 2 links, and counting them takes as many comparisons, done as
products of blocks of ``BLOCK`` sets in tasks of their own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, join_lists, keyed, mix64, salted, small_batches, window_hashes, word_bounds, word_hashes, written

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
DEPTH, BLOCK = 3, 512
#: Values of a matrix that are worked on together: it bounds a worker's memory.
TOGETHER = 500_000
_EMPTY = np.zeros(0, np.uint64)


def runs_for(recall: float, depth: int) -> int:
    """Runs until a pair at the threshold has met with this probability.  A shared
    choice at each level is a Poisson number of mean one; q is the chance that the
    pair is lost within so many levels."""
    q = 0.0
    for _ in range(depth):
        q = math.exp(q - 1)
    return math.ceil(math.log(1 - recall) / math.log(q))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    data = text.encode().translate(FOLD) if text else b""
    start, end = word_bounds(data)
    if not len(start):
        return _EMPTY
    return np.unique(window_hashes(word_hashes(data, start, end), min(words, len(start))))


def children(tokens: np.ndarray, paths: np.ndarray, threshold: float) -> np.ndarray:
    """For every path the shingles chosen below it, as (child path, index of path)."""
    rate = 1.0 / (threshold * len(tokens))
    bound = np.uint64(min(1.0, rate) * (2**64 - 2**12))
    out, of = [], []
    step = max(1, TOGETHER // len(tokens))
    for at in range(0, len(paths), step):
        keys = mix64(paths[at : at + step])
        i, j = np.nonzero(tokens[None, :] * (keys | np.uint64(1))[:, None] < bound)
        out.append(mix64(keys[i] ^ tokens[j]))
        of.append(i + at)
    return np.stack([np.concatenate(out), np.concatenate(of).astype(np.uint64)])


def _roots(runs: int) -> np.ndarray:
    return mix64(np.arange(1, runs + 1, dtype=np.uint64))


def sketches(docs: DataFrame, runs: int, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, th, n, sig, paths): sig names the set, null for a text without words."""

    def sketch(batches):
        roots = _roots(runs)
        for batch in batches:
            n, sig, paths = [], [], []
            for text in batch.column(2).to_pylist():
                tokens = shingles(text)
                n.append(len(tokens))
                sig.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                paths.append(children(tokens, roots, threshold)[0].view(np.int64) if len(tokens) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], names=["doc_id", "th", "n", "sig", "paths"])

    return docs.mapInArrow(sketch, "doc_id long, th long, n long, sig binary, paths array<long>")


def _deeper(docs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(path, doc_id, th) one level below the given ones."""
    lists = written(rows.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_list("path").alias("paths")), "join-split")

    def split(batches):
        for batch in batches:
            out, ids, ths = [_EMPTY], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc_id, th, text, paths in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                got = children(shingles(text), np.array(paths, np.int64).view(np.uint64), threshold)[0]
                out.append(got)
                ids.append(np.full(len(got), doc_id))
                ths.append(np.full(len(got), th))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(ths))], names=["path", "doc_id", "th"])

    return join_lists(docs, lists, F.size("paths") * 8).select("doc_id", "th", "text", "paths").mapInArrow(split, "path long, doc_id long, th long").distinct()


def buckets(docs: DataFrame, reps: DataFrame, threshold: float = THRESHOLD, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(path, doc_id, th, m): the buckets that are compared, of two sets or more."""
    rows = reps.select(F.explode("paths").alias("path"), "doc_id", "th").distinct()
    done = []
    for level in range(1, depth + 1):
        rows = written(rows, "join-paths")
        sizes = written(rows.groupBy("path").agg(F.count("*").alias("m")).where("m > 1"), "join-sizes")
        sized = written(salted(rows, sizes, sizes.withColumnRenamed("m", "n"), ["path"], rows.count(), by=["doc_id", "th"]), "join-buckets")
        last = level == depth
        done.append(sized if last else sized.where(F.col("m") <= block))
        big = sized.where(F.col("m") > block)
        if last or big.isEmpty():
            break
        rows = _deeper(docs, big, threshold)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


_SLOTS = pa.schema([("path", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("leaves", pa.binary())])
_SLOTS_DDL = "path long, i int, j int, part int, doc_id long, th long, n long, leaves binary"
_PARTS = pa.schema([("path", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("copies", pa.int64()), ("tokens", pa.binary()), ("leaves", pa.binary())])
_PARTS_DDL = "path long, i int, j int, part int, doc_id long, th long, copies long, tokens binary, leaves binary"


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of a (bucket, pair of blocks) side by side."""
    return rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "doc_id", "th")


def _groups(batches, width: int):
    """((path, i, j), rows without these) of dealt rows; a group of one has no pair."""
    key, held = None, []
    for batch in batches:
        for path, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in range(width)), strict=True):
            if (path, i, j) != key:
                if len(held) > 1:
                    yield key, held
                key, held = (path, i, j), []
            held.append(rest)
    if len(held) > 1:
        yield key, held


def _slots(members: DataFrame, block: int, threshold: float) -> DataFrame:
    """(doc_id, th, path, i, j, part, leaves): where a set must be compared.  Of each bucket
    only those sets stay that have a partner of a fitting size which they meet here
    first; this is known without the sets, so few of them have to travel."""

    def place(batches):
        for batch in batches:
            rows = []
            for doc_id, th, n, inside in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                leaves = np.sort(np.array([x["path"] for x in inside], np.int64)).tobytes()
                mixed = mix64(np.array([doc_id ^ th], np.int64).view(np.uint64))[0]
                for x in inside:
                    blocks = -(-x["m"] // block)
                    own = int(mixed % np.uint64(blocks))
                    rows += [(x["path"], min(own, o), max(own, o), own, doc_id, th, n, leaves) for o in range(blocks)]
            yield _batch(rows, _SLOTS)

    def choose(batches):
        rows = []
        for (path, i, j), held in _groups(batches, 8):
            leaves = [np.frombuffer(h[4], np.int64) for h in held]
            meet = first_here(path, fitting(np.array([h[0] for h in held]), np.array([h[3] for h in held], np.float32), i != j, threshold), leaves)
            rows += [(path, i, j, held[x][0], *held[x][1:]) for x in np.flatnonzero(meet.any(1)).tolist()]
            if len(rows) >= 5000:
                yield _batch(rows, _SLOTS)
                rows = []
        yield _batch(rows, _SLOTS)

    return _dealt(members.select("__id", "__th", "n", "inside").mapInArrow(place, _SLOTS_DDL)).mapInArrow(choose, _SLOTS_DDL)


def _parts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets themselves, once for each slot; wanted: (__id, __th, copies, slots)."""

    def emit(batches):
        for batch in batches:
            rows = []
            for doc_id, th, text, copies, slots in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                tokens = np.unique((shingles(text) >> np.uint64(32)).astype("<u4")).tobytes()
                rows += [(x["path"], x["i"], x["j"], x["part"], doc_id, th, copies, tokens, x["leaves"]) for x in slots]
                if len(rows) >= 2000:
                    yield _batch(rows, _PARTS)
                    rows = []
            yield _batch(rows, _PARTS)

    size = F.aggregate("slots", F.lit(0).cast("long"), lambda a, x: a + 40 + F.octet_length(x["leaves"]))
    return join_lists(docs, wanted, size).select("doc_id", "th", "text", "copies", "slots").mapInArrow(emit, _PARTS_DDL)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _overlap(values: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections of sorted distinct arrays."""
    m = len(values)
    owner = np.repeat(np.arange(m), [len(v) for v in values])
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    token = np.cumsum(new) - 1
    shared = np.bincount(token)[token] > 1 if len(token) else np.zeros(0, bool)
    token, owner = token[shared], owner[shared]
    total = np.zeros((m, m), np.float32)
    if not len(token):
        return total
    token = np.unique(token, return_inverse=True)[1]  # sorted: the tokens of a chunk lie together
    width = max(1, min(int(token[-1]) + 1, TOGETHER // m))
    for lo in range(0, int(token[-1]) + 1, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        has = np.zeros((m, width), np.float32)
        has[owner[a:b], token[a:b] - lo] = 1
        total += has @ has.T
    return total


def fitting(side: np.ndarray, size: np.ndarray, cross: bool, threshold: float) -> np.ndarray:
    """Which pairs have sizes that allow the similarity (a symmetric matrix)."""
    fits = np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-3
    np.fill_diagonal(fits, False)
    if cross:
        fits &= side[:, None] != side[None, :]
    return fits


def first_here(path: int, pairs: np.ndarray, leaves: list[np.ndarray]) -> np.ndarray:
    """Those of the pairs that share no earlier bucket."""
    some = np.flatnonzero(pairs.any(1))
    if len(some):
        earlier = _overlap([leaves[i][: np.searchsorted(leaves[i], path)] for i in some])
        pairs[np.ix_(some, some)] &= earlier == 0
    return pairs


def compare(path: int, side: np.ndarray, tokens: list[np.ndarray], leaves: list[np.ndarray], cross: bool, threshold: float) -> np.ndarray:
    """Which pairs are linked and meet in this bucket first (a symmetric matrix)."""
    size = np.array([len(t) for t in tokens], np.float32)
    fits = fitting(side, size, cross, threshold)
    some = np.flatnonzero(fits.any(1))  # sets without a partner of a fitting size need no work
    near = np.zeros_like(fits)
    if len(some):
        inner, both = _overlap([tokens[i] for i in some]), size[some][:, None] + size[some][None, :]
        # |a & b| / |a | b| >= threshold, in whole numbers of tokens
        near[np.ix_(some, some)] = inner * (1 + threshold) >= threshold * both - 1e-3
    return first_here(path, near & fits, leaves)


_FOUND = pa.schema([(c, pa.int64()) for c in ("doc_id", "th", "root", "rth", "links")])


def trees(near: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for the connected components of a bucket's links."""
    free, out = near.any(1), []
    while free.any():
        root = int(np.argmax(free))
        free[root] = False
        front = [root]
        while len(front):
            front = np.flatnonzero(near[front].any(0) & free)
            free[front] = False
            out += [(root, int(x)) for x in front]
    return out


def _found(parts: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, th, root, rth, links) for every linked set of a bucket: how many documents it
    is linked to there, and the root of its tree."""

    def search(batches):
        rows = []
        for (path, i, j), held in _groups(batches, 9):
            tokens = [np.frombuffer(h[4], "<u4") for h in held]
            leaves = [np.frombuffer(h[5], np.int64) for h in held]
            near = compare(path, np.array([h[0] for h in held]), tokens, leaves, i != j, threshold)
            if not near.any():
                continue
            copies = np.array([h[3] for h in held])
            count, root = near @ copies, {m: r for r, m in trees(near)}
            rows += [(*held[x][1:3], *held[root.get(x, x)][1:3], int(count[x])) for x in np.flatnonzero(near.any(1)).tolist()]
            if len(rows) >= 5000:
                yield _batch(rows, _FOUND)
                rows = []
        yield _batch(rows, _FOUND)

    return _dealt(parts).mapInArrow(search, "doc_id long, th long, root long, rth long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, for every node of
    the edges (a, b).  Alternating large and small stars; each round is written."""
    undirected = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = None
    while True:
        both = undirected(edges)
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "stars-low")
        # The middle of a star may have all other nodes as neighbours.
        large = salted(both.where("b > a"), low.drop("n"), low.select("a", "n"), ["a"], 2 * edges.count(), by=["b"])
        large = written(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "stars-large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), "a", "m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = written(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        state = now


def _classes(docs: DataFrame, threshold: float, recall: float, depth: int, block: int) -> DataFrame:
    """(doc_id, th, class, copy, n_links) per document; class and copy: (doc_id, th)."""
    small_batches(docs.sparkSession)
    docs = keyed(docs).where("doc_id is not null")
    node = lambda a, b: F.struct(F.col(a).alias("doc_id"), F.col(b).alias("th"))
    sets = written(sketches(docs, runs_for(recall, depth), threshold), "join-sets")
    classes = written(sets.where("sig is not null").groupBy("sig").agg(F.min(node("doc_id", "th")).alias("rep"), F.count("*").alias("copies")), "join-classes")
    by_rep = (F.col("sig") == F.col("__sig")) & (F.col("doc_id") == F.col("rep.doc_id")) & (F.col("th") == F.col("rep.th"))
    reps = sets.where("sig is not null").join(classes.select(F.col("sig").alias("__sig"), "rep", "copies"), by_rep)
    leaves = buckets(docs, reps, threshold, depth, block)
    key = [F.col("doc_id").alias("__id"), F.col("th").alias("__th")]
    inside = leaves.groupBy(*key).agg(F.collect_list(F.struct("path", "m")).alias("inside"))
    sizes = reps.groupBy(*key).agg(F.max("n").alias("n"))
    copies = classes.select(F.col("rep.doc_id").alias("__id"), F.col("rep.th").alias("__th"), "copies")
    members = written(inside.join(sizes, ["__id", "__th"]).join(copies, ["__id", "__th"]), "join-members")
    slots = _slots(members, block, threshold).groupBy(*key).agg(F.collect_list(F.struct("path", "i", "j", "part", "leaves")).alias("slots"))
    wanted = written(slots.join(members.select("__id", "__th", "copies"), ["__id", "__th"]), "join-slots")
    found = written(_found(_parts(docs, wanted), threshold), "join-found")
    links = found.groupBy(node("doc_id", "th").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(found.select(node("doc_id", "th").alias("a"), node("root", "rth").alias("b")))
    per = classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    per = written(per.select("sig", "rep", F.coalesce("label", "rep").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("copies").alias("n")), "join-per")
    # A group of equal sets may hold a third of all documents.
    lone = sets.where("sig is null").select("doc_id", "th", node("doc_id", "th").alias("class"), node("doc_id", "th").alias("copy"), F.lit(0).cast("long").alias("n_links"))
    rest = salted(sets.where("sig is not null").select("doc_id", "th", "sig"), per.drop("n"), per.select("sig", "n"), ["sig"], sets.count(), by=["doc_id", "th"])
    return lone.unionByName(rest.select("doc_id", "th", F.col("label").alias("class"), F.col("rep").alias("copy"), F.col("links").cast("long").alias("n_links")))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, class_id (the smallest id of its group of linked
    documents), copy_of (the smallest id with the same set), and n_links (documents
    with a similarity of ``threshold`` or more, copies included)."""
    found = _classes(docs, threshold, recall, depth, block)
    return found.select("doc_id", F.col("class.doc_id").alias("class_id"), F.col("copy.doc_id").alias("copy_of"), "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """The columns of docs, one document of each group: the one with its class_id, of
    several texts of that id the one with the smallest hash.  Rows equal in id and text
    are one document and stay together; documents without an id or without words all
    stay."""
    other = (F.col("class.doc_id") != F.col("doc_id")) | (F.col("class.th") != F.col("th"))
    gone = _classes(docs, threshold, recall, depth, block).where(other).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    return rows.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("th") == F.col("__th")), "left_anti").select("__row.*")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(docs: list[tuple[int, str | None]], threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """doc_id -> (class_id, n_links), all pairs (for tests)."""
    sets = {i: frozenset(shingles(t).tolist()) for i, t in docs}
    ids = sorted(i for i, s in sets.items() if s)
    label, links = {i: i for i in sets}, {i: 0 for i in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y):
                links[a] += 1
                links[b] += 1
                p, q = sorted((top(a), top(b)))
                label[q] = p
    return {i: (top(i), links[i]) for i in sets}


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 10 * c >= 8 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE a = d.doc_id), d.doc_id)) AS class_id, least(d.doc_id, coalesce((SELECT min(b) FROM l WHERE a = d.doc_id AND same), d.doc_id)) AS copy_of,
       (SELECT count(*) FROM l WHERE a = d.doc_id) AS n_links
FROM d
"""
