"""Whitening of embeddings by shifted Cholesky QR.

The rows A are centred vectors.  Squaring them into a Gram matrix squares their condition
too, so the first factor is that of the Gram matrix with a small multiple of the identity
added (the shift), which always exists: R1.  The rows times the inverse of R1, by a
triangular solve in each task, are better conditioned; their Gram matrix is summed by another
pass over the rows, factored, and so on until the rows are orthonormal to rounding.  The product
R of the factors is as good as a QR factorisation of A, and its singular values and right
singular vectors are those of A: components and, squared over n, eigenvalues of the covariance.

Only sums cross between tasks: a Gram matrix of d by d numbers per task, added by Spark, and
factors of d by d on the driver; d is the vectors' dimension, no matter how many there are.
The rows are read from the table in each pass, of which there are as many as Gram matrices and
three more; nothing is written, and no key is grouped, so no vector can be too frequent.

Defined results: vectors that are null, or have a null or non-finite entry, are left out, as
are those of another length than most have (of equally frequent lengths the largest) and
those with an entry of 2**30 or more, whose sums could leave the integers.  Dimensions that
hang linearly on earlier ones (constant ones, repeated ones) get no column of their own in R
and are brought back by one more pass; components without variance can't be scaled to one and
are not returned, so n equal vectors, or a single one, give no rows.  Repeated rows count each
and come out each, ids may be null or repeated; an empty table gives no rows.  A deviation that
no long holds is null.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components that are returned.
MOST = 8
SCALE, OFFSET, LIMIT = 1024, 100_000, float(1 << 30)
#: Rows that are worked on at once, and entries after which integer sums are handed on.
ROWS, FLUSH = 4096, 1 << 20
#: Gram passes at most; orthonormal to this, or this near to dependent, the passes end.
PASSES, EXACT, DEPENDENT = 6, 1e-13, 1e-12
UNIT = float(np.finfo(np.float64).eps) / 2
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(embeddings: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that count, and their dimension."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LIMIT))
    rows = embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d"))["d"]).first()[0] or 0
    return rows.where(F.size("v") == size), size


def integers(column: pa.Array, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, x) for blocks of rows: floor(1024 c) + 100000 of each entry."""
    for at in range(0, len(column), ROWS):
        some = column.slice(at, ROWS)
        c = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), d)
        yield at, np.floor(c * SCALE).astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - s / n, from the exact n * x - s."""
    return ((n * x - s) if _fits(x, n) else (n * x.astype(object) - s.astype(object))).astype(np.float64) / n


def _fits(x: np.ndarray, n: int) -> bool:
    return not x.size or float(np.abs(x).max()) * n * 2 < 2.0**62


def sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sum of x in each dimension."""

    def add(batches):
        total, seen = np.zeros(d, np.int64), 0
        for batch in batches:
            for _, x in integers(batch.column(0), d):
                total += x.sum(axis=0)
                seen += len(x)
                if seen >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([seen, *total.tolist()], pa.int64())], names=["i", "s"])
                    total, seen = np.zeros(d, np.int64), 0
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([seen, *total.tolist()], pa.int64())], names=["i", "s"])

    got = rows.select("v").mapInArrow(add, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s"))
    by = {r["i"]: int(r["s"]) for r in got.collect()}  # one row per dimension
    return by.get(-1, 0), np.array([by.get(i, 0) for i in range(d)], object)


def products(rows: DataFrame, d: int, shape: tuple[int, int], of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum over all rows of left' right, where ``of`` makes both from a block of x; each
    task adds up its rows, Spark adds up the tasks."""

    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            for _, x in integers(batch.column(0), d):
                left, right = of(x)
                total += left.T @ right
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], names=["cell", "p"])

    got = rows.select("v").mapInArrow(add, "cell long, p double").groupBy("cell").agg(F.sum("p").alias("p")).toPandas()  # d * d at most
    out = np.zeros(shape[0] * shape[1])
    out[got["cell"].to_numpy(np.int64)] = got["p"].to_numpy()
    return out.reshape(shape)


def independent(gram: np.ndarray, tolerance: float) -> list[int]:
    """The columns that pivoted Cholesky finds to be no combination of the others, in order."""
    left = gram.copy()
    scale = np.diag(gram).copy()
    kept: list[int] = []
    for _ in range(len(gram)):
        share = np.divide(np.diag(left), scale, out=np.zeros(len(scale)), where=scale > 0)
        share[kept] = 0
        at = int(np.argmax(share))
        if share[at] <= tolerance:
            break
        kept.append(at)
        left -= np.outer(left[:, at], left[at]) / left[at, at]
    return sorted(kept)


def solve(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangular r, column by column."""
    out = np.array(rows, order="F")
    for j in range(len(r)):
        if j:
            out[:, j] -= out[:, :j] @ r[:j, j]
        out[:, j] /= r[j, j]
    return out


@dataclass
class Whitening:
    """n and the exact sums of the fit; components as columns with their eigenvalues, falling;
    each component's share of the variance; Gram passes it took."""

    n: int
    s: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    passes: int = 0


def factor(rows: DataFrame, d: int, n: int, s: np.ndarray) -> tuple[np.ndarray, int]:
    """R with A'A = R'R, one row per independent dimension, and the passes it took."""
    gram = products(rows, d, (d, d), lambda x: (lambda a: (a, a))(centred(x, n, s)))
    kept = independent(gram, DEPENDENT)
    k, factors = len(kept), []
    if not k:
        return np.zeros((0, d)), 1
    # Columns of one length, so that the shift is small beside each of them.
    size = np.sqrt(np.diag(gram)[kept])
    g = gram[np.ix_(kept, kept)] / np.outer(size, size)
    shift = 11 * (n * k + k * (k + 1)) * UNIT * np.linalg.norm(g, 2)
    g = g + min(shift, 1e-3) * np.eye(k)
    passes = 1
    while True:
        factors.append(np.linalg.cholesky(g).T)

        def orthogonal(x: np.ndarray) -> np.ndarray:
            q = centred(x, n, s)[:, kept] / size
            for r in factors:  # noqa: B023
                q = solve(r, q)
            return q

        g = products(rows, d, (k, k), lambda x: (lambda q: (q, q))(orthogonal(x)))
        passes += 1
        off = np.abs(g - np.eye(k)).max()
        if off <= EXACT * max(1.0, np.sqrt(k)) or passes >= PASSES:
            break
        if passes > 2 and off > 0.5:  # still far from orthonormal: another shift
            g = g + 11 * k * (k + 1) * UNIT * np.linalg.norm(g, 2) * np.eye(k)
    r = np.eye(k)
    for f in factors:
        r = f @ r
    full = np.zeros((k, d))
    full[:, kept] = r * size
    rest = [i for i in range(d) if i not in set(kept)]
    if rest and np.diag(gram)[rest].any():
        full[:, rest] = products(rows, d, (k, len(rest)), lambda x: (orthogonal(x), centred(x, n, s)[:, rest]))
        passes += 1
    return full, passes


def fit(rows: DataFrame, d: int) -> Whitening:
    """The components of all rows (vec_id, v), of ``d`` entries each."""
    n, s = sums(rows, d)
    if not n or not d:
        return Whitening(n, s, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    r, passes = factor(rows, d, n, s)
    _, sigma, vt = np.linalg.svd(r, full_matrices=False) if len(r) else (None, np.zeros(0), np.zeros((0, d)))
    good = sigma > sigma.max(initial=0) * d * 4 * UNIT
    sigma, vt = sigma[good], vt[good]
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)]) if len(vt) else np.zeros(0)
    e = sigma**2 / n
    return Whitening(n, s, (vt * sign[:, None]).T, e, e / e.sum() if len(e) else e, passes)


def project(w: Whitening, x: np.ndarray, most: int | None = None) -> np.ndarray:
    """Whitened rows of x: centred, projected, each component of variance one."""
    return centred(x, w.n, w.s) @ (w.components[:, :most] / np.sqrt(w.eigenvalues[:most]))


def identity_error(rows: DataFrame, d: int, w: Whitening, most: int | None = None) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = min(len(w.eigenvalues), most or d)
    if not k:
        return 0.0
    def with_one(x: np.ndarray) -> np.ndarray:
        return np.column_stack([project(w, x, most), np.ones(len(x))])

    p = products(rows, d, (k + 1, k + 1), lambda x: (lambda y: (y, y))(with_one(x))) / w.n
    # Whitened means are zero but for rounding, so taking them off afterwards loses nothing.
    return float(np.abs(p[:k, :k] - np.outer(p[k, :k], p[k, :k]) - np.eye(k)).max())


def deviations(w: Whitening, x: np.ndarray) -> list[int | None]:
    """The exact sums of (n * x - s)**2 over the dimensions."""
    if _fits(x, w.n):
        c = w.n * x - w.s.astype(np.int64)
        if len(c) == 0 or (c.astype(np.float64) ** 2).sum(axis=1).max() < 2.0**62:
            return (c * c).sum(axis=1).tolist()
    c = w.n * x.astype(object) - w.s
    return [v if v < 1 << 63 else None for v in (c * c).sum(axis=1).tolist()]


def whiten(embeddings: DataFrame, vector: str = "embedding", most: int = MOST) -> DataFrame:
    """A row per usable vector and component, the columns of RESULT."""
    rows, d = usable(embeddings, vector)
    w = fit(rows, d)
    k = min(most, len(w.eigenvalues))
    error = identity_error(rows, d, w, most)

    def write(batches):
        names = [f.split()[0] for f in RESULT.split(", ")]
        for batch in batches:
            ids = batch.column(0)
            for at, x in integers(batch.column(1), d):
                m = len(x)
                row = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    ids.slice(at, m).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), pa.array(deviations(w, x), pa.int64()).take(row),
                    pa.array(project(w, x, most).ravel()), pa.array(np.tile(w.explained[:k], m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(write, RESULT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
