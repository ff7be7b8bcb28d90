"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time: it starts from a bounded sample
of labelled documents, and then every labelled document is learned from, one segment of
every STRETCH bytes of its text.  These segments are dealt by hash to groups of a
fixed number, whatever the table's partitions; each group goes on from the same start and the
mean of what they come to is the network.  It gives every byte position a
probability for each language; a document's probabilities are the means over all
positions of its whole text, in lower case.  The units squash by x / (1 + |x|), which
costs a fraction of a hyperbolic tangent and has as simple a derivative.

The LANGUAGES most frequent label values are learned; the model and the sample grow with their
number, not with the corpus.  On request a class of no language is learned too, from
texts with their characters in random order, and a bound for it from all held-out
documents, few of which reach it even where some of them are mislabelled themselves.

Defined results: a null text or one without any letter is ``und`` with score 0;
documents without a label are predicted but not learned from; an empty table, or
one without labels, gives ``und`` throughout; texts are read whole, in segments.
rows of one id and different texts, and repeated rows, are each predicted by their own
text.  Only doc_id, text and (to learn) lang are read, so extra columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, small_batches

#: The sample: about so many documents of each language, so many places in each
#: text, so many characters at each place.
SAMPLE_DOCS, PLACES, CHARS = 600, 3, 200
#: Label values that are learned at most: the sample is on the driver.
LANGUAGES = 100
#: The class of no language; the share of a text's positions below which it never goes, and
#: the share of held-out documents below the bound; bytes of texts that say too little.
NONE, LEAST_NONE, MOST_BELOW, SHORT_TEXT = "", 0.75, 0.95, 100
HIDDEN, SEGMENT, LANES = 16, 128, 512
STEPS, BATCH, TRAIN_SEGMENT, RATE, SEED = 400, 192, 64, 0.01, 7
#: All documents: a segment of each so many bytes, about so many segments in a group (whose
#: memory this bounds), so many in a step; every REPLAY-th as many again are of the start's
#: sample, equally of each language, so that no group forgets what it doesn't hold.  A group
#: of few segments sees them again up to so many steps.
STRETCH, GROUP, STEP, REPLAY, LEAST_STEPS = 512, 16_384, 128, 8, 128
#: Bytes of all lanes whose probabilities and slopes are worked out together.
NEAR = 8
#: Sums of what groups come to that reach the driver.
SUMS = 64
#: Steps in which shares of no language are counted.
BINS = 10_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _squash(x: np.ndarray, size: np.ndarray) -> None:
    """x / (1 + |x|), in place; size: an array of that shape to work in."""
    np.abs(x, out=size)
    size += 1
    x /= size


class Work:
    """Arrays that are used again from step to step, so that their memory isn't asked for anew."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def array(self, name: str, *shape: int) -> np.ndarray:
        if name not in self.kept or self.kept[name].shape != shape:
            self.kept[name] = np.empty(shape, np.float32)
        return self.kept[name]


@dataclass
class Network:
    """Two GRUs (forward, backward) and a softmax over both states at each byte.
    p: for d in 'fb', W+d (256, 3H) input rows, U+d (H, 3H); V (2H, L), c (L)."""

    languages: list[str]
    p: dict[str, np.ndarray]
    none_limit: float = 1.0  # a document of which more is of no language isn't in one

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"W{d}"] = r.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            p[f"U{d}"] = r.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        p["V"] = r.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        p["c"] = np.zeros(len(languages), np.float32)
        return cls(languages, p)

    def gates(self, name: str) -> np.ndarray:
        """The rows of W or U by gate (update, reset, new) and direction: (3, 2, rows, H)."""
        return np.ascontiguousarray(np.stack([np.stack(np.split(self.p[f"{name}{d}"], 3, axis=1)) for d in "fb"], axis=1))

    def states(self, x: np.ndarray, d: str) -> np.ndarray:
        """States (T, B, H) of one direction over bytes (T, B), in the order of the text."""
        (Wz, Wr, Wn), (Uz, Ur, Un) = (self.gates(name)[:, "fb".index(d)] for name in "WU")
        h = np.zeros((x.shape[1], Uz.shape[1]), np.float32)
        out = np.empty((*x.shape, Uz.shape[1]), np.float32)
        # The same few arrays for every byte, which stay near the core.
        g, size = (np.empty((2, *h.shape), np.float32) for _ in range(2))
        z, r = g
        rows, n = np.empty_like(h), np.empty_like(h)
        at = x.astype(np.intp)
        # Gates are (1 + g) / 2; the halves are taken with what they are multiplied by.
        half = np.float32(0.5)
        Un = Un * half
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.matmul(h, Uz, out=z)
            z += Wz.take(at[t], 0, rows, "clip")
            np.matmul(h, Ur, out=r)
            r += Wr.take(at[t], 0, rows, "clip")
            _squash(g, size)
            g += 1
            r *= h
            np.matmul(r, Un, out=n)
            n += Wn.take(at[t], 0, rows, "clip")
            _squash(n, size[0])
            n -= h
            n *= z
            n *= half
            h = np.add(h, n, out=out[t])
        return out

    def shares(self, q: np.ndarray) -> np.ndarray:
        """Probabilities (L, n) from the products (L, n) of states and V, in place."""
        q += self.p["c"][:, None]
        q -= q.max(0)
        np.exp(q, out=q)
        q /= q.sum(0)
        return q

    def outputs(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Probabilities (L, T * B) from the states of both directions."""
        H = f.shape[2]
        q = self.p["V"][:H].T @ f.reshape(-1, H).T
        q += self.p["V"][H:].T @ b.reshape(-1, H).T
        return self.shares(q)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, B, L) for bytes (T, B)."""
        q = self.outputs(self.states(x, "f"), self.states(x, "b"))
        return np.ascontiguousarray(q.T).reshape(*x.shape, -1)

    def summed(self, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """(B, L): the probabilities of each row's valid bytes added up."""
        f, b = self.states(x, "f"), self.states(x, "b")
        total = np.zeros((len(self.languages), x.shape[1]), np.float32)
        for t in range(0, len(x), NEAR):
            q = self.outputs(f[t : t + NEAR], b[t : t + NEAR])
            own = valid[t : t + NEAR]
            if not own.all():
                q *= own.reshape(-1)
            total += q.reshape(len(q), len(own), -1).sum(1)
        return total.T

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, share: np.ndarray | None = None, work: Work | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over valid positions (of rows that count by their share), and its
        gradient, through time.  Both directions go side by side: arrays are (2, T, B, H),
        each direction in its reading order."""
        work = Work() if work is None else work
        both = np.stack([x, x[::-1]])
        h, z, r, rh, n = self._kept(both, work)
        H, V = h.shape[3], self.p["V"]
        states = work.array("states", *x.shape, 2 * H)
        states[:, :, :H] = h[0, 1:]
        states[:, :, H:] = h[1, :0:-1]
        states = states.reshape(-1, 2 * H)
        q = np.ascontiguousarray(self.shares(V.T @ states.T).T).reshape(*x.shape, -1)
        at = (np.arange(x.shape[0])[:, None], np.arange(x.shape[1])[None, :], y[None, :])
        weight = valid if share is None else valid * share
        weight = (weight / weight.sum()).astype(np.float32)
        loss = float(-(np.log(q[at] + 1e-9) * weight).sum())
        dl = q
        dl[at] -= 1
        dl *= weight[:, :, None]
        flat = dl.reshape(-1, dl.shape[2])
        grad = {"V": states.T @ flat, "c": flat.sum(0)}
        dout = work.array("dout", *both.shape, H)
        np.matmul(dl, V[:H].T, out=dout[0])
        np.matmul(dl, V[H:].T, out=dout[1, ::-1])
        dg = self._through_time(h, z, r, n, dout, work)
        for i, d in enumerate("fb"):
            rows = dg[i].reshape(-1, 3 * H)
            grad[f"U{d}"] = np.concatenate([h[i, :-1].reshape(-1, H).T @ rows[:, : 2 * H], rh[i].reshape(-1, H).T @ rows[:, 2 * H :]], 1)
            order = np.argsort(both[i], axis=None, kind="stable")
            seen = both[i].reshape(-1)[order].astype(np.int64)
            first = np.flatnonzero(np.diff(seen, prepend=-1))
            grad[f"W{d}"] = np.zeros((256, 3 * H), np.float32)
            grad[f"W{d}"][seen[first]] = np.add.reduceat(rows.take(order, 0, work.array("rows", *rows.shape), "clip"), first, axis=0)
        return loss, grad

    def _kept(self, both: np.ndarray, work: Work) -> tuple[np.ndarray, ...]:
        """What backpropagation needs of bytes (2, T, B): states (from before the first byte),
        gates, reset states and new ones."""
        W, U = self.gates("W"), self.gates("U")
        H, T = U.shape[3], both.shape[1]
        place = both[None].astype(np.intp) + (np.arange(6) * 256).reshape(3, 2, 1, 1)
        given = W.reshape(-1, H).take(place, 0, work.array("given", *place.shape, H), "clip")
        g, n = given[:2], given[2]
        h, rh = work.array("h", 2, T + 1, both.shape[2], H), work.array("rh", *both.shape, H)
        h[:, 0] = 0
        size, product = (np.empty((2, 2, both.shape[2], H), np.float32) for _ in range(2))
        for t in range(T):
            gate, new, now = g[:, :, t], n[:, t], h[:, t]
            gate += np.matmul(now, U[:2], out=product)
            _squash(gate, size)
            gate += 1
            gate *= 0.5
            new += np.matmul(np.multiply(gate[1], now, out=rh[:, t]), U[2], out=product[0])
            _squash(new, size[0])
            step = np.subtract(new, now, out=size[0])
            step *= gate[0]
            np.add(now, step, out=h[:, t + 1])
        return h, g[0], g[1], rh, n

    def _through_time(self, h: np.ndarray, z: np.ndarray, r: np.ndarray, n: np.ndarray, dout: np.ndarray, work: Work) -> np.ndarray:
        """The gradient of the gates' inputs, (2, T, B, 3H), from that of the states."""
        U = self.gates("U").swapaxes(2, 3)
        of_gates, of_state = np.ascontiguousarray(np.concatenate([U[0], U[1]], 1)), np.ascontiguousarray(U[2])
        T, H = dout.shape[1], dout.shape[3]
        dg = work.array("dg", *dout.shape[:3], 3 * H)
        dh, drh, product = (np.zeros((2, *dout.shape[2:]), np.float32) for _ in range(3))
        for end in range(T, 0, -NEAR):
            # The slopes of a few bytes, which stay near the core.  That of x / (1 + |x|) is the
            # square of 1 - |its value|; of a gate it is twice that of the smaller part.
            start = max(0, end - NEAR)
            part = np.s_[:, start:end]
            rest = 1 - z[part]
            of_new = np.abs(n[part])
            np.subtract(1, of_new, out=of_new)
            of_new *= of_new
            of_new *= z[part]
            of_z = np.minimum(z[part], rest)
            of_z *= of_z
            of_z *= 2
            of_z *= n[part] - h[part]
            of_r = np.minimum(r[part], 1 - r[part])
            of_r *= of_r
            of_r *= 2
            of_r *= h[part]
            for k in range(end - start - 1, -1, -1):
                t = start + k
                dh += dout[:, t]
                now = dg[:, t]
                np.multiply(dh, of_z[:, k], out=now[:, :, :H])
                np.matmul(np.multiply(dh, of_new[:, k], out=now[:, :, 2 * H :]), of_state, out=drh)
                np.multiply(drh, of_r[:, k], out=now[:, :, H : 2 * H])
                dh *= rest[:, k]
                drh *= r[:, t]
                dh += drh
                dh += np.matmul(now[:, :, : 2 * H], of_gates, out=product)
        return dg

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, mean probability) of each whole text."""
        return [(language, score) for language, score, _ in self.judged(texts)]

    def judged(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, mean probability, that of no language) of each whole text."""
        real = [k for k, x in enumerate(self.languages) if x != NONE]
        if not real:
            return [("und", 0.0, 0.0)] * len(texts)
        data = [t.lower().encode() if t and any(map(str.isalpha, t)) else b"" for t in texts]
        total = np.zeros((len(texts), len(self.languages)))
        rows, owners = [], []
        for i, d in enumerate(data):
            for at in range(0, len(d), SEGMENT):
                rows.append(d[at : at + SEGMENT])
                owners.append(i)
            while len(rows) >= LANES or rows and i == len(data) - 1:
                self._add(rows[:LANES], owners[:LANES], total)
                rows, owners = rows[LANES:], owners[LANES:]
        total /= np.array([max(1, len(d)) for d in data])[:, None]
        best = total[:, real].argmax(1)
        none = total[:, self.languages.index(NONE)] if NONE in self.languages else np.zeros(len(texts))
        none = np.where([len(d) < SHORT_TEXT for d in data], 0.0, none)
        return [(self.languages[real[k]], float(min(1.0, total[i, real[k]])), float(none[i])) if data[i] else ("und", 0.0, 0.0) for i, k in enumerate(best.tolist())]

    def _add(self, rows: list[bytes], owners: list[int], total: np.ndarray) -> None:
        np.add.at(total, owners, self.summed(*padded(rows, SEGMENT)))

    def positions(self, text: str) -> list[str]:
        """The most probable language at each byte of the lower-case text."""
        data = text.lower().encode()
        rows = [data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)]
        if not rows:
            return []
        x, valid = padded(rows, SEGMENT)
        best = self.probabilities(x).argmax(2)
        return [self.languages[k] for k in best.T[valid.T].tolist()]


def padded(rows: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (size, rows) with zeros behind each row, and which are the row's own."""
    flat = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in rows), np.uint8).reshape(-1, size).T
    return flat, np.arange(size)[:, None] < np.array([len(r) for r in rows])[None, :]


class Adam:
    """Steps of one network; gradients are cut to length 1."""

    def __init__(self, net: Network):
        self.net, self.steps = net, 0
        self.m, self.v = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))

    def step(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
        for k, g in grad.items():
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.net.p[k] = (self.net.p[k] - rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)


def _drawn(by: list[list[bytes]], y: np.ndarray, r: np.random.Generator) -> list[bytes]:
    """A random segment of a random text of each language in y."""
    rows = []
    for k in y:
        data = by[k][r.integers(len(by[k]))]
        at = r.integers(max(1, len(data) - TRAIN_SEGMENT // 2))
        rows.append(data[at : at + TRAIN_SEGMENT] or b" ")
    return rows


def _by_language(samples: list[tuple[str, str]], languages: list[str]) -> list[list[bytes]]:
    return [[t.lower().encode() for t, lang in samples if lang == x and t] or [b" "] for x in languages]


def train(samples: list[tuple[str, str]], steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> Network:
    """Adam on random segments of (text, language) samples, every language as often."""
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return Network([], {})
    net, r, work = Network.fresh(languages), np.random.default_rng(seed), Work()
    by, adam = _by_language(samples, languages), Adam(net)
    for step in range(1, steps + 1):
        y = r.integers(0, len(languages), batch)
        x, valid = padded(_drawn(by, y, r), TRAIN_SEGMENT)
        adam.step(net.gradients(x, y, valid, work=work)[1], RATE * (1 - step / (steps + 1)) ** 0.5)
    return net


def learned(net: Network, rows: list[bytes], y: np.ndarray, by: list[list[bytes]], seed: int) -> dict[str, np.ndarray]:
    """What the network comes to on these segments, each at least once, in the order given."""
    mine, r = Network(net.languages, dict(net.p)), np.random.default_rng(seed)
    adam, once, work = Adam(mine), -(-len(rows) // STEP), Work()
    steps = once * -(-LEAST_STEPS // once)
    for i in range(steps):
        at = i % once * STEP
        again = r.integers(0, len(by), max(1, min(STEP, len(rows)) // REPLAY))
        of = np.concatenate([y[at : at + STEP], again])
        x, valid = padded(rows[at : at + STEP] + _drawn(by, again, r), TRAIN_SEGMENT)
        # Every language of the step counts alike, however many segments it has.
        share = 1 / np.maximum(1, np.bincount(of))
        adam.step(mine.gradients(x, of, valid, share[of], work)[1], RATE * (1 - i / steps))
    return mine.p


def _segments(labelled: DataFrame, languages: list[str], groups: int) -> DataFrame:
    """(group, place, y, segment): of every STRETCH bytes of each text in lower case one segment,
    from a place that a hash gives; where no language is learned too, one in as many as there are
    languages is there once more with its characters in random order."""
    number, none = {x: i for i, x in enumerate(languages)}, languages.index(NONE) if NONE in languages else None

    def cut(batches):
        for batch in batches:
            places, ys, rows = [], [], []
            for h, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.lower().encode() or b" "
                starts = np.arange(0, len(data), STRETCH)
                own = mix64(starts.astype(np.uint64) + np.uint64(h & (1 << 64) - 1))
                room = np.maximum(1, np.minimum(STRETCH, len(data) - starts) - TRAIN_SEGMENT)
                for at, place in zip((starts + (own >> np.uint64(8)).astype(np.int64) % room).tolist(), own.view(np.int64).tolist(), strict=True):
                    row = data[at : at + TRAIN_SEGMENT]
                    found = [(number[lang], row)]
                    if none is not None and place % max(1, len(languages) - 1) == 0:
                        chars = np.array(list(row.decode(errors="ignore")) or [" "])
                        found.append((none, "".join(chars[np.random.default_rng(place & (1 << 64) - 1).permutation(len(chars))].tolist()).encode()))
                    for y, x in found:
                        places.append(place)
                        ys.append(y)
                        rows.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([(p >> 20) % groups for p in places], pa.int32()), pa.array(places, pa.int64()), pa.array(ys, pa.int32()), pa.array(rows, pa.binary())], names=["group", "place", "y", "segment"])

    return labelled.select(F.xxhash64("id", "text"), "text", "lang").mapInArrow(cut, "group int, place long, y int, segment binary")


def refined(labelled: DataFrame, net: Network, samples: list[tuple[str, str]]) -> Network:
    """The network after it has seen every labelled document: the mean, by segments, of what it
    comes to in each group."""
    spark = labelled.sparkSession
    small_batches(spark)
    known = labelled.where(F.col("lang").isin([x for x in net.languages if x != NONE]))
    size = known.agg(F.sum(F.ceil(F.length("text") / STRETCH))).first()[0] or 0
    shared = spark.sparkContext.broadcast((net, _by_language(samples, net.languages)))
    names = sorted(net.p)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "y", "segment"])
        net, by = shared.value
        p = learned(net, rows["segment"].tolist(), rows["y"].to_numpy(), by, int(rows["group"].iloc[0]))
        return pd.DataFrame({"group": [int(rows["group"].iloc[0])], "n": [len(rows)], "p": [np.concatenate([p[k].reshape(-1) for k in names]).tobytes()]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("group")
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) * n for p, n in zip(rows["p"], rows["n"], strict=True))
        return pd.DataFrame({"part": [int(rows["group"].iloc[0]) % SUMS], "n": [int(rows["n"].sum())], "p": [total.tobytes()]})

    # Rows that repeat in id and text are learned from once.
    segments = _segments(known, net.languages, max(1, -(-int(size) // GROUP))).distinct()
    found = segments.groupBy("group").applyInPandas(group, "group int, n long, p binary")
    sums = sorted(found.groupBy(F.col("group") % SUMS).applyInPandas(added, "part int, n long, p binary").collect(), key=lambda r: r["part"])
    if not sums:
        return net
    total, n = sum(np.frombuffer(r["p"], np.float64) for r in sums), sum(r["n"] for r in sums)
    ends = np.cumsum([net.p[k].size for k in names])[:-1]
    parts = np.split((total / n).astype(np.float32), ends)
    return Network(net.languages, {k: x.reshape(net.p[k].shape) for k, x in zip(names, parts, strict=True)})


def none_limit(judged: DataFrame) -> float:
    """What MOST_BELOW of the shares ``none`` stay below, up to 1 / BINS, LEAST_NONE at least:
    all of them are counted, by steps of that size."""
    bins = sorted(tuple(r) for r in judged.groupBy(F.ceil(F.col("none") * BINS).alias("b")).count().collect())
    most, seen = MOST_BELOW * sum(n for _, n in bins), 0
    for b, n in bins:
        seen += n
        if seen >= most:
            return max(LEAST_NONE, b / BINS)
    return LEAST_NONE


def sampled(labelled: DataFrame) -> list[tuple[str, str, list[str]]]:
    """(language, id, texts): of each of the LANGUAGES most frequent label values about
    SAMPLE_DOCS different documents, chosen by a hash of id and text."""
    top = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    counts = {r[0]: r[1] for r in top.collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, SAMPLE_DOCS / n))])
    chosen = labelled.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 20))
    places = [F.substring(F.col("text"), (F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(F.lit(1), F.length("text") - CHARS)) + 1).cast("int"), F.lit(CHARS)) for k in range(PLACES)]
    rows = chosen.select("id", "lang", F.array(*places).alias("texts")).distinct().collect()
    return sorted((r["lang"], r["id"], r["texts"]) for r in rows)


def fit(docs: DataFrame, none: bool = False) -> Network:
    """Learns from all labelled documents that are not held out, starting from a sample of
    them; with ``none`` a class of no language too, whose limit is what MOST_BELOW of all
    labelled held-out documents stay below, LEAST_NONE at least."""
    labelled = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and id is not null")
    learn = labelled.where(~held_out(F.col("id")))
    samples = [(t, lang) for lang, _, texts in sampled(learn) for t in texts]
    if not samples:
        return train(samples)
    if none:
        r = np.random.default_rng(SEED)
        order = r.permutation(len(samples))[: -(-len(samples) // len({lang for _, lang in samples}))]
        samples += [("".join(np.array(list(samples[i][0]))[r.permutation(len(samples[i][0]))].tolist()) if samples[i][0] else "", NONE) for i in order]
    net = refined(learn, train(samples), samples)
    if none:
        judge = predictor(docs.sparkSession, net)
        net.none_limit = none_limit(labelled.where(held_out(F.col("id"))).select(judge(F.col("text")).alias("p")).select("p.none"))
    return net


_PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("none", T.DoubleType())])


def predictor(spark: SparkSession, net: Network):
    """A column function text -> (lang_pred, score, none)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf(_PREDICTION)
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.judged(text.tolist()), columns=["lang_pred", "score", "none"])

    return predict


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    predict = predictor(docs.sparkSession, net or fit(docs))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predict(F.col("text").cast("string")).alias("p"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
