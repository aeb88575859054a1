"""Quality: Bradley-Terry scores learned from preference pairs, cut at a score quantile.

A document's features are figures of its whole text: shares of character classes, word and
line shapes, repetition, each also in a few soft steps so that a linear score can bend.
Every labelled training row of label 1 is preferred to every one of label 0. A score
s(x) = w.x is learned by logistic loss on feature differences over all these pairs:
P(x over y) = 1 / (1 + exp(s(y) - s(x))), with an l2 penalty.

The features of the training rows are stored once, in blocks, and read in passes that add
up figures; only sums leave a pass. Steps' knots and the cut are exact order statistics,
found digit by digit. The sum over pairs needs no list of pairs: a row's part depends on
the others only through the distribution of the other class's scores, which a pass counts
on a grid (linear between its nodes, h = ``STEP`` apart, or ``NODES`` over the span of the
scores where that is more than 256; a pair's probability is off by h * h / 40 at most).
Newton's steps use that gradient and a Hessian of wider score bins.

The cut is a quantile of the training rows' scores, the one at the share of label 0 among
them; the reported score is 1 / (1 + exp(cut - s)), so 0.5 is the cut.

Only the weights are broadcast; scoring is one pass in the tasks that read the documents.
Labels, lang, source and doc_id are never features.

Defined results: null and empty texts have the features of an empty text; repeated rows
each give a row, in training too; without labels of both classes every score is 0.5; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _labels, _text

STEPS = 300
L2 = 1e-4
BENDS = 7
STEP = 1 / 256
NODES = 1 << 16
BINS = 512
ROUNDS = 60
BLOCK = 1024
WIDE = 64

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 13), "line": (10,), "stop": b".", "comma": b",", "bang": b"!?", "bar": b"|",
    "hash": b"#$%&*@^~", "brace": b"{}<>[]()=;\\/", "quote": b"\"'`", "dash": b"-_+:", "lead": range(0xC2, 0xF5), "control": (*range(9), *range(14, 32), 127),
}
_CLASSES = np.zeros((256, len(_KINDS)))
for _i, _members in enumerate(_KINDS.values()):
    _CLASSES[list(_members), _i] = 1
_TOKEN = np.ones(256, bool)
_TOKEN[[32, 9, 10, 11, 12, 13]] = False
_LINE = np.ones(256, bool)
_LINE[10] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Distinct hashes of each row."""
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[new], minlength=rows).astype(float)


def features(column: pa.Array) -> np.ndarray:
    """One row of figures per text."""
    data, offs = _text.buffer(column)
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    counts = np.zeros((n, 256))
    for i in range(n):
        counts[i] = np.bincount(data[offs[i] : offs[i + 1]], minlength=256)
    shares = counts @ _CLASSES / np.maximum(size, 1)[:, None]
    s, e, row = _text.spans(data, offs, _TOKEN)
    count = lambda mask: np.bincount(row[mask], minlength=n).astype(float)
    words = np.bincount(row, minlength=n).astype(float)
    per = np.maximum(words, 1)
    long = (e - s).astype(float)
    mean = np.bincount(row, weights=long, minlength=n) / per
    spread = np.sqrt(np.maximum(np.bincount(row, weights=long**2, minlength=n) / per - mean**2, 0))
    h = _text.hashes(data, s, e)
    g, good = _text.ngrams(h, row, 4)
    grams = np.bincount(row[: len(g)][good], minlength=n).astype(float)
    first, last = (data[s], data[e - 1]) if len(s) else (np.zeros(0, np.uint8),) * 2
    upper = (first >= 65) & (first <= 90)
    second = data[np.minimum(s + 1, len(data) - 1)] if len(s) else first
    ls, le, lrow = _text.spans(data, offs, _LINE)
    lines = np.bincount(lrow, minlength=n).astype(float)
    per_line = np.maximum(lines, 1)
    ending = np.isin(data[le - 1], np.frombuffer(b".!?:", np.uint8)) if len(ls) else np.zeros(0, bool)
    figures = [
        np.log1p(size), np.log1p(words), mean, spread, count(long <= 3) / per, count(long >= 15) / per, count(upper) / per,
        count(upper & (second >= 65) & (second <= 90)) / per, count(~_LETTER[first]) / per, count(~_LETTER[last]) / per, count((last == 46) | (last == 33)) / per,
        _distinct(row, h, n) / per, np.where(grams > 0, _distinct(row[: len(g)][good], g[good], n) / np.maximum(grams, 1), 1.0),
        np.log1p(lines), size / per_line / 100, _distinct(lrow, _text.hashes(data, ls, le), n) / per_line, np.bincount(lrow[ending], minlength=n) / per_line,
        (counts > 0).sum(1) / 100,
    ]
    return np.column_stack([shares, *figures])


class Model:
    def __init__(self, knots: np.ndarray, weights: np.ndarray, cut: float):
        self.knots, self.weights, self.cut = knots, weights, cut

    def score(self, column: pa.Array) -> np.ndarray:
        return _labels.sigmoid(bend(features(column), self.knots) @ self.weights - self.cut)


def bend(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Each feature as soft steps at its knots: 0 below a knot's span, 1 above, linear within."""
    lo, hi = knots[:-1], knots[1:]
    parts = (x[:, None, :] - lo[None]) / np.maximum(hi - lo, 1e-9)[None]
    return np.clip(parts, 0, 1).reshape(len(x), -1)


Sums = list[np.ndarray]


def _add(parts: Iterable[Sums]) -> Sums:
    total: Sums = []
    for part in parts:
        total = [t + p for t, p in zip(total, part, strict=True)] if total else list(part)
    return total


class Rows:
    """Training rows in memory: figures, labels, and the sum of a function over blocks of them."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.x, self.label = x, label

    def total(self, of: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
        return _add(of(self.x[i : i + BLOCK], self.label[i : i + BLOCK] == 1) for i in range(0, len(self.x), BLOCK))


class Blocks:
    """Training rows as a table of blocks (x, y), bytes of figures and labels; sums are made in the tasks."""

    def __init__(self, table: DataFrame):
        self.table = table

    def total(self, of: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
        def run(batches):
            def parts():
                for b in batches:
                    for x, y in zip(b.column(0), b.column(1), strict=True):
                        y = np.frombuffer(y.as_buffer(), np.uint8)
                        yield of(np.frombuffer(x.as_buffer(), float).reshape(len(y), -1), y == 1)

            yield from packed(_add(parts()))

        def again(batches):
            yield from packed(_add(pickle.loads(v.as_py()) for b in batches for v in b.column(0)))

        def packed(sums):
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)], pa.binary())], names=["sums"])

        found = self.table.mapInArrow(run, "sums binary")
        if (n := self.table.rdd.getNumPartitions()) > WIDE:
            found = found.repartition(math.isqrt(n)).mapInArrow(again, "sums binary")
        return _add(pickle.loads(r.sums) for r in found.collect())


def _keys(x: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the values."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys).view(float)


def ranked(rows: Rows | Blocks, of: Callable[[np.ndarray], np.ndarray], columns: int, ranks: list[int], bits: int = 8) -> np.ndarray:
    """The values at those ranks (from 0) of each column of ``of(x)``, exactly: a digit of their keys in each pass."""
    found = np.zeros((len(ranks), columns), np.uint64)
    left = np.repeat(np.array(ranks, np.int64)[:, None], columns, axis=1)
    size = 1 << bits
    for shift in range(64 - bits, -1, -bits):
        heads = [np.unique(found[:, c]) for c in range(columns)]

        def count(x, y, shift=shift, heads=heads):
            k = _keys(of(x))
            high = (k >> np.uint64(shift)) >> np.uint64(bits)
            digit = (k >> np.uint64(shift)).astype(np.int64) & (size - 1)
            out = []
            for c, h in enumerate(heads):
                at = np.minimum(np.searchsorted(h, high[:, c]), len(h) - 1)
                hit = h[at] == high[:, c]
                out.append(np.bincount(at[hit] * size + digit[hit, c], minlength=len(h) * size))
            return out

        for c, counts in enumerate(rows.total(count)):
            at = np.searchsorted(heads[c], found[:, c])
            for i, below in enumerate(np.cumsum(counts.reshape(-1, size), axis=1)[at]):
                d = int(np.searchsorted(below, left[i, c], side="right"))
                left[i, c] -= below[d - 1] if d else 0
                found[i, c] = (found[i, c] << np.uint64(bits)) | np.uint64(d)
    return _values(found)


def spread(rows: Rows | Blocks, n: int, width: int) -> np.ndarray:
    """Knots halfway between the quantiles of each figure and even steps over its span."""
    at = np.linspace(0, 1, BENDS + 1) * (n - 1)
    low = np.floor(at).astype(int)
    ranks = sorted({*low.tolist(), *np.ceil(at).astype(int).tolist()})
    values = dict(zip(ranks, ranked(rows, _same, width, ranks), strict=True))
    part = (at - low)[:, None]
    quantiles = np.array([values[r] for r in low]) * (1 - part) + np.array([values[r] for r in np.ceil(at).astype(int)]) * part
    return (quantiles + np.linspace(values[0], values[n - 1], BENDS + 1)) / 2


def _same(x: np.ndarray) -> np.ndarray:
    return x


def _against(weight: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """At each node a the sum over nodes b of weight[b] * kernel[a - b], kernel from 1 - n to n - 1."""
    n = len(weight)
    size = 1 << (3 * n).bit_length()
    return np.fft.irfft(np.fft.rfft(weight, size) * np.fft.rfft(kernel, size), size)[n - 1 : 2 * n - 1]


class _Grid:
    """The scores of both classes under some weights, counted on a grid, and the mean loss over all pairs."""

    def __init__(self, rows: Rows | Blocks, knots: np.ndarray, w: np.ndarray, l2: float):
        low, high = w[w < 0].sum(), w[w > 0].sum()
        step = max(STEP, (high - low) / (NODES - 2))
        n = int((high - low) / step) + 2
        per = max(int(0.25 / STEP), -(-n // BINS))
        bins = (n - 2) // per + 1

        def place(x):
            z = bend(x, knots)
            s = (z @ w - low) / step
            node = np.clip(s.astype(np.int64), 0, n - 2)
            return z, node, np.clip(s - node, 0, 1)

        def count(x, y):
            _, node, part = place(x)
            out = []
            for c in (y, ~y):
                out += [np.bincount(node[c], 1 - part[c], n) + np.bincount(node[c] + 1, part[c], n), np.bincount(node[c] // per, minlength=bins)]
            return out

        good, self.good, bad, self.bad = rows.total(count)
        self.n_good, self.n_bad = self.good.sum(), self.bad.sum()
        good, bad = good / self.n_good, bad / self.n_bad
        gap = np.arange(1 - n, n) * step
        self.wrong_good = _against(bad, _labels.sigmoid(-gap))  # chance of the wrong order against the other class
        self.wrong_bad = _against(good, _labels.sigmoid(gap))
        self.loss = bad @ _against(good, np.logaddexp(0, gap)) + l2 / 2 * w @ w
        self.rows, self.w, self.l2, self.place, self.per, self.width = rows, w, l2, place, per, per * step

    def slope(self) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the loss, and its Hessian with the scores at the middle of their bins."""
        gap = np.subtract.outer(np.arange(len(self.good)), np.arange(len(self.good))) * self.width
        curve = _labels.sigmoid(gap) * _labels.sigmoid(-gap) / (self.n_good * self.n_bad)
        tables = (self.wrong_good, curve @ self.bad), (self.wrong_bad, curve @ self.good)
        place, per, bins, scale = self.place, self.per, len(self.good), (-1 / self.n_good, 1 / self.n_bad)

        def part(x, y):
            z, node, inner = place(x)
            pull, square, sums = np.zeros(z.shape[1]), np.zeros((z.shape[1],) * 2), []
            for c, (wrong, own), k in zip((y, ~y), tables, scale, strict=True):
                zc, at, f = z[c], node[c], inner[c]
                pull += (wrong[at] * (1 - f) + wrong[at + 1] * f) @ zc * k
                square += (zc * own[at // per][:, None]).T @ zc
                by = np.zeros((bins, z.shape[1]))
                order = np.argsort(at, kind="stable")
                b, first = np.unique(at[order] // per, return_index=True)
                if len(b):
                    by[b] = np.add.reduceat(zc[order], first, axis=0)
                sums.append(by)
            return [pull, square, *sums]

        pull, square, good, bad = self.rows.total(part)
        cross = good.T @ curve @ bad
        return pull + self.l2 * self.w, square - cross - cross.T + self.l2 * np.eye(len(pull))


def prefer(rows: Rows | Blocks, knots: np.ndarray, l2: float = L2) -> np.ndarray:
    """Bradley-Terry weights over every pair of a row of label 1 and one of label 0, by Newton's steps."""
    at = _Grid(rows, knots, np.zeros(BENDS * knots.shape[1]), l2)
    for _ in range(ROUNDS):
        grad, hess = at.slope()
        move = -np.linalg.solve(hess, grad)
        if -grad @ move < 1e-9:
            break
        t = 1.0
        while (new := _Grid(rows, knots, at.w + t * move, l2)).loss > at.loss + 1e-4 * t * (grad @ move) + 1e-7 and t > 1e-4:
            t /= 2
        at = new
    else:
        move = np.zeros(len(at.w))
    return np.round(at.w + move, 6)  # the same weights whatever the order of the sums


def fit(x: np.ndarray, label: np.ndarray, share_low: float, pairs: int | None = None, steps: int = STEPS, l2: float = L2, seed: int = 0) -> Model:
    """Bradley-Terry weights of rows in memory: over every pair, or by accelerated gradient steps over as many drawn ones as ``pairs`` says."""
    width = x.shape[1] if x.ndim == 2 else 0
    if not len(label) or label.min() == label.max():
        return Model(np.zeros((BENDS + 1, width)), np.zeros(BENDS * width), 0.0)
    knots = spread(Rows(x, label), len(x), width)
    z = bend(x, knots)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w = prefer(Rows(x, label), knots, l2) if pairs is None else _drawn(z, good, bad, pairs, steps, l2, seed)
    s = z @ w
    # the quantile of the labelled population: both classes weighted by their shares
    share = np.where(label == 0, share_low / len(bad), (1 - share_low) / len(good))
    order = np.argsort(s)
    below = np.cumsum(share[order])
    k = int(np.searchsorted(below, share_low))
    k = min(max(k, 0), len(order) - 2)
    return Model(knots, w, float((s[order[k]] + s[order[k + 1]]) / 2))


def _drawn(z: np.ndarray, good: np.ndarray, bad: np.ndarray, pairs: int, steps: int, l2: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    rate = 4.0 / (np.square(z[i[:5000]] - z[j[:5000]]).sum(1).mean() + 1e-9)
    for _ in range(steps):
        s = z @ v
        p = _labels.sigmoid(s[j] - s[i]) / pairs  # chance of the wrong order
        pull = np.bincount(i, weights=p, minlength=len(z)) - np.bincount(j, weights=p, minlength=len(z))
        new = v + rate * (z.T @ pull - l2 * v)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def blocks(docs: DataFrame, chosen: DataFrame, modulus: int, remainder: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Figures and labels of the chosen rows, in blocks of bytes; the join carries figures, not texts."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~_labels.held_out("doc_id", modulus, remainder))
    schema = T.StructType([source.schema["doc_id"], T.StructField("x", T.BinaryType())])

    def run(batches):
        for b in _text.pieces(batches, 1):
            x = np.ascontiguousarray(features(b.column(1)))
            ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])], names=schema.names)

    def pack(batches):
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                some = b.slice(i, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([_text.buffer(some.column(0))[0].tobytes()], pa.binary()), pa.array([np.asarray(some.column(1)).astype(np.uint8).tobytes()], pa.binary())], names=["x", "y"])
        _text.release()

    return source.mapInArrow(run, schema).hint("merge").join(chosen, "doc_id").select("x", "label").mapInArrow(pack, "x binary, y binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on every labelled row that is not held out."""
    table = _text.stored(blocks(docs, _labels.known(labels, label, modulus, remainder), modulus, remainder, doc_id, text), "quality")
    rows, width = Blocks(table), features(pa.array([""])).shape[1]
    sums = rows.total(lambda x, y: [np.array([(~y).sum(), y.sum()])])
    bad, good = (int(n) for n in sums[0]) if sums else (0, 0)
    if not bad or not good:
        model = Model(np.zeros((BENDS + 1, width)), np.zeros(BENDS * width), 0.0)
    else:
        knots = spread(rows, bad + good, width)
        w = prefer(rows, knots)
        around = ranked(rows, lambda x: (bend(x, knots) @ w)[:, None], 1, [bad - 1, bad], 16)  # as many rows below the cut as have label 0
        model = Model(knots, w, float(around.mean()))
    _text.discard(table)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in _text.pieces(batches, 1):
            m = shared.value
            s = m.score(b.column(1)) if len(m.weights) else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", _labels.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
