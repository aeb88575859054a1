"""Toxicity: a counterfactually regularised logistic classifier over word presence.

Features are the distinct words of the whole text (letters, A-Z lowered) and their
beginnings of 4 to 6 bytes, which inflected forms share, hashed into ``BUCKETS``. Identity
terms (``IDENTITY``, a parameter) have a feature each of their own, beyond the buckets, and no
beginnings, so no other word can be taken for one of them, nor one of them for another word. The
model is fitted on a bounded, documented sample of labelled rows (at most ``PER_CLASS``
rows of each label, chosen by a hash of the id) on the features whose share differs between
the labels by ``SCREEN`` standard errors, by proximal gradient steps on

    logistic loss  +  l1 |w|  +  cf * mean over pairs of (score(x) - score(x'))^2,

where a score is a logit, and the pairs are of two kinds:

* swaps: x is a labelled text that names a group, x' the same text with the terms of that set moved on
  by one or more places in the set. The words are swapped in the text and all features are taken anew;
* neutral mentions: x is a text of label 0 of the sample, x' the same text that also names a group. There are
  ``NEUTRAL`` texts for each term, so that a term counts where the labelled rows say nothing of it.

The first kind ties what the terms of a set do to a score, the second keeps that small, so that
naming a group does not by itself raise or lower a score.

The sampled texts are read once into a table of the shared folder; the driver gets counts by bucket and, of the
texts, only the features that passed the screen. Only the weights are broadcast; scoring is one pass over the documents
in the tasks that read them. Labels, lang, source and doc_id are never features.

Defined results: null and empty texts get the score of the bias alone; repeated rows each
give a row; without labels of both classes every score is 0.5 (nothing learned); other
columns are ignored (``score``) or kept (``keep_clean``), whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _labels, _text

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
PER_CLASS = 12_000
THRESHOLD = 0.3
L1 = 2e-5
SCREEN = 4.0
COUNTERFACTUAL = 1.0
STEPS = 500
NEUTRAL = 64

#: Sets of identity terms that are swapped for each other; any list can be given.
IDENTITY = (
    ("women", "girls", "ladies", "boys", "gentlemen"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "transgender", "bisexual"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def flat(identity=IDENTITY) -> list[str]:
    return sorted({w for group in identity for w in group})


def features(column: pa.Array, buckets: int = BUCKETS, identity=IDENTITY) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each text, sorted: distinct words and their beginnings, and ``buckets`` + place of identity terms."""
    data, offs = _text.buffer(column)
    data = _LOW[data]
    s, e, row = _text.spans(data, offs, _LETTER)
    h = _text.hashes(data, s, e)
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    first = order[new]
    names = np.array([_hash(w) for w in flat(identity)], np.uint64)
    by = np.argsort(names)
    at = np.minimum(np.searchsorted(names[by], h[first]), max(len(names) - 1, 0))
    term = names[by][at] == h[first] if len(names) else np.zeros(len(first), bool)
    width = buckets + len(names)
    parts = [row[first[term]] * width + buckets + by[at[term]]] if len(names) else []
    first = first[~term]
    parts.append(row[first] * width + (h[first] % np.uint64(buckets)).astype(np.int64))
    for n in PREFIXES:
        long = first[e[first] - s[first] > n]
        parts.append(row[long] * width + (_text.mix(_text.hashes(data, s[long], s[long] + n), n) % np.uint64(buckets)).astype(np.int64))
    both = np.unique(np.concatenate(parts))
    return both // width, both % width


def _hash(word: str) -> np.uint64:
    data = _LOW[np.frombuffer(word.encode(), np.uint8)]
    return _text.hashes(data, np.array([0]), np.array([len(data)]))[0]


def bucket(word: str, buckets: int = BUCKETS) -> int:
    """The bucket of a whole word that is no identity term."""
    return int(_hash(word) % np.uint64(buckets))


def slot(term: str, buckets: int = BUCKETS, identity=IDENTITY) -> int:
    """The feature of an identity term."""
    return buckets + flat(identity).index(term)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, identity=IDENTITY):
        self.weights, self.bias, self.identity = weights, bias, identity

    def score(self, column: pa.Array) -> np.ndarray:
        row, b = features(column, len(self.weights) - len(flat(self.identity)), self.identity)
        z = np.bincount(row, weights=self.weights[b], minlength=len(column)) if len(row) else np.zeros(len(column))
        return _labels.sigmoid(z + self.bias)


def counterfactuals(texts: list[str | None], identity=IDENTITY) -> list[tuple[int, str]]:
    """(text, the text with the terms of one set swapped) for each text, each set it names and each way to move on in the set."""
    out = []
    for group in identity:
        low = [w.encode() for w in group]
        find = re.compile(rb"(?<![a-z\x80-\xff])(?:" + b"|".join(map(re.escape, low)) + rb")(?![a-z\x80-\xff])")
        for i, text in enumerate(texts):
            raw = _LOW[np.frombuffer((text or "").encode(), np.uint8)].tobytes()
            if find.search(raw):
                for k in range(1, len(low)):
                    out.append((i, find.sub(lambda m: low[(low.index(m[0]) + k) % len(low)], raw).decode()))
    return out


def screened(both: np.ndarray, in1: np.ndarray, n1: float, n0: float, z: float = SCREEN) -> np.ndarray:
    """Buckets whose share of the texts differs between the labels by ``z`` standard errors.

    ``both`` and ``in1`` count the texts, and those of label 1, that have each bucket.
    """
    p = (both + 1) / (n1 + n0 + 2)
    gap = in1 / max(n1, 1) - (both - in1) / max(n0, 1)
    return np.flatnonzero((both >= 2) & (np.abs(gap) >= z * np.sqrt(p * (1 - p) * (1 / max(n1, 1) + 1 / max(n0, 1)))))


class Objective:
    """Value and gradient of the smooth part of the loss in the weights and the bias."""

    def __init__(self, row: np.ndarray, col: np.ndarray, label: np.ndarray, width: int, pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, cf: float = COUNTERFACTUAL):
        self.row, self.col, self.label, self.width, self.cf = row, col, label, width, cf
        #: pair, feature and sign (1: of x only, -1: of x' only) of the features that the two texts of a pair don't share
        self.pair, self.at, self.sign = pairs if pairs is not None else (np.zeros(0, np.int64),) * 3
        self.pairs = int(self.pair.max()) + 1 if len(self.pair) else 0

    def __call__(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        n = len(self.label)
        z = np.bincount(self.row, weights=w[self.col], minlength=n) + bias
        value = float(np.logaddexp(0, np.where(self.label == 1, -z, z)).mean())
        g = (_labels.sigmoid(z) - self.label) / n
        grad = np.bincount(self.col, weights=g[self.row], minlength=self.width).astype(float)
        if self.pairs:
            d = np.bincount(self.pair, weights=w[self.at] * self.sign, minlength=self.pairs)
            value += self.cf * float(np.square(d).mean())
            grad += np.bincount(self.at, weights=2 * self.cf / self.pairs * d[self.pair] * self.sign, minlength=self.width)
        return value, grad, float(g.sum())


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, feature and sign of what the feature sets of the pairs (a[i], b[i]) don't share."""
    out = [(np.full(len(d), i), d, np.full(len(d), sign)) for i, (x, y) in enumerate(zip(a, b, strict=True)) for sign, d in ((1, np.setdiff1d(x, y)), (-1, np.setdiff1d(y, x)))]
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def fit(row: np.ndarray, col: np.ndarray, label: np.ndarray, swaps: tuple[list[np.ndarray], list[np.ndarray]] = ((), ()), share: float | None = None, buckets: int = BUCKETS, l1: float = L1, cf: float = COUNTERFACTUAL, steps: int = STEPS, neutral: int = NEUTRAL, identity=IDENTITY) -> Model:
    """Proximal steps over all sampled rows; ``swaps``: features of the texts x and x'; ``share`` is that of label 1 outside the sample."""
    n, terms = len(label), buckets + np.arange(len(flat(identity)))
    width = buckets + len(terms)
    if not n or label.min() == label.max():
        return Model(np.zeros(width), 0.0, identity)
    both, in1 = np.bincount(col, minlength=width), np.bincount(col, weights=label[row], minlength=width)
    names = np.union1d(screened(both, in1, label.sum(), n - label.sum()), terms)
    known = lambda c: np.searchsorted(names, c[np.isin(c, names)])
    a, b = [known(x) for x in swaps[0]], [known(x) for x in swaps[1]]
    keep = np.isin(col, names)
    r, c = row[keep], np.searchsorted(names, col[keep])
    cuts = np.searchsorted(r, np.arange(n + 1))
    plain = np.flatnonzero(label == 0)
    for i, t in enumerate(np.searchsorted(names, terms).tolist()):  # naming a group adds its feature and nothing else
        for j in plain[(np.arange(min(neutral, len(plain))) + i * neutral) % len(plain)].tolist():
            own = c[cuts[j] : cuts[j + 1]]
            a.append(own)
            b.append(np.union1d(own, t))
    loss = Objective(r, c, label, len(names), differences(a, b), cf)
    w, total = np.zeros(len(names)), np.full(len(names), 1e-8)
    bias, total_b = float(np.log(label.mean() / (1 - label.mean()))), 1e-8
    for _ in range(steps):
        _, grad, slope = loss(w, bias)
        total += grad**2
        total_b += slope**2
        rate = 0.5 / np.sqrt(total)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        bias -= 0.5 / np.sqrt(total_b) * slope
    if share is not None and 0 < share < 1:  # the sample holds more of the rarer label than the rows it is from
        bias += np.log(share / (1 - share)) - np.log(label.mean() / (1 - label.mean()))
    full = np.zeros(width)
    full[names] = w
    return Model(full, float(bias), identity)


def _lists(row: np.ndarray, col: np.ndarray, n: int) -> list[np.ndarray]:
    cuts = np.searchsorted(row, np.arange(n + 1))
    return [col[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text", **options) -> Model:
    """Fit on at most ``2 * per_class`` labelled rows; that bound also allows the broadcast of their ids."""
    chosen = _labels.sample(labels, label, modulus, remainder, per_class)
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("double").alias("label"))
    rows = _text.stored(picked, "sample")
    identity = options.get("identity", IDENTITY)
    terms = BUCKETS + np.arange(len(flat(identity)))

    def counted(batches):
        for b in _text.pieces(batches, 0):
            y = b.column(1).to_numpy()
            row, col = features(b.column(0), identity=identity)
            names, at = np.unique(col, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.bincount(at, minlength=len(names)), pa.int64()), pa.array(np.bincount(at, weights=y[row], minlength=len(names)).astype(np.int64))], names=["bucket", "n", "n1"])

    size = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # one row for each bucket at most, whatever the texts
    counts = rows.mapInArrow(counted, "bucket long, n long, n1 long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).where("n > 1").toArrow()
    both, in1 = np.zeros(BUCKETS + len(terms)), np.zeros(BUCKETS + len(terms))
    both[counts["bucket"].to_numpy()], in1[counts["bucket"].to_numpy()] = counts["n"].to_numpy(), counts["n1"].to_numpy()
    names = np.union1d(screened(both, in1, size.get(1.0, 0), size.get(0.0, 0)), terms)

    def kept(batches):
        blob = lambda xs: pa.array([x[np.isin(x, names)].astype("<i4").tobytes() for x in xs], pa.binary())
        for b in _text.pieces(batches, 0):
            own = _lists(*features(b.column(0), identity=identity), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(1), blob(own), pa.nulls(b.num_rows, pa.binary())], names=["label", "x", "swapped"])
            moved = counterfactuals(b.column(0).to_pylist(), identity)
            if moved:
                other = _lists(*features(pa.array([t for _, t in moved]), identity=identity), len(moved))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(moved), pa.float64()), blob([own[i] for i, _ in moved]), blob(other)], names=["label", "x", "swapped"])

    known = labels.where(F.col(label).isin(0, 1) & ~_labels.held_out(doc_id, modulus, remainder))
    share = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    # in an order that does not depend on the partitions
    found = sorted((tuple(r.values()) for r in rows.mapInArrow(kept, "label double, x binary, swapped binary").toArrow().to_pylist()), key=lambda t: (t[0] is None, t[0] or 0.0, t[1], t[2] or b""))
    _text.discard(rows)
    opened = lambda k, some: [np.frombuffer(t[k], "<i4").astype(np.int64) for t in some]
    base, moved = [t for t in found if t[0] is not None], [t for t in found if t[0] is None]
    cols = opened(1, base)
    col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
    return fit(np.repeat(np.arange(len(cols)), [len(x) for x in cols]), col, np.array([t[0] for t in base], float), (opened(1, moved), opened(2, moved)), share, **options)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in _text.pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)), pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in _text.pieces(batches, at):
            yield b.filter(pa.array(shared.value.score(b.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", _labels.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
