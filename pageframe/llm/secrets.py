"""Secret scan: fixed patterns, plus random-looking tokens found by a battery of tests.

Base kinds (leftmost, non-overlapping, per kind): ``assign`` (a value assigned to a
password-like name), ``access`` (access-key ids) and ``hex`` (long lower-case hex runs).

The battery adds kind ``random``. Runs of the characters of all encodings are cut at ``=``
(but for final padding), as in NAME=value; the candidates are the maximal runs of each
encoding's alphabet of at least ``MIN_TOKEN`` characters within, equal ones once, so that a
value glued to a path or a prefix is tested by itself too. A candidate's encoding is inferred from the characters that
occur (hex, base 32, base 36, base 62, base 64). Since a secret is what looks uniform, each
test has "not random" as its null hypothesis, so that a small p-value speaks for a secret:

* chi-squared uniformity over the encoding's alphabet: the null is a departure per
  character of at least that of words; p is the lower tail of the noncentral chi-squared
  distribution (Sankaran's normal approximation);
* runs of character classes: the null is at most ``RUNS`` of the runs of a uniform string;
* serial correlation of neighbours' places in the alphabet: the null is ``SERIAL`` or more.

All three must reject, so a token's p-value is their maximum. Within a document, the
p-values go through the Benjamini-Hochberg procedure at rate ``FDR`` with weights
proportional to the tokens' lengths (long tokens carry more evidence and get more of the
error rate). The family is the document, so no result depends on other rows. Finds that
overlap are one span.

Defined results: null and empty texts have no spans; repeated rows each give a row; whole
texts are scanned; other columns are left out (``scan``) or kept (``redact``).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _text

MIN_TOKEN = 20
FDR = 0.05
RUNS = 0.5
SERIAL = 0.7
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=")] = True

_UP, _LOW, _DIG = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
#: name, alphabet, noncentrality per character from which a token counts as not random
ENCODINGS = (
    ("hex", _DIG + b"abcdef", 0.8),
    ("HEX", _DIG + b"ABCDEF", 0.8),
    ("base32", _UP + b"234567", 1.4),
    ("base36", _DIG + _LOW, 1.6),
    ("BASE36", _DIG + _UP, 1.6),
    ("base62", _UP + _LOW + _DIG, 1.8),
    ("base64", _UP + _LOW + _DIG + b"+/", 1.8),
    ("base64url", _UP + _LOW + _DIG + b"-_", 1.8),
)
_RUNS = [re.compile(b"[" + re.escape(letters) + b"]{%d,}" % MIN_TOKEN) for _, letters, _ in ENCODINGS]
_PLACE = []
for _, _letters, _ in ENCODINGS:
    _table = np.full(256, -1)
    _table[list(_letters)] = np.arange(len(_letters))
    _PLACE.append(_table)
_CLASS = np.zeros(256, np.int8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3


def _phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def noncentral_chi2_cdf(x: float, df: float, lam: float) -> float:
    """Sankaran's approximation to the distribution function."""
    if x <= 0:
        return 0.0
    h = 1 - 2 / 3 * (df + lam) * (df + 3 * lam) / (df + 2 * lam) ** 2
    p = (df + 2 * lam) / (df + lam) ** 2
    m = (h - 1) * (1 - 3 * h)
    return _phi(((x / (df + lam)) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p)))


def encoding(token: bytes) -> int | None:
    """Index in ENCODINGS of the smallest alphabet that holds all of the token."""
    used = set(token)
    return next((i for i, (_, letters, _) in enumerate(ENCODINGS) if used <= set(letters)), None)


def p_value(token: bytes) -> float:
    """Largest p-value of the battery; the null hypothesis is that the token is not random."""
    body = token.rstrip(b"=")
    which = encoding(body)
    n = len(body)
    if which is None or n < 8:
        return 1.0
    _, letters, delta = ENCODINGS[which]
    k = len(letters)
    raw = np.frombuffer(body, np.uint8)
    place = _PLACE[which][raw]
    counts = np.bincount(place, minlength=k)
    x2 = float(((counts - n / k) ** 2).sum() * k / n)
    uniform = noncentral_chi2_cdf(x2, k - 1, n * delta)
    share = np.bincount(_CLASS[list(letters)], minlength=4) / k
    change = 1 - float((share**2).sum())
    mean, sd = (n - 1) * change, math.sqrt(max((n - 1) * change * (1 - change), 1e-9))
    classes = _CLASS[raw]
    turns = int((classes[1:] != classes[:-1]).sum())
    runs = 1 - _phi((turns - RUNS * mean) / sd)
    d = place - place.mean()
    var = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / var if var else 1.0
    serial = _phi((abs(r) - SERIAL) * math.sqrt(n))
    return max(uniform, runs, serial)


def candidates(run: bytes) -> list[tuple[int, int]]:
    """Places of the candidates in a run of token characters, in order."""
    out = set()
    for m in re.finditer(rb"[^=]+", run):
        final = not run[m.end() :].strip(b"=")
        for rx in _RUNS:
            for t in rx.finditer(run, m.start(), m.end()):
                out.add((t.start(), len(run) if final and t.end() == m.end() else t.end()))
    return sorted(out)


def discoveries(tokens: list[bytes], rate: float = FDR) -> list[bool]:
    """Weighted Benjamini-Hochberg over one document's tokens, weights by length."""
    if not tokens:
        return []
    total = sum(map(len, tokens))
    q = np.array([p_value(t) * total / (len(t) * len(tokens)) for t in tokens])
    order = np.sort(q)
    ok = np.flatnonzero(order <= rate * np.arange(1, len(q) + 1) / len(q))
    return (q <= order[ok[-1]]).tolist() if len(ok) else [False] * len(q)


def outside(extra: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The sorted places that lie in none of the sorted base spans: one pass over both."""
    kept, reach, i = [], -1, 0
    for x, y in extra:
        while i < len(base) and base[i][0] <= x:
            reach = max(reach, base[i][1])
            i += 1
        if y > reach:
            kept.append((x, y))
    return kept


def scan_column(column: pa.Array) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text its spans: start and end in code points, kind, start and end in bytes."""
    data, offs = _text.buffer(column)
    rows = len(offs) - 1
    found: list[list] = [[] for _ in range(rows)]
    for table, least, kind in ((_IS_HEX, 24, 2), (_IS_TOKEN, MIN_TOKEN, 3)):
        s, e, row = _text.spans(data, offs, table)
        at = np.flatnonzero(e - s >= least)
        for i, x, y in zip(row[at].tolist(), s[at].tolist(), e[at].tolist(), strict=True):
            found[i].append((kind, x - int(offs[i]), y - int(offs[i])))
    whole = data.tobytes()
    out = []
    for i in range(rows):
        raw = whole[offs[i] : offs[i + 1]]
        low = raw.lower()
        own = found[i]
        if any(x in low for x in _NAMES):
            own.extend((0, m.start(), m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6)
        if b"AKIA" in raw:
            own.extend((1, m.start(), m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20)
        if not own:
            out.append([])
            continue
        base = sorted((x, y, k) for k, x, y in own if k < 3)
        extra = [(x + a, x + b) for k, x, y in own if k == 3 for a, b in candidates(raw[x:y])]
        extra = outside(sorted(extra), base)
        hit = discoveries([raw[x:y] for x, y in extra])
        joined: list[tuple[int, int, int]] = []
        for x, y in sorted(t for t, good in zip(extra, hit, strict=True) if good):
            if joined and x < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(y, joined[-1][1]), 3)
            else:
                joined.append((x, y, 3))
        every = sorted([*base, *joined], key=lambda t: (t[0], t[2]))
        if not every:
            out.append([])
            continue
        points = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=points[1:])
        out.append([(int(points[x]), int(points[y]), k, x, y) for x, y, k in every])
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id and its spans (kind, start, end in code points) by start, kind."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("spans", _SPANS)])

    def run(batches):
        for b in _text.pieces(batches, 1):
            found = [[{"kind": KINDS[k], "start": x, "end": y} for x, y, k, _, _ in own] for own in scan_column(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ARROW_SPANS)], names=schema.names)

    return source.mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; all rows and columns stay."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in _text.pieces(batches, at):
            texts, sizes = b.column(at).to_pylist(), b.column(chars).to_pylist() if chars is not None else None
            for i, own in enumerate(scan_column(b.column(at))):
                if own:
                    raw, out, p = texts[i].encode(), [], 0
                    for _, _, _, x, y in sorted(own, key=lambda t: t[3]):
                        if x >= p:
                            out += [raw[p:x], mark.encode()]
                        p = max(p, y)
                    texts[i] = b"".join([*out, raw[p:]]).decode()
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            arrays = list(b.columns)
            arrays[at] = pa.array(texts, arrays[at].type)
            if sizes is not None:
                arrays[chars] = pa.array(sizes, arrays[chars].type)
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("random"),
    )
