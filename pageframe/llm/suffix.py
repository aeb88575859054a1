"""Suffix-array dedup on bytes by induced sorting with queues that spill to disk.

Candidate contexts reach the shards through ``passages``. A shard's contexts, each ended by
a separator of its own, are sorted by induction: suffixes are classed as L or S, the
leftmost S substrings are sorted by a first induction and named, equal names are resolved one
level down on the string of names, and a second induction sorts all suffixes from them. Within
a bucket (a first byte), induced suffixes arrive in their final order, so the priority queue
of the external algorithm is a first-in first-out queue per bucket; blocks of a queue beyond
the memory bound are written to a scratch file in the folder given. A bucket is induced in
rounds of whole numpy blocks, not suffix by suffix.

Common prefixes are only needed against the window length: adjacent suffixes' windows are
compared byte by byte in blocks, which costs less here than carrying their exact lengths.

Defined results (``deduplicate``): a null text is empty; texts shorter than the window lose
nothing; rows that repeat an id are not earlier than each other, so they lose nothing to each
other; null ids come last; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _text, passages

WINDOW, GRAM = 50, 20
MEMORY = 64 << 20


class Spill:
    """Blocks of all queues held in memory up to a bound, beyond it in one scratch file."""

    def __init__(self, limit: int = MEMORY, folder: str | None = None):
        self.limit, self.folder, self.held, self.file = limit, folder, 0, None

    def keep(self, block: np.ndarray):
        if self.held + block.nbytes <= self.limit or self.folder is None:
            self.held += block.nbytes
            return block
        if self.file is None:
            fd, name = tempfile.mkstemp(dir=self.folder)
            self.file = os.fdopen(fd, "w+b")
            os.unlink(name)  # gone with the task, whatever happens to it
        self.file.seek(0, 2)
        at = self.file.tell()
        block.tofile(self.file)
        return at, len(block), block.dtype

    def take(self, kept) -> np.ndarray:
        if isinstance(kept, np.ndarray):
            self.held -= kept.nbytes
            return kept
        at, n, dtype = kept
        self.file.flush()
        self.file.seek(at)
        return np.fromfile(self.file, dtype, n)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _push(queues: list, spill: Spill, source: np.ndarray, wanted: np.ndarray, cls: np.ndarray) -> None:
    """Append the predecessors of the wanted type to the queues of their buckets, in order."""
    p = source - 1
    p = p[wanted[p] & (p >= 0)]
    if not len(p):
        return
    c = cls[p]
    order = np.argsort(c, kind="stable")
    p, c = p[order], c[order]
    cuts = (np.flatnonzero(c[1:] != c[:-1]) + 1).tolist()
    for lo, hi in zip([0, *cuts], [*cuts, len(p)], strict=True):
        queues[int(c[lo])].append(spill.keep(p[lo:hi]))


def _induce(is_s: np.ndarray, cls: np.ndarray, buckets: int, lms: np.ndarray, ends: np.ndarray, spill: Spill) -> np.ndarray:
    """All suffixes in order, given the leftmost S suffixes in order; ``ends``: separators in order."""
    by_class = cls[lms]
    order = np.argsort(by_class, kind="stable")
    seeds = np.split(lms[order], np.searchsorted(by_class[order], np.arange(1, buckets)))
    seeds[0] = ends
    is_l = ~is_s
    none = np.zeros(0, lms.dtype)
    queues: list = [[] for _ in range(buckets)]
    left = []
    for c in range(buckets):
        rounds = []
        while queues[c]:
            blocks, queues[c] = queues[c], []
            block = np.concatenate([spill.take(x) for x in blocks])
            rounds.append(block)
            _push(queues, spill, block, is_l, cls)
        left.append(spill.keep(np.concatenate(rounds) if rounds else none))
        _push(queues, spill, seeds[c], is_l, cls)
    queues = [[] for _ in range(buckets)]
    out = []
    for c in range(buckets - 1, -1, -1):
        rounds = []
        while queues[c]:
            blocks, queues[c] = queues[c], []
            block = np.concatenate([spill.take(x) for x in blocks])
            rounds.append(block)
            if c:
                _push(queues, spill, block, is_s, cls)
        own = spill.take(left[c])
        out.append(np.concatenate(rounds)[::-1] if rounds and c else none)
        if c == 0:
            out[-1] = ends
        out.append(own)
        _push(queues, spill, own[::-1], is_s, cls)
    return np.concatenate(out[::-1])


def _ordered(names: np.ndarray) -> np.ndarray:
    """Suffix array of dense names, whose suffixes differ, by prefix doubling of those still equal."""
    n, k = len(names), 1
    size = np.bincount(names)
    rank = (np.cumsum(size) - size)[names]
    live = np.flatnonzero(size[names] > 1)
    while len(live):
        then = live + k
        key = rank[live] * (n + 1) + np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        order = np.argsort(key)
        live, key = live[order], key[order]
        old = key // (n + 1)
        group, begin = (np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1)) for x in (old, key))
        many = np.diff(np.append(begin, len(key)))
        rank[live] = old + np.repeat(begin, many) - np.repeat(group, np.diff(np.append(group, len(key))))
        live = live[np.repeat(many > 1, many)]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def induced_sort(data: np.ndarray, at: np.ndarray, spill: Spill | None = None) -> np.ndarray:
    """Suffix array of bytes in which the places ``at`` are separators, the last place one of them.

    Separators are below all bytes, a later one below an earlier one.
    """
    spill = spill or Spill()
    n = len(data)
    place = np.int32 if n < 1 << 31 else np.int64
    at = at.astype(place)
    cls = data.astype(np.int16) + np.int16(1)
    cls[at] = 0
    value = cls.astype(place) + place(len(at))
    value[at] = np.arange(len(at), dtype=place)[::-1]
    nxt = np.arange(n, dtype=place)
    nxt[:-1][value[:-1] == value[1:]] = n - 1
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = value[:-1] < value[1:]
    is_s = smaller[nxt]
    start = np.zeros(n, bool)
    start[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(start).astype(place)
    if not len(lms):
        lms = np.array([n - 1], place)
        start[n - 1] = True
    ends = at[::-1]
    first = _induce(is_s, cls, 257, lms, ends, spill)
    sub = first[start[first]]
    nth = np.cumsum(start, dtype=place) - 1  # of a leftmost S suffix
    order = nth[sub]
    size = np.diff(lms, append=place(n - 1))[order]
    a, b = sub[:-1], sub[1:]
    same = size[:-1] == size[1:]
    live = np.flatnonzero(same)
    for j in range(int(size.max()) + 1):
        live = live[size[live] >= j]
        if not len(live):
            break
        equal = value[a[live] + j] == value[b[live] + j]
        same[live[~equal]] = False
        live = live[equal]
    names = np.empty(len(lms), np.int64)
    names[order] = np.concatenate(([0], np.cumsum(~same)))
    ordered = sub if names.max() == len(names) - 1 else lms[_ordered(names)]
    return _induce(is_s, cls, 257, ordered, ends, spill)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data), "<u8", padded, strides=(1,)).copy()


def judge(pieces: list[int], rows: list, window: int):
    found = passages.Contexts(rows, self_repeats=False)
    sizes = np.array(found.sizes, np.int64)
    data = np.frombuffer(b"\0".join(found.texts) + b"\0", np.uint8)
    at = np.cumsum(sizes + 1) - 1
    spill = Spill(folder=tempfile.gettempdir())  # the executor's own
    try:
        sa = induced_sort(data, at, spill)
    finally:
        spill.close()
    count = sizes - window + 1
    base = np.cumsum(count) - count
    # a place is a window's start, or one of the last window - 1 bytes or the separator
    is_window = np.repeat(np.tile([True, False], len(sizes)), np.column_stack((count, sizes + 1 - count)).ravel())
    sa = sa[is_window[sa]]
    wide = window >= 8
    steps = [*range(window - 8, 0, -8), 0] if wide else range(window)
    part = _eights(data) if wide else data
    new = np.zeros(len(sa), bool)
    new[:1] = True
    for lo in range(1, len(sa), 1 << 16):
        a, b = sa[lo - 1 : lo - 1 + (1 << 16)], sa[lo : lo + (1 << 16)]
        a = a[: len(b)]
        differs = np.zeros(len(b), bool)
        live = np.arange(len(b))
        for j in steps:
            bad = part[a[live] + j] != part[b[live] + j]
            differs[live[bad]] = True
            live = live[~bad]
            if not len(live):
                break
        new[lo : lo + len(b)] = differs
    starts = np.flatnonzero(new)
    least = np.empty(int(count.sum()), np.int64)
    if len(sa):
        nth = np.cumsum(is_window, dtype=sa.dtype) - 1  # the windows in order of their places
        nth = nth[sa]
        low = np.minimum.reduceat(np.repeat(found.doc, count)[nth], starts)
        least[nth] = np.repeat(low, np.diff(np.append(starts, len(sa))))
    yield from passages.answers(found, pieces, least, None, base, window)


_BYTE = _text.mix(np.arange(256, dtype=np.uint64), 41)


def units(data: np.ndarray, offs: np.ndarray):
    place = np.arange(len(data))
    return _BYTE[data], np.repeat(np.arange(len(offs) - 1), np.diff(offs)), place, place + 1


def _finish(ids, data, offs, found, gone):
    removed, spans, digests, kept = [], [], [], []
    for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        own = gone[x:y]
        a, b = _text.runs(own)
        removed.append(int(own.sum()))
        spans.append([{"start": int(u), "end": int(v)} for u, v in zip(a, b, strict=True)])
        raw = data[x:y][~own].tobytes() if len(a) else data[x:y].tobytes()
        kept.append(raw)
        digests.append(hashlib.sha256(raw).hexdigest())
    return pa.array(np.diff(offs), pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(digests), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, bytes, bytes removed, spans removed, hash of the kept bytes, the spans, the kept bytes."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
    return passages.repeats(docs, units, judge, _finish, schema, window, gram, doc_id, text, width=1)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
