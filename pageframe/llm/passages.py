"""Shared frame of the exact-repeat operators: find candidate windows, judge them in shards.

A repeat is a window of W units (words or bytes) that occurs twice. Texts are packed into
pieces of a few megabytes, compressed, in a table of the shared folder. Then:

1. Each piece winnows its windows: the gram of least hash in each window is the window's
   anchor, so equal windows have equal anchors wherever they are. A piece sends each anchor
   hash once to the hash's bucket.
2. A bucket tells each piece which of its anchors another piece has too.
3. Pieces send the windows around anchors that occur twice (contexts) to the anchor's shard,
   equal contexts of a piece once, with the places where they stand. All windows with that
   anchor meet in one shard, so a shard's index decides them exactly. An anchor with more
   contexts than a shard holds is split: its windows are sent one by one, each to the shard
   of the hash of the whole window, where equal windows still meet.
4. The shard returns the windows to remove, and each piece removes them.

Nothing is sampled or dropped: windows whose anchor occurs once in the corpus can't repeat.
Bucket and shard counts follow the corpus size, so that a task's memory does not. A key
shared by many documents costs at most one entry per piece and distinct context.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from . import _text

BUCKET_BYTES = 8 << 20
SHARD_BYTES = 3 << 20
BLOCK = 1 << 16  # windows whose hashes are made at once, in the processor's cache
NO_ID = np.iinfo(np.int64).max

PACKED = "piece long, ids binary, offs binary, blob binary, bytes long"


def packed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Pieces of documents: ids (null as the largest), offsets and the zstd-compressed texts."""
    from pyspark import TaskContext

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3)
        for b in _text.pieces(batches, 1):
            data, offs = _text.buffer(b.column(1))
            ids = b.column(0).fill_null(NO_ID).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([offs.astype("<i8").tobytes()], pa.binary()), pa.array([pack.compress(data.tobytes())], pa.binary()), pa.array([len(data)])], names=["piece", "ids", "offs", "blob", "bytes"])
            at += 1

    return source.mapInArrow(run, PACKED)


def _open(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    piece, ids, offs, blob = (batch.column(k)[i].as_py() for k in range(4))
    data = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return piece, np.frombuffer(ids, "<i8"), np.frombuffer(offs, "<i8"), data


def argmin_windows(h: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost least value of each w consecutive ones, which are below 2^32."""
    key = (h << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < w:
        key = np.minimum(key[: len(key) - (w - size)], key[w - size :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def gram_hashes(unit: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram consecutive units: a polynomial of the units, by doubling, then mixed."""
    factor, h, size, have = 0x9E3779B97F4A7C15, unit, 1, {1: unit}
    power = lambda k: np.uint64(pow(factor, k, 1 << 64))
    with np.errstate(over="ignore"):
        while size * 2 <= gram:
            h = h[:-size] * power(size) + h[size:]
            size *= 2
            have[size] = h
        rest, at = gram - size, size
        while rest:
            part = 1 << (rest.bit_length() - 1)
            m = len(unit) - at - part + 1
            h = h[:m] * power(part) + have[part][at : at + m]
            at, rest = at + part, rest - part
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def anchors(unit: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor and the first and last start of the windows it stands for."""
    n = len(unit)
    empty = np.zeros(0, np.int64)
    found, starts, before = [empty.astype(np.uint64)], [empty], [empty]
    lately = -1, -1  # the last window's anchor and start
    for lo in range(0, n - window + 1, BLOCK):
        some = unit[lo : lo + BLOCK + window - 1]
        s = np.flatnonzero(row[lo : lo + len(some) - window + 1] == row[lo + window - 1 : lo + len(some)])
        if not len(s):
            continue
        h = gram_hashes(some, gram)
        p = argmin_windows(h >> np.uint64(32), window - gram + 1)[s]
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
        new[0] = lately != (p[0] + lo, s[0] + lo - 1)
        first = np.flatnonzero(new)
        found.append(h[p[first]])
        starts.append(s[first] + lo)
        before.append(np.where(first > 0, s[first - 1] + lo, lately[1]))
        lately = p[-1] + lo, s[-1] + lo
    first = np.concatenate(starts)
    return np.concatenate(found), first, np.append(np.concatenate(before)[1:], lately[1])[: len(first)]


def window_hashes(unit: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Hash of the whole window at each start."""
    h = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + unit[start + j]
    return _text.mix(h, 51)


def variety(unit: np.ndarray, first: np.ndarray, last: np.ndarray, group: np.ndarray, times: np.ndarray, window: int) -> np.ndarray:
    """Per group of anchors the distinct contexts, as the power of two at or above their number."""
    at = np.flatnonzero(times[group] > 1)
    with np.errstate(over="ignore"):  # the first and the last window cover the context
        h = window_hashes(unit, first[at], window) + _text.mix(window_hashes(unit, last[at], window), 52)
    order = np.lexsort((h, group[at]))
    g, h = group[at][order], h[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
    return np.ceil(np.log2(np.maximum(np.bincount(g[new], minlength=len(times)), 1))).astype(np.uint8)


def dealt(unit: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray, parts: np.ndarray, window: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards of the contexts and the first and last starts of their windows.

    ``parts`` is the power of two of the parts of the anchor. A context of a split anchor is
    sent as its windows, the part by the hash of the whole window, to shards of their own;
    there are more of these, since a byte is in many windows.
    """
    split = parts > 0
    whole = ~split
    n = (last - first + 1)[split]
    start = np.repeat(first[split] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    with np.errstate(over="ignore"):
        part = window_hashes(unit, start, window) & ((np.uint64(1) << np.repeat(parts[split], n).astype(np.uint64)) - np.uint64(1))
        key = _text.mix(np.repeat(h[split], n) + _text.mix(part, 53), 32)
    shard = (_text.mix(h[whole], 31) % np.uint64(shards)).astype(np.int64), (key % np.uint64(shards * window)).astype(np.int64) + shards
    return tuple(np.concatenate(x) for x in (shard, (first[whole], start), (last[whole], start)))


class Frame:
    """Counts of buckets and shards for a corpus of that many bytes."""

    def __init__(self, total: int, window: int, width: int):
        room = SHARD_BYTES if width > 1 else SHARD_BYTES // 3  # an index of bytes has arrays of a place for each byte
        self.most = max(1, room // (window * width))  # contexts of an anchor, or windows, in one shard
        self.bits = max(4, int(total // BUCKET_BYTES).bit_length())
        self.shards = max(8, int(total // room))
        # an anchor stands for some 16 bytes; 12 bits more than their number keep chance hits rare
        narrow = total.bit_length() - 4 + 12 - self.bits <= 32
        self.dtype = "<u4" if narrow else "<u8"

    def keys(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = h << np.uint64(self.bits)
        return bucket, (rest >> np.uint64(32)).astype("<u4") if self.dtype == "<u4" else rest.astype("<u8")

    def unique(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets and stored hashes of the distinct anchors, in order; how often; inverse."""
        bucket, rest = self.keys(h)
        order = np.lexsort((rest, bucket))
        b, r = bucket[order], rest[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1])
        group = np.cumsum(new) - 1
        inverse = np.empty(len(h), np.int64)
        inverse[order] = group
        return b[new], r[new], np.bincount(group) if len(group) else group, inverse


def repeats(docs: DataFrame, units: Callable, judge: Callable, finish: Callable, schema: str, window: int, gram: int, doc_id: str = "doc_id", text: str = "text", width: int = 8) -> DataFrame:
    """``units(data, offs)`` gives unit hashes, rows, byte starts and ends; ``judge(contexts)``
    decides a shard; ``finish(ids, data, offs, units, removed)`` makes a piece's rows; a unit
    has some ``width`` bytes."""
    spark = docs.sparkSession
    pieces = _text.stored(packed(docs, doc_id, text), "pieces")
    total = pieces.agg(F.sum("bytes")).first()[0] or 0
    frame = Frame(total, window, width)
    body = pieces.select("piece", "ids", "offs", "blob")

    def send(batches):
        for b in batches:
            for i in range(b.num_rows):
                piece, _, offs, data = _open(b, i)
                unit, row, _, _ = units(data, offs)
                h, first, last = anchors(unit, row, window, gram)
                bucket, rest, times, inverse = frame.unique(h)
                many = variety(unit, first, last, inverse, times, window)
                names, begin = np.unique(bucket, return_index=True)
                cuts = np.append(begin, len(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.full(len(names), piece), pa.int64()), *(pa.array([z[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for z in (rest, many))], names=["bucket", "piece", "hashes", "many"])

    def count(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, frame.dtype) for x in table.column("hashes").to_pylist()]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        s = every[order]
        same = np.zeros(len(s), bool)
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        live = np.empty(len(s), bool)
        live[order] = same
        new = np.ones(len(s), bool)
        new[1:] = ~eq
        contexts = np.exp2(np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8)[order].astype(float))
        contexts = np.add.reduceat(contexts, np.flatnonzero(new))
        split = np.empty(len(s), np.uint8)
        split[order] = np.where(contexts > frame.most, np.ceil(np.log2(contexts * (window - gram + 1) / frame.most)), 0)[np.cumsum(new) - 1]
        cuts = np.cumsum([0, *map(len, parts)])
        each = lambda f: pa.array([f(slice(x, y)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        return pa.table({"piece": table.column("piece"), "bucket": table.column("bucket"), "bits": each(lambda k: np.packbits(live[k]).tobytes()), "split": each(lambda k: split[k].tobytes() if split[k].any() else b"")})

    bits = body.mapInArrow(send, "bucket long, piece long, hashes binary, many binary").groupBy("bucket").applyInArrow(count, "piece long, bucket long, bits binary, split binary")
    flags = bits.groupBy("piece").agg(F.collect_list(F.struct("bucket", "bits", "split")).alias("flags"))

    def contexts(batches):
        for b in batches:
            for i in range(b.num_rows):
                piece, ids, offs, data = _open(b, i)
                unit, row, s, e = units(data, offs)
                h, first, last = anchors(unit, row, window, gram)
                if not len(h):
                    continue
                bucket, rest, times, inverse = frame.unique(h)
                live, split = times > 1, np.zeros(len(times), np.uint8)
                start = dict(zip(*(x.tolist() for x in np.unique(bucket, return_index=True)), strict=True))
                for f in b.column(4)[i].as_py() or ():
                    at = start[f["bucket"]]
                    got = np.unpackbits(np.frombuffer(f["bits"], np.uint8)).astype(bool)
                    size = min(len(got), len(live) - at)
                    live[at : at + size] |= got[:size] & (bucket[at : at + size] == f["bucket"])
                    split[at : at + len(f["split"])] = np.frombuffer(f["split"], np.uint8)
                kept = live[inverse]
                shard, first, last = dealt(unit, h[kept], first[kept], last[kept], split[inverse][kept], window, frame.shards)
                yield from _contexts(piece, ids, data, row, s, e, shard, first, last, window, first_unit=_text.starts_of(row, len(ids)))

    sent = body.join(flags, "piece", "left").mapInArrow(contexts, "shard long, piece long, texts binary, sizes binary, refs binary")

    def decide(table: pa.Table) -> pa.Table:
        piece, out = [], []
        for p, blob in judge(table.column("piece").to_pylist(), [tuple(x) for x in zip(*(table.column(c).to_pylist() for c in ("texts", "sizes", "refs")), strict=True)], window):
            piece.append(p)
            out.append(blob)
        _text.release()
        return pa.table({"piece": pa.array(piece, pa.int64()), "windows": pa.array(out, pa.binary())})

    judged = sent.groupBy("shard").applyInArrow(decide, "piece long, windows binary")
    removed = judged.groupBy("piece").agg(F.collect_list("windows").alias("windows"))
    fields = T._parse_datatype_string(schema).fieldNames()

    def last(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, ids, offs, data = _open(b, i)
                found = units(data, offs)
                blobs = b.column(4)[i].as_py() or []
                w = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 3).astype(np.int64)  # document in the piece, start, windows
                at = _text.starts_of(found[1], len(ids))[w[:, 0]] + w[:, 1]
                gone = _text.merge_cover(at, w[:, 2] + window - 1, len(found[0])) if len(at) else np.zeros(len(found[0]), bool)
                rows = finish(ids, data, offs, found, gone)
                yield pa.RecordBatch.from_arrays([pa.array([None if x == NO_ID else x for x in ids.tolist()], pa.int64()), *(pa.array(x) for x in rows)], names=fields)

    return body.join(removed, "piece", "left").mapInArrow(last, schema)


_REF = {"context": "<u4", "nth": "<u4", "start": "<u4", "doc": "<i8"}
_ROW = np.dtype(list(_REF.items()))
#: A blob of refs begins with a zstd frame's first byte, or with this one where it holds plain rows; few refs do not compress.
_PLAIN, FEW = b"\0", 32
_PACK, _UNPACK = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _squeezed(refs: dict[str, np.ndarray]) -> bytes:
    """Columns of differences, which compress well."""
    return _PACK.compress(b"".join(np.diff(refs[k].astype(t), prepend=np.zeros(1, t)).tobytes() for k, t in _REF.items()))


def _spread(blob: bytes) -> np.ndarray:
    if blob[:1] == _PLAIN:
        return np.frombuffer(blob, _ROW, offset=1)
    raw = _UNPACK.decompress(blob)
    n, at = len(raw) // _ROW.itemsize, 0
    out = np.empty(n, _ROW)
    for k, t in _REF.items():
        size = n * np.dtype(t).itemsize
        out[k] = np.cumsum(np.frombuffer(raw[at : at + size], t), dtype=t)
        at += size
    return out


def _contexts(piece, ids, data, row, s, e, shard, first, last, window, first_unit):
    """A piece's live contexts, equal ones once, by shard."""
    at = np.argsort(shard, kind="stable")
    shard = shard[at]
    x, y = s[first[at]].tolist(), e[last[at] + window - 1].tolist()
    size = (last[at] - first[at] + window).tolist()
    refs = np.empty(len(at), _ROW)
    refs["nth"] = row[first[at]]
    refs["start"] = first[at] - first_unit[refs["nth"]]
    refs["doc"] = ids[refs["nth"]]
    whole = data.tobytes()
    names, cut = np.unique(shard, return_index=True)
    cut = np.append(cut, len(shard)).tolist()
    of, texts, sizes = [], [], []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        seen: dict[bytes, int] = {}
        units = []
        for k in range(lo, hi):
            t = whole[x[k] : y[k]]
            c = seen.setdefault(t, len(seen))
            if c == len(units):
                units.append(size[k])
            of.append(c)
        texts.append(_PACK.compress(b"".join(seen)))
        sizes.append(struct.pack(f"<{2 * len(seen)}I", *map(len, seen), *units))
    refs["context"] = of
    plain = refs.tobytes()
    blobs = [_PLAIN + plain[lo * _ROW.itemsize : hi * _ROW.itemsize] if hi - lo < FEW else _squeezed(refs[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
    if len(names):
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.full(len(names), piece), pa.int64()), *(pa.array(c, pa.binary()) for c in (texts, sizes, blobs))], names=["shard", "piece", "texts", "sizes", "refs"])


class Contexts:
    """A shard's distinct contexts with, for each, the least (document, start) that has it.

    ``refs`` are the places of all rows, ``of`` their contexts, ``rows`` where each row's places begin.
    """

    def __init__(self, rows: list[tuple[bytes, bytes, bytes]], self_repeats: bool):
        seen: dict[bytes, int] = {}
        self.sizes: list[int] = []
        own: list[int] = []
        begin, refs = [], []
        for texts, sizes, ref in rows:
            n = len(sizes) // 8
            both = struct.unpack(f"<{2 * n}I", sizes)
            texts = _UNPACK.decompress(texts)
            begin.append(len(own))
            at = 0
            for k in range(n):
                t = texts[at : at + both[k]]
                at += both[k]
                c = seen.setdefault(t, len(seen))
                if c == len(self.sizes):
                    self.sizes.append(both[n + k])
                own.append(c)
            refs.append(_spread(ref))
        self.texts = list(seen)
        self.refs = np.concatenate(refs)
        sizes = [len(r) for r in refs]
        self.rows = np.cumsum([0, *sizes])
        self.of = of = np.array(own, np.int64)[np.repeat(begin, sizes) + self.refs["context"]]
        doc, start = (np.ascontiguousarray(self.refs[k]) for k in ("doc", "start"))
        order = np.lexsort((start if self_repeats else np.zeros(len(of)), doc, of))
        firsts = np.searchsorted(of[order], np.arange(len(seen)))
        self.doc, self.start = doc[order][firsts], start[order][firsts].astype(np.int64)


def answers(found: Contexts, pieces: list[int], least_doc: np.ndarray, least_start: np.ndarray | None, base: np.ndarray, window: int, most: int = 1 << 20):
    """Per piece the runs of windows that occur earlier: document, first start, windows.

    ``least_doc`` and ``least_start`` are, per window of the distinct contexts (those of
    context c from ``base[c]`` on), the least place that has the window. Rows are taken
    together up to ``most`` windows.
    """
    count = np.array(found.sizes) - window + 1
    done = np.concatenate(([0], np.cumsum(count[found.of])))[found.rows]
    i = 0
    while i < len(pieces):
        j = max(i + 1, int(np.searchsorted(done, done[i] + most, side="right")) - 1)
        lo, hi = found.rows[i], found.rows[j]
        refs, of = found.refs[lo:hi], found.of[lo:hi]
        n = count[of]
        ref = np.repeat(np.arange(len(of)), n)
        inner = np.arange(len(ref)) - np.repeat(np.cumsum(n) - n, n)
        at = base[of][ref] + inner
        doc, start = refs["doc"][ref], refs["start"][ref].astype(np.int64) + inner
        gone = least_doc[at] < doc
        if least_start is not None:
            gone |= (least_doc[at] == doc) & (least_start[at] < start)
        if gone.any():
            first, last = gone.copy(), gone.copy()
            first[1:] &= ~gone[:-1] | (ref[1:] != ref[:-1])
            last[:-1] &= ~gone[1:] | (ref[1:] != ref[:-1])
            a, b = np.flatnonzero(first), np.flatnonzero(last)
            runs = np.column_stack([refs["nth"][ref[a]], start[a], b - a + 1]).astype("<u4")
            cut = np.searchsorted(ref[a], found.rows[i : j + 1] - lo).tolist()
            for piece, x, y in zip(pieces[i:j], cut[:-1], cut[1:], strict=True):
                if y > x:
                    yield piece, runs[x:y].tobytes()
        i = j
