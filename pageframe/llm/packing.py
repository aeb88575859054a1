"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised once, in the tasks that read them; a document longer than a
sequence is cut into full pieces and a rest. Only the histogram of piece lengths (at most
``capacity`` rows, whatever the corpus) goes to the driver, where the fractional
bin-packing program "fewest configurations that cover every length's demand" is solved by
multiplicative weights: lengths still badly covered weigh more, and the pricing step, a
knapsack dynamic program over the capacity, returns the configurations of largest weight
(several at a time, on perturbed weights). Rounding prices configurations by the solved weights on
what is left, takes each as often as that allows, and prices again, until at most ``REST`` of the volume (or
``LEAST_LEFT`` sequences' worth) is left. Only that is placed by best fit, first into the gaps that are left, then
into new sequences. All steps run on groups of equal sequences, so their cost depends on the histogram, not on the corpus.

A plan is a list of slot intervals per length: the g-th piece of a length takes the g-th
slot. The rank g is the piece's rank in its own task, counted while tokenising, plus the
counts of earlier tasks, so no key gathers in one task, however many pieces share a length.

Defined results: a null or empty text has only the end id; repeated document rows are
packed each; every row of the table is packed; an empty table gives no rows; columns other
than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from . import _text

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 1_000_000
#: Text bytes that are tokenised together; some hundred bytes of arrays are held for each.
BATCH_BYTES = 512 << 10
# The program: size classes of the weights, configurations per pricing round, rounds, fewest lengths priced
CLASSES, LANES, ROUNDS, LEAST = 64, 16, 24, 96
STEP, NOISE, LAG = 0.1, 0.0005, 0.02
#: Among equally good configurations, rounding prefers long pieces by this much, since short ones fill gaps later.
BIAS = 0.02
#: Of a pricing round the configurations of at least this share of the best value are used.
CLOSE = 0.9998
#: Best fit places what is left when that is below this share of the volume, or below so many sequences' worth.
REST, LEAST_LEFT = 0.02, 12

_READY: dict[str, _Encoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Encoder:
    """Ids of whole texts as ``tokenizers`` gives them, a batch of texts at a time in numpy.

    The tokeniser collapses white space and never joins what it separates, so a text's
    ids are those of its space-separated chunks in order. Chunks of plain characters (ASCII and
    Latin letters, without apostrophes and angle brackets) are cut into runs of letters, single digits and
    runs of other characters, as the tokeniser's pattern cuts them; the byte pairs of all new words of a batch
    are then merged together, from the tokeniser's tables. All other chunks, and long words, go
    through ``tokenizers`` itself. Ids of known words are kept by the 64-bit hash of their bytes.
    """

    LONGEST = 60

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit = limit
        model = json.loads(self.tok.to_str())["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies write other bytes from 256 on
        others = [b for b in range(256) if b not in printable]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.first = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[shown[b] + end] for b in range(256)], np.int64)
        pairs = [(x if isinstance(x, list | tuple) else x.split(" ")) for x in model["merges"]]
        keys = np.array([vocab[x] << 20 | vocab[y] for x, y in pairs], np.int64)
        made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order, made[order]
        self._forget()

    def _forget(self) -> None:
        self.names = np.zeros(0, np.uint64)  # hashes of known words, sorted; where their ids are in the pool, and how many
        self.at, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _pair(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (large if it doesn't merge) and what it makes."""
        key = x << 20 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], 1 << 40), self.made[at]

    def merged(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[s:e], and how many each has: byte pairs merged for all words at once, lowest rank first."""
        size = e - s
        end = np.cumsum(size)
        raw = data[np.repeat(s - (end - size), size) + np.arange(size.sum())]
        sym = self.first[raw]
        sym[end - 1] = self.last[raw[end - 1]]
        word = np.repeat(np.arange(len(s)), size)
        done_sym, done_word = [sym[:0]], [word[:0]]
        rank, made = np.full(len(sym), 1 << 40), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self._pair(sym[inner], sym[inner + 1])
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(start, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, start), sizes)
            over = low >= 1 << 40
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                live = ~over
                sym, word, rank, made, low = sym[live], word[live], rank[live], made[live], low[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]  # the leftmost of each word
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            rank[at] = 1 << 40
            # pairs that changed: the merged symbol with its neighbours
            after = at + 2
            ok = after < len(sym)
            ok[ok] = word[after[ok]] == word[at[ok]]
            rank[at[ok]], made[at[ok]] = self._pair(sym[at[ok]], sym[after[ok]])
            before = at - 1
            ok = before >= 0
            ok[ok] = word[before[ok]] == word[at[ok]]
            rank[before[ok]], made[before[ok]] = self._pair(sym[before[ok]], sym[at[ok]])
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype("<u4"), np.bincount(word, minlength=len(s))

    def _cut(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lowered bytes, and start, end, row and plainness of each word; a chunk that isn't plain is one word."""
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        low[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
        plain = _PLAIN[data] | (after & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)) | (data == 0xC3)
        s, e, row = _text.spans(data, offs, _CHUNK)
        odd = np.concatenate(([0], np.cumsum(~plain)))
        good = odd[e] == odd[s]
        kind = _KIND[low]
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        for x, y in zip(s[~good].tolist(), e[~good].tolist(), strict=True):
            start[x:y] = False
        start[s] = True
        chunk = _CHUNK[data]
        begin = np.flatnonzero(start[:-1] & chunk)
        mine = np.searchsorted(s, begin, side="right") - 1
        stop = np.minimum(np.append(begin[1:], len(data)), e[mine])
        return low, begin, stop, row[mine], good[mine]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, and the n+1 offsets of the texts in them."""
        data, offs = _text.buffer(column)
        rows = len(offs) - 1
        low, s, e, row, plain = self._cut(data, offs) if len(data) else (data, *(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))
        h = _text.hashes(low, s, e)
        h[~plain] = _text.mix(_text.hashes(data, s[~plain], e[~plain]), 61)
        names, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.names) + len(names) > self.limit:
            self._forget()
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        known[at < len(self.names)] = self.names[at[at < len(self.names)]] == names[at < len(self.names)]
        new = np.flatnonzero(~known)
        if len(new):
            w = first[new]
            easy = plain[w] & (e[w] - s[w] <= self.LONGEST)
            ids, size = self.merged(low, s[w[easy]], e[w[easy]])
            sizes = np.zeros(len(new), np.int64)
            starts = np.zeros(len(new), np.int64)
            sizes[easy], starts[easy] = size, np.cumsum(size) - size
            more, filled = [ids], len(ids)
            for i in np.flatnonzero(~easy).tolist():
                raw = (low if plain[w[i]] else data)[s[w[i]] : e[w[i]]].tobytes().decode()
                own = np.array(self.tok.encode(raw, add_special_tokens=False).ids, "<u4")
                more.append(own)
                sizes[i], starts[i] = len(own), filled
                filled += len(own)
            place = at[new]
            self.names = np.insert(self.names, place, names[new])
            self.at = np.insert(self.at, place, starts + len(self.pool))
            self.size = np.insert(self.size, place, sizes)
            self.pool = np.concatenate([self.pool, *more])
            at = np.searchsorted(self.names, names)
        size = self.size[at][inverse]
        end = np.cumsum(size)
        out = self.pool[np.repeat(self.at[at][inverse] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        ends = np.concatenate(([0], end))
        return out, ends[np.searchsorted(row, np.arange(rows + 1))]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, offs = self.encode(pa.array(texts, pa.string()))
        return [ids[x:y].tobytes() for x, y in zip(offs[:-1], offs[1:], strict=True)]


_CHUNK = np.ones(256, bool)
_CHUNK[[32, 10]] = False
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_PLAIN[[ord("'"), ord("<")]] = False  # contractions and special tokens are left to the tokeniser
_KIND = np.full(256, 2, np.int8)
_KIND[97:123] = _KIND[128:] = 0
_KIND[48:58] = 1


def encoder(path: str) -> _Encoder:
    if path not in _READY:
        _READY[path] = _Encoder(path)
    return _READY[path]


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and its task and rank there among its length."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"]] + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("nth", T.LongType()))])

    def run(batches):
        enc = encoder(path or tokenizer_path())
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in _text.pieces(batches, 1, limit=BATCH_BYTES):
            ids, offs = enc.encode(b.column(1))
            total = np.diff(offs) + 1  # with the end id
            count = -(-total // capacity)
            rows = np.repeat(np.arange(b.num_rows), count)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(total[rows] - start, capacity)
            whole = np.insert(ids, offs[1:], end_id).astype("<u4")
            begin = (offs[:-1] + np.arange(b.num_rows))[rows] + start
            raw = memoryview(whole.tobytes())
            crc = [zlib.crc32(raw[x:y]) for x, y in zip((4 * begin).tolist(), (4 * (begin + length)).tolist(), strict=True)]
            # the rank of each piece among its length in this task
            order = np.argsort(length, kind="stable")
            sizes, at, n = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(rows), np.int64)
            nth[order] = np.arange(len(rows)) - np.repeat(at - seen[sizes], n)
            seen[sizes] += n
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(np.full(len(rows), task), pa.int32()), pa.array(nth, pa.int64()),
            ], names=schema.names)

    return source.mapInArrow(run, schema)


def price(values: np.ndarray, lengths: np.ndarray, copies: np.ndarray, capacity: int) -> np.ndarray:
    """Bounded knapsack by dynamic programming, for each row of values: how often each length is taken, (rows, lengths)."""
    lanes = len(values)
    items = []
    for i, (size, most) in enumerate(zip(lengths.tolist(), np.minimum(copies, capacity // lengths).tolist(), strict=True)):
        times = 1
        while most > 0:  # any number up to the most is a sum of these multiples
            n = min(times, most)
            items.append((i, n, n * size))
            most, times = most - n, 2 * times
    best = np.zeros((lanes, capacity + 1), np.float32)
    taken = np.zeros((len(items), lanes, capacity + 1), bool)
    values = values.astype(np.float32)
    for t, (i, n, size) in enumerate(items):
        got = best[:, : capacity + 1 - size] + n * values[:, i, None]
        np.greater(got, best[:, size:], out=taken[t, :, size:])
        np.maximum(best[:, size:], got, out=best[:, size:])
    counts = np.zeros(values.shape, np.int64)
    left = np.full(lanes, capacity)
    every = np.arange(lanes)
    for t in range(len(items) - 1, -1, -1):
        i, n, size = items[t]
        yes = taken[t, every, left]
        counts[yes, i] += n
        left[yes] -= size
    return counts


class Program:
    """The configuration program of a histogram: fewest configurations that cover every length's demand.

    The dual value of a length is its share of the capacity times a factor of its size class,
    which multiplicative weights move: a class that the priced configurations cover beyond
    its demand loses weight, one that they neglect gains. A pricing round takes a random part of the lengths
    (all, where they are few), ``LANES`` times with slightly perturbed values.
    """

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int, seed: int = 0):
        self.lengths, self.demand, self.capacity = lengths, demand, capacity
        self.rng = np.random.default_rng(seed)
        _, self.cls = np.unique(lengths * CLASSES // capacity, return_inverse=True)
        self.of_class = lambda x: np.bincount(self.cls, weights=x)
        self.wanted = self.of_class(demand)
        self.factor = np.ones(len(self.wanted))

    def some(self, left: np.ndarray, volume: float) -> np.ndarray:
        """Random lengths, by how many pieces of them are left, that hold some volume together."""
        there = np.flatnonzero(left)
        if len(there) <= LEAST:
            return there
        weight = left[there] / self.wanted[self.cls[there]]  # classes alike
        order = there[np.argsort(self.rng.exponential(size=len(there)) / weight)]
        enough = int(np.searchsorted(np.cumsum(self.lengths[order] * left[order]), volume)) + 1
        return np.sort(order[: max(LEAST, enough)])

    def round(self, left: np.ndarray, copies: np.ndarray, factor: np.ndarray, noise: float, bias: float = 0.0) -> np.ndarray:
        own = self.some(left, 2.0 * LANES * self.capacity)
        size = self.lengths[own] / self.capacity
        value = size * factor[self.cls[own]] * (1 + bias * size)
        counts = np.zeros((LANES, len(self.lengths)), np.int64)
        counts[:, own] = price(value * np.exp(noise * self.rng.standard_normal((LANES, len(own)))), self.lengths[own], copies[own], self.capacity)
        return counts

    def solve(self, rounds: int = ROUNDS) -> float:
        """Move the weights of the size classes, keep those of the best bound, and return that bound."""
        log, total = np.zeros(len(self.factor)), np.zeros(len(self.factor))
        best = self.bound(), self.factor
        for r in range(1, rounds + 1):
            got = self.round(self.demand, self.demand, np.exp(log), NOISE).sum(0)
            share = self.of_class(got) / self.wanted
            log -= STEP * share / max(share.max(), 1e-12) / np.sqrt(r)
            log -= np.average(log, weights=self.of_class(self.lengths * self.demand))
            total += log
            if r % 8 == 0:
                self.factor = np.exp(total / r)
                best = max(best, (self.bound(), self.factor), key=lambda t: t[0])
        bound, self.factor = best
        return bound

    def bound(self) -> float:
        """A number of sequences no packing is below: the weights' dual value (at first weights, about the volume)."""
        y = self.lengths / self.capacity * self.factor[self.cls]
        # the unbounded program's dual holds for all configurations, with no more of a length than there is
        top = float((price(y[None], self.lengths, self.demand, self.capacity)[0] * y).sum())
        return max(float((self.lengths * self.demand).sum()) / self.capacity, float((y * self.demand).sum()) / max(top, 1e-12) * (1 - 1e-5))

    def rounded(self) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
        """Whole numbers of configurations, priced again on what is left until little is, and that rest."""
        rest, groups = self.demand.copy(), []
        total = float((self.lengths * self.demand).sum())
        while float((self.lengths * rest).sum()) > max(REST * total, LEAST_LEFT * self.capacity):
            left = self.of_class(rest) / self.wanted
            mean = np.average(left, weights=self.of_class(self.lengths * rest) + 1e-12)
            counts = self.round(rest, rest, self.factor * np.exp(LAG * (left - mean)), NOISE, BIAS)
            value = counts @ (self.lengths / self.capacity * self.factor[self.cls])
            for k in np.argsort(-value, kind="stable").tolist():
                if value[k] < CLOSE * value.max():
                    break
                at = np.flatnonzero(counts[k])
                most = int((rest[at] // counts[k, at]).min()) if len(at) else 0
                if most:
                    rest[at] -= most * counts[k, at]
                    groups.append(({int(self.lengths[i]): int(counts[k, i]) for i in at}, most))
        return groups, rest


def best_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int, groups: list[tuple[dict[int, int], int]]) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on groups of equal sequences: ({length: count}, sequences) each."""
    by_gap: dict[int, list] = {}
    gaps: list[int] = []

    def add(pattern: dict[int, int], n: int, gap: int) -> None:
        if gap not in by_gap:
            insort(gaps, gap)
            by_gap[gap] = []
        by_gap[gap].append((pattern, n))

    for pattern, n in groups:
        add(pattern, n, capacity - sum(k * v for k, v in pattern.items()))
    for size, left in sorted(zip(lengths.tolist(), demand.tolist(), strict=True), reverse=True):
        while left:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                per = capacity // size
                add({}, max(1, left // per), capacity)
                continue
            gap = gaps[i]
            pattern, n = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(i)
            per = min(gap // size, left)
            take = min(n, left // per)
            if n > take:
                add(pattern, n - take, gap)
            add({**pattern, size: pattern.get(size, 0) + per}, take, gap - per * size)
            left -= per * take
    return [x for own in by_gap.values() for x in own if x[0]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Groups of equal sequences, ({length: count}, sequences), that hold all pieces."""
    full = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(x for x in histogram if x < capacity and histogram[x]), np.int64)
    if not len(lengths):
        return full
    demand = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    program = Program(lengths, demand, capacity)
    program.solve()
    groups, rest = program.rounded()
    return full + best_fit(lengths, rest, capacity, groups)


def slots(groups: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Slot intervals sorted by (length, first rank): where the g-th piece of a length goes."""
    base = np.zeros(capacity + 1, np.int64)
    rows, first = [], 0
    for pattern, n in groups:
        offset = 0
        for size in sorted(pattern, reverse=True):
            per = pattern[size]
            rows.append((size, base[size], per, first, offset))
            base[size] += n * per
            offset += size * per
        first += n
    rows.sort()
    names = ("length", "base", "per", "sequence", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def place(length: np.ndarray, rank: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these ranks among their length."""
    lo, hi = np.searchsorted(table["length"], length), np.searchsorted(table["length"], length, side="right")
    while (wide := hi - lo > 1).any():
        mid = (lo + hi) // 2
        right = wide & (table["base"][np.minimum(mid, len(table["base"]) - 1)] <= rank)
        lo, hi = np.where(right, mid, lo), np.where(wide & ~right, mid, hi)
    local = rank - table["base"][lo]
    per = table["per"][lo]
    return table["sequence"][lo] + local // per, table["offset"][lo] + local % per * length


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All documents in sequences of at most ``capacity`` ids: one row per piece with its place."""
    spark = docs.sparkSession
    cut = _text.stored(pieces_of(docs, path, capacity, end_id), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    ranked = cut.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth")).select(names)
    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for b in batches:
            seq, off = place(b.column(3).to_numpy(), b.column(5).to_numpy(), table.value) if b.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=schema.names)

    return ranked.mapInArrow(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
