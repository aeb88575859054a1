"""Substring dedup on words with a compressed FM-index per shard.

Candidate contexts reach the shards through ``passages``. A shard numbers its words, builds
the suffix array of its contexts (prefix doubling; each context ends in a separator of its own),
takes the Burrows-Wheeler transform, stores it in a wavelet matrix of packed bits with
block counts, and keeps of the suffix array every ``SAMPLE``-th place only. All contexts are then streamed through it
from their ends, side by side: backward search extends each one's match by a word, and where
the longer match would occur once only, words at its end are dropped until its interval grows. This
gives the matching statistics, the length of the longest repeated match at each place; where
that is ``window`` or more, the window there repeats. Its interval is widened to all suffixes that begin with the
window, these are located through the sampled places, and the least (document, start) is the one that stays.

Defined results (``deduplicate``): a word is a run without ASCII white space, unchanged; a null or empty
text has no words; of rows that repeat an id none counts as earlier than the others at the same
place, while a later start does lose to an earlier one; null ids come last; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _text, passages

WINDOW, GRAM = 20, 8
#: Every so many places of a context keep their place in the index.
SAMPLE = 4

_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Prefix doubling; the suffixes of ``t`` must differ (its last symbol occurs once)."""
    _, rank = np.unique(t, return_inverse=True)
    n, k = len(t), 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        key = rank.astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.ones(n, np.int64)
        new[1:] = s[1:] != s[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class Bits:
    """Packed bits with counts per 64, for rank queries."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-len(bits) // 64) * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w, o = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << o) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        """The bit at i."""
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """Counts, wavelet matrix of the transform, sampled places and common-prefix lengths; backward search of many patterns at once."""

    def __init__(self, t: np.ndarray, separators: int, sampled: np.ndarray):
        """``t``: separators are 0 .. separators - 1, each once, the last symbol is 0. ``sampled``: places whose suffixes
        keep their place; a place after a separator must be one."""
        sa = suffix_array(t)
        word = np.maximum(t - separators + 1, 0)  # all separators are symbol 0 from here on
        self.size = len(t)
        self.sigma = int(word.max()) + 1
        bwt = word[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=self.sigma))))
        self.depth = max(1, (self.sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (bwt >> level & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        self.base = np.zeros(self.sigma, np.int64)
        self.base = self._descend(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        kept = sampled[sa]
        self.marks, self.places = Bits(kept.astype(np.uint8)), sa[kept].astype(np.int32)
        # length of the common prefix of each suffix and the one before it; -1 at both ends
        lcp = np.zeros(len(t) + 1, np.int32)
        live, j = np.arange(1, len(t)), 0
        while len(live):
            live = live[t[sa[live - 1] + j] == t[sa[live] + j]]  # separators differ, so no comparison passes one
            lcp[live] += 1
            j += 1
        lcp[0] = lcp[-1] = -1
        self.lows = [lcp]  # minima of 1, 2, 4 ... lengths from each place on
        while (step := 1 << (len(self.lows) - 1)) * 2 <= len(lcp):
            self.lows.append(np.minimum(self.lows[-1][:-step], self.lows[-1][step:]))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros, strict=True):
            ones = bits.rank(i)
            i = np.where(c >> level & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c in the transform before i."""
        return self._descend(c, i) - self.base[c]

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c followed by what the intervals stand for."""
        return self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)

    def before(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one place earlier (which is no separator)."""
        c, i = np.zeros(len(row), np.int64), row
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.at(i), bits.rank(i)
            c = c << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return self.first[c] + i - self.base[c]

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places of the suffixes of the rows: back to the nearest sampled place."""
        out, row, open_ = np.zeros(len(row), np.int64), row.copy(), np.arange(len(row))
        steps = 0
        while len(open_):
            done = self.marks.at(row[open_])
            out[open_[done]] = self.places[self.marks.rank(row[open_[done]])] + steps
            open_ = open_[~done]
            row[open_] = self.before(row[open_])
            steps += 1
        return out

    def widened(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals around [lo, hi) in which all suffixes share a prefix of that length."""
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self.lows) - 1, -1, -1):
            step, low = 1 << k, self.lows[k]
            back = lo - step + 1
            ok = (back >= 0) & (low[np.maximum(back, 0)] >= depth)
            lo[ok] -= step
            ok = (hi + step <= self.size + 1) & (low[np.minimum(hi, len(low) - 1)] >= depth)
            hi[ok] += step
        return lo, hi

    def matching(self, words: np.ndarray, begin: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of documents words[begin : begin + size], all streamed side by side from their ends.

        At each place the longest match that begins there and occurs at least twice in the index. Returns the places
        where that has ``least`` words or more: document, place in it, length, and the match's interval.
        """
        n = len(begin)
        lo, hi, length = np.zeros(n, np.int64), np.full(n, self.size), np.zeros(n, np.int64)
        out = []
        for k in range(int(sizes.max()) if n else 0):
            live = np.flatnonzero(sizes > k)
            i = sizes - 1 - k
            todo = live
            while len(todo):
                a, b = self.step(words[begin[todo] + i[todo]], lo[todo], hi[todo])
                good = b - a > 1
                at = todo[good]
                lo[at], hi[at] = a[good], b[good]
                length[at] += 1
                todo = todo[~good]
                todo = todo[length[todo] > 0]  # a word that occurs once matches nothing
                # drop words at the match's end until its interval grows
                shorter = np.maximum(self.lows[0][lo[todo]], self.lows[0][hi[todo]]).astype(np.int64)
                lo[todo], hi[todo] = self.widened(lo[todo], hi[todo], shorter)
                length[todo] = np.maximum(shorter, 0)
            once = live[(length[live] == 0)]
            lo[once], hi[once] = 0, self.size
            found = live[length[live] >= least]
            out.append((found, i[found], length[found], lo[found], hi[found]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


def judge(pieces: list[int], rows: list, window: int):
    found = passages.Contexts(rows, self_repeats=True)
    m = len(found.texts)
    vocab: dict[bytes, int] = {}
    ids: list[int] = []
    sizes = np.array(found.sizes)
    for text in found.texts:
        ids += [vocab.setdefault(w, len(vocab)) for w in text.split()]
        ids.append(-1)
    t = np.array(ids, np.int64) + m
    at = np.cumsum(sizes + 1) - 1
    t[at] = np.arange(m)[::-1]
    begin = at - sizes
    inner = np.arange(len(t)) - np.repeat(begin, sizes + 1)
    index = FMIndex(t, m, inner % SAMPLE == 0)
    count = sizes - window + 1
    base = np.cumsum(count) - count
    which = np.repeat(np.arange(m), count)
    least_doc = found.doc[which]
    least_start = found.start[which] + np.arange(len(which)) - base[which]
    context, place, _, lo, hi = index.matching(np.maximum(t - m + 1, 0), begin, sizes, window)
    if len(context):
        # all suffixes that begin with the window, and the least place among them
        lo, hi = index.widened(lo, hi, np.full(len(lo), window))
        lows, inverse = np.unique(lo, return_inverse=True)
        size = np.zeros(len(lows), np.int64)
        size[inverse] = hi - lo
        first = np.cumsum(size) - size
        spot = index.locate(np.repeat(lows - first, size) + np.arange(size.sum()))
        of = np.searchsorted(at, spot)
        doc, where = found.doc[of], found.start[of] + spot - begin[of]
        order = np.lexsort((where, doc))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        best = order[np.minimum.reduceat(rank, first)][inverse]
        least_doc[base[context] + place], least_start[base[context] + place] = doc[best], where[best]
    yield from passages.answers(found, pieces, least_doc, least_start, base, window)


def units(data: np.ndarray, offs: np.ndarray):
    s, e, row = _text.spans(data, offs, _WORD)
    return _text.hashes(data, s, e), row, s, e


def _finish(ids, data, offs, found, gone):
    _, row, s, e = found
    n = len(ids)
    first = _text.starts_of(row, n)
    whole = data.tobytes()
    text, spans = [], []
    for i in range(n):
        kept = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
        text.append(b" ".join([whole[x:y] for x, y in zip(s[kept].tolist(), e[kept].tolist(), strict=True)]).decode())
        a, b = _text.runs(gone[first[i] : first[i + 1]])
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
    removed = np.bincount(row[gone], minlength=n)
    return pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text]), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(text)


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, words, words removed, hash of the kept words, removed word spans, kept text."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept string"
    return passages.repeats(docs, units, judge, _finish, schema, window, gram, doc_id, text)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS x FROM d WHERE len(w) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS gone FROM s),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE gone),
g AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM p GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda y, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
