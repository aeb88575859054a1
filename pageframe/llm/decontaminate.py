"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the normalised words of all items (A-Z lowered, words are runs
of letters a-z, digits and non-ASCII characters). Training words are streamed through it;
at each word the length of the longest suffix that occurs in an item is known, so every
window of an item that ends there is found, whatever item it is from.

Words that occur in no item reset the automaton, so only runs of item words that are long
enough for a window are streamed at all; the others are skipped by a hash of each word
(no false negatives; the words of a run are compared by their bytes).

The items are a test set and far smaller than the corpus. Their size is checked
(``max_item_words``); beyond it the items are taken in shards of that size, one automaton and one pass over the
documents each, and the results are united. One automaton at a time is made and broadcast.

Defined results: null and empty texts have no words and no hits; an item without words is
ignored; an item of fewer words than ``window`` is one window; repeated items all count;
repeated document rows each give a row; other columns are left out (``matches``) or kept
(``decontaminate``), whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _text

WINDOW = 10
MAX_ITEM_WORDS = 500_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = np.frombuffer(_TABLE, np.uint8)
_WORD = _LOWER != 32


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        seqs = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for item, ws in items if ws]
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._add(last, c)
        n = len(self.next)
        order = sorted(range(1, n), key=self.len.__getitem__)
        self.full = [-1] * n  # the ancestor that holds the suffix of `window` words
        for v in order:
            if self.len[v] >= window:
                up = self.link[v]
                self.full[v] = self.full[up] if self.len[up] >= window else v
        owners: dict[int, set] = {}
        short: dict[int, list] = {}
        for item, seq in seqs:
            v = 0
            for i, c in enumerate(seq):
                v = self.next[v][c]
                if i + 1 >= window:
                    while self.len[self.link[v]] >= window:
                        v = self.link[v]
                    owners.setdefault(v, set()).add(item)
            if len(seq) < window:
                short.setdefault(v, []).append((len(seq), item))
        self.owners = owners
        self.short: dict[int, list] = {}
        if short:
            for v in order:
                found = short.get(v, []) + self.short.get(self.link[v], [])
                if found:
                    self.short[v] = found
        self.least = min((min(len(s), window) for _, s in seqs), default=window)
        known = [np.frombuffer(w, np.uint8) for w in self.vocab]
        size = np.array([len(w) for w in known], np.int64)
        end = np.cumsum(size)
        data = np.concatenate(known) if known else np.zeros(0, np.uint8)
        self.hashes = np.sort(_text.hashes(data, end - size, end))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def _add(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def known(self, h: np.ndarray) -> np.ndarray:
        """Which word hashes are those of item words."""
        out = self.bits[(h >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        i = np.searchsorted(self.hashes, h[at])
        out[at] = self.hashes[np.minimum(i, len(self.hashes) - 1)] == h[at]
        return out

    def stream(self, seq: Iterable[bytes]) -> Iterator[tuple[int, int, int, list]]:
        """(start, end, longest match ending there, items) of each window that occurs."""
        nxt, link, length, vocab, window = self.next, self.link, self.len, self.vocab, self.window
        v = size = 0
        for i, w in enumerate(seq):
            c = vocab.get(w)
            if c is None:
                v = size = 0
                continue
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
            else:
                size = 0
            if size >= window:
                yield i + 1 - window, i + 1, size, self.owners[self.full[v]]
            for m, item in self.short.get(v, ()):
                if m <= size:
                    yield i + 1 - m, i + 1, size, (item,)


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("longest", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("words", T.LongType())]))),
])


class Words:
    """The normalised words of a column of texts: byte places, rows and hashes."""

    def __init__(self, column: pa.Array):
        data, self.offs = _text.buffer(column)
        self.rows = len(self.offs) - 1
        self.data = _LOWER[data]
        self.s, self.e, self.row = _text.spans(self.data, self.offs, _WORD_LOWERED)
        self.first = _text.starts_of(self.row, self.rows)
        self.h = _text.hashes(self.data, self.s, self.e)


#: Of a text: longest match, items, runs of hit words.
State = tuple[int, list, list]


def advance(w: Words, a: Automaton, state: list[State | None]) -> None:
    """Add to each text's state what one automaton finds."""
    if not len(a.hashes) or not len(w.s):
        return
    hits: dict[int, list] = {}
    inside = a.known(w.h)
    # runs of item words within one row
    new_row = np.flatnonzero(np.diff(w.row)) + 1
    lo, hi = _text.runs(inside)
    for x, y in zip(lo[hi - lo >= a.least].tolist(), hi[hi - lo >= a.least].tolist(), strict=True):
        cuts = new_row[np.searchsorted(new_row, x, "right") : np.searchsorted(new_row, y, "left")].tolist()
        for p, q in zip([x, *cuts], [*cuts, y], strict=True):
            if q - p >= a.least:
                seq = [w.data[w.s[k] : w.e[k]].tobytes() for k in range(p, q)]
                r = int(w.row[p])
                for u, v, size, items in a.stream(seq):
                    hits.setdefault(r, []).append((p + u - int(w.first[r]), p + v - int(w.first[r]), size, items))
    for r, found in hits.items():
        longest, items, runs = state[r] or (0, [], [])
        mask = np.zeros(int(w.first[r + 1] - w.first[r]), bool)
        for u, v in [*runs, *((u, v) for u, v, _, _ in found)]:
            mask[u:v] = True
        names = set(items).union(*(n for *_, n in found))
        starts, ends = _text.runs(mask)
        state[r] = max(longest, *(size for _, _, size, _ in found)), sorted(names, key=lambda x: (x is None, x or "")), list(zip(starts.tolist(), ends.tolist(), strict=True))


def told(w: Words, state: list[State | None]) -> Iterator[tuple[int, int, int, list, list]]:
    """For each text: words, words hit, longest match, items, hit byte spans (start, end, words)."""
    for r in range(w.rows):
        first, n = int(w.first[r]), int(w.first[r + 1] - w.first[r])
        longest, items, runs = state[r] or (0, [], [])
        spans = [(int(w.s[first + x] - w.offs[r]), int(w.e[first + y - 1] - w.offs[r]), y - x) for x, y in runs]
        yield n, sum(y - x for x, y in runs), longest, items, spans


def scan(column: pa.Array, automata: Iterable[Automaton]) -> Iterator[tuple[int, int, int, list, list]]:
    """``told`` of a column after all automata."""
    w = Words(column)
    state: list[State | None] = [None] * w.rows
    for a in automata:
        advance(w, a, state)
    yield from told(w, state)


_WORD_LOWERED = np.arange(256) != 32


def automata(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text", max_item_words: int = MAX_ITEM_WORDS) -> Iterator[Automaton]:
    """The items' automata, each of at most ``max_item_words`` words or of one item, made one at a time."""
    shard: list[tuple[str, list[bytes]]] = []
    size = 0
    for x in benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).orderBy("item").toLocalIterator():
        ws = words(x.text)
        if shard and size + len(ws) > max_item_words:
            yield Automaton(shard, window)
            shard, size = [], 0
        shard.append((x.item, ws))
        size += len(ws)
    if size:
        yield Automaton(shard, window)


_STATE = T.StructType([T.StructField("longest", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType())))])
_ARROW_STATE = pa.struct([("longest", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(pa.list_(pa.int64())))])


def _passes(docs: DataFrame, benchmark: DataFrame, at: int, window: int, text: str, max_item_words: int) -> tuple[DataFrame, str, object]:
    """``docs`` after a pass for each automaton but the last, the column of the states, and the broadcast of the last.

    One automaton is broadcast at a time, so what a worker holds is bounded by ``max_item_words``, however many items
    there are; between two passes the states are stored. A test set of one automaton needs one pass.
    """
    name = "found"
    while name in docs.columns:
        name += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _STATE)])
    shards = automata(benchmark, window, text=text, max_item_words=max_item_words)
    last, rows = next(shards, None), docs.withColumn(name, F.lit(None).cast(_STATE))
    for following in shards:
        shared = docs.sparkSession.sparkContext.broadcast(last)

        def run(batches, shared=shared):
            for b in _text.pieces(batches, at):
                w = Words(b.column(at))
                state = _states(b.column(b.num_columns - 1))
                advance(w, shared.value, state)
                cells = [None if x is None else {"longest": x[0], "items": x[1], "runs": [list(r) for r in x[2]]} for x in state]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(cells, _ARROW_STATE)], names=schema.names)

        before, rows = rows, _text.stored(rows.mapInArrow(run, schema), "pass")
        _text.discard(before)
        shared.unpersist()
        last = following
    return rows, name, docs.sparkSession.sparkContext.broadcast(last)


def _states(column: pa.Array) -> list[State | None]:
    return [None if x is None else (x["longest"], x["items"], [tuple(r) for r in x["runs"]]) for x in column.to_pylist()]


def _final(column: pa.Array, states: pa.Array, last: Automaton | None) -> Iterator[tuple[int, int, int, list, list]]:
    w, state = Words(column), _states(states)
    if last is not None:
        advance(w, last, state)
    return told(w, state)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """Per document row: id, words, words hit, longest match, items and hit byte spans."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, _, shared = _passes(source, benchmark, 1, window, text, max_item_words)
    schema = T.StructType([source.schema["doc_id"], *_FOUND.fields])

    def run(batches):
        for b in _text.pieces(batches, 1):
            found = list(_final(b.column(1), b.column(2), shared.value))
            yield pa.RecordBatch.from_arrays([
                b.column(0),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], pa.int64()),
                pa.array([x[3] for x in found], pa.list_(pa.string())),
                pa.array([[{"start": u, "end": v, "words": w} for u, v, w in x[4]] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))),
            ], names=schema.names)

    return rows.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = WINDOW, max_coverage: float = 0.8, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """``docs`` with benchmark spans cut from ``text``; all columns and clean texts are kept.

    A hit span of ``max_span`` words or more is removed; shorter ones, which come from items of fewer words than
    the window, stay, as such an item is often a common phrase. Where the hit words are more than
    ``max_coverage`` of a document, nothing of value is left and the document is dropped.
    ``n_chars``, where there is such a column, follows a changed text.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    rows, _, shared = _passes(docs, benchmark, at, window, "text", max_item_words)

    def run(batches):
        for b in _text.pieces(batches, at):
            keep, texts, sizes = [], b.column(at).to_pylist(), b.column(chars).to_pylist() if chars is not None else None
            for i, (n, hit, _, _, spans) in enumerate(_final(b.column(at), b.column(b.num_columns - 1), shared.value)):
                keep.append(not (hit and hit > max_coverage * n))
                if cut := [x for x in spans if x[2] >= max_span]:
                    raw, out, p = texts[i].encode(), [], 0
                    for u, v, _ in cut:
                        out.append(raw[p:u])
                        p = v
                    texts[i] = b"".join([*out, raw[p:]]).decode()
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            arrays = list(b.columns[:-1])
            arrays[at] = pa.array(texts, arrays[at].type)
            if sizes is not None:
                arrays[chars] = pa.array(sizes, arrays[chars].type)
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw USING (k, s)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
