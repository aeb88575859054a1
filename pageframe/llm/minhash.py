"""Near-duplicates by DartMinHash signatures, banding and exact verification.

A document is the multiset of its five-word shingles (words are runs without white space,
unchanged; a document of one to four words is one shingle). Its signature throws darts
into the weighted regions of its elements: each unit of an element's weight is a cell with
a Poisson process of ranks, drawn from a hash of the cell, so equal cells of two documents
receive equal darts; each dart has a coordinate, and the dart of least rank is kept per
coordinate. Two signatures agree in a coordinate with the probability of the documents'
weighted Jaccard similarity. A cell whose first rank is beyond the rank at which all
coordinates are expected to be filled costs one hash, so a document costs its size
plus k log k.

Documents with the same words are collapsed first. Bands of ``ROWS`` coordinates are the
buckets. No bucket is expanded into all of its pairs: in each bucket the document with the
most company overall (a near copy's source has more of it than other copies) is compared
with the others, then the best document outside that one's class. What is still in different
classes is then compared across classes, so that no candidate link between classes is lost:
in the task, in bounded blocks, by longer signatures that only these documents get, and only
close pairs leave the task. A pair is checked by its signatures (four standard deviations or
more below the threshold) and then exactly, on both texts. Classes are the connected
components of the verified links.

Defined results: null and empty texts and texts of white space are in no bucket, each its own
class; equal texts are one class; rows that share an id are one document, linked to all that one
of its texts is linked to; a null id is in the class of the documents of its words, or in none; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import _text
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
FINE = 256
BLOCK = 2048
#: Cells (words) of the texts of a block that are measured together.
BLOCK_CELLS = 1 << 20
#: Signature coordinates that are made at a time; some eight darts each are held.
DARTS = 60_000

_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def cells(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each unit cell (shingle, n-th occurrence), by row and hash; word hashes and their rows."""
    data, offs = _text.buffer(column)
    rows = len(offs) - 1
    s, e, row = _text.spans(data, offs, _WORD)
    h = _text.hashes(data, s, e)
    g, good = _text.ngrams(h, row, shingle)
    parts_r, parts_g = [row[: len(g)][good]], [g[good]]
    first = _text.starts_of(row, rows)
    count = np.diff(first)
    for n in range(1, shingle):
        at = first[:-1][count == n]
        if len(at):
            few, ok = _text.ngrams(h, row, n)
            parts_r.append(row[at])
            parts_g.append(few[at])
    r, g = np.concatenate(parts_r), np.concatenate(parts_g)
    order = np.lexsort((g, r))
    r, g = r[order], g[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        nth = np.arange(len(g)) - np.repeat(at, np.diff(np.append(at, len(g))))
        more = nth > 0
        g = g.copy()
        g[more] = _text.mix(g[more] ^ _text.mix(nth[more].astype(np.uint64), 3), 4)
    return r, g, h, row


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def signatures(row: np.ndarray, cell: np.ndarray, rows: int, k: int, width: np.ndarray | None = None) -> np.ndarray:
    """(rows, k) dart ids of least rank per coordinate; rows without cells have zeros.

    ``width`` is each cell's share of a unit of weight (1 if none is given): a dart lands at
    a hashed place in the cell and counts if that is inside the width.
    """
    out = np.zeros((rows, k), np.uint64)
    best = np.full((rows, k), np.inf)
    weight = np.bincount(row, weights=width, minlength=rows) if len(row) else np.zeros(rows)
    want = weight > 0
    limit = np.zeros(rows)
    limit[want] = (k * np.log(k) + 2 * k) / weight[want]
    r, c, w = row, cell, width
    rank, nth = np.zeros(len(r)), 0
    held = [(r, c, w, rank, np.zeros(len(r), np.int64))]  # cells with their latest rank and dart number
    while want.any():
        waiting = []
        found = []
        for r, c, w, rank, nth in held:
            while len(r):
                seed = _text.mix(c ^ _text.mix(nth.astype(np.uint64), 5), 6)
                nxt = rank - np.log(_uniform(seed))
                far = nxt > limit[r]
                if far.any():
                    waiting.append((r[far], c[far], None if w is None else w[far], rank[far], nth[far]))
                    near = ~far
                    r, c, w, nxt, nth, seed = r[near], c[near], None if w is None else w[near], nxt[near], nth[near], seed[near]
                dart = _text.mix(seed, 7)
                ok = np.ones(len(r), bool) if w is None else _uniform(_text.mix(seed, 8)) < w
                found.append((r[ok], dart[ok], nxt[ok]))
                rank, nth = nxt, nth + 1
        if found:
            r, dart, rank = (np.concatenate(x) for x in zip(*found, strict=True))
            slot = r * k + (dart % np.uint64(k)).astype(np.int64)
            order = np.lexsort((rank, slot))
            slot = slot[order]
            first = np.ones(len(slot), bool)
            first[1:] = slot[1:] != slot[:-1]
            slot, rank, dart = slot[first], rank[order][first], dart[order][first]
            better = rank < best.ravel()[slot]
            best.ravel()[slot[better]] = rank[better]
            out.ravel()[slot[better]] = dart[better]
        want = want & ~np.isfinite(best).all(1)
        limit[want] *= 2
        held = [(r[m], c[m], None if w is None else w[m], q[m], n[m]) for r, c, w, q, n in waiting if (m := want[r]).any()]
    return out


def bands(sig: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) 64-bit bucket keys; the band's number is part of the key."""
    out = np.zeros((len(sig), n), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(n):
            h = np.full(len(sig), b + 1, np.uint64)
            for j in range(rows):
                h = _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + j], 9)
            out[:, b] = h
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted cell sets."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_SIGNED = [("key", T.BinaryType()), ("weight", T.LongType()), ("sig", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))]


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, key of its words (null without words), weight, byte signature, band keys."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(n, t) for n, t in _SIGNED)])
    k = n_bands * rows

    def run(batches):
        for b in _text.pieces(batches, 1, most=DARTS // k):
            n = b.num_rows
            r, c, h, row = cells(b.column(1))
            sig = signatures(r, c, n, k)
            keys = bands(sig, n_bands, rows).view(np.int64)
            cuts = _text.starts_of(row, n)
            size = np.bincount(r, minlength=n)
            low = (sig >> np.uint64(32)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([hashlib.md5(h[x:y].tobytes()).digest() if y > x else None for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                pa.array(size, pa.int64()), pa.array([x.tobytes() for x in low], pa.binary()), pa.array([x if m else [] for x, m in zip(keys, size, strict=True)], pa.list_(pa.int64())),
            ], names=schema.names)

    return source.mapInArrow(run, schema)


def _close(pairs: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs whose signatures do not rule the threshold out (five standard deviations)."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("weight").alias(f"w_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(F.least("w_a", "w_b") >= threshold * F.greatest("w_a", "w_b"))
    least = threshold - 5 * np.sqrt(threshold * (1 - threshold) / k)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(_text.buffer(b.column(i))[0], np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
                keep = pa.array((x == y).mean(1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(keep)

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, pairs.select("a", "b").schema)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs of at least the threshold, measured on both texts."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        last, left = None, None
        for b in _text.pieces(batches, 3):
            r, c, _, _ = cells(b.column(3))
            cuts = np.searchsorted(r, np.arange(b.num_rows + 1))
            ids, keep = b.column(0).to_pylist(), []
            for i in range(b.num_rows):
                if left is None or ids[i] != last:
                    last, left = ids[i], cells(b.column(2).slice(i, 1))[1]
                keep.append(similarity(left, c[cuts[i] : cuts[i + 1]]) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def _finer(texts: DataFrame, k: int = FINE) -> DataFrame:
    """(node, size, fine): longer byte signatures of the texts that are still in question."""

    def run(batches):
        for b in _text.pieces(batches, 1, most=DARTS // k):
            r, c, _, _ = cells(b.column(1))
            low = (signatures(r, c, b.num_rows, k) >> np.uint64(32)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.bincount(r, minlength=b.num_rows), pa.int64()), pa.array([x.tobytes() for x in low], pa.binary())], names=["node", "size", "fine"])

    kind = texts.schema["node"].dataType.simpleString()
    return texts.select("node", "text").mapInArrow(run, f"node {kind}, size long, fine binary")


class _Block:
    """The rows of one bucket, or of two parts of a large one, and which pairs of them are open."""

    def __init__(self, table: pa.Table, threshold: float):
        k = len(table.column("fine")[0].as_py())
        self.least = threshold - 4 * np.sqrt(threshold * (1 - threshold) / k)
        self.threshold = threshold
        # by weight, so that the partners of a row are one run of rows
        table = table.sort_by([("size", "ascending"), ("node", "ascending")])
        self.node, self.size, self.own = table.column("node").to_pylist(), table.column("size").to_numpy(), table.column("own").to_numpy()
        _, self.comp = np.unique(np.array(table.column("comp").to_pylist(), object).astype(str), return_inverse=True)
        self.apart = table.column("lo")[0].as_py() < table.column("hi")[0].as_py()
        self.fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(len(self.node), -1)
        self.keys = np.array(table.column("bands").to_pylist(), np.int64)
        self.band = int(np.flatnonzero(self.keys[0] == table.column("bucket")[0].as_py())[0])
        self.table = table

    def partners(self, i: int) -> np.ndarray:
        """Later rows of another class and fitting weight whose fine signature is close; pairs of an earlier band are its own."""
        end = int(np.searchsorted(self.size, self.size[i] / self.threshold + 1e-9, side="right"))
        j = np.arange(i + 1, end)
        j = j[(self.comp[j] != self.comp[i]) & ((self.own[j] != self.own[i]) if self.apart else True)]
        if len(j):
            j = j[(self.fine[j] == self.fine[i]).mean(1) >= self.least]
        if len(j):
            j = j[~(self.keys[j, : self.band] == self.keys[i, : self.band]).any(1)]
        return j


def _spread(rows: DataFrame, block: int, most: int) -> DataFrame:
    """Each row (bucket, node, comp, size) once per pair of parts of its bucket that it belongs to.

    Buckets of at most ``block`` rows and ``most`` cells are one part.
    """
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / most)).cast("int")
    hot = rows.groupBy("bucket").agg(parts.alias("parts")).where("parts > 1")
    own = rows.join(hot, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    return own.select("*", F.explode(other).alias("other")).select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "comp")


def _across(live: DataFrame, details: DataFrame, texts: DataFrame, threshold: float, block: int = BLOCK, most: int = BLOCK_CELLS) -> DataFrame:
    """Verified links (a, b) between different classes that share a bucket.

    A bucket's rows are compared in the task, in blocks of bounded rows and cells (a larger
    bucket meets itself block by block). A first pass finds, by fine signatures, the rows
    of a block that have a close partner of another class; only they are given their texts, and
    a second pass over the same buckets measures these pairs on their cells. No pair leaves a
    task unless it is a link, and of the links that join the same classes one is enough, so a block
    returns fewer links than it has classes. ``details``: node, size, bands, fine.
    """
    kind = live.schema["node"].dataType.simpleString()

    def close(table: pa.Table) -> pa.Table:
        b = _Block(table, threshold)
        asked = np.zeros(len(b.node), bool)
        for i in range(len(b.node)):
            j = b.partners(i)
            asked[i] |= len(j) > 0
            asked[j] = True
        return b.table.filter(pa.array(asked)).select(["bucket", "node", "comp", "size"])

    def measure(table: pa.Table) -> pa.Table:
        b = _Block(table, threshold)
        row, cell, _, _ = cells(b.table.column("text"))
        names, cell = np.unique(cell, return_inverse=True)
        cuts = np.searchsorted(row, np.arange(len(b.node) + 1))
        size = np.diff(cuts)
        mark = np.zeros(len(names), np.uint8)
        root = np.arange(int(b.comp.max()) + 1)
        links = []
        for i in range(len(b.node)):
            j = b.partners(i)
            j = j[root[b.comp[j]] != root[b.comp[i]]]
            if not len(j):
                continue
            own = cell[cuts[i] : cuts[i + 1]]
            mark[own] = 1
            n = size[j]
            at = np.repeat(cuts[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.add.reduceat(mark[cell[at]].astype(np.int64), np.cumsum(n) - n)
            mark[own] = 0
            for x in j[both / (size[i] + n - both) >= threshold].tolist():
                u, v = root[b.comp[i]], root[b.comp[x]]
                if u != v:
                    root[root == v] = u
                    links.append((b.node[x], b.node[i]))
        kinds = b.table.schema.field("node").type
        return pa.table({"a": pa.array([x for x, _ in links], kinds), "b": pa.array([x for _, x in links], kinds)})

    keys = ["bucket", "lo", "hi"]
    sized = live.join(details.select("node", "size"), "node")
    asked = _spread(sized, block, 1 << 62).join(details, "node").groupBy(*keys).applyInArrow(close, f"bucket long, node {kind}, comp {kind}, size long")
    asked = _text.stored(asked.distinct(), "asked")
    full = _spread(asked, block, most).join(details, "node").join(texts.select("node", "text"), "node")
    found = _text.stored(full.groupBy(*keys).applyInArrow(measure, f"a {kind}, b {kind}"), "good")
    _text.discard(asked)
    return found


def _leaders(rows: DataFrame) -> DataFrame:
    """Per bucket the document with the most company, ties to the smallest id."""
    best = rows.groupBy("bucket").agg(F.min(F.struct((-F.col("degree")).alias("order"), "node", "comp")).alias("t"))
    return best.select("bucket", F.col("t.node").alias("lead"), F.col("t.comp").alias("lead_comp"))


def _judged(docs: DataFrame, threshold: float, n_bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, class_id) of every row of ``docs``, stored; all other tables are removed again."""
    k = n_bands * rows
    sign = _text.stored(signed(docs, doc_id, text, n_bands, rows), "signed")
    groups = sign.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node"))
    groups = _text.stored(groups, "groups")
    nodes = sign.join(groups.select("key", F.col("node").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("node"), "weight", "sig", "bands")
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket", "n")
    company = _text.stored(placed.join(shared, "bucket"), "company")  # only buckets of two or more
    degree = company.groupBy("node").agg(F.sum("n").alias("degree"))
    placed = _text.stored(company.select("node", "bucket").join(degree, "node"), "placed")
    sigs = _text.stored(nodes.select("node", "weight", "sig").join(degree.select("node"), "node", "left_semi"), "sigs")
    # texts of all that take part in a bucket with a possible partner, read once
    found = docs.select(F.col(doc_id).alias("node"), F.col(text).cast("string").alias("text")).join(degree.select("node").hint("merge"), "node", "left_semi")
    named = sign.where("key is not null and doc_id is not null")
    again = named.groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = _text.stored(again, "again")
    if again.limit(1).count():  # rows that repeat an id and a text are one text, however many they are
        ids = again.select(F.col("doc_id").alias("node"))
        found = found.join(ids, "node", "left_anti").unionAll(found.join(ids, "node", "left_semi").dropDuplicates(["node", "text"]))
    texts = _text.stored(found, "texts")
    used = [company, placed, sigs, texts, again]
    # rows that share an id are one document: the groups of its texts are linked
    several = again.where("key <> last").select("doc_id")
    same = named.join(several, "doc_id", "left_semi").join(groups, "key").select("doc_id", "node").distinct()
    links = _text.stored(same.select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "same")
    used.append(links)
    tested: DataFrame | None = None
    comp = None
    for turn in ("first", "second", "rest"):
        if comp is None:
            rows_ = placed.withColumn("comp", F.col("node"))
        else:
            rows_ = placed.join(comp.select("node", F.col("root")), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        open_ = rows_.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
        live = _text.stored(rows_.join(open_, "bucket", "left_semi"), "live")
        used.append(live)
        if turn == "rest":
            fine = _finer(texts.join(live.select("node").distinct(), "node", "left_semi"))
            fine = _text.stored(fine.join(nodes.select("node", "bands"), "node"), "fine")
            good = _across(live.select("bucket", "node", "comp"), fine, texts, threshold)
            used.append(fine)
        else:
            first = _leaders(live)
            lead = first if turn == "first" else _leaders(live.join(first.select("bucket", "lead_comp"), "bucket").where("comp <> lead_comp").drop("lead_comp"))
            # the better-connected end is `a`, whose text many pairs share
            pairs = live.join(lead, "bucket").where("comp <> lead_comp").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
            if tested is not None:
                seen = tested.select("a", "b").unionAll(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
                pairs = pairs.join(seen, ["a", "b"], "left_anti")
            pairs = _text.stored(pairs, "pairs")
            tested = pairs if tested is None else tested.unionAll(pairs)
            close = _text.stored(_close(pairs, sigs, threshold, k), "close")
            good = _text.stored(_verified(close, texts, threshold), "good")
            used += [pairs, close]
        used.append(good)
        links = links.unionAll(good)
        if comp is not None:
            used.append(comp)
        comp = components(links)
    of_key = groups.join(comp, "node", "left").select("key", F.coalesce("root", "node").alias("class_id"))
    # without a null id all ids and texts are told apart by the groups; a null id has none of its own
    out = sign.select("doc_id", "key").join(of_key, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    out = _text.stored(out, "classes")
    _text.discard(sign, groups, comp, *used)
    return out


def classes(docs: DataFrame, threshold: float = THRESHOLD, n_bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id) for every row, class_id the smallest id of the class; ids are of any type that has an order."""
    return _judged(docs, threshold, n_bands, rows, doc_id, text)


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the one document of smallest id of each class, all columns kept.

    Of rows that share an id, one stays, that of the least text. Rows without an id belong to no class
    that could be named: of those with the same text one stays, whatever other documents say.
    """
    found = _judged(docs, threshold, BANDS, ROWS, "doc_id", "text")
    dropped = _text.stored(found.where("doc_id <> class_id").select("doc_id").distinct(), "dropped")
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    again = _text.stored(again.join(dropped, "doc_id", "left_anti"), "again")
    nameless = found.where("doc_id is null").limit(1).count() > 0
    repeated = again.limit(1).count() > 0
    out = docs.join(dropped, "doc_id", "left_anti")
    if not nameless and not repeated:
        return out
    # the least of each group is aggregated before the shuffle, however often an id is repeated
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = lambda df, *by: df.groupBy(*by).agg(F.min_by(row, F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))).alias("r")).select("r.*")
    named = out.where("doc_id is not null")
    parts = [named.join(again, "doc_id", "left_anti"), least(named.join(again, "doc_id", "left_semi"), "doc_id")]
    if nameless:
        without = out.where("doc_id is null")
        worded = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
        parts += [without.where(~worded), least(without.where(worded), "text")]
    for part in parts[1:]:
        parts[0] = parts[0].unionAll(part)
    return parts[0]


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
