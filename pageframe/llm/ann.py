"""Approximate nearest neighbours: stable random projections in a kd-tree.

Largest inner product becomes smallest distance by one more coordinate: with M the largest
norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have |x' - q'|^2 = M^2 + |q|^2 - 2<x, q>.

Every vector is projected to ``DIMS`` Gaussian (2-stable) projections, so the squared projected
distance of a point at distance d is d^2 times a chi-squared variable of ``DIMS`` degrees of
freedom. Points are searched by increasing projected distance and verified on their true scores,
until the chi-square test holds: with t the projected distance reached and d the distance of the k-th best so
far, a point at distance d would be projected within t with probability F(t^2 / d^2); once that is
``CONFIDENCE`` or more, what is unseen holds an improvement only with small probability. A point whose own
projected distance fails the test is not verified.

The kd-tree has two levels. The upper one cuts the projected space into at most ``CELLS`` cells by medians of a
sample (``SAMPLE`` rows at most, by a hash of the id); every row is indexed in its cell, in one table that is
stored once, and the cells' boxes are exact. A cell beyond a shard's rows or bytes is dealt to several shards. In
a shard, a tree with leaves of ``LEAF`` points gives the order. A query first meets the cell it is in;
the k-th best found there bounds the search, and it then meets only those other cells whose box passes the test.
Queries that meet a cell do so in blocks of at most about ``BLOCK``, as a stated query set in
blocks, so shard and block sizes bound every task, whatever the table's size.

Vectors of different lengths have no inner product, so each length is a table of its own.

Defined results: vectors that are null, zero or hold null or non-finite components take no
part; a query finds vectors of its own length only; ties go to the
smaller id; a query never finds its own id, so repeated ids never find each other; of
rows that repeat a query's id the smallest vector is the query, and a repeated candidate id is one
candidate per row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import _text

K = 20
DIMS = 16
LEAF = 64
SHARD = 16_384
SHARD_BYTES = 64 << 20
BLOCK = 8_192
CELLS, SAMPLE = 256, 16_384
CONFIDENCE = 0.95
SEED = 7


def chi2_cdf(x: np.ndarray, df: int) -> np.ndarray:
    """Chi-squared distribution function for an even number of degrees of freedom."""
    h = np.asarray(x, float) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, df // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def reach(confidence: float = CONFIDENCE, dims: int = DIMS) -> float:
    """t^2 / d^2 from which the stopping test holds."""
    grid = np.linspace(0, 12 * dims, 24_001)
    return float(grid[min(int(np.searchsorted(chi2_cdf(grid, dims), confidence)), len(grid) - 1)])


def projected(x: np.ndarray, largest: float | None, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """Projections of candidates, or of queries where ``largest`` is None."""
    p = np.random.default_rng((seed, x.shape[1])).standard_normal((x.shape[1] + 1, dims))
    if largest is None:
        return x @ p[:-1]
    return x @ p[:-1] + np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0))[:, None] * p[-1]


def gap(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance from q to each box."""
    out = np.maximum(np.maximum(low - q, q - high), 0)
    return (out**2).sum(-1)


class Tree:
    """kd-tree over projected points, median splits on the widest side, down to leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        todo, leaves = [np.arange(len(points))], []
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                leaves.append(own)
                continue
            x = points[own]
            axis = int(np.argmax(x.max(0) - x.min(0)))
            order = np.argpartition(x[:, axis], len(own) // 2)
            todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        self.points, self.leaves = points, leaves
        self.low = np.array([points[i].min(0) for i in leaves])
        self.high = np.array([points[i].max(0) for i in leaves])


class Splits:
    """Cells of the projected space: medians of a sample on its widest side."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, value, left, right; a leaf is -1 - cell
        self.cells = 0
        self.root = self._split(points, cells)

    def _split(self, points: np.ndarray, cells: int) -> int:
        axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) else 0
        value = float(np.median(points[:, axis])) if len(points) else 0.0
        right = points[:, axis] >= value if len(points) else np.zeros(0, bool)
        if cells < 2 or not right.any() or right.all():
            self.cells += 1
            return -self.cells
        at = len(self.nodes)
        self.nodes.append((axis, value, 0, 0))
        left = self._split(points[~right], cells // 2)
        self.nodes[at] = (axis, value, left, self._split(points[right], cells - cells // 2))
        return at

    def cell(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            at, own = todo.pop()
            if at < 0:
                out[own] = -1 - at
            else:
                axis, value, left, right = self.nodes[at]
                side = points[own, axis] >= value
                todo += [(left, own[~side]), (right, own[side])]
        return out


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, largest: float, k: int = K, confidence: float = CONFIDENCE, dims: int = DIMS) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query the ids and scores of its k best candidates found, best first; and how many scores were taken.

    ``floor``: a score each query has k candidates for elsewhere, nan if it is not known.
    """
    tree = Tree(projected(x, largest, dims))
    limit = reach(confidence, dims)
    out, verified = [], 0
    for own, v, pq, least in zip(query_ids, q, projected(q, None, dims), floor, strict=True):
        bounds = gap(tree.low, tree.high, pq)
        order = np.argsort(bounds, kind="stable")
        bounds = bounds[order]
        base = largest**2 + float(v @ v)
        got_ids, got = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(order):
            known = got[k - 1] if len(got) >= k else -np.inf
            known = known if np.isnan(least) else max(known, least)
            radius = limit * max(base - 2 * known, 0.0)  # the test holds from this squared projected distance
            if bounds[at] > radius:
                break
            end = at + min(step, int(np.searchsorted(bounds[at:], radius, side="right")))
            rows = np.concatenate([tree.leaves[i] for i in order[at:end]])
            if np.isfinite(radius):
                rows = rows[((tree.points[rows] - pq) ** 2).sum(1) <= radius]
            rows = rows[ids[rows] != own]
            verified += len(rows)
            got_ids, got = np.concatenate([got_ids, ids[rows]]), np.concatenate([got, x[rows] @ v])
            best = np.lexsort((got_ids, -got))[:k]
            got_ids, got = got_ids[best], got[best]
            at, step = end, step * 2
        out.append((got_ids, got))
    return out, verified


def usable(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part, x in double precision."""
    x = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return x.where(finite & F.exists("x", lambda c: c != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 0))


def _projected_rows(column: pa.Array, largest: float) -> np.ndarray:
    """Projections of rows that may differ in length."""
    values = column.to_numpy(zero_copy_only=False)
    sizes = np.array([len(v) for v in values])
    out = np.zeros((len(values), DIMS))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out[at] = projected(np.stack(values[at]), largest)
    return out


def neighbours(table: DataFrame, queries, k: int = K, shard: int = SHARD, block: int = BLOCK, vec_id: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row where ``queries`` holds."""
    spark = table.sparkSession
    x = usable(table, vec_id, vector)
    facts = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c))).alias("largest")).first()
    largest = float(facts.largest or 0.0) * (1 + 1e-12)
    rows_of_shard = max(1, min(shard, SHARD_BYTES // (8 * (facts.width or 1))))
    wanted = min(cells, -(-facts.n // rows_of_shard)) if facts.n else 1
    points = np.zeros((0, DIMS))
    if wanted > 1:
        drawn = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array(list(_projected_rows(b.column(1), largest)), pa.list_(pa.float64()))], names=["p"]) for b in bs if b.num_rows), "p array<double>")
        points = _matrix(drawn.toArrow().combine_chunks()["p"].combine_chunks())
        points = points[np.lexsort(points.T)]
    splits = Splits(points, wanted)

    def place(batches):
        for b in batches:
            if b.num_rows:
                p = _projected_rows(b.column(1), largest)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splits.cell(p), pa.int32()), pa.array(list(p), pa.list_(pa.float64()))], names=["vec_id", "x", "cell", "p"])

    placed = _text.stored(x.mapInArrow(place, "vec_id long, x array<double>, cell int, p array<double>").withColumn("width", F.size("x")), "placed")
    sides = [f(F.get(F.col("p"), F.lit(i))).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(DIMS)]
    boxes = placed.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n"), *sides).collect()  # a row for each cell
    cell_of: dict[int, list] = {}
    for r in sorted(boxes, key=lambda r: (r.width, r.cell)):
        cell_of.setdefault(r.width, []).append((r.cell, -(-r.n // rows_of_shard), [r[f"lo{i}"] for i in range(DIMS)], [r[f"hi{i}"] for i in range(DIMS)]))
    asked = placed.where(queries).groupBy("vec_id").agg(F.min(F.struct("x", "width", "cell")).alias("q")).select("vec_id", "q.*").withColumn("floor", F.lit(None).cast("double"))
    visit = "vec_id long, x array<double>, width int, cell int, floor double"
    limit = reach(confidence)

    def others(batches):
        """The cells beside its own that a query has to visit."""
        tables = {w: (np.array([c for c, *_ in own]), np.array([lo for *_, lo, _ in own]), np.array([hi for *_, hi in own])) for w, own in cell_of.items()}
        for b in batches:
            ids, vectors, widths, home, floors = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            row, cell = [], []
            for i in range(b.num_rows):
                names, low, high = tables[int(widths[i])]
                far = largest**2 + float(vectors[i] @ vectors[i]) - 2 * floors[i] if not np.isnan(floors[i]) else np.inf
                there = names[(gap(low, high, projected(vectors[i][None], None)[0]) <= limit * max(far, 0.0)) & (names != home[i])]
                row += [i] * len(there)
                cell += there.tolist()
            yield b.take(pa.array(row, pa.int64())).set_column(3, "cell", pa.array(cell, pa.int32()))

    def searched(visits: DataFrame) -> DataFrame:
        """The best of each visit's cell: its shards meet its queries block by block."""
        met = {(r.width, r.cell): -(-r.n // block) for r in visits.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        sizes = [(w, c, shards, met[w, c]) for w, own in cell_of.items() for c, shards, *_ in own if (w, c) in met]
        dealt = F.broadcast(spark.createDataFrame(sizes, "width int, cell int, shards int, blocks int"))  # a row for each cell
        part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        keys = ["width", "cell", "shard", "block"]
        cand = placed.join(dealt, ["width", "cell"]).select("width", "cell", part("shards", 1).alias("shard"), every("blocks").alias("block"), "vec_id", "x")
        ask = visits.join(dealt, ["width", "cell"]).select("width", "cell", part("blocks", 2).alias("block"), every("shards").alias("shard"), "vec_id", "x", "floor")

        def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            order = np.argsort(left.vec_id.to_numpy(), kind="stable")  # the same tree whatever the order of rows
            ids, v = left.vec_id.to_numpy()[order], np.stack(left.x.to_numpy())[order]
            queries_ = right.vec_id.to_numpy()
            found, _ = search(ids, v, queries_, np.stack(right.x.to_numpy()), right.floor.to_numpy(float), largest, k, confidence)
            return pd.DataFrame({"query_id": np.repeat(queries_, [len(i) for i, _ in found]), "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])})

        found = cand.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    asked = _text.stored(asked, "asked")
    first = _text.stored(searched(asked), "first")
    if sum(map(len, cell_of.values())) <= 1:
        return first.select("query_id", "rank", "vec_id", "score")
    last = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    bounded = asked.join(last, "vec_id", "left").withColumn("floor", F.col("known")).drop("known")
    visits = _text.stored(bounded.mapInArrow(others, visit), "visits")
    both = first.unionByName(searched(visits)).drop("rank")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
