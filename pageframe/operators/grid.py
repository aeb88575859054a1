"""Page items to aligned plain text.

Two orders of items: ``canonical`` sorts by (y, x, ord), is deterministic and stays in the
JVM; ``exact`` uses the original pairwise comparison (x within the row threshold, else y), which
is not transitive, so it needs a sort by comparison per page (``exact_text``).
"""

from __future__ import annotations

import functools
import operator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import geometry as G, text as X

# Parameter defaults and texts of the rendering.
CHAR_WIDTH, LINE_HEIGHT, Y_THRESHOLD = 8.0, 12.0, 6.0
BANNER, NOTHING = "——— Sayfa ", "(Bu sayfada metin yok)"


def parameters(char_width: Column, line_height: Column, y_threshold: Column) -> tuple[Column, Column, Column]:
    """Clamped parameters; the line height has no effect."""
    return X.clamp(char_width, 4.0, 20.0, CHAR_WIDTH), X.clamp(line_height, 6.0, 30.0, LINE_HEIGHT), X.clamp(y_threshold, 1.0, 20.0, Y_THRESHOLD)


def block_items(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (bbox, text, ord) as grid items; those without a box or text drop."""
    text = X.js_trim(X.unix_lines(X.cell_text(F.col("text"))))
    return blocks.where("bbox is not null").select(*keys, F.col("bbox.y0").alias("y"), F.col("bbox.x0").alias("x"), F.col("ord").cast("long").alias("ord"), text.alias("text")).where("text <> ''")


def cell_items(cells: DataFrame, keys: list[str], n_rows: Column, n_cols: Column, ord: Column) -> DataFrame:  # noqa: A002
    """Cells (row_idx, col_idx, text, cell, bbox) as grid items, placed by cell or table box."""
    at = G.cell_origin(F.col("cell"), F.col("bbox"), F.col("row_idx"), F.col("col_idx"), n_rows, n_cols)
    return cells.select(*keys, at["y"].alias("y"), at["x"].alias("x"), ord.cast("long").alias("ord"), X.js_trim(X.cell_text(F.col("text"))).alias("text")).where("text <> ''")


def row_anchors(ys: Column, threshold: Column | float) -> Column:
    """Anchors of the rows of sorted y: an item joins while y - anchor <= threshold; a row's first item is its anchor.

    One fold over the distinct y of a page, which carries the anchors only.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    start = F.array().cast("array<double>")
    return F.aggregate(ys, start, lambda acc, y: F.when((F.size(acc) == 0) | (y - F.element_at(acc, -1) > limit), F.concat(acc, F.array(y))).otherwise(acc))


def rows(items: DataFrame, keys: list[str], threshold: Column | float = Y_THRESHOLD) -> DataFrame:
    """One row per item with its row number on the page (canonical order)."""
    page = F.array_sort(F.collect_list(F.struct("y", "x", "ord", "text")))
    anchors = row_anchors(F.array_distinct(F.transform("i", lambda it: it["y"])), threshold)
    # an item's row is the last whose anchor is at or above it
    placed = F.transform("i", lambda it: F.struct((F.size(F.filter("a", lambda y: y <= it["y"])) - 1).alias("row"), it["x"].alias("x"), it["ord"].alias("ord"), it["text"].alias("text")))
    return items.groupBy(*keys).agg(page.alias("i")).withColumn("a", anchors).select(*keys, F.inline(placed))


def line(segments: Column, char_width: Column | float = CHAR_WIDTH) -> Column:
    """A row's (x, ord, text) painted in columns; a segment starts at least one column after the last one."""
    width = char_width if isinstance(char_width, Column) else F.lit(float(char_width))
    # columns are UTF-16 units, as the original counts them
    gap = lambda done, x: F.greatest(X.js_round(x / width).cast("int") - X.utf16_length(done), F.lit(1))
    painted = F.aggregate(segments, F.lit(""), lambda done, s: F.concat(done, F.repeat(F.lit(" "), gap(done, s["x"])), s["text"]))
    return X.right_trim(painted)


def page_text(items: DataFrame, keys: list[str], char_width: Column | float = CHAR_WIDTH, threshold: Column | float = Y_THRESHOLD) -> DataFrame:
    """Grid text of each page. All in one grouped pass and two folds."""
    placed = rows(items, keys, threshold)
    lines = placed.groupBy(*keys, "row").agg(line(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), char_width).alias("line"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda s: s["line"]), "\n").alias("grid"))


def document_text(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages (page_number, grid) of a document: banners between pages if there are several, trimmed."""
    every = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("grid", F.lit("")).alias("grid"))))
    part = lambda p: F.concat(F.lit(BANNER), p["page_number"].cast("string"), F.lit(" ———\n\n"), p["grid"])
    text = F.when(F.size("p") > 1, F.array_join(F.transform("p", part), "\n\n")).otherwise(F.get(F.col("p"), 0)["grid"])
    return pages.groupBy(doc).agg(every.alias("p")).select(doc, X.or_else(X.js_trim(text), NOTHING).alias("text"))


def exact_text(items: DataFrame, keys: list[str], char_width: float = CHAR_WIDTH, threshold: float = Y_THRESHOLD) -> DataFrame:
    """Grid text in the original's item order; a page's items are one row's array, as a page is bounded."""

    def before(a, b) -> float:
        return a[1] - b[1] if abs(a[0] - b[0]) <= threshold else a[0] - b[0]

    def render(page: list[tuple]) -> str:
        placed: list[list] = []
        anchor = None
        for item in sorted(page, key=functools.cmp_to_key(before)):
            if anchor is None or item[0] - anchor > threshold:
                placed.append([])
                anchor = item[0]
            placed[-1].append(item)
        out = []
        for row in placed:
            done, units = "", 0
            for _, x, text in sorted(row, key=operator.itemgetter(1)):
                gap = max(int((x / char_width + 0.5) // 1) - units, 1)
                done += " " * gap + text
                units += gap + (len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2)
            out.append(done.rstrip())
        return "\n".join(out)

    def run(batches):
        for b in batches:
            page = b.column("i")
            cut = page.offsets.to_pylist()
            y, x = (page.values.field(n).to_numpy(zero_copy_only=False).tolist() for n in ("y", "x"))
            flat = list(zip(y, x, page.values.field("text").to_pylist(), strict=True))
            grid = [render(flat[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(grid, pa.string())], names=[*keys, "grid"])

    kinds = items.select(*keys).schema
    pages = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "y", "x", "text"))).alias("i"))
    return pages.mapInArrow(run, T.StructType([*kinds.fields, T.StructField("grid", T.StringType())]))
