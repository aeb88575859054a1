"""Spatial joins within pages: always an equi-join on the page with the geometry as residue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G, text as X

PAGE = ("doc_id", "page_number")


def _box(df: DataFrame | str, prefix: str = "") -> Column:
    return G.box(*(F.col(f"{df}.{prefix}{n}") for n in ("x0", "y0", "x1", "y1")))


def _on(page: tuple[str, ...], a: str, b: str) -> Column:
    test = F.lit(True)
    for k in page:
        test = test & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return test


def _sorted(df: DataFrame) -> DataFrame:
    """A side of a join by pages that is sorted with the other, not collected on the driver and sent to all.

    Rows that come out of arrays are many more than the planner's guess from the files' sizes.
    """
    return df.hint("merge")


def outside_tables(lines: DataFrame, tables: DataFrame, ratio: float = 0.5, page: tuple[str, ...] = PAGE) -> DataFrame:
    """Lines that are mostly inside no table (anti join); tables without a box do not count."""
    on = _on(page, "l", "t") & F.coalesce(G.mostly_inside(_box("l"), _box("t"), ratio), F.lit(False))
    return lines.alias("l").join(_sorted(tables.where("x0 is not null").alias("t")), on, "left_anti")


def image_size(images: DataFrame, least: float = 5.0) -> DataFrame:
    return images.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def image_to_cell(images: DataFrame, cells: DataFrame, page: tuple[str, ...] = PAGE, order: str = "ord") -> DataFrame:
    """The first matching cell by (table, row, column) of each image; images without one drop.

    The first is a minimum, so it is aggregated before the shuffle, whatever the candidates.
    """
    at = F.struct("c.table_idx", "c.row_idx", "c.col_idx")
    found = images.alias("i").join(_sorted(cells.where("x0 is not null").alias("c")), _on(page, "i", "c") & G.matches_cell(_box("i"), _box("c")))
    return found.groupBy(*(F.col(f"i.{k}").alias(k) for k in (*page, order))).agg(F.min(at).alias("cell")).select(*page, order, "cell.*")


def cells_with_ocr(cells: DataFrame, matched: DataFrame, page: tuple[str, ...] = PAGE, order: str = "ord") -> DataFrame:
    """Cells with the texts of their images appended in image order; ``matched`` has ocr_text.

    A match with a cell that is not in ``cells`` is lost, as its text is nobody's.
    """
    keys = [*page, "table_idx", "row_idx", "col_idx"]
    added = matched.where(F.col("ocr_text") != "").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "ocr_text"))), lambda s: s["ocr_text"]), " ").alias("added_"))
    text = F.when(F.col("added_").isNull(), F.col("text")).otherwise(X.strip(F.concat_ws(" ", F.nullif("text", F.lit("")), "added_")))
    return cells.join(_sorted(added), keys, "left").withColumn("text", text).drop("added_")


def image_dedup(images: DataFrame, lines: DataFrame, ratio: float = 0.5, page: tuple[str, ...] = PAGE) -> DataFrame:
    """Images whose text no overlapping native line already has (anti join); ``images`` has ocr_text."""
    on = _on(page, "i", "l") & (G.overlap_ratio(_box("i"), _box("l")) > ratio) & X.either_contains(F.col("l.text"), F.col("i.ocr_text"))
    return images.alias("i").join(_sorted(lines.alias("l")), on, "left_anti")


def table_cells(tables: DataFrame, page: tuple[str, ...] = PAGE, table: str = "table_idx") -> DataFrame:
    """rows[r][c] with cells_bbox[r][c], both ragged: one row per cell of ``rows``, box null where none."""
    rows = tables.select(*page, table, "cells_bbox", "bbox", F.posexplode("rows").alias("row_idx", "row_"))
    cells = rows.select("*", F.size("row_").alias("n_cols"), F.posexplode("row_").alias("col_idx", "text"))
    found = F.get(F.get(F.col("cells_bbox"), F.col("row_idx")), F.col("col_idx"))
    return cells.withColumn("cell", found).select(*page, table, "row_idx", "col_idx", X.cell_text(F.col("text")).alias("text"), "cell", "bbox", "n_cols")


def table_text(cells: DataFrame, page: tuple[str, ...] = PAGE) -> DataFrame:
    """One line per table row: its cells joined by a bar."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", X.cell_text(F.col("text")).alias("t_")))), lambda s: s["t_"]), " | ", "")
    return cells.groupBy(*page, "table_idx", "row_idx").agg(row.alias("text"))


def reading_order(texts: DataFrame, tables: DataFrame, page: tuple[str, ...] = PAGE) -> DataFrame:
    """Page content by (y0, x0), text before tables at the same place.

    ``texts``: y0, x0, ord, text; ``tables``: y0, x0, ord, lines (an array of row lines).
    """
    place = ["y0", "x0"]
    both = texts.select(*page, *place, F.lit(0).alias("kind"), F.col("ord").cast("long").alias("ord"), F.array("text").alias("lines")).unionByName(tables.select(*page, *place, F.lit(1).alias("kind"), F.col("ord").cast("long").alias("ord"), "lines"))
    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in place), "kind", "ord", "lines"))), lambda s: s["lines"]))
    return both.groupBy(*page).agg(X.strip(F.array_join(every, "\n", "")).alias("content"))
