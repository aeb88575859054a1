"""Lines from spans, glyphs and recognised items; page content and blocks from lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G, text as X

PAGE = ("doc_id", "page_number")


def ordered_text(order: list[str], text: str = "text", sep: str = "") -> Column:
    """Aggregate: texts joined in the given order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("t_")))), lambda s: s["t_"]), sep)


def not_blank(df: DataFrame, text: str = "text", keep_raw: bool = True) -> DataFrame:
    """Lines that are more than white space, as they are or stripped."""
    out = df.where(X.strip(F.col(text)) != "")
    return out if keep_raw else out.withColumn(text, X.strip(F.col(text)))


def span_lines(spans: DataFrame, page: tuple[str, ...] = PAGE) -> DataFrame:
    """Spans (block, line, span, text, bbox) to lines in document order; ``bbox`` is null for none."""
    part = lambda n, f: f(F.col("bbox")[n])
    return (
        spans.groupBy(*page, "block", "line")
        .agg(ordered_text(["span"]).alias("text"), part("x0", F.min).alias("x0"), part("y0", F.min).alias("y0"), part("x1", F.max).alias("x1"), part("y1", F.max).alias("y1"))
        .withColumn("bbox", F.when(F.col("x0").isNotNull(), G.box("x0", "y0", "x1", "y1")))
        .drop("x0", "y0", "x1", "y1")
    )


def glyph_lines(glyphs: DataFrame, tolerance: float | None = None, page: tuple[str, ...] = PAGE, order: str = "ord") -> DataFrame:
    """Glyphs to lines by equal ``top``, or by ``top`` within a tolerance (half-even quantised)."""
    key = F.col("top") if tolerance is None else G.quantise(F.col("top"), tolerance)
    within = ["x0", order] if tolerance is None else ["x0", "top", order]
    return glyphs.withColumn("line_y", key).groupBy(*page, "line_y").agg(
        ordered_text(within).alias("text"), F.min("x0").alias("x0"), F.min("top").alias("y0"), F.max("x1").alias("x1"), F.max("bottom").alias("y1"),
    )


def content(lines: DataFrame, order: list[str], sep: str = "\n", stripped: bool = True, page: tuple[str, ...] = PAGE) -> DataFrame:
    """Page content: lines joined in order, stripped or not."""
    joined = ordered_text(order, sep=sep)
    return lines.groupBy(*page).agg((X.strip(joined) if stripped else joined).alias("content"))


def pages_of(lines: DataFrame, order: list[str], sep: str = "\n", stripped: bool = True, page: tuple[str, ...] = PAGE) -> DataFrame:
    """Page content and positioned blocks of lines with x0, y0, x1, y1, in one pass."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "text", G.box("x0", "y0", "x1", "y1").alias("bbox"))))
    joined = F.array_join(F.transform("rows_", lambda r: r["text"]), sep)
    blocks = F.transform("rows_", lambda r: F.struct(r["text"].alias("text"), r["bbox"].alias("bbox")))
    return lines.groupBy(*page).agg(rows.alias("rows_")).select(*page, (X.strip(joined) if stripped else joined).alias("content"), blocks.alias("text_blocks"))


def with_fallback(pages: DataFrame, page_text: str = "page_text", width: str = "page_width", height: str = "page_height") -> DataFrame:
    """Whole page text where no content was found, in one block over the page where there is none."""
    whole = F.when(F.coalesce(X.strip(F.col(page_text)), F.lit("")) != "", X.strip(F.col(page_text)))
    empty = (F.coalesce("content", F.lit("")) == "") & whole.isNotNull()
    block = F.array(F.struct(whole.alias("text"), G.box(0.0, 0.0, F.col(width), F.col(height)).alias("bbox")))
    return pages.withColumns({
        "text_blocks": F.when(empty & (F.coalesce(F.size("text_blocks"), F.lit(0)) <= 0), block).otherwise(F.col("text_blocks")),
        "content": F.when(empty, whole).otherwise(F.col("content")),
    })


def image_text(items: DataFrame, keys: list[str], order: str = "item_ord") -> DataFrame:
    """Recognised items of an image: stripped, empty ones left out, joined by spaces; images without text drop.

    ``confidence`` is the mean of the numeric scores of all items, 0.9 if there are none.
    """
    kept = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.struct(order, X.strip(F.col("text")).alias("t_")))))
    joined = X.strip(F.array_join(F.transform(kept, lambda s: s["t_"]), " "))
    out = items.groupBy(*keys).agg(joined.alias("ocr_text"), F.coalesce(F.avg("score"), F.lit(0.9)).alias("confidence"))
    return out.where(F.col("ocr_text") != "")


def ocr_lines(items: DataFrame, drop_blank: bool) -> DataFrame:
    """Recognised items: only empty ones drop, or blank ones too; texts stay as they are."""
    test = X.strip(F.col("text")) != "" if drop_blank else F.col("text") != ""
    return items.where(F.col("text").isNotNull() & test)
