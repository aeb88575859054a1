"""The seven modes as plans over page primitives (``sources.backends.decode``).

Each takes pages (doc_id, page_number, page_width, page_height, page_text, spans, glyphs,
tables, images, ocr) and gives page results: doc_id, page_number, content, text_blocks,
tables, page_width, page_height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G, text as X
from ..operators import lines as L, normalize, routing, spatial as S
from ..schema import PAGE_RESULT, RESPONSE
from ..sources import backends, scratch

PAGE = ["doc_id", "page_number"]
_BLOCKS = PAGE_RESULT["text_blocks"].dataType
_TABLES = PAGE_RESULT["tables"].dataType


def _dealt(pages: DataFrame) -> DataFrame:
    """In partitions by page: a page's rows are then grouped and joined where they are."""
    return pages.repartition(*PAGE)


def _flat(pages: DataFrame, part: str, order: str = "ord") -> DataFrame:
    return _dealt(pages.select(*PAGE, part)).select(*PAGE, F.posexplode(part).alias(order, "e_")).select(*PAGE, order, "e_.*")


def _boxed(df: DataFrame, box: str = "bbox") -> DataFrame:
    return df.select("*", *(F.col(box)[n].alias(n) for n in ("x0", "y0", "x1", "y1")))


def _result(pages: DataFrame, found: DataFrame, tables: Column | None = None) -> DataFrame:
    out = _dealt(pages.select(*PAGE, "page_width", "page_height", "page_text", "tables")).join(found, PAGE, "left")
    return out.select(
        *PAGE, F.coalesce("content", F.lit("")).alias("content"), F.coalesce("text_blocks", F.array().cast(_BLOCKS)).alias("text_blocks"),
        (F.array().cast(_TABLES) if tables is None else F.coalesce(tables, F.array().cast(_TABLES))).alias("tables"), "page_width", "page_height", "page_text",
    )


def pdftext(pages: DataFrame) -> DataFrame:
    """Spans to lines in document order; blank lines drop; lines without a box are content only."""
    found = L.not_blank(L.span_lines(_flat(pages, "spans").where("type = 0")))
    rows = F.array_sort(F.collect_list(F.struct("block", "line", "text", "bbox")))
    found = found.groupBy(*PAGE).agg(rows.alias("r")).select(
        *PAGE, X.strip(F.array_join(F.transform("r", lambda x: x["text"]), "\n")).alias("content"),
        F.transform(F.filter("r", lambda x: x["bbox"].isNotNull()), lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"))).alias("text_blocks"),
    )
    return L.with_fallback(_result(pages, found)).drop("page_text")


def pdftexttable(pages: DataFrame) -> DataFrame:
    """Glyph lines of equal top as blocks, the page's text as content, tables with cell boxes."""
    found = L.not_blank(L.glyph_lines(_flat(pages, "glyphs")))
    blocks = L.pages_of(found, ["line_y"]).drop("content")
    out = _result(pages, blocks.withColumn("content", F.lit(None).cast("string")), _clean_tables(F.col("tables")))
    return out.withColumn("content", X.strip(F.coalesce("page_text", F.lit("")))).drop("page_text")


def _clean_tables(tables: Column) -> Column:
    kept = F.filter(tables, lambda t: F.size(t["rows"]) > 0)
    return F.transform(kept, lambda t: t.withField("rows", X.rows_text(t["rows"])))


def _ocr(pages: DataFrame, drop_blank: bool, sep: str) -> DataFrame:
    kept = L.ocr_lines(_flat(pages, "ocr"), drop_blank).withColumn("b_", G.polygon_box(F.col("polygon")))
    found = L.pages_of(_boxed(kept, "b_"), ["ord"], sep, stripped=False)
    return _result(pages, found).drop("page_text")


def pdfimagev5(pages: DataFrame) -> DataFrame:
    """Recognised lines: only empty ones drop; content is not stripped."""
    return _ocr(pages, False, "\n")


def pdfimagets(pages: DataFrame) -> DataFrame:
    """Recognised words: blank ones drop; content is words joined by spaces."""
    return _ocr(pages, True, " ")


def _image_texts(pages: DataFrame) -> DataFrame:
    """Embedded images of a size with the text recognised in them."""
    found = S.image_size(_boxed(_flat(pages, "images")))
    items = found.select(*PAGE, F.col("ord").alias("image_ord"), F.posexplode("items").alias("item_ord", "i_")).select(*PAGE, "image_ord", "item_ord", "i_.*")
    texts = L.image_text(items, [*PAGE, "image_ord"]).withColumnRenamed("image_ord", "ord")
    return found.select(*PAGE, "ord", "x0", "y0", "x1", "y1").join(texts, [*PAGE, "ord"])


def provenance_lines(pages: DataFrame) -> DataFrame:
    """Native lines (confidence 1) and image texts that no native line has, with their source, in order."""
    native = L.span_lines(_flat(pages, "spans").where("type = 0"))
    own = _flat(pages, "spans").where("type = 0").groupBy(*PAGE, "block", "line").agg(F.first("line_bbox").alias("line_bbox"))
    native = native.join(own, [*PAGE, "block", "line"]).withColumn("b_", F.coalesce("line_bbox", "bbox", G.zero_box()))
    native = _boxed(native, "b_").select(*PAGE, F.struct(F.lit(0).alias("k"), "block", "line").alias("ord"), "text", "x0", "y0", "x1", "y1")
    images = S.image_dedup(_image_texts(pages), native)
    a = native.withColumns({"confidence": F.lit(1.0), "source": F.lit("native")})
    b = images.select(*PAGE, F.struct(F.lit(1).alias("k"), F.col("ord").cast("int").alias("block"), F.lit(0).alias("line")).alias("ord"), F.col("ocr_text").alias("text"), "x0", "y0", "x1", "y1", "confidence", F.lit("ocr_image").alias("source"))
    return a.unionByName(b).withColumn("box", G.box_polygon(G.box("x0", "y0", "x1", "y1")))


def pdftxtimage(pages: DataFrame) -> DataFrame:
    """Native lines and image texts by (y, x); blank native lines stay."""
    return _result(pages, L.pages_of(provenance_lines(pages), ["y0", "x0", "ord"])).drop("page_text")


def pdfimagetable(pages: DataFrame) -> DataFrame:
    """Lines outside tables, tables with image texts in their cells, other image texts as blocks, in reading order."""
    tabs = _flat(pages, "tables", "table_idx").where(F.size("rows") > 0)
    cells = S.table_cells(tabs, page=tuple(PAGE))
    boxed = _boxed(cells, "cell")
    text = L.not_blank(L.glyph_lines(_flat(pages, "glyphs"), 3.0), keep_raw=False)
    text = S.outside_tables(text, _boxed(tabs.select(*PAGE, "table_idx", "bbox")))
    images = _image_texts(pages)
    cell_of = S.image_to_cell(images, boxed)
    matched = images.join(cell_of, [*PAGE, "ord"], "left")
    filled = S.cells_with_ocr(cells, matched.where("table_idx is not null"))
    free = matched.where("table_idx is null").select(*PAGE, F.struct(F.lit(1).alias("k"), F.col("ord").cast("double").alias("o")).alias("ord"), F.col("ocr_text").alias("text"), "x0", "y0", "x1", "y1")
    blocks = text.select(*PAGE, F.struct(F.lit(0).alias("k"), F.col("line_y").alias("o")).alias("ord"), "text", "x0", "y0", "x1", "y1").unionByName(free)
    found = L.pages_of(blocks, ["y0", "x0", "ord"]).drop("content")
    rows = filled.groupBy(*PAGE, "table_idx", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "text"))).alias("c"))
    rows = rows.groupBy(*PAGE, "table_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "c"))), lambda r: F.transform(r["c"], lambda c: c["text"])).alias("rows"))
    tabs = tabs.drop("rows").join(rows, [*PAGE, "table_idx"])
    b0 = lambda n: F.coalesce(F.col("bbox")[n], F.lit(0.0)).alias(n)
    with_lines = tabs.select(*PAGE, b0("y0"), b0("x0"), F.col("table_idx").alias("ord"), F.transform("rows", lambda r: F.array_join(r, " | ", "")).alias("lines"))
    numbered = routing.numbered(blocks.select(*PAGE, "y0", "x0", F.col("ord").alias("o_"), "text"), PAGE, ["y0", "x0", "o_"], "ord")
    content = S.reading_order(numbered, with_lines)
    tables = tabs.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "rows", "bbox", "cells_bbox"))), lambda t: F.struct(t["rows"].alias("rows"), t["bbox"].alias("bbox"), t["cells_bbox"].alias("cells_bbox"))).alias("tables_"))
    base = _dealt(pages.select(*PAGE, "page_width", "page_height"))
    out = base.join(found, PAGE, "left").join(content, PAGE, "left").join(tables, PAGE, "left")
    return out.select(*PAGE, F.coalesce("content", F.lit("")).alias("content"), F.coalesce("text_blocks", F.array().cast(_BLOCKS)).alias("text_blocks"), F.coalesce("tables_", F.array().cast(_TABLES)).alias("tables"), "page_width", "page_height")


def decided(pages: DataFrame) -> DataFrame:
    """The engine of each page: text layer first, table probe only then."""
    heavy = routing.is_table_heavy(F.transform("tables", lambda t: F.size(t["rows"])))
    found = routing.engine(routing.has_text_layer(F.col("page_text")), heavy)
    return pages.withColumn("engine", F.when(F.col("image"), F.lit("pdfimagev5")).otherwise(found) if "image" in pages.columns else found)


def auto(pages: DataFrame) -> DataFrame:
    """Every page by the engine chosen for it, with ``engine``; see ``routing.majority`` for the document."""
    own = decided(pages)
    parts = [BY_NAME[name](own.where(F.col("engine") == name)).withColumn("engine", F.lit(name)) for name in ("pdftext", "pdftexttable", "pdfimagev5")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


BY_NAME = {"pdftext": pdftext, "pdftexttable": pdftexttable, "pdfimagev5": pdfimagev5, "pdfimagets": pdfimagets, "pdftxtimage": pdftxtimage, "pdfimagetable": pdfimagetable, "auto": auto}


def routed(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """The pages a mode looks at, with ``image``: whether their file counts as an image, of which there is one page.

    ``filename`` and ``content_type`` of the file decide, where ``pages`` has such columns; without both, files are PDFs.
    """
    if not {"filename", "content_type"} & set(pages.columns):
        return pages.withColumn("image", F.lit(False))
    name, kind = (F.col(c) if c in pages.columns else F.lit(None).cast("string") for c in ("filename", "content_type"))
    if mode == "auto":
        image = routing.auto_route(kind, name) == "ocr"
    elif mode in ("pdfimagev5", "pdfimagets"):
        image = ~routing.ocr_is_pdf(kind, name)
    else:
        image = F.lit(False)
    return pages.withColumn("image", image).where(~F.col("image") | (F.col("page_number") == 1))


def process(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """Response rows (doc_id, filename, method_used, processing_time_sec, pages) of a mode; unknown modes are ``auto``.

    The primitives are stored once, so that no page is decoded or recognised again for a second use.
    """
    mode = mode if mode in BY_NAME else "auto"
    pages = scratch.stored(pages, "pages")
    own = routed(pages, mode)
    results = BY_NAME[mode](own)
    if mode == "auto":
        results = results.join(routing.majority(decided(own)), "doc_id")  # a result for each page
    else:
        results = results.withColumn("method_used", F.lit(mode))
    name = F.max("filename") if "filename" in pages.columns else F.lit(None).cast("string")
    return normalize.responses(results.join(own.groupBy("doc_id").agg(name.alias("filename")), "doc_id"), mode=mode)


def process_uploads(files: DataFrame, mode: str = "auto", backend: str | backends.Backend = "json", max_bytes: int = routing.MAX_BYTES, max_pages: int = routing.MAX_PAGES) -> DataFrame:
    """One row per upload (doc_id, content, filename, content_type; ``length`` if known): status, detail and its response.

    413 and 400 are told before decoding, 500 for a file that cannot be decoded, 422 for more pages
    than allowed; none of these has a response. A file without pages has an empty response of the mode's name.
    """
    mode = mode if mode in BY_NAME else "auto"
    length = F.col("length") if "length" in files.columns else F.length("content")
    checked = routing.guards(files.withColumn("length", F.coalesce(length, F.lit(0)).cast("long")), max_bytes=max_bytes).select("doc_id", "filename", "content_type", "content", "status", "detail")
    read = scratch.stored(backends.decode(checked.where("status = 200").select("doc_id", "filename", "content_type", "content"), backend, keys=("doc_id", "filename", "content_type"), all_or_nothing=True), "decoded")
    failed = read.where("status = 'error'").select("doc_id", F.lit(500).alias("code"), F.concat(F.lit("processing failed: "), "error").alias("why"))
    pages = read.where("status = 'ok'").drop("status", "error")
    long = routed(pages, mode).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_pages)
    refused = failed.unionByName(long.select("doc_id", F.lit(422).alias("code"), F.lit("too many pages").alias("why")))
    done = process(scratch.stored(pages.join(refused, "doc_id", "left_anti"), "accepted"), mode).drop("filename")
    out = checked.drop("content", "content_type").join(refused, "doc_id", "left").join(done, "doc_id", "left")
    status = F.coalesce("code", "status")
    good = status == 200
    return out.select(
        "doc_id", status.alias("status"), F.coalesce("why", "detail").alias("detail"), F.when(good, X.or_else(F.col("filename"), normalize.NO_NAME)).alias("filename"),
        F.when(good, F.coalesce("method_used", F.lit(mode))).alias("method_used"), F.when(good, F.coalesce("processing_time_sec", F.lit(0.0))).alias("processing_time_sec"),
        F.when(good, F.coalesce("pages", F.array().cast(RESPONSE["pages"].dataType))).alias("pages"),
    )
