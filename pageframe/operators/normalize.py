"""Loose page JSON to the fixed schema, and the response document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G, text as X
from ..schema import BBOX, PAGE_RESULT, RESPONSE

# Fixed value: the name of a response without a file name.
NO_NAME = "unknown"

_RAW = "array<string>"  # from_json keeps nested JSON as text in string elements


def items(json: Column) -> Column:
    """Elements of a JSON array as JSON texts; null for anything else."""
    return F.when(F.ltrim(json).startswith("["), F.from_json(json, _RAW))


def _is(json: Column, sign: str) -> Column:
    return F.coalesce(F.ltrim(json).startswith(sign), F.lit(False))



def text_blocks(json: Column) -> Column:
    """Blocks from objects (text, bbox) or [text, bbox] arrays; other shapes drop; boxes default to zeros."""
    box = lambda raw: F.coalesce(G.coerce_box(raw), G.zero_box())
    get = F.get_json_object
    block = lambda b: F.when(
        _is(b, "{"), F.struct(F.coalesce(get(b, "$.text"), F.lit("")).alias("text"), box(get(b, "$.bbox")).alias("bbox"))
    ).when(_is(b, "[") & (F.json_array_length(b) >= 2), F.struct(F.coalesce(F.get(items(b), 0), F.lit("None")).alias("text"), box(F.get(items(b), 1)).alias("bbox")))
    return F.coalesce(F.filter(F.transform(items(json), block), lambda b: b.isNotNull()), F.array().cast("array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>"))


def _row(json: Column) -> Column:
    """Cells of one row: a list as it is, an object's values by sorted key, anything else as one cell."""
    values = X.dict_row(F.from_json(json, "map<string,string>"))
    return F.when(_is(json, "["), items(json)).when(_is(json, "{"), values).otherwise(F.array(json))


def rows_of(json: Column) -> Column:
    """rows of a table: cells as texts; a flat list is one row, a scalar row one cell, an object its values by key."""
    first = F.get(items(json), 0)
    flat = first.isNotNull() & ~_is(first, "[") & ~_is(first, "{")
    return F.coalesce(F.when(flat, F.array(items(json))).otherwise(F.transform(items(json), _row)), F.array().cast("array<array<string>>"))


def cell_boxes(json: Column) -> Column:
    """Boxes of cells, null where a cell has none; a row that is no list is one cell; null for an empty list."""
    rows = F.transform(items(json), lambda r: F.when(_is(r, "[") & ~_is(F.get(items(r), 0), "["), F.when(F.coalesce(F.get(items(r), 0).rlike("^-?[0-9]"), F.lit(False)), F.array(G.coerce_box(r))).otherwise(F.transform(items(r), lambda c: G.coerce_box(c)))).when(_is(r, "["), F.transform(items(r), lambda c: G.coerce_box(c))).otherwise(F.array(G.coerce_box(r))))
    return F.when(F.size(items(json)) > 0, rows)


def tables(json: Column) -> Column:
    """Tables from objects (rows, bbox, cells_bbox) or lists of rows; any other value is an empty table."""
    get = F.get_json_object
    kind = f"struct<rows:array<array<string>>,bbox:{BBOX.simpleString()},cells_bbox:array<array<{BBOX.simpleString()}>>>"
    table = lambda rows, box, cells: F.struct(rows.alias("rows"), box.alias("bbox"), cells.alias("cells_bbox")).cast(kind)
    none = F.lit(None)
    from_list = lambda t: F.transform(items(t), _row)
    one = lambda t: (
        F.when(_is(t, "{"), table(rows_of(get(t, "$.rows")), G.coerce_box(get(t, "$.bbox")), cell_boxes(get(t, "$.cells_bbox"))))
        .when(_is(t, "["), table(from_list(t), none, none))
        .otherwise(table(F.array().cast("array<array<string>>"), none, none))
    )
    return F.coalesce(F.transform(items(json), one), F.array().cast(f"array<{kind}>"))


def page(page_number: Column, content: Column, blocks: Column, tabs: Column, width: Column, height: Column) -> Column:
    """One page of the response, with the defaults of its fields."""
    return F.struct(
        page_number.cast("int").alias("page_number"), F.coalesce(content, F.lit("")).alias("content"),
        F.coalesce(blocks, F.array().cast(PAGE_RESULT["text_blocks"].dataType)).alias("text_blocks"), F.coalesce(tabs, F.array().cast(PAGE_RESULT["tables"].dataType)).alias("tables"),
        width.cast("double").alias("page_width"), height.cast("double").alias("page_height"),
    )


def responses(pages: DataFrame, doc: str = "doc_id", filename: str = "filename", method: str = "method_used", elapsed: str | None = None, mode: str = "auto") -> DataFrame:
    """One row per document: filename, method_used (the mode where there is none), processing_time_sec, pages by number."""
    seconds = F.bround(F.max(elapsed), 3) if elapsed else F.lit(0.0)
    every = F.array_sort(F.collect_list(page(*(F.col(c) for c in ("page_number", "content", "text_blocks", "tables", "page_width", "page_height")))), lambda a, b: a["page_number"] - b["page_number"])
    out = pages.groupBy(doc).agg(X.or_else(F.max(filename), NO_NAME).alias("filename"), X.or_else(F.max(method), mode).alias("method_used"), seconds.alias("processing_time_sec"), every.alias("pages"))
    return out


def encode(response: Column) -> Column:
    return F.to_json(response, {"ignoreNullFields": "false"})


def decode(json: Column) -> Column:
    return F.from_json(json, RESPONSE)
