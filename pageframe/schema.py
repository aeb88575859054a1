"""Fixed schemas of the data model. ``unit`` and ``dpi`` go with pages whose coordinates are pixels."""

from __future__ import annotations

from pyspark.sql import types as T

_f = T.StructField
BBOX = T.StructType([_f(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
TEXT_BLOCK = T.StructType([_f("text", T.StringType()), _f("bbox", BBOX)])
PAGE_TABLE = T.StructType([_f("rows", T.ArrayType(T.ArrayType(T.StringType()))), _f("bbox", BBOX), _f("cells_bbox", T.ArrayType(T.ArrayType(BBOX)))])
PAGE_RESULT = T.StructType([
    _f("page_number", T.IntegerType()), _f("content", T.StringType()), _f("text_blocks", T.ArrayType(TEXT_BLOCK)),
    _f("tables", T.ArrayType(PAGE_TABLE)), _f("page_width", T.DoubleType()), _f("page_height", T.DoubleType()),
])
RESPONSE = T.StructType([_f("filename", T.StringType()), _f("method_used", T.StringType()), _f("processing_time_sec", T.DoubleType()), _f("pages", T.ArrayType(PAGE_RESULT))])
LINE = T.StructType([_f("text", T.StringType()), _f("confidence", T.DoubleType()), _f("box", T.ArrayType(T.ArrayType(T.DoubleType()))), _f("source", T.StringType())])
GLYPH = T.StructType([_f("doc_id", T.LongType()), _f("page_number", T.IntegerType()), _f("ord", T.LongType()), _f("text", T.StringType()), *(_f(n, T.DoubleType()) for n in ("x0", "top", "x1", "bottom"))])
#: What a decoding backend yields per page; all parts may be empty.
PRIMITIVES = T.StructType([
    _f("page_number", T.IntegerType()), _f("page_width", T.DoubleType()), _f("page_height", T.DoubleType()), _f("page_text", T.StringType()),
    _f("spans", T.ArrayType(T.StructType([_f("block", T.IntegerType()), _f("type", T.IntegerType()), _f("line", T.IntegerType()), _f("span", T.IntegerType()), _f("text", T.StringType()), _f("bbox", BBOX), _f("line_bbox", BBOX)]))),
    _f("glyphs", T.ArrayType(T.StructType([_f("text", T.StringType()), *(_f(n, T.DoubleType()) for n in ("x0", "top", "x1", "bottom"))]))),
    _f("tables", T.ArrayType(PAGE_TABLE)),
    _f("images", T.ArrayType(T.StructType([_f("bbox", BBOX), _f("items", T.ArrayType(T.StructType([_f("text", T.StringType()), _f("score", T.DoubleType())])))]))),
    _f("ocr", T.ArrayType(T.StructType([_f("text", T.StringType()), _f("score", T.DoubleType()), _f("polygon", T.ArrayType(T.ArrayType(T.DoubleType())))]))),
])
# The names of the modes.
MODES = ("auto", "pdftext", "pdftexttable", "pdfimagev5", "pdfimagets", "pdftxtimage", "pdfimagetable")
