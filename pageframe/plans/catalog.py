"""The registered queries over the derived layout tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as G, text as X
from ..operators import grid, image, lines as L, normalize, routing, spatial as S
from ..sources import backends, files, fixtures as fx, scratch
from ..streaming import drop
from . import modes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PAGE = ["doc_id", "page_number"]
_WS = r"[\s\x{85}\x{a0}\p{Z}\x{1c}-\x{1f}]"


def _strip(e: str) -> str:
    return rf"regexp_replace({e}, '^{_WS}+|{_WS}+$', '', 'g')"


def _trim(e: str) -> str:
    return rf"regexp_replace({e}, '^[\s\x{{85}}\x{{a0}}\p{{Z}}\x{{feff}}]+|[\s\x{{85}}\x{{a0}}\p{{Z}}\x{{feff}}]+$', '', 'g')"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL over tables and layout views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = fx.with_views(sql)
        return f

    return add


def _overlap(a: str, b: str) -> str:
    side = lambda lo, hi: f"greatest(0, least({a}.{hi}, {b}.{hi}) - greatest({a}.{lo}, {b}.{lo}))"
    return f"({side('x0', 'x1')} * {side('y0', 'y1')})"


def _area(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


# lines and pages


@query(f"SELECT doc_id, page_number, ord, text, x0, y0, x1, y1, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ord) AS line_no FROM fx_lines WHERE {_strip('text')} <> ''")
def doc_lines(spark, d):
    return routing.numbered(L.not_blank(fx.lines(spark, d)), PAGE, ["ord"], "line_no").withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY ord) AS content, count(*) AS n FROM fx_lines GROUP BY doc_id, page_number")
def lines_with_blanks(spark, d):
    return fx.lines(spark, d).groupBy(*PAGE).agg(L.ordered_text(["ord"], sep="\n").alias("content"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, page_number, {_strip("string_agg(text, chr(10) ORDER BY ord)")} AS content, count(*) AS n_blocks, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
FROM fx_lines WHERE {_strip('text')} <> '' GROUP BY doc_id, page_number""")
def pdftext_pages(spark, d):
    """Flagship: pages of mode pdftext from document lines, with the union of their blocks."""
    pages = L.pages_of(L.not_blank(fx.lines(spark, d)), ["ord"])
    union = G.union_box(F.transform("text_blocks", lambda b: b["bbox"]))
    return pages.select(*PAGE, "content", F.size("text_blocks").cast("long").alias("n_blocks"), *(union[n].alias(n) for n in ("x0", "y0", "x1", "y1")))


_PAGE_TEXT = "pt AS (SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY ord) AS text, count(*) FILTER (contains(text, ' | ')) AS n_rows FROM fx_lines GROUP BY ALL)"


def _page_text(spark, d):
    return fx.lines(spark, d).groupBy(*PAGE).agg(L.ordered_text(["ord"], sep="\n").alias("text"), F.count_if(F.contains("text", F.lit(" | "))).alias("n_rows"))


@query(f"WITH {_PAGE_TEXT} SELECT doc_id, page_number, length({_strip('text')}) >= 20 AS has_text FROM pt")
def text_layer_flag(spark, d):
    return _page_text(spark, d).select(*PAGE, routing.has_text_layer(F.col("text")).alias("has_text"))


@query(f"WITH {_PAGE_TEXT} SELECT doc_id, page_number, n_rows >= 2 AS table_heavy FROM pt")
def table_heavy_flag(spark, d):
    return _page_text(spark, d).select(*PAGE, routing.is_table_heavy(F.array("n_rows")).alias("table_heavy"))


_ENGINE = f"CASE WHEN length({_strip('text')}) >= 20 AND n_rows >= 2 THEN 'pdftexttable' WHEN length({_strip('text')}) >= 20 THEN 'pdftext' ELSE 'pdfimagev5' END"


def _engines(spark, d):
    return _page_text(spark, d).select(*PAGE, routing.engine(routing.has_text_layer(F.col("text")), routing.is_table_heavy(F.array("n_rows"))).alias("engine"))


@query(f"WITH {_PAGE_TEXT} SELECT doc_id, page_number, {_ENGINE} AS engine FROM pt")
def auto_engine(spark, d):
    return _engines(spark, d)


@query(f"""WITH {_PAGE_TEXT}, e AS (SELECT doc_id, {_ENGINE} AS engine, count(*) AS n FROM pt GROUP BY ALL)
SELECT doc_id, engine AS method_used FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, engine) = 1""")
def auto_method_used(spark, d):
    return routing.majority(_engines(spark, d))


@query(f"WITH {_PAGE_TEXT} SELECT DISTINCT doc_id, {_ENGINE} AS engine FROM pt")
def distinct_methods(spark, d):
    return _engines(spark, d).select("doc_id", "engine").distinct()


# routing and guards

_TYPES, _NAMES, _MODES = ("image/jpeg", "IMAGE/PNG", "image/bmp", "application/pdf", "text/plain", None), ("a.pdf", "b.PDF", "c.png", "d", ".pdf", None), ("auto", "pdftext", "nonsense", None)


def _listed(items) -> str:
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in items) + "]"


@query(f"""SELECT doc_id, coalesce(m, '') AS mode_in, coalesce(t, '') AS type_in, coalesce(n, '') AS name_in,
 CASE WHEN m IN ('auto', 'pdftext', 'pdftexttable', 'pdfimagev5', 'pdfimagets', 'pdftxtimage', 'pdfimagetable') THEN m ELSE 'auto' END AS mode,
 CASE WHEN lower(t) IN ('image/jpeg', 'image/png', 'image/jpg') THEN 'ocr' WHEN lower(t) = 'application/pdf' OR lower(n) IN ('a.pdf', 'b.pdf') THEN 'pdf' ELSE 'ocr' END AS route,
 coalesce(lower(t) = 'application/pdf', false) OR coalesce(lower(n) IN ('a.pdf', 'b.pdf'), false) AS is_pdf
FROM (SELECT o_orderkey AS doc_id, {_listed(_MODES)}[o_orderkey % 4 + 1] AS m, {_listed(_TYPES)}[o_orderkey // 4 % 6 + 1] AS t, {_listed(_NAMES)}[o_orderkey // 24 % 6 + 1] AS n FROM orders)""")
def mode_route_matrix(spark, d):
    """A mode, a type and a name for each order, in all combinations."""
    pick = lambda xs, at: F.get(F.array(*(F.lit(x).cast("string") for x in xs)), F.expr(f"cast({at} as int)"))
    rows = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), pick(_MODES, "o_orderkey % 4").alias("m"), pick(_TYPES, "o_orderkey div 4 % 6").alias("t"), pick(_NAMES, "o_orderkey div 24 % 6").alias("n"))
    return rows.select("doc_id", *(F.coalesce(a, F.lit("")).alias(b) for a, b in (("m", "mode_in"), ("t", "type_in"), ("n", "name_in"))), routing.mode(F.col("m")).alias("mode"), routing.auto_route(F.col("t"), F.col("n")).alias("route"), routing.ocr_is_pdf(F.col("t"), F.col("n")).alias("is_pdf"))


@query(r"""WITH f AS (SELECT page_id, length(html) AS length, length(html) // 20 AS n_pages, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)
SELECT page_id, CASE WHEN length > 8000 THEN 413 WHEN length = 0 THEN 400 WHEN n_pages > 300 THEN 422 ELSE 200 END AS status,
 CASE WHEN length > 8000 THEN 'file too large' WHEN length = 0 THEN 'empty file' WHEN n_pages > 300 THEN 'too many pages' END AS detail,
 coalesce(nullif(regexp_replace(substr(coalesce(nullif(name, ''), 'upload'), 1, 80), '[^\p{L}\p{N}._\- ]', '', 'g'), ''), 'upload') AS filename FROM f""")
def upload_guards(spark, d):
    f = fx.table(spark, d, "pages").select("page_id", F.length("html").alias("length"), F.expr("length(html) div 20").alias("n_pages"), F.regexp_extract("url", "([^/]*)$", 1).alias("name"))
    return routing.guards(f, pages="n_pages", max_bytes=8000, max_pages=300).select("page_id", "status", "detail", X.safe_name(F.col("name")).alias("filename"))


@query("SELECT l.* FROM fx_lines l JOIN (VALUES (0, 0), (1, 2), (2, 0), (3, 99)) AS r(request, page_index) ON page_number = page_index + 1".replace("l.*", "request, doc_id, page_number, ord, text"))
def page_select(spark, d):
    requested = spark.createDataFrame([(0, 0), (1, 2), (2, 0), (3, 99)], "request int, page_index int")
    return routing.select_pages(fx.lines(spark, d), requested).select("request", "doc_id", "page_number", "ord", "text")


@query("SELECT doc_id, page_number, count(*) AS n FROM fx_lines WHERE page_number <= 2 GROUP BY ALL")
def page_cap(spark, d):
    return routing.page_cap(fx.lines(spark, d), 2).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT DISTINCT doc_id, page_number FROM fx_lines), c AS (SELECT doc_id, page_number, {_strip("string_agg(text, chr(10) ORDER BY ord)")} AS content FROM fx_lines WHERE page_number % 2 = 1 GROUP BY ALL)
SELECT doc_id, page_number, coalesce(content, '') AS content FROM p LEFT JOIN c USING (doc_id, page_number)""")
def stub_pages(spark, d):
    own = fx.lines(spark, d)
    return routing.with_stubs(own.select(*PAGE).distinct(), L.content(own.where("page_number % 2 = 1"), ["ord"]))


# glyphs


@query(f"""SELECT doc_id, page_number, top AS line_y, string_agg(text, '' ORDER BY x0, ord, word_ord) AS text, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1
FROM fx_words GROUP BY doc_id, page_number, top HAVING {_strip("string_agg(text, '' ORDER BY x0, ord, word_ord)")} <> ''""")
def glyph_lines_exact(spark, d):
    g = fx.words(spark, d).withColumn("ord", F.struct("ord", "word_ord"))
    return L.not_blank(L.glyph_lines(g)).select(*PAGE, "line_y", "text", "x0", "y0", "x1", "y1")


@query(f"""WITH q AS (SELECT *, round_even(top / 3, 0) * 3 AS line_y FROM fx_words)
SELECT doc_id, page_number, line_y, {_strip("string_agg(text, '' ORDER BY x0, top, ord, word_ord)")} AS text, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1
FROM q GROUP BY doc_id, page_number, line_y HAVING {_strip("string_agg(text, '' ORDER BY x0, top, ord, word_ord)")} <> ''""")
def glyph_lines_tolerant(spark, d):
    g = fx.words(spark, d).withColumn("ord", F.struct("ord", "word_ord"))
    return L.not_blank(L.glyph_lines(g, 3.0), keep_raw=False).select(*PAGE, "line_y", "text", "x0", "y0", "x1", "y1")


@query("SELECT doc_id, page_number, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1 FROM fx_words GROUP BY ALL")
def bbox_union_page(spark, d):
    return fx.words(spark, d).groupBy(*PAGE).agg(G.union_agg("x0", "top", "x1", "bottom").alias("b")).select(*PAGE, "b.*")


@query(f"""SELECT doc_id, page_number, string_agg(text, ' ' ORDER BY ord, word_ord) AS content, count(*) AS n, min(x0) AS x0, max(bottom) AS y1 FROM fx_words WHERE {_strip('text')} <> '' GROUP BY doc_id, page_number""")
def ocr_word_content(spark, d):
    w = fx.words(spark, d).withColumns({"left": F.col("x0"), "width": F.col("x1") - F.col("x0"), "height": F.col("bottom") - F.col("top")})
    w = L.ocr_lines(w, drop_blank=True).withColumn("b", G.ltwh_box("left", "top", "width", "height")).drop("x0", "x1").select("*", "b.*")
    p = L.pages_of(w, ["ord", "word_ord"], " ", stripped=False)
    u = G.union_box(F.transform("text_blocks", lambda b: b["bbox"]))
    return p.select(*PAGE, "content", F.size("text_blocks").cast("long").alias("n"), u["x0"].alias("x0"), u["y1"].alias("y1"))


@query("""SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY ord) AS content, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM fx_lines WHERE text <> '' GROUP BY doc_id, page_number""")
def ocr_line_content(spark, d):
    own = fx.lines(spark, d).withColumn("polygon", G.box_polygon(G.box("x0", "y0", "x1", "y1"))).drop("x0", "y0", "x1", "y1")
    own = L.ocr_lines(own, drop_blank=False).withColumn("b", G.polygon_box(F.col("polygon"))).select("*", "b.*")
    p = L.pages_of(own, ["ord"], stripped=False)
    u = G.union_box(F.transform("text_blocks", lambda b: b["bbox"]))
    return p.select(*PAGE, "content", *(u[n].alias(n) for n in ("x0", "y0", "x1", "y1")))


# tables


@query("SELECT doc_id, page_number, table_idx, row_idx, string_agg(coalesce(text, ''), ' | ' ORDER BY col_idx) AS text FROM fx_cells GROUP BY doc_id, page_number, table_idx, row_idx")
def table_rows_text(spark, d):
    return S.table_text(fx.cells(spark, d))


def _nested(spark, d, docs=None) -> DataFrame:
    """Tables as nested rows and cell boxes."""
    rows = fx.cells(spark, d, docs).groupBy(*PAGE, "table_idx", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "text", G.box("x0", "y0", "x1", "y1").alias("b")))).alias("c"))
    r = rows.groupBy(*PAGE, "table_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", "c"))).alias("r"))
    return r.select(*PAGE, "table_idx", F.transform("r", lambda x: F.transform(x["c"], lambda c: c["text"])).alias("rows"), F.transform("r", lambda x: F.transform(x["c"], lambda c: c["b"])).alias("cells_bbox"), G.union_box(F.flatten(F.transform("r", lambda x: F.transform(x["c"], lambda c: c["b"])))).alias("bbox"))


@query("SELECT doc_id, page_number, table_idx, row_idx, col_idx, coalesce(text, '') AS text, x0, y0, x1, y1 FROM fx_cells")
def table_cells(spark, d):
    c = S.table_cells(_nested(spark, d))
    return c.select(*PAGE, "table_idx", F.col("row_idx").cast("long").alias("row_idx"), F.col("col_idx").cast("long").alias("col_idx"), "text", "cell.*")


# spatial joins


@query(f"SELECT l.* FROM fx_order_lines l WHERE NOT EXISTS (SELECT 1 FROM fx_tables t WHERE t.doc_id = l.doc_id AND t.page_number = l.page_number AND {_area('l')} > 0 AND {_overlap('l', 't')} >= 0.5 * {_area('l')})")
def lines_outside_tables(spark, d):
    return S.outside_tables(fx.order_lines(spark, d), fx.tables(spark, d))


@query("SELECT * FROM fx_images WHERE x1 - x0 >= 5 AND y1 - y0 >= 5")
def image_size_filter(spark, d):
    return S.image_size(fx.images(spark, d))


_BIG = "SELECT * FROM fx_images WHERE x1 - x0 >= 5 AND y1 - y0 >= 5"
_MATCH = f"""im AS ({_BIG}), m AS (SELECT i.doc_id, i.page_number, i.ord, min({{'t': table_idx, 'r': row_idx, 'c': col_idx}}) AS cell FROM im i JOIN fx_cells c ON i.doc_id = c.doc_id AND i.page_number = c.page_number
 AND {_area('c')} > 0 AND (CASE WHEN {_area('c')} > 0 THEN {_overlap('i', 'c')} / {_area('c')} ELSE 0 END >= 0.2 OR (CASE WHEN {_area('i')} > 0 THEN {_overlap('i', 'c')} / {_area('i')} ELSE 0 END) >= 0.5) GROUP BY ALL)"""


@query(f"WITH {_MATCH} SELECT doc_id, page_number, ord, cell.t AS table_idx, cell.r AS row_idx, cell.c AS col_idx FROM m")
def image_to_cell(spark, d):
    return S.image_to_cell(S.image_size(fx.images(spark, d)), fx.cells(spark, d))


# one key for the match and the cell: few rows on one side of each join
_ADDED = f"""{_MATCH}, a AS (SELECT doc_id || ':' || page_number || ':' || cell.t || ':' || cell.r || ':' || cell.c AS k, string_agg(ocr_text, ' ' ORDER BY ord) AS added FROM (SELECT m.*, ocr_text FROM m JOIN im USING (doc_id, page_number, ord) WHERE ocr_text <> '') GROUP BY 1),
fc AS (SELECT *, doc_id || ':' || page_number || ':' || table_idx || ':' || row_idx || ':' || col_idx AS k FROM fx_cells)"""
_FILLED = f"CASE WHEN added IS NULL THEN text ELSE {_strip("concat_ws(' ', nullif(text, ''), added)")} END"


@query(f"WITH {_ADDED} SELECT doc_id, page_number, table_idx, row_idx, col_idx, {_FILLED} AS text, x0, y0, x1, y1 FROM fc LEFT JOIN a USING (k)")
def cells_with_ocr(spark, d):
    images, own = S.image_size(fx.images(spark, d)), fx.cells(spark, d)
    matched = S.image_to_cell(images, own).join(images.select(*PAGE, "ord", "ocr_text"), [*PAGE, "ord"])
    return S.cells_with_ocr(own, matched).select(*PAGE, "table_idx", "row_idx", "col_idx", "text", "x0", "y0", "x1", "y1")


_DEDUP = f"""im AS ({_BIG}), d AS (SELECT i.* FROM im i WHERE NOT EXISTS (SELECT 1 FROM fx_order_lines l WHERE l.doc_id = i.doc_id AND l.page_number = i.page_number
 AND {_area('i')} > 0 AND {_overlap('i', 'l')} > 0.5 * {_area('i')} AND ((l.text <> '' AND contains(i.ocr_text, l.text)) OR contains(l.text, i.ocr_text))))"""


@query(f"WITH {_DEDUP} SELECT * FROM d")
def image_dedup(spark, d):
    return S.image_dedup(S.image_size(fx.images(spark, d)), fx.order_lines(spark, d))


@query("""SELECT doc_id, page_number, image_ord, regexp_replace(string_agg(trim(text), ' ' ORDER BY item_ord) FILTER (text <> ''), '^ +| +$', '', 'g') AS ocr_text, coalesce(avg(score), 0.9) AS confidence
FROM fx_ocr_items GROUP BY doc_id, page_number, image_ord HAVING trim(coalesce(string_agg(trim(text), ' ') FILTER (text <> ''), '')) <> ''""")
def image_text(spark, d):
    return L.image_text(fx.ocr_items(spark, d), [*PAGE, "image_ord"])


@query(f"""WITH {_DEDUP}, u AS (SELECT doc_id, page_number, 0 AS kind, ord, text, 1.0::DOUBLE AS confidence, 'native' AS source, x0, y0 FROM fx_order_lines UNION ALL SELECT doc_id, page_number, 1, ord, ocr_text, coalesce(score, 0.9), 'ocr_image', x0, y0 FROM d)
SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, kind, ord) AS n, text, confidence, source FROM u""")
def hybrid_lines(spark, d):
    native = fx.order_lines(spark, d)
    images = S.image_dedup(S.image_size(fx.images(spark, d)), native)
    both = native.select(*PAGE, F.lit(0).alias("kind"), F.col("ord").cast("long").alias("ord"), "text", F.lit(1.0).alias("confidence"), F.lit("native").alias("source"), "x0", "y0").unionByName(
        images.select(*PAGE, F.lit(1).alias("kind"), "ord", F.col("ocr_text").alias("text"), F.coalesce("score", F.lit(0.9)).alias("confidence"), F.lit("ocr_image").alias("source"), "x0", "y0"))
    return routing.numbered(both, PAGE, ["y0", "x0", "kind", "ord"]).select(*PAGE, F.col("n").cast("long").alias("n"), "text", "confidence", "source")


@query(f"""WITH {_DEDUP}, u AS (SELECT doc_id, page_number, 0 AS kind, ord, text, x0, y0 FROM fx_order_lines UNION ALL SELECT doc_id, page_number, 1, ord, ocr_text, x0, y0 FROM d)
SELECT doc_id, page_number, {_strip("string_agg(text, chr(10) ORDER BY y0, x0, kind, ord)")} AS content, count(*) AS n FROM u GROUP BY doc_id, page_number""")
def hybrid_content(spark, d):
    return hybrid_lines(spark, d).groupBy(*PAGE).agg(X.strip(L.ordered_text(["n"], sep="\n")).alias("content"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH k AS (SELECT l.* FROM fx_order_lines l WHERE NOT EXISTS (SELECT 1 FROM fx_tables t WHERE t.doc_id = l.doc_id AND t.page_number = l.page_number AND {_overlap('l', 't')} >= 0.5 * {_area('l')})),
r AS (SELECT doc_id, page_number, table_idx, row_idx, string_agg(coalesce(text, ''), ' | ' ORDER BY col_idx) AS text FROM fx_cells GROUP BY ALL),
t AS (SELECT r.doc_id, r.page_number, r.table_idx, string_agg(text, chr(10) ORDER BY row_idx) AS text, any_value(y0) AS y0, any_value(x0) AS x0 FROM r JOIN fx_tables USING (doc_id, page_number, table_idx) GROUP BY ALL),
u AS (SELECT doc_id, page_number, y0, x0, 0 AS kind, ord, text FROM k UNION ALL SELECT doc_id, page_number, y0, x0, 1, table_idx, text FROM t)
SELECT doc_id, page_number, {_strip("string_agg(text, chr(10) ORDER BY y0, x0, kind, ord)")} AS content FROM u GROUP BY doc_id, page_number""")
def reading_order_content(spark, d):
    own = S.table_text(fx.cells(spark, d)).groupBy(*PAGE, "table_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "text"))), lambda r: r["text"]).alias("lines"))
    tabs = own.join(fx.tables(spark, d), [*PAGE, "table_idx"]).select(*PAGE, "y0", "x0", F.col("table_idx").alias("ord"), "lines")
    return S.reading_order(S.outside_tables(fx.order_lines(spark, d), fx.tables(spark, d)), tabs)


# normalising

_BOXES = ("[1,2,3,4]", "[1,2,3]", '{"x0":1,"top":2,"x1":3,"bottom":4}', "{}", '{"y0":5,"top":9}', "null", "7", "[1,2,3,4,5]")


@query("""WITH v(i, box) AS (VALUES (0, {'x0': 1::DOUBLE, 'y0': 2::DOUBLE, 'x1': 3::DOUBLE, 'y1': 4::DOUBLE}), (1, NULL), (2, {'x0': 1, 'y0': 2, 'x1': 3, 'y1': 4}), (3, {'x0': 0, 'y0': 0, 'x1': 0, 'y1': 0}), (4, {'x0': 0, 'y0': 5, 'x1': 0, 'y1': 0}), (5, NULL), (6, NULL), (7, {'x0': 1, 'y0': 2, 'x1': 3, 'y1': 4}))
SELECT o_orderkey AS doc_id, i::INT AS i, box.x0 AS x0, box.y0 AS y0, box.x1 AS x1, box.y1 AS y1 FROM orders, v""")
def bbox_coerce(spark, d):
    rows = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(*map(F.lit, _BOXES))).alias("i", "v"))
    b = G.coerce_box(F.col("v"))
    return rows.select("doc_id", "i", *(b[n].alias(n) for n in ("x0", "y0", "x1", "y1")))


@query("SELECT doc_id, page_number, table_idx, row_idx, col_idx, coalesce(text, '') AS text, x0, y0, x1, y1 FROM fx_cells")
def normalize_tables(spark, d):
    """Tables through loose JSON and the normaliser, back to cells."""
    raw = _nested(spark, d).withColumn("json", F.to_json(F.array(F.struct("rows", F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1").alias("bbox"), "cells_bbox")), {"ignoreNullFields": "false"})).drop("rows", "cells_bbox", "bbox")
    t = raw.select(*PAGE, F.posexplode(normalize.tables(F.col("json"))).alias("table_idx", "t")).select(*PAGE, "table_idx", "t.*")
    return S.table_cells(t).select(*PAGE, "table_idx", F.col("row_idx").cast("long").alias("row_idx"), F.col("col_idx").cast("long").alias("col_idx"), "text", "cell.*")


@query("SELECT doc_id, page_number, ord, x0 * 72 / 150 AS x0, y0 * 72 / 150 AS y0 FROM fx_lines WHERE page_number % 2 = 0 UNION ALL SELECT doc_id, page_number, ord, x0, y0 FROM fx_lines WHERE page_number % 2 = 1".replace("x0 * 72 / 150", "x0 * (72.0::DOUBLE / 150)").replace("y0 * 72 / 150", "y0 * (72.0::DOUBLE / 150)"))
def unit_normalize(spark, d):
    own = fx.lines(spark, d).withColumns({"unit": F.when(F.col("page_number") % 2 == 0, "px").otherwise("pt"), "dpi": F.lit(150)})
    b = G.to_points(G.box("x0", "y0", "x1", "y1"), F.col("unit"), F.col("dpi"))
    return own.select(*PAGE, "ord", b["x0"].alias("x0"), b["y0"].alias("y0"))


@query(f"""WITH p AS (SELECT doc_id, page_number, {_strip("string_agg(text, chr(10) ORDER BY ord)")} AS content, count(*) AS n FROM fx_lines WHERE {_strip('text')} <> '' GROUP BY doc_id, page_number)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'f' || doc_id || '.pdf' END AS filename, CASE WHEN doc_id % 2 = 0 THEN 'auto' ELSE 'pdftext' END AS method_used, count(*) AS n_pages, sum(n)::BIGINT AS n_blocks, string_agg(content, chr(12) ORDER BY page_number) AS contents FROM p GROUP BY doc_id""")
def response_json(spark, d):
    """Responses encoded to JSON and decoded again."""
    p = L.pages_of(L.not_blank(fx.lines(spark, d)), ["ord"]).withColumns({"tables": F.lit(None), "page_width": F.lit(612.0), "page_height": F.lit(792.0),
        "filename": F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "")).otherwise(F.concat(F.lit("f"), F.col("doc_id"), F.lit(".pdf"))), "method_used": F.when(F.col("doc_id") % 2 == 0, "").otherwise("pdftext")})
    r = normalize.responses(p, mode="auto")
    back = r.select("doc_id", normalize.decode(normalize.encode(F.struct("filename", "method_used", "processing_time_sec", "pages"))).alias("r")).select("doc_id", "r.*")
    return back.select("doc_id", "filename", "method_used", F.size("pages").cast("long").alias("n_pages"), F.aggregate("pages", F.lit(0).cast("long"), lambda a, x: a + F.size(x["text_blocks"])).alias("n_blocks"), F.array_join(F.transform("pages", lambda x: x["content"]), "\f").alias("contents"))


# grid


def _grid_items(spark, d) -> DataFrame:
    blocks = fx.order_lines(spark, d).withColumn("bbox", G.box("x0", "y0", "x1", "y1"))
    a = grid.block_items(blocks, PAGE)
    c = fx.cells(spark, d).withColumns({"cell": F.when(F.col("text").isNotNull(), G.box("x0", "y0", "x1", "y1")), "bbox": G.box(72.0, 200.0, 432.0, 500.0)})
    b = grid.cell_items(c, PAGE, F.lit(15), F.lit(4), F.lit(1000) + F.col("row_idx") * 4 + F.col("col_idx"))
    return a.unionByName(b)


_ITEMS = f"""gi AS (SELECT doc_id, page_number, y0 AS y, x0 AS x, ord::BIGINT AS ord, {_trim("replace(text, chr(13) || chr(10), chr(10))")} AS text FROM fx_order_lines WHERE {_trim("text")} <> ''
 UNION ALL SELECT doc_id, page_number, y0, x0, (1000 + row_idx * 4 + col_idx)::BIGINT, {_trim("text")} FROM fx_cells WHERE coalesce({_trim("text")}, '') <> '')"""
_ROWS = f"""{_ITEMS}, gl AS (SELECT doc_id, page_number, list({{'y': y, 'x': x, 'ord': ord, 'text': text}} ORDER BY y, x, ord) AS l FROM gi GROUP BY ALL),
gf AS (SELECT doc_id, page_number, l, list_reduce(l, lambda a, i: CASE WHEN a.anchor IS NULL OR i.y - a.anchor > 6 THEN {{'row': a.row + 1, 'anchor': i.y, 'out': list_append(a.out, a.row + 1)}} ELSE {{'row': a.row, 'anchor': a.anchor, 'out': list_append(a.out, a.row)}} END,
 {{'row': -1, 'anchor': NULL::DOUBLE, 'out': []::INT[]}}).out AS r FROM gl),
gr AS (SELECT doc_id, page_number, unnest(l) AS i, unnest(r) AS row FROM gf)"""


@query(f"WITH {_ITEMS} SELECT * FROM gi")
def grid_items(spark, d):
    return _grid_items(spark, d)


@query(f"WITH {_ROWS} SELECT doc_id, page_number, row::INT AS row, i.x AS x, i.ord AS ord, i.text AS text FROM gr")
def grid_rows(spark, d):
    return grid.rows(_grid_items(spark, d), PAGE)


_TEXT = f"""{_ROWS}, gs AS (SELECT doc_id, page_number, row, list({{'c': floor(i.x / 8 + 0.5)::INT, 't': i.text}} ORDER BY i.x, i.ord) AS s FROM gr GROUP BY ALL),
gt AS (SELECT doc_id, page_number, row, rtrim(list_reduce(s, lambda a, e: {{'d': rpad(a.d, greatest(e.c, length(a.d) + 1)::INT, ' ') || e.t}}, {{'d': ''}}).d) AS line FROM gs),
gp AS (SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY row) AS grid FROM gt GROUP BY ALL)"""
_TEXT = _TEXT.replace("{{'d'", "{'d'").replace("|| e.t}}", "|| e.t}").replace("''}}", "''}")


@query(f"WITH {_TEXT} SELECT * FROM gp")
def grid_text(spark, d):
    return grid.page_text(_grid_items(spark, d), PAGE)


@query(f"""WITH {_TEXT} SELECT doc_id, coalesce(nullif({_trim("grid")}, ''), '(Bu sayfada metin yok)') AS text FROM gp""")
def grid_document(spark, d):
    return grid.document_text(grid.page_text(_grid_items(spark, d), PAGE))


@query(None)
def grid_text_exact(spark, d):
    """The original's item order; a sort by a comparison that is not transitive has no SQL."""
    return grid.exact_text(_grid_items(spark, d), PAGE)


@query("""SELECT o_orderkey AS doc_id, greatest(4, least(20, CASE WHEN v = 0 THEN 8 ELSE v END))::DOUBLE AS char_width, greatest(6, least(30, CASE WHEN v = 0 THEN 12 ELSE v END))::DOUBLE AS line_height, greatest(1, least(20, CASE WHEN v = 0 THEN 6 ELSE v END))::DOUBLE AS y_threshold FROM (SELECT o_orderkey, o_orderkey % 40 AS v FROM orders)""")
def grid_parameters(spark, d):
    v = (F.col("o_orderkey") % 40).cast("double")
    a, b, c = grid.parameters(v, v, v)
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), a.alias("char_width"), b.alias("line_height"), c.alias("y_threshold"))


# images


@query("""WITH b AS (SELECT doc_id, ascii(c) AS level, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE ascii(c) BETWEEN 1 AND 255 GROUP BY ALL),
v AS (SELECT doc_id, t, coalesce(n, 0)::DOUBLE AS c FROM (SELECT DISTINCT doc_id, unnest(range(256)) AS t FROM b) LEFT JOIN b ON b.doc_id = _doc AND level = t), """.replace("SELECT doc_id, t, coalesce(n, 0)::DOUBLE AS c FROM (SELECT DISTINCT doc_id, unnest(range(256)) AS t FROM b) LEFT JOIN b ON b.doc_id = _doc AND level = t", "SELECT k.doc_id, t, coalesce(n, 0)::DOUBLE AS c FROM (SELECT doc_id, unnest(range(256)) AS t FROM (SELECT DISTINCT doc_id FROM b)) k LEFT JOIN b ON b.doc_id = k.doc_id AND level = t") + """
s AS (SELECT doc_id, t, sum(c) OVER u AS w, sum(c * t) OVER u AS m, sum(c) OVER a AS ww, sum(c * t) OVER a AS mm FROM v WINDOW u AS (PARTITION BY doc_id ORDER BY t), a AS (PARTITION BY doc_id)),
o AS (SELECT doc_id, t, CASE WHEN w * (ww - w) <> 0 THEN (mm * w - m * ww) * (mm * w - m * ww) / (w * (ww - w)) ELSE -1 END AS s FROM s)
SELECT doc_id, t::INT AS threshold FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, t) = 1""")
def otsu_threshold(spark, d):
    """Otsu over the histogram of code points below 256 of each document."""
    chars = fx.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("c")).select("doc_id", F.ascii("c").alias("level")).where("level between 1 and 255")
    return image.otsu_of(chars.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n")), ["doc_id"])


def _rasters(spark, d) -> DataFrame:
    """Leaning gray rasters made of all bytes of the documents; empty and null texts are empty rasters."""
    raw = fx.table(spark, d, "documents").select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("data"))
    return image.leaning(raw)


@query(None)
def preprocess_image(spark, d):
    """Gray, binary and deskewed rasters; pixel operations have no SQL."""
    return image.processed(_rasters(spark, d))


@query(None)
def deskew_image(spark, d):
    return image.processed(_rasters(spark, d), image.deskew)


# the modes over decoded pages


def _decoded(spark, d, *parts: str) -> DataFrame:
    """Pages of all documents through the JSON backend, stored once: lines as spans, recognised lines, glyphs, images and tables.

    ``parts`` are the primitives that the mode reads; others are in no file. Documents are dealt
    by id once, and only tables and images of documents are made.
    """
    docs = fx.table(spark, d, "documents").select("doc_id")
    own = fx.lines(spark, d, dealt=True).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ord", "text", "x0", "y0", "x1", "y1"))).alias("l"))
    files = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "l"))).alias("p"))
    if "tables" in parts:
        found = _nested(spark, d, docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "table_idx", F.struct("rows", "bbox", "cells_bbox").alias("own")))).alias("tables"))
        files = files.join(found, "doc_id", "left")
    if "images" in parts:
        found = F.struct("page_number", "ord", F.struct(G.box("x0", "y0", "x1", "y1").alias("bbox"), F.array(F.struct(F.col("ocr_text").alias("text"), "score")).alias("items")).alias("own"))
        files = files.join(fx.images(spark, d, docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(found)).alias("images")), "doc_id", "left")
    box = lambda r: F.struct(*(r[n].alias(n) for n in ("x0", "y0", "x1", "y1")))
    zero = lambda *names: [F.lit(0).alias(n) for n in names]
    word = lambda r: lambda t, w: F.struct(r["ord"].alias("ord"), w.alias("word_ord"), t.alias("text"), *fx.word_box(r["x0"], r["y0"], w, t))
    of_page = lambda name: lambda p: F.transform(F.filter(name, lambda t: t["page_number"] == p["page_number"]), lambda t: t["own"])
    made = {
        "page_text": lambda p: F.array_join(F.transform(p["l"], lambda r: F.coalesce(r["text"], F.lit(""))), "\n"),
        "spans": lambda p: F.transform(p["l"], lambda r: F.struct(r["ord"].alias("block"), *zero("type", "line", "span"), r["text"].alias("text"), box(r).alias("bbox"), box(r).alias("line_bbox"))),
        "ocr": lambda p: F.transform(p["l"], lambda r: F.struct(r["text"].alias("text"), F.lit(0.5).alias("score"), G.box_polygon(box(r)).alias("polygon"))),
        "glyphs": lambda p: F.transform(F.array_sort(F.flatten(F.transform(p["l"], lambda r: F.transform(F.split(r["text"], " ", -1), word(r))))), lambda g: g.dropFields("ord", "word_ord")),
        "tables": of_page("tables"), "images": of_page("images"),
    }
    pages = F.transform("p", lambda p: F.struct(F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), *(made[n](p).alias(n) for n in parts)))
    files = files.select("doc_id", F.to_json(F.struct(pages.alias("pages"))).cast("binary").alias("content"))
    return scratch.stored(backends.decode(files).where("status = 'ok'").drop("status", "error"), "decoded")


@query(f"""WITH {_PAGE_TEXT} SELECT doc_id, page_number, {_strip("string_agg(text, chr(10) ORDER BY ord)")} AS content, count(*) AS n_blocks FROM fx_lines WHERE {_strip('text')} <> '' GROUP BY doc_id, page_number
UNION ALL SELECT doc_id, page_number, '', 0 FROM pt WHERE {_strip('text')} = ''""")
def mode_pdftext(spark, d):
    return modes.pdftext(_decoded(spark, d, "page_text", "spans")).select(*PAGE, "content", F.size("text_blocks").cast("long").alias("n_blocks"))


@query(f"""WITH {_PAGE_TEXT}, b AS (SELECT doc_id, page_number, count(*) AS n FROM (SELECT doc_id, page_number, top, string_agg(text, '') AS t FROM fx_words GROUP BY ALL) WHERE {_strip('t')} <> '' GROUP BY ALL),
t AS (SELECT doc_id, page_number, count(DISTINCT table_idx) AS n_tables FROM fx_cells GROUP BY ALL)
SELECT doc_id, page_number, {_strip('text')} AS content, coalesce(n, 0)::BIGINT AS n_blocks, coalesce(n_tables, 0)::BIGINT AS n_tables FROM pt LEFT JOIN b USING (doc_id, page_number) LEFT JOIN t USING (doc_id, page_number)""")
def mode_pdftexttable(spark, d):
    return modes.pdftexttable(_decoded(spark, d, "page_text", "glyphs", "tables")).select(*PAGE, "content", F.size("text_blocks").cast("long").alias("n_blocks"), F.size("tables").cast("long").alias("n_tables"))


@query("SELECT doc_id, page_number, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (text <> ''), '') AS content FROM fx_lines GROUP BY doc_id, page_number")
def mode_pdfimagev5(spark, d):
    return modes.pdfimagev5(_decoded(spark, d, "ocr")).select(*PAGE, "content")


@query(f"SELECT doc_id, page_number, coalesce(string_agg(text, ' ' ORDER BY ord) FILTER ({_strip('text')} <> ''), '') AS content FROM fx_lines GROUP BY doc_id, page_number")
def mode_pdfimagets(spark, d):
    return modes.pdfimagets(_decoded(spark, d, "ocr")).select(*PAGE, "content")


_DOCIM = f"im AS (SELECT i.* FROM ({_BIG}) i JOIN (SELECT DISTINCT doc_id, page_number FROM fx_lines) USING (doc_id, page_number))"


@query(f"""WITH {_DOCIM}, d AS (SELECT i.* FROM im i WHERE NOT EXISTS (SELECT 1 FROM fx_lines l WHERE l.doc_id = i.doc_id AND l.page_number = i.page_number
 AND {_area('i')} > 0 AND {_overlap('i', 'l')} > 0.5 * {_area('i')} AND ((l.text <> '' AND contains(i.ocr_text, l.text)) OR contains(l.text, i.ocr_text)))),
u AS (SELECT doc_id, page_number, 0 AS k, ord, text, x0, y0 FROM fx_lines UNION ALL SELECT doc_id, page_number, 1, ord, ocr_text, x0, y0 FROM d)
SELECT doc_id, page_number, {_strip("string_agg(text, chr(10) ORDER BY y0, x0, k, ord)")} AS content, count(*) AS n_blocks FROM u GROUP BY doc_id, page_number""")
def mode_pdftxtimage(spark, d):
    return modes.pdftxtimage(_decoded(spark, d, "spans", "images")).select(*PAGE, "content", F.size("text_blocks").cast("long").alias("n_blocks"))


# a page's blocks outside its tables with free images, its tables with filled cells, and both in reading order
_IMAGE_TABLE = f"""pg AS (SELECT DISTINCT doc_id, page_number FROM fx_lines), tb AS (SELECT t.* FROM fx_tables t JOIN pg USING (doc_id, page_number)),
q AS (SELECT *, round_even(top / 3, 0) * 3 AS line_y FROM fx_words), gl AS (SELECT doc_id, page_number, line_y, {_strip("string_agg(text, '' ORDER BY x0, top, ord, word_ord)")} AS text, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1 FROM q GROUP BY doc_id, page_number, line_y),
tl AS (SELECT l.* FROM gl l WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM tb t WHERE t.doc_id = l.doc_id AND t.page_number = l.page_number AND {_area('l')} > 0 AND {_overlap('l', 't')} >= 0.5 * {_area('l')})),
{_ADDED}, fr AS (SELECT im.* FROM im JOIN pg USING (doc_id, page_number) WHERE ocr_text <> '' AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = im.doc_id AND m.page_number = im.page_number AND m.ord = im.ord)),
u AS (SELECT doc_id, page_number, y0, x0, 0 AS k, line_y AS o, text FROM tl UNION ALL SELECT doc_id, page_number, y0, x0, 1, ord, {_strip('ocr_text')} FROM fr),
cl AS (SELECT fc.doc_id, fc.page_number, table_idx, row_idx, string_agg(coalesce({_FILLED}, ''), ' | ' ORDER BY col_idx) AS line FROM fc JOIN pg USING (doc_id, page_number) LEFT JOIN a USING (k) GROUP BY ALL),
tt AS (SELECT doc_id, page_number, table_idx, string_agg(line, chr(10) ORDER BY row_idx) AS text FROM cl GROUP BY ALL),
o AS (SELECT doc_id, page_number, y0, x0, 0 AS kind, k, o, text FROM u UNION ALL SELECT doc_id, page_number, y0, x0, 1, 0, table_idx, text FROM tt JOIN tb USING (doc_id, page_number, table_idx)),
ct AS (SELECT doc_id, page_number, {_strip("string_agg(text, chr(10) ORDER BY y0, x0, kind, k, o)")} AS content FROM o GROUP BY ALL),
bl AS (SELECT doc_id, page_number, string_agg(text || '@' || x0::BIGINT || ',' || y0::BIGINT, chr(10) ORDER BY y0, x0, k, o) AS blocks FROM u GROUP BY ALL),
tn AS (SELECT doc_id, page_number, string_agg(text, chr(12) ORDER BY table_idx) AS tables FROM tt GROUP BY ALL)"""


@query(f"""WITH {_IMAGE_TABLE} SELECT doc_id, page_number, coalesce(content, '') AS content, coalesce(blocks, '') AS blocks, coalesce(tables, '') AS tables
FROM pg LEFT JOIN ct USING (doc_id, page_number) LEFT JOIN bl USING (doc_id, page_number) LEFT JOIN tn USING (doc_id, page_number)""")
def mode_pdfimagetable(spark, d):
    """Content, the texts and origins of the blocks, and the rows of the tables."""
    return modes.pdfimagetable(_decoded(spark, d, "glyphs", "tables", "images")).select(*PAGE, "content", _block_texts().alias("blocks"), _table_texts().alias("tables"))


def _block_texts():
    at = lambda b, n: b["bbox"][n].cast("long").cast("string")
    return F.array_join(F.transform("text_blocks", lambda b: F.concat(b["text"], F.lit("@"), at(b, "x0"), F.lit(","), at(b, "y0"))), "\n")


def _table_texts():
    return F.array_join(F.transform("tables", lambda t: F.array_join(F.transform(t["rows"], lambda r: F.array_join(r, " | ", "")), "\n")), "\f")


# the engine of a page by its text and the tables found on it, and each engine's content
_AUTO = f"""{_PAGE_TEXT}, tb AS (SELECT doc_id, page_number, max(n_rows) AS n FROM fx_tables GROUP BY ALL),
e AS (SELECT pt.doc_id, pt.page_number, text, CASE WHEN length({_strip('text')}) < 20 THEN 'pdfimagev5' WHEN coalesce(n, 0) >= 2 THEN 'pdftexttable' ELSE 'pdftext' END AS engine FROM pt LEFT JOIN tb USING (doc_id, page_number)),
c AS (SELECT doc_id, page_number, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER ({_strip('text')} <> ''), '') AS spans, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (text <> ''), '') AS ocr FROM fx_lines GROUP BY ALL),
p AS (SELECT doc_id, page_number, engine, CASE engine WHEN 'pdfimagev5' THEN ocr WHEN 'pdftexttable' THEN {_strip('text')} ELSE {_strip('spans')} END AS content FROM e JOIN c USING (doc_id, page_number)),
v AS (SELECT doc_id, engine, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, engine) AS place FROM e GROUP BY doc_id, engine)"""


@query(f"""WITH {_AUTO} SELECT doc_id, 'unknown' AS filename, any_value(v.engine) AS method_used, count(*) AS n_pages, string_agg(content, chr(12) ORDER BY page_number) AS contents
FROM p JOIN (SELECT doc_id, engine FROM v WHERE place = 1) v USING (doc_id) GROUP BY doc_id""")
def mode_auto(spark, d):
    r = modes.process(_decoded(spark, d, "page_text", "spans", "glyphs", "tables", "ocr"), "auto")
    return r.select("doc_id", "filename", "method_used", F.size("pages").cast("long").alias("n_pages"), F.array_join(F.transform("pages", lambda p: p["content"]), "\f").alias("contents"))


@query("""SELECT doc_id, status, CASE WHEN status = 200 THEN CASE k WHEN 4 THEN 'unknown' WHEN 1 THEN 'scan.png' ELSE 'a.PDF' END END AS filename,
 CASE WHEN status = 200 THEN CASE WHEN k IN (1, 3, 4) THEN 'pdfimagev5' ELSE 'pdftext' END END AS method_used, CASE WHEN status = 200 THEN n END AS n_pages
FROM (SELECT page_id AS doc_id, k, n, CASE WHEN size > 8000 THEN 413 WHEN size = 0 THEN 400 WHEN n > 3 THEN 422 ELSE 200 END AS status
 FROM (SELECT page_id, page_id % 5 AS k, CASE WHEN page_id % 5 IN (1, 4) THEN 1 ELSE page_id % 4 + 1 END AS n, coalesce(length(html), 0) AS size FROM pages))""")
def process_uploads(spark, d):
    """Uploads of several kinds through guards, routing and mode ``auto``: status, filename, method and pages."""
    kind = F.col("page_id") % 5
    n = (F.col("page_id") % 4 + 1).cast("int")
    text = F.when(kind != 3, F.lit("a page with a text layer")).otherwise(F.lit(" short "))
    one = F.struct(F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), text.alias("page_text"))
    html = fx.table(spark, d, "pages")
    length = F.coalesce(F.length("html"), F.lit(0))
    body = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), n), lambda i: one).alias("pages"))).cast("binary")
    files = html.select(
        F.col("page_id").alias("doc_id"), length.alias("length"), body.alias("content"), F.when(kind == 4, None).when(kind == 1, "scan.png").otherwise("a.PDF").alias("filename"),
        F.when(kind == 2, "application/pdf").when(kind == 1, "IMAGE/PNG").alias("content_type"),
    )
    r = modes.process_uploads(files, "auto", max_bytes=8000, max_pages=3)
    return r.select("doc_id", "status", "filename", "method_used", F.size("pages").cast("long").alias("n_pages"))


@query("""WITH t AS (SELECT page_id, page_id % 6 AS k FROM pages)
SELECT page_id AS doc_id, CASE k WHEN 5 THEN 'invalid JSON' WHEN 4 THEN 'no pages' END AS error,
 CASE WHEN k < 4 THEN 2 END::BIGINT AS n_blocks, CASE WHEN k < 4 THEN 'a' || page_id || '|' || CASE k WHEN 3 THEN 'None' ELSE 'b' END END AS block_texts,
 CASE WHEN k < 4 THEN CASE k WHEN 1 THEN 0 ELSE 1 END END::DOUBLE AS x0,
 CASE k WHEN 0 THEN 'x,;7,1.5' WHEN 1 THEN 'p,q' WHEN 2 THEN '' WHEN 3 THEN 'left,right' END AS rows_text
FROM t""")
def page_json_blocks(spark, d):
    """Loose page JSON of several shapes through the source: blocks as objects and arrays, tables as objects, lists, maps and other values."""
    k, i = F.col("page_id") % 6, F.col("page_id").cast("string")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    page = lambda blocks, tables: text('{"filename": "f", "pages": [{"page_number": 1, "text_blocks": ', blocks, ', "tables": ', tables, "}]}")
    two = lambda box: text('[{"text": "a', i, f'", "bbox": {box}}}, ["b", [1, 2, 3, 4]], 7, "x"]')
    json = (
        F.when(k == 0, page(two("[1, 2, 3, 4]"), F.lit('[{"rows": [["x", null], [7, 1.5]], "bbox": [1, 2, 3, 4]}]')))
        .when(k == 1, page(two("[1, 2]"), F.lit('[[["p", "q"]]]')))
        .when(k == 2, page(two('{"x0": 1, "top": 2, "x1": 3, "bottom": 4}'), F.lit("[5]")))
        .when(k == 3, page(text('[{"text": "a', i, '", "bbox": [1, 2, 3, 4]}, [null, [1, 2, 3, 4]]]'), F.lit('[{"rows": [{"b": "right", "a": "left"}]}]')))
        .when(k == 4, F.lit('{"pages": []}')).otherwise(F.lit("{pages"))
    )
    found = files.parsed(fx.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), json.alias("json")))
    first = F.get(F.col("pages"), F.lit(0))
    blocks, rows = first["text_blocks"], F.get(first["tables"], F.lit(0))["rows"]
    good = F.col("error").isNull()
    return found.select(
        "doc_id", "error", F.when(good, F.size(blocks).cast("long")).alias("n_blocks"), F.when(good, F.array_join(F.transform(blocks, lambda b: b["text"]), "|")).alias("block_texts"),
        F.when(good, F.get(blocks, F.lit(0))["bbox"]["x0"]).alias("x0"), F.when(good, F.array_join(F.transform(rows, lambda r: F.array_join(r, ",", "")), ";")).alias("rows_text"),
    )


@query(f"""WITH p AS (SELECT doc_id, page_number, {_strip("string_agg(text, chr(10) ORDER BY ord)")} AS whole FROM fx_lines GROUP BY ALL)
SELECT doc_id, page_number, CASE WHEN page_number % 2 = 0 THEN 'own' ELSE whole END AS content, CASE WHEN page_number % 2 = 0 OR whole = '' THEN 0 ELSE 1 END::BIGINT AS n_blocks, CASE WHEN page_number % 2 = 1 AND whole <> '' THEN 612 END::DOUBLE AS x1 FROM p""")
def content_fallback(spark, d):
    """Pages whose engine found nothing take the page's whole text, as one block over the page."""
    none = F.array().cast("array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>")
    p = _page_text(spark, d).select(*PAGE, F.when(F.col("page_number") % 2 == 0, "own").otherwise("").alias("content"), F.col("text").alias("page_text"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), none.alias("text_blocks"))
    return L.with_fallback(p).select(*PAGE, "content", F.size("text_blocks").cast("long").alias("n_blocks"), F.get(F.col("text_blocks"), F.lit(0))["bbox"]["x1"].alias("x1"))


@query("""SELECT doc_id, page_number, row_idx, col_idx,
 CASE (row_idx + col_idx) % 3 WHEN 0 THEN x0 WHEN 1 THEN 72 + col_idx * (360.0::DOUBLE / 4) ELSE 0 END::DOUBLE AS x, CASE (row_idx + col_idx) % 3 WHEN 0 THEN y0 WHEN 1 THEN 200 + row_idx * (300.0::DOUBLE / 15) ELSE 0 END::DOUBLE AS y FROM fx_cells""")
def cell_origins(spark, d):
    """Origins of cells from their own box, from the table's box, and without either."""
    k = (F.col("row_idx") + F.col("col_idx")) % 3
    own, whole = F.when(k == 0, G.box("x0", "y0", "x1", "y1")), F.when(k != 2, G.box(72.0, 200.0, 432.0, 500.0))
    at = G.cell_origin(own, whole, F.col("row_idx"), F.col("col_idx"), F.lit(15), F.lit(4))
    return fx.cells(spark, d).select(*PAGE, "row_idx", "col_idx", at["x"].alias("x"), at["y"].alias("y"))


# extensions


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_event_windows(spark, d):
    """Extension: tumbling windows over events."""
    return drop.event_windows(fx.table(spark, d, "events"), "ts")


@query("SELECT page_id, length(html) AS length, CASE WHEN length(html) > 8000 THEN 413 WHEN length(html) = 0 THEN 400 ELSE 200 END AS status FROM pages")
def ext_upload_status(spark, d):
    """Extension: the guards as the drop-directory stream applies them."""
    f = fx.table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("length"))
    return routing.guards(f, max_bytes=8000).select("page_id", "length", "status")


