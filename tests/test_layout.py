"""Operators on small hand-made pages."""

import json

import numpy as np
from pyspark.sql import functions as F

from pageframe.operators import grid, image, lines as L, normalize, spatial as S
from pageframe.plans import catalog, modes
from pageframe.sources import backends, files


def test_dedup_is_strict(spark):
    lines = spark.createDataFrame([(1, 1, "abc", 0.0, 0.0, 10.0, 10.0)], "doc_id long, page_number int, text string, x0 double, y0 double, x1 double, y1 double")
    images = spark.createDataFrame([(1, 1, 0, "abc", 5.0, 0.0, 15.0, 10.0), (1, 1, 1, "abc", 4.0, 0.0, 14.0, 10.0), (1, 1, 2, "zzz", 0.0, 0.0, 9.0, 9.0)], "doc_id long, page_number int, ord int, ocr_text string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.ord for r in S.image_dedup(images, lines).collect()) == [0, 2]


def test_update_join(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0, 0, "a"), (1, 1, 0, 0, 1, None)], "doc_id long, page_number int, table_idx int, row_idx int, col_idx int, text string")
    m = spark.createDataFrame([(1, 1, 5, 0, 0, 0, "y"), (1, 1, 2, 0, 0, 0, "x"), (1, 1, 3, 0, 0, 1, "z"), (1, 1, 4, 0, 9, 9, "lost")], "doc_id long, page_number int, ord int, table_idx int, row_idx int, col_idx int, ocr_text string")
    assert {r.col_idx: r.text for r in S.cells_with_ocr(cells, m).collect()} == {0: "a x y", 1: "z"}


def test_grid_golden(spark):
    items = [(100.0, 72.0, "Invoice 7"), (125.0, 0.0, "Zero"), (200.0, 72.0, "Item"), (200.0, 75.0, "Qty"), (200.0, 244.0, "Sum")]
    df = spark.createDataFrame([(1, 1, i, *x) for i, x in enumerate(items)], "doc_id long, page_number int, ord long, y double, x double, text string")
    want = "       Invoice 7\n Zero\n       Item Qty         Sum"
    pages = grid.page_text(df, ["doc_id", "page_number"], 10.0, 4.0)
    assert pages.first().grid == want
    assert grid.exact_text(df, ["doc_id", "page_number"], 10.0, 4.0).first().grid == want
    assert grid.document_text(pages).first().text == want.strip()
    two = pages.unionByName(pages.withColumn("page_number", F.lit(2)))
    assert grid.document_text(two).first().text == f"——— Sayfa 1 ———\n\n{want}\n\n——— Sayfa 2 ———\n\n{want}"
    assert grid.document_text(pages.withColumn("grid", F.lit(""))).first().text == grid.NOTHING


def test_grid_counts_utf16_units(spark):
    df = spark.createDataFrame([(1, 1, i, 0.0, x, t) for i, (x, t) in enumerate([(0.0, "\U0001f600b"), (80.0, "c"), (81.0, "d")])], "doc_id long, page_number int, ord long, y double, x double, text string")
    want = " \U0001f600b      c d"  # one column, then two units and one, then up to column ten
    assert grid.page_text(df, ["doc_id", "page_number"]).first().grid == want
    assert grid.exact_text(df, ["doc_id", "page_number"]).first().grid == want


def test_row_anchor_does_not_move(spark):
    df = spark.createDataFrame([(1, i, float(y), 0.0, str(y)) for i, y in enumerate((10, 12, 14, 15, 21))], "doc_id long, ord long, y double, x double, text string")
    assert sorted((int(r.text), r.row) for r in grid.rows(df, ["doc_id"], 4.0).collect()) == [(10, 0), (12, 0), (14, 0), (15, 1), (21, 2)]


def test_confidence_default(spark):
    df = spark.createDataFrame([(1, 0, " a ", None), (1, 1, "", None), (1, 2, "b", None), (2, 0, " ", 0.5)], "image int, item_ord int, text string, score double")
    assert [(r.ocr_text, r.confidence) for r in L.image_text(df, ["image"]).collect()] == [("a b", 0.9)]


def test_normaliser(spark):
    page = {
        "text_blocks": [{"text": "a", "bbox": [1, 2, 3, 4]}, {"bbox": None}, ["t", None], ["u", {"x0": 1}], 5, ["short"]],
        "tables": [{"rows": ["x", "y"]}, {"rows": [["1", None]], "bbox": [0, 0, 9, 9], "cells_bbox": [[[1, 1, 2, 2], None], [0, 0, 1, 1], {"x0": 3}]}, [["a"], "s"], 7, {"rows": [], "cells_bbox": []}],
    }
    df = spark.createDataFrame([(json.dumps(page["text_blocks"]), json.dumps(page["tables"]))], "b string, t string").select(normalize.text_blocks(F.col("b")).alias("b"), normalize.tables(F.col("t")).alias("t")).first()
    assert [(x.text, tuple(x.bbox)) for x in df.b] == [("a", (1, 2, 3, 4)), ("", (0, 0, 0, 0)), ("t", (0, 0, 0, 0)), ("u", (1, 0, 0, 0))]
    assert df.t[0].rows == [["x", "y"]] and df.t[0].bbox is None and df.t[0].cells_bbox is None
    assert df.t[1].rows == [["1", None]] and tuple(df.t[1].bbox) == (0, 0, 9, 9)
    assert tuple(df.t[1].cells_bbox[0][0]) == (1, 1, 2, 2) and df.t[1].cells_bbox[0][1] is None and tuple(df.t[1].cells_bbox[2][0]) == (3, 0, 0, 0)
    assert df.t[2].rows == [["a"], ["s"]] and df.t[3].rows == [] and df.t[4].cells_bbox is None


def test_response_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"filename": "f", "pages": [{"page_number": 1, "content": "c", "text_blocks": [], "tables": []}]}))
    (tmp_path / "b.json").write_text('{"pages": []}')
    (tmp_path / "c.json").write_text("not json")
    got = {r.path.rsplit("/", 1)[1]: (r.error, r.pages and r.pages[0].content) for r in files.page_json(spark, str(tmp_path)).collect()}
    assert got["a.json"] == (None, "c") and got["b.json"][0] == "no pages" and got["c.json"][0] == "invalid JSON"


PAGE = {
    "page_width": 100.0, "page_height": 100.0, "page_text": "Heading line of the page\nmore",
    "spans": [{"block": 0, "type": 0, "line": 0, "span": i, "text": t, "bbox": {"x0": 10.0 * i, "y0": 1.0, "x1": 10.0 * i + 9, "y1": 9.0}, "line_bbox": {"x0": 0.0, "y0": 1.0, "x1": 19.0, "y1": 9.0}} for i, t in enumerate(("Head", "ing"))]
    + [{"block": 1, "type": 0, "line": 0, "span": 0, "text": "  ", "bbox": None, "line_bbox": None}, {"block": 2, "type": 1, "line": 0, "span": 0, "text": "pic", "bbox": None, "line_bbox": None}],
    "glyphs": [{"text": t, "x0": x, "top": y, "x1": x + 5, "bottom": y + 8} for t, x, y in (("b", 6.0, 11.0), ("a", 0.0, 10.0), ("T", 21.0, 61.0))],
    "tables": [{"rows": [["c", None], ["d", "e"]], "bbox": {"x0": 20.0, "y0": 60.0, "x1": 60.0, "y1": 100.0}, "cells_bbox": [[{"x0": 20.0, "y0": 60.0, "x1": 40.0, "y1": 80.0}, None], [None, {"x0": 40.0, "y0": 80.0, "x1": 60.0, "y1": 100.0}]]}],
    "images": [{"bbox": {"x0": 21.0, "y0": 61.0, "x1": 39.0, "y1": 79.0}, "items": [{"text": " in cell ", "score": 0.5}]}, {"bbox": {"x0": 0.0, "y0": 30.0, "x1": 20.0, "y1": 40.0}, "items": [{"text": "free", "score": None}]}, {"bbox": {"x0": 0.0, "y0": 30.0, "x1": 4.0, "y1": 40.0}, "items": [{"text": "tiny", "score": None}]}],
    "ocr": [{"text": t, "score": 0.5, "polygon": [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]} for t in ("one", " ", "", "two")],
}


def pages(spark, *contents):
    df = spark.createDataFrame([(i, bytearray(json.dumps({"pages": c}).encode())) for i, c in enumerate(contents)], "doc_id long, content binary")
    return backends.decode(df).where("status = 'ok'")


def test_modes(spark):
    p = pages(spark, [PAGE])
    got = {m: f(p).first() for m, f in modes.BY_NAME.items()}
    assert got["pdftext"].content == "Heading" and [tuple(b.bbox) for b in got["pdftext"].text_blocks] == [(0, 1, 19, 9)]
    assert got["pdftexttable"].content == PAGE["page_text"] and [b.text for b in got["pdftexttable"].text_blocks] == ["a", "b", "T"]
    assert got["pdftexttable"].tables[0].rows == [["c", ""], ["d", "e"]]
    assert got["pdfimagev5"].content == "one\n \ntwo" and got["pdfimagets"].content == "one two"
    assert got["pdftxtimage"].content == "Heading\nfree\nin cell"
    assert got["pdfimagetable"].content == "a\nb\nfree\nc in cell | \nd | e" and got["pdfimagetable"].tables[0].rows[0][0] == "c in cell"
    assert got["auto"].engine == "pdftexttable"


def test_empty_page(spark):
    blank = {k: ([] if isinstance(v, list) else v) for k, v in PAGE.items()} | {"page_text": "only the page text is known"}
    p = pages(spark, [blank])
    got = modes.pdftext(p).first()
    assert got.content == blank["page_text"] and tuple(got.text_blocks[0].bbox) == (0, 0, 100, 100)
    for f in modes.BY_NAME.values():
        assert f(p).count() == 1


def test_process(spark):
    blank = {k: ([] if isinstance(v, list) else v) for k, v in PAGE.items()} | {"page_text": ""}
    r = modes.process(pages(spark, [PAGE, blank]), "auto").first()
    assert [p.page_number for p in r.pages] == [1, 2] and r.method_used == "pdfimagev5"
    assert modes.process(pages(spark, [PAGE]), "nonsense").first().method_used == "pdftexttable"


def test_backend_failure_and_pdf(spark):
    pdf = b"%PDF-1.4\n1 0 obj <</Type /Page /MediaBox [0 0 200 100] /Contents 2 0 R>> endobj\n2 0 obj <<>> stream\nBT /F1 10 Tf 20 80 Td (Hello \\(PDF\\)) Tj 0 -12 Td [(Wor) 3 (ld)] TJ ET\nendstream endobj"
    df = spark.createDataFrame([(0, bytearray(b"junk")), (1, bytearray(pdf))], "doc_id long, content binary")
    assert {r.doc_id: r.status for r in backends.decode(df.where("doc_id = 0")).collect()} == {0: "error"}
    assert {r.doc_id: r.n_pages for r in backends.page_counts(df.where("doc_id = 0")).collect()} == {0: 0}
    page = backends.decode(df.where("doc_id = 1"), "pdf").first()
    assert [s.text for s in page.spans] == ["Hello (PDF)", "World"] and page.page_width == 200 and page.spans[0].bbox.x0 == 20


def test_otsu_and_deskew():
    rng = np.random.default_rng(0)
    gray = np.concatenate([rng.normal(60, 8, 500), rng.normal(190, 8, 500)]).clip(0, 255).astype(np.uint8).reshape(20, 50)

    def brute(g):
        best = (-1.0, 0)
        for t in range(256):
            a, b = g[g <= t].astype(float), g[g > t].astype(float)
            if len(a) and len(b):
                s = len(a) * len(b) * (a.mean() - b.mean()) ** 2
                best = max(best, (round(s, 6), -t))
        return -best[1]

    assert image.otsu(gray) == brute(gray)
    assert set(np.unique(image.preprocess(gray, straighten=False))) == {0, 255}
    page = np.full((200, 200), 255, np.uint8)
    page[90:110, 30:170] = 0
    assert image.skew_angle(page) == 0
    assert abs(abs(image.skew_angle(image.rotate(page, 10))) - 10) < 1.5
    assert image.deskew(np.full((5, 5), 255, np.uint8)).shape == (5, 5)
    assert image.preprocess(None) is None
    assert image.contrast(np.array([[100, 200]], np.uint8)).tolist() == [[150, 255]]
    assert image.to_gray(np.array([[[255, 0, 0]]], np.uint8)).tolist() == [[29]]


def test_box_order_in_pages(spark):
    df = spark.createDataFrame([(1, 1, 0, "b", 5.0, 1.0, 6.0, 2.0), (1, 1, 1, "a", 0.0, 1.0, 2.0, 2.0)], "doc_id long, page_number int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    got = L.pages_of(df, ["y0", "x0", "ord"]).first()
    assert got.content == "a\nb" and tuple(got.text_blocks[0].bbox) == (0, 1, 2, 2)


def test_words_of_long_documents(spark, tmp_path):
    """The queries over words see every line of documents beyond sixty lines."""
    texts = {1: "\n".join(f"a{i} b{i % 7} c" for i in range(130)), 2: "x y"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    exact, tolerant, union, content = {}, {}, {}, {}
    for doc, text in texts.items():
        for o, raw in enumerate(text.split("\n")):
            line = "  " if o % 17 == 16 else raw
            page = doc, o // 40 + 1
            for w, word in enumerate(line.split(" ")):
                x0, top = 72 + 18 * (o % 3) + 30 * w, 72 + 14 * (o % 40) + 3 * (o % 2) + 0.5 * (w % 3)
                exact.setdefault((*page, top), []).append((x0, o, w, word))
                tolerant.setdefault((*page, round(top / 3) * 3), []).append((x0, top, o, w, word))
                box = x0, top, x0 + 5 * len(word), top + 10
                old = union.get(page, box)
                union[page] = (*map(min, old[:2], box[:2]), *map(max, old[2:], box[2:]))
                if word:
                    content.setdefault(page, []).append(word)
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    joined = lambda groups: {k: t for k, g in groups.items() if (t := "".join(x[-1] for x in sorted(g)))}
    assert {(r.doc_id, r.page_number, r.line_y): r.text for r in run("glyph_lines_exact")} == joined(exact)
    assert {(r.doc_id, r.page_number, r.line_y): r.text for r in run("glyph_lines_tolerant")} == joined(tolerant)
    assert {(r.doc_id, r.page_number): (r.x0, r.y0, r.x1, r.y1) for r in run("bbox_union_page")} == union
    assert {(r.doc_id, r.page_number): r.content for r in run("ocr_word_content")} == {k: " ".join(v) for k, v in content.items()}
    assert max(k[1] for k in union) == 4


def test_rasters_of_whole_texts(spark, tmp_path):
    """Every document is a raster of all its bytes; leaning pages are rotated, as by a plain version."""
    rng = np.random.default_rng(3)
    texts = {i: "".join(map(chr, rng.integers(32, 127, n))) for i, n in enumerate([1, 399, 400, 3001, 20_003, 950, 2000, 1203])} | {8: "", 9: None, 10: "é日本 " * 90}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    d, turned = str(tmp_path), 0
    made = {int(r.origin): np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in catalog._rasters(spark, d).collect()}
    assert {i: m[m < 255].tobytes().decode() for i, m in made.items()} == {i: t or "" for i, t in texts.items()}
    assert len({m.shape for m in made.values()}) > 7 and (made[4] < 255).sum() > image.DESKEW_POINTS
    for name, step in (("deskew_image", image.deskew), ("preprocess_image", image.preprocess)):
        got = {int(r.origin): r for r in catalog.QUERIES[name](spark, d).collect()}
        assert set(got) == set(texts)
        for i, m in made.items():
            assert bytes(got[i].data) == step(m).tobytes() and (got[i].height, got[i].width) == m.shape
            turned += name == "deskew_image" and bytes(got[i].data) != m.tobytes()
    assert turned >= 4
    assert [abs(round(np.degrees(np.arctan(k / 16)) - abs(image.skew_angle(made[i])))) for i, k in ((3, 3), (6, 2), (7, 3))] == [0, 0, 0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_joins_are_not_broadcast(spark):
    """Lines come out of arrays, so the planner's guess is far too low; collecting them filled the driver."""
    d = "/root/testdata/sf0.001"
    for name in ("image_dedup", "hybrid_lines", "hybrid_content", "lines_outside_tables", "image_to_cell"):
        assert "Broadcast" not in _plan(catalog.QUERIES[name](spark, d)), name


def test_modes_deal_their_pages_once(spark):
    """A mode's files hold the primitives it reads, and its pages are dealt by page, not once more for each grouping."""
    pages = catalog._decoded(spark, "/root/testdata/sf0.001", "page_text", "spans")
    assert pages.where("glyphs is not null or ocr is not null or tables is not null or images is not null").count() == 0
    assert pages.where("spans is null or page_text is null").count() == 0 < pages.count()
    assert _plan(modes.pdftext(pages)).count("Exchange hashpartitioning") <= 2  # the spans, and the rest of the page


def test_exact_grid_without_a_frame_for_each_page(spark):
    items = spark.createDataFrame([(1, 1, 100.0, 72.0, 0, "a\U0001f600"), (1, 1, 103.0, 40.0, 1, "b"), (1, 1, 140.0, 72.0, 2, "c"), (2, 1, 5.0, 16.0, 0, "d"), (None, 1, 5.0, 16.0, 0, "e")], "doc_id long, page_number int, y double, x double, ord long, text string")
    out = grid.exact_text(items, ["doc_id", "page_number"])
    assert "InPandas" not in _plan(out)
    assert {r.doc_id: r.grid for r in out.collect()} == {1: "     b   a\U0001f600\n         c", 2: "  d", None: "  e"}
