"""Sources, sinks and streams: PDFs, rasters, the recognition seam, uploads, page JSON, the drop directory."""

import json
import zlib

import numpy as np
from pyspark.sql import functions as F

from pageframe.plans import modes
from pageframe.sources import backends, files, ocr, pdf
from pageframe.streaming import drop


def make_pdf(packed=False):
    """Two pages, the second object first in the file; a ruled table with text and an image on the first."""
    first = b"BT /F1 10 Tf 72 700 Td (Hello world) Tj ET BT /F1 10 Tf 102 602 Td (A1) Tj 60 0 Td (B1) Tj -60 -20 Td (A2) Tj ET\n"
    first += b"".join(b"%d %d m %d %d l S\n" % x for x in ((100, 620, 220, 620), (100, 600, 220, 600), (100, 580, 220, 580), (100, 580, 100, 620), (160, 580, 160, 620), (220, 580, 220, 620)))
    first += b"q 50 0 0 40 300 300 cm /Im1 Do Q\n"
    second = b"BT /F1 12 Tf 14 TL 72 720 Td (two \\(2\\)) Tj T* [(ke) -50 (rn)] TJ ET"
    stream = lambda n, head, data: b"%d 0 obj << %s /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (n, head, len(zlib.compress(data)), zlib.compress(data))
    plain = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [8 0 R 3 0 R] /Count 2 /MediaBox [0 0 612 792] /Resources << /Font << /F1 6 0 R >> /XObject << /Im1 7 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", 8: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>", 6: b"<< /Type /Font /FirstChar 65 /Widths [600 700] >>",
    }
    image = stream(7, b"/Subtype /Image /Width 4 /Height 2 /ColorSpace /DeviceGray /BitsPerComponent 8", bytes(range(8)))
    body = stream(5, b"", second) + stream(4, b"", first) + image
    if packed:
        heads, data = [], b""
        for n, v in plain.items():
            heads.append(b"%d %d" % (n, len(data)))
            data += v + b" "
        index = b" ".join(heads) + b" "
        body += stream(9, b"/Type /ObjStm /N %d /First %d" % (len(plain), len(index)), index + data)
    else:
        body += b"".join(b"%d 0 obj %s endobj\n" % x for x in plain.items())
    return b"%PDF-1.5\n" + body + b"trailer << /Root 1 0 R >>"


def test_pdf_pages():
    for packed in (False, True):
        one, two = pdf.pdf_pages(make_pdf(packed))
        assert [s["text"] for s in one["spans"]] == ["Hello world", "A1", "B1", "A2"] and one["page_text"].startswith("Hello world\nA1")
        assert two["page_text"] == "two (2)\nkern" and two["spans"][1]["bbox"]["y1"] == 792 - 706
        a = next(g for g in one["glyphs"] if g["text"] == "A")
        assert (a["x0"], a["x1"], a["top"], a["bottom"]) == (102, 108, 180, 190)
        (t,) = one["tables"]
        assert t["rows"] == [["A1", "B1"], ["A2", ""]] and t["bbox"] == {"x0": 100, "y0": 172, "x1": 220, "y1": 212} and t["cells_bbox"][1][0] == {"x0": 100, "y0": 192, "x1": 160, "y1": 212}
        assert [m["bbox"] for m in one["images"]] == [{"x0": 300, "y0": 452, "x1": 350, "y1": 492}]
        assert [p["page_number"] for p in pdf.pdf_pages(make_pdf(packed), [1, 5])] == [2]
    doc = pdf.Document(make_pdf())
    assert pdf.samples(doc, pdf.Ref(7)).ravel().tolist() == list(range(8)) and pdf.samples(doc, pdf.Ref(4)) is None


def test_tables_need_all_sides():
    box = lambda x, y: [((x, y), (x + 9, y)), ((x, y + 9), (x + 9, y + 9)), ((x, y), (x, y + 9)), ((x + 9, y), (x + 9, y + 9))]
    assert list(pdf.tables(box(0, 0), [])) == []  # one cell is a frame
    assert [t["rows"] for t in pdf.tables([*box(0, 0), *box(9, 0), *box(40, 40), *box(49, 49)], [])] == [[["", ""]], [["", None], [None, ""]]]
    assert list(pdf.tables([*box(0, 0), *box(9, 0)][:-1], [])) == []


def test_png_filters():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (4, 6, 3)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        assert (ocr.decoded(ocr.png(x)) == x).all()
    # one row for each filter, made by their definitions
    x = rng.integers(0, 256, (5, 6)).astype(int)
    raw = b""
    for kind in range(5):
        up = x[kind - 1] if kind else np.zeros(6, int)
        a, c = np.concatenate(([0], x[kind][:-1])), np.concatenate(([0], up[:-1]))
        paeth = [min((p, q, r), key=lambda v, e=p + q - r: abs(e - v)) for p, q, r in zip(a.tolist(), up.tolist(), c.tolist(), strict=True)]
        guess = (0 * a, a, up, (a + up) // 2, np.array(paeth))[kind]
        raw += bytes([kind]) + bytes(((x[kind] - guess) & 255).tolist())
    assert (ocr._unfilter(raw, 5, 6, 1) == x).all()
    assert ocr.decoded(b"P5 2 2 255\n\x00\x01\x02\x03").tolist() == [[0, 1], [2, 3]]
    assert ocr.decoded(b"GIF89a") is None and ocr.decoded(ocr.png(np.zeros((2, 2), np.uint8))[:40]) is None


def _recognisers():
    """Recognisers for tests, which go to the workers by value: the box of what is dark, named by its size."""

    def box(image):
        gray = image if image.ndim == 2 else image[..., 0]
        y, x = (gray < 128).nonzero()
        if not len(y):
            return []
        a, b, c, d = int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1
        return [([[a, b], [c, b], [c, d], [a, d]], f"{c - a}x{d - b}", 0.75)]

    def words(image):
        return [(p[0][0], p[0][1], p[1][0] - p[0][0], p[2][1] - p[0][1], t) for p, t, _ in box(image)] + [(0, 0, 1, 1, " ")]

    return box, words


def test_recognised_pages(spark):
    box, words = _recognisers()
    engines = ocr.Engine("lines", lambda: box), ocr.Engine("words", lambda: words), ocr.Engine("broken", lambda: 1 / 0)
    scan = np.full((60, 80), 250, np.uint8)
    scan[20:40, 10:50] = 5
    content = [(1, ocr.png(scan)), (2, make_pdf()), (3, b"no image")]
    df = spark.createDataFrame([(i, bytearray(c), f"{i}.{'pdf' if i == 2 else 'png'}", None) for i, c in content], "doc_id long, content binary, filename string, content_type string")
    found = lambda read: {(r.doc_id, r.page_number): r for r in backends.decode(df, read).collect()}
    lines = found(ocr.backend(engines[0]))
    assert [o.text for o in lines[1, 1].ocr] == ["40x20"] and lines[1, 1].ocr[0].polygon[2] == [50.0, 40.0] and (lines[1, 1].page_width, lines[1, 1].page_height) == (80, 60)
    assert lines[2, 1].page_width == 1275 and len(lines[2, 2].ocr) == 1 and (lines[3, 1].page_width, lines[3, 1].ocr) == (0, [])
    words = found(ocr.backend(engines[1], "words"))
    assert [o.text for o in words[1, 1].ocr] == ["40x20", " "] and set(words) == {(1, 1), (2, 1), (2, 2)}
    assert found(ocr.backend(engines[2]))[1, 1].ocr == []
    done = {r.doc_id: r for r in modes.process_uploads(df, "pdfimagev5", ocr.backend(engines[0])).collect()}
    assert done[1].pages[0].content == "40x20" and tuple(done[1].pages[0].text_blocks[0].bbox) == (10, 20, 50, 40) and done[3].pages[0].content == "" and len(done[2].pages) == 2
    assert [i for i, _ in ocr.rasters(make_pdf())] == [0, 1] and ocr.painted(make_pdf(), 7) is None and ocr.painted(b"x", 0) is None
    clip = next(iter(ocr.with_image_text(engines[0])(make_pdf(), [0])))["images"][0]
    assert clip["items"][0]["text"] == "250x200" and clip["items"][0]["score"] == 0.75


def test_uploads_from_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = json.dumps({"pages": [{"page_text": "a page with a text layer", "spans": [{"block": 0, "type": 0, "line": 0, "span": 0, "text": "a page with a text layer"}]}] * 2}).encode()
    for name, data in (("a.pdf", good), ("b.pdf", b"{"), ("d.pdf", good + b" " * 3000), ("e.png", good)):
        (tmp_path / "in" / name).write_bytes(data)
    own = files.uploads(spark, str(tmp_path / "in"), max_bytes=2000)
    assert {r.filename: r.content is None for r in own.collect()} == {"a.pdf": False, "b.pdf": False, "d.pdf": True, "e.png": False}
    own = own.withColumn("doc_id", F.col("filename"))
    got = {r.doc_id: r for r in modes.process_uploads(own, "auto", max_bytes=2000, max_pages=1).collect()}
    assert {k: r.status for k, r in got.items()} == {"a.pdf": 422, "b.pdf": 500, "d.pdf": 413, "e.png": 200}
    assert got["e.png"].method_used == "pdfimagev5" and len(got["e.png"].pages) == 1 and got["a.pdf"].pages is None and "JSONDecodeError" in got["b.pdf"].detail
    got = {r.doc_id: r for r in modes.process_uploads(own, "pdftext", max_bytes=2000).where("status = 200").collect()}
    assert got["a.pdf"].method_used == "pdftext" and [p.content for p in got["a.pdf"].pages] == ["a page with a text layer"] * 2
    assert modes.process_uploads(own.limit(1).withColumns({"content": F.lit(b""), "length": F.lit(0)}), "auto").first().status == 400
    nothing = spark.createDataFrame([("x", bytearray(b'{"pages": []}'), "", None)], "doc_id string, content binary, filename string, content_type string")
    assert tuple(modes.process_uploads(nothing, "nonsense").first()) == ("x", 200, None, "unknown", "auto", 0.0, [])


def test_sinks_and_page_json(spark, tmp_path):
    files.page_json(spark, str(_write(tmp_path / "j", {"a.json": '{"filename": "f", "method_used": "m", "pages": [{"page_number": 2, "content": null, "page_width": 3}]}', "b.json": "[1", "c.json": "{}"}))).createOrReplaceTempView("pj")
    got = {r.path[-6:]: r for r in spark.table("pj").collect()}
    assert [got[k].error for k in ("a.json", "b.json", "c.json")] == [None, "invalid JSON", "no pages"]
    page = got["a.json"].pages[0]
    assert (page.page_number, page.content, page.text_blocks, page.tables, page.page_width, page.page_height) == (2, "", [], [], 3.0, None)
    lines = spark.createDataFrame([(1, 1, "b", 1.0, [[0.0, 5.0]], "native", 5.0, 0.0, 1), (1, 1, "a", 0.5, [[0.0, 1.0]], "ocr_image", 1.0, 0.0, 2), (1, 2, "c", 1.0, None, "native", 0.0, 0.0, 1), (1, 3, "d", 1.0, None, "native", 0.0, 0.0, 1)],
                                  "doc_id long, page_number int, text string, confidence double, box array<array<double>>, source string, y0 double, x0 double, ord int")
    files.write_lines(lines, str(tmp_path / "lines"), page_limit=2)
    (value,) = [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert json.loads(value) == [{"page": 1, "lines": [{"text": "a", "confidence": 0.5, "box": [[0.0, 1.0]], "source": "ocr_image"}, {"text": "b", "confidence": 1.0, "box": [[0.0, 5.0]], "source": "native"}]}, {"page": 2, "lines": [{"text": "c", "confidence": 1.0, "source": "native"}]}]
    docs = spark.createDataFrame([("f", "m", 1.5, [])], "filename string, method_used string, processing_time_sec double, pages array<string>")
    files.write_pretty(docs, str(tmp_path / "cli"))
    assert json.loads(spark.read.text(str(tmp_path / "cli"), wholetext=True).first().value) == {"filename": "f", "method_used": "m", "processing_time_sec": 0.0, "pages": []}
    files.write_responses(docs, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["processing_time_sec"] == 1.5
    files.write_text(docs.select(F.lit("x\ny").alias("text")), str(tmp_path / "txt"))
    assert [r.value for r in spark.read.text(str(tmp_path / "txt")).collect()] == ["x", "y"]


def _write(folder, contents):
    folder.mkdir()
    for name, text in contents.items():
        (folder / name).write_text(text)
    return folder


def test_drop_directory(spark, tmp_path):
    _write(tmp_path / "in", {"a.pdf": "one", "b.pdf": "x" * 50, "c.pdf": "one"})
    found = drop.uploads(spark, f"file://{tmp_path}/in", max_bytes=40)
    q = drop.run(found, lambda df: df.select("filename"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination()
    rows = lambda: sorted(r.filename for r in spark.read.json(f"file://{tmp_path}/out/pages/*").collect())
    assert rows() == ["a.pdf", "c.pdf"] and [r.status for r in spark.read.json(f"file://{tmp_path}/out/rejected/*").collect()] == [413]
    _write(tmp_path / "more", {}), (tmp_path / "in" / "d.pdf").write_text("two")
    drop.run(drop.uploads(spark, f"file://{tmp_path}/in"), lambda df: df.select("filename"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert rows() == ["a.pdf", "c.pdf", "d.pdf"]  # only what is new
    one = drop.distinct_uploads(drop.uploads(spark, f"file://{tmp_path}/in")).select("filename")
    q = one.writeStream.format("memory").queryName("once").option("checkpointLocation", f"file://{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type")
    assert sorted(r.n for r in drop.event_windows(events, "ts").collect()) == [1, 2]
