"""String expressions against Python."""

import pytest
from pyspark.sql import functions as F

from pageframe.functions import text as X
from pageframe.operators import routing


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize("code", [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8202, 8232, 8233, 8239, 8287, 12288, 65, 8203])
def test_strip(spark, code):
    s = f"{chr(code)}a{chr(code)}b{chr(code)}"
    assert one(spark, X.strip(F.lit(s))) == s.strip()


def test_trims(spark):
    assert one(spark, X.js_trim(F.lit("﻿ a ﻿"))) == "a"
    assert one(spark, X.right_trim(F.lit("  a  "))) == "  a"
    assert one(spark, X.unix_lines(F.lit("a\r\nb\rc"))) == "a\nb\rc"


@pytest.mark.parametrize(("name", "want"), [("a.PDF", ".PDF"), ("a.b.c", ".c"), (".pdf", ""), ("x", ""), ("dir.d/x", ""), ("", ""), ("a.", "")])
def test_suffix(spark, name, want):
    assert one(spark, X.suffix(F.lit(name))) == want


def test_names(spark):
    assert one(spark, X.safe_name(F.lit("çay/ş?.pdf"))) == "çayş.pdf"
    assert one(spark, X.safe_name(F.lit("???"))) == "upload"
    assert one(spark, X.safe_name(F.lit(None).cast("string"))) == "upload"
    assert len(one(spark, X.safe_name(F.lit("x" * 200)))) == 80
    assert one(spark, X.staged_suffix(F.lit("abc"))) == ".bin"


def test_numbers(spark):
    assert one(spark, X.js_round(F.lit(2.5))) == 3
    assert one(spark, X.js_round(F.lit(-2.5))) == -2
    assert one(spark, X.clamp(F.lit(0.0), 4.0, 20.0, 8.0)) == 8
    assert one(spark, X.clamp(F.lit(99.0), 4.0, 20.0, 8.0)) == 20
    assert one(spark, X.utf16_length(F.lit("a😀"))) == 3
    assert one(spark, X.dict_row(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit(None).cast("string")))) == ["", "2"]


def test_contains(spark):
    test = lambda line, ocr: one(spark, X.either_contains(F.lit(line), F.lit(ocr)))
    assert test("ab", "xaby") and test("xaby", "ab") and not test("", "ab") and not test("q", "ab")


@pytest.mark.parametrize(("kind", "name", "auto", "pdf"), [("image/png", "a.pdf", "ocr", True), ("image/bmp", "a.pdf", "pdf", True), ("application/pdf", "a.png", "pdf", True), (None, "a.png", "ocr", False), (None, None, "ocr", False), ("APPLICATION/PDF", None, "pdf", True)])
def test_routes(spark, kind, name, auto, pdf):
    k, n = F.lit(kind).cast("string"), F.lit(name).cast("string")
    assert one(spark, routing.auto_route(k, n)) == auto
    assert one(spark, routing.ocr_is_pdf(k, n)) is pdf


def test_engine_choice(spark):
    assert one(spark, routing.has_text_layer(F.lit(" " * 30))) is False
    assert one(spark, routing.has_text_layer(F.lit("x" * 20))) is True
    assert one(spark, routing.is_table_heavy(F.array(F.lit(1), F.lit(2)))) is True
    assert one(spark, routing.is_table_heavy(F.array().cast("array<int>"))) is False
    assert one(spark, routing.mode(F.lit("x"))) == "auto"


def test_majority_breaks_ties_by_name(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b")], "doc_id long, engine string")
    assert {r.doc_id: r.method_used for r in routing.majority(df).collect()} == {1: "a", 2: "b"}


def test_guards(spark):
    df = spark.createDataFrame([(0, 1), (10, 1), (99, 1), (10, 9)], "length long, pages int")
    got = [r.status for r in routing.guards(df, pages="pages", max_bytes=50, max_pages=5).collect()]
    assert got == [400, 200, 413, 422]
