"""Geometry goldens and properties."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pageframe.functions import geometry as G


def box(*v):
    return G.box(*map(float, v))


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_overlap(spark):
    a, b = box(0, 0, 10, 10), box(5, 5, 15, 15)
    assert one(spark, G.overlap_area(a, b)) == 25
    assert one(spark, G.overlap_ratio(a, b)) == 0.25
    assert one(spark, G.overlap_area(a, box(10, 0, 20, 10))) == 0
    assert one(spark, G.mostly_inside(box(1, 1, 1, 5), a)) is False


@pytest.mark.parametrize(("image", "match"), [((0, 0, 20, 20), True), ((0, 0, 19, 20), True), ((-100, 0, 19, 20), False), ((0, 0, 100, 4), True)])
def test_cell_match(spark, image, match):
    assert one(spark, G.matches_cell(box(*image), box(0, 0, 100, 20))) is match


def test_cell_match_is_null_safe(spark):
    assert one(spark, G.matches_cell(box(0, 0, 1, 1), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))) is False
    assert one(spark, G.matches_cell(box(0, 0, 1, 1), box(0, 0, 0, 5))) is False


@pytest.mark.parametrize(("top", "to"), [(4.5, 6.0), (7.5, 6.0), (1.4, 0.0), (-1.5, 0.0)])
def test_quantise(spark, top, to):
    assert one(spark, G.quantise(F.lit(top))) == to


@pytest.mark.parametrize(("json", "want"), [("[1,2,3,4]", (1, 2, 3, 4)), ("[1,2,3]", None), ('{"x0":1,"top":2,"x1":3,"bottom":4}', (1, 2, 3, 4)), ("{}", (0, 0, 0, 0)), ("null", None), ("5", None), (None, None)])
def test_coerce(spark, json, want):
    got = one(spark, G.coerce_box(F.lit(json).cast("string")))
    assert (got and tuple(got)) == want


def test_coerce_without_default(spark):
    assert tuple(one(spark, G.coerce_box(F.lit('{"x0":1}'), None))) == (1, None, None, None)


def test_polygons(spark):
    b = box(1, 2, 3, 4)
    assert one(spark, G.box_polygon(b)) == [[1, 2], [3, 2], [3, 4], [1, 4]]
    assert tuple(one(spark, G.polygon_box(G.box_polygon(b)))) == (1, 2, 3, 4)
    assert tuple(one(spark, G.polygon_box(F.array(F.array(F.lit(1.0), F.lit(2.0)))))) == (0, 0, 0, 0)


def test_union_and_units(spark):
    assert tuple(one(spark, G.union_box(F.array(box(0, 5, 1, 6), box(-1, 7, 0, 8))))) == (-1, 5, 1, 8)
    assert tuple(one(spark, G.union_box(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")))) == (0, 0, 0, 0)
    assert tuple(one(spark, G.to_points(box(0, 0, 150, 300), F.lit("px"), F.lit(150)))) == (0, 0, 72, 144)
    assert tuple(one(spark, G.ltwh_box(F.lit(1), F.lit(2), F.lit(3), F.lit(4)))) == (1, 2, 4, 6)


def test_cell_origin(spark):
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    at = lambda c, t: tuple(one(spark, G.cell_origin(c, t, F.lit(1), F.lit(2), F.lit(4), F.lit(3))))
    assert at(box(7, 8, 9, 10), none) == (8, 7)
    assert at(none, box(0, 0, 30, 40)) == (10, 20)
    assert at(none, none) == (0, 0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-50, 50)] * 4), min_size=2, max_size=2))
def test_overlap_is_symmetric(spark, boxes):
    a, b = (box(*x) for x in boxes)
    x, y = spark.range(1).select(G.overlap_area(a, b), G.overlap_area(b, a)).first()
    assert x == y >= 0
