"""Boxes and polygons as Column expressions; a box is struct<x0,y0,x1,y1> of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F



def box(x0, y0, x1, y1) -> Column:
    cols = zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)
    return F.struct(*((c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)).cast("double").alias(n) for n, c in cols))


def zero_box() -> Column:
    return box(0.0, 0.0, 0.0, 0.0)


def overlap_area(a: Column, b: Column) -> Column:
    """Area of the intersection; 0 for boxes that are apart or touch."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")


def area(b: Column) -> Column:
    """Width times height (negative for an inverted box); 0 for no box."""
    return F.coalesce((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]), F.lit(0.0))


def overlap_ratio(inner: Column, outer: Column) -> Column:
    """Share of the inner box that the outer one covers; 0 for none or a degenerate inner box."""
    return F.coalesce(F.when(area(inner) > 0, F.try_divide(overlap_area(inner, outer), area(inner))), F.lit(0.0))


def mostly_inside(inner: Column, outer: Column, ratio: float = 0.5) -> Column:
    return (area(inner) > 0) & (overlap_ratio(inner, outer) >= ratio)


def matches_cell(image: Column, cell: Column, of_cell: float = 0.2, of_image: float = 0.5) -> Column:
    """An image belongs to a cell if it covers enough of the cell, or enough of it lies in the cell."""
    ok = (overlap_ratio(cell, image) >= of_cell) | (overlap_ratio(image, cell) >= of_image)
    return F.coalesce((area(cell) > 0) & ok, F.lit(False))


def box_of_array(a: Column) -> Column:
    """First four numbers as a box; null for fewer."""
    return F.when(F.size(a) >= 4, box(F.get(a, 0), F.get(a, 1), F.get(a, 2), F.get(a, 3)))


def coerce_box(json: Column, missing: float | None = 0.0) -> Column:
    """JSON to a box: arrays by place, objects by x0, y0 or top, x1, y1 or bottom.

    ``missing`` stands for an object's absent keys (None leaves them null); anything else is null.
    """
    at = lambda *keys: F.coalesce(*(F.get_json_object(json, f"$.{k}").cast("double") for k in keys), F.lit(missing).cast("double"))
    place = lambda i: F.get_json_object(json, f"$[{i}]").cast("double")
    text = F.ltrim(json)
    return F.when(text.startswith("[") & (F.json_array_length(json) >= 4), box(place(0), place(1), place(2), place(3))).when(text.startswith("{"), box(at("x0"), at("y0", "top"), at("x1"), at("y1", "bottom")))


def union_box(boxes: Column) -> Column:
    """Smallest box around an array of boxes; zeros for none."""
    part = lambda n, f: f(F.transform(boxes, lambda b: b[n]))
    whole = box(part("x0", F.array_min), part("y0", F.array_min), part("x1", F.array_max), part("y1", F.array_max))
    return F.when(F.size(boxes) > 0, whole).otherwise(zero_box())


def union_agg(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    """The same as an aggregate over rows."""
    return box(F.min(x0), F.min(y0), F.max(x1), F.max(y1))


def polygon_box(points: Column) -> Column:
    """Box around a polygon's points; zeros for fewer than four."""
    xs, ys = F.transform(points, lambda p: F.get(p, 0)), F.transform(points, lambda p: F.get(p, 1))
    return F.when(F.size(points) >= 4, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(zero_box())


def box_polygon(b: Column) -> Column:
    """Four corners, clockwise from the top left."""
    return F.array(F.array(b["x0"], b["y0"]), F.array(b["x1"], b["y0"]), F.array(b["x1"], b["y1"]), F.array(b["x0"], b["y1"]))


def ltwh_box(left, top, width, height) -> Column:
    c = [x if isinstance(x, Column) else F.col(x) for x in (left, top, width, height)]
    return box(c[0], c[1], c[0] + c[2], c[1] + c[3])


def cell_origin(cell: Column, table: Column, row: Column, col: Column, n_rows: Column, n_cols: Column) -> Column:
    """Place (y, x) of a cell: its own box, else its share of the table's box, else zeros."""
    step = lambda lo, hi, n: (table[hi] - table[lo]) / F.greatest(F.lit(1), n)
    y = F.coalesce(cell["y0"], table["y0"] + row * step("y0", "y1", n_rows), F.lit(0.0))
    x = F.coalesce(cell["x0"], table["x0"] + col * step("x0", "x1", n_cols), F.lit(0.0))
    return F.struct(y.alias("y"), x.alias("x"))


def quantise(y: Column, tolerance: float = 3.0) -> Column:
    """Nearest multiple of the tolerance, halves to the even one."""
    return F.rint(y / tolerance) * tolerance


def scaled(b: Column, factor: Column | float) -> Column:
    k = factor if isinstance(factor, Column) else F.lit(factor)
    return box(b["x0"] * k, b["y0"] * k, b["x1"] * k, b["y1"] * k)


def to_points(b: Column, unit: Column, dpi: Column) -> Column:
    """Pixel boxes in points; boxes in points as they are."""
    return F.when(unit == "px", scaled(b, F.lit(72.0) / dpi)).otherwise(b)
