"""Raster operations on uint8 arrays (rows x columns x channels, BGR), in numpy behind Arrow batches.

The Otsu threshold is also given over a histogram table, in DataFrame operations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Sizes and limits of the pre-processing.
LARGE_SIDE = 2000
DESKEW_POINTS = 10_000
DESKEW_LEAST = 100
DESKEW_ANGLE = 0.5


def to_gray(image: np.ndarray, rgb: bool = False) -> np.ndarray:
    """Luma of a colour image; gray images as they are."""
    if image.ndim == 2:
        return image
    if image.shape[2] == 1:
        return image[..., 0]
    b, g, r = (image[..., i].astype(np.float64) for i in ((2, 1, 0) if rgb else (0, 1, 2)))
    return np.rint(0.299 * r + 0.587 * g + 0.114 * b).clip(0, 255).astype(np.uint8)


def three_channels(image: np.ndarray) -> np.ndarray:
    """Gray, or with alpha, to three channels."""
    if image.ndim == 2:
        return np.repeat(image[..., None], 3, axis=2)
    return image[..., :3] if image.shape[2] >= 3 else np.repeat(image[..., :1], 3, axis=2)


def otsu(gray: np.ndarray) -> int:
    """Threshold of the largest variance between the classes (the first such level)."""
    p = np.bincount(gray.ravel(), minlength=256) / gray.size
    w = np.cumsum(p)
    m = np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w > 0) & (w < 1), (m[-1] * w - m) ** 2 / (w * (1 - w)), -1)
    return int(np.argmax(between))


def binarise(gray: np.ndarray) -> np.ndarray:
    return np.where(gray > otsu(gray), 255, 0).astype(np.uint8)


def contrast(gray: np.ndarray, alpha: float = 1.5) -> np.ndarray:
    return np.rint(np.abs(gray.astype(np.float64) * alpha)).clip(0, 255).astype(np.uint8)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    p = points[np.lexsort((points[:, 1], points[:, 0]))]
    ends = np.ones(len(p), bool)  # only the ends of a row can be corners
    ends[1:-1] = (p[1:-1, 0] != p[:-2, 0]) | (p[1:-1, 0] != p[2:, 0])
    p = np.unique(p[ends], axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    rows = p.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def least_rectangle_angle(points: np.ndarray) -> float:
    """Angle in (0, 90] degrees of the smallest rectangle around the points: one side lies on a hull edge."""
    h = hull(points).astype(float)
    if len(h) < 3:
        return 90.0
    edges = np.roll(h, -1, axis=0) - h
    angles = np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2), 12))
    u = np.column_stack([np.cos(angles), np.sin(angles)])
    v = np.column_stack([-u[:, 1], u[:, 0]])
    best = int(np.argmin(np.ptp(h @ u.T, axis=0) * np.ptp(h @ v.T, axis=0)))
    return float(np.degrees(angles[best])) or 90.0


def skew_angle(image: np.ndarray) -> float:
    """Angle to rotate by; 0 for too few points or too small an angle."""
    gray = to_gray(image)
    points = np.column_stack(np.nonzero(gray < 255))
    if len(points) < DESKEW_LEAST:
        return 0.0
    if len(points) > DESKEW_POINTS:
        points = points[np.random.default_rng(42).choice(len(points), DESKEW_POINTS, replace=False)]
    angle = least_rectangle_angle(points)
    if angle > 45:
        angle -= 90
    return 0.0 if abs(angle) < DESKEW_ANGLE else angle


def _cubic(t: np.ndarray, a: float = -0.75) -> list[np.ndarray]:
    near = lambda x: ((a + 2) * x - (a + 3)) * x * x + 1
    far = lambda x: ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return [far(1 + t), near(t), near(1 - t), far(2 - t)]


def rotate(image: np.ndarray, angle: float) -> np.ndarray:
    """Rotation about the centre by degrees, cubic, edges repeated."""
    h, w = image.shape[:2]
    rad, cx, cy = np.radians(angle), w / 2, h / 2
    y, x = np.mgrid[0:h, 0:w].astype(float)
    c, s = np.cos(rad), np.sin(rad)
    sx, sy = c * (x - cx) - s * (y - cy) + cx, s * (x - cx) + c * (y - cy) + cy
    ix, iy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    wx, wy = _cubic(sx - ix), _cubic(sy - iy)
    src = image.astype(float)
    out = np.zeros(src.shape)
    for j in range(4):
        for i in range(4):
            k = wx[i] * wy[j]
            out += src[np.clip(iy + j - 1, 0, h - 1), np.clip(ix + i - 1, 0, w - 1)] * (k[..., None] if src.ndim == 3 else k)
    return np.rint(out).clip(0, 255).astype(np.uint8)


def deskew(image: np.ndarray) -> np.ndarray:
    angle = skew_angle(image)
    return rotate(image, angle) if angle else image


def preprocess(image: np.ndarray | None, grayscale: bool = True, threshold: bool = True, straighten: bool = True) -> np.ndarray | None:
    """Gray, binary, deskewed, each by its switch; null and empty images pass through."""
    if image is None or image.size == 0:
        return image
    out = to_gray(image) if grayscale else image
    if threshold and out.ndim == 2:
        out = binarise(out)
    if straighten:
        out = deskew(three_channels(out))
        out = to_gray(out) if grayscale else out
    return out


def for_lines(image: np.ndarray) -> np.ndarray:
    """Before line recognition: large images only gray, others also binary; never deskewed."""
    return preprocess(image, threshold=max(image.shape[:2]) <= LARGE_SIDE, straighten=False)


def for_words(image: np.ndarray) -> np.ndarray:
    """Before word recognition: all three steps."""
    return preprocess(image)


def for_embedded(image: np.ndarray) -> np.ndarray:
    """Before recognition of an embedded image: gray with more contrast."""
    return contrast(to_gray(image, rgb=True))


def page(data: bytes, lean: int) -> np.ndarray:
    """All bytes as a page of some 5 rows to 4 columns on white; a row stands ``lean`` sixteenths of a pixel right of the one above."""
    n = len(data)
    if not n:
        return np.zeros((0, 0), np.uint8)
    w = int(np.ceil(0.8 * np.sqrt(n)))
    h = -(-n // w)
    cells = np.full(h * w, 255, np.uint8)
    cells[:n] = np.frombuffer(data, np.uint8)
    right = np.arange(h) * lean // 16
    out = np.full((h, w + int(right[-1])), 255, np.uint8)
    out[np.arange(h)[:, None], right[:, None] + np.arange(w)] = cells.reshape(h, w)
    return out


KINDS = "origin string, height int, width int, nChannels int, data binary"
HELD = 8 << 20


def _batches(rows):
    """Rows of ``KINDS`` as frames of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1])
        if size >= HELD:
            yield pd.DataFrame(held, columns=["origin", "height", "width", "nChannels", "data"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["origin", "height", "width", "nChannels", "data"])


def leaning(docs: DataFrame) -> DataFrame:
    """Rows of Spark's image source made of (doc_id, data): the page of the bytes, leaning by doc_id modulo 4."""

    def rows(parts):
        for part in parts:
            for i, data in zip(part["doc_id"], part["data"], strict=True):
                out = page(data, 0 if pd.isna(i) else int(i) % 4)
                yield None if pd.isna(i) else str(int(i)), *out.shape, 1, out.tobytes()

    return docs.select("doc_id", "data").mapInPandas(lambda parts: _batches(rows(parts)), KINDS)


def processed(images: DataFrame, step=preprocess) -> DataFrame:
    """Rows of Spark's image source (origin, height, width, nChannels, data) after a step."""

    def rows(parts):
        for part in parts:
            for r in part.itertuples(index=False):
                out = step(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels))
                yield r.origin, out.shape[0], out.shape[1], 1 if out.ndim == 2 else out.shape[2], out.tobytes()

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(lambda parts: _batches(rows(parts)), KINDS)


def otsu_of(histogram: DataFrame, keys: list[str], level: str = "level", n: str = "n") -> DataFrame:
    """Otsu threshold per key of a histogram table; empty levels need no rows.

    The levels of a key are one array of at most 256 entries, and the best split is one fold over it. Between two
    levels that occur, the score doesn't change, so only levels that occur are looked at, but for a first split below them.
    """
    levels = F.array_sort(F.collect_list(F.struct(F.col(level).cast("int").alias("t"), F.col(n).cast("double").alias("c"))))
    total = lambda f: F.aggregate("h", F.lit(0.0), lambda a, x: a + f(x))
    own = histogram.groupBy(*keys).agg(levels.alias("h")).withColumns({"all_w": total(lambda x: x["c"]), "all_m": total(lambda x: x["c"] * x["t"])})
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("m"), F.lit(-1.0).alias("s"), F.lit(0).alias("t"))

    def step(acc, x):
        w, m = acc["w"] + x["c"], acc["m"] + x["c"] * x["t"]
        gap = F.col("all_m") * w - m * F.col("all_w")
        score = F.coalesce(F.try_divide(gap * gap, w * (F.col("all_w") - w)), F.lit(-1.0))
        better = score > acc["s"]
        return F.struct(w.alias("w"), m.alias("m"), F.when(better, score).otherwise(acc["s"]).alias("s"), F.when(better, x["t"]).otherwise(acc["t"]).alias("t"))

    return own.select(*keys, F.aggregate("h", start, step, lambda acc: acc["t"]).alias("threshold"))
