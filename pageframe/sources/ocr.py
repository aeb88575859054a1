"""The seam to text recognition: bytes to rasters, pre-processing, a recogniser, and recognised items of a page.

No recogniser is in this environment; one is given as an ``Engine`` with a factory, which each Python worker calls
once. A line recogniser maps a raster (rows x columns x 3, BGR) to (polygon, text, score) items, a word
recogniser to (left, top, width, height, text) items. A rasteriser maps a file, a page index and a resolution to a
raster; the one that comes with the package paints the glyph boxes and embedded images of a simple PDF.
Images are PNG (8 bits, not interlaced; the first frame only) and binary PGM or PPM; other bytes give no raster.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable

import numpy as np

from ..operators import image as I
from . import pdf

# Resolutions of pages and of embedded images.
PAGE_DPI = 150
CLIP_ZOOM = 5

_MADE: dict[str, Callable | None] = {}


class Engine:
    """A recogniser by name: the factory goes to the workers, each of which calls it once."""

    def __init__(self, name: str, factory: Callable[[], Callable]):
        self.name, self.factory = name, factory

    def get(self) -> Callable | None:
        """The recogniser; None if it cannot be made: pages are then empty, not lost."""
        if self.name not in _MADE:
            try:
                _MADE[self.name] = self.factory()
            except Exception:  # told by empty pages, as an engine that is not installed
                _MADE[self.name] = None
        return _MADE[self.name]


def png(image: np.ndarray) -> bytes:
    """A gray or BGR raster as PNG."""
    h, w = image.shape[:2]
    own = image.reshape(h, w, -1)
    own = own[..., :3][..., ::-1] if own.shape[2] >= 3 else own
    rows = np.concatenate([np.zeros((h, 1), np.uint8), own.reshape(h, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if own.shape[2] == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _unfilter(raw: bytes, h: int, row: int, step: int) -> np.ndarray:
    lines = np.frombuffer(raw, np.uint8, h * (row + 1)).reshape(h, row + 1)
    out = np.zeros((h, row), np.uint8)
    above = np.zeros(row, np.int64)
    for y in range(h):
        kind, x = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if kind == 1:
            x = np.concatenate([np.cumsum(x[k::step])[:, None] for k in range(step)], axis=1).ravel() if row % step == 0 else x
        elif kind == 2:
            x = x + above
        elif kind in (3, 4):
            for i in range(row):
                a, b, c = (int(x[i - step]) if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))  # ties to the first
                x[i] = (x[i] + guess) & 255
        above = x & 255
        out[y] = above
    return out


def decoded(data: bytes) -> np.ndarray | None:
    """Raster of image bytes (BGR or gray); None for bytes that are no image."""
    try:
        if m := re.match(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s", data):
            h, w, n = int(m[3]), int(m[2]), 1 if m[1] == b"5" else 3
            out = np.frombuffer(data, np.uint8, h * w * n, m.end()).reshape(h, w, n)
            return out[..., 0] if n == 1 else out[..., ::-1]
        if not data.startswith(b"\x89PNG\r\n\x1a\n"):
            return None
        at, parts, palette = 8, [], None
        while at < len(data):
            (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                parts.append(body)
            at += 12 + size
        if depth != 8 or interlace:
            return None
        n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        out = _unfilter(zlib.decompress(b"".join(parts)), h, w * n, n).reshape(h, w, n)
        if colour == 3:
            out = palette[out[..., 0]]
        if out.shape[2] in (1, 2):
            return out[..., 0]
        return out[..., 2::-1]
    except (KeyError, IndexError, TypeError, ValueError, UnboundLocalError, struct.error, zlib.error):
        return None


def painted(content: bytes, page_index: int, dpi: int = PAGE_DPI) -> np.ndarray | None:
    """A simple PDF's page as a gray raster: glyph boxes black, embedded images by their samples; None for no such page."""
    try:
        doc = pdf.Document(content)
        leaves = doc.pages()
        if not 0 <= page_index < len(leaves):
            return None
        p = pdf.Painter(doc, leaves[page_index])
    except (ValueError, zlib.error):
        return None
    k = dpi / 72
    out = np.full((max(1, round(p.height * k)), max(1, round(p.width * k))), 255, np.uint8)
    cut = lambda lo, hi, n: slice(max(0, min(n, round(lo * k))), max(0, min(n, round(hi * k))))
    for m in p.images:
        rows, cols = cut(m["bbox"]["y0"], m["bbox"]["y1"], out.shape[0]), cut(m["bbox"]["x0"], m["bbox"]["x1"], out.shape[1])
        own = pdf.samples(doc, m["object"])
        h, w = out[rows, cols].shape
        if own is not None and h and w:
            gray = I.to_gray(own, rgb=True)
            out[rows, cols] = gray[(np.arange(h) * gray.shape[0] // h)[:, None], np.arange(w) * gray.shape[1] // w]
    for g in p.glyphs:
        if g["text"].strip():
            out[cut(g["top"], g["bottom"], out.shape[0]), cut(g["x0"], g["x1"], out.shape[1])] = 0
    return out


def rasters(content: bytes, rasterise: Callable = painted, dpi: int = PAGE_DPI) -> Iterable[tuple[int, bytes]]:
    """Index and PNG of each page of a PDF, one at a time."""
    i = 0
    while (image := rasterise(content, i, dpi)) is not None:
        yield i, png(image)
        i += 1


def _page(number: int, image: np.ndarray | None, items: list) -> dict:
    h, w = image.shape[:2] if image is not None else (0, 0)
    return {"page_number": number, "page_width": float(w), "page_height": float(h), "page_text": "", "spans": [], "glyphs": [], "tables": [], "images": [], "ocr": items}


def lines_of(image: np.ndarray | None, engine: Engine) -> list[dict]:
    """Line items of a raster; none without an engine or an image."""
    recognise = engine.get()
    if recognise is None or image is None:
        return []
    return [{"text": text, "score": float(score), "polygon": [[float(x), float(y)] for x, y in polygon]} for polygon, text, score in recognise(I.three_channels(I.for_lines(image)))]


def words_of(image: np.ndarray, engine: Engine) -> list[dict]:
    """Word items of a raster, as polygons; a failing engine gives none."""
    recognise = engine.get()
    try:
        found = recognise(I.for_words(image)) if recognise is not None else []
    except Exception:  # a page that cannot be recognised is a page without words
        found = []
    box = lambda x, y, w, h: [[float(x), float(y)], [float(x + w), float(y)], [float(x + w), float(y + h)], [float(x), float(y + h)]]
    return [{"text": text or "", "score": None, "polygon": box(int(x), int(y), int(w), int(h))} for x, y, w, h, text in found]


def backend(engine: Engine, kind: str = "lines", rasterise: Callable = painted, dpi: int = PAGE_DPI) -> Callable:
    """A decoding backend (``backends.decode``) of recognised pages: ``kind`` is lines or words.

    A PDF has a page for each of its pages, an image one page, that of its first frame. Bytes that are no
    image are an empty page of no size for lines, and no page for words.
    """

    def pages(content: bytes, page_numbers: list[int] | None = None) -> Iterable[dict]:
        read = (lambda image: lines_of(image, engine)) if kind == "lines" else (lambda image: words_of(image, engine))
        if content[:1024].find(b"%PDF") >= 0:
            i = 0
            while (image := rasterise(content, i, dpi)) is not None:
                if page_numbers is None or i in page_numbers:
                    yield _page(i + 1, image, read(image))
                i += 1
            return
        image = decoded(content)
        if image is not None or kind == "lines":
            yield _page(1, image, read(image) if image is not None else [])

    return pages


def with_image_text(engine: Engine, rasterise: Callable = painted, zoom: int = CLIP_ZOOM) -> Callable:
    """A decoding backend of PDF primitives whose embedded images of a size carry the text recognised in their clip."""

    def pages(content: bytes, page_numbers: list[int] | None = None) -> Iterable[dict]:
        recognise = engine.get()
        for p in pdf.pdf_pages(content, page_numbers):
            large = [m for m in p["images"] if m["bbox"]["x1"] - m["bbox"]["x0"] >= 5 and m["bbox"]["y1"] - m["bbox"]["y0"] >= 5]
            whole = rasterise(content, p["page_number"] - 1, 72 * zoom) if large and recognise is not None else None
            for m in large if whole is not None else ():
                b = m["bbox"]
                clip = whole[max(0, round(b["y0"] * zoom)) : round(b["y1"] * zoom), max(0, round(b["x0"] * zoom)) : round(b["x1"] * zoom)]
                if clip.size:
                    m["items"] = [{"text": text, "score": float(score) if isinstance(score, int | float) else None} for _, text, score in recognise(I.for_embedded(clip))]
            yield p

    return pages
