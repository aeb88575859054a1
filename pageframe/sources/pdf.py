"""A reader of PDF pages with the standard library: text, glyphs, ruled tables and embedded images.

Objects come from the file body and from object streams; pages are those of the page tree, in
its order, with inherited boxes and resources. Streams are plain or Flate. Texts are one-byte
strings (WinAnsi); glyph widths are the font's, or half the size. Fonts with encodings of their own,
encryption, filters besides Flate and rasterising are left to other backends.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"<<|>>|\[|\]|/[^\s/<>\[\]()%]*|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+", re.S)
_NUMBER = re.compile(rb"[-+]?(?:\d+\.?\d*|\.\d+)\Z")


class Ref(int):
    """The number of another object."""


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    body = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw[1:-1])
    body = re.sub(rb"\\([nrtbf()\\])", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(m[1], m[1]), body)
    return body.decode("cp1252", "replace")


def parsed(raw: bytes):
    """The first value in the bytes: dicts by name, lists, numbers, strings, names as bytes, references."""
    stack: list[list] = [[]]
    for t in _TOKEN.findall(raw):
        if t in (b"<<", b"["):
            stack.append([])
        elif t in (b">>", b"]") and len(stack) > 1:
            own = stack.pop()
            stack[-1].append(dict(zip(own[::2], own[1::2], strict=False)) if t == b">>" else own)
        elif t == b"R" and len(stack[-1]) > 1:
            stack[-1][-2:] = [Ref(stack[-1][-2])]
        elif _NUMBER.match(t):
            stack[-1].append(float(t) if b"." in t else int(t))
        elif t[:1] in (b"(", b"<"):
            stack[-1].append(_string(t))
        else:
            stack[-1].append({b"true": True, b"false": False, b"null": None}.get(t, t))
    return stack[0][0] if stack[0] else None


class Document:
    def __init__(self, content: bytes):
        if b"%PDF" not in content[:1024] and not _OBJECT.search(content):
            raise ValueError("not a PDF")
        self.values: dict[int, object] = {}
        self.raw: dict[int, bytes] = {}
        for n, _, body in _OBJECT.findall(content):
            m = _STREAM.search(body)
            self.values[int(n)] = parsed(body[: m.start()] if m else body)
            if m:
                self.raw[int(n)] = m[1]
        for n in list(self.raw):
            head = self.values[n]
            if isinstance(head, dict) and head.get(b"/Type") == b"/ObjStm":
                data = self.stream(n)
                places = [int(x) for x in data[: int(head[b"/First"])].split()]
                starts = places[1::2] + [len(data)]
                for k, number in enumerate(places[::2]):
                    self.values.setdefault(number, parsed(data[int(head[b"/First"]) + starts[k] : int(head[b"/First"]) + starts[k + 1]]))

    def get(self, x):
        seen = 0
        while isinstance(x, Ref) and seen < 32:
            x, seen = self.values.get(int(x)), seen + 1
        return x

    def stream(self, n: int) -> bytes:
        head = self.values.get(n)
        kinds = self.get(head.get(b"/Filter")) if isinstance(head, dict) else None
        kinds = kinds if isinstance(kinds, list) else [kinds] if kinds else []
        if any(k not in (b"/FlateDecode", b"/Fl") for k in kinds):
            raise ValueError("unknown stream filter")
        data = self.raw.get(n, b"")
        for _ in kinds:
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> list[dict]:
        """Pages in the order of the page tree, with what they inherit."""
        out: list[dict] = []
        seen: set[int] = set()

        def walk(ref, inherited: dict) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                return
            if isinstance(ref, Ref):
                seen.add(ref)
            own = {**inherited, **{k: node[k] for k in (b"/MediaBox", b"/Resources") if k in node}}
            if b"/Kids" in node:
                for kid in self.get(node[b"/Kids"]) or []:
                    walk(kid, own)
            else:
                out.append({**node, **own})

        every = [v for _, v in sorted(self.values.items()) if isinstance(v, dict)]
        root = next((v for v in every if v.get(b"/Type") == b"/Catalog"), None)
        if root and b"/Pages" in root:
            walk(root[b"/Pages"], {})
        return out or [v for v in every if v.get(b"/Type") == b"/Page"]

    def content(self, page: dict) -> bytes:
        refs = page.get(b"/Contents")
        refs = refs if isinstance(refs, Ref) and not isinstance(self.get(refs), list) else self.get(refs)
        return b"\n".join(self.stream(int(r)) for r in (refs if isinstance(refs, list) else [refs]) if isinstance(r, Ref))


def _times(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


class Painter:
    """Spans, glyphs, ruled segments and image boxes of one page; the origin is the top left."""

    def __init__(self, doc: Document, page: dict):
        box = [float(x) for x in (doc.get(page.get(b"/MediaBox")) or (0, 0, 612, 792))]
        self.doc, self.left, self.top = doc, box[0], box[3]
        self.width, self.height = box[2] - box[0], box[3] - box[1]
        self.spans, self.glyphs, self.segments, self.images = [], [], [], []
        resources = doc.get(page.get(b"/Resources")) or {}
        self.fonts, self.objects = (doc.get(resources.get(k)) or {} for k in (b"/Font", b"/XObject"))
        self._run(doc.content(page))

    def _widths(self, name: bytes) -> tuple[int, list]:
        font = self.doc.get(self.fonts.get(name)) or {}
        return int(self.doc.get(font.get(b"/FirstChar")) or 0), self.doc.get(font.get(b"/Widths")) or []

    def _text(self, s: dict, values: list) -> None:
        scale = s["scale"]
        size = s["size"] * scale
        first, widths = s["widths"]
        x, y = s["x"], s["y"]
        begin, text = x, ""
        for v in values:
            if isinstance(v, str):
                for c in v:
                    code = c.encode("cp1252", "replace")[0] - first
                    w = (widths[code] / 1000 if 0 <= code < len(widths) else 0.5) * size
                    self.glyphs.append({"text": c, "x0": x - self.left, "top": self.top - y - size, "x1": x + w - self.left, "bottom": self.top - y})
                    x += w
                text += v
            elif isinstance(v, int | float):
                x -= v / 1000 * size
        box = {"x0": begin - self.left, "y0": self.top - y - size, "x1": x - self.left, "y1": self.top - y}
        self.spans.append({"block": max(s["block"], 0), "type": 0, "line": s["line"], "span": 0, "text": text, "bbox": box, "line_bbox": box})
        s["x"], s["line"] = x, s["line"] + 1

    def _run(self, ops: bytes) -> None:
        s = {"size": 12.0, "scale": 1.0, "leading": 0.0, "x": 0.0, "y": 0.0, "lx": 0.0, "ly": 0.0, "block": -1, "line": 0, "widths": (0, [])}
        matrix, kept, path, at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], [], (0.0, 0.0)
        stack: list = []
        lists: list[list] = []
        for t in _TOKEN.findall(ops):
            if t == b"[":
                lists.append([])
                continue
            if t == b"]" and lists:
                own = lists.pop()
                (lists[-1] if lists else stack).append(own)
                continue
            if t[:1] in b"(</+-.0123456789" and t not in (b"<<", b">>"):
                (lists[-1] if lists else stack).append(float(t) if _NUMBER.match(t) else t if t[:1] == b"/" else _string(t))
                continue
            num = [v for v in stack if isinstance(v, float)]
            if t == b"q":
                kept.append(matrix)
            elif t == b"Q" and kept:
                matrix = kept.pop()
            elif t == b"cm" and len(num) >= 6:
                matrix = _times(num[-6:], matrix)
            elif t == b"BT":
                s.update(block=s["block"] + 1, x=0.0, y=0.0, lx=0.0, ly=0.0, scale=1.0)
            elif t == b"Tf" and num:
                s.update(size=num[-1], widths=self._widths(next((v for v in stack if isinstance(v, bytes)), b"")))
            elif t == b"TL" and num:
                s["leading"] = num[-1]
            elif t in (b"Td", b"TD") and len(num) >= 2:
                s.update(lx=s["lx"] + num[-2] * s["scale"], ly=s["ly"] + num[-1] * s["scale"], leading=-num[-1] if t == b"TD" else s["leading"])
                s.update(x=s["lx"], y=s["ly"])
            elif t == b"Tm" and len(num) >= 6:
                s.update(scale=abs(num[-3]) or 1.0, lx=num[-2], ly=num[-1], x=num[-2], y=num[-1])
            elif t in (b"T*", b"'", b'"'):
                s["ly"] -= s["leading"] * s["scale"]
                s.update(x=s["lx"], y=s["ly"])
            elif t == b"re" and len(num) >= 4:
                x, y, w, h = num[-4:]
                path += [((x, y), (x + w, y)), ((x, y + h), (x + w, y + h)), ((x, y), (x, y + h)), ((x + w, y), (x + w, y + h))]
            elif t == b"m" and len(num) >= 2:
                at = (num[-2], num[-1])
            elif t == b"l" and len(num) >= 2:
                path.append((at, (num[-2], num[-1])))
                at = (num[-2], num[-1])
            elif t in (b"S", b"s", b"f", b"F", b"f*", b"B", b"b", b"B*", b"b*"):
                self.segments += [tuple(self._place(p, matrix) for p in ends) for ends in path]
                path = []
            elif t == b"n":
                path = []
            elif t == b"Do" and stack and isinstance(stack[-1], bytes):
                self._image(stack[-1], matrix)
            if t in (b"Tj", b"TJ", b"'", b'"'):
                self._text(s, [x for v in stack for x in (v if isinstance(v, list) else [v]) if isinstance(x, str) or isinstance(v, list)])
            stack = []

    def _place(self, p, matrix) -> tuple[float, float]:
        x, y = p[0] * matrix[0] + p[1] * matrix[2] + matrix[4], p[0] * matrix[1] + p[1] * matrix[3] + matrix[5]
        return x - self.left, self.top - y

    def _image(self, name: bytes, matrix) -> None:
        head = self.doc.get(self.objects.get(name))
        if isinstance(head, dict) and head.get(b"/Subtype") == b"/Image":
            corners = [self._place(p, matrix) for p in ((0, 0), (1, 0), (0, 1), (1, 1))]
            xs, ys = zip(*corners, strict=True)
            self.images.append({"bbox": {"x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys)}, "items": [], "object": self.objects.get(name)})


def samples(doc: Document, ref: Ref) -> np.ndarray | None:
    """An embedded image's own samples (8 bits, gray or RGB), if they can be read."""
    head = doc.get(ref)
    try:
        h, w = int(doc.get(head[b"/Height"])), int(doc.get(head[b"/Width"]))
        n = {b"/DeviceGray": 1, b"/DeviceRGB": 3}[doc.get(head.get(b"/ColorSpace"))]
        return np.frombuffer(doc.stream(int(ref)), np.uint8, h * w * n).reshape(h, w, n)
    except (KeyError, TypeError, ValueError, zlib.error):
        return None


def tables(segments: Iterable, glyphs: list[dict], snap: float = 3.0) -> Iterator[dict]:
    """Ruled tables: cells whose four sides are drawn, connected ones a table, texts by the glyphs' centres."""
    flat, steep = [], []
    for (ax, ay), (bx, by) in segments:
        if abs(ay - by) <= 1 and abs(ax - bx) > 1:
            flat.append((min(ax, bx), max(ax, bx), (ay + by) / 2))
        elif abs(ax - bx) <= 1 and abs(ay - by) > 1:
            steep.append((min(ay, by), max(ay, by), (ax + bx) / 2))

    def lines(values) -> list[float]:
        out: list[float] = []
        for v in sorted(values):
            if not out or v - out[-1] > snap:
                out.append(v)
        return out

    xs, ys = lines(x for _, _, x in steep), lines(y for _, _, y in flat)

    def drawn(of: list, at: float, lo: float, hi: float) -> bool:
        reach = lo
        for a, b, v in sorted(of):
            if abs(v - at) <= snap and a <= reach + snap:
                reach = max(reach, b)
        return reach >= hi - snap

    cells = {(i, j) for i in range(len(ys) - 1) for j in range(len(xs) - 1) if drawn(flat, ys[i], xs[j], xs[j + 1]) and drawn(flat, ys[i + 1], xs[j], xs[j + 1]) and drawn(steep, xs[j], ys[i], ys[i + 1]) and drawn(steep, xs[j + 1], ys[i], ys[i + 1])}
    while cells:
        group, todo = set(), [min(cells)]
        while todo:
            c = todo.pop()
            if c in cells:
                cells.remove(c)
                group.add(c)
                todo += [(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        if len(group) < 2:
            continue
        rows, boxes = [], []
        for i in sorted({i for i, _ in group}):
            texts, own = [], []
            for j in range(min(j for _, j in group), max(j for _, j in group) + 1):
                box = {"x0": xs[j], "y0": ys[i], "x1": xs[j + 1], "y1": ys[i + 1]} if (i, j) in group else None
                inside = [g for g in glyphs if box and box["x0"] <= (g["x0"] + g["x1"]) / 2 < box["x1"] and box["y0"] <= (g["top"] + g["bottom"]) / 2 < box["y1"]]
                tops = sorted({g["top"] for g in inside})
                texts.append("\n".join("".join(g["text"] for g in sorted((g for g in inside if g["top"] == t), key=lambda g: g["x0"])).strip() for t in tops) if box else None)
                own.append(box)
            rows.append(texts)
            boxes.append(own)
        every = [b for r in boxes for b in r if b]
        yield {"rows": rows, "bbox": {"x0": min(b["x0"] for b in every), "y0": min(b["y0"] for b in every), "x1": max(b["x1"] for b in every), "y1": max(b["y1"] for b in every)}, "cells_bbox": boxes}


def pdf_pages(content: bytes, page_numbers: list[int] | None = None) -> Iterable[dict]:
    """Primitives of the pages: one block per text object, one span per shown string."""
    doc = Document(content)
    leaves = doc.pages()
    for i in range(len(leaves)) if page_numbers is None else [i for i in page_numbers if 0 <= i < len(leaves)]:
        p = Painter(doc, leaves[i])
        yield {
            "page_number": i + 1, "page_width": p.width, "page_height": p.height, "page_text": "\n".join(s["text"] for s in p.spans), "spans": p.spans, "glyphs": p.glyphs,
            "tables": list(tables(p.segments, p.glyphs)), "images": [{k: v for k, v in m.items() if k != "object"} for m in p.images], "ocr": [],
        }
