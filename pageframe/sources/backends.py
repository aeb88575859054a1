"""Decoding backends behind one seam: content bytes of a file to page primitives.

A backend is a function ``pages(content, page_numbers) -> iterable of dicts`` in the shape of
``schema.PRIMITIVES``. Two come with the package: ``json`` (primitives as JSON, for tests and
for decoders that ran elsewhere) and ``pdf`` (``sources.pdf``: text, glyphs, ruled tables and
embedded images of simple PDFs). Backends of recognised pages come from ``sources.ocr``.
Others are registered by name, and are imported in the Python workers, once per worker.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..schema import PRIMITIVES
from . import pdf

Backend = Callable[[bytes, list[int] | None], Iterable[dict]]
REGISTRY: dict[str, Backend] = {}


def register(name: str, backend: Backend) -> None:
    REGISTRY[name] = backend


def json_pages(content: bytes, page_numbers: list[int] | None = None) -> Iterable[dict]:
    pages = json.loads(content)["pages"]
    wanted = range(len(pages)) if page_numbers is None else [i for i in page_numbers if 0 <= i < len(pages)]
    for i in wanted:
        yield {"page_number": i + 1, **pages[i]}


def page_counts(files: DataFrame, backend: str | Backend = "json", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pages of each file; 0 where it cannot be read."""
    return decode(files, backend, keys=keys, all_or_nothing=True).groupBy(*keys).agg(F.count_if(F.col("status") == "ok").alias("n_pages"))


register("json", json_pages)
register("pdf", pdf.pdf_pages)


def decode(files: DataFrame, backend: str | Backend = "json", page_numbers: list[int] | None = None, keys: tuple[str, ...] = ("doc_id",), all_or_nothing: bool = False) -> DataFrame:
    """Page primitives of each file: keys, status, error and the columns of PRIMITIVES.

    A file that fails keeps the pages read so far (or none), and has a row with the error.
    """
    read = REGISTRY[backend] if isinstance(backend, str) else backend
    names = PRIMITIVES.fieldNames()
    kinds = dict(files.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "status string", "error string", *(f"{f.name} {f.dataType.simpleString()}" for f in PRIMITIVES)])

    def run(parts):
        for part in parts:
            rows = []
            for r in part.to_dict("records"):
                own, failure = [], None
                try:
                    for p in read(bytes(r["content"]), page_numbers):
                        own.append([*(r[k] for k in keys), "ok", None, *(p.get(n) for n in names)])
                except Exception as e:  # the file's own failure, told in its row
                    failure = f"{type(e).__name__}: {e}"
                if failure is not None:
                    own = [] if all_or_nothing else own
                    own.append([*(r[k] for k in keys), "error", failure, *[None] * len(names)])
                rows += own
            yield pd.DataFrame(rows, columns=[*keys, "status", "error", *names])

    return files.select(*keys, F.col("content").cast("binary")).mapInPandas(run, schema)
