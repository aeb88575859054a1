"""Modes, guards and the choice of an engine per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..schema import MODES

# Limits and type lists that results depend on.
MAX_BYTES = 50 * 1024 * 1024
MAX_PAGES = 500
MIN_TEXT = 20
MIN_TABLE_ROWS = 2
IMAGE_TYPES = ("image/jpeg", "image/png", "image/jpg")
PDF_TYPE = "application/pdf"


def mode(c: Column) -> Column:
    """Unknown modes are ``auto``."""
    return F.when(c.isin(*MODES), c).otherwise(F.lit("auto"))


def auto_route(content_type: Column, name: Column) -> Column:
    """``ocr`` or ``pdf``: a listed content type decides, else the suffix."""
    kind = F.lower(content_type)
    by_suffix = F.when(F.lower(X.suffix(name)) == ".pdf", "pdf").otherwise("ocr")
    return F.when(kind.isin(*IMAGE_TYPES), "ocr").when(kind == PDF_TYPE, "pdf").otherwise(by_suffix)


def ocr_is_pdf(content_type: Column, name: Column) -> Column:
    """For the OCR modes a file is a PDF by content type or by suffix."""
    return F.coalesce(F.lower(content_type) == PDF_TYPE, F.lit(False)) | F.coalesce(F.lower(X.suffix(name)) == ".pdf", F.lit(False))


def has_text_layer(text: Column) -> Column:
    return F.coalesce(F.length(X.strip(text)) >= MIN_TEXT, F.lit(False))


def is_table_heavy(row_counts: Column) -> Column:
    """Whether a table has rows enough; the argument is an array of row counts."""
    return F.coalesce(F.exists(row_counts, lambda n: n >= MIN_TABLE_ROWS), F.lit(False))


def engine(text_layer: Column, table_heavy: Column) -> Column:
    return F.when(text_layer & table_heavy, "pdftexttable").when(text_layer, "pdftext").otherwise("pdfimagev5")


def majority(pages: DataFrame, doc: str = "doc_id", method: str = "engine") -> DataFrame:
    """Most frequent method per document; ties to the first by name."""
    return pages.groupBy(doc).agg(F.mode(method, True).alias("method_used"))


def guards(files: DataFrame, length: str = "length", pages: str | None = None, max_bytes: int = MAX_BYTES, max_pages: int = MAX_PAGES) -> DataFrame:
    """``status`` and ``detail`` of each upload: size before emptiness before page count."""
    n = F.col(length)
    checks = [(n > max_bytes, 413, "file too large"), (n == 0, 400, "empty file")]
    if pages:
        checks.append((F.col(pages) > max_pages, 422, "too many pages"))
    status, detail = F.lit(None), F.lit(None)
    for test, code, said in reversed(checks):
        status, detail = F.when(test, code).otherwise(status), F.when(test, said).otherwise(detail)
    return files.withColumns({"status": F.coalesce(status, F.lit(200)).cast("int"), "detail": detail.cast("string")})


def select_pages(pages: DataFrame, requested: DataFrame, page: str = "page_number", index: str = "page_index") -> DataFrame:
    """Requested 0-based pages in request order, repeats kept, pages that do not exist dropped."""
    return pages.join(requested, pages[page] == requested[index] + 1)


def page_cap(pages: DataFrame, limit: int = 999, page: str = "page_number") -> DataFrame:
    return pages.where(F.col(page) <= limit)


def with_stubs(pages: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("doc_id", "page_number")) -> DataFrame:
    """Every page of ``pages``; those without a result get a blank one."""
    return pages.join(results, list(keys), "left").withColumn("content", F.coalesce("content", F.lit("")))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
