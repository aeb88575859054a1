"""String and conversion expressions with the semantics of the two source languages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STRIP = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"
JS_TRIM = r"(?U)^[\s\x{feff}]+|[\s\x{feff}]+$"
RTRIM = r"(?U)[\s\x{feff}]+$"


def strip(c: Column) -> Column:
    """Unicode strip of Python strings."""
    return F.regexp_replace(c, STRIP, "")


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, JS_TRIM, "")


def right_trim(c: Column) -> Column:
    return F.regexp_replace(c, RTRIM, "")


def unix_lines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def or_else(c: Column, other: Column | str) -> Column:
    """``c``, or ``other`` where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other if isinstance(other, Column) else F.lit(other))


def cell_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def rows_text(rows: Column) -> Column:
    """Cells of a table as strings, nulls empty."""
    return F.transform(rows, lambda r: F.transform(r, cell_text))


def dict_row(m: Column) -> Column:
    """Values of a map row by sorted key, nulls empty."""
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: cell_text(F.try_element_at(m, k)))


def safe_name(name: Column) -> Column:
    """First 80 characters, letters, digits, dots, underscores, dashes and spaces only; else ``upload``."""
    return or_else(F.regexp_replace(F.substr(or_else(name, "upload"), F.lit(1), F.lit(80)), r"[^\p{L}\p{N}._\- ]", ""), "upload")


def suffix(name: Column) -> Column:
    """Last dot and what follows it; '' for none, for names that begin with their only dot, and for a final dot."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_extract(base, r"[^.].*?(\.[^.]+)$|^$", 1)


def staged_suffix(name: Column) -> Column:
    return or_else(suffix(F.coalesce(name, F.lit(""))), ".bin")


def either_contains(line: Column, ocr: Column) -> Column:
    """A non-empty line within the recognised text, or that text within the line."""
    return ((line != "") & F.contains(ocr, line)) | F.contains(line, ocr)


def seconds(c: Column) -> Column:
    return F.bround(c, 3)


def js_round(c: Column) -> Column:
    """Halves upwards."""
    return F.floor(c + F.lit(0.5))


def clamp(c: Column, low: float, high: float, default: float) -> Column:
    """Between the limits; the default for null and zero."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(default))))


def guessed_type(name: Column) -> Column:
    """MIME type by suffix, as far as the command-line tools need it."""
    s = F.lower(suffix(name))
    return F.when(s == ".pdf", "application/pdf").when(s == ".png", "image/png").when(s.isin(".jpg", ".jpeg"), "image/jpeg")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, in which two count for a character beyond the basic plane."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10ffff}]"))
