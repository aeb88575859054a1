"""File sources: uploads, images and page JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import normalize, routing
from ..schema import RESPONSE

BINARY = "path string, modificationTime timestamp, length long, content binary"


def uploads(spark: SparkSession, path: str, max_bytes: int = routing.MAX_BYTES, glob: str | None = None) -> DataFrame:
    """Files with content, content type by suffix and safe name; of a file beyond the limit the content is null.

    Guards on ``length`` reject such a file, as they do in a stream. Spark's reader passes over
    empty files; the guard for these holds for uploads that come as rows.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(path).withColumn("content", F.when(F.col("length") <= max_bytes, F.col("content")))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return found.withColumns({"filename": X.safe_name(name), "suffix": X.staged_suffix(name), "content_type": X.guessed_type(name)})


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (BGR rows); files that are no images drop."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def page_json(spark: SparkSession, path: str) -> DataFrame:
    """Response documents, one per file: ``error`` where there is no valid, non-empty ``pages``."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.trim("value").alias("json"))
    return parsed(raw)


def parsed(raw: DataFrame, json: str = "json") -> DataFrame:
    """Loose response JSON to filename, method_used and normalised pages."""
    get = lambda p: F.get_json_object(json, p)
    one = lambda p: normalize.page(
        F.get_json_object(p, "$.page_number"), F.get_json_object(p, "$.content"), normalize.text_blocks(F.get_json_object(p, "$.text_blocks")), normalize.tables(F.get_json_object(p, "$.tables")),
        F.get_json_object(p, "$.page_width"), F.get_json_object(p, "$.page_height"),
    )
    listed = normalize.items(get("$.pages"))
    error = F.when(F.json_array_length(json).isNull() & F.json_object_keys(json).isNull(), "invalid JSON").when(~(F.coalesce(F.size(listed), F.lit(0)) > 0), "no pages")
    out = raw.withColumns({"filename": get("$.filename"), "method_used": get("$.method_used"), "processing_time_sec": get("$.processing_time_sec").cast("double"), "error": error, "pages_": listed})
    return out.withColumn("pages", F.transform("pages_", one).cast(RESPONSE["pages"].dataType)).drop("pages_")


def write_responses(responses: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept."""
    responses.select(normalize.encode(F.struct("filename", "method_used", "processing_time_sec", "pages")).alias("value")).write.text(path)


def write_lines(lines: DataFrame, path: str, page_limit: int = 999) -> None:
    """One JSON array per document, ``{"page", "lines": [{"text", "confidence", "box", "source"}]}`` by page, up to the limit."""
    own = F.struct("y0", "x0", "ord", F.struct("text", "confidence", "box", "source").alias("line"))
    pages = routing.page_cap(lines, page_limit).groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(own)).alias("l"))
    pages = pages.select("doc_id", F.struct(F.col("page_number").alias("page"), F.transform("l", lambda x: x["line"]).alias("lines")).alias("p"))
    pages.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list("p"), lambda a, b: a["page"] - b["page"])).alias("value")).select("value").write.text(path)


def write_pretty(responses: DataFrame, path: str) -> None:
    """Responses as indented JSON, elapsed seconds 0, as a command line prints them; one blank line between documents."""
    zero = F.struct("filename", "method_used", F.lit(0.0).alias("processing_time_sec"), "pages")
    responses.select(F.to_json(zero, {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).write.option("lineSep", "\n\n").text(path)


def write_text(pages: DataFrame, path: str, text: str = "text") -> None:
    pages.select(F.col(text).alias("value")).write.text(path)
