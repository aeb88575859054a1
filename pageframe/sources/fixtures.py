"""Layout tables derived from plain tables, as DataFrames and as SQL views of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PAGE_LINES = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _d(e: str):
    return F.expr(f"cast({e} as double)")


def _of(raw: DataFrame, key: Column, docs: DataFrame | None) -> DataFrame:
    """The rows of the documents ``docs``, of all if None."""
    return raw if docs is None else raw.join(docs.select(F.col("doc_id").alias("wanted_")), key == F.col("wanted_"), "left_semi")


def lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Document lines on pages of forty; ``dealt``: in partitions by document, before they are cut."""
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = (raw.repartition("doc_id") if dealt else raw).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("o", "raw"))
    return raw.select(
        "doc_id", F.expr(f"cast(o div {PAGE_LINES} + 1 as int)").alias("page_number"), F.col("o").alias("ord"), F.when(F.col("o") % 17 == 16, "  ").otherwise(F.col("raw")).alias("text"),
        _d("72 + 18 * (o % 3)").alias("x0"), _d("72 + 14 * (o % 40) + 3 * (o % 2)").alias("y0"), _d("least(72 + 18 * (o % 3) + 5 * length(raw), 560)").alias("x1"), _d("84 + 14 * (o % 40) + 3 * (o % 2)").alias("y1"),
    )


def word_box(x0: Column, y0: Column, w: Column, word: Column) -> list[Column]:
    """x0, top, x1 and bottom of the w-th word of a line at (x0, y0)."""
    left, top = x0 + 30 * w, y0 + F.lit(0.5) * (w % 3)
    return [c.cast("double").alias(n) for c, n in ((left, "x0"), (top, "top"), (left + 5 * F.length(word), "x1"), (top + 10, "bottom"))]


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all lines of each document, standing in for glyphs."""
    raw = lines(spark, sf_dir).select("doc_id", "page_number", "ord", "x0", "y0", F.posexplode(F.split("text", " ", -1)).alias("w", "word"))
    return raw.select(
        "doc_id", "page_number", "ord", F.col("w").alias("word_ord"), F.col("word").alias("text"), *word_box(*map(F.col, ("x0", "y0", "w", "word"))),
    )


def cells(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """One table per order: a row per line item, four columns; with ``docs`` the tables of those documents."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    flag = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_returnflag"))
    raw = _of(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), docs).withColumn("row_idx", F.row_number().over(by) - 1)
    raw = raw.select(F.col("l_orderkey").alias("doc_id"), "row_idx", F.posexplode(F.array(F.col("l_partkey").cast("string"), money("l_quantity"), money("l_extendedprice"), flag)).alias("col_idx", "text"))
    return raw.select(
        "doc_id", F.lit(1).alias("page_number"), F.lit(0).alias("table_idx"), "row_idx", "col_idx", "text",
        _d("72 + 90 * col_idx").alias("x0"), _d("200 + 20 * row_idx").alias("y0"), _d("162 + 90 * col_idx").alias("x1"), _d("220 + 20 * row_idx").alias("y1"),
    )


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("doc_id", "page_number", "table_idx").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.max("row_idx") + 1).alias("n_rows"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lines per order."""
    raw = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    text = F.expr("case k % 5 when 0 then 'view item' when 1 then 'click' when 2 then 'purchase order' when 3 then 'err' else o_orderpriority end")
    return raw.select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.col("k").alias("ord"), text.alias("text"),
        _d("72").alias("x0"), _d("150 + 25 * k").alias("y0"), _d("112 + 40 * ((o_orderkey + k) % 12)").alias("x1"), _d("162 + 25 * k").alias("y1"),
    )


def images(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    return _of(table(spark, sf_dir, "events"), F.expr("event_id % 500"), docs).select(
        F.expr("event_id % 500").alias("doc_id"), F.lit(1).alias("page_number"), F.expr("event_id div 500").alias("ord"),
        _d("60 + 5 * (user_id % 90)").alias("x0"), _d("150 + 5 * (event_id % 43)").alias("y0"), _d("60 + 5 * (user_id % 90) + 2 + event_id % 97").alias("x1"), _d("150 + 5 * (event_id % 43) + 2 + user_id % 23").alias("y1"),
        F.col("event_type").alias("ocr_text"), F.expr("cast(user_id % 64 as double) / 64").alias("score"),
    )


def ocr_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.explode(F.sequence(F.lit(0), F.expr("cast(event_id % 3 as int)"))).alias("k"))
    return raw.select(
        F.expr("event_id % 500").alias("doc_id"), F.lit(1).alias("page_number"), F.expr("event_id div 500").alias("image_ord"), F.col("k").alias("item_ord"),
        F.expr("case k when 0 then event_type when 1 then '' else concat(' u', user_id) end").alias("text"), F.expr("case when k <> 2 then cast((user_id + k) % 64 as double) / 64 end").alias("score"),
    )


SQL = {
    "fx_lines": """SELECT doc_id, (o // 40 + 1)::INT AS page_number, o AS ord, CASE WHEN o % 17 = 16 THEN '  ' ELSE raw END AS text,
  (72 + 18 * (o % 3))::DOUBLE AS x0, (72 + 14 * (o % 40) + 3 * (o % 2))::DOUBLE AS y0, least(72 + 18 * (o % 3) + 5 * length(raw), 560)::DOUBLE AS x1, (84 + 14 * (o % 40) + 3 * (o % 2))::DOUBLE AS y1
FROM (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS o FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    "fx_words": """SELECT doc_id, page_number, ord, w AS word_ord, word AS text, x0 + 30 * w AS x0, y0 + 0.5::DOUBLE * (w % 3) AS top, x0 + 30 * w + 5 * length(word) AS x1, y0 + 0.5::DOUBLE * (w % 3) + 10 AS bottom
FROM (SELECT doc_id, page_number, ord, x0, y0, unnest(l) AS word, unnest(range(len(l))) AS w FROM (SELECT *, string_split(text, ' ') AS l FROM fx_lines))""",
    "fx_cells": """SELECT l_orderkey AS doc_id, 1 AS page_number, 0 AS table_idx, row_idx, col_idx, t[col_idx + 1] AS text, (72 + 90 * col_idx)::DOUBLE AS x0, (200 + 20 * row_idx)::DOUBLE AS y0, (162 + 90 * col_idx)::DOUBLE AS x1, (220 + 20 * row_idx)::DOUBLE AS y1
FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_idx, unnest(range(4)) AS col_idx,
  [l_partkey::VARCHAR, l_quantity::DECIMAL(18,2)::VARCHAR, l_extendedprice::DECIMAL(18,2)::VARCHAR, CASE WHEN l_linenumber % 5 <> 0 THEN l_returnflag END] AS t FROM lineitem)""",
    "fx_tables": "SELECT doc_id, page_number, table_idx, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(row_idx) + 1 AS n_rows FROM fx_cells GROUP BY ALL",
    "fx_order_lines": """SELECT o_orderkey AS doc_id, 1 AS page_number, k AS ord, CASE k % 5 WHEN 0 THEN 'view item' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase order' WHEN 3 THEN 'err' ELSE o_orderpriority END AS text,
  72::DOUBLE AS x0, (150 + 25 * k)::DOUBLE AS y0, (112 + 40 * ((o_orderkey + k) % 12))::DOUBLE AS x1, (162 + 25 * k)::DOUBLE AS y1 FROM (SELECT *, unnest(range(10)) AS k FROM orders)""",
    "fx_images": """SELECT event_id % 500 AS doc_id, 1 AS page_number, event_id // 500 AS ord, (60 + 5 * (user_id % 90))::DOUBLE AS x0, (150 + 5 * (event_id % 43))::DOUBLE AS y0,
  (60 + 5 * (user_id % 90) + 2 + event_id % 97)::DOUBLE AS x1, (150 + 5 * (event_id % 43) + 2 + user_id % 23)::DOUBLE AS y1, event_type AS ocr_text, (user_id % 64)::DOUBLE / 64 AS score FROM events""",
    "fx_ocr_items": """SELECT event_id % 500 AS doc_id, 1 AS page_number, event_id // 500 AS image_ord, k AS item_ord, CASE k WHEN 0 THEN event_type WHEN 1 THEN '' ELSE ' u' || user_id END AS text,
  CASE WHEN k <> 2 THEN ((user_id + k) % 64)::DOUBLE / 64 END AS score FROM (SELECT *, unnest(range(event_id % 3 + 1)) AS k FROM events)""",
}
_NEEDS = {"fx_words": ("fx_lines",), "fx_tables": ("fx_cells",)}


def with_views(sql: str) -> str:
    """A query with the views it names as common table expressions."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in SQL:
        if name in sql:
            need(name)
    head = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in wanted)
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
