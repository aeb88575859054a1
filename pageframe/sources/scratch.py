"""Tables in the shared folder, for results that are read more than once."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own only where that is unset, on a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and current.isDefined():
        found = current.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pageframe-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


_STORED: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: what made it runs once, and its lineage ends there.

    A table that was stored already is returned as it is.
    """
    if df in _STORED:
        return df
    path = f"{root(df.sparkSession).rstrip('/')}/pageframe-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED.add(out)
    return out
