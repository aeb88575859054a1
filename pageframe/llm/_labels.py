"""Labelled rows for training, bounded and reproducible samples of them, and logistic training in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is not held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def known(labels: DataFrame, label: str, modulus: int, remainder: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label) of every training row, one for each id."""
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    return rows.where(~held_out("doc_id", modulus, remainder)).groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the training rows: at most ``per_class`` of each class, by a hash of the id."""
    rows = known(labels, label, modulus, remainder, doc_id)
    one = lambda k: rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return one(0).unionByName(one(1))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))
