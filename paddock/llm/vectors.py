"""Vectors for the embedding operators: validity, and packed rows that numpy reads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, v, dim) of the usable vectors, as doubles; null ids are left out."""
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return d.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))


def matrix(column) -> np.ndarray:
    """A pandas column of equally long arrays as a matrix of doubles."""
    return np.array(column.tolist(), dtype=np.float64)
