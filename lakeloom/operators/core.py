"""Vector, matrix and reduction primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def add_vectors(rows: DataFrame) -> DataFrame:
    """id and the elementwise sum of a and b; vectors of different length are an error."""
    same = F.assert_true(F.size("a") == F.size("b"), "vectors differ in length")
    return rows.select("id", F.zip_with("a", "b", lambda x, y: x + y).alias("sum"), same.alias("ok")).drop("ok")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v of the product of matrices in (i, j, v) form."""
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
    return a.select("i", F.col("j").alias("k"), F.col("v").alias("va")).join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def reduce_all(values: DataFrame) -> DataFrame:
    """One row: sum, count, largest and smallest."""
    return values.agg(F.sum(F.col("value").cast("double")).alias("sum"), F.count("value").alias("n"), F.max("value").alias("max"), F.min("value").alias("min"))


def scatter_gather(values: DataFrame, workers: int) -> DataFrame:
    """worker and its partial sum: a fixed partition of the work and its results."""
    return values.groupBy(F.pmod(F.xxhash64("id"), F.lit(workers)).alias("worker")).agg(F.sum("value").alias("partial"), F.count(F.lit(1)).alias("n"))
