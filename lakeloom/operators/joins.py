"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakeloom.storage import materialise


def range_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], at: str, start: str, width: int) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal keys whose ``left.at`` is in [start, start + width] of
    ``right``.  Time is cut into buckets of ``width``; a right row goes to the two that its interval
    meets, so the join is on keys and bucket, and a busy key is dealt over its buckets."""
    cut = left.withColumn("_bucket", F.floor(F.col(at) / width))
    spans = right.withColumn("_bucket", F.explode(F.array(F.floor(F.col(start) / width), F.floor(F.col(start) / width) + 1)))
    same = [cut[a] == spans[b] for a, b in on] + [cut["_bucket"] == spans["_bucket"]]
    return cut.join(spans, same).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(start) + width)).drop("_bucket")


def as_of_join(left: DataFrame, right: DataFrame, key: str, ts: str, columns: list[str], strict: bool = True) -> DataFrame:
    """Each left row with the ``columns`` of the last right row of its key before its time (or at it,
    unless ``strict``): one sort over the union of both, without a join."""
    from pyspark.sql import Window

    lefts = left.withColumn("_row", F.struct(*left.columns))
    a = lefts.select(F.col(key), F.col(ts), F.lit(0 if strict else 1).alias("_side"), F.col("_row"), F.lit(None).cast(right.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("_v"))
    b = right.select(F.col(key), F.col(ts), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_v"))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_row IS NOT NULL")
    return both.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in columns])


def running_sum(rows: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each one by ``order``, which tells rows apart.  Ranges of
    rows are summed apart and shifted by what stands before them, so no task has all rows."""
    parts = materialise(rows.withColumn(name, value).repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("_part").agg(F.sum(name).alias("_sum"))  # a row a partition
    before = sums.select("_part", (F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"))
    own = F.sum(name).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return parts.withColumn(name, own).join(before, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
