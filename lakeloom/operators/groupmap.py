"""Ordered per-group Python over sorted partitions.

Groups are streamed: a task holds one group at a time (or, of folds, one batch of it), and many small groups share one call into
Python, unlike a grouped map, which pays for each group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the rows of a key in one task, dealt by a hash of the keys.  Spark leaves a repartition by
    the keys themselves out where its input is dealt by them already, as a union of joins and totals is; what
    it then does to that input's partitions (joining small ones, splitting large ones) parts the rows of a key."""
    return df.repartition(F.xxhash64(*keys))


def ordered_groups(df: DataFrame, keys: list[str], order: list[str | Column], fn: Callable[[tuple, list[dict]], Iterable[tuple]], schema: str, batch_rows: int = 20_000, whole: bool = True) -> DataFrame:
    """Rows of ``schema`` that ``fn(key, rows)`` gives for each group of ``keys``, its rows as dicts in
    ``order``.  Groups meet in one task each; keys should be fine enough for a group to fit one.  Without
    ``whole``, ``fn`` gets an iterator and the task holds a batch of rows, however large a group is."""
    spark = df.sparkSession
    target = spark.createDataFrame([], schema).schema
    names = [f.name for f in target]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(target)
        rows = (row for b in batches for row in b.to_pylist())
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], names=names)

        for key, group in groupby(rows, key=lambda x: tuple(x[k] for k in keys)):
            for row in fn(key, list(group) if whole else group):
                out.append(row)
                if len(out) >= batch_rows:
                    yield flush()
                    out.clear()
        if out:
            yield flush()

    return dealt(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(task, schema)
