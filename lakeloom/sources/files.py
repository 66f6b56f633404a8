"""Tables in and out of files.

Formats are Spark's own.  Readers take the schema where one is known: text formats are not
scanned twice to infer it, and malformed values become nulls or errors as asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "text")


def _checked(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {', '.join(FORMATS)}")
    return fmt


def read(spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema: str | StructType | None = None, strict: bool = False, **options) -> DataFrame:
    """The table at ``path``; ``strict`` fails on malformed text records instead of nulling them."""
    reader = spark.read.format(_checked(fmt))
    if fmt == "csv":
        options = {"header": True, **options}
    if fmt in ("csv", "json"):
        options = {"mode": "FAILFAST" if strict else "PERMISSIVE", **options}
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def read_stream(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    if fmt == "csv":
        options = {"header": True, **options}
    if files_per_batch:
        options["maxFilesPerTrigger"] = files_per_batch
    return spark.readStream.format(_checked(fmt)).schema(schema).options(**options).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), **options) -> None:
    """Writes ``df``; sorting within files lets readers skip row groups by their minima and maxima."""
    if fmt == "csv":
        options = {"header": True, **options}
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.format(_checked(fmt)).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_buckets(df: DataFrame, name: str, by: tuple[str, ...], buckets: int, mode: str = "errorifexists") -> None:
    """A catalog table that is dealt and sorted by its join keys, so that joins and aggregations on
    them need no shuffle."""
    df.write.format("parquet").mode(mode).bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)
