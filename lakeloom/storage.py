"""Scratch tables that outlive lost executors.

Everything an operator writes between two jobs goes under ``spark.checkpoint.dir``, the one
folder the cluster names as shared.  The setting is read from the session; a private folder is
used only where it is unset and Spark runs in one process, as in local tests.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANED: set[str] = set()
#: For tables whose rows are blobs of megabytes: a row group for each row, so that neither writer nor
#: reader holds more than one of them.
_BLOB_OPTIONS = {"parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # what is left over does no harm
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table called ``name``.  The folder of an application is deleted when its
    driver ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/lakeloom/{app}"
    if app not in _CLEANED:
        _CLEANED.add(app)
        atexit.register(_delete, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), blobs: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and
    the planner sees the true size of what it joins.  ``blobs`` is for rows of megabytes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer = writer.options(**_BLOB_OPTIONS) if blobs else writer
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._scratch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
