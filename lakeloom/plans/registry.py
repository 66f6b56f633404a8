"""All registered queries with their SQL, and the catalog of operators behind them."""

from __future__ import annotations

import importlib
import importlib.util
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeloom.sources.views import VIEWS, view, view_sql

DOMAINS = "payments clearing audit banking compliance graph ml temporal risk process behavioral treasury accounting orderbook core streaming".split()


@dataclass(frozen=True)
class Entry:
    """A registered query: which kernel it runs, over which views, and what SQL says the same."""

    name: str
    kernel: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


#: Bytes of Parquet, or of written shuffle, that a task gets at most: some million narrow rows, whose sorts and
#: hash tables then fit a task's share of memory however large the tables are.
PIECE = 16 << 20


def deal_by_size(spark: SparkSession, sf_dir: str, views: list[str]) -> None:
    """Sets the session so that the number of tasks grows with the tables behind ``views``, not what a task
    holds: smaller file splits and shuffle partitions, and enough of these to start from.  Smaller sizes and
    larger numbers that the session has stay."""
    files = {t for v in views for t in (re.findall(r"\{(\w+)\}", VIEWS[v]) if v in VIEWS else [v])}
    size = 0
    for t in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        if bytes_of(spark.conf.get(key)) > PIECE:
            spark.conf.set(key, str(PIECE))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * size // PIECE)))


def query(name: str, kernel: str, views: str = "", sql: str | None = None):
    """Registers a function of the named views' DataFrames.  ``sql`` is DuckDB SQL over them."""

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = views.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            deal_by_size(spark, sf_dir, names)
            return fn(*[view(spark, sf_dir, v) for v in names])

        ENTRIES[name] = Entry(name, kernel, run, sql and _with_views(sql.strip(), names))
        return fn

    return register


def _with_views(sql: str, names: list[str]) -> str:
    ctes = ", ".join(f"{v} AS MATERIALIZED ({view_sql(v)})" for v in names if v in VIEWS)
    if not ctes:
        return sql
    recursive = "RECURSIVE " if re.match(r"(?i)with recursive\b", sql) else ""
    rest = re.sub(r"(?i)^with(\s+recursive)?\s", "", sql)
    return f"WITH {recursive}{ctes}{', ' if rest != sql else ' '}{rest}"


def r(column: str | Column, digits: int = 4, name: str | None = None) -> Column:
    """A rounded double, under its own name; never a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.round(c.cast("double"), digits) + F.lit(0.0)
    return out.alias(name or column) if name or isinstance(column, str) else out


def _load() -> None:
    for d in DOMAINS:
        if importlib.util.find_spec(f"lakeloom.plans.{d}") is not None:
            importlib.import_module(f"lakeloom.plans.{d}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: e.run for k, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: e.sql for k, e in ENTRIES.items() if e.sql}


def catalog(spark: SparkSession) -> DataFrame:
    """domain, kernel, query and whether SQL checks it."""
    _load()
    rows = [(e.kernel.split("/")[0], e.kernel, e.name, e.sql is not None) for e in ENTRIES.values()]
    return spark.createDataFrame(rows, "domain string, kernel string, query string, has_sql boolean")


def search(spark: SparkSession, text: str) -> DataFrame:
    return catalog(spark).where(F.lower(F.concat_ws(" ", "kernel", "query")).contains(text.lower()))
