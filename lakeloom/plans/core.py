"""Queries over vectors, matrices and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import core as op
from lakeloom.plans.registry import catalog, query, r


@query("core_add_vectors", "core/vector-add", "lineitem", "SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS id, ROUND(l_quantity + l_discount, 4) AS s0, ROUND(l_tax + l_extendedprice, 4) AS s1 FROM lineitem")
def _(li):
    v = li.select((F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("id"), F.array("l_quantity", "l_tax").alias("a"), F.array("l_discount", "l_extendedprice").alias("b"))
    return op.add_vectors(v).select("id", r(F.col("sum")[0], 4, "s0"), r(F.col("sum")[1], 4, "s1"))


@query("core_matmul", "core/matmul", "links", "SELECT a.src AS i, b.dst AS j, CAST(COUNT(*) AS BIGINT) AS v FROM links a JOIN links b ON a.dst = b.src GROUP BY 1, 2")
def _(links):
    m = links.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).cast("long").alias("v"))
    return op.matmul(m, m)


@query("core_reduce", "core/reduce-sum", "lineitem", "SELECT ROUND(SUM(l_extendedprice), 0) AS sum, COUNT(*) AS n, MAX(l_extendedprice) AS max, MIN(l_extendedprice) AS min FROM lineitem")
def _(li):
    return op.reduce_all(li.select(F.col("l_extendedprice").alias("value"))).select(r("sum", 0), "n", "max", "min")


@query("core_scatter_gather", "core/k2k-and-reductions", "lineitem", "SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS total FROM lineitem")
def _(li):
    return op.scatter_gather(li.select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("value")), 16).agg(F.sum("n").alias("n"), r(F.sum("partial"), 2, "total"))


@query("core_catalog", "core/k2k-and-reductions", "region")
def _(region):
    return catalog(region.sparkSession)
