"""Dispatch by name, and tables in and out of files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lakeloom import engine
from lakeloom.sources import files
from tests.compare import DATA

EDGES = [{"src": 1, "dst": 2}, {"src": 2, "dst": 3}, {"src": 3, "dst": 1}, {"src": 3, "dst": 4}]


NODES = [{"id": i} for i in (1, 2, 3, 4, 9)]


def test_every_domain_has_operators():
    known = engine.operators()
    assert {"graph", "ml", "payments", "temporal", "risk"} <= {n.split(".")[0] for n in known}
    assert len(known) > 150 and all(o.inputs for o in known.values())


def test_run_by_name(spark):
    name = "graph.connected_components"
    got = engine.run(name, {"edges": spark.createDataFrame(EDGES), "nodes": spark.createDataFrame(NODES)})
    assert got.count() == 5
    assert len(json.loads(engine.run_json(spark, name, json.dumps({"inputs": {"edges": EDGES, "nodes": NODES}})))) == 5
    assert {"graph_pagerank", "graph_pagerank_in"} <= set(engine.run_kernel(spark, "graph/pagerank", f"{DATA}/sf0.001"))


def test_requests_that_do_not_fit(spark):
    with pytest.raises(engine.UnknownOperator):
        engine.run("graph.nothing", {})
    with pytest.raises(engine.UnknownOperator):
        engine.run_kernel(spark, "graph/nothing", "")
    name = "graph.connected_components"
    for inputs, params in (({}, {}), ({"strange": None}, {}), ({"edges": None, "nodes": None}, {"strange": 1})):
        with pytest.raises(engine.BadRequest):
            engine.run(name, inputs, **params)
    for body in ("not json", "{}", '{"inputs": {"edges": []}}'):
        with pytest.raises(engine.BadRequest):
            engine.run_json(spark, name, body)


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_files_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b,\"c\"", None)], "i long, s string, x double")
    path = f"file://{tmp_path}/t"
    files.write(df, path, fmt, partition_by=("i",), sort_by=("s",))
    back = files.read(spark, path, fmt, schema="s string, x double, i long")
    assert sorted(back.select("i", "s", "x").collect(), key=lambda r: r.i) == df.collect()
    with pytest.raises(ValueError):
        files.read(spark, path, "xml!")


def test_bucketed_tables_join_without_shuffle(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    files.write_buckets(df, "bucketed_t", ("id",), 4, mode="overwrite")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = spark.table("bucketed_t")
        plan = t.join(t.withColumnRenamed("v", "w"), "id")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_t")
