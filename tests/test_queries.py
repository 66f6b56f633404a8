"""Every query with SQL against DuckDB, kernel by kernel, and that all others run."""

from __future__ import annotations

import pytest

from lakeloom.plans import registry
from tests.compare import DATA, connect, rows

registry._load()
KERNELS = sorted({e.kernel for e in registry.ENTRIES.values()})


@pytest.fixture(scope="module")
def duck():
    return connect("sf0.001")


@pytest.mark.parametrize("kernel", KERNELS)
def test_kernel(spark, duck, kernel):
    for e in registry.ENTRIES.values():
        if e.kernel == kernel:
            got = e.run(spark, f"{DATA}/sf0.001").toPandas()
            assert e.sql is None or rows(got) == rows(duck.execute(e.sql).df()), e.name


def test_entries_stay_whole_where_their_tables_are_dealt_by_entry(spark, duck):
    # joined by sorting, as large tables are, both sides of the journal's union are dealt by entry, and
    # their small partitions put together differently
    conf = {"spark.sql.autoBroadcastJoinThreshold": "5000", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        flows = [registry.ENTRIES[f"accounting_{k}"] for k in ("generate_flows", "account_flows", "boosted_flows", "recent_flows", "flows_between")]
        assert [e.name for e in flows if rows(e.run(spark, f"{DATA}/sf0.001").toPandas()) != rows(duck.execute(e.sql).df())] == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_every_domain_is_registered():
    assert len(KERNELS) >= 106
    assert {k.split("/")[0] for k in KERNELS} == {"accounting", "audit", "banking", "behavioral", "clearing", "compliance", "core", "graph", "ml", "orderbook", "payments", "procint", "risk", "temporal", "treasury"}


def test_catalog_can_be_searched(spark):
    assert registry.search(spark, "pagerank").count() >= 2


def test_tasks_grow_with_the_tables(spark, tmp_path):
    number = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    for i in range(3):
        (tmp_path / f"{('orders', 'lineitem', 'part')[i]}.parquet").mkdir()
        (tmp_path / f"{('orders', 'lineitem', 'part')[i]}.parquet" / "x").write_bytes(b"x" * (30 << 20))
    registry.deal_by_size(spark, str(tmp_path), ["transactions", "part"])
    assert int(spark.conf.get(number)) == 23  # 90 MB by 4
    assert [int(spark.conf.get(k).rstrip("b")) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")] == [registry.PIECE] * 2
    registry.ENTRIES["core_matmul"].run(spark, f"{DATA}/sf0.001")
    assert int(spark.conf.get(number)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
