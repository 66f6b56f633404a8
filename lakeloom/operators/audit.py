"""Audit features and hypergraphs of audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeloom.operators.iterate import components

TYPES = ("JournalEntry", "Invoice", "Payment", "Receipt", "Adjustment", "Transfer", "Expense", "Revenue")
EDGE_TYPES = {"Payment": "Transaction", "Transfer": "Transaction", "Invoice": "DocumentRef", "Receipt": "DocumentRef", "JournalEntry": "AccountRel", "Adjustment": "AccountRel", "Expense": "CategoryMembership", "Revenue": "CategoryMembership"}


def volume_features(records: DataFrame) -> DataFrame:
    kinds = [F.count(F.when(F.col("record_type") == t, 1)).cast("double").alias(f"count_{t.lower()}") for t in TYPES]
    zero = F.lit(0.0)
    return records.groupBy("entity_id").agg(
        F.count(F.lit(1)).cast("double").alias("total_count"), F.coalesce(F.sum("amount"), zero).alias("total_amount"), F.coalesce(F.avg("amount"), zero).alias("avg_amount"),
        F.greatest(F.coalesce(F.max("amount"), zero), zero).alias("max_amount"), F.coalesce(F.stddev_pop("amount"), zero).alias("std_amount"), *kinds,
    )


def temporal_features(records: DataFrame) -> DataFrame:
    """Span in days, mean gap in hours, active days a day, and shares of records on days 5 and 6 of the
    epoch week, in the last 5 of 30 days, and outside of 9 to 17 h."""
    day, hour = F.floor(F.col("ts") / 86400), F.floor(F.col("ts") / 3600) % 24
    a = records.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), (F.max("ts") - F.min("ts")).alias("span"), F.count_distinct(day).alias("days"),
        F.avg(F.when((day % 7).isin(5, 6), 1.0).otherwise(0.0)).alias("weekend_ratio"), F.avg(F.when(day % 30 >= 25, 1.0).otherwise(0.0)).alias("month_end_ratio"), F.avg(F.when((hour < 9) | (hour >= 17), 1.0).otherwise(0.0)).alias("off_hours_ratio"),
    )
    span = F.col("span") / 86400
    return a.select("entity_id", span.alias("time_span_days"), F.when(F.col("n") > 1, F.col("span") / 3600 / (F.col("n") - 1)).otherwise(0.0).alias("avg_interval_hours"), F.when(span > 0, F.col("days") / F.greatest(span, F.lit(1.0))).otherwise(0.0).alias("activity_ratio"), "weekend_ratio", "month_end_ratio", "off_hours_ratio")


def _concentration(records: DataFrame, column: str, name: str) -> DataFrame:
    """Herfindahl index of a column's values by entity; 0 without any."""
    n = records.groupBy("entity_id", column).agg(F.count(column).alias("n"))
    return n.groupBy("entity_id").agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("n")), F.sum("n") * F.sum("n")).cast("double"), F.lit(0.0)).alias(name))


def distribution_features(records: DataFrame) -> DataFrame:
    """Population skewness (0 for under 3 values) and excess kurtosis (under 4), share of round amounts
    and concentration of categories."""
    rounds = F.when((F.abs(F.col("amount") % 100) < 0.01) | (F.abs(F.col("amount") % 1000) < 0.01), 1.0).when(F.col("amount").isNotNull(), 0.0)
    a = records.groupBy("entity_id").agg(F.count("amount").alias("n"), F.stddev_pop("amount").alias("sd"), F.skewness("amount").alias("sk"), F.kurtosis("amount").alias("ku"), F.coalesce(F.avg(rounds), F.lit(0.0)).alias("round_number_ratio"))
    flat = F.col("sd").isNull() | (F.col("sd") < 2.220446049250313e-16)
    a = a.withColumn("amount_skewness", F.when((F.col("n") < 3) | flat, 0.0).otherwise(F.col("sk"))).withColumn("amount_kurtosis", F.when((F.col("n") < 4) | flat, 0.0).otherwise(F.col("ku")))
    return a.select("entity_id", "amount_skewness", "amount_kurtosis", "round_number_ratio").join(_concentration(records, "category", "category_concentration"), "entity_id")


def network_features(records: DataFrame) -> DataFrame:
    self_tx = F.when(F.col("account") == F.col("counter_party"), 1.0).otherwise(0.0)
    a = records.groupBy("entity_id").agg(F.count_distinct("account").cast("double").alias("unique_accounts"), F.count_distinct("counter_party").cast("double").alias("unique_counterparties"), F.avg(self_tx).alias("self_transaction_ratio"))
    return a.join(_concentration(records, "counter_party", "counterparty_concentration"), "entity_id")


def entity_features(records: DataFrame) -> DataFrame:
    """All features, one row per entity."""
    return volume_features(records).join(temporal_features(records), "entity_id").join(distribution_features(records), "entity_id").join(network_features(records), "entity_id")


def long_features(features: DataFrame) -> DataFrame:
    """entity_id, feature, value."""
    return features.unpivot("entity_id", [c for c in features.columns if c != "entity_id"], "feature", "value")


def global_stats(features: DataFrame) -> DataFrame:
    """Mean and population standard deviation of each feature."""
    return long_features(features).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def anomaly_scores(features: DataFrame) -> DataFrame:
    """The mean absolute z score over features that vary."""
    names = [c for c in features.columns if c != "entity_id"]
    stats = features.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names])
    zs = F.array_compact(F.array(*[F.when(F.col(f"s_{c}") > 0, F.abs(F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c in names]))
    score = F.aggregate(zs, F.lit(0.0), lambda a, x: a + x) / F.size(zs)
    return features.crossJoin(F.broadcast(stats)).where(F.size(zs) > 0).select("entity_id", score.alias("score"))


def top_anomalies(features: DataFrame, limit: int = 10) -> DataFrame:
    return anomaly_scores(features).orderBy(F.col("score").desc(), "entity_id").limit(limit)


def hyperedges(records: DataFrame, entity: bool = True, account: bool = True, transaction: bool = False, category: bool = True, day: bool = False, least: int = 2) -> DataFrame:
    """edge_id, edge_type, weight and nodes (prefixed ids) of each record with enough nodes."""
    parts = [(entity, F.concat(F.lit("entity:"), "entity_id")), (account, F.concat(F.lit("account:"), "account")), (transaction, F.concat(F.lit("tx:"), F.col("id").cast("string"))), (category, F.concat(F.lit("category:"), "category")), (day, F.concat(F.lit("day:"), F.floor(F.col("ts") / 86400).cast("string")))]
    nodes = F.array_compact(F.array(*[c for on, c in parts if on]))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_TYPES.items() for x in kv]), F.col("record_type"))
    return records.select(F.col("id").alias("edge_id"), kind.alias("edge_type"), F.coalesce("amount", F.lit(1.0)).alias("weight"), nodes.alias("nodes")).where(F.size("nodes") >= least)


def node_centrality(edges: DataFrame) -> DataFrame:
    """node, degree and the share of all hyperedges that hold it."""
    total = edges.agg(F.count(F.lit(1)).alias("total"))
    n = edges.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return n.crossJoin(F.broadcast(total)).select("node", "degree", (F.col("degree") / F.col("total")).alias("centrality"))


def edge_weights(edges: DataFrame) -> DataFrame:
    top = edges.agg(F.max("weight").alias("top"))
    return edges.crossJoin(F.broadcast(top)).select("edge_id", F.when(F.col("top") > 0, F.col("weight") / F.col("top")).otherwise(0.0).alias("weight"))


def hypergraph_components(edges: DataFrame) -> DataFrame:
    """node and label: nodes of an edge are chained, so links grow with the edges' size."""
    pairs = edges.select(F.element_at("nodes", 1).alias("a"), F.explode("nodes").alias("b")).distinct()
    return components(pairs).withColumnRenamed("id", "node")


def shared_edges(edges: DataFrame, prefix: str = "entity:") -> DataFrame:
    """a < b and how many hyperedges two nodes of a kind share."""
    n = edges.select("edge_id", F.explode("nodes").alias("a")).where(F.col("a").startswith(prefix))
    return n.join(n.withColumnRenamed("a", "b"), "edge_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def hypergraph_patterns(edges: DataFrame) -> DataFrame:
    """pattern, node or label, and confidence: hubs over mean + 2 standard deviations, and components
    that hold under a tenth of the nodes."""
    c = node_centrality(edges)
    stats = F.broadcast(c.agg(F.avg("centrality").alias("m"), F.stddev_pop("centrality").alias("s")))
    hubs = c.crossJoin(stats).where(F.col("centrality") > F.col("m") + 2 * F.col("s")).select(F.lit("HighCentralityHub").alias("pattern"), "node", ((F.col("centrality") - F.col("m")) / F.col("s") / 3).alias("confidence"))
    sizes = hypergraph_components(edges).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = F.broadcast(sizes.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")))
    small = sizes.crossJoin(whole).where((F.col("k") > 1) & (F.col("n") < F.floor(F.col("all") / 10))).select(F.lit("IsolatedComponent").alias("pattern"), F.col("label").alias("node"), F.lit(0.8).alias("confidence"))
    return hubs.unionByName(small)


def hypergraph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean edge size and node degree, components, density = edges / (2^n - n - 1)."""
    size = edges.agg(F.count(F.lit(1)).alias("edge_count"), F.avg(F.size("nodes")).alias("avg_edge_size"))
    nodes = node_centrality(edges).agg(F.count(F.lit(1)).alias("node_count"), F.avg("degree").alias("avg_node_degree"))
    parts = hypergraph_components(edges).agg(F.count_distinct("label").alias("component_count"))
    n = F.col("node_count").cast("double")
    density = F.when(n > 1000, 0.0).otherwise(F.least(F.col("edge_count") / (F.pow(F.lit(2.0), F.least(n, F.lit(1000.0))) - n - 1), F.lit(1.0)))
    return size.crossJoin(F.broadcast(nodes)).crossJoin(F.broadcast(parts)).withColumn("density", density)

