"""Queries over audit records."""

from __future__ import annotations

from lakeloom.operators import audit as op
from lakeloom.plans.registry import query, r

_VOL = "".join(f", CAST(COUNT(*) FILTER (WHERE record_type = '{t}') AS DOUBLE) AS count_{t.lower()}" for t in op.TYPES)
_V = f"SELECT entity_id, CAST(COUNT(*) AS DOUBLE) AS total_count, SUM(amount) AS total_amount, AVG(amount) AS avg_amount, MAX(amount) AS max_amount, STDDEV_POP(amount) AS std_amount{_VOL} FROM audit_records GROUP BY 1"
_T = """SELECT entity_id, (MAX(ts) - MIN(ts)) / 86400 AS time_span_days, CASE WHEN COUNT(*) > 1 THEN (MAX(ts) - MIN(ts)) / 3600 / (COUNT(*) - 1) ELSE 0 END AS avg_interval_hours,
 CASE WHEN MAX(ts) > MIN(ts) THEN COUNT(DISTINCT ts // 86400) / GREATEST((MAX(ts) - MIN(ts)) / 86400, 1) ELSE 0 END AS activity_ratio, AVG(CASE WHEN ts // 86400 % 7 IN (5, 6) THEN 1 ELSE 0 END) AS weekend_ratio,
 AVG(CASE WHEN ts // 86400 % 30 >= 25 THEN 1 ELSE 0 END) AS month_end_ratio, AVG(CASE WHEN ts // 3600 % 24 BETWEEN 9 AND 16 THEN 0 ELSE 1 END) AS off_hours_ratio FROM audit_records GROUP BY 1"""
_HHI = "SELECT entity_id, SUM(n * n) / (SUM(n) * SUM(n)) AS {1} FROM (SELECT entity_id, {0}, COUNT(*) AS n FROM audit_records GROUP BY 1, 2) GROUP BY 1"
_D = f"""SELECT entity_id, CASE WHEN n < 3 OR sd < 2.3e-16 THEN 0 ELSE m3 / (sd * sd * sd) END AS amount_skewness, CASE WHEN n < 4 OR sd < 2.3e-16 THEN 0 ELSE m4 / (sd * sd * sd * sd) - 3 END AS amount_kurtosis, rnd AS round_number_ratio, category_concentration
 FROM (SELECT entity_id, COUNT(*) AS n, MAX(sd) AS sd, AVG((amount - mean) ** 3) AS m3, AVG((amount - mean) ** 4) AS m4, AVG(CASE WHEN abs(amount % 100) < 0.01 OR abs(amount % 1000) < 0.01 THEN 1 ELSE 0 END) AS rnd
 FROM (SELECT entity_id, amount, AVG(amount) OVER (PARTITION BY entity_id) AS mean, STDDEV_POP(amount) OVER (PARTITION BY entity_id) AS sd FROM audit_records) GROUP BY 1) JOIN ({_HHI.format('category', 'category_concentration')}) USING (entity_id)"""
_N = f"""SELECT entity_id, CAST(COUNT(DISTINCT account) AS DOUBLE) AS unique_accounts, CAST(COUNT(DISTINCT counter_party) AS DOUBLE) AS unique_counterparties, AVG(CASE WHEN account = counter_party THEN 1 ELSE 0 END) AS self_transaction_ratio, ANY_VALUE(counterparty_concentration) AS counterparty_concentration
 FROM audit_records JOIN ({_HHI.format('counter_party', 'counterparty_concentration')}) USING (entity_id) GROUP BY 1"""
_VCOLS = ["total_count", "total_amount", "avg_amount", "max_amount", "std_amount", *[f"count_{t.lower()}" for t in op.TYPES]]
_TCOLS = ["time_span_days", "avg_interval_hours", "activity_ratio", "weekend_ratio", "month_end_ratio", "off_hours_ratio"]
_DCOLS = ["amount_skewness", "amount_kurtosis", "round_number_ratio", "category_concentration"]
_NCOLS = ["unique_accounts", "unique_counterparties", "self_transaction_ratio", "counterparty_concentration"]


def _sql(body: str, cols: list[str]) -> str:
    return f"SELECT entity_id, {', '.join(f'ROUND({c}, 4) + 0.0 AS {c}' for c in cols)} FROM ({body})"


for _name, _fn, _body, _cols in (("volume", op.volume_features, _V, _VCOLS), ("temporal", op.temporal_features, _T, _TCOLS), ("distribution", op.distribution_features, _D, _DCOLS), ("network", op.network_features, _N, _NCOLS)):
    query(f"audit_{_name}_features", "audit/feature-extraction", "audit_records", _sql(_body, _cols))(lambda a, fn=_fn, cols=_cols: fn(a).select("entity_id", *[r(c) for c in cols]))

_ALL = f"f AS (SELECT * FROM ({_V}) JOIN ({_T}) USING (entity_id) JOIN ({_D}) USING (entity_id) JOIN ({_N}) USING (entity_id)), l AS (UNPIVOT f ON COLUMNS(* EXCLUDE entity_id) INTO NAME feature VALUE value)"
_SCORED = f"{_ALL}, st AS (SELECT feature, AVG(value) AS mean, STDDEV_POP(value) AS sd FROM l GROUP BY 1), sc AS (SELECT entity_id, AVG(ABS(value - mean) / sd) AS score FROM l JOIN st USING (feature) WHERE sd > 0 GROUP BY 1)"


@query("audit_entity_features", "audit/feature-extraction", "audit_records", f"WITH {_ALL} SELECT entity_id, feature, ROUND(value, 4) + 0.0 AS value FROM l")
def _(a):
    return op.long_features(op.entity_features(a)).select("entity_id", "feature", r("value"))


@query("audit_global_stats", "audit/feature-extraction", "audit_records", f"WITH {_SCORED} SELECT feature, ROUND(mean, 4) + 0.0 AS mean, ROUND(sd, 4) AS sd FROM st")
def _(a):
    return op.global_stats(op.entity_features(a)).select("feature", r("mean"), r("sd"))


@query("audit_anomaly_scores", "audit/feature-extraction", "audit_records", f"WITH {_SCORED} SELECT entity_id, ROUND(score, 5) AS score FROM sc")
def _(a):
    return op.anomaly_scores(op.entity_features(a)).select("entity_id", r("score", 5))


@query("audit_top_anomalies", "audit/feature-extraction", "audit_records", f"WITH {_SCORED} SELECT entity_id, ROUND(score, 5) AS score FROM sc ORDER BY sc.score DESC, entity_id LIMIT 10")
def _(a):
    return op.top_anomalies(op.entity_features(a), 10).select("entity_id", r("score", 5))


_E = """e AS (SELECT id AS edge_id, CASE WHEN record_type IN ('Payment', 'Transfer') THEN 'Transaction' WHEN record_type IN ('Invoice', 'Receipt') THEN 'DocumentRef' WHEN record_type IN ('JournalEntry', 'Adjustment') THEN 'AccountRel' ELSE 'CategoryMembership' END AS edge_type,
 amount AS weight, ['entity:' || entity_id, 'account:' || account, 'category:' || category] AS nodes FROM audit_records), x AS (SELECT edge_id, unnest(nodes) AS node FROM e), c AS (SELECT node, COUNT(*) AS degree, COUNT(*) / (SELECT COUNT(*) FROM e) AS centrality FROM x GROUP BY 1)"""


@query("audit_hyperedges", "audit/hypergraph", "audit_records", f"WITH {_E} SELECT edge_id, edge_type, ROUND(weight, 2) AS weight, array_to_string(nodes, ',') AS nodes FROM e")
def _(a):
    return op.hyperedges(a).selectExpr("edge_id", "edge_type", "round(weight, 2) as weight", "array_join(nodes, ',') as nodes")


@query("audit_node_centrality", "audit/hypergraph", "audit_records", f"WITH {_E} SELECT node, degree, ROUND(centrality, 8) AS centrality FROM c")
def _(a):
    return op.node_centrality(op.hyperedges(a)).select("node", "degree", r("centrality", 8))


@query("audit_edge_weights", "audit/hypergraph", "audit_records", f"WITH {_E} SELECT edge_id, ROUND(weight / (SELECT MAX(weight) FROM e), 8) AS weight FROM e")
def _(a):
    return op.edge_weights(op.hyperedges(a)).select("edge_id", r("weight", 8))


@query("audit_hypergraph_components", "audit/hypergraph", "audit_records", f"WITH {_E} SELECT node, (SELECT MIN(node) FROM c) AS label FROM c")
def _(a):
    return op.hypergraph_components(op.hyperedges(a))


@query("audit_hypergraph_patterns", "audit/hypergraph", "audit_records", f"WITH {_E}, s AS (SELECT AVG(centrality) AS m, STDDEV_POP(centrality) AS sd FROM c) SELECT 'HighCentralityHub' AS pattern, node, ROUND((centrality - m) / sd / 3, 6) AS confidence FROM c, s WHERE centrality > m + 2 * sd")
def _(a):
    return op.hypergraph_patterns(op.hyperedges(a)).select("pattern", "node", r("confidence", 6))


@query("audit_shared_edges", "audit/hypergraph", "audit_records", f"WITH {_E}, n AS (SELECT * FROM x WHERE node LIKE 'category:%' OR node LIKE 'account:%') SELECT p.node AS a, q.node AS b, COUNT(*) AS shared FROM n p JOIN n q USING (edge_id) WHERE p.node < q.node GROUP BY 1, 2")
def _(a):
    return op.shared_edges(op.hyperedges(a, entity=False), "")


@query("audit_hypergraph_stats", "audit/hypergraph", "audit_records", f"WITH {_E} SELECT (SELECT COUNT(*) FROM e) AS edge_count, 3.0 AS avg_edge_size, COUNT(*) AS node_count, ROUND(AVG(degree), 6) AS avg_node_degree, 1 AS component_count, 0.0 AS density FROM c")
def _(a):
    return op.hypergraph_stats(op.hyperedges(a)).select("edge_count", r("avg_edge_size"), "node_count", r("avg_node_degree", 6), "component_count", r("density"))
