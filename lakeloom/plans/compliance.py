"""Queries over transactions between accounts, customers and watchlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import compliance as op
from lakeloom.plans.registry import query, r

DAY = 86_400


@query("compliance_circular_flow", "compliance/circular-flow", "edges", """WITH RECURSIVE t AS (SELECT src, dst, CAST(src * 7 + dst AS DOUBLE) AS amount FROM edges),
reach(a, b) AS (SELECT DISTINCT src, dst FROM t UNION SELECT reach.a, t.dst FROM reach JOIN t ON reach.b = t.src),
scc AS (SELECT x.a AS id, MIN(x.b) AS label, COUNT(DISTINCT x.b) AS size FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT label, size, ROUND((SELECT SUM(amount) FROM t JOIN scc p ON t.src = p.id JOIN scc q ON t.dst = q.id WHERE p.label = s.label AND q.label = s.label), 2) AS amount FROM scc s WHERE size > 1 GROUP BY label, size""")  # fmt: skip
def _(e):
    t = e.select(F.col("src").alias("source_id"), F.col("dst").alias("dest_id"), (F.col("src") * 7 + F.col("dst")).cast("double").alias("amount"))
    return op.circular_flow(t).select("label", "size", r("amount", 2))


@query("compliance_circular_ratio", "compliance/circular-flow", "transactions", """WITH RECURSIVE t AS (SELECT DISTINCT source_id AS src, dest_id AS dst FROM transactions), reach(a, b) AS (SELECT src, dst FROM t UNION SELECT reach.a, t.dst FROM reach JOIN t ON reach.b = t.src),
scc AS (SELECT x.a AS id, MIN(x.b) AS label, COUNT(DISTINCT x.b) AS size FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1), i AS (SELECT COALESCE(SUM(amount), 0) AS circular FROM transactions JOIN scc p ON source_id = p.id JOIN scc q ON dest_id = q.id WHERE p.label = q.label AND p.size > 1)
SELECT ROUND(circular, 0) AS circular, (SELECT COUNT(DISTINCT label) FROM scc WHERE size > 1) AS groups, ROUND(total, 0) AS total, ROUND(circular / total, 6) AS ratio FROM i, (SELECT SUM(amount) AS total FROM transactions)""")  # fmt: skip
def _(t):
    return op.circular_ratio(t).select(r("circular", 0), "groups", r("total", 0), r("ratio", 6))


@query("compliance_reciprocal_pairs", "compliance/reciprocity-flow", "transfers", """WITH d AS (SELECT source_id AS s, dest_id AS t, SUM(amount) AS v FROM transfers GROUP BY 1, 2)
SELECT x.s AS a, x.t AS b, ROUND(x.v, 2) AS forward, ROUND(y.v, 2) AS backward, ROUND(2 * LEAST(x.v, y.v), 2) AS reciprocal FROM d x JOIN d y ON x.s = y.t AND x.t = y.s WHERE x.s <= x.t AND LEAST(x.v, y.v) >= 1000""")  # fmt: skip
def _(t):
    return op.reciprocal_pairs(t, 1000.0).select("a", "b", r("forward", 2), r("backward", 2), r("reciprocal", 2))


_SIDES = "s AS (SELECT source_id AS entity_id, * FROM transfers UNION ALL SELECT dest_id, * FROM transfers)"


@query("compliance_rapid_movement", "compliance/rapid-movement", "transfers", f"""WITH {_SIDES}, w AS (SELECT entity_id, ts, COUNT(*) OVER f AS n, SUM(amount) OVER f AS v FROM s WINDOW f AS (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND {7 * DAY - 1} FOLLOWING)),
b AS (SELECT DISTINCT ON (entity_id) entity_id, n, v FROM w ORDER BY entity_id, n DESC, ts) SELECT entity_id, ROUND(n / 168.0, 6) AS velocity, ROUND(v, 2) AS amount, n / 168.0 >= 0.02 AND v >= 100000 AS flagged FROM b""")  # fmt: skip
def _(t):
    return op.rapid_movement(t, 168.0, 0.02, 100_000.0).select("entity_id", r("velocity", 6), r("amount", 2), "flagged")


_AML = f"""u AS (SELECT * FROM transfers WHERE amount > 56000 AND amount < 80000),
w AS (SELECT source_id, ts, COUNT(*) OVER f AS n, SUM(amount) OVER f AS v FROM u WINDOW f AS (PARTITION BY source_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND {90 * DAY - 1} FOLLOWING)),
st AS (SELECT DISTINCT ON (source_id) source_id AS entity_id, n, v AS amount FROM w WHERE n >= 3 AND v > 80000 ORDER BY source_id, ts),
fu AS (SELECT dest_id AS entity_id, COUNT(DISTINCT source_id) AS n, SUM(amount) AS amount FROM transfers GROUP BY 1 HAVING COUNT(DISTINCT source_id) >= 5),
fo AS (SELECT source_id AS entity_id, COUNT(DISTINCT dest_id) AS n, SUM(amount) AS amount FROM transfers GROUP BY 1 HAVING COUNT(DISTINCT dest_id) >= 5),
p AS (SELECT 'Structuring' AS pattern, *, LEAST(n / 10, 1) AS confidence FROM st UNION ALL SELECT 'FunnelAccount', *, LEAST(n / 20, 1) FROM fu UNION ALL SELECT 'FanOut', *, LEAST(n / 20, 1) FROM fo)"""


@query("compliance_aml_patterns", "compliance/aml-patterns", "transfers", f"WITH {_AML} SELECT pattern, entity_id, n, ROUND(amount, 2) AS amount, ROUND(confidence, 6) AS confidence FROM p")
def _(t):
    return op.aml_patterns(t, 80_000.0, 24 * 90).select("pattern", "entity_id", "n", r("amount", 2), r("confidence", 6))


@query("compliance_aml_risk", "compliance/aml-patterns", "transfers", f"WITH {_AML} SELECT COUNT(*) AS patterns, LEAST(ROUND(SUM(confidence * CASE pattern WHEN 'Structuring' THEN 25 WHEN 'FunnelAccount' THEN 20 ELSE 15 END), 4), 100.0::DOUBLE) AS risk FROM p")
def _(t):
    return op.aml_risk(op.aml_patterns(t, 80_000.0, 24 * 90)).select("patterns", r("risk"))


_REV = f"""p AS (SELECT a.id AS original_id, b.id AS reversal_id, a.source_id, a.dest_id, a.amount, b.amount AS r_amount, b.ts - a.ts AS delay, LEAST(b.amount / a.amount, a.amount / b.amount) AS ratio
 FROM transactions a JOIN transactions b ON a.source_id = b.dest_id AND a.dest_id = b.source_id AND b.ts > a.ts AND b.ts <= a.ts + {20 * DAY}),
q AS (SELECT *, CASE WHEN delay < {2 * DAY} AND ratio >= 0.99 THEN 'Critical' WHEN delay < {2 * DAY} THEN 'High' WHEN delay < {5 * DAY} AND ratio >= 0.99 THEN 'High' WHEN delay < {5 * DAY} OR ratio >= 0.99 THEN 'Suspicious' ELSE 'Normal' END AS risk FROM p WHERE ratio >= 0.9)"""


def _reversals(t):
    return op.flow_reversals(t, 20 * DAY, 5 * DAY, 2 * DAY)


@query("compliance_flow_reversals", "compliance/flow-reversal", "transactions", f"WITH {_REV} SELECT original_id, reversal_id, delay, ROUND(ratio, 6) AS ratio, risk FROM q")
def _(t):
    return _reversals(t).select("original_id", "reversal_id", "delay", r("ratio", 6), "risk")


@query("compliance_reversal_summary", "compliance/flow-reversal", "transactions", f"""WITH {_REV}, c AS (SELECT e, COUNT(*) AS n FROM (SELECT source_id AS e FROM q UNION ALL SELECT dest_id FROM q) GROUP BY 1),
a AS (SELECT COUNT(*) AS reversals, SUM(amount + r_amount) AS volume, COUNT(*) FILTER (WHERE risk IN ('High', 'Critical')) AS high, (SELECT COUNT(*) FROM c WHERE n >= 2) AS repeat_offenders, (SELECT SUM(amount) FROM transactions) AS total FROM q)
SELECT reversals, ROUND(volume, 0) AS volume, ROUND(volume / total, 6) AS ratio, repeat_offenders, LEAST(ROUND(reversals * 5 + high * 15 + repeat_offenders * 10 + volume / total * 50, 2), 100.0::DOUBLE) AS risk_score FROM a""")  # fmt: skip
def _(t):
    return op.reversal_summary(_reversals(t), t).select("reversals", r("volume", 0), r("ratio", 6), "repeat_offenders", r("risk_score", 2))


@query("compliance_flow_splits", "compliance/flow-split", "transfers")
def _(t):
    return op.flow_splits(t, 20_000.0, 30 * DAY).select("source_id", "n", r("amount", 2), "span", "risk")


@query("compliance_kyc_scores", "compliance/kyc-scoring", "kyc", """WITH k AS (SELECT *, 100 - documentation_score AS gap, (10 - LEAST(tenure_years, 10)) * 10 AS tenure FROM kyc),
s AS (SELECT *, country_risk * 0.25 + industry_risk * 0.2 + product_risk * 0.15 + transaction_risk * 0.2 + gap * 0.1 + tenure * 0.1 AS v FROM k)
SELECT customer_id, ROUND(gap, 4) AS documentation_gap, ROUND(tenure, 4) AS tenure_risk, ROUND(v, 4) AS risk_score, CASE WHEN ROUND(v, 6) < 25 THEN 'Low' WHEN ROUND(v, 6) < 50 THEN 'Medium' WHEN ROUND(v, 6) < 75 THEN 'High' ELSE 'VeryHigh' END AS risk_tier FROM s""")  # fmt: skip
def _(k):
    s = op.kyc_scores(k).withColumn("risk_score", F.round("risk_score", 6)).withColumn("risk_tier", op.tier("risk_score"))
    return s.select("customer_id", r("documentation_gap"), r("tenure_risk"), r("risk_score"), "risk_tier")


def _queries(c):
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey").cast("string"))).alias("name"))


def _watchlist(s):
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 13).cast("string"), 9, "0"))).alias("aliases"))


@query("compliance_sanctions_screening", "compliance/sanctions-screening", "customer supplier")
def _(c, s):
    return op.screen(_queries(c), _watchlist(s)).select("query_id", "entry_id", r("score", 6), "rank", "is_hit")


@query("compliance_pep_screening", "compliance/pep-screening", "customer supplier")
def _(c, s):
    return op.screen_pep(_queries(c), _watchlist(s).select("id", "name", (F.col("id") % 4).alias("level"))).select("query_id", "entry_id", "level", r("score", 6), "rank", "is_pep")


@query("compliance_entity_resolution", "compliance/entity-resolution", "customer")
def _(c):
    people = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 300).cast("string"))).alias("aliases"), (F.lit(19500101) + F.col("c_custkey") % 40 * 10000 + F.col("c_custkey") % 12 * 100).cast("long").alias("birth_date"), F.col("c_nationkey").alias("country"))
    return op.resolve_entities(people.where("id % 20 = 0"), people).select("query_id", "entity_id", r("name_score", 6), r("score", 6), "rank")


_NOW = 900_000_000
_RULES = ((1, "SingleAmount", 90_000.0, 0, "High"), (2, "AggregateAmount", 300_000.0, 30 * DAY, "Medium"), (3, "TransactionCount", 8.0, 60 * DAY, "Medium"), (4, "Velocity", 200.0, 60 * DAY, "High"))


@query("compliance_transaction_monitoring", "compliance/transaction-monitoring", "transfers", f"""WITH {_SIDES},
g AS (SELECT entity_id, COALESCE(SUM(amount) FILTER (WHERE ts >= {_NOW - 30 * DAY}), 0) AS v2, CAST(COUNT(*) AS DOUBLE) AS v3, SUM(amount) / {60 * 24} AS v4 FROM s WHERE ts >= {_NOW - 60 * DAY} AND ts < {_NOW} GROUP BY 1)
SELECT 1 AS rule_id, source_id AS entity_id, id AS tx_id, 'High' AS severity, ROUND(amount, 2) AS value FROM transfers WHERE amount >= 90000
UNION ALL SELECT 2, entity_id, -1, 'Medium', ROUND(v2, 2) FROM g WHERE v2 >= 300000 UNION ALL SELECT 3, entity_id, -1, 'Medium', v3 FROM g WHERE v3 >= 8 UNION ALL SELECT 4, entity_id, -1, 'High', ROUND(v4, 2) FROM g WHERE v4 >= 200""")  # fmt: skip
def _(t):
    return op.monitor(t, _NOW, _RULES).select("rule_id", "entity_id", "tx_id", "severity", r("value", 2))


@query("compliance_default_rules", "compliance/transaction-monitoring", "region", "SELECT * FROM (VALUES (1, 'SingleAmount', 10000.0::DOUBLE, 0, 'High'), (2, 'AggregateAmount', 10000.0, 86400, 'Medium'), (3, 'TransactionCount', 50.0, 86400, 'Medium'), (4, 'Velocity', 5000.0, 3600, 'High')) t(rule_id, rule_type, threshold, window_seconds, severity)")
def _(region):
    return region.sparkSession.createDataFrame(list(op.DEFAULT_RULES), "rule_id int, rule_type string, threshold double, window_seconds int, severity string")


@query("compliance_entity_circularity", "compliance/circular-flow", "links", """WITH RECURSIVE t AS (SELECT src, dst, CAST(src * 7 + dst AS DOUBLE) AS amount FROM links WHERE src < dst OR (src + dst) % 5 < 2), reach(a, b) AS (SELECT src, dst FROM t UNION SELECT reach.a, t.dst FROM reach JOIN t ON reach.b = t.src),
ids AS (SELECT src AS id FROM t UNION SELECT dst FROM t), same AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a), g AS (SELECT t.src AS id, SUM(amount) AS o, COALESCE(SUM(amount) FILTER (WHERE same.a IS NOT NULL), 0) AS c FROM t LEFT JOIN same ON same.a = t.src AND same.b = t.dst GROUP BY 1)
SELECT ids.id AS entity_id, ROUND(CASE WHEN o > 0 THEN c / o ELSE 0 END, 6) AS ratio, CASE WHEN EXISTS (SELECT 1 FROM same WHERE same.a = ids.id AND same.b <> ids.id) THEN 1 ELSE 0 END AS groups, ROUND(COALESCE(c, 0), 2) AS amount FROM ids LEFT JOIN g USING (id)""")  # fmt: skip
def _(e):
    t = e.where("src < dst OR (src + dst) % 5 < 2").select(F.col("src").alias("source_id"), F.col("dst").alias("dest_id"), (F.col("src") * 7 + F.col("dst")).cast("double").alias("amount"))
    return op.entity_circularity(t).select("entity_id", r("ratio", 6), "groups", r("amount", 2))
