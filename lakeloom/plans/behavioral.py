"""Queries over user events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import behavioral as op
from lakeloom.plans.registry import query, r

_H = "h AS (SELECT user_id, ts // 3600 % 24 AS hour, COUNT(*) AS n, COUNT(*) FILTER (WHERE ts // 86400 % 7 IN (5, 6)) AS odd FROM user_events GROUP BY 1, 2), hp AS (SELECT *, n / SUM(n) OVER (PARTITION BY user_id) AS p FROM h)"
_TEMP = f"{_H}, tf AS (SELECT user_id, CAST(arg_max(hour, (n, hour)) AS DOUBLE) AS peak_hour, SUM(CASE WHEN hour BETWEEN 9 AND 17 THEN p ELSE 0 END) AS business_ratio, SUM(CASE WHEN hour >= 22 OR hour < 6 THEN p ELSE 0 END) AS night_ratio, SUM(odd) / SUM(n) AS weekend_ratio, -SUM(p * ln(p)) AS hour_entropy FROM hp GROUP BY 1)"


def _rounded(cols: str) -> str:
    return ", ".join(f"ROUND({c}, 6) + 0.0 AS {c}" for c in cols.split())


_TC = "peak_hour business_ratio night_ratio weekend_ratio hour_entropy"


@query("behavioral_temporal_features", "behavioral/profiling", "user_events", f"WITH {_TEMP} SELECT user_id, {_rounded(_TC)} FROM tf")
def _(e):
    return op.temporal_features(e).select("user_id", *[r(c, 6) for c in _TC.split()])


_FREQ = """g AS (SELECT user_id, event_type, ts, ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, id) AS gap FROM user_events), tp AS (SELECT user_id, MAX(k) AS top FROM (SELECT user_id, event_type, COUNT(*) AS k FROM user_events GROUP BY 1, 2) GROUP BY 1),
ff AS (SELECT g.user_id, COUNT(*) / GREATEST((MAX(ts) - MIN(ts)) / 86400, 1) AS avg_events_per_day, ANY_VALUE(top) / COUNT(*) AS dominant_ratio, COUNT(DISTINCT event_type) / COUNT(*) AS diversity, COALESCE(AVG(gap), 0) AS mean_gap, COALESCE(STDDEV_POP(gap), 0) AS sd_gap FROM g JOIN tp USING (user_id) GROUP BY 1)"""
_FC = "avg_events_per_day dominant_ratio diversity mean_gap sd_gap"


@query("behavioral_frequency_features", "behavioral/profiling", "user_events", f"WITH {_FREQ} SELECT user_id, {', '.join(f'ROUND({c}, 4) AS {c}' for c in _FC.split())} FROM ff")
def _(e):
    return op.frequency_features(e).select("user_id", *[r(c) for c in _FC.split()])


@query("behavioral_session_features", "behavioral/profiling", "user_events", "WITH s AS (SELECT user_id, session_id, COUNT(*) AS n, MAX(ts) - MIN(ts) AS span FROM user_events GROUP BY 1, 2) SELECT user_id, CAST(COUNT(*) AS DOUBLE) AS session_count, ROUND(AVG(n), 4) AS events_per_session, ROUND(AVG(span), 4) AS session_seconds FROM s GROUP BY 1")
def _(e):
    return op.session_features(e).select("user_id", "session_count", r("events_per_session"), r("session_seconds"))


_DEV = """sw AS (SELECT user_id, device_id, location, LAG(device_id) OVER w AS d, LAG(location) OVER w AS l FROM user_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
df AS (SELECT user_id, CAST(COUNT(DISTINCT device_id) AS DOUBLE) AS unique_device_count, CAST(COUNT(DISTINCT location) AS DOUBLE) AS unique_location_count, COUNT(*) FILTER (WHERE device_id <> d) / GREATEST(COUNT(*) - 1, 1) AS device_switch_rate, COUNT(*) FILTER (WHERE location <> l) / GREATEST(COUNT(*) - 1, 1) AS location_switch_rate FROM sw GROUP BY 1)"""
_DC = "unique_device_count unique_location_count device_switch_rate location_switch_rate"


@query("behavioral_device_features", "behavioral/profiling", "user_events", f"WITH {_DEV} SELECT user_id, {_rounded(_DC)} FROM df")
def _(e):
    return op.device_features(e).select("user_id", *[r(c, 6) for c in _DC.split()])


@query("behavioral_stability", "behavioral/profiling", "user_events", """WITH k AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS k, COUNT(*) OVER (PARTITION BY user_id) AS n FROM user_events), h AS (SELECT *, k <= n // 2 AS a FROM k),
z AS (SELECT user_id, MAX(n) AS n, COUNT(*) FILTER (WHERE a) / GREATEST((MAX(ts) FILTER (WHERE a) - MIN(ts) FILTER (WHERE a)) / 86400, 1) AS x, COUNT(*) FILTER (WHERE NOT a) / GREATEST((MAX(ts) FILTER (WHERE NOT a) - MIN(ts) FILTER (WHERE NOT a)) / 86400, 1) AS y FROM h GROUP BY 1)
SELECT user_id, ROUND(CASE WHEN n < 10 THEN 0.5 ELSE GREATEST(1 - ABS(x - y) / (x + y + 0.001), 0) END, 6) AS stability FROM z""")  # fmt: skip
def _(e):
    return op.stability(e).select("user_id", r("stability", 6))


@query("behavioral_confidence", "behavioral/profiling", "user_events", "WITH g AS (SELECT user_id, COUNT(*) AS n, GREATEST((MAX(ts) - MIN(ts)) / 86400, 1) AS d FROM user_events GROUP BY 1) SELECT user_id, ROUND(0.4 * LEAST(n / 100, 1) + 0.3 * LEAST(d / 30, 1) + 0.3 * LEAST(n / d / 10, 1), 6) AS confidence FROM g")
def _(e):
    return op.confidence(e).select("user_id", r("confidence", 6))


@query("behavioral_profile_features", "behavioral/profiling", "user_events", f"""WITH {_TEMP}, {_FREQ}, {_DEV}, j AS (SELECT * FROM tf JOIN ff USING (user_id) JOIN df USING (user_id)), l AS (UNPIVOT j ON COLUMNS(* EXCLUDE user_id) INTO NAME feature VALUE value) SELECT user_id, feature, ROUND(value, 4) + 0.0 AS value FROM l""")
def _(e):
    keep = ["user_id", *_TC.split(), *_FC.split(), *_DC.split()]
    return op.profile_features(op.profiles(e).select(*keep)).select("user_id", "feature", r("value"))


@query("behavioral_anomaly_scores", "behavioral/anomaly", "user_events", f"""WITH {_TEMP}, {_FREQ}, few AS (SELECT id, user_id, ts, event_type, session_id, CASE WHEN user_id % 2 = 0 THEN device_id ELSE 'dev0' END AS device_id, CASE WHEN id % 50 = 0 THEN 'locX' ELSE 'loc0' END AS location FROM user_events),
dc AS (SELECT user_id, COUNT(DISTINCT device_id) AS ud, COUNT(DISTINCT location) AS ul FROM few GROUP BY 1),
x AS (SELECT e.id, e.user_id, e.ts, row_number() OVER (PARTITION BY e.user_id, location ORDER BY e.ts, e.id) = 1 AS np, row_number() OVER (PARTITION BY e.user_id, device_id ORDER BY e.ts, e.id) = 1 AS nd,
 COUNT(*) OVER (PARTITION BY e.user_id ORDER BY e.ts RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) - row_number() OVER (PARTITION BY e.user_id, e.ts ORDER BY e.id DESC) AS recent FROM few e),
y AS (SELECT x.*, LEAST(ABS(ts // 3600 % 24 - peak_hour), 24 - ABS(ts // 3600 % 24 - peak_hour)) / 12 * 100 AS h, np AND ul < 3 AS place, nd AND ud < 3 AS device, avg_events_per_day / 24 AS rate FROM x JOIN tf USING (user_id) JOIN ff USING (user_id) JOIN dc USING (user_id)),
z AS (SELECT *, recent > rate * 5 AS fast, h * 0.2 + CASE WHEN place THEN 12.5 ELSE 0 END + CASE WHEN device THEN 8 ELSE 0 END + CASE WHEN recent > rate * 5 THEN LEAST(recent / rate - 1, 100) ELSE 0 END * 0.35 AS s FROM y)
SELECT id, ROUND(LEAST(s, 100), 4) AS score, CASE WHEN CAST(h > 30 AS INT) + CAST(place AS INT) + CAST(device AS INT) + CAST(fast AS INT) > 1 THEN 'Mixed' WHEN h > 30 THEN 'Temporal' WHEN place THEN 'Geographic' WHEN device THEN 'Device' WHEN fast THEN 'Velocity' ELSE 'None' END AS kind, s >= 20 AS is_anomaly FROM z""")  # fmt: skip
def _(e):
    few = e.withColumn("device_id", F.when(F.col("user_id") % 2 == 0, F.col("device_id")).otherwise("dev0")).withColumn("location", F.when(F.col("id") % 50 == 0, "locX").otherwise("loc0"))
    return op.anomaly_scores(few, op.profiles(few), 20.0).select("id", r("score"), F.coalesce("kind", F.lit("None")).alias("kind"), "is_anomaly")


@query("behavioral_match_sequence", "behavioral/fraud-signatures", "user_events", """WITH s AS (SELECT user_id, ts, event_type AS a, LEAD(event_type) OVER w AS b, LEAD(event_type, 2) OVER w AS c, LEAD(ts, 2) OVER w AS u FROM user_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)),
m AS (SELECT user_id, ts, u - ts AS span, CASE WHEN u - ts < 300 THEN 100 WHEN u - ts < 3600 THEN 80 WHEN u - ts < 86400 THEN 60 ELSE 40 END * 0.9 AS score FROM s WHERE a = 'signup' AND b = 'error' AND c = 'purchase'),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ts) AS k FROM m) SELECT user_id, ts AS start, span, CAST(score AS DOUBLE) AS score FROM k WHERE k = 1""")  # fmt: skip
def _(e):
    return op.match_sequence(e, ["signup", "error", "purchase"], 90.0)


@query("behavioral_match_attributes", "behavioral/fraud-signatures", "user_events", "SELECT user_id, COUNT(*) AS n, 70.0::DOUBLE AS score FROM user_events WHERE event_type = 'purchase' AND device_id = 'dev1' AND location = 'loc2' GROUP BY 1")
def _(e):
    return op.match_attributes(e, "purchase", {"device_id": "dev1", "location": "loc2"}, 70.0)


@query("behavioral_match_time_window", "behavioral/fraud-signatures", "user_events", """WITH e AS (SELECT * FROM user_events WHERE event_type IN ('signup', 'purchase')), s AS (SELECT user_id, ts, MIN(CASE WHEN event_type = 'signup' THEN ts END) OVER w AS f0, MIN(CASE WHEN event_type = 'purchase' THEN ts END) OVER w AS f1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 7200 FOLLOWING)),
m AS (SELECT user_id, ts, GREATEST(f0, f1) - ts AS span, 80 * (0.5 + 0.5 * (1 - (GREATEST(f0, f1) - ts) / 7200)) AS score FROM s WHERE f0 IS NOT NULL AND f1 IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ts) AS k FROM m) SELECT user_id, ts AS start, span, ROUND(score, 6) AS score FROM k WHERE k = 1""")  # fmt: skip
def _(e):
    return op.match_time_window(e, ["signup", "purchase"], 7200, 80.0).withColumn("score", r("score", 6))


@query("behavioral_match_count", "behavioral/fraud-signatures", "user_events", "WITH c AS (SELECT user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING) AS n FROM user_events WHERE event_type = 'error'), m AS (SELECT user_id, MAX(n) AS n FROM c GROUP BY 1) SELECT user_id, n, ROUND(LEAST(60 * n / 4, 100.0), 6) AS score FROM m WHERE n >= 4")
def _(e):
    return op.match_count(e, "error", 4, 86_400, 60.0).withColumn("score", r("score", 6))


@query("behavioral_match_substring", "behavioral/fraud-signatures", "user_events", "SELECT user_id, COUNT(*) AS n, 50.0::DOUBLE AS score FROM user_events WHERE contains(event_type, 'c3') OR contains(location, 'c3') GROUP BY 1")
def _(e):
    return op.match_substring(e, "c3", ["event_type", "location"], 50.0)


_CAUSE = """s AS (SELECT event_type AS source, LEAD(event_type) OVER w AS target, LEAD(ts) OVER w - ts AS lag FROM user_events WINDOW w AS (ORDER BY ts, id)), g AS (SELECT source, target, COUNT(*) AS n, AVG(lag) AS mean_lag FROM s WHERE lag <= 3600 AND source <> target GROUP BY 1, 2),
e AS (SELECT *, n / SUM(n) OVER (PARTITION BY source) AS strength FROM g QUALIFY n >= 3 AND strength >= 0.1)"""


@query("behavioral_causal_edges", "behavioral/causal-graph", "user_events", f"WITH {_CAUSE} SELECT source, target, n, ROUND(mean_lag, 4) AS mean_lag, ROUND(strength, 8) AS strength FROM e")
def _(e):
    return op.causal_edges(e).select("source", "target", "n", r("mean_lag"), r("strength", 8))


@query("behavioral_causal_dag", "behavioral/causal-graph", "user_events")
def _(e):
    return op.prune_to_dag(op.causal_edges(e)).select("source", "target", "n", r("strength", 8))


@query("behavioral_causal_roles", "behavioral/causal-graph", "user_events", f"WITH {_CAUSE}, x AS (SELECT source AS event_type, 1 AS o, 0 AS i FROM e WHERE strength >= 0.25 UNION ALL SELECT target, 0, 1 FROM e WHERE strength >= 0.25) SELECT event_type, ROUND(SUM(o) / (SUM(i) + 1), 6) AS root, ROUND(SUM(i) / (SUM(o) + 1), 6) AS effect FROM x GROUP BY 1")
def _(e):
    return op.causal_roles(op.causal_edges(e).where("strength >= 0.25")).select("event_type", r("root", 6), r("effect", 6))


@query("behavioral_causal_impact", "behavioral/causal-graph", "user_events", f"""WITH {_CAUSE}, d AS (SELECT target, strength FROM e WHERE source = 'signup'), l1 AS (SELECT DISTINCT target AS node FROM d WHERE target <> 'signup'), i1 AS (SELECT e.target, strength / 2 AS strength FROM e JOIN l1 ON source = node),
l2 AS (SELECT DISTINCT target AS node FROM i1 WHERE target <> 'signup' AND target NOT IN (SELECT node FROM l1)), i2 AS (SELECT e.target, strength / 3 AS strength FROM e JOIN l2 ON source = node)
SELECT target, 0 AS depth, ROUND(strength, 8) AS strength FROM d UNION ALL SELECT target, 1, ROUND(strength, 8) FROM i1 UNION ALL SELECT target, 2, ROUND(strength, 8) FROM i2""")  # fmt: skip
def _(e):
    return op.causal_impact(op.causal_edges(e), "signup").select("target", "depth", r("strength", 8))


_A, _B = 1_704_500_000, 1_705_500_000


@query("behavioral_pattern_search", "behavioral/forensic-query", "user_events", f"SELECT id FROM user_events WHERE ts BETWEEN {_A} AND {_B} AND contains(event_type, 'c') AND device_id = 'dev2'")
def _(e):
    return op.pattern_search(op.in_scope(e, _A, _B), "c", "dev2").select("id")


@query("behavioral_timeline", "behavioral/forensic-query", "user_events", f'SELECT MIN(ts) AS start, MAX(ts) AS "end", COUNT(*) AS events, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT session_id) AS sessions, MAX(ts) - MIN(ts) AS duration, ROUND(COUNT(*) / GREATEST((MAX(ts) - MIN(ts)) / 3600, 1), 6) AS events_per_hour FROM user_events WHERE ts BETWEEN {_A} AND {_B} AND user_id IN (3, 5, 8, 13)')
def _(e):
    return op.timeline(op.in_scope(e, _A, _B, [3, 5, 8, 13])).withColumn("events_per_hour", r("events_per_hour", 6))


@query("behavioral_activity_summary", "behavioral/forensic-query", "user_events", """WITH t AS (SELECT event_type, COUNT(*) AS n, (SELECT COUNT(*) FROM user_events) AS total FROM user_events GROUP BY 1), u AS (SELECT user_id, COUNT(*) AS n FROM user_events GROUP BY 1), h AS (SELECT ts // 3600 % 24 AS h, COUNT(*) AS n FROM user_events GROUP BY 1)
SELECT 'count_' || event_type AS name, CAST(n AS DOUBLE) AS value FROM t UNION ALL SELECT 'ratio_' || event_type, ROUND(n / total, 6) FROM t UNION ALL SELECT 'peak_hour', arg_max(h, (n, h)) FROM h UNION ALL SELECT 'avg_events_per_user', ROUND(AVG(n), 6) FROM u UNION ALL SELECT 'max_events_per_user', MAX(n) FROM u UNION ALL SELECT 'users', COUNT(*) FROM u""")  # fmt: skip
def _(e):
    return op.activity_summary(e).select("name", r("value", 6))


@query("behavioral_anomaly_hunt", "behavioral/forensic-query", "user_events", "WITH n AS (SELECT id, ts, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n FROM user_events), w AS (SELECT id, CONCAT_WS(',', CASE WHEN n > 2 THEN 'burst' END, CASE WHEN ts // 3600 % 24 < 6 THEN 'night' END) AS reasons FROM n) SELECT * FROM w WHERE reasons <> ''")
def _(e):
    return op.anomaly_hunt(e, 2)


@query("behavioral_correlated_types", "behavioral/forensic-query", "user_events", """WITH s AS (SELECT event_type AS a, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, id) AS b FROM user_events), n AS (SELECT a, b, COUNT(*) AS n FROM s WHERE b IS NOT NULL GROUP BY 1, 2), p AS (SELECT event_type, COUNT(*) AS k FROM user_events GROUP BY 1), t AS (SELECT COUNT(*) AS t FROM user_events)
SELECT a, b, n, ROUND(n / t / (x.k / t * y.k / t), 8) AS lift FROM n JOIN p x ON x.event_type = a JOIN p y ON y.event_type = b CROSS JOIN t ORDER BY lift DESC, a, b LIMIT 5""")  # fmt: skip
def _(e):
    return op.correlated_types(e).withColumn("lift", r("lift", 8))


_CORR = """j AS (SELECT a.id, b.id AS other, a.ts - b.ts AS gap, 1 - ABS(a.ts - b.ts) / 1800 AS near, a.user_id = b.user_id AS u, a.session_id = b.session_id AS s, a.device_id = b.device_id AS d, a.location = b.location AS l FROM user_events a JOIN user_events b ON a.id <> b.id AND ABS(a.ts - b.ts) <= 1800),
c AS (SELECT id, other, gap, near * 0.2 + CASE WHEN u THEN 0.3 ELSE 0 END + CASE WHEN s THEN 0.25 ELSE 0 END + CASE WHEN d THEN 0.15 ELSE 0 END + CASE WHEN l THEN 0.1 ELSE 0 END AS score, CASE WHEN u THEN 'User' WHEN s THEN 'Session' WHEN near > 0.5 THEN 'Temporal' WHEN d THEN 'Device' WHEN l THEN 'Location' ELSE 'Temporal' END AS kind FROM j)"""


@query("behavioral_correlate", "behavioral/event-correlation", "user_events", f"WITH {_CORR}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ROUND(score, 9) DESC, other) AS k FROM c WHERE ROUND(score, 9) >= 0.4) SELECT id, other, gap, ROUND(score, 6) AS score, kind FROM k WHERE k <= 50")
def _(e):
    return op.correlate(e, 1800, 0.4).select("id", "other", "gap", r("score", 6), "kind")


@query("behavioral_correlation_clusters", "behavioral/event-correlation", "user_events", f"""WITH RECURSIVE {_CORR}, g AS (SELECT id, other FROM c WHERE score >= 0.7), reach(a, b) AS (SELECT id, id FROM g UNION SELECT a, other FROM reach JOIN g ON b = id), l AS (SELECT a, MIN(b) AS label FROM reach GROUP BY 1) SELECT label, COUNT(*) AS size FROM l GROUP BY 1 HAVING COUNT(*) > 1""")
def _(e):
    return op.event_clusters(e, 1800, 0.7)


@query("behavioral_regular_pairs", "behavioral/event-correlation", "user_events", "WITH s AS (SELECT event_type AS a, LEAD(event_type) OVER w AS b, LEAD(ts) OVER w - ts AS gap FROM user_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)), g AS (SELECT a, b, COUNT(*) AS n, AVG(gap) AS m, STDDEV_POP(gap) AS sd FROM s WHERE b IS NOT NULL GROUP BY 1, 2) SELECT a, b, n, ROUND(1 - sd / m, 6) AS score FROM g WHERE n >= 3 AND sd / m < 1")
def _(e):
    return op.regular_pairs(e, 3, 1.0).withColumn("score", r("score", 6))


@query("behavioral_pairs_of_kinds", "behavioral/event-correlation", "user_events", "SELECT a.id AS a, b.id AS b, ABS(a.ts - b.ts) AS gap FROM user_events a JOIN user_events b ON a.user_id = b.user_id AND a.device_id = b.device_id AND a.id < b.id AND ABS(a.ts - b.ts) <= 3600")
def _(e):
    return op.pairs_of_kinds(e, ["user", "device"])


@query("behavioral_standard_signatures", "behavioral/fraud-signatures", "region", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{k}', {v}::DOUBLE)" for i, n, k, _, v in op.SIGNATURES) + ") t(signature, name, pattern, severity)")
def _(region):
    return op.standard_signatures(region.sparkSession)


_KINDS = {"view": "login_attempt", "click": "login", "signup": "password_reset", "purchase": "high_value_purchase", "error": "logout"}


@query("behavioral_match_signatures", "behavioral/fraud-signatures", "user_events", """WITH c AS (SELECT user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS n FROM user_events WHERE event_type = 'view'), a AS (SELECT user_id, MAX(n) AS n FROM c GROUP BY 1 HAVING MAX(n) >= 5),
s AS (SELECT ts, user_id, MIN(CASE WHEN event_type = 'click' THEN ts END) OVER w AS f0, MIN(CASE WHEN event_type = 'purchase' THEN ts END) OVER w AS f1, MIN(CASE WHEN event_type = 'error' THEN ts END) OVER w AS f2 FROM user_events WHERE event_type IN ('click', 'purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING)),
m AS (SELECT user_id, MAX(80 * (0.5 + 0.5 * (1 - (GREATEST(f0, f1, f2) - ts) / 300))) AS score FROM s WHERE f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL GROUP BY 1)
SELECT 1 AS signature, user_id, ROUND(LEAST(70 * n / 5, 100.0), 4) AS score FROM a UNION ALL SELECT 3, user_id, ROUND(score, 4) FROM m""")  # fmt: skip
def _(e):
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("event_type")), F.col("event_type"))
    return op.match_signatures(e.withColumn("event_type", kind)).select("signature", "user_id", r("score", 4))
