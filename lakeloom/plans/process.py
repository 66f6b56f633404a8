"""Queries over event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import process as op
from lakeloom.plans.registry import query, r

_S = "s AS (SELECT case_id, id, activity AS a, ts AS ta, LEAD(activity) OVER w AS b, LEAD(ts) OVER w AS tb, LAG(activity) OVER w AS p, row_number() OVER w AS k FROM process_events WINDOW w AS (PARTITION BY case_id ORDER BY ts, id))"
_DFG = f"{_S}, d AS (SELECT a, b, COUNT(*) AS n, AVG(tb - ta) AS duration FROM s WHERE b IS NOT NULL GROUP BY 1, 2)"


@query("process_directly_follows", "procint/dfg-construction", "process_events", f"WITH {_DFG} SELECT a, b, n, ROUND(duration, 4) AS duration FROM d")
def _(e):
    return op.directly_follows(e).select("a", "b", "n", r("duration"))


@query("process_activity_counts", "procint/dfg-construction", "process_events", f"WITH {_S} SELECT a AS activity, COUNT(*) AS n, COUNT(*) FILTER (WHERE k = 1) AS starts, COUNT(*) FILTER (WHERE b IS NULL) AS ends FROM s GROUP BY 1")
def _(e):
    return op.activity_counts(e)


@query("process_frequent_edges", "procint/dfg-construction", "process_events", f"WITH {_DFG} SELECT a, b, n FROM d WHERE n >= 390")
def _(e):
    return op.frequent_edges(op.directly_follows(e), 390).select("a", "b", "n")


@query("process_dfg_metrics", "procint/dfg-construction", "process_events", f"WITH {_DFG} SELECT COUNT(DISTINCT activity) AS nodes, (SELECT COUNT(*) FROM d) AS edges, ROUND((SELECT COUNT(*) FROM d) / (COUNT(DISTINCT activity) * COUNT(DISTINCT activity)), 6) AS density, (SELECT ROUND(AVG(n), 4) FROM d) AS mean_count FROM process_events")
def _(e):
    return op.dfg_metrics(op.directly_follows(e), e.select("activity").distinct()).select("nodes", "edges", r("density", 6), r("mean_count"))


@query("process_order_relations", "procint/partial-order", "process_events", """WITH n AS (SELECT DISTINCT activity FROM process_events), h AS (SELECT DISTINCT case_id, activity FROM process_events),
co AS (SELECT x.activity AS a, y.activity AS b, COUNT(*) AS cases FROM h x JOIN h y USING (case_id) WHERE x.activity < y.activity GROUP BY 1, 2),
o AS (SELECT x.activity AS x, y.activity AS y, COUNT(*) AS n FROM process_events x JOIN process_events y ON x.case_id = y.case_id AND x.ts < y.ts WHERE x.activity <> y.activity GROUP BY 1, 2),
z AS (SELECT p.activity AS a, q.activity AS b, COALESCE(cases, 0) AS cases, COALESCE(u.n, 0) AS ab, COALESCE(v.n, 0) AS ba FROM n p JOIN n q ON p.activity < q.activity LEFT JOIN co ON co.a = p.activity AND co.b = q.activity LEFT JOIN o u ON u.x = p.activity AND u.y = q.activity LEFT JOIN o v ON v.y = p.activity AND v.x = q.activity)
SELECT a, b, cases, ab, ba, CASE WHEN cases = 0 THEN 'Exclusive' WHEN (ab >= floor(cases * 0.8) AND ba = 0) OR (ba >= floor(cases * 0.8) AND ab = 0) THEN 'Sequential' WHEN LEAST(ab, ba) / GREATEST(ab, ba) >= 0.5 THEN 'Concurrent' ELSE 'None' END AS relation FROM z""")  # fmt: skip
def _(e):
    return op.order_relations(e)


_LEADS = ", ".join(f"LEAD(activity, {i}) OVER w AS x{i}" for i in range(1, 6))


@query("process_immediate_loops", "procint/partial-order", "process_events", f"""WITH l AS (SELECT activity AS x0, {_LEADS} FROM process_events WINDOW w AS (PARTITION BY case_id ORDER BY ts, id)),
u AS (SELECT x0 || ',' || x1 AS pattern, 2 AS length FROM l WHERE x0 = x2 AND x1 = x3 UNION ALL SELECT x0 || ',' || x1 || ',' || x2, 3 FROM l WHERE x0 = x3 AND x1 = x4 AND x2 = x5) SELECT pattern, length, COUNT(*) AS n FROM u GROUP BY 1, 2 HAVING COUNT(*) >= 2""")  # fmt: skip
def _(e):
    return op.immediate_loops(e, 3)


@query("process_independence", "procint/partial-order", "process_events", """WITH h AS (SELECT DISTINCT case_id, activity FROM process_events), t AS (SELECT COUNT(DISTINCT case_id) AS t FROM h), p AS (SELECT activity, COUNT(*) AS n FROM h GROUP BY 1), co AS (SELECT x.activity AS a, y.activity AS b, COUNT(*) AS n FROM h x JOIN h y USING (case_id) GROUP BY 1, 2)
SELECT x.activity AS a, y.activity AS b, ROUND(1 - LEAST(COALESCE(co.n, 0) * t / (x.n * y.n), 1), 6) + 0.0 AS independence FROM p x JOIN p y ON x.activity < y.activity CROSS JOIN t LEFT JOIN co ON co.a = x.activity AND co.b = y.activity""")  # fmt: skip
def _(e):
    return op.independence(e).select("a", "b", r("independence", 6))


_MODEL = f"{_DFG}, m AS (SELECT a, b FROM d WHERE n >= 390), st AS (SELECT a FROM s WHERE k = 1 GROUP BY 1 HAVING COUNT(*) >= 28), en AS (SELECT a FROM s WHERE b IS NULL GROUP BY 1 HAVING COUNT(*) >= 28), deg AS (SELECT a, COUNT(*) AS options FROM m GROUP BY 1)"
_CONF = f"""{_MODEL}, x AS (SELECT s.*, CASE WHEN p IS NULL THEN a IN (SELECT a FROM st) ELSE (p, a) IN (SELECT (a, b) FROM m) END AS ok, b IS NULL AND a NOT IN (SELECT a FROM en) AS bad_end, options FROM s LEFT JOIN deg USING (a)),
c AS (SELECT case_id, COUNT(*) FILTER (WHERE ok) AS sync, COUNT(*) FILTER (WHERE NOT ok) + COUNT(*) FILTER (WHERE bad_end) AS log_moves, COUNT(*) FILTER (WHERE b IS NOT NULL AND options IS NOT NULL) AS used, SUM(options) FILTER (WHERE b IS NOT NULL) AS possible FROM x GROUP BY 1),
f AS (SELECT case_id, sync, log_moves, sync / (sync + log_moves) AS fitness, COALESCE(used / possible, 1) AS precision FROM c)"""


def _model(e):
    a = op.activity_counts(e)
    return op.frequent_edges(op.directly_follows(e), 390).select("a", "b"), a.where("starts >= 28").select("activity"), a.where("ends >= 28").select("activity")


@query("process_conformance", "procint/conformance", "process_events", f"WITH {_CONF} SELECT case_id, sync, log_moves, ROUND(fitness, 6) AS fitness, ROUND(precision, 6) AS precision FROM f")
def _(e):
    return op.conformance(e, *_model(e)).select("case_id", "sync", "log_moves", r("fitness", 6), r("precision", 6))


@query("process_conformance_stats", "procint/conformance", "process_events", f"WITH {_CONF} SELECT COUNT(*) AS cases, COUNT(*) FILTER (WHERE log_moves = 0) AS conforming, ROUND(AVG(fitness), 6) AS fitness, ROUND(AVG(precision), 6) AS precision FROM f")
def _(e):
    return op.conformance_stats(op.conformance(e, *_model(e))).select("cases", "conforming", r("fitness", 6), r("precision", 6))


_DEV = f"""{_MODEL}, v AS (SELECT 'WrongStart' AS kind, a AS activity FROM s WHERE p IS NULL AND a NOT IN (SELECT a FROM st) UNION ALL SELECT 'UnexpectedStep', a FROM s WHERE p IS NOT NULL AND (p, a) NOT IN (SELECT (a, b) FROM m) UNION ALL SELECT 'WrongEnd', a FROM s WHERE b IS NULL AND a NOT IN (SELECT a FROM en))"""


@query("process_deviations", "procint/conformance", "process_events", f"WITH {_DEV} SELECT kind, activity, COUNT(*) AS n FROM v GROUP BY 1, 2")
def _(e):
    return op.deviations(e, *_model(e))


@query("process_common_deviations", "procint/conformance", "process_events", f"WITH {_DEV} SELECT kind, activity, COUNT(*) AS n FROM v GROUP BY 1, 2 ORDER BY n DESC, kind, activity LIMIT 4")
def _(e):
    return op.deviations(e, *_model(e), top=4)


@query("process_replay", "procint/conformance", "process_events")
def _(e):
    net = [("signup", ("p0",), ("p1",)), ("click", ("p1",), ("p1", "p2")), ("view", ("p1",), ("p1",)), ("purchase", ("p2",), ("p3",))]
    return op.replay(e, net, {"p0": 1}, {"p3": 1}).withColumn("fitness", r("fitness", 6))


@query("process_transition_counts", "procint/next-activity", "process_events", f"WITH {_S} SELECT p AS context, a AS next, COUNT(*) AS n FROM s WHERE p IS NOT NULL GROUP BY 1, 2")
def _(e):
    return op.transition_counts(e)


@query("process_transition_counts_2", "procint/next-activity", "process_events", "WITH s AS (SELECT LAG(activity, 2) OVER w AS x, LAG(activity) OVER w AS y, activity AS a FROM process_events WINDOW w AS (PARTITION BY case_id ORDER BY ts, id)) SELECT x || '>' || y AS context, a AS next, COUNT(*) AS n FROM s WHERE x IS NOT NULL GROUP BY 1, 2")
def _(e):
    return op.transition_counts(e, 2)


@query("process_predict_next", "procint/next-activity", "process_events", f"""WITH {_S}, c AS (SELECT p AS context, a AS next, COUNT(*) AS n FROM s WHERE p IS NOT NULL GROUP BY 1, 2), t AS (SELECT context, SUM(n) AS total FROM c GROUP BY 1), v AS (SELECT DISTINCT activity FROM process_events),
g AS (SELECT x.activity AS context, y.activity AS next, (COALESCE(n, 0) + 1) / (total + (SELECT COUNT(*) FROM v)) AS probability FROM v x CROSS JOIN v y LEFT JOIN c ON c.context = x.activity AND c.next = y.activity JOIN t ON t.context = x.activity)
SELECT context, next, CAST(rank AS INTEGER) AS rank, ROUND(probability, 8) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY probability DESC, next) AS rank FROM g) WHERE rank <= 3""")  # fmt: skip
def _(e):
    v = e.select("activity").distinct()
    return op.predict_next(op.transition_counts(e), v.select(F.col("activity").alias("context")), v, 3).select("context", "next", "rank", r("probability", 8))


@query("process_expected_next", "procint/log-imputation", "process_events", f"WITH {_DFG} SELECT a, b, n, ROUND(probability, 8) AS probability FROM (SELECT *, n / SUM(n) OVER (PARTITION BY a) AS probability FROM d) WHERE n >= GREATEST(floor((SELECT COUNT(DISTINCT case_id) FROM process_events) * 0.1::DOUBLE), 1)")
def _(e):
    return op.expected_next(e).select("a", "b", "n", r("probability", 8))


def _shaken(e):
    """The log with some times moved back, so that order and duplicates are off."""
    return e.withColumn("ts", F.when(F.col("id") % 11 == 0, F.col("ts") - 20000).otherwise(F.col("ts")))


_SH = "sh AS (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN ts - 20000 ELSE ts END AS ts) FROM process_events)"


@query("process_out_of_order", "procint/log-imputation", "process_events", f"WITH {_SH}, k AS (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY id) AS a, row_number() OVER (PARTITION BY case_id ORDER BY ts, id) AS b FROM sh) SELECT case_id, id, 0.9 AS confidence FROM k WHERE a <> b")
def _(e):
    return op.out_of_order(_shaken(e))


@query("process_duplicates", "procint/log-imputation", "process_events", f"WITH {_SH} SELECT y.case_id, y.id, COUNT(*) AS earlier, 0.7 AS confidence FROM sh x JOIN sh y ON x.case_id = y.case_id AND x.activity = y.activity AND (x.ts < y.ts OR (x.ts = y.ts AND x.id < y.id)) AND x.ts >= y.ts - 6000 GROUP BY 1, 2")
def _(e):
    return op.duplicates(_shaken(e), 6000)


@query("process_missing_events", "procint/log-imputation", "process_events", f"""WITH {_S}, n0 AS (SELECT a, b, COUNT(*) AS n FROM s WHERE b IS NOT NULL GROUP BY 1, 2), pr AS (SELECT a, b, n, n / SUM(n) OVER (PARTITION BY a) AS p FROM n0), ex AS (SELECT * FROM pr WHERE n >= GREATEST(floor((SELECT COUNT(DISTINCT case_id) FROM process_events) * 2.6::DOUBLE), 1)),
via AS (SELECT x.a, y.b, x.b AS missing, LEAST(x.p, y.p) AS p FROM ex x JOIN ex y ON x.b = y.a), best AS (SELECT a, b, MAX((p, missing)) AS m FROM via GROUP BY 1, 2)
SELECT case_id, k, s.a, m[2] AS missing, s.b, ROUND(0.8 * m[1], 6) AS confidence FROM s JOIN best USING (a, b) WHERE s.b IS NOT NULL AND (s.a, s.b) NOT IN (SELECT (a, b) FROM ex) AND m[1] >= 0.05""")  # fmt: skip
def _(e):
    return op.missing_events(e, 2.6, 0.05).select("case_id", "k", "a", "missing", "b", r("confidence", 6))


@query("process_incomplete_cases", "procint/log-imputation", "process_events", f"""WITH {_S}, a AS (SELECT 'start' AS kind, case_id, a AS activity FROM s WHERE k = 1 UNION ALL SELECT 'end', case_id, a FROM s WHERE b IS NULL) SELECT case_id, kind, activity FROM (SELECT *, COUNT(*) OVER (PARTITION BY kind, activity) AS n FROM a) WHERE n < GREATEST(floor((SELECT COUNT(DISTINCT case_id) FROM process_events) * 0.2::DOUBLE), 1)""")
def _(e):
    return op.incomplete_cases(e, 0.2)


@query("process_repair", "procint/log-imputation", "process_events", f"""WITH {_SH}, dup AS (SELECT DISTINCT y.id FROM sh x JOIN sh y ON x.case_id = y.case_id AND x.activity = y.activity AND (x.ts < y.ts OR (x.ts = y.ts AND x.id < y.id)) AND x.ts >= y.ts - 6000)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ts, id) AS position, id, activity, ts FROM sh WHERE id NOT IN (SELECT id FROM dup)""")  # fmt: skip
def _(e):
    return op.repair(_shaken(e), 6000).withColumn("position", F.col("position").cast("long"))


@query("process_log_quality", "procint/log-imputation", "process_events", f"""WITH {_SH}, k AS (SELECT row_number() OVER (PARTITION BY case_id ORDER BY id) AS a, row_number() OVER (PARTITION BY case_id ORDER BY ts, id) AS b FROM sh), st AS (SELECT arg_min(activity, (ts, id)) AS f, arg_max(activity, (ts, id)) AS l FROM sh GROUP BY case_id),
ct AS (SELECT GREATEST(floor(COUNT(*) * 0.1::DOUBLE), 1) AS least FROM st), x AS (SELECT (SELECT COUNT(*) FROM sh) AS events, (SELECT COUNT(*) FROM k WHERE a <> b) AS misordered,
(SELECT COUNT(DISTINCT y.id) FROM sh x JOIN sh y ON x.case_id = y.case_id AND x.activity = y.activity AND (x.ts < y.ts OR (x.ts = y.ts AND x.id < y.id)) AND x.ts >= y.ts - 6000) AS duplicated,
(SELECT COUNT(*) FROM (SELECT COUNT(*) OVER (PARTITION BY f) AS n FROM st), ct WHERE n < least) + (SELECT COUNT(*) FROM (SELECT COUNT(*) OVER (PARTITION BY l) AS n FROM st), ct WHERE n < least) AS incomplete)
SELECT *, ROUND(GREATEST(1 - (misordered + duplicated + incomplete) / events, 0), 6) AS quality FROM x""")  # fmt: skip
def _(e):
    return op.log_quality(_shaken(e), 6000).withColumn("quality", r("quality", 6))


def _objects(e):
    o = F.array(F.concat(F.lit("u"), F.col("case_id") % 40), F.concat(F.lit("s"), F.col("id") % 25), F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), F.col("id") % 60)))
    return e.select("id", "activity", "ts", F.array_compact(o).alias("objects"))


_OBJ = "ev AS (SELECT id, activity, ts, list_filter(['u' || case_id % 40, 's' || id % 25, CASE WHEN id % 3 = 0 THEN 'x' || id % 60 END], lambda x: x IS NOT NULL) AS objects FROM process_events), tc AS (SELECT id, activity, ts, unnest(objects) AS o FROM ev)"


@query("process_lifecycles", "procint/ocpm-patterns", "process_events", f"""WITH {_OBJ}, s AS (SELECT o AS object_id, list(activity ORDER BY ts, id) AS s FROM tc WHERE o LIKE 'u%' GROUP BY 1), z AS (SELECT *, len(list_distinct(s)) / len(s) AS u, regexp_matches(s[1], 'create|start|signup') AS st, regexp_matches(s[-1], 'complete|close|end|purchase') AS en FROM s)
SELECT object_id, CASE WHEN len(s) = 1 THEN 'single' WHEN st AND en THEN 'full' WHEN u < 0.5 THEN 'loop' ELSE 'sequential' END AS kind, ROUND(0.5 * u + CASE WHEN st THEN 0.25 ELSE 0 END + CASE WHEN en THEN 0.25 ELSE 0 END, 6) AS score FROM z""")  # fmt: skip
def _(e):
    ev = _objects(e)
    objects = ev.select(F.explode("objects").alias("object_id")).distinct().withColumn("object_type", F.substring("object_id", 1, 1))
    return op.lifecycles(ev, objects, "u").select("object_id", "kind", r("score", 6))


@query("process_interactions", "procint/ocpm-patterns", "process_events", f"WITH {_OBJ} SELECT x.o AS a, y.o AS b, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM ev), 8) AS score FROM tc x JOIN tc y USING (id) WHERE x.o < y.o GROUP BY 1, 2 HAVING COUNT(*) >= 2")
def _(e):
    return op.interactions(_objects(e)).withColumn("score", r("score", 8))


@query("process_convergence", "procint/ocpm-patterns", "process_events", f"WITH {_OBJ} SELECT id, activity, CAST(len(list_distinct(objects)) AS INTEGER) AS objects FROM ev WHERE len(list_distinct(objects)) >= 3")
def _(e):
    return op.convergence(_objects(e))


@query("process_divergence", "procint/ocpm-patterns", "process_events", f"WITH {_OBJ}, f AS (SELECT o, arg_min(id, (ts, id)) AS id FROM tc GROUP BY 1) SELECT id, COUNT(*) AS introduced FROM f GROUP BY 1 HAVING COUNT(*) >= 2")
def _(e):
    return op.divergence(_objects(e))


@query("process_batches", "procint/ocpm-patterns", "process_events", f"""WITH {_OBJ}, g AS (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY activity ORDER BY ts, id) <= 1000 THEN 0 ELSE 1 END AS new FROM ev), q AS (SELECT *, SUM(new) OVER (PARTITION BY activity ORDER BY ts, id) AS run FROM g)
SELECT activity, MIN(ts) AS start, MAX(ts) AS "end", COUNT(*) AS events, CAST(len(list_distinct(flatten(list(objects)))) AS INTEGER) AS objects FROM q GROUP BY activity, run HAVING len(list_distinct(flatten(list(objects)))) >= 3""")  # fmt: skip
def _(e):
    return op.batches(_objects(e))


@query("process_synchronised", "procint/ocpm-patterns", "process_events")
def _(e):
    return op.synchronised(_objects(e))


@query("process_flow_metrics", "procint/ocpm-patterns", "process_events", f"WITH {_OBJ}, o AS (SELECT o, COUNT(*) AS n, MAX(ts) - MIN(ts) AS span FROM tc GROUP BY 1) SELECT (SELECT COUNT(*) FROM ev) AS events, (SELECT ROUND(AVG(len(objects)), 6) FROM ev) AS objects_per_event, COUNT(*) AS objects, ROUND(AVG(n), 6) AS events_per_object, ROUND(AVG(span), 2) AS mean_span FROM o")
def _(e):
    return op.flow_metrics(_objects(e)).select("events", r("objects_per_event", 6), "objects", r("events_per_object", 6), r("mean_span", 2))


def _steps(region):
    return op.simulate(region.sparkSession, [("intake", "uniform", 0.1, 2), ("review", "exponential", 0.25, 3), ("decide", "normal", 0.05, 1)])


@query("process_simulation_kpis", "procint/digital-twin", "region")
def _(region):
    return op.simulation_kpis(_steps(region)).select("replication", "cases", r("mean", 6), r("p50", 6), r("p95", 6), r("throughput", 6))


@query("process_bottlenecks", "procint/digital-twin", "region")
def _(region):
    return op.bottlenecks(_steps(region)).select("activity", r("wait", 6), r("duration", 6), r("score", 6))


@query("process_utilisation", "procint/digital-twin", "region")
def _(region):
    return op.utilisation(_steps(region)).select("resource", r("utilisation", 6))
