"""Queries over points, vectors and predictions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lakeloom.functions import vectors as V
from lakeloom.operators import ml as op
from lakeloom.plans.registry import query, r

_CENTRES = [[5.0, 2.0, 2.0], [20.0, 5.0, 4.0], [35.0, 8.0, 6.0], [48.0, 3.0, 1.0]]


def _points(p):
    return p.select(F.col("row_id").alias("id"), F.array("x0", "x1", "x2").alias("x"))


_DIST = [f"sqrt(pow(x0 - {a}, 2) + pow(x1 - {b}, 2) + pow(x2 - {c}, 2))" for a, b, c in _CENTRES]
_STEP = "SELECT id, x0, x1, x2, arg_min(k, (d, k)) AS cluster, MIN(d) AS distance FROM (SELECT row_id AS id, x0, x1, x2, c.k, sqrt(pow(x0 - a, 2) + pow(x1 - b, 2) + pow(x2 - c, 2)) AS d FROM points, {c} c) GROUP BY 1, 2, 3, 4"
_LLOYD = ["c0(k, a, b, c) AS (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(_CENTRES)) + ")"]
for _i in range(5):
    _LLOYD.append(f"a{_i} AS MATERIALIZED ({_STEP.replace('{c}', f'c{_i}')})")
    _LLOYD.append(f"c{_i + 1} AS MATERIALIZED (SELECT cluster AS k, AVG(x0) AS a, AVG(x1) AS b, AVG(x2) AS c FROM a{_i} GROUP BY 1)")


@query("ml_kmeans_assign", "ml/kmeans-cluster", "points", f"SELECT row_id AS id, list_position([{', '.join(_DIST)}], LEAST({', '.join(_DIST)})) - 1 AS cluster, ROUND(LEAST({', '.join(_DIST)}), 6) AS distance FROM points")
def _(p):
    return op.assign(_points(p), _CENTRES).select("id", "cluster", r("distance", 6))


@query("ml_kmeans", "ml/kmeans-cluster", "points", f"WITH {', '.join(_LLOYD)}, f AS ({_STEP.replace('{c}', 'c5')}) SELECT cluster, COUNT(*) AS n, ROUND(SUM(distance * distance), 4) AS inertia FROM f GROUP BY 1")
def _(p):
    _, a = op.kmeans(_points(p), 4, _CENTRES, rounds=5, tolerance=0.0)
    return a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("distance") * F.col("distance")), 4, "inertia"))


@query("ml_kmeans_plus_plus", "ml/kmeans-cluster", "points")
def _(p):
    return op.inertia(op.kmeans(_points(p), 4, rounds=10)[1]).select(r("inertia", 2))


_EPS = """pt AS (SELECT c_custkey AS row_id, c_acctbal / 100 AS x0, c_nationkey * 10 AS x1, length(c_mktsegment) * 10 AS x2 FROM customer), pr AS (SELECT a.row_id AS a, b.row_id AS b FROM pt a JOIN pt b ON a.row_id <> b.row_id AND sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2)) <= 5),
co AS (SELECT row_id AS id FROM pt LEFT JOIN pr ON a = row_id GROUP BY 1 HAVING COUNT(b) + 1 >= 3)"""


def _customer_points(c):
    return c.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 100, F.col("c_nationkey") * 10.0, F.length("c_mktsegment") * 10.0).alias("x"))


@query("ml_dbscan", "ml/dbscan-cluster", "customer", f"""WITH RECURSIVE {_EPS}, rc(a, b) AS (SELECT id, id FROM co UNION SELECT rc.a, pr.b FROM rc JOIN pr ON rc.b = pr.a JOIN co ON co.id = pr.b), cl AS (SELECT a AS id, MIN(b) AS cluster FROM rc GROUP BY 1),
bo AS (SELECT pr.a AS id, MIN(cluster) AS cluster FROM pr JOIN cl ON cl.id = pr.b WHERE pr.a NOT IN (SELECT id FROM co) GROUP BY 1) SELECT pt.row_id AS id, COALESCE(cl.cluster, bo.cluster, -1) AS cluster FROM pt LEFT JOIN cl ON cl.id = pt.row_id LEFT JOIN bo ON bo.id = pt.row_id""")  # fmt: skip
def _(c):
    return op.dbscan(_customer_points(c), 5.0, 3)


@query("ml_eps_neighbours", "ml/dbscan-cluster", "customer", f"WITH {_EPS} SELECT a, b FROM pr")
def _(c):
    return op.neighbour_pairs(_customer_points(c), 5.0)


@query("ml_hierarchical", "ml/hierarchical-cluster", "customer")
def _(c):
    nations = c.groupBy(F.col("c_nationkey").alias("id")).agg(F.array(F.avg("c_acctbal") / 100, F.count(F.lit(1)).cast("double")).alias("x"))
    return op.hierarchical(nations, 5)


@query("ml_isolation_forest", "ml/isolation-forest", "points")
def _(p):
    return op.isolation_forest(_points(p), 50, 128).select("id", r("score", 6), "is_outlier")


@query("ml_isolation_path", "ml/isolation-forest", "region", "SELECT n, ROUND(CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n ELSE 1 END, 8) AS path FROM (SELECT unnest([2, 8, 64, 256, 10000]) AS n)")
def _(region):
    return region.sparkSession.createDataFrame([(n, round(op.average_path(n), 8)) for n in (2, 8, 64, 256, 10_000)], "n int, path double")


_KNN = "WITH e AS (SELECT vec_id AS id, embedding AS v FROM embeddings), d AS (SELECT a.id, b.id AS other, list_distance(a.v::DOUBLE[], b.v::DOUBLE[]) AS distance FROM e a, e b WHERE a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d QUALIFY rank <= 5)"


def _vectors(e):
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


@query("ml_knn", "ml/local-outlier-factor", "embeddings", f"{_KNN} SELECT id, other, ROUND(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM k")
def _(e):
    return op.knn(_vectors(e), 5).select("id", "other", r("distance", 6), "rank")


@query("ml_local_outlier_factor", "ml/local-outlier-factor", "embeddings", f"{_KNN}, kd AS (SELECT id AS other, MAX(distance) AS kd FROM k GROUP BY 1), l AS (SELECT k.id, 5 / SUM(GREATEST(distance, kd)) AS lrd FROM k JOIN kd USING (other) GROUP BY 1) SELECT k.id, ROUND(AVG(o.lrd) / ANY_VALUE(l.lrd), 6) AS lof FROM k JOIN l o ON o.id = k.other JOIN l ON l.id = k.id GROUP BY 1")
def _(e):
    return op.local_outlier_factor(_vectors(e), 5).select("id", r("lof", 6))


_PRED = "p AS (SELECT o_orderkey AS sample, m AS model, (o_orderkey * (m + 3) // 7) % 3 AS label, (o_orderkey * (m + 2) % 101) / 100.0 AS value, 1.0 + m / 2.0 AS w FROM orders, (SELECT unnest([0, 1, 2, 3]) AS m))"


def _predictions(o):
    k, m = F.col("o_orderkey"), F.col("model")
    p = o.crossJoin(o.sparkSession.range(4).select(F.col("id").cast("int").alias("model")))
    p = p.select(k.alias("sample"), "model", (F.floor(k * (m + 3) / 7) % 3).alias("label"), (k * (m + 2) % 101 / 100.0).alias("value"))
    p = p.withColumn("p", F.array(F.col("value") / 2, 0.5 - F.col("value") / 4, 0.5 - F.col("value") / 4 + 0.0))
    return p, o.sparkSession.createDataFrame([(i, 1.0 + i / 2) for i in range(4)], "model int, weight double")


@query("ml_hard_vote", "ml/ensemble-voting", "orders", f"WITH {_PRED}, v AS (SELECT sample, label, SUM(w) AS w FROM p GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY w DESC, label) AS k FROM v) SELECT sample, label, ROUND(w, 4) AS votes FROM k WHERE k = 1")
def _(o):
    return op.hard_vote(*_predictions(o)).select("sample", "label", r("votes"))


@query("ml_soft_vote", "ml/ensemble-voting", "orders", f"WITH {_PRED}, v AS (SELECT sample, SUM(w * value / 2) / SUM(w) AS a, SUM(w * (0.5 - value / 4)) / SUM(w) AS b FROM p GROUP BY 1) SELECT sample, CASE WHEN a >= b THEN 0 ELSE 1 END AS class, ROUND(GREATEST(a, b), 6) AS probability FROM v WHERE ABS(a - b) > 1e-6")
def _(o):
    p, w = _predictions(o)
    out = op.soft_vote(p, w)
    close = op.weighted_average(p, w).where(F.abs(F.col("value") / 2 - (0.5 - F.col("value") / 4)) > 1e-6)
    return out.join(close.select("sample"), "sample", "left_semi").select("sample", "class", r("probability", 6))


@query("ml_weighted_average", "ml/ensemble-voting", "orders", f"WITH {_PRED} SELECT sample, ROUND(SUM(w * value) / SUM(w), 6) AS value FROM p GROUP BY 1")
def _(o):
    return op.weighted_average(*_predictions(o)).select("sample", r("value", 6))


@query("ml_median_prediction", "ml/ensemble-voting", "orders", f"WITH {_PRED} SELECT sample, ROUND(MEDIAN(value), 6) AS value FROM p GROUP BY 1")
def _(o):
    return op.median_prediction(_predictions(o)[0]).select("sample", r("value", 6))


def _xy(p, *cols):
    return p.select(F.array(*cols).alias("x"), "y")


@query("ml_linear_regression", "ml/linear-regression", "points", "SELECT ROUND(regr_slope(y, x0), 4) AS slope, ROUND(regr_intercept(y, x0), 2) AS intercept, ROUND(regr_r2(y, x0), 8) AS r2 FROM points")
def _(p):
    return op.linear_regression(_xy(p, "x0")).select(r(F.col("coefficients")[0], 4, "slope"), r("intercept", 2), r("r2", 8))


@query("ml_multiple_regression", "ml/linear-regression", "points", """WITH m AS (SELECT var_pop(x0) AS a, var_pop(x1) AS b, var_pop(x2) AS c, covar_pop(x0, x1) AS d, covar_pop(x0, x2) AS e, covar_pop(x1, x2) AS f, covar_pop(x0, y) AS p, covar_pop(x1, y) AS q, covar_pop(x2, y) AS r, var_pop(y) AS v FROM points),
k AS (SELECT *, a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e) AS det FROM m), s AS (SELECT *, (p * (b * c - f * f) - d * (q * c - f * r) + e * (q * f - b * r)) / det AS w0, (a * (q * c - f * r) - p * (d * c - f * e) + e * (d * r - q * e)) / det AS w1, (a * (b * r - q * f) - d * (d * r - q * e) + p * (d * f - b * e)) / det AS w2 FROM k)
SELECT CAST(i AS INTEGER) AS feature, ROUND([w0, w1, w2][i + 1], 4) AS value, ROUND((w0 * p + w1 * q + w2 * r) / v, 8) AS r2 FROM s, (SELECT unnest(range(3)) AS i)""")  # fmt: skip
def _(p):
    return op.linear_regression(_xy(p, "x0", "x1", "x2")).select(F.posexplode("coefficients").alias("feature", "value"), "r2").select("feature", r("value", 4), r("r2", 8))


@query("ml_ridge_regression", "ml/ridge-regression", "points", "WITH m AS (SELECT AVG(x0) AS mx, AVG(y) AS my FROM points), w AS (SELECT SUM((x0 - mx) * (y - my)) / (SUM((x0 - mx) * (x0 - mx)) + 1000) AS w FROM points, m) SELECT ROUND(w, 4) AS slope, ROUND(my - w * mx, 2) AS intercept FROM w, m")
def _(p):
    return op.ridge(_xy(p, "x0"), 1000.0).select(r(F.col("coefficients")[0], 4, "slope"), r("intercept", 2))


def _linear(m: np.ndarray) -> np.ndarray:
    return m @ np.array([2.0, -1.0, 0.5]) + 3.0


@query("ml_shap_values", "ml/shap-values", "points")
def _(p):
    s = op.shap_values(_points(p), [[10.0, 2.0, 1.0], [30.0, 6.0, 5.0], [25.0, 5.0, 4.0]], _linear)
    return s.select("id", r("base", 6), *[r(F.col("values")[i], 4, f"v{i}") for i in range(3)])


@query("ml_shap_importance", "ml/shap-values", "points")
def _(p):
    s = op.shap_values(_points(p), [[10.0, 2.0, 1.0], [30.0, 6.0, 5.0], [25.0, 5.0, 4.0]], _linear)
    return op.mean_importance(s).select("feature", r("importance", 4))


@query("ml_kernel_weight", "ml/shap-values", "region", "SELECT z, ROUND(CASE WHEN z IN (0, 6) THEN 1e6 ELSE 5 / (c * z * (6 - z)) END, 8) AS weight FROM (VALUES (0, 1), (1, 6), (2, 15), (3, 20), (4, 15), (5, 6), (6, 1)) t(z, c)")
def _(region):
    return region.sparkSession.createDataFrame([(z, round(op.kernel_weight(6, z), 8)) for z in range(7)], "z int, weight double")


@query("ml_permutation_importance", "ml/feature-importance", "points")
def _(p):
    rows = p.select(F.col("row_id").alias("id"), F.array("x0", "x1", "x2").alias("x"), (2 * F.col("x0") - F.col("x1") + 0.5 * F.col("x2") + 3).alias("y"))
    return op.permutation_importance(rows, _linear).select("feature", r("importance", 6), "rank")


@query("ml_prediction_scores", "ml/feature-importance", "points", "SELECT ROUND(1 - SUM(pow(y - x0 * 1500, 2)) / (VAR_POP(y) * COUNT(*)), 6) AS r2, ROUND(-AVG(ABS(y - x0 * 1500)), 4) AS mae FROM points")
def _(p):
    s = p.select("y", (F.col("x0") * 1500).alias("prediction"))
    return op.prediction_score(s, "r2").select(r("score", 6, "r2")).crossJoin(op.prediction_score(s, "mae").select(r("score", 4, "mae")))


@query("ml_tokenize", "ml/embedding-generation", "documents", "WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), t AS (SELECT id, list_filter(list_transform(w, lambda x: regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')), lambda x: x <> '') AS t FROM w) SELECT id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM t")
def _(d):
    t = op.tokenize(F.col("text"), None)
    return d.select(F.col("doc_id").alias("id"), F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


for _pool in ("mean", "max", "attention"):
    query(f"ml_embed_{_pool}", "ml/embedding-generation", "conversations")(lambda c, pool=_pool: op.embed(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), 64, pooling=pool, longest=None).select("id", r(F.col("vector")[0], 6, "v0"), r(F.col("vector")[63], 6, "v63"), r(V.norm(F.col("vector")), 4, "norm")))


def _vec(e):
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


@query("ml_semantic_matches", "ml/semantic-similarity", "embeddings", """WITH s AS (SELECT q.vec_id AS query, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, id, ROUND(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10 AND score >= 0.3""")  # fmt: skip
def _(e):
    v = _vec(e)
    return op.semantic_matches(v.where("id % 20 = 0"), v, top=10, least=0.3).select("query", "id", r("score", 6), "rank")


@query("ml_semantic_dedup", "ml/semantic-similarity", "embeddings")
def _(e):
    return op.semantic_dedup(_vec(e), 0.8)


def _updates(s):
    k = F.col("s_suppkey")
    return s.select(k.alias("participant"), F.array(k % 7 / 5.0, k % 3 - 1.0, k % 11 / 20.0).alias("x"), (k % 9 + 1).alias("n"))


_UPD = "u AS (SELECT s_suppkey AS k, [s_suppkey % 7 / 5.0, s_suppkey % 3 - 1.0, s_suppkey % 11 / 20.0]::DOUBLE[] AS x, s_suppkey % 9 + 1 AS n FROM supplier), f AS (SELECT *, CASE WHEN sqrt(list_dot_product(x, x)) > 1 THEN 1 / sqrt(list_dot_product(x, x)) ELSE 1 END AS f FROM u)"


@query("ml_secure_aggregate", "ml/secure-aggregation", "supplier", f"WITH {_UPD}, e AS (SELECT n, f, unnest(x) AS v, unnest(range(3)) AS feature FROM f) SELECT CAST(feature AS INTEGER) AS feature, ROUND(SUM(v * f * n) / SUM(n), 8) AS value FROM e GROUP BY 1")
def _(s):
    return op.secure_aggregate(_updates(s)).select("feature", r("value", 8))


@query("ml_private_aggregate", "ml/secure-aggregation", "supplier")
def _(s):
    return op.secure_aggregate(_updates(s), epsilon=1.0).select("feature", r("value", 6))


@query("ml_simulate_round", "ml/secure-aggregation", "supplier", f"WITH {_UPD}, e AS (SELECT n, f, unnest(x) AS v, unnest(range(3)) AS feature FROM f), s AS (SELECT feature, SUM(v * f * n) / SUM(n) AS step FROM e GROUP BY 1) SELECT CAST(feature AS INTEGER) AS feature, feature + 1.0::DOUBLE AS before, ROUND(feature + 1 + step, 8) AS value FROM s")
def _(s):
    model = s.sparkSession.range(3).select(F.col("id").cast("int").alias("feature"), (F.col("id") + 1.0).alias("value"))
    return op.simulate_round(model, _updates(s)).select("feature", "before", r("value", 8))


@query("ml_aggregation_is_sound", "ml/secure-aggregation", "supplier", "SELECT COUNT(*) AS participants, CAST(3 AS BIGINT) AS features, true AS sound FROM supplier")
def _(s):
    u = _updates(s)
    return op.aggregation_is_sound(u, op.secure_aggregate(u))


@query("ml_masked_sum", "ml/secure-aggregation", "supplier", f"WITH {_UPD}, e AS (SELECT unnest(x) AS v, unnest(range(3)) AS feature FROM u) SELECT CAST(feature AS INTEGER) AS feature, ROUND(SUM(v), 6) AS value FROM e GROUP BY 1")
def _(s):
    return op.masked_updates(_updates(s)).select(F.posexplode("x").alias("feature", "v")).groupBy("feature").agg(r(F.sum("v"), 6, "value"))


def _drugs(p):
    k = F.col("p_partkey")
    drugs = p.select(k.alias("drug"), F.array(k % 9).alias("classes"), F.array(k % 5, k % 7 + 10, k % 3 + 20).alias("targets"), F.array((k % 4).cast("double"), (k % 6).cast("double"), F.lit(1.0)).alias("mechanism"))
    known = p.select(k.alias("a"), (k + 3).alias("b"), F.when(k % 2 == 0, "Major").otherwise("Minor").alias("severity"))
    return drugs, known


def _patients(c):
    k = F.col("c_custkey")
    return c.select(k.alias("patient"), F.array(k % 40, (k * 7 + 3) % 40, (k * 11 + 5) % 40, (k % 37 + 3) % 40).alias("drugs"))


_RX = """pt AS (SELECT c_custkey AS patient, list_distinct([c_custkey % 40, (c_custkey * 7 + 3) % 40, (c_custkey * 11 + 5) % 40, (c_custkey % 37 + 3) % 40]) AS ds FROM customer), dg AS (SELECT p_partkey AS drug, p_partkey % 9 AS cls, [p_partkey % 5, p_partkey % 7 + 10, p_partkey % 3 + 20] AS tg, [p_partkey % 4, p_partkey % 6, 1.0]::DOUBLE[] AS mo FROM part),
rx AS (SELECT patient, drug, cls, tg, mo FROM (SELECT patient, unnest(ds) AS drug FROM pt) JOIN dg USING (drug))"""
_INT = f"""{_RX}, pp AS (SELECT x.patient, x.drug AS a, y.drug AS b, x.cls = y.cls AS same, list_cosine_similarity(x.mo, y.mo) AS cos, len(list_intersect(x.tg, y.tg)) / len(list_distinct(list_concat(x.tg, y.tg))) AS overlap, CASE WHEN y.drug = x.drug + 3 THEN CASE WHEN x.drug % 2 = 0 THEN 'Major' ELSE 'Minor' END END AS known FROM rx x JOIN rx y ON x.patient = y.patient AND x.drug < y.drug),
rk AS (SELECT *, CASE WHEN known = 'Major' THEN 0.9 WHEN known = 'Minor' THEN 0.3 WHEN same THEN 0.8 ELSE LEAST(overlap * (1 - cos) + 0.3 * cos, 1) END AS risk, CASE WHEN known IS NOT NULL THEN 1.0 WHEN same THEN 0.8 ELSE 0.3 + 0.7 * overlap END AS confidence FROM pp),
iv AS (SELECT patient, a, b, COALESCE(known, CASE WHEN risk >= 0.7 THEN 'Major' WHEN risk >= 0.5 THEN 'Moderate' WHEN risk >= 0.3 THEN 'Minor' ELSE 'None' END) AS severity, risk, confidence FROM rk), it AS (SELECT * FROM iv WHERE severity <> 'None')"""


@query("ml_drug_interactions", "ml/drug-interaction-prediction", "customer part", f"WITH {_INT} SELECT patient, a, b, severity, ROUND(risk, 6) AS risk, ROUND(confidence, 6) AS confidence FROM it")
def _(c, p):
    return op.drug_interactions(_patients(c), *_drugs(p)).select("patient", "a", "b", "severity", r("risk", 6), r("confidence", 6))


@query("ml_polypharmacy_risk", "ml/drug-interaction-prediction", "customer part", f"WITH {_INT}, m AS (SELECT patient, AVG(risk * confidence) AS m FROM it GROUP BY 1) SELECT patient, ROUND(LEAST(0.1 * (len(ds) - 1) + COALESCE(m, 0), 1), 6) AS risk FROM pt LEFT JOIN m USING (patient)")
def _(c, p):
    return op.polypharmacy_risk(_patients(c), op.drug_interactions(_patients(c), *_drugs(p))).select("patient", r("risk", 6))


@query("ml_drug_triplets", "ml/drug-interaction-prediction", "customer part", f"""WITH {_RX}, t AS (SELECT x.patient, x.drug AS a, y.drug AS b, z.drug AS c, (list_cosine_similarity(x.mo, y.mo) + list_cosine_similarity(y.mo, z.mo) + list_cosine_similarity(x.mo, z.mo)) / 3 * 0.4 + (1 - len(list_distinct(list_concat(list_concat(x.tg, y.tg), z.tg))) / 9) * 0.6 AS risk
FROM rx x JOIN rx y ON x.patient = y.patient AND x.drug < y.drug JOIN rx z ON z.patient = y.patient AND y.drug < z.drug) SELECT patient, a, b, c, CASE WHEN risk > 0.6 THEN 'Major' WHEN risk > 0.4 THEN 'Moderate' ELSE 'Minor' END AS severity, ROUND(risk, 6) AS risk, ROUND(risk * 0.7, 6) AS confidence FROM t""")  # fmt: skip
def _(c, p):
    return op.drug_triplets(_patients(c), _drugs(p)[0]).select("patient", "a", "b", "c", "severity", r("risk", 6), r("confidence", 6))


@query("ml_drug_recommendations", "ml/drug-interaction-prediction", "customer part", f"""WITH {_INT}, g AS (SELECT patient, COUNT(*) FILTER (WHERE risk >= 0.7) AS h, COUNT(*) FILTER (WHERE severity = 'Major') AS m, COUNT(*) AS n FROM it GROUP BY 1)
SELECT patient, h || ' combinations of high risk: look for other drugs' AS advice FROM g WHERE h > 0 UNION ALL SELECT patient, m || ' major interactions to look at before prescribing' FROM g WHERE m > 0 UNION ALL SELECT patient, 'many interactions: go over all drugs' FROM g WHERE n > 5""")  # fmt: skip
def _(c, p):
    return op.drug_recommendations(op.drug_interactions(_patients(c), *_drugs(p)))


_STEPS = [("s1", "signup", "intake", True, 1.0, []), ("s2", "view", "check", True, 100.0, ["s1"]), ("s3", "purchase", "care", True, 300.0, ["s2"]), ("s4", "error", "audit", False, None, ["s3"])]


def _care(e):
    steps = e.sparkSession.createDataFrame(_STEPS, "step string, name string, category string, required boolean, expected_hours double, needs array<string>")
    events = e.select(F.col("user_id").alias("patient"), "id", F.lit(None).cast("string").alias("step"), F.when(F.col("event_type") == "signup", "intake").when(F.col("event_type") == "view", "check").when(F.col("event_type") == "purchase", "care").otherwise("audit").alias("category"), F.concat(F.lit("Did "), F.upper("event_type")).alias("description"), ((F.col("ts") - 1_704_067_200) / 3600.0).alias("hours"))
    return steps, events


_CARE = """ev AS (SELECT user_id AS patient, event_type AS t, (ts - 1704067200) / 3600 AS hours FROM user_events), st(step, name, req, exp, need) AS (VALUES ('s1', 'signup', true, 1.0, NULL), ('s2', 'view', true, 100.0, 's1'), ('s3', 'purchase', true, 300.0, 's2'), ('s4', 'error', false, NULL, 's3')),
dn AS (SELECT patient, step, exp, need, COUNT(*) AS n, MIN(hours) AS hours FROM ev JOIN st ON t = name GROUP BY ALL), wh AS (SELECT DISTINCT patient FROM ev),
dv AS (SELECT patient, step, 'MissedStep' AS deviation, 'Major' AS severity FROM wh, st WHERE req AND (patient, step) NOT IN (SELECT (patient, step) FROM dn) UNION ALL SELECT patient, step, 'TimingDeviation', CASE WHEN ABS(hours - exp) > 48 THEN 'Major' ELSE 'Minor' END FROM dn WHERE ABS(hours - exp) > 24
UNION ALL SELECT patient, step, 'DuplicateStep', 'Info' FROM dn WHERE n > 1 UNION ALL SELECT patient, step, 'OrderViolation', 'Major' FROM dn WHERE need IS NOT NULL AND (patient, need) NOT IN (SELECT (patient, step) FROM dn))"""


@query("ml_pathway_deviations", "ml/clinical-pathway-conformance", "user_events", f"WITH {_CARE} SELECT * FROM dv")
def _(e):
    return op.pathway_deviations(*_care(e))


_SCORES = f"{_CARE}, g AS (SELECT patient, SUM(CASE severity WHEN 'Major' THEN 0.2 WHEN 'Minor' THEN 0.05 ELSE 0 END) AS p, COUNT(*) FILTER (WHERE deviation = 'MissedStep') AS m FROM dv GROUP BY 1), sc AS (SELECT wh.patient, 1 - COALESCE(m, 0) / 3 AS completion, GREATEST(1 - COALESCE(p, 0), 0) * (1 - COALESCE(m, 0) / 3) AS conformance FROM wh LEFT JOIN g USING (patient))"


@query("ml_pathway_scores", "ml/clinical-pathway-conformance", "user_events", f"WITH {_SCORES} SELECT patient, ROUND(completion, 6) AS completion, ROUND(conformance, 6) + 0.0 AS conformance FROM sc")
def _(e):
    return op.pathway_scores(*_care(e)).select("patient", r("completion", 6), r("conformance", 6))


@query("ml_pathway_statistics", "ml/clinical-pathway-conformance", "user_events", f"WITH {_SCORES} SELECT 'mean_conformance' AS name, ROUND(AVG(conformance), 6) AS value FROM sc UNION ALL SELECT 'mean_completion', ROUND(AVG(completion), 6) FROM sc UNION ALL SELECT 'patients', COUNT(*) FROM sc UNION ALL SELECT deviation, COUNT(*) FROM dv GROUP BY 1")
def _(e):
    s, ev = _care(e)
    return op.pathway_statistics(op.pathway_scores(s, ev), op.pathway_deviations(s, ev)).select("name", r("value", 6))
