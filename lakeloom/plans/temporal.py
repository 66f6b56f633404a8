"""Queries over time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import temporal as op
from lakeloom.plans.registry import query, r

_P = "p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, COUNT(*) OVER (PARTITION BY series_id) AS n FROM customer_series)"
_O = "PARTITION BY series_id ORDER BY t"


@query("temporal_moving_average", "temporal/trend-extraction", "customer_series", f"SELECT series_id, t, ROUND(AVG(value) OVER w, 4) AS trend, ROUND(value - AVG(value) OVER w, 4) AS detrended FROM customer_series WINDOW w AS ({_O} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def _(s):
    return op.moving_average(s, 7).select("series_id", "t", r("trend"), r("detrended"))


@query("temporal_centred_average", "temporal/trend-extraction", "customer_series", f"SELECT series_id, t, ROUND(AVG(value) OVER w, 4) AS trend FROM customer_series WINDOW w AS ({_O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def _(s):
    return op.moving_average(s, 7, centred=True).select("series_id", "t", r("trend"))


@query("temporal_exponential_average", "temporal/trend-extraction", "customer_series", f"""WITH RECURSIVE {_P}, e(series_id, i, s) AS (SELECT series_id, i, value FROM p WHERE i = 0 UNION ALL SELECT p.series_id, p.i, 2.0 / 13 * p.value + 11.0 / 13 * e.s FROM e JOIN p ON p.series_id = e.series_id AND p.i = e.i + 1)
SELECT series_id, CAST(i AS INTEGER) AS i, ROUND(s, 2) AS trend FROM e""")  # fmt: skip
def _(s):
    return op.exponential_average(s, 12).select("series_id", "i", r("trend", 2))


@query("temporal_holt", "temporal/trend-extraction", "customer_series", f"""WITH RECURSIVE {_P}, e(series_id, i, l, b) AS (SELECT p.series_id, p.i, p.value, q.value - p.value FROM p JOIN p q ON q.series_id = p.series_id AND q.i = 1 WHERE p.i = 0
UNION ALL SELECT p.series_id, p.i, 0.3 * p.value + 0.7 * (l + b), 0.1 * (0.3 * p.value + 0.7 * (l + b) - l) + 0.9 * b FROM e JOIN p ON p.series_id = e.series_id AND p.i = e.i + 1) SELECT series_id, CAST(i AS INTEGER) AS i, ROUND(l, 2) AS level, ROUND(b, 2) AS slope FROM e""")  # fmt: skip
def _(s):
    return op.holt(s).select("series_id", "i", r("level", 2), r("slope", 2))


@query("temporal_lowess", "temporal/trend-extraction", "customer_series", f"""WITH {_P}, w AS (SELECT a.series_id, a.i, b.i - a.i AS x, b.value AS y, POW(1 - POW(ABS(b.i - a.i) / 6.0::DOUBLE, 3), 3) AS w FROM p a JOIN p b ON a.series_id = b.series_id AND b.i BETWEEN a.i - 5 AND a.i + 5),
g AS (SELECT series_id, i, SUM(w) AS sw, SUM(w * x) AS wx, SUM(w * y) AS wy, SUM(w * x * x) AS wxx, SUM(w * x * y) AS wxy FROM w GROUP BY 1, 2)
SELECT series_id, CAST(i AS INTEGER) AS i, ROUND((wxx * wy - wx * wxy) / (sw * wxx - wx * wx), 2) AS trend FROM g""")  # fmt: skip
def _(s):
    return op.lowess(s, 5).select("series_id", F.col("i").cast("int").alias("i"), r("trend", 2))


@query("temporal_anomalies_zscore", "temporal/anomaly-detection", "customer_series", "SELECT series_id, t, ROUND(ABS(value - AVG(value) OVER w) / STDDEV_SAMP(value) OVER w, 6) AS score, ABS(value - AVG(value) OVER w) / STDDEV_SAMP(value) OVER w > 2 AS is_anomaly FROM customer_series WINDOW w AS (PARTITION BY series_id)")
def _(s):
    return op.anomalies(s, "zscore", 2.0).select("series_id", "t", r("score", 6), "is_anomaly")


@query("temporal_anomalies_rolling", "temporal/anomaly-detection", "customer_series", f"SELECT series_id, t, ROUND(CASE WHEN sd > 1e-10 THEN ABS(value - m) / sd ELSE 0 END, 5) AS score FROM (SELECT *, AVG(value) OVER w AS m, STDDEV_POP(value) OVER w AS sd FROM customer_series WINDOW w AS ({_O} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))")
def _(s):
    return op.anomalies(s, "zscore", 2.0, 20).select("series_id", "t", r("score", 5))


@query("temporal_anomalies_iqr", "temporal/anomaly-detection", "customer_series", """WITH l AS (SELECT series_id, list_sort(list(value)) AS v FROM customer_series GROUP BY 1), q AS (SELECT series_id, v[len(v) // 4 + 1] AS q1, v[3 * len(v) // 4 + 1] AS q3, v[len(v) // 2 + 1] AS med FROM l),
x AS (SELECT s.series_id, t, value, med, q3 - q1 AS iqr, q1 - 1.2 * (q3 - q1) AS lo, q3 + 1.2 * (q3 - q1) AS hi FROM customer_series s JOIN q USING (series_id))
SELECT series_id, t, ROUND(med, 4) AS expected, ROUND(CASE WHEN value < lo THEN (lo - value) / iqr WHEN value > hi THEN (value - hi) / iqr ELSE 0 END, 6) AS score, value < lo OR value > hi AS is_anomaly FROM x""")  # fmt: skip
def _(s):
    return op.anomalies(s, "iqr", 1.2).select("series_id", "t", r("expected"), r("score", 6), "is_anomaly")


@query("temporal_anomalies_moving_average", "temporal/anomaly-detection", "customer_series", f"""WITH x AS (SELECT *, AVG(value) OVER ({_O} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM customer_series), l AS (SELECT series_id, list_sort(list(ABS(value - m))) AS v FROM x GROUP BY 1)
SELECT series_id, t, ROUND(ABS(value - m) / v[len(v) // 2 + 1], 6) AS score, ABS(value - m) / v[len(v) // 2 + 1] > 3 AS is_anomaly FROM x JOIN l USING (series_id)""")  # fmt: skip
def _(s):
    return op.anomalies(s, "moving_average", 3.0, 10).select("series_id", "t", r("score", 6), "is_anomaly")


@query("temporal_anomalies_seasonal", "temporal/anomaly-detection", "customer_series", f"WITH {_P}, x AS (SELECT *, value - AVG(value) OVER (PARTITION BY series_id, i % 12) AS v FROM p) SELECT series_id, t, ROUND(ABS(v - AVG(v) OVER w) / STDDEV_POP(v) OVER w, 6) AS score FROM x WINDOW w AS (PARTITION BY series_id)")
def _(s):
    return op.anomalies(s, "seasonal_esd", 2.0, 12).select("series_id", "t", r("score", 6))


_PROPHET = f"""{_P}, x AS (SELECT *, AVG(value) OVER ({_O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM p), l AS (SELECT series_id, i % 7 AS phase, AVG(value - trend) AS level FROM x GROUP BY 1, 2),
z AS (SELECT series_id, phase, level - AVG(level) OVER (PARTITION BY series_id) AS seasonal FROM l), d AS (SELECT x.*, seasonal FROM x JOIN z ON x.series_id = z.series_id AND x.i % 7 = z.phase)"""


@query("temporal_prophet", "temporal/prophet-decomposition", "customer_series", f"WITH {_PROPHET} SELECT series_id, t, ROUND(trend, 4) AS trend, ROUND(seasonal, 4) AS seasonal, ROUND(value - trend - seasonal, 4) AS residual FROM d")
def _(s):
    return op.prophet(s, 7).select("series_id", "t", r("trend"), r("seasonal"), r("residual"))


@query("temporal_prophet_forecast", "temporal/prophet-decomposition", "customer_series", f"""WITH {_PROPHET}, e AS (SELECT series_id, MAX(n) AS n, MAX(trend) FILTER (WHERE i = n - 1) AS b, MAX(trend) FILTER (WHERE i = n - 2) AS a FROM d GROUP BY 1), h AS (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS step)
SELECT e.series_id, step, ROUND(b + (b - a) * step + seasonal, 3) AS forecast FROM e CROSS JOIN h JOIN z ON z.series_id = e.series_id AND z.phase = (n + step - 1) % 7""")  # fmt: skip
def _(s):
    return op.prophet_forecast(s, 7, 10).select("series_id", "step", r("forecast", 3))


_DEC = f"""{_P}, x AS (SELECT *, CASE WHEN i >= 6 AND i + 6 < n THEN (SUM(value) OVER w - 0.5 * (LAG(value, 6) OVER o + LEAD(value, 6) OVER o)) / 12 ELSE AVG(value) OVER w END AS trend FROM p WINDOW w AS ({_O} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), o AS ({_O})),
l AS (SELECT series_id, i % 12 AS phase, AVG(value - trend) AS level FROM x GROUP BY 1, 2), z AS (SELECT series_id, phase, level - AVG(level) OVER (PARTITION BY series_id) AS seasonal FROM l),
d AS (SELECT x.series_id, x.t, i, value, seasonal, value - seasonal AS lft FROM x JOIN z ON x.series_id = z.series_id AND x.i % 12 = z.phase),
k AS (SELECT a.series_id, a.i, SUM(b.lft * POW(1 - POW(ABS(b.i - a.i) / 12.0::DOUBLE, 3), 3)) / SUM(POW(1 - POW(ABS(b.i - a.i) / 12.0::DOUBLE, 3), 3)) AS trend FROM d a JOIN d b ON a.series_id = b.series_id AND b.i BETWEEN a.i - 12 AND a.i + 12 GROUP BY 1, 2)"""


@query("temporal_decompose", "temporal/seasonal-decomposition", "customer_series", f"WITH {_DEC} SELECT series_id, t, ROUND(k.trend, 3) AS trend, ROUND(seasonal, 3) AS seasonal, ROUND(value - k.trend - seasonal, 3) AS residual FROM d JOIN k USING (series_id, i)")
def _(s):
    return op.decompose(s, 12).select("series_id", "t", r("trend", 3), r("seasonal", 3), r("residual", 3))


@query("temporal_decompose_robust", "temporal/seasonal-decomposition", "customer_series", f"WITH {_DEC.replace('AVG(value - trend) AS level', 'list_sort(list(value - trend))[COUNT(*) // 2 + 1] AS level').replace('AVG(level) OVER (PARTITION BY series_id)', '(SELECT list_sort(list(y.level))[COUNT(*) // 2 + 1] FROM l y WHERE y.series_id = l.series_id)')} SELECT series_id, t, ROUND(k.trend, 3) AS trend, ROUND(seasonal, 3) AS seasonal, ROUND(value - k.trend - seasonal, 3) AS residual FROM d JOIN k USING (series_id, i)")
def _(s):
    return op.decompose(s, 12, robust=True).select("series_id", "t", r("trend", 3), r("seasonal", 3), r("residual", 3))


@query("temporal_decompose_multiplicative", "temporal/seasonal-decomposition", "customer_series", f"WITH {_DEC.replace('FROM customer_series', 'FROM (SELECT series_id, t, ln(value) AS value FROM customer_series)')} SELECT series_id, t, ROUND(exp(k.trend), 3) AS trend, ROUND(exp(seasonal), 5) AS seasonal, ROUND(exp(value - k.trend - seasonal), 5) AS residual FROM d JOIN k USING (series_id, i)")
def _(s):
    return op.decompose(s, 12, multiplicative=True).select("series_id", "t", r("trend", 3), r("seasonal", 5), r("residual", 5))


@query("temporal_arima_coefficients", "temporal/arima-forecast", "customer_series")
def _(s):
    return op.arima_coefficients(s, 2, 1, 1).select("series_id", "term", r("value", 6))


@query("temporal_arima_forecast", "temporal/arima-forecast", "customer_series")
def _(s):
    return op.arima_forecast(s, 2, 1, 1, 10).select("series_id", "step", r("forecast", 3))


for _m, _penalty in (("pelt", 5e11), ("binary", 5e11), ("cusum", 3e6)):
    query(f"temporal_change_points_{_m}", "temporal/changepoint-detection", "customer_series")(lambda s, m=_m, penalty=_penalty: op.change_points(s, m, penalty, 20).select("series_id", "start", "end", r("mean", 2), r("variance", 0)))


_SHIFT = 0.01234567  # sums of cents over small counts never lie on a rounding tie once shifted by it


@query("temporal_cusum", "temporal/changepoint-detection", "customer_series", f"SELECT series_id, t, ROUND(SUM(off) OVER ({_O}) + {_SHIFT}, 1) + 0.0 AS cusum FROM (SELECT *, value - AVG(value) OVER (PARTITION BY series_id) AS off FROM customer_series)")
def _(s):
    return op.cusum(s).withColumn("cusum", F.col("cusum") + _SHIFT).select("series_id", "t", r("cusum", 1))


_R = f"x AS (SELECT series_id, t, ln(value) - ln(LAG(value) OVER ({_O})) AS value FROM customer_series), rt AS (SELECT *, row_number() OVER ({_O}) - 1 AS i FROM x WHERE value IS NOT NULL)"


@query("temporal_realized_volatility", "temporal/volatility-analysis", "customer_series", f"WITH {_R} SELECT series_id, t, ROUND(sqrt(AVG(value * value) OVER ({_O} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)), 6) AS volatility FROM rt")
def _(s):
    return op.realized_volatility(op.returns(s), 21).select("series_id", "t", r("volatility", 6))


@query("temporal_ewma_volatility", "temporal/volatility-analysis", "customer_series", f"""WITH RECURSIVE {_R}, e(series_id, i, v) AS (SELECT series_id, CAST(0 AS BIGINT), VAR_SAMP(value) FROM rt GROUP BY 1 UNION ALL SELECT e.series_id, e.i + 1, 0.94 * v + 0.06 * value * value FROM e JOIN (SELECT *, COUNT(*) OVER (PARTITION BY series_id) AS c FROM rt) rt ON rt.series_id = e.series_id AND rt.i = e.i AND e.i + 1 < c)
SELECT series_id, CAST(i AS INTEGER) AS i, ROUND(sqrt(v), 6) AS volatility FROM e""")  # fmt: skip
def _(s):
    return op.ewma_volatility(op.returns(s)).select("series_id", "i", r("volatility", 6))


@query("temporal_garch", "temporal/volatility-analysis", "customer_series")
def _(s):
    return op.garch(op.returns(s)).select("series_id", r("omega", 6), r("alpha"), r("beta"))


@query("temporal_garch_forecast", "temporal/volatility-analysis", "customer_series")
def _(s):
    return op.garch_forecast(op.returns(s), 5).select("series_id", "step", r("volatility", 6))


@query("temporal_range_volatility", "temporal/volatility-analysis", "orders", """WITH b AS (SELECT o_orderdate AS d, arg_min(o_totalprice, o_orderkey) AS o, MAX(o_totalprice) AS h, MIN(o_totalprice) AS l, arg_max(o_totalprice, o_orderkey) AS c FROM orders GROUP BY 1)
SELECT CAST(epoch(d) AS BIGINT) AS t, ROUND(CASE WHEN h > l THEN sqrt(ln(h / l) * ln(h / l) / (4 * ln(2.0::DOUBLE))) ELSE 0 END, 6) AS parkinson,
 ROUND(CASE WHEN h > l THEN sqrt(GREATEST(0.5 * ln(h / l) * ln(h / l) - (2 * ln(2.0::DOUBLE) - 1) * ln(c / o) * ln(c / o), 0)) ELSE 0 END, 6) AS garman_klass FROM b""")  # fmt: skip
def _(o):
    bars = o.groupBy(F.unix_timestamp("o_orderdate").alias("t")).agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"))
    return op.range_volatility(bars).select("t", r("parkinson", 6), r("garman_klass", 6))


@query("temporal_asset_volatility", "temporal/volatility-analysis", "customer_series")
def _(s):
    return op.asset_volatility(op.returns(s), 5).select("series_id", r("volatility", 6), r("persistence"), F.posexplode("forecast").alias("step", "v")).select("series_id", "volatility", "persistence", "step", r("v", 6, "forecast"))
