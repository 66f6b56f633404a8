"""Queries over obligors and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import normal as nd
from lakeloom.operators import risk as op
from lakeloom.plans.registry import query, r


def _poly(x: str, coefficients) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _inv(p: str) -> str:
    edge = lambda q: f"{_poly(q, nd.ACKLAM_C)} / {_poly(q, (*nd.ACKLAM_D, 1.0))}"
    q, m = f"sqrt(-2 * ln({p}))", f"({p} - 0.5::DOUBLE)"
    return f"(CASE WHEN {p} < 0.02425 THEN {edge(q)} WHEN {p} <= 0.97575 THEN {_poly(f'({m} * {m})', nd.ACKLAM_A)} * {m} / {_poly(f'({m} * {m})', (*nd.ACKLAM_B, 1.0))} ELSE -({edge(f'sqrt(-2 * ln(1 - {p}))')}) END)"


_CDF = f"(CASE WHEN x > 0 THEN 1 - tail ELSE tail END) FROM (SELECT *, {nd.CDF_D} * exp(-x * x / 2) * u * {_poly('u', nd.CDF_B[::-1])} AS tail FROM (SELECT *, 1 / (1 + {nd.CDF_P} * abs(x)) AS u FROM "


def _rwa(source: str) -> str:
    """CTEs that end in z(obligor_id, ..., rwa) from ``source`` with pd, lgd, ead and maturity."""
    return f"""a AS (SELECT *, LEAST(GREATEST(pd, 0.0003::DOUBLE), 1) AS p, LEAST(GREATEST(lgd, 0), 1) AS g FROM {source}), b AS (SELECT *, (1 - exp(-50 * p)) / (1 - exp(-50::DOUBLE)) AS w, pow(0.11852 - 0.05478 * ln(p), 2) AS bb FROM a),
c AS (SELECT *, 0.12 * w + 0.24 * (1 - w) AS rr FROM b), d AS (SELECT *, {_inv('p')} / sqrt(1 - rr) + sqrt(rr / (1 - rr)) * {_inv('0.999::DOUBLE')} AS x FROM c),
z AS (SELECT *, 12.5 * g * (phi - p) * (1 + (maturity - 2.5) * bb) / (1 - 1.5 * bb) * ead AS rwa FROM (SELECT *, {_CDF} d))))"""


_SCORES = f"""s AS (SELECT *, LEAST(GREATEST(600 + payment_history * 0.35 + (1 - credit_utilization) * 30 + LEAST(credit_history_years, 30) * 0.3 + (1 - LEAST(debt_to_income, 1)) * 5 + (10 - LEAST(recent_inquiries, 10)) * 0.15 - delinquencies, 300), 850) AS credit_score FROM obligors),
t AS (SELECT *, 0.30 / (1 + exp(-(700 - credit_score) / 50)) AS pd, GREATEST(0.45 - (1 - LEAST(loan_to_value, 1)) * 0.30, 0.10) AS lgd FROM s), {_rwa('t')}""".replace("(SELECT *, (CASE WHEN x > 0", "(SELECT *, (CASE WHEN x > 0").replace("ELSE tail END) FROM", "ELSE tail END) AS phi FROM")


@query("risk_credit_scores", "risk/credit-scoring", "obligors", f"WITH {_SCORES} SELECT obligor_id, ROUND(credit_score, 6) AS credit_score, ROUND(pd, 8) AS pd, ROUND(lgd, 8) AS lgd, ROUND(pd * lgd * ead, 4) AS expected_loss, ROUND(rwa, 3) AS rwa FROM z")
def _(o):
    return op.credit_scores(o).select("obligor_id", r("credit_score", 6), r("pd", 8), r("lgd", 8), r("expected_loss"), r("rwa", 3))


def _exposures(o):
    return o.select("obligor_id", (0.001 + F.col("obligor_id") % 250 / 1000.0).alias("pd"), (0.2 + F.col("obligor_id") % 40 / 100.0).alias("lgd"), "ead", "maturity")


_EXP = "e AS (SELECT obligor_id, 0.001 + obligor_id % 250 / 1000.0 AS pd, 0.2 + obligor_id % 40 / 100.0 AS lgd, ead, maturity FROM obligors), " + _rwa("e").replace("ELSE tail END) FROM", "ELSE tail END) AS phi FROM")


@query("risk_exposure_risk", "risk/credit-scoring", "obligors", f"WITH {_EXP} SELECT obligor_id, ROUND(700 - 50 * (ln(pd / 0.3) - ln(1 - pd / 0.3)), 5) AS credit_score, ROUND(pd * lgd * ead, 4) AS expected_loss, ROUND(rwa, 3) AS rwa FROM z")
def _(o):
    return op.exposure_risk(_exposures(o)).select("obligor_id", r("credit_score", 5), r("expected_loss"), r("rwa", 3))


def _corr(p):
    ids = p.select(F.regexp_extract("asset_id", r"\d+", 0).cast("int").alias("k"), "asset_id")
    a, b = ids.select(F.col("k").alias("ka"), F.col("asset_id").alias("i")), ids.select(F.col("k").alias("kb"), F.col("asset_id").alias("j"))
    return a.crossJoin(b).where("ka < kb").select("i", "j", (0.3 / (1 + (F.col("kb") - F.col("ka")) / 5.0)).alias("rho"))


_Z, _H = nd.quantile(0.95), (10 / 252) ** 0.5
_COV = """k AS (SELECT *, CAST(regexp_extract(asset_id, '\\d+') AS INTEGER) AS k, value / SUM(value) OVER () AS w FROM positions),
c AS (SELECT a.asset_id AS i, b.asset_id AS j, a.w AS wi, b.w AS wj, a.value AS vi, a.sigma * b.sigma * CASE WHEN a.k = b.k THEN 1 ELSE 0.3 / (1 + ABS(a.k - b.k) / 5.0) END AS cov FROM k a, k b)"""


@query("risk_portfolio_risk", "risk/portfolio-aggregation", "positions", f"""WITH {_COV}, v AS (SELECT sqrt(SUM(wi * wj * cov)) AS volatility FROM c), t AS (SELECT SUM(value) AS total, SUM(value * sigma) AS alone FROM positions)
SELECT ROUND(volatility, 8) AS volatility, ROUND(total * volatility * {_H!r} * {_Z!r}, 2) AS var, ROUND(total * volatility * {_H!r} * exp(-{_Z!r} * {_Z!r} / 2) / sqrt(2 * pi()) / 0.05, 2) AS expected_shortfall, ROUND(alone * {_Z!r} * {_H!r}, 2) AS undiversified_var,
ROUND(alone * {_Z!r} * {_H!r} - total * volatility * {_H!r} * {_Z!r}, 2) AS diversification_benefit FROM v, t""")  # fmt: skip
def _(p):
    return op.portfolio_risk(p, _corr(p)).select(r("volatility", 8), r("var", 2), r("expected_shortfall", 2), r("undiversified_var", 2), r("diversification_benefit", 2))


@query("risk_component_var", "risk/monte-carlo-var", "positions", f"""WITH {_COV}, b AS (SELECT i, SUM(wj * cov) AS cv, ANY_VALUE(wi) AS w, ANY_VALUE(vi) AS v FROM c GROUP BY 1), t AS (SELECT SUM(w * cv) AS var, SUM(v) AS total FROM b)
SELECT i AS asset_id, ROUND(w * cv / var * 100000, 4) AS component, ROUND({_Z!r} * {_H!r} * cv / sqrt(var) * total, 2) AS marginal FROM b, t""")  # fmt: skip
def _(p):
    return op.component_var(p, _corr(p), 100_000.0).select("asset_id", r("component"), r("marginal", 2))


@query("risk_monte_carlo_var", "risk/monte-carlo-var", "positions")
def _(p):
    return op.monte_carlo_var(op.simulate_pnl(p, _corr(p)), 10_000).select(r("var", 2), r("expected_shortfall", 2))


@query("risk_correlation_matrix", "risk/realtime-correlation", "customer_series", """SELECT a.series_id AS i, b.series_id AS j, CASE WHEN a.series_id = b.series_id THEN 1.0 ELSE ROUND(CASE WHEN isfinite(corr(a.value, b.value)) THEN corr(a.value, b.value) ELSE 0 END, 6) END AS rho, COUNT(*) AS n
FROM customer_series a JOIN customer_series b ON a.t = b.t AND a.series_id <= b.series_id GROUP BY 1, 2""")  # fmt: skip
def _(s):
    return op.correlation_matrix(s.withColumnRenamed("series_id", "asset_id")).select("i", "j", r("rho", 6), "n")


@query("risk_correlation_row", "risk/realtime-correlation", "customer_series", "SELECT a.series_id AS asset_id, CASE WHEN a.series_id = '7' THEN 1.0 ELSE ROUND(CASE WHEN isfinite(corr(a.value, b.value)) THEN corr(a.value, b.value) ELSE 0 END, 6) END AS rho FROM customer_series a JOIN customer_series b ON a.t = b.t AND b.series_id = '7' GROUP BY a.series_id")
def _(s):
    return op.correlation_row(op.correlation_matrix(s.withColumnRenamed("series_id", "asset_id")), "7").select("asset_id", r("rho", 6))


_SC = "sc(scenario, factor, shock, probability) AS (VALUES " + ", ".join(f"('{n}', '{f}', {s}::DOUBLE, {p}::DOUBLE)" for n, f, s, p in op.SCENARIOS) + ")"
_STRESS = f"""{_SC}, q AS (SELECT *, CAST(regexp_extract(asset_id, '\\d+') AS INTEGER) AS k FROM positions), x AS (SELECT *, CASE WHEN k % 4 = 0 THEN 1 ELSE 0.5 + k / 50.0 END AS delta, CASE WHEN k % 4 = 0 THEN 0 ELSE k / 100.0 END AS gamma, CASE WHEN k % 4 = 0 THEN 0 ELSE k * 10.0 END AS vega, CASE WHEN k % 4 = 0 THEN 0 ELSE -k / 20.0 END AS rho FROM q),
im AS (SELECT scenario, factor, probability, asset_id, CASE factor WHEN 'equity' THEN delta * value * shock + 0.5 * gamma * value * shock * shock WHEN 'interest_rate' THEN rho * value * shock WHEN 'volatility' THEN vega * shock WHEN 'credit_spread' THEN -delta * value * shock ELSE delta * value * shock END AS impact FROM x, sc),
rs AS (SELECT scenario, ANY_VALUE(probability) AS probability, SUM(impact) AS pnl, (SELECT SUM(value) FROM positions) AS total FROM im GROUP BY 1)"""


def _impacts(p):
    k = F.regexp_extract("asset_id", r"\d+", 0).cast("int")
    sens = p.select("asset_id", k.alias("k")).where("k % 4 <> 0").select("asset_id", (0.5 + F.col("k") / 50.0).alias("delta"), (F.col("k") / 100.0).alias("gamma"), (F.col("k") * 10.0).alias("vega"), (-F.col("k") / 20.0).alias("rho"))
    return op.stress_impacts(p, op.standard_scenarios(p.sparkSession), sens)


@query("risk_stress_impacts", "risk/stress-testing", "positions", f"WITH {_STRESS} SELECT scenario, factor, asset_id, ROUND(impact, 4) + 0.0 AS impact FROM im")
def _(p):
    return _impacts(p).select("scenario", "factor", "asset_id", r("impact"))


@query("risk_stress_results", "risk/stress-testing", "positions", f"WITH {_STRESS} SELECT scenario, ROUND(pnl, 2) AS pnl, ROUND(pnl / total * 100, 6) AS pnl_percent, ROUND(total + pnl, 2) AS post_value FROM rs")
def _(p):
    return op.stress_results(_impacts(p), p).select("scenario", r("pnl", 2), r("pnl_percent", 6), r("post_value", 2))


@query("risk_worst_case", "risk/stress-testing", "positions", f"WITH {_STRESS} SELECT scenario, ROUND(pnl, 2) AS pnl FROM rs ORDER BY rs.pnl LIMIT 1")
def _(p):
    return op.worst_case(op.stress_results(_impacts(p), p)).select("scenario", r("pnl", 2))


@query("risk_expected_stress_loss", "risk/stress-testing", "positions", f"WITH {_STRESS} SELECT ROUND(SUM(LEAST(pnl, 0) * probability), 2) AS expected_loss FROM rs")
def _(p):
    return op.expected_stress_loss(op.stress_results(_impacts(p), p)).select(r("expected_loss", 2))


@query("risk_standard_scenarios", "risk/stress-testing", "region", f"WITH {_SC} SELECT * FROM sc")
def _(region):
    return op.standard_scenarios(region.sparkSession)


@query("risk_recalculated_var", "risk/monte-carlo-var", "positions")
def _(p):
    updates = p.where("asset_id LIKE 'Brand#1%'").withColumn("value", F.col("value") * 2)
    return op.recalculated_var(p, updates, _corr(p)).select(r("var", 2), r("expected_shortfall", 2))
