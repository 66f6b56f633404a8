"""Credit scores, value at risk, portfolio aggregation, correlations and stress tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lakeloom.functions.normal import cdf, inverse, quantile


def score_to_pd(score: Column) -> Column:
    return 0.30 / (1 + F.exp(-(700.0 - score) / 50.0))


def pd_to_score(pd_: Column) -> Column:
    share = F.least(F.greatest(pd_, F.lit(0.001)), F.lit(0.30)) / 0.30
    # at the upper end the logarithm of 1 - share is minus infinity
    return F.when(share < 1, 700.0 - 50.0 * (F.log(share) - F.log(F.when(share < 1, 1 - share)))).otherwise(F.lit(float("-inf")))


def estimate_lgd(ltv: Column) -> Column:
    return F.greatest(0.45 - (1 - F.least(ltv, F.lit(1.0))) * 0.30, F.lit(0.10))


def risk_weighted_assets(pd_: Column, lgd: Column, ead: Column, maturity: Column) -> Column:
    """Basel IRB capital times 12.5: asset correlation between 0.12 and 0.24, maturity adjustment."""
    p = F.least(F.greatest(pd_, F.lit(0.0003)), F.lit(1.0))
    g = F.least(F.greatest(lgd, F.lit(0.0)), F.lit(1.0))
    w = (1 - F.exp(-50.0 * p)) / (1 - math.exp(-50.0))
    corr = 0.12 * w + 0.24 * (1 - w)
    b = F.pow(0.11852 - 0.05478 * F.log(p), 2)
    stressed = cdf(inverse(p) / F.sqrt(1 - corr) + F.sqrt(corr / (1 - corr)) * inverse(F.lit(0.999)))
    return 12.5 * g * (stressed - p) * (1 + (maturity - 2.5) * b) / (1 - 1.5 * b) * ead


def credit_scores(obligors: DataFrame) -> DataFrame:
    """obligor_id, credit_score (300 to 850), pd, lgd, expected_loss, rwa."""
    f = F.col
    parts = (
        f("payment_history") * 0.35 + (1 - f("credit_utilization")) * 30.0 + F.least("credit_history_years", F.lit(30.0)) * 0.3
        + (1 - F.least("debt_to_income", F.lit(1.0))) * 5.0 + (10 - F.least("recent_inquiries", F.lit(10))) * 0.15 - f("delinquencies") * 1.0
    )
    score = F.least(F.greatest(600.0 + parts, F.lit(300.0)), F.lit(850.0))
    df = obligors.withColumn("credit_score", score).withColumn("pd", score_to_pd(F.col("credit_score"))).withColumn("lgd", estimate_lgd(F.col("loan_to_value")))
    return df.select("obligor_id", "credit_score", "pd", "lgd", (F.col("pd") * F.col("lgd") * F.col("ead")).alias("expected_loss"), risk_weighted_assets(F.col("pd"), F.col("lgd"), F.col("ead"), F.col("maturity")).alias("rwa"))


def exposure_risk(exposures: DataFrame) -> DataFrame:
    """The same from exposures(obligor_id, pd, lgd, ead, maturity)."""
    p = F.col("pd")
    return exposures.select("obligor_id", pd_to_score(p).alias("credit_score"), "pd", "lgd", (p * F.col("lgd") * F.col("ead")).alias("expected_loss"), risk_weighted_assets(p, F.col("lgd"), F.col("ead"), F.col("maturity")).alias("rwa"))


def covariances(positions: DataFrame, corr: DataFrame) -> DataFrame:
    """i, j, wi, wj, si, sj, vi, rho of every ordered pair of positions(asset_id, value, mu, sigma); corr(i, j,
    rho) may list a pair once; missing pairs count 0, an asset with itself 1."""
    total = F.broadcast(positions.agg(F.sum("value").alias("total")))
    p = positions.crossJoin(total).withColumn("w", F.col("value") / F.col("total"))
    a, b = (p.select(F.col("asset_id").alias(x), F.col("w").alias(f"w{x}"), F.col("sigma").alias(f"s{x}"), F.col("value").alias(f"v{x}")) for x in "ij")
    both = corr.select("i", "j", "rho").unionByName(corr.select(F.col("j").alias("i"), F.col("i").alias("j"), "rho")).where("i <> j").distinct()
    pairs = a.crossJoin(b).join(both, ["i", "j"], "left")
    return pairs.withColumn("rho", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce("rho", F.lit(0.0)))).withColumn("cov", F.col("si") * F.col("sj") * F.col("rho"))


def portfolio_risk(positions: DataFrame, corr: DataFrame, confidence: float = 0.95, days: int = 10) -> DataFrame:
    """One row: volatility, parametric value at risk, expected shortfall, undiversified sum and benefit."""
    z, h = quantile(confidence), math.sqrt(days / 252.0)
    c = covariances(positions, corr)
    var = c.agg(F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("var"))
    total = positions.agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("sigma")).alias("alone"))
    tail = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (1 - confidence)
    one = var.crossJoin(F.broadcast(total)).withColumn("volatility", F.sqrt("var"))
    value = F.col("total") * F.col("volatility") * h
    one = one.select("volatility", (value * z).alias("var"), (value * tail).alias("expected_shortfall"), (F.col("alone") * z * h).alias("undiversified_var"))
    return one.withColumn("diversification_benefit", F.col("undiversified_var") - F.col("var"))


def component_var(positions: DataFrame, corr: DataFrame, total_var: float, confidence: float = 0.95, days: int = 10) -> DataFrame:
    """asset_id, component (w beta VaR; they sum to the total) and marginal value at risk."""
    c = covariances(positions, corr)
    by = c.groupBy(F.col("i").alias("asset_id")).agg(F.sum(F.col("wj") * F.col("cov")).alias("cov"), F.first("wi").alias("w"), F.first("vi").alias("value"))
    whole = F.broadcast(by.agg(F.sum(F.col("w") * F.col("cov")).alias("var"), F.sum("value").alias("total")))
    scale = quantile(confidence) * math.sqrt(days / 252.0)
    flat = F.sqrt("var") < 1e-10
    return by.crossJoin(whole).select("asset_id", F.when(flat, 0.0).otherwise(F.col("w") * F.col("cov") / F.col("var") * total_var).alias("component"), F.when(flat, 0.0).otherwise(scale * F.col("cov") / F.sqrt("var") * F.col("total")).alias("marginal"))


def _book(positions: DataFrame, corr: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, means, volatilities and the Cholesky factor; a book of positions is driver-sized."""
    p = positions.select("asset_id", "value", "mu", "sigma").orderBy("asset_id").toPandas()
    at = {a: k for k, a in enumerate(p["asset_id"])}
    m = np.eye(len(p))
    for i, j, rho in corr.select("i", "j", "rho").collect():
        if i in at and j in at and i != j:
            m[at[i], at[j]] = m[at[j], at[i]] = rho
    low = np.zeros_like(m)
    for k in range(len(m)):  # a factor with zeros where the matrix is not positive definite
        d = m[k, k] - low[k, :k] @ low[k, :k]
        low[k, k] = math.sqrt(d) if d > 0 else 0.0
        if abs(low[k, k]) > 1e-10:
            low[k + 1 :, k] = (m[k + 1 :, k] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
    return p["value"].to_numpy(float), p["mu"].to_numpy(float), p["sigma"].to_numpy(float), low


def simulate_pnl(positions: DataFrame, corr: DataFrame, days: int = 10, n: int = 10_000, seed: int = 42, per_stream: int = 1_000) -> DataFrame:
    """scenario and pnl.  Scenarios come in streams, each with a generator of its own seed, so any
    number of tasks gives the same scenarios."""
    value, mu, sigma, low = _book(positions, corr)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["stream"]:
                rng = np.random.default_rng([seed, int(s)])
                z = rng.standard_normal((per_stream, len(value))) @ low.T
                ret = mu * days / 252.0 + sigma * math.sqrt(days / 252.0) * z
                yield pd.DataFrame({"scenario": int(s) * per_stream + np.arange(per_stream), "pnl": ret @ value})

    streams = positions.sparkSession.range(math.ceil(n / per_stream)).select(F.col("id").alias("stream"))
    return streams.mapInPandas(task, "scenario long, pnl double").where(F.col("scenario") < n)


def monte_carlo_var(pnl: DataFrame, n: int, confidence: float = 0.95) -> DataFrame:
    """One row: minus the pnl at rank floor((1 - c) n), and minus the mean of those below it."""
    at = int((1 - confidence) * n)
    lowest = pnl.orderBy("pnl", "scenario").limit(at + 1)
    return lowest.agg((-F.max("pnl")).alias("var"), F.when(F.count(F.lit(1)) > 1, -(F.sum("pnl") - F.max("pnl")) / (F.count(F.lit(1)) - 1)).otherwise(-F.max("pnl")).alias("expected_shortfall"))


def upsert_positions(positions: DataFrame, updates: DataFrame) -> DataFrame:
    """Positions with those of ``updates`` put in their place, or added; a value of 0 takes one off the book."""
    kept = positions.join(updates.select("asset_id"), "asset_id", "left_anti")
    return kept.unionByName(updates.select(*positions.columns)).where("value <> 0")


def recalculated_var(positions: DataFrame, updates: DataFrame, corr: DataFrame, confidence: float = 0.95, days: int = 10, n: int = 10_000) -> DataFrame:
    """Value at risk and expected shortfall of the book after the updates, by simulation."""
    return monte_carlo_var(simulate_pnl(upsert_positions(positions, updates), corr, days, n), n, confidence)


def correlation_matrix(returns: DataFrame) -> DataFrame:
    """i <= j, rho and n over returns(asset_id, t, value) on common times, 0 for flat assets, within [-1, 1]."""
    a, b = (returns.select(F.col("asset_id").alias(x), "t", F.col("value").alias(f"r{x}")) for x in "ij")
    pairs = a.join(b, "t").where("i <= j").groupBy("i", "j").agg(F.corr("ri", "rj").alias("rho"), F.stddev_samp("ri").alias("si"), F.stddev_samp("rj").alias("sj"), F.count(F.lit(1)).alias("n"))
    ok = (F.col("si") > 1e-10) & (F.col("sj") > 1e-10)
    rho = F.when(F.col("i") == F.col("j"), 1.0).when(ok, F.least(F.greatest("rho", F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    return pairs.select("i", "j", rho.alias("rho"), "n")


def correlation_row(matrix: DataFrame, asset) -> DataFrame:
    """The other assets of one asset's row."""
    other = F.when(F.col("i") == asset, F.col("j")).otherwise(F.col("i"))
    return matrix.where((F.col("i") == asset) | (F.col("j") == asset)).select(other.alias("asset_id"), "rho")


# fixed values: name, factor, shock, probability
SCENARIOS = (
    ("2008 Financial Crisis", "equity", -0.40, 0.01), ("2008 Financial Crisis", "credit_spread", 0.03, 0.01), ("2008 Financial Crisis", "volatility", 1.0, 0.01),
    ("COVID-19 Crash", "equity", -0.30, 0.02), ("COVID-19 Crash", "interest_rate", -0.015, 0.02), ("COVID-19 Crash", "volatility", 2.0, 0.02),
    ("Equity Crash", "equity", -0.20, 0.01), ("Rate Shock +200", "interest_rate", 0.02, 0.05), ("Rate Shock -100", "interest_rate", -0.01, 0.05), ("Credit Spread Widening", "credit_spread", 0.01, 0.03),
    ("Stagflation", "equity", -0.15, 0.03), ("Stagflation", "interest_rate", 0.03, 0.03), ("Stagflation", "commodity", 0.30, 0.03),
    ("Flight to Quality", "equity", -0.25, 0.02), ("Flight to Quality", "interest_rate", -0.02, 0.02), ("Flight to Quality", "credit_spread", 0.015, 0.02),
)


def standard_scenarios(spark) -> DataFrame:
    return spark.createDataFrame(list(SCENARIOS), "scenario string, factor string, shock double, probability double")


def factor_impact() -> Column:
    """Equity by delta and gamma, rates by rho, volatility by vega alone, credit against delta, others by
    delta."""
    f, s, v = F.lower("factor"), F.col("shock"), F.col("value")
    linear = F.col("delta") * v * s
    return F.when(f.isin("equity", "stock", "index"), linear + 0.5 * F.col("gamma") * v * s * s).when(f.isin("interest_rate", "rate", "ir"), F.col("rho") * v * s).when(f.isin("volatility", "vol", "vega"), F.col("vega") * s).when(f.isin("credit_spread", "credit"), -linear).otherwise(linear)


def stress_impacts(positions: DataFrame, scenarios: DataFrame, sensitivities: DataFrame) -> DataFrame:
    """scenario, factor, asset_id, impact; assets without sensitivities have delta 1.  Scenarios are few."""
    df = positions.select("asset_id", "value").join(sensitivities, "asset_id", "left")
    df = df.withColumn("delta", F.coalesce("delta", F.lit(1.0)))
    for g in ("gamma", "vega", "rho"):
        df = df.withColumn(g, F.coalesce(g, F.lit(0.0)))
    return df.crossJoin(F.broadcast(scenarios)).select("scenario", "factor", "probability", "asset_id", "value", factor_impact().alias("impact"))


def stress_results(impacts: DataFrame, positions: DataFrame) -> DataFrame:
    """scenario, pnl, percent, value after."""
    total = F.broadcast(positions.agg(F.sum("value").alias("total")))
    s = impacts.groupBy("scenario").agg(F.sum("impact").alias("pnl"), F.first("probability").alias("probability")).crossJoin(total)
    return s.select("scenario", "probability", "pnl", F.when(F.abs("total") > 1e-10, F.col("pnl") / F.col("total") * 100).otherwise(0.0).alias("pnl_percent"), (F.col("total") + F.col("pnl")).alias("post_value"))


def worst_case(results: DataFrame) -> DataFrame:
    return results.orderBy("pnl", "scenario").limit(1)


def expected_stress_loss(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.sum(F.least("pnl", F.lit(0.0)) * F.col("probability")), F.lit(0.0)).alias("expected_loss"))
