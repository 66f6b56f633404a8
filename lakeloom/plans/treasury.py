"""Queries over cash flows, collateral, currencies, rates and liquidity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import treasury as op
from lakeloom.plans.registry import query, r

_S, _D = 10_000, 120  # days since 1970
_CF = f"""cal AS (SELECT unnest(range({_S}, {_S + _D})) AS day), g AS (SELECT day, SUM(CASE WHEN amount > 0 THEN amount * certainty ELSE 0 END) AS i, SUM(CASE WHEN amount < 0 THEN -amount * certainty ELSE 0 END) AS o, 1 - AVG(certainty) AS u FROM cash_flows GROUP BY 1),
f AS (SELECT cal.day, COALESCE(i, 0) AS inflow, COALESCE(o, 0) AS outflow, COALESCE(u, 0) AS uncertainty, -500000 + SUM(COALESCE(i, 0) - COALESCE(o, 0)) OVER (ORDER BY cal.day) AS balance FROM cal LEFT JOIN g USING (day))"""


@query("treasury_cash_forecast", "treasury/cashflow-forecast", "cash_flows", f"WITH {_CF} SELECT day, ROUND(inflow, 2) AS inflow, ROUND(outflow, 2) AS outflow, ROUND(uncertainty, 6) AS uncertainty, ROUND(balance, 2) AS balance FROM f")
def _(c):
    return op.cash_forecast(c, _S, _D, -500_000.0).select("day", r("inflow", 2), r("outflow", 2), r("uncertainty", 6), r("balance", 2))


@query("treasury_forecast_summary", "treasury/cashflow-forecast", "cash_flows", f"WITH {_CF} SELECT ROUND(SUM(inflow), 2) AS total_inflow, ROUND(SUM(outflow), 2) AS total_outflow, ROUND(MIN(balance), 2) AS min_balance, ROUND(MAX(balance), 2) AS max_balance, ROUND(arg_max(balance, day), 2) AS ending_balance FROM f")
def _(c):
    return op.forecast_summary(op.cash_forecast(c, _S, _D, -500_000.0)).select(*[r(x, 2) for x in ("total_inflow", "total_outflow", "min_balance", "max_balance", "ending_balance")])


@query("treasury_forecast_by_category", "treasury/cashflow-forecast", "cash_flows", f"""WITH cal AS (SELECT unnest(range({_S}, {_S + _D})) AS day), c AS (SELECT DISTINCT category FROM cash_flows), g AS (SELECT category, day, SUM(amount * certainty) AS v FROM cash_flows GROUP BY 1, 2)
SELECT c.category, cal.day, ROUND(SUM(COALESCE(v, 0)) OVER (PARTITION BY c.category ORDER BY cal.day), 2) + 0.0 AS balance FROM cal CROSS JOIN c LEFT JOIN g ON g.category = c.category AND g.day = cal.day""")  # fmt: skip
def _(c):
    return op.cash_forecast(c, _S, _D, 0.0, ("category",)).select("category", "day", r("balance", 2))


@query("treasury_stressed_forecast", "treasury/cashflow-forecast", "cash_flows", f"""WITH cal AS (SELECT unnest(range({_S}, {_S + _D})) AS day), g AS (SELECT day, SUM(CASE WHEN amount > 0 THEN amount * 0.7 ELSE amount * 1.3 END * certainty * 0.9) AS v FROM cash_flows GROUP BY 1) SELECT day, ROUND(SUM(COALESCE(v, 0)) OVER (ORDER BY day), 2) + 0.0 AS balance FROM cal LEFT JOIN g USING (day)""")
def _(c):
    return op.cash_forecast(op.stressed(c, 0.7, 1.3, 0.9), _S, _D).select("day", r("balance", 2))


@query("treasury_funding_gaps", "treasury/cashflow-forecast", "cash_flows", f"""WITH {_CF}, l AS (SELECT *, balance < 2000000 AS low FROM f), x AS (SELECT *, day - row_number() OVER (PARTITION BY low ORDER BY day) AS run FROM l) SELECT MIN(day) AS start, MAX(day) AS "end", COUNT(*) AS days, ROUND(MAX(2000000 - balance), 2) AS shortfall FROM x WHERE low GROUP BY run""")
def _(c):
    return op.funding_gaps(op.cash_forecast(c, _S, _D, -500_000.0), 2_000_000.0).select("start", "end", "days", r("shortfall", 2))


_TYPES = ["GovernmentBond", "CorporateBond", "Equity", "Cash"]


def _assets(s):
    k = F.col("s_suppkey")
    return s.select(k.alias("asset_id"), F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (k % 4 + 1).cast("int")).alias("asset_type"), F.when(k % 3 == 0, "EUR").otherwise("USD").alias("currency"), (F.abs("s_acctbal") + 100).alias("value"), (k % 10 / 50.0).alias("haircut"), (k % 13 == 0).alias("pledged"))


def _needs(n):
    k = F.col("n_nationkey")
    return n.select(k.cast("long").alias("req_id"), F.col("n_name").alias("counterparty"), (k * 350.0 + 500).alias("amount"), F.when(k % 4 == 0, "EUR").otherwise("USD").alias("currency"), F.when(k % 2 == 0, F.array(F.lit("GovernmentBond"), F.lit("Cash"))).otherwise(F.array(*[F.lit(t) for t in _TYPES[:3]])).alias("types"), (k % 5).cast("long").alias("priority"))


@query("treasury_allocate_collateral", "treasury/collateral-opt", "supplier nation")
def _(s, n):
    return op.allocate_collateral(_assets(s), _needs(n)).select("req_id", "asset_id", r("amount"), r("value"))


@query("treasury_collateral_score", "treasury/collateral-opt", "supplier nation")
def _(s, n):
    a, q = _assets(s), _needs(n)
    return op.collateral_score(op.allocate_collateral(a, q), a, q).select(r("coverage", 6), r("quality", 6), r("hhi", 6), r("score", 6))


@query("treasury_eligible_by_type", "treasury/collateral-opt", "supplier", "SELECT ['GovernmentBond', 'CorporateBond', 'Equity', 'Cash'][s_suppkey % 4 + 1] AS asset_type, ROUND(SUM((ABS(s_acctbal) + 100) * (1 - s_suppkey % 10 / 50.0)), 4) AS eligible FROM supplier WHERE s_suppkey % 13 <> 0 GROUP BY 1")
def _(s):
    return op.eligible_by_type(_assets(s)).select("asset_type", r("eligible"))


@query("treasury_collateral_utilisation", "treasury/collateral-opt", "supplier nation")
def _(s, n):
    a = _assets(s)
    return op.collateral_utilisation(a, op.allocate_collateral(a, _needs(n))).select(r("total", 2), r("pledged", 2), r("used", 2), r("free", 2), r("utilisation", 6))


_RATES = [("EUR", "USD", 1.10, 1.099, 1.101), ("GBP", "USD", 1.25, 1.249, 1.252), ("USD", "JPY", 150.0, 149.9, 150.1), ("USD", "CHF", 0.9, 0.899, 0.901)]
_CUR = "['EUR', 'GBP', 'JPY', 'CHF', 'SEK', 'USD']"
_FX = f"""p AS (SELECT {_CUR}[c_custkey % 6 + 1] AS currency, c_acctbal * 100 * CASE WHEN c_custkey % 7 < 3 THEN -1 ELSE 1 END AS amount FROM customer),
x AS (SELECT currency, SUM(GREATEST(amount, 0)) AS "long", SUM(GREATEST(-amount, 0)) AS short FROM p WHERE currency <> 'USD' GROUP BY 1),
e AS (SELECT *, "long" - short AS net, ("long" - short) * CASE currency WHEN 'EUR' THEN 1.10 WHEN 'GBP' THEN 1.25 WHEN 'JPY' THEN 1 / 150.0 WHEN 'CHF' THEN 1 / 0.9 ELSE 1 END AS base_equivalent FROM x)"""


def _exposures(c):
    cur = F.element_at(F.array(*[F.lit(x) for x in ("EUR", "GBP", "JPY", "CHF", "SEK", "USD")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    p = c.select(cur.alias("currency"), (F.col("c_acctbal") * 100 * F.when(F.col("c_custkey") % 7 < 3, -1).otherwise(1)).alias("amount"))
    rates = c.sparkSession.createDataFrame(_RATES, "base string, quote string, rate double, bid double, ask double")
    return op.fx_exposures(p, rates), rates


@query("treasury_fx_exposures", "treasury/fx-hedging", "customer", f'WITH {_FX} SELECT currency, ROUND("long", 2) AS "long", ROUND(short, 2) AS short, ROUND(net, 2) AS net, ROUND(base_equivalent, 2) AS base_equivalent FROM e')
def _(c):
    return _exposures(c)[0].select("currency", r("long", 2), r("short", 2), r("net", 2), r("base_equivalent", 2))


@query("treasury_forward_hedges", "treasury/fx-hedging", "customer", f"""WITH {_FX} SELECT currency || 'USD' AS pair, ROUND(ABS(net) * 0.8, 2) AS notional, 'Forward' AS hedge_type, CASE currency WHEN 'EUR' THEN 1.10 WHEN 'GBP' THEN 1.25 ELSE -1 END AS strike,
ROUND(ABS(net) * 0.8 * (CASE currency WHEN 'EUR' THEN 1.101 - 1.099 WHEN 'GBP' THEN 1.252 - 1.249 ELSE 0.01 END + 0.02 * 90 / 365), 2) AS cost FROM e WHERE ABS(net) >= 10000""")  # fmt: skip
def _(c):
    e, q = _exposures(c)
    return op.recommend_hedges(e, q).select("pair", r("notional", 2), "hedge_type", F.coalesce("strike", F.lit(-1.0)).alias("strike"), r("cost", 2))


for _kind in ("Option", "Collar"):
    query(f"treasury_{_kind.lower()}_hedges", "treasury/fx-hedging", "customer")(lambda c, kind=_kind: op.recommend_hedges(*_exposures(c), instrument=kind).select("pair", r("notional", 2), "hedge_type", r("strike", 6), r("cost", 2)))


@query("treasury_hedge_summary", "treasury/fx-hedging", "customer")
def _(c):
    e, q = _exposures(c)
    return op.hedge_summary(e, op.recommend_hedges(e, q, instrument="Option")).select(r("cost", 2), r("residual", 2), r("hedge_ratio", 6), r("var_reduction", 2))


@query("treasury_net_after_hedges", "treasury/fx-hedging", "customer", f"WITH {_FX} SELECT currency, ROUND(net - CASE WHEN ABS(net) >= 10000 THEN ABS(net) * 0.8 ELSE 0 END, 2) AS net FROM e")
def _(c):
    e, q = _exposures(c)
    return op.net_after_hedges(e, op.recommend_hedges(e, q)).select("currency", r("net", 2))


_NOW = 1_000_000_000
_KINDS = "['FixedBond', 'FloatingNote', 'Swap', 'Deposit', 'FixedLoan', 'FloatingLoan']"
_IR = f"""p AS (SELECT c_custkey AS id, {_KINDS}[c_custkey % 6 + 1] AS instrument, c_acctbal * 100 AS notional, 0.02 + c_custkey % 40 / 1000.0 AS rate, {_NOW} + (c_custkey * 37 % 4000 + 10) * 86400 AS maturity, CASE WHEN c_custkey % 4 <> 0 THEN {_NOW} + c_custkey % 180 * 86400 END AS next_reset, CASE WHEN c_custkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM customer),
t AS (SELECT *, (maturity - {_NOW}) / 31536000 AS t, notional * pow(1.025, -(maturity - {_NOW}) / 31536000 * 2) AS pv FROM p)"""
_IRM = f"""{_IR}, cf AS (SELECT id, SUM(k * cf * df) / SUM(cf * df) / 2 AS d, SUM(k * (k + 1) * cf * df) / SUM(cf * df) / pow(1.025, 2) / 4 AS c FROM (SELECT id, k, rate / 2 + CASE WHEN k = n THEN 1 ELSE 0 END AS cf, pow(1.025, -k) AS df FROM (SELECT id, rate, ceil(t * 2) AS n, unnest(range(1, CAST(ceil(t * 2) AS BIGINT) + 1)) AS k FROM t)) GROUP BY 1),
m AS (SELECT t.*, CASE WHEN instrument LIKE 'Fixed%' THEN d WHEN instrument LIKE 'Floating%' THEN COALESCE(GREATEST((next_reset - {_NOW}) / 31536000, 0), 0.25) WHEN instrument = 'Swap' THEN ABS((1 - exp(-GREATEST(rate, 0.01) * t)) / GREATEST(rate, 0.01) - 0.25) ELSE t END AS duration,
 CASE WHEN instrument LIKE 'Fixed%' THEN c WHEN instrument LIKE 'Floating%' THEN 0.01 ELSE 0.5 * t * t END AS convexity FROM t JOIN cf USING (id))"""


def _positions(c):
    k = F.col("c_custkey")
    return c.select(k.alias("id"), F.element_at(F.array(*[F.lit(x) for x in ("FixedBond", "FloatingNote", "Swap", "Deposit", "FixedLoan", "FloatingLoan")]), (k % 6 + 1).cast("int")).alias("instrument"), (F.col("c_acctbal") * 100).alias("notional"), (0.02 + k % 40 / 1000.0).alias("rate"), (_NOW + (k * 37 % 4000 + 10) * 86400).alias("maturity"), F.when(k % 4 != 0, _NOW + k % 180 * 86400).alias("next_reset"), F.when(k % 3 == 0, "EUR").otherwise("USD").alias("currency"))


@query("treasury_ir_measures", "treasury/ir-risk", "customer", f"WITH {_IRM} SELECT id, ROUND(pv, 4) AS pv, ROUND(duration, 6) AS duration, ROUND(convexity, 6) AS convexity FROM m")
def _(c):
    return op.ir_measures(_positions(c), _NOW).select("id", r("pv"), r("duration", 6), r("convexity", 6))


@query("treasury_ir_metrics", "treasury/ir-risk", "customer", f"WITH {_IRM}, a AS (SELECT SUM(pv) AS pv, SUM(ABS(pv) * duration) / SUM(ABS(pv)) AS d, SUM(ABS(pv) * convexity) / SUM(ABS(pv)) AS c FROM m) SELECT ROUND(pv, 2) AS pv, ROUND(d, 6) AS duration, ROUND(c, 6) AS convexity, ROUND(d / 1.025, 6) AS modified_duration, ROUND(d / 1.025 * ABS(pv) * 0.0001, 4) AS dv01 FROM a")
def _(c):
    return op.ir_metrics(_positions(c), _NOW).select(r("pv", 2), r("duration", 6), r("convexity", 6), r("modified_duration", 6), r("dv01"))


@query("treasury_pv01_by_currency", "treasury/ir-risk", "customer", f"WITH {_IRM} SELECT currency, ROUND(SUM(pv * duration / 1.025 * 0.0001), 4) AS pv01 FROM m GROUP BY 1")
def _(c):
    return op.pv01_by_currency(_positions(c), _NOW).select("currency", r("pv01"))


@query("treasury_gap_analysis", "treasury/ir-risk", "customer", f"""WITH {_IR}, b(k, bucket, hi) AS (VALUES (0, '0-1M', 30), (1, '1-3M', 90), (2, '3-6M', 180), (3, '6-12M', 365), (4, '1-2Y', 730), (5, '2-5Y', 1825), (6, '5Y+', 99999999)), d AS (SELECT notional, GREATEST(CASE WHEN instrument LIKE 'Floating%' THEN COALESCE(next_reset, maturity) ELSE maturity END - {_NOW}, 0) // 86400 AS days FROM t),
g AS (SELECT (SELECT MIN(k) FROM b WHERE days < hi) AS k, notional FROM d), s AS (SELECT b.k, bucket, COALESCE(SUM(GREATEST(notional, 0)), 0) AS assets, COALESCE(SUM(GREATEST(-notional, 0)), 0) AS liabilities FROM b LEFT JOIN g USING (k) GROUP BY 1, 2)
SELECT bucket, ROUND(assets, 2) AS assets, ROUND(liabilities, 2) AS liabilities, ROUND(assets - liabilities, 2) AS gap, ROUND(SUM(assets - liabilities) OVER (ORDER BY k), 2) AS cumulative_gap FROM s""")  # fmt: skip
def _(c):
    return op.gap_analysis(_positions(c), _NOW).select("bucket", r("assets", 2), r("liabilities", 2), r("gap", 2), r("cumulative_gap", 2))


@query("treasury_parallel_shift", "treasury/ir-risk", "customer", f"WITH {_IR}, a AS (SELECT SUM(pv) AS x, SUM(notional * pow(1.03, -t * 2)) AS y FROM t) SELECT ROUND(x, 2) AS pv_before, ROUND(y, 2) AS pv_after, ROUND(y - x, 2) AS pv_change, ROUND((y - x) / x, 8) AS percent FROM a")
def _(c):
    return op.parallel_shift(_positions(c), _NOW, 100.0).select(r("pv_before", 2), r("pv_after", 2), r("pv_change", 2), r("percent", 8))


@query("treasury_key_rate_durations", "treasury/ir-risk", "customer", f"WITH {_IR}, k AS (SELECT unnest([365, 730, 1825, 3650]) AS tenor) SELECT tenor, ROUND(-(SUM(notional * pow(1.02505, -t * 2)) - SUM(pv)) / SUM(pv) * 10000, 4) AS duration FROM t JOIN k ON ABS((maturity - {_NOW}) / 86400 - tenor) <= 180 GROUP BY 1")
def _(c):
    return op.key_rate_durations(_positions(c), _NOW).select("tenor", r("duration"))


_LT = "['CashReserves', 'Level1HQLA', 'Level2AHQLA', 'Level2BHQLA', 'OtherLiquid', 'Illiquid']"
_OC = "['RetailDeposits', 'WholesaleFunding', 'CommittedFacilities', 'Derivatives']"
_FT = "['Equity', 'LongTermDebt', 'RetailDeposit', 'WholesaleDeposit', 'Other']"
_LIQ = f"""a AS (SELECT s_suppkey AS id, {_LT}[s_suppkey % 6 + 1] AS asset_type, ABS(s_acctbal) * 30 AS amount, s_suppkey % 6 * 0.05 AS haircut, s_suppkey % 60 AS dl FROM supplier),
o AS (SELECT c_custkey AS id, {_OC}[c_custkey % 4 + 1] AS category, ABS(c_acctbal) AS amount, 0.05 + c_custkey % 5 * 0.1 AS runoff, c_custkey % 45 AS days FROM customer), i AS (SELECT ABS(c_acctbal) AS amount, 0.1 AS rate, c_custkey % 45 AS days FROM customer)"""


def _lcr_sql(a: str, o: str, i: str, p: str) -> str:
    return f"""{p}l AS (SELECT SUM(CASE WHEN asset_type IN ('CashReserves', 'Level1HQLA') THEN amount * (1 - haircut) ELSE 0 END) AS level1, SUM(CASE WHEN asset_type = 'Level2AHQLA' THEN amount * (1 - haircut) ELSE 0 END) AS r2a, SUM(CASE WHEN asset_type = 'Level2BHQLA' THEN amount * (1 - haircut) ELSE 0 END) AS r2b FROM {a}),
{p}m AS (SELECT *, LEAST(r2a, level1 * 0.4 / 0.6) AS level2a FROM {p}l), {p}n AS (SELECT *, LEAST(r2b, (level1 + level2a) * 0.15 / 0.85) AS level2b FROM {p}m), {p}h AS (SELECT *, level1 + LEAST(level2a + level2b, level1 * 0.4 / 0.6) AS hqla FROM {p}n),
{p}f AS (SELECT (SELECT SUM(amount * runoff) FROM {o} WHERE days <= 30) AS go, (SELECT SUM(amount * rate) FROM {i} WHERE days <= 30) AS gi), {p}z AS (SELECT *, GREATEST(go - LEAST(gi, go * 0.75), 0) AS net FROM {p}h, {p}f)"""


def _books(s, c):
    k, j = F.col("s_suppkey"), F.col("c_custkey")
    pick = lambda names, x: F.element_at(F.array(*[F.lit(n) for n in names]), (x % len(names) + 1).cast("int"))
    a = s.select(k.alias("id"), pick(("CashReserves", "Level1HQLA", "Level2AHQLA", "Level2BHQLA", "OtherLiquid", "Illiquid"), k).alias("asset_type"), (F.abs("s_acctbal") * 30).alias("amount"), (k % 6 * 0.05).alias("haircut"), (k % 60).alias("days_to_liquidate"))
    o = c.select(j.alias("id"), pick(("RetailDeposits", "WholesaleFunding", "CommittedFacilities", "Derivatives"), j).alias("category"), F.abs("c_acctbal").alias("amount"), (0.05 + j % 5 * 0.1).alias("runoff"), (j % 45).alias("days"))
    i = c.select(F.abs("c_acctbal").alias("amount"), F.lit(0.1).alias("rate"), (j % 45).alias("days"))
    f = c.select(j.alias("id"), pick(("Equity", "LongTermDebt", "RetailDeposit", "WholesaleDeposit", "Other"), j).alias("funding_type"), F.abs("c_acctbal").alias("amount"), (j % 500).alias("days"), (j % 2 == 0).alias("stable"))
    return a, o, i, f


@query("treasury_lcr", "treasury/liquidity-opt", "supplier customer", f"WITH {_LIQ}, {_lcr_sql('a', 'o', 'i', 'q')} SELECT ROUND(level1, 2) AS level1, ROUND(level2a, 2) AS level2a, ROUND(level2b, 2) AS level2b, ROUND(hqla, 2) AS hqla, ROUND(net, 2) AS net_outflows, ROUND(hqla / net, 6) AS ratio, ROUND(hqla - net, 2) AS buffer, hqla / net >= 1 AS compliant FROM qz")
def _(s, c):
    a, o, i, _ = _books(s, c)
    return op.lcr(a, o, i).select(*[r(x, 2) for x in ("level1", "level2a", "level2b", "hqla", "net_outflows")], r("ratio", 6), r("buffer", 2), "compliant")


@query("treasury_nsfr", "treasury/liquidity-opt", "supplier customer", f"""WITH {_LIQ}, f AS (SELECT {_FT}[c_custkey % 5 + 1] AS t, ABS(c_acctbal) AS amount, c_custkey % 500 AS d, c_custkey % 2 = 0 AS stable FROM customer),
x AS (SELECT (SELECT SUM(amount * CASE t WHEN 'Equity' THEN 1 WHEN 'LongTermDebt' THEN CASE WHEN d > 365 THEN 1 WHEN d > 180 THEN 0.5 ELSE 0 END WHEN 'RetailDeposit' THEN CASE WHEN stable THEN 0.95 ELSE 0.9 END WHEN 'WholesaleDeposit' THEN CASE WHEN d > 365 THEN 1 ELSE 0.5 END ELSE 0 END) FROM f) AS asf,
 (SELECT SUM(amount * CASE WHEN asset_type IN ('CashReserves', 'Level1HQLA') THEN 0 WHEN asset_type = 'Level2AHQLA' THEN 0.15 WHEN asset_type = 'Level2BHQLA' THEN 0.5 WHEN asset_type = 'OtherLiquid' AND dl <= 30 THEN 0.5 ELSE 1 END) FROM a) AS rsf)
SELECT ROUND(asf, 2) AS asf, ROUND(rsf, 2) AS rsf, ROUND(asf / rsf, 6) AS ratio, ROUND(asf - rsf, 2) AS buffer, asf / rsf >= 1 AS compliant FROM x""")  # fmt: skip
def _(s, c):
    a, _, _, f = _books(s, c)
    return op.nsfr(a, f).select(r("asf", 2), r("rsf", 2), r("ratio", 6), r("buffer", 2), "compliant")


@query("treasury_lcr_actions", "treasury/liquidity-opt", "supplier customer", f"""WITH {_LIQ}, b AS (SELECT * FROM a WHERE amount < 60000), {_lcr_sql('b', 'o', 'i', 'q')}, n AS (SELECT GREATEST(net - hqla, 0) AS need FROM qz),
w AS (SELECT id, haircut, need, LEAST(amount, need) AS used FROM a, n WHERE asset_type IN ('OtherLiquid', 'Illiquid') AND need > 0), v AS (SELECT *, SUM(used * (1 - haircut)) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) - used * (1 - haircut) AS before FROM w)
SELECT 'ConvertToHQLA' AS action, id, ROUND(used, 4) AS amount, ROUND(used * (1 - haircut), 6) AS impact, ROUND(used * 0.01, 6) AS cost FROM v WHERE before < need
UNION ALL SELECT 'ReduceCommitment', id, ROUND(amount * 0.1, 4), ROUND(amount * 0.1 * runoff, 6), ROUND(amount * 0.1 * 0.005, 6) FROM o, n WHERE category = 'CommittedFacilities' AND need > 0""")  # fmt: skip
def _(s, c):
    a, o, i, _ = _books(s, c)
    return op.lcr_actions(a, o, op.lcr(a.where("amount < 60000"), o, i)).select("action", "id", r("amount", 4), r("impact", 6), r("cost", 6))


@query("treasury_liquidity_stress", "treasury/liquidity-opt", "supplier customer", f"""WITH {_LIQ}, a2 AS (SELECT id, asset_type, amount, LEAST(haircut + 0.05, 1) AS haircut FROM a), o2 AS (SELECT id, amount, LEAST(runoff * CASE category WHEN 'WholesaleFunding' THEN 1.5 WHEN 'CommittedFacilities' THEN 1.3 ELSE 1.2 END, 1) AS runoff, days FROM o), i2 AS (SELECT amount, rate * 0.8 AS rate, days FROM i),
{_lcr_sql('a', 'o', 'i', 'q')}, {_lcr_sql('a2', 'o2', 'i2', 'w')} SELECT ROUND(qz.hqla / qz.net, 6) AS base_ratio, ROUND(wz.hqla / wz.net, 6) AS stressed_ratio, ROUND(wz.hqla - wz.net, 2) AS stressed_buffer FROM qz, wz""")  # fmt: skip
def _(s, c):
    a, o, i, _ = _books(s, c)
    return op.liquidity_stress(a, o, i).select(r("base_ratio", 6), r("stressed_ratio", 6), r("stressed_buffer", 2))


@query("treasury_nsfr_actions", "treasury/liquidity-opt", "supplier customer", f"""WITH {_LIQ}, b AS (SELECT id, asset_type, amount * 100 AS amount, dl FROM a), f AS (SELECT c_custkey AS id, {_FT}[c_custkey % 5 + 1] AS t, ABS(c_acctbal) AS amount, c_custkey % 500 AS d, c_custkey % 2 = 0 AS stable FROM customer),
x AS (SELECT (SELECT SUM(amount * CASE t WHEN 'Equity' THEN 1 WHEN 'LongTermDebt' THEN CASE WHEN d > 365 THEN 1 WHEN d > 180 THEN 0.5 ELSE 0 END WHEN 'RetailDeposit' THEN CASE WHEN stable THEN 0.95 ELSE 0.9 END WHEN 'WholesaleDeposit' THEN CASE WHEN d > 365 THEN 1 ELSE 0.5 END ELSE 0 END) FROM f)
 - (SELECT SUM(amount * CASE WHEN asset_type IN ('CashReserves', 'Level1HQLA') THEN 0 WHEN asset_type = 'Level2AHQLA' THEN 0.15 WHEN asset_type = 'Level2BHQLA' THEN 0.5 WHEN asset_type = 'OtherLiquid' AND dl <= 30 THEN 0.5 ELSE 1 END) FROM b) AS buffer),
n AS (SELECT GREATEST(-buffer, 0) AS need FROM x), w AS (SELECT id, d, need, LEAST(amount, need) AS used FROM f, n WHERE t = 'WholesaleDeposit' AND d < 365 AND need > 0), v AS (SELECT *, SUM(used * 0.5) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) - used * 0.5 AS before FROM w)
SELECT 'IssueTerm' AS action, id, ROUND(used, 4) AS amount, ROUND(used * 0.5, 6) AS impact, ROUND(used * 0.02 * (365 - d) / 365, 6) AS cost FROM v WHERE before < need
UNION ALL SELECT 'SellIlliquid', id, ROUND(LEAST(amount, need), 4), ROUND(LEAST(amount, need), 6), ROUND(LEAST(amount, need) * 0.1, 6) FROM b, n WHERE asset_type = 'Illiquid' AND need > 0""")  # fmt: skip
def _(s, c):
    a, _, _, f = _books(s, c)
    a = a.withColumn("amount", F.col("amount") * 100)
    return op.nsfr_actions(a, f, op.nsfr(a, f)).select("action", "id", r("amount", 4), r("impact", 6), r("cost", 6))


@query("treasury_lcr_improvement", "treasury/liquidity-opt", "supplier customer", f"""WITH {_LIQ}, b AS (SELECT id, asset_type, amount / 100 AS amount, haircut FROM a), {_lcr_sql('b', 'o', 'i', 'q')}, n AS (SELECT GREATEST(net - hqla, 0) AS need FROM qz),
w AS (SELECT id, haircut, need, LEAST(amount, need) AS used FROM b, n WHERE asset_type IN ('OtherLiquid', 'Illiquid') AND need > 0), v AS (SELECT *, SUM(used * (1 - haircut)) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) - used * (1 - haircut) AS before FROM w), g AS (SELECT * FROM v WHERE before < need),
b2 AS (SELECT id, asset_type, amount - COALESCE(used, 0) AS amount, b.haircut FROM b LEFT JOIN (SELECT id, used FROM g) g USING (id) UNION ALL SELECT id, 'Level1HQLA', used, 0 FROM g),
o2 AS (SELECT id, category, CASE WHEN category = 'CommittedFacilities' AND need > 0 THEN amount * 0.9 ELSE amount END AS amount, runoff, days FROM o, n), {_lcr_sql('b2', 'o2', 'i', 'w')}
SELECT ROUND(qz.hqla - qz.net, 2) AS before, ROUND(wz.hqla - wz.net, 2) AS after, ROUND(wz.hqla - wz.net - qz.hqla + qz.net, 2) AS improvement FROM qz, wz""")  # fmt: skip
def _(s, c):
    a, o, i, _ = _books(s, c)
    a = a.withColumn("amount", F.col("amount") / 100)
    return op.lcr_improvement(a, o, i, op.lcr_actions(a, o, op.lcr(a, o, i))).select(r("before", 2), r("after", 2), r("improvement", 2))


@query("treasury_optimise_liquidity", "treasury/liquidity-opt", "supplier customer", f"""WITH {_LIQ}, {_lcr_sql('a', 'o', 'i', 'q')}, n AS (SELECT GREATEST(net - hqla, 0) AS need FROM qz),
w AS (SELECT id, haircut, need, LEAST(amount, need) AS used FROM a, n WHERE asset_type IN ('OtherLiquid', 'Illiquid') AND need > 0), v AS (SELECT *, SUM(used * (1 - haircut)) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) - used * (1 - haircut) AS before FROM w),
f AS (SELECT c_custkey AS id, {_FT}[c_custkey % 5 + 1] AS t, ABS(c_acctbal) AS amount, c_custkey % 500 AS d, c_custkey % 2 = 0 AS stable FROM customer),
x AS (SELECT (SELECT SUM(amount * CASE t WHEN 'Equity' THEN 1 WHEN 'LongTermDebt' THEN CASE WHEN d > 365 THEN 1 WHEN d > 180 THEN 0.5 ELSE 0 END WHEN 'RetailDeposit' THEN CASE WHEN stable THEN 0.95 ELSE 0.9 END WHEN 'WholesaleDeposit' THEN CASE WHEN d > 365 THEN 1 ELSE 0.5 END ELSE 0 END) FROM f)
 - (SELECT SUM(amount * CASE WHEN asset_type IN ('CashReserves', 'Level1HQLA') THEN 0 WHEN asset_type = 'Level2AHQLA' THEN 0.15 WHEN asset_type = 'Level2BHQLA' THEN 0.5 WHEN asset_type = 'OtherLiquid' AND dl <= 30 THEN 0.5 ELSE 1 END) FROM a) AS buffer),
m AS (SELECT GREATEST(-buffer, 0) AS need FROM x), wf AS (SELECT id, d, need, LEAST(amount, need) AS used FROM f, m WHERE t = 'WholesaleDeposit' AND d < 365 AND need > 0), vf AS (SELECT *, SUM(used * 0.5) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) - used * 0.5 AS before FROM wf)
SELECT 'LCR' AS ratio, 'ConvertToHQLA' AS action, id, ROUND(used, 4) AS amount, ROUND(used * (1 - haircut), 6) AS impact, ROUND(used * 0.01, 6) AS cost FROM v WHERE before < need
UNION ALL SELECT 'LCR', 'ReduceCommitment', id, ROUND(amount * 0.1, 4), ROUND(amount * 0.1 * runoff, 6), ROUND(amount * 0.1 * 0.005, 6) FROM o, n WHERE category = 'CommittedFacilities' AND need > 0
UNION ALL SELECT 'NSFR', 'IssueTerm', id, ROUND(used, 4), ROUND(used * 0.5, 6), ROUND(used * 0.02 * (365 - d) / 365, 6) FROM vf WHERE before < need
UNION ALL SELECT 'NSFR', 'SellIlliquid', id, ROUND(LEAST(amount, need), 4), ROUND(LEAST(amount, need), 6), ROUND(LEAST(amount, need) * 0.1, 6) FROM a, m WHERE asset_type = 'Illiquid' AND need > 0""")  # fmt: skip
def _(s, c):
    a, o, i, f = _books(s, c)
    return op.optimise_liquidity(a, o, i, f).select("ratio", "action", "id", r("amount", 4), r("impact", 6), r("cost", 6))
