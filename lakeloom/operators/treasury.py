"""Cash forecasts, collateral, currency hedges, interest-rate risk and liquidity ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakeloom.functions.normal import option_cdf
from lakeloom.operators.groupmap import ordered_groups
from lakeloom.operators.joins import running_sum

# --- cash: flows(id, day, amount, category, certainty)


def daily_flows(flows: DataFrame, start: int, days: int, by: tuple[str, ...] = (), weighted: bool = True) -> DataFrame:
    """by, day, inflow, outflow, uncertainty (1 - mean certainty) for each day of the horizon."""
    amount = F.col("amount") * F.col("certainty") if weighted else F.col("amount")
    zero = F.lit(0.0)
    g = flows.where(F.col("day").between(start, start + days - 1)).groupBy(*by, "day").agg(F.sum(F.when(F.col("amount") > 0, amount).otherwise(zero)).alias("inflow"), F.sum(F.when(F.col("amount") < 0, -amount).otherwise(zero)).alias("outflow"), (1 - F.avg("certainty")).alias("uncertainty"))
    calendar = flows.sparkSession.range(start, start + days).select(F.col("id").alias("day"))
    grid = calendar if not by else flows.select(*by).distinct().crossJoin(F.broadcast(calendar))
    return grid.join(g, [*by, "day"], "left").na.fill(0.0, ["inflow", "outflow", "uncertainty"])


def cash_forecast(flows: DataFrame, start: int, days: int, opening: float = 0.0, by: tuple[str, ...] = (), weighted: bool = True) -> DataFrame:
    """daily_flows with net and the running balance from the opening one.  The window runs over the days of
    the horizon, not over flows."""
    w = W.partitionBy(*by).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    d = daily_flows(flows, start, days, by, weighted).withColumn("net", F.col("inflow") - F.col("outflow"))
    return d.withColumn("balance", opening + F.sum("net").over(w))


def forecast_summary(forecast: DataFrame) -> DataFrame:
    return forecast.agg(F.sum("inflow").alias("total_inflow"), F.sum("outflow").alias("total_outflow"), F.min("balance").alias("min_balance"), F.max("balance").alias("max_balance"), F.max_by("balance", "day").alias("ending_balance"))


def stressed(flows: DataFrame, inflow_factor: float, outflow_factor: float, certainty_factor: float = 1.0) -> DataFrame:
    amount = F.when(F.col("amount") > 0, F.col("amount") * inflow_factor).otherwise(F.col("amount") * outflow_factor)
    return flows.withColumn("amount", amount).withColumn("certainty", F.col("certainty") * certainty_factor)


def funding_gaps(forecast: DataFrame, floor: float) -> DataFrame:
    """start, end, days, shortfall of the runs of days with a balance under the floor."""
    w = W.orderBy("day")
    low = forecast.select("day", "balance", (F.col("balance") < floor).alias("low"))
    turn = F.when(F.col("low") != F.lag("low", 1, False).over(w), 1).otherwise(0)
    runs = low.withColumn("turn", turn).withColumn("run", F.sum("turn").over(w)).where("low")
    return runs.groupBy("run").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count(F.lit(1)).alias("days"), F.max(floor - F.col("balance")).alias("shortfall")).drop("run")


# --- collateral: assets(asset_id, asset_type, currency, value, haircut, pledged), requirements(req_id,
#     counterparty, amount, currency, types, priority)


def allocate_collateral(assets: DataFrame, requirements: DataFrame, order: str = "cheapest") -> DataFrame:
    """req_id, asset_id, amount (market value used) and value (after haircut).  Requirements by falling
    priority draw on free assets of their types and currency: cheapest to deliver first (largest haircut),
    "quality" (smallest) or "value" (largest).  Each currency is a pool of its own."""
    a = assets.where("NOT pledged").select("currency", F.lit(1).alias("kind"), F.col("asset_id").alias("id"), F.col("value").alias("size"), "haircut", F.array("asset_type").alias("types"), F.lit(0).alias("priority"))
    q = requirements.select("currency", F.lit(0).alias("kind"), F.col("req_id").alias("id"), F.col("amount").alias("size"), F.lit(0.0).alias("haircut"), "types", "priority")
    sort = {"cheapest": lambda x: (-x["haircut"], x["id"]), "quality": lambda x: (x["haircut"], x["id"]), "value": lambda x: (-x["size"], x["id"])}[order]

    def pool(_: tuple, rows: list[dict]) -> list[tuple]:
        free = {x["id"]: x["size"] for x in rows if x["kind"] == 1}
        ranked = sorted((x for x in rows if x["kind"] == 1), key=sort)
        out = []
        for need in sorted((x for x in rows if x["kind"] == 0), key=lambda x: (-x["priority"], x["id"])):
            left = need["size"]
            for asset in ranked:
                if left <= 1e-9:
                    break
                if asset["types"][0] in need["types"] and free[asset["id"]] > 1e-9:
                    worth = 1 - asset["haircut"]
                    used = min(free[asset["id"]], left / worth)
                    free[asset["id"]] -= used
                    left -= used * worth
                    out.append((need["id"], asset["id"], used, used * worth))
        return out

    return ordered_groups(a.unionByName(q), ["currency"], ["kind", "id"], pool, "req_id long, asset_id long, amount double, value double")


def collateral_score(allocations: DataFrame, assets: DataFrame, requirements: DataFrame) -> DataFrame:
    """One row: coverage, quality (1 - value-weighted haircut), concentration by type, and the score 0.6, 0.25,
    0.15 of coverage, quality and 1 - concentration."""
    j = allocations.join(assets.select("asset_id", "asset_type", "haircut"), "asset_id")
    need = F.broadcast(requirements.agg(F.sum("amount").alias("need")))
    sums = j.agg(F.sum("value").alias("got"), (1 - F.sum(F.col("value") * F.col("haircut")) / F.sum("value")).alias("quality"))
    share = j.groupBy("asset_type").agg(F.sum("value").alias("v")).agg((F.sum(F.col("v") * F.col("v")) / F.pow(F.sum("v"), 2)).alias("hhi"))
    one = sums.crossJoin(F.broadcast(share)).crossJoin(need).withColumn("coverage", F.least(F.col("got") / F.col("need"), F.lit(1.0)))
    return one.select("coverage", "quality", "hhi", (0.6 * F.col("coverage") + 0.25 * F.col("quality") + 0.15 * (1 - F.col("hhi"))).alias("score"))


def eligible_by_type(assets: DataFrame) -> DataFrame:
    return assets.where("NOT pledged").groupBy("asset_type").agg(F.sum(F.col("value") * (1 - F.col("haircut"))).alias("eligible"))


def collateral_utilisation(assets: DataFrame, allocations: DataFrame) -> DataFrame:
    a = assets.agg(F.sum("value").alias("total"), F.coalesce(F.sum(F.when(F.col("pledged"), F.col("value"))), F.lit(0.0)).alias("pledged"))
    u = allocations.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("used"))
    one = a.crossJoin(F.broadcast(u))
    return one.withColumn("free", F.col("total") - F.col("pledged") - F.col("used")).withColumn("utilisation", (F.col("pledged") + F.col("used")) / F.col("total"))


# --- currencies: positions(currency, amount), rates(base, quote, rate, bid, ask)


def fx_exposures(positions: DataFrame, rates: DataFrame, base: str = "USD") -> DataFrame:
    """currency, long, short, net and base_equivalent by the direct rate, else the inverse one, else 1."""
    p = positions.where(F.col("currency") != base).groupBy("currency").agg(F.sum(F.greatest("amount", F.lit(0.0))).alias("long"), F.sum(F.greatest(-F.col("amount"), F.lit(0.0))).alias("short"))
    direct = rates.where(F.col("quote") == base).select(F.col("base").alias("currency"), F.col("rate").alias("direct"))
    inverse = rates.where(F.col("base") == base).select(F.col("quote").alias("currency"), (1 / F.col("rate")).alias("inverse"))
    net = F.col("long") - F.col("short")
    return p.join(F.broadcast(direct), "currency", "left").join(F.broadcast(inverse), "currency", "left").select("currency", "long", "short", net.alias("net"), (net * F.coalesce("direct", "inverse", F.lit(1.0))).alias("base_equivalent"))


def black_scholes(spot: Column, strike: Column, years: float, rate: float, vol: float, call: Column) -> Column:
    """Premium of a call or put; the intrinsic value without time or volatility."""
    if years <= 0 or vol <= 0:
        return F.greatest(F.when(call, spot - strike).otherwise(strike - spot), F.lit(0.0))
    root = vol * math.sqrt(years)
    d1 = (F.log(spot / strike) + (rate + vol * vol / 2) * years) / root
    d2 = d1 - root
    paid = strike * math.exp(-rate * years)
    return F.when(call, spot * option_cdf(d1) - paid * option_cdf(d2)).otherwise(paid * option_cdf(-d2) - spot * option_cdf(-d1))


def recommend_hedges(exposures: DataFrame, rates: DataFrame, base: str = "USD", instrument: str = "Forward", ratio: float = 0.8, least: float = 10_000.0, days: int = 90, carry: float = 0.02, vol: float = 0.10, otm: float = 0.05) -> DataFrame:
    """pair, notional, hedge_type, strike, cost for exposures of at least ``least``."""
    quote = F.broadcast(rates.where(F.col("quote") == base).select(F.col("base").alias("currency"), "rate", (F.col("ask") - F.col("bid")).alias("spread")))
    df = exposures.where(F.abs("net") >= least).join(quote, "currency", "left").withColumn("notional", F.abs("net") * ratio)
    spot, years = F.coalesce("rate", F.lit(1.0)), days / 365.0
    price = lambda call: black_scholes(spot, spot * F.when(call, 1 + otm).otherwise(1 - otm), years, 0.02, vol, call) * F.col("notional") / spot
    short = F.col("net") < 0
    if instrument == "Forward":
        kind, strike, cost = F.lit("Forward"), F.col("rate"), F.col("notional") * (F.coalesce("spread", F.lit(0.01)) + carry * days / 365.0)
    elif instrument == "Option":
        kind, strike, cost = F.when(short, "Call").otherwise("Put"), spot * F.when(short, 1 + otm).otherwise(1 - otm), price(short)
    else:
        kind, strike, cost = F.lit("Collar"), spot * (1 - otm), F.greatest(price(F.lit(False)) - 0.9 * price(F.lit(True)), F.lit(0.0))
    return df.select(F.concat("currency", F.lit(base)).alias("pair"), "notional", kind.alias("hedge_type"), strike.alias("strike"), cost.alias("cost"))


def hedge_summary(exposures: DataFrame, hedges: DataFrame, days: int = 90, vol: float = 0.10) -> DataFrame:
    """One row: cost, residual, hedge ratio and the reduction of value at risk (95 percent, by delta, less a
    gamma allowance for options and a twentieth for basis risk)."""
    e = exposures.agg(F.sum(F.abs("net")).alias("gross"), F.sum(F.abs("base_equivalent")).alias("base"))
    years = days / 365.0
    d1 = (0.02 + vol * vol / 2) * years / (vol * math.sqrt(years))
    phi = option_cdf(F.lit(d1))
    delta = F.when(F.col("hedge_type").isin("Forward", "Swap"), 1.0).when(F.col("hedge_type") == "Call", phi).when(F.col("hedge_type") == "Put", F.abs(phi - 1)).otherwise(0.7)
    h = hedges.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("notional"), F.lit(0.0)).alias("notional"), F.coalesce(F.sum(F.col("notional") * delta), F.lit(0.0)).alias("delta"), F.coalesce(F.max(F.col("hedge_type").isin("Put", "Call", "Collar")), F.lit(False)).alias("options"))
    one = e.crossJoin(F.broadcast(h))
    move = 1.645 * vol * math.sqrt(days / 252.0)
    effect = F.least(F.coalesce(F.try_divide(F.col("delta"), F.col("gross")), F.lit(0.0)), F.lit(1.0))
    residual = F.col("gross") - F.col("notional")
    return one.select("cost", residual.alias("residual"), F.coalesce(1 - F.try_divide(residual, F.col("gross")), F.lit(0.0)).alias("hedge_ratio"), (F.col("base") * move * effect * F.when(F.col("options"), 1 - 0.3 * move).otherwise(1.0) * 0.95).alias("var_reduction"))


def net_after_hedges(exposures: DataFrame, hedges: DataFrame) -> DataFrame:
    both = exposures.select("currency", "net").unionByName(hedges.select(F.substring("pair", 1, 3).alias("currency"), (-F.col("notional")).alias("net")))
    return both.groupBy("currency").agg(F.sum("net").alias("net"))


# --- interest rates: positions(id, instrument, notional, rate, maturity, next_reset, currency), seconds

BUCKETS = (("0-1M", 0, 30), ("1-3M", 30, 90), ("3-6M", 90, 180), ("6-12M", 180, 365), ("1-2Y", 365, 730), ("2-5Y", 730, 1825), ("5Y+", 1825, 1 << 31))
_YEAR = 365 * 86_400


def _years(now: int) -> Column:
    return (F.col("maturity") - now) / _YEAR


def present_value(now: int, market: float, frequency: int = 2) -> Column:
    """The notional discounted from maturity; itself once due."""
    t = _years(now)
    return F.col("notional") * F.when(t <= 0, 1.0).otherwise(F.pow(F.lit(1 + market / frequency), -t * frequency))


def ir_measures(positions: DataFrame, now: int, market: float = 0.05, frequency: int = 2) -> DataFrame:
    """id, pv, duration and convexity.  Coupons of a fixed instrument are summed by the closed forms of
    geometric series over its periods, in the row."""
    t = _years(now)
    n = F.ceil(t * frequency).cast("double")
    y, c = market / frequency, F.col("rate") / frequency
    v = 1 / (1 + y)
    vn = F.pow(F.lit(v), n)
    # sums over k = 1..n of v^k, k v^k and k (k + 1) v^k
    s0 = v * (1 - vn) / (1 - v)
    s1 = (s0 / v - n * vn) * v / (1 - v)
    s2 = (2 * s1 / v - n * (n + 1) * vn) * v / (1 - v)
    price = c * s0 + vn
    fixed = F.col("instrument").isin("FixedBond", "FixedLoan")
    floats = F.col("instrument").isin("FloatingNote", "FloatingLoan")
    swap = F.greatest("rate", F.lit(0.01))
    duration = (
        F.when(fixed, F.when(n <= 0, t).otherwise((c * s1 + n * vn) / price / frequency))
        .when(floats, F.coalesce(F.greatest((F.col("next_reset") - now) / _YEAR, F.lit(0.0)), F.lit(0.25)))
        .when(F.col("instrument") == "Swap", F.abs((1 - F.exp(-swap * t)) / swap - 0.25))
        .otherwise(t)
    )
    convexity = F.when(fixed, F.when(n <= 0, t * t).otherwise((c * s2 + n * (n + 1) * vn) / price / (1 + y) ** 2 / frequency**2)).when(floats, 0.01).otherwise(0.5 * t * t)
    return positions.withColumn("pv", present_value(now, market, frequency)).withColumn("duration", duration).withColumn("convexity", convexity)


def ir_metrics(positions: DataFrame, now: int, market: float = 0.05, frequency: int = 2) -> DataFrame:
    """One row: value, weighted duration, modified duration, convexity and the value of a basis point."""
    m = ir_measures(positions, now, market, frequency)
    w = F.sum(F.abs("pv"))
    a = m.agg(F.sum("pv").alias("pv"), (F.sum(F.abs("pv") * F.col("duration")) / w).alias("duration"), (F.sum(F.abs("pv") * F.col("convexity")) / w).alias("convexity"))
    a = a.withColumn("modified_duration", F.col("duration") / (1 + market / frequency))
    return a.withColumn("dv01", F.col("modified_duration") * F.abs("pv") * 0.0001)


def pv01_by_currency(positions: DataFrame, now: int, market: float = 0.05, frequency: int = 2) -> DataFrame:
    m = ir_measures(positions, now, market, frequency)
    return m.groupBy("currency").agg(F.sum(F.col("pv") * F.col("duration") / (1 + market / frequency) * 0.0001).alias("pv01"))


def gap_analysis(positions: DataFrame, now: int, buckets: tuple = BUCKETS) -> DataFrame:
    """bucket, assets, liabilities, gap, cumulative_gap by days to maturity, or to the next reset of floaters."""
    due = F.when(F.col("instrument").isin("FloatingNote", "FloatingLoan"), F.coalesce("next_reset", "maturity")).otherwise(F.col("maturity"))
    days = F.floor(F.greatest(due - now, F.lit(0)) / 86_400)
    k = F.lit(len(buckets) - 1)
    for i in reversed(range(len(buckets) - 1)):
        k = F.when(days < buckets[i][2], i).otherwise(k)
    g = positions.groupBy(k.alias("k")).agg(F.sum(F.greatest("notional", F.lit(0.0))).alias("assets"), F.sum(F.greatest(-F.col("notional"), F.lit(0.0))).alias("liabilities"))
    names = positions.sparkSession.createDataFrame([(i, b[0]) for i, b in enumerate(buckets)], "k int, bucket string")
    out = F.broadcast(names).join(g, "k", "left").na.fill(0.0).withColumn("gap", F.col("assets") - F.col("liabilities"))
    return out.withColumn("cumulative_gap", F.sum("gap").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0))).drop("k")


def parallel_shift(positions: DataFrame, now: int, bps: float, market: float = 0.05, frequency: int = 2) -> DataFrame:
    a = positions.agg(F.sum(present_value(now, market, frequency)).alias("pv_before"), F.sum(present_value(now, market + bps / 10_000, frequency)).alias("pv_after"))
    change = F.col("pv_after") - F.col("pv_before")
    return a.withColumn("pv_change", change).withColumn("percent", F.coalesce(F.try_divide(change, F.col("pv_before")), F.lit(0.0)))


def key_rate_durations(positions: DataFrame, now: int, tenors: tuple[int, ...] = (365, 730, 1825, 3650), market: float = 0.05, frequency: int = 2) -> DataFrame:
    """tenor and -10000 times the relative change for a basis point, of positions due within 180 days of it."""
    days = (F.col("maturity") - now) / 86_400
    hits = F.array_compact(F.array(*[F.when(F.abs(days - t) <= 180, F.lit(t)) for t in tenors]))
    g = positions.withColumn("tenor", F.explode(hits)).groupBy("tenor").agg(F.sum(present_value(now, market, frequency)).alias("a"), F.sum(present_value(now, market + 0.0001, frequency)).alias("b"))
    return g.select("tenor", F.coalesce(-F.try_divide(F.col("b") - F.col("a"), F.col("a")) * 10_000, F.lit(0.0)).alias("duration"))


# --- liquidity: assets(id, asset_type, amount, haircut, days_to_liquidate), outflows(id, category, amount,
#     runoff, days), inflows(amount, rate, days), funding(id, funding_type, amount, days, stable)


def lcr(assets: DataFrame, outflows: DataFrame, inflows: DataFrame, floor: float = 1.0, cap_2a: float = 0.40, cap_2b: float = 0.15, cap_2: float = 0.40, cap_in: float = 0.75) -> DataFrame:
    """One row: level1, level2a, level2b, hqla, net_outflows, ratio (null without outflows), buffer, compliant."""
    kind, worth = F.col("asset_type"), F.col("amount") * (1 - F.col("haircut"))
    part = lambda *t: F.coalesce(F.sum(F.when(kind.isin(*t), worth)), F.lit(0.0))
    a = assets.agg(part("CashReserves", "Level1HQLA").alias("level1"), part("Level2AHQLA").alias("raw_2a"), part("Level2BHQLA").alias("raw_2b"))
    a = a.withColumn("level2a", F.least("raw_2a", F.col("level1") * (cap_2a / (1 - cap_2a))))
    a = a.withColumn("level2b", F.least("raw_2b", (F.col("level1") + F.col("level2a")) * (cap_2b / (1 - cap_2b))))
    a = a.withColumn("hqla", F.col("level1") + F.least(F.col("level2a") + F.col("level2b"), F.col("level1") * (cap_2 / (1 - cap_2))))
    o = outflows.where("days <= 30").agg(F.coalesce(F.sum(F.col("amount") * F.col("runoff")), F.lit(0.0)).alias("gross_out"))
    i = inflows.where("days <= 30").agg(F.coalesce(F.sum(F.col("amount") * F.col("rate")), F.lit(0.0)).alias("gross_in"))
    one = a.crossJoin(F.broadcast(o)).crossJoin(F.broadcast(i)).withColumn("net_outflows", F.greatest(F.col("gross_out") - F.least("gross_in", F.col("gross_out") * cap_in), F.lit(0.0)))
    one = one.withColumn("ratio", F.try_divide(F.col("hqla"), F.col("net_outflows"))).withColumn("buffer", F.col("hqla") - F.col("net_outflows") * floor)
    return one.select("level1", "level2a", "level2b", "hqla", "net_outflows", "ratio", "buffer", F.coalesce(F.col("ratio") >= floor, F.lit(True)).alias("compliant"))


def asf_factor() -> Column:
    t, d = F.col("funding_type"), F.col("days")
    return F.when(t == "Equity", 1.0).when(t == "LongTermDebt", F.when(d > 365, 1.0).when(d > 180, 0.5).otherwise(0.0)).when(t == "RetailDeposit", F.when(F.col("stable"), 0.95).otherwise(0.90)).when(t == "WholesaleDeposit", F.when(d > 365, 1.0).otherwise(0.5)).otherwise(0.0)


def rsf_factor() -> Column:
    t = F.col("asset_type")
    return F.when(t.isin("CashReserves", "Level1HQLA"), 0.0).when(t == "Level2AHQLA", 0.15).when(t == "Level2BHQLA", 0.5).when((t == "OtherLiquid") & (F.col("days_to_liquidate") <= 30), 0.5).otherwise(1.0)


def nsfr(assets: DataFrame, funding: DataFrame, floor: float = 1.0) -> DataFrame:
    a = funding.agg(F.coalesce(F.sum(F.col("amount") * asf_factor()), F.lit(0.0)).alias("asf"))
    r = assets.agg(F.coalesce(F.sum(F.col("amount") * rsf_factor()), F.lit(0.0)).alias("rsf"))
    one = a.crossJoin(F.broadcast(r)).withColumn("ratio", F.try_divide(F.col("asf"), F.col("rsf"))).withColumn("buffer", F.col("asf") - F.col("rsf") * floor)
    return one.withColumn("compliant", F.coalesce(F.col("ratio") >= floor, F.lit(True)))


def lcr_actions(assets: DataFrame, outflows: DataFrame, lcr_row: DataFrame, cost_rate: float = 0.01, commitment_cost: float = 0.005) -> DataFrame:
    """action, id, amount, impact, cost if the buffer is negative: illiquid assets, in order of id, are
    converted (each up to the whole shortfall) until their impact makes it up, and committed facilities are
    cut by a tenth."""
    need = F.broadcast(lcr_row.select(F.greatest(-F.col("buffer"), F.lit(0.0)).alias("need")))
    a = assets.where(F.col("asset_type").isin("OtherLiquid", "Illiquid")).crossJoin(need).where("need > 0")
    a = a.withColumn("used", F.least("amount", "need")).withColumn("impact", F.col("used") * (1 - F.col("haircut")))
    a = running_sum(a, F.col("impact"), "id", "upto").where(F.col("upto") - F.col("impact") < F.col("need"))
    convert = a.select(F.lit("ConvertToHQLA").alias("action"), "id", F.col("used").alias("amount"), "impact", (F.col("used") * cost_rate).alias("cost"))
    cut = outflows.where(F.col("category") == "CommittedFacilities").crossJoin(need).where("need > 0")
    cut = cut.select(F.lit("ReduceCommitment").alias("action"), "id", (F.col("amount") * 0.1).alias("amount"), (F.col("amount") * 0.1 * F.col("runoff")).alias("impact"), (F.col("amount") * 0.1 * commitment_cost).alias("cost"))
    return convert.unionByName(cut)


def nsfr_actions(assets: DataFrame, funding: DataFrame, nsfr_row: DataFrame, spread: float = 0.02, sale_haircut: float = 0.10) -> DataFrame:
    """action, id, amount, impact, cost if stable funding falls short: wholesale deposits of under a year, in
    order of id, are replaced by term funding (each up to the whole shortfall) until that makes it up, and
    illiquid assets are sold, each up to the whole shortfall."""
    need = F.broadcast(nsfr_row.select(F.greatest(-F.col("buffer"), F.lit(0.0)).alias("need")))
    f = funding.where((F.col("funding_type") == "WholesaleDeposit") & (F.col("days") < 365)).crossJoin(need).where("need > 0")
    f = f.withColumn("used", F.least("amount", "need")).withColumn("impact", F.col("used") * 0.5)
    f = running_sum(f, F.col("impact"), "id", "upto").where(F.col("upto") - F.col("impact") < F.col("need"))
    term = f.select(F.lit("IssueTerm").alias("action"), "id", F.col("used").alias("amount"), "impact", (F.col("used") * spread * (365 - F.col("days")) / 365).alias("cost"))
    a = assets.where(F.col("asset_type") == "Illiquid").crossJoin(need).where("need > 0").withColumn("used", F.least("amount", "need"))
    return term.unionByName(a.select(F.lit("SellIlliquid").alias("action"), "id", F.col("used").alias("amount"), F.col("used").alias("impact"), (F.col("used") * sale_haircut).alias("cost")))


def lcr_improvement(assets: DataFrame, outflows: DataFrame, inflows: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: the buffer before and after the actions, and the improvement.  What is converted leaves its
    asset and is level 1 without a haircut; commitments that are cut leave their outflow."""
    done = lambda name, key: actions.where(F.col("action") == name).groupBy(F.col("id").alias(key)).agg(F.sum("amount").alias("moved"))
    gone = assets.join(done("ConvertToHQLA", "_id"), F.col("id") == F.col("_id"), "left")
    left = gone.withColumn("amount", F.col("amount") - F.coalesce("moved", F.lit(0.0))).select(*assets.columns)
    made = gone.where("moved > 0").withColumns({"asset_type": F.lit("Level1HQLA"), "amount": F.col("moved"), "haircut": F.lit(0.0)}).select(*assets.columns)
    cut = outflows.join(done("ReduceCommitment", "_id"), F.col("id") == F.col("_id"), "left").withColumn("amount", F.col("amount") - F.coalesce("moved", F.lit(0.0))).select(*outflows.columns)
    before, after = lcr(assets, outflows, inflows), lcr(left.unionByName(made), cut, inflows)
    return before.select(F.col("buffer").alias("before")).crossJoin(F.broadcast(after.select(F.col("buffer").alias("after")))).withColumn("improvement", F.col("after") - F.col("before"))


def optimise_liquidity(assets: DataFrame, outflows: DataFrame, inflows: DataFrame, funding: DataFrame) -> DataFrame:
    """The actions for both ratios: ratio, action, id, amount, impact, cost."""
    short = lcr_actions(assets, outflows, lcr(assets, outflows, inflows)).withColumn("ratio", F.lit("LCR"))
    stable = nsfr_actions(assets, funding, nsfr(assets, funding)).withColumn("ratio", F.lit("NSFR"))
    return short.unionByName(stable)


def liquidity_stress(assets: DataFrame, outflows: DataFrame, inflows: DataFrame, extra_haircut: float = 0.05, inflow_factor: float = 0.8, multipliers: dict[str, float] | None = None, default: float = 1.2) -> DataFrame:
    """One row: the liquidity coverage before and after larger run-off, haircuts and smaller inflows, and days
    until cover falls under a half (90 at most looked at)."""
    multipliers = {"WholesaleFunding": 1.5, "CommittedFacilities": 1.3} if multipliers is None else multipliers
    factor = F.lit(default)
    for k, m in multipliers.items():
        factor = F.when(F.col("category") == k, m).otherwise(factor)
    hard = lcr(assets.withColumn("haircut", F.least(F.col("haircut") + extra_haircut, F.lit(1.0))), outflows.withColumn("runoff", F.least(F.col("runoff") * factor, F.lit(1.0))), inflows.withColumn("rate", F.col("rate") * inflow_factor))
    base = lcr(assets, outflows, inflows).select(F.col("ratio").alias("base_ratio"))
    days = F.ceil((F.col("hqla") - 0.5 * F.col("net_outflows")) / F.when(F.col("net_outflows") > 0, F.col("net_outflows") / 30))
    hard = hard.select(F.col("ratio").alias("stressed_ratio"), F.col("buffer").alias("stressed_buffer"), F.when(days <= 90, F.greatest(days, F.lit(0))).alias("days_until_breach"))
    return base.crossJoin(F.broadcast(hard))
