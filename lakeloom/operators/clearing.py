"""Trade validation, DVP matching, netting, settlement and settlement efficiency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakeloom.operators.groupmap import ordered_groups

DAY = 86400


def validate(trades: DataFrame, parties: DataFrame, securities: DataFrame, limits: DataFrame | None = None, min_days: int = 0, max_days: int = 30) -> DataFrame:
    """id, is_valid, errors (codes in order) and same_party.  parties(party_id), securities(security_id)
    and limits(security_id, max_quantity) are small reference tables."""
    known = securities.select("security_id", F.lit(True).alias("sec_ok"))
    buyers, sellers = (parties.select(F.col("party_id").alias(f"{s}_id"), F.lit(True).alias(f"{s}_ok")) for s in ("buyer", "seller"))
    df = trades.join(buyers, "buyer_id", "left").join(sellers, "seller_id", "left").join(known, "security_id", "left")
    df = df.join(limits, "security_id", "left") if limits is not None else df.withColumn("max_quantity", F.lit(None).cast("long"))
    days = F.floor(F.greatest(F.col("settlement_date") - F.col("trade_date"), F.lit(0)) / DAY)
    checks = [
        (F.col("status") != "Pending", "INVALID_STATUS"), (F.col("quantity") == 0, "ZERO_QUANTITY"), (F.col("price") <= 0, "INVALID_PRICE"),
        (F.col("buyer_ok").isNull(), "BUYER_NOT_ELIGIBLE"), (F.col("seller_ok").isNull(), "SELLER_NOT_ELIGIBLE"), (F.col("sec_ok").isNull(), "SECURITY_NOT_ELIGIBLE"),
        (F.col("settlement_date") < F.col("trade_date"), "INVALID_SETTLEMENT_DATE"), (days < min_days, "SETTLEMENT_TOO_SOON"), (days > max_days, "SETTLEMENT_TOO_FAR"),
        (F.abs("quantity") > F.col("max_quantity"), "EXCEEDS_POSITION_LIMIT"),
    ]
    errors = F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in checks]))
    return df.select("id", (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), (F.col("buyer_id") == F.col("seller_id")).alias("same_party"))


def validation_stats(results: DataFrame) -> DataFrame:
    """code and n: how often each error occurs; codes TOTAL and VALID count trades."""
    totals = results.select(F.explode(F.array(F.lit("TOTAL"), F.when(F.col("is_valid"), F.lit("VALID")))).alias("code")).where("code IS NOT NULL")
    return results.select(F.explode("errors").alias("code")).unionByName(totals).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _legs(trades: DataFrame) -> DataFrame:
    """The buyer's and the seller's side of each trade."""
    value = F.col("quantity") * F.col("price")

    def leg(party: str, sign: int) -> Column:
        return F.struct(F.col(party).alias("party_id"), (sign * F.col("quantity")).alias("q"), (-sign * value).alias("pay"))

    return trades.withColumn("leg", F.explode(F.array(leg("buyer_id", 1), leg("seller_id", -1)))).select("id", "security_id", "settlement_date", "currency", "leg.party_id", "leg.q", "leg.pay")


def net_positions(trades: DataFrame, by: tuple[str, ...] = ("security_id", "settlement_date", "currency"), include_failed: bool = False) -> DataFrame:
    """Net quantity and payment of each party by the chosen keys, and its number of trades."""
    live = trades if include_failed else trades.where(F.col("status").isin("Pending", "Validated", "Matched"))
    return _legs(live).groupBy("party_id", *by).agg(F.sum("q").alias("net_quantity"), F.sum("pay").alias("net_payment"), F.count_distinct("id").alias("n_trades"))


def netting_summary(trades: DataFrame, by: tuple[str, ...] = ("security_id", "settlement_date", "currency")) -> DataFrame:
    """One row: gross trades, net instructions and 1 - net / (2 gross)."""
    live = trades.where(F.col("status").isin("Pending", "Validated", "Matched")).agg(F.count(F.lit(1)).alias("gross"))
    net = net_positions(trades, by).agg(F.count(F.lit(1)).alias("net"))
    return live.crossJoin(F.broadcast(net)).select("gross", "net", F.when(F.col("gross") > 0, 1 - F.col("net") / (2 * F.col("gross"))).otherwise(0.0).alias("efficiency"))


def party_summary(trades: DataFrame, by: tuple[str, ...] = ("security_id", "settlement_date", "currency")) -> DataFrame:
    q, pay = F.col("net_quantity"), F.col("net_payment")
    return net_positions(trades, by).groupBy("party_id").agg(
        F.sum(F.greatest(q, F.lit(0))).alias("gross_receipts"), F.sum(F.greatest(-q, F.lit(0))).alias("gross_deliveries"), F.sum(q).alias("net_position"),
        F.sum(-pay).alias("gross_payments"), F.sum(pay).alias("net_payment"), F.sum("n_trades").alias("n_trades"),
    )


def bilateral_net(trades: DataFrame, a: str, b: str) -> DataFrame:
    """One row: what party a nets with party b."""
    buys = F.col("buyer_id") == a
    both = trades.where((buys & (F.col("seller_id") == b)) | ((F.col("buyer_id") == b) & (F.col("seller_id") == a)))
    sign, value = F.when(buys, 1).otherwise(-1), F.col("quantity") * F.col("price")
    return both.agg(F.count(F.lit(1)).alias("n_trades"), F.coalesce(F.sum(sign * F.col("quantity")), F.lit(0)).alias("net_securities"), F.coalesce(F.sum(-sign * value), F.lit(0)).alias("net_payment"))


def netting_by_security(trades: DataFrame, by: tuple[str, ...] = ("security_id", "settlement_date", "currency")) -> DataFrame:
    return net_positions(trades, by).groupBy("security_id").agg(F.count(F.lit(1)).alias("positions"), F.sum("n_trades").alias("n_trades"), F.sum(F.abs("net_quantity")).alias("net_quantity"))


def match_dvp(instructions: DataFrame, min_confidence: float = 0.8, quantity_tolerance: float = 0.01, amount_tolerance: float = 0.01, strict: bool = True) -> DataFrame:
    """delivery_id, receipt_id and confidence of matched instructions(id, security_id,
    settlement_date, deliverer, receiver, quantity, payment_amount, currency, status).

    Pending deliveries (negative quantities) of a security and day are matched in id order, each to
    the free receipt with the highest score (ties by id).  With ``strict`` parties the groups are
    those of the parties too, so a busy security is many small groups."""
    pending = instructions.where("status = 'Pending' AND quantity <> 0")
    delivers = F.col("quantity") < 0
    keys = ["security_id", "settlement_date"]
    df = pending.withColumn("gives", F.when(delivers, F.col("deliverer")).otherwise(F.col("receiver"))).withColumn("takes", F.when(delivers, F.col("receiver")).otherwise(F.col("deliverer")))
    if strict:
        keys += ["gives", "takes", "currency"]

    def group(_: tuple, rows: list[dict]) -> list[tuple]:
        out, free = [], [x for x in rows if x["quantity"] > 0]
        for d in (x for x in rows if x["quantity"] < 0):
            best = None
            for j, x in enumerate(free):
                if d["currency"] != x["currency"]:
                    continue
                score = (1.0 if d["gives"] == x["gives"] else 0.5) * (1.0 if d["takes"] == x["takes"] else 0.5)
                for what, tolerance in (("quantity", quantity_tolerance), ("payment_amount", amount_tolerance)):
                    mine, theirs = abs(d[what]), abs(x[what])
                    off = abs(mine - theirs) / max(mine, theirs, 1)
                    score = 0.0 if off > tolerance else score * (1 - off)
                if score >= min_confidence and (best is None or score > best[1]):
                    best = j, score
            if best:
                out.append((d["id"], free.pop(best[0])["id"], best[1]))
        return out

    return ordered_groups(df, keys, ["id"], group, "delivery_id long, receipt_id long, confidence double")


def dvp_summary(instructions: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: pairs settled, their securities and payments, and the share of pending matched."""
    done = matches.join(instructions.select(F.col("id").alias("delivery_id"), "quantity", "payment_amount"), "delivery_id")
    sums = done.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum(F.abs("quantity")), F.lit(0)).alias("securities"), F.coalesce(F.sum(F.abs("payment_amount")), F.lit(0)).alias("payments"))
    pending = instructions.agg(F.count(F.when(F.col("status") == "Pending", 1)).alias("pending"))
    return sums.crossJoin(F.broadcast(pending)).select("pairs", "securities", "payments", F.when(F.col("pending") > 0, 2 * F.col("pairs") / F.col("pending")).otherwise(0.0).alias("match_rate"))


def execute_settlement(instructions: DataFrame, parties: DataFrame, security_balances: DataFrame, cash_balances: DataFrame, allow_partial: bool = True, fail_on_error: bool = True) -> DataFrame:
    """id, status and reason after a settlement run.  parties(party_id, on_hold),
    security_balances(party_id, security_id, balance), cash_balances(party_id, cash).  Balances are not
    lowered by what settles."""
    df = instructions.join(parties, "party_id", "left").join(security_balances, ["party_id", "security_id"], "left").join(cash_balances, "party_id", "left")
    kind, q, pay = F.col("instruction_type"), F.abs("quantity"), F.abs("payment_amount")
    short = ((kind == "Deliver") & (F.coalesce("balance", F.lit(0)) < q)) | ((kind == "Pay") & (F.coalesce("cash", F.lit(0)) < pay))
    zero = (kind.isin("Deliver", "Receive") & (q == 0)) | (kind.isin("Pay", "Collect") & (pay == 0))
    over = F.col("status").isin("Settled", "Failed")
    reason = F.when(over, None).when(F.col("on_hold").isNull(), "ineligible").when(F.col("on_hold"), "hold").when(short, "insufficient").when(zero, "zero")
    status = (
        F.when(over, F.col("status")).when(F.col("on_hold").isNull(), "Failed").when(F.col("on_hold"), "OnHold")
        .when(short, "Partial" if allow_partial else "Failed").when(zero, "Failed" if fail_on_error else "Pending").otherwise("Settled")
    )
    return df.select("id", "party_id", "payment_amount", status.alias("status"), reason.alias("reason"))


def settlement_totals(executed: DataFrame) -> DataFrame:
    """One row: counts by outcome, the settled share and values."""
    s, v = F.col("status"), F.abs("payment_amount")
    out = executed.agg(
        F.count(F.when(s == "Settled", 1)).alias("settled"), F.count(F.when((s == "Failed") & F.col("reason").isNotNull(), 1)).alias("failed"), F.count(F.when(s.isin("Pending", "Partial", "OnHold"), 1)).alias("pending"),
        F.coalesce(F.sum(F.when(s == "Settled", v)), F.lit(0)).alias("value_settled"), F.coalesce(F.sum(F.when((s == "Failed") & F.col("reason").isNotNull(), v)), F.lit(0)).alias("value_failed"),
    )
    total = F.col("settled") + F.col("failed") + F.col("pending")
    return out.withColumn("rate", F.when(total > 0, F.col("settled") / total).otherwise(0.0))


def party_settlement(instructions: DataFrame) -> DataFrame:
    s, kind = F.col("status"), F.col("instruction_type")
    return instructions.groupBy("party_id").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(s == "Settled", 1)).alias("settled"), F.count(F.when(s == "Failed", 1)).alias("failed"),
        F.count(F.when(s.isin("Pending", "InProgress"), 1)).alias("pending"), F.count(F.when(s == "Partial", 1)).alias("partial"), F.count(F.when(s == "OnHold", 1)).alias("on_hold"),
        F.sum(F.when(kind.isin("Deliver", "Receive"), F.abs("quantity")).otherwise(0)).alias("securities_volume"), F.sum(F.when(kind.isin("Pay", "Collect"), F.abs("payment_amount")).otherwise(0)).alias("cash_volume"),
    )


def prioritise(instructions: DataFrame, order: str = "value_desc") -> DataFrame:
    """Instructions in processing order; ties by id."""
    by = {"value_desc": F.abs("payment_amount").desc(), "value_asc": F.abs("payment_amount").asc(), "date": F.col("settlement_date").asc(), "fifo": F.col("id").asc()}[order]
    return instructions.orderBy(by, "id")


def zero_balance(activity: DataFrame) -> DataFrame:
    """Per party of activity(party_id, day, eod_position, peak_position, turnover)."""
    return activity.groupBy("party_id").agg(
        F.count(F.lit(1)).alias("days"), F.count(F.when(F.col("eod_position") == 0, 1)).alias("zero_days"), F.avg(F.when(F.col("eod_position") == 0, 1.0).otherwise(0.0)).alias("frequency"),
        F.avg("eod_position").alias("avg_eod"), F.max("peak_position").alias("peak"), F.avg("turnover").alias("avg_turnover"),
    )


def settlement_efficiency(instructions: DataFrame, times: DataFrame) -> DataFrame:
    """One row; times(id, expected, actual).  Settled without times counts as on time."""
    df = instructions.join(times, "id", "left")
    done, late = F.col("status") == "Settled", F.col("actual") > F.col("expected")
    late = F.coalesce(late, F.lit(False))
    out = df.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(done & ~late, 1)).alias("on_time"), F.count(F.when(done & late, 1)).alias("late"), F.count(F.when(F.col("status") == "Failed", 1)).alias("failed"),
        F.coalesce(F.avg(F.when(done & late, F.col("actual") - F.col("expected"))), F.lit(0.0)).alias("avg_delay"),
    )
    return out.withColumn("on_time_rate", F.when(F.col("total") > 0, F.col("on_time") / F.col("total")).otherwise(0.0))


def settlement_velocity(instructions: DataFrame, seconds: int) -> DataFrame:
    """Settled instructions, value and securities per second; the peak is taken as twice the mean."""
    s = instructions.where("status = 'Settled'").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.abs("payment_amount")), F.lit(0)).alias("v"), F.coalesce(F.sum(F.abs("quantity")), F.lit(0)).alias("q"))
    per = [(F.col(c) / seconds if seconds else F.lit(0.0)).alias(a) for c, a in (("n", "per_second"), ("v", "value_per_second"), ("q", "securities_per_second"))]
    return s.select(*per).withColumn("peak", F.col("per_second") * 2)


def score_parties(instructions: DataFrame) -> DataFrame:
    """max(0, 100 settled share - 50 failed share) of each party."""
    s = F.col("status")
    g = instructions.groupBy("party_id").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(s == "Settled", 1)).alias("settled"), F.count(F.when(s == "Failed", 1)).alias("failed"), F.count(F.when(~s.isin("Settled", "Failed", "Partial"), 1)).alias("pending"))
    return g.withColumn("score", F.greatest((F.col("settled") * 100 - F.col("failed") * 50) / F.col("total"), F.lit(0.0)))


def liquidity_usage(instructions: DataFrame, available: int) -> DataFrame:
    v, s = F.abs("payment_amount"), F.col("status")
    out = instructions.agg(F.coalesce(F.sum(F.when(s != "Failed", v)), F.lit(0)).alias("processed"), F.coalesce(F.sum(F.when(s == "Settled", v)), F.lit(0)).alias("settled"))
    if available <= 0:
        return out.withColumn("utilisation", F.lit(0.0)).withColumn("turnover", F.lit(0.0))
    return out.withColumn("utilisation", F.least(F.col("processed") / available, F.lit(1.0))).withColumn("turnover", F.col("settled") / available)
