"""Payment processing and payment flow analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

TYPES = ("ACH", "Wire", "RealTime", "Internal", "Check", "Card")
PRIORITIES = ("Low", "Normal", "High", "Urgent")


@dataclass(frozen=True)
class ProcessingConfig:
    enabled_types: tuple[str, ...] = TYPES
    min_amount: float | None = 0.01
    max_amount: float | None = 1_000_000.0
    fraud_check: bool = True
    velocity_limit: float | None = 100.0
    large_payment: float | None = 50_000.0
    outside_hours: bool = True
    batch_mode: bool = False
    open_hour: int = 9
    close_hour: int = 17
    offset_seconds: int = 0


def first_error(checks: list[tuple[Column, str]]) -> Column:
    """The text of the first check that holds, else null."""
    out = F.lit(None).cast("string")
    for test, text in reversed(checks):
        out = F.when(test, F.lit(text)).otherwise(out)
    return out


def in_window(config: ProcessingConfig, ts: str = "initiated_at") -> Column:
    """Monday to Friday within business hours; real-time and internal payments always."""
    if config.outside_hours:
        return F.lit(True)
    at = F.col(ts) + config.offset_seconds
    day, hour = (F.floor(at / 86400) + 4) % 7, F.floor((at % 86400) / 3600)
    return F.col("payment_type").isin("RealTime", "Internal") | (day.between(1, 5) & (hour >= config.open_hour) & (hour < config.close_hour))


def with_accounts(payments: DataFrame, accounts: DataFrame) -> DataFrame:
    """Payments with the payer's account (p_*) and whether the payee's exists."""
    payer = accounts.select(F.col("account_id").alias("payer_account"), *[F.col(c).alias(f"p_{c}") for c in ("available_balance", "currency", "status", "daily_limit", "daily_used")])
    payee = accounts.select(F.col("account_id").alias("payee_account"), F.lit(True).alias("payee_known"))
    return payments.join(payer, "payer_account", "left").join(payee, "payee_account", "left")


def validation_error(config: ProcessingConfig) -> Column:
    """The first failed validation of a row of with_accounts.  Balances are those given: one payment
    does not lower them for the next."""
    amount = F.col("amount")
    checks = [
        (amount <= 0, "Invalid amount: must be positive"),
        (F.col("p_status").isNull(), "Payer account not found"),
        (F.col("p_status") != "Active", "Payer account is not active"),
        (F.col("p_available_balance") < amount, "Insufficient funds"),
        (F.col("p_daily_limit").isNotNull() & (F.col("p_daily_used") + amount > F.col("p_daily_limit")), "Daily limit exceeded"),
        (F.col("payee_known").isNull(), "Payee account not found"),
        (F.col("p_currency") != F.col("currency"), "Currency mismatch"),
    ]
    if config.min_amount is not None:
        checks.append((amount < config.min_amount, "Amount below minimum"))
    if config.max_amount is not None:
        checks.append((amount > config.max_amount, "Amount exceeds maximum"))
    return first_error(checks)


def fraud_error(config: ProcessingConfig) -> Column:
    """Amounts over ten times the velocity limit, and large real-time payments."""
    checks = []
    if config.velocity_limit is not None:
        checks.append((F.col("amount") > config.velocity_limit * 10, "Velocity check failed"))
    if config.large_payment is not None:
        checks.append(((F.col("payment_type") == "RealTime") & (F.col("amount") > config.large_payment), "Large payment requires manual review"))
    return first_error(checks)


def process_payments(payments: DataFrame, accounts: DataFrame, config: ProcessingConfig = ProcessingConfig()) -> DataFrame:
    """id, amount, priority, outcome (Processed, Pending or Failed) and reason of each payment."""
    df = with_accounts(payments, accounts)
    reason = F.coalesce(validation_error(config), first_error([(~F.col("payment_type").isin(*config.enabled_types), "Payment type not enabled")]))
    waits = ~in_window(config)
    fraud = fraud_error(config) if config.fraud_check else F.lit(None).cast("string")
    done = "Pending" if config.batch_mode else "Processed"
    df = df.withColumn("_v", reason).withColumn("_f", fraud)
    outcome = F.when(F.col("_v").isNotNull(), "Failed").when(waits, "Pending").when(F.col("_f").isNotNull(), "Failed").otherwise(done)
    why = F.when(F.col("_v").isNotNull(), F.col("_v")).when(waits, None).otherwise(F.col("_f"))
    return df.select("id", "amount", "priority", outcome.alias("outcome"), why.alias("reason"))


def processing_stats(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts and amounts of process_payments' rows, by the given columns."""
    done, failed = F.col("outcome") == "Processed", F.col("outcome") == "Failed"
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(done, 1)).alias("processed"),
        F.count(F.when(failed, 1)).alias("failed"),
        F.count(F.when(F.col("outcome") == "Pending", 1)).alias("pending"),
        F.coalesce(F.sum(F.when(done, F.col("amount"))), F.lit(0.0)).alias("processed_amount"),
        F.coalesce(F.sum(F.when(failed, F.col("amount"))), F.lit(0.0)).alias("failed_amount"),
    )


def process_by_priority(payments: DataFrame, accounts: DataFrame, config: ProcessingConfig = ProcessingConfig()) -> DataFrame:
    return processing_stats(process_payments(payments, accounts, config), "priority")


def validate_only(payments: DataFrame, accounts: DataFrame, config: ProcessingConfig = ProcessingConfig()) -> DataFrame:
    """id, is_valid, error and warnings (comma-joined codes)."""
    warn = F.concat_ws(",", F.when(F.col("amount") > 5000, "LARGE_AMOUNT"), F.when(F.col("payment_type") == "Check", "SLOW_PAYMENT"))
    error = validation_error(config)
    return with_accounts(payments, accounts).select("id", error.isNull().alias("is_valid"), error.alias("error"), warn.alias("warnings"))


def _urgency() -> Column:
    return F.element_at(F.create_map(*[x for i, p in enumerate(PRIORITIES) for x in (F.lit(p), F.lit(i))]), F.col("priority"))


def fees() -> Column:
    kind, amount = F.col("payment_type"), F.col("amount")
    return F.when(kind == "RealTime", 0.5).when(kind == "Wire", F.when(_urgency() >= 3, 25.0).otherwise(15.0)).when(kind == "ACH", amount * 0.001).when(kind == "Internal", 0.0).when(kind == "Check", 1.0).otherwise(amount * 0.029 + 0.3)


def routing(payments: DataFrame) -> DataFrame:
    """id, rail, settlement_days, requires_approval and fees."""
    kind = F.col("payment_type")
    rail = F.when(kind == "RealTime", "RTP").when(kind == "Wire", "FEDWIRE").when(kind == "ACH", "ACH").when(kind == "Internal", "INTERNAL").when(kind == "Check", "CHECK").otherwise("CARD_NETWORK")
    days = F.when(kind.isin("RealTime", "Internal"), 0).when(kind == "Wire", F.when(_urgency() >= 2, 0).otherwise(1)).when(kind == "ACH", 2).when(kind == "Check", 5).otherwise(1)
    return payments.select("id", rail.alias("rail"), days.cast("long").alias("settlement_days"), ((F.col("amount") > 10000) | (_urgency() >= 3)).alias("requires_approval"), fees().alias("fees"))


def settled(payments: DataFrame) -> DataFrame:
    return payments.where(F.col("status").isin("Completed", "Processing"))


def build_flows(payments: DataFrame) -> DataFrame:
    """source, target, volume, n, avg_amount of completed and processing payments."""
    return settled(payments).groupBy(F.col("payer_account").alias("source"), F.col("payee_account").alias("target")).agg(F.sum("amount").alias("volume"), F.count(F.lit(1)).alias("n"), F.avg("amount").alias("avg_amount"))


def node_metrics(payments: DataFrame) -> DataFrame:
    """Flows in and out of every account of any payment, and its share of all flow.  One pass: a
    payment is two signed rows, so there is no join back to the accounts."""
    counts = F.when(F.col("status").isin("Completed", "Processing"), 1).otherwise(0)
    amount = F.when(counts == 1, F.col("amount")).otherwise(0.0)
    side = F.explode(F.array(F.struct(F.col("payer_account").alias("node"), F.lit(0.0).alias("i"), amount.alias("o"), F.lit(0).alias("ni"), counts.alias("no")), F.struct(F.col("payee_account").alias("node"), amount.alias("i"), F.lit(0.0).alias("o"), counts.alias("ni"), F.lit(0).alias("no"))))
    per = payments.select(side.alias("s")).groupBy(F.col("s.node").alias("node")).agg(F.sum("s.i").alias("inflow"), F.sum("s.o").alias("outflow"), F.sum("s.ni").alias("inbound"), F.sum("s.no").alias("outbound"))
    total = settled(payments).agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))
    share = F.when(F.col("total") > 0, (F.col("inflow") + F.col("outflow")) / (2 * F.col("total"))).otherwise(0.0)
    return per.crossJoin(F.broadcast(total)).select("node", "inflow", "outflow", (F.col("inflow") - F.col("outflow")).alias("net"), "inbound", "outbound", share.alias("centrality"))


def overall_metrics(payments: DataFrame) -> DataFrame:
    """One row: totals, distinct parties, peak hour (the later of equals) and density."""
    done = settled(payments)
    hours = done.groupBy((F.floor(F.col("initiated_at") / 3600) % 24).alias("hour")).agg(F.sum("amount").alias("v")).agg(F.max(F.struct(F.round("v", 2).alias("v"), "hour"))["hour"].alias("peak_hour"))
    totals = done.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_volume"), F.count(F.lit(1)).alias("n"), F.count_distinct("payer_account").alias("payers"), F.count_distinct("payee_account").alias("payees"), F.count_distinct(F.struct("payer_account", "payee_account")).alias("pairs"))
    nodes = payments.select(F.explode(F.array("payer_account", "payee_account")).alias("a")).agg(F.count_distinct("a").alias("nodes"))
    avg = F.when(F.col("n") > 0, F.col("total_volume") / F.col("n")).otherwise(0.0)
    density = F.col("pairs") / F.when(F.col("nodes") > 1, F.col("nodes") * (F.col("nodes") - 1)).otherwise(1)
    one = totals.crossJoin(F.broadcast(nodes)).crossJoin(F.broadcast(hours))
    return one.select("total_volume", "n", "payers", "payees", avg.alias("avg_size"), "peak_hour", density.alias("density"))


def flow_anomalies(payments: DataFrame, volume_sd: float = 3.0, count_multiple: float = 5.0) -> DataFrame:
    """kind, entity, severity: unusual volumes and counts of flows, pairs that pay one another, and
    accounts that money passes through."""
    flows = build_flows(payments)
    stats = F.broadcast(flows.agg(F.avg("volume").alias("mv"), F.stddev_pop("volume").alias("sv"), F.avg("n").alias("mn")))
    scored = flows.crossJoin(stats)
    pair = F.concat("source", F.lit("->"), "target")
    volume = scored.where(F.col("volume") > F.col("mv") + volume_sd * F.col("sv")).select(F.lit("UnusualVolume").alias("kind"), pair.alias("entity"), F.least((F.col("volume") - F.col("mv")) / F.col("sv") / 10, F.lit(1.0)).alias("severity"))
    often = scored.where(F.col("n") > F.col("mn") * count_multiple).select(F.lit("UnusualFrequency").alias("kind"), pair.alias("entity"), F.least(F.col("n") / F.col("mn") / 5, F.lit(1.0)).alias("severity"))
    low, high = F.least("source", "target"), F.greatest("source", "target")
    both = flows.groupBy(low.alias("a"), high.alias("b")).agg(F.count(F.lit(1)).alias("k")).where((F.col("k") > 1) | (F.col("a") == F.col("b")))
    circular = both.select(F.lit("CircularFlow").alias("kind"), F.concat("a", F.lit("<->"), "b").alias("entity"), F.lit(0.7).alias("severity"))
    through = F.least("inflow", "outflow") / ((F.col("inflow") + F.col("outflow")) / 2)
    nodes = node_metrics(payments).where((F.col("inflow") + F.col("outflow") > 0) & (through > 0.8) & (F.col("inbound") >= 2) & (F.col("outbound") >= 2))
    rapid = nodes.select(F.lit("RapidMovement").alias("kind"), F.col("node").alias("entity"), through.alias("severity"))
    return volume.unionByName(often).unionByName(circular).unionByName(rapid)


def top_flows(payments: DataFrame, limit: int, by: str = "volume") -> DataFrame:
    """The largest flows by volume or n, ties by source and target."""
    return build_flows(payments).orderBy(F.col(by).desc(), "source", "target").limit(limit)


def account_flows(payments: DataFrame, account: str) -> DataFrame:
    """One row for an account over payments of any status."""
    to, out = F.col("payee_account") == account, F.col("payer_account") == account
    zero = F.lit(0.0)
    a = payments.where(to | out).agg(
        F.coalesce(F.sum(F.when(to, F.col("amount"))), zero).alias("total_inbound"), F.coalesce(F.sum(F.when(out, F.col("amount"))), zero).alias("total_outbound"),
        F.count(F.when(to, 1)).alias("inbound"), F.count(F.when(out, 1)).alias("outbound"),
        F.count_distinct(F.when(to, F.col("payer_account"))).alias("sources"), F.count_distinct(F.when(out, F.col("payee_account"))).alias("destinations"),
    )
    return a.withColumn("net", F.col("total_inbound") - F.col("total_outbound"))


def account_types(payments: DataFrame, account: str) -> DataFrame:
    """payment_type, n, amount of an account's payments; one to itself counts twice."""
    sides = F.explode(F.array("payee_account", "payer_account")).alias("side")
    return payments.select("payment_type", "amount", sides).where(F.col("side") == account).groupBy("payment_type").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
