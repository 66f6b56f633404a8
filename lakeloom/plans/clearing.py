"""Queries over trades and settlement instructions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import clearing as op
from lakeloom.plans.registry import query, r

_DAYS = "GREATEST(settlement_date - trade_date, 0) // 86400"
_ERRORS = f"""list_filter([CASE WHEN status <> 'Pending' THEN 'INVALID_STATUS' END, CASE WHEN quantity = 0 THEN 'ZERO_QUANTITY' END, CASE WHEN price <= 0 THEN 'INVALID_PRICE' END,
 CASE WHEN buyer_id NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 6 <> 0) THEN 'BUYER_NOT_ELIGIBLE' END, CASE WHEN seller_id NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 6 <> 0) THEN 'SELLER_NOT_ELIGIBLE' END,
 CASE WHEN security_id NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#2') THEN 'SECURITY_NOT_ELIGIBLE' END, CASE WHEN settlement_date < trade_date THEN 'INVALID_SETTLEMENT_DATE' END,
 CASE WHEN {_DAYS} > 30 THEN 'SETTLEMENT_TOO_FAR' END, CASE WHEN ABS(quantity) > 40 THEN 'EXCEEDS_POSITION_LIMIT' END], lambda x: x IS NOT NULL)"""


def _validated(t, nation, part):
    parties = nation.where("n_nationkey % 6 <> 0").select(F.col("n_name").alias("party_id"))
    securities = part.where("p_brand <> 'Brand#2'").select(F.col("p_brand").alias("security_id")).distinct()
    return op.validate(t, parties, securities, part.select(F.col("p_brand").alias("security_id")).distinct().withColumn("max_quantity", F.lit(40)))


@query("clearing_validate", "clearing/validation", "trades nation part", f"SELECT id, len(e) = 0 AS is_valid, array_to_string(e, ',') AS errors, same_party FROM (SELECT id, {_ERRORS} AS e, buyer_id = seller_id AS same_party FROM trades)")
def _(t, nation, part):
    return _validated(t, nation, part).withColumn("errors", F.array_join("errors", ","))


@query("clearing_validation_stats", "clearing/validation", "trades nation part", f"""WITH v AS (SELECT {_ERRORS} AS e FROM trades)
SELECT code, COUNT(*) AS n FROM (SELECT unnest(e) AS code FROM v UNION ALL SELECT 'TOTAL' FROM v UNION ALL SELECT 'VALID' FROM v WHERE len(e) = 0) GROUP BY code""")  # fmt: skip
def _(t, nation, part):
    return op.validation_stats(_validated(t, nation, part))


_LEGS = """l AS (SELECT id, security_id, settlement_date, currency, buyer_id AS party_id, quantity AS q, -quantity * price AS pay FROM trades WHERE status IN ('Pending', 'Validated', 'Matched')
  UNION ALL SELECT id, security_id, settlement_date, currency, seller_id, -quantity, quantity * price FROM trades WHERE status IN ('Pending', 'Validated', 'Matched')),
p AS (SELECT party_id, security_id, settlement_date, currency, CAST(SUM(q) AS BIGINT) AS net_quantity, CAST(SUM(pay) AS BIGINT) AS net_payment, COUNT(DISTINCT id) AS n_trades FROM l GROUP BY ALL)"""


@query("clearing_net_positions", "clearing/netting", "trades", f"WITH {_LEGS} SELECT * FROM p")
def _(t):
    return op.net_positions(t)


@query("clearing_netting_summary", "clearing/netting", "trades", f"WITH {_LEGS}, g AS (SELECT COUNT(*) AS gross FROM trades WHERE status IN ('Pending', 'Validated', 'Matched')) SELECT gross, (SELECT COUNT(*) FROM p) AS net, ROUND(1 - (SELECT COUNT(*) FROM p) / (2 * gross), 8) AS efficiency FROM g")
def _(t):
    return op.netting_summary(t).select("gross", "net", r("efficiency", 8))


@query("clearing_party_summary", "clearing/netting", "trades", f"""WITH {_LEGS} SELECT party_id, CAST(SUM(GREATEST(net_quantity, 0)) AS BIGINT) AS gross_receipts, CAST(SUM(GREATEST(-net_quantity, 0)) AS BIGINT) AS gross_deliveries,
 CAST(SUM(net_quantity) AS BIGINT) AS net_position, CAST(SUM(-net_payment) AS BIGINT) AS gross_payments, CAST(SUM(net_payment) AS BIGINT) AS net_payment, CAST(SUM(n_trades) AS BIGINT) AS n_trades FROM p GROUP BY party_id""")  # fmt: skip
def _(t):
    return op.party_summary(t)


@query("clearing_bilateral_net", "clearing/netting", "trades", """SELECT COUNT(*) AS n_trades, CAST(SUM(CASE WHEN buyer_id = 'NATION_3' THEN quantity ELSE -quantity END) AS BIGINT) AS net_securities,
 CAST(SUM(CASE WHEN buyer_id = 'NATION_3' THEN -quantity * price ELSE quantity * price END) AS BIGINT) AS net_payment FROM trades
 WHERE (buyer_id = 'NATION_3' AND seller_id = 'NATION_7') OR (buyer_id = 'NATION_7' AND seller_id = 'NATION_3')""")  # fmt: skip
def _(t):
    return op.bilateral_net(t, "NATION_3", "NATION_7")


@query("clearing_netting_by_security", "clearing/netting", "trades", f"WITH {_LEGS} SELECT security_id, COUNT(*) AS positions, CAST(SUM(n_trades) AS BIGINT) AS n_trades, CAST(SUM(ABS(net_quantity)) AS BIGINT) AS net_quantity FROM p GROUP BY 1")
def _(t):
    return op.netting_by_security(t)


def _dvp(t):
    """Each trade as a delivery and, for most, a receipt that differs a little."""
    give = t.select((F.col("id") * 2).alias("id"), "security_id", "settlement_date", F.col("seller_id").alias("deliverer"), F.col("buyer_id").alias("receiver"), (-F.col("quantity")).alias("quantity"), (-F.col("quantity") * F.col("price")).alias("payment_amount"), "currency", "status")
    take = t.where("id % 7 <> 0").select((F.col("id") * 2 + 1).alias("id"), "security_id", "settlement_date", F.col("buyer_id").alias("deliverer"), F.col("seller_id").alias("receiver"), "quantity", (F.col("quantity") * F.col("price") + F.col("id") % 3).alias("payment_amount"), "currency", "status")
    return give.unionByName(take)


@query("clearing_match_dvp", "clearing/dvp-matching", "trades")
def _(t):
    return op.match_dvp(_dvp(t)).select("delivery_id", "receipt_id", r("confidence", 8))


@query("clearing_dvp_summary", "clearing/dvp-matching", "trades")
def _(t):
    legs = _dvp(t)
    return op.dvp_summary(legs, op.match_dvp(legs)).select("pairs", "securities", "payments", r("match_rate", 8))


def _execution(i, nation):
    parties = nation.select(F.col("n_name").alias("party_id"), (F.col("n_nationkey") % 9 == 0).alias("on_hold")).where("party_id <> 'NATION_5'")
    held = i.groupBy("party_id", "security_id").agg(F.max("quantity").alias("m")).select("party_id", "security_id", (F.col("m") - 5).alias("balance"))
    cash = nation.select(F.col("n_name").alias("party_id"), (F.lit(40000) + F.col("n_nationkey") * 1000).alias("cash"))
    return op.execute_settlement(i, parties, held, cash)


_EXEC = """held AS (SELECT party_id, security_id, MAX(quantity) - 5 AS balance FROM instructions GROUP BY 1, 2),
x AS (SELECT i.*, n_nationkey AS k, balance, i.party_id <> 'NATION_5' AS known FROM instructions i JOIN nation ON party_id = n_name JOIN held USING (party_id, security_id)),
y AS (SELECT id, party_id, payment_amount, status IN ('Settled', 'Failed') AS over, status AS s0, known, k % 9 = 0 AS hold,
  (instruction_type = 'Deliver' AND balance < quantity) OR (instruction_type = 'Pay' AND 40000 + k * 1000 < payment_amount) AS short,
  (instruction_type IN ('Deliver', 'Receive') AND quantity = 0) OR (instruction_type IN ('Pay', 'Collect') AND payment_amount = 0) AS zero FROM x),
z AS (SELECT id, party_id, payment_amount, CASE WHEN over THEN s0 WHEN NOT known THEN 'Failed' WHEN hold THEN 'OnHold' WHEN short THEN 'Partial' WHEN zero THEN 'Failed' ELSE 'Settled' END AS status,
  CASE WHEN over THEN NULL WHEN NOT known THEN 'ineligible' WHEN hold THEN 'hold' WHEN short THEN 'insufficient' WHEN zero THEN 'zero' END AS reason FROM y)"""


@query("clearing_execute_settlement", "clearing/settlement", "instructions nation", f"WITH {_EXEC} SELECT * FROM z")
def _(i, nation):
    return _execution(i, nation)


@query("clearing_settlement_totals", "clearing/settlement", "instructions nation", f"""WITH {_EXEC}, a AS (SELECT COUNT(*) FILTER (WHERE status = 'Settled') AS settled, COUNT(*) FILTER (WHERE status = 'Failed' AND reason IS NOT NULL) AS failed,
 COUNT(*) FILTER (WHERE status IN ('Pending', 'Partial', 'OnHold')) AS pending, CAST(COALESCE(SUM(payment_amount) FILTER (WHERE status = 'Settled'), 0) AS BIGINT) AS value_settled,
 CAST(COALESCE(SUM(payment_amount) FILTER (WHERE status = 'Failed' AND reason IS NOT NULL), 0) AS BIGINT) AS value_failed FROM z) SELECT *, ROUND(settled / (settled + failed + pending), 8) AS rate FROM a""")  # fmt: skip
def _(i, nation):
    return op.settlement_totals(_execution(i, nation)).withColumn("rate", r("rate", 8))


@query("clearing_party_settlement", "clearing/settlement", "instructions", """SELECT party_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'Settled') AS settled, COUNT(*) FILTER (WHERE status = 'Failed') AS failed,
 COUNT(*) FILTER (WHERE status = 'Pending') AS pending, COUNT(*) FILTER (WHERE status = 'Partial') AS partial, COUNT(*) FILTER (WHERE status = 'OnHold') AS on_hold,
 CAST(SUM(CASE WHEN instruction_type IN ('Deliver', 'Receive') THEN quantity ELSE 0 END) AS BIGINT) AS securities_volume, CAST(SUM(CASE WHEN instruction_type IN ('Pay', 'Collect') THEN payment_amount ELSE 0 END) AS BIGINT) AS cash_volume FROM instructions GROUP BY 1""")  # fmt: skip
def _(i):
    return op.party_settlement(i)


@query("clearing_prioritise", "clearing/settlement", "instructions", "SELECT id, payment_amount FROM instructions ORDER BY payment_amount DESC, id")
def _(i):
    return op.prioritise(i).select("id", "payment_amount")


def _activity(i):
    return i.groupBy("party_id", F.col("settlement_date").alias("day")).agg(F.sum(F.when(F.col("instruction_type").isin("Receive", "Collect"), F.col("quantity")).otherwise(-F.col("quantity"))).alias("eod_position"), F.max("quantity").alias("peak_position"), F.sum("quantity").alias("turnover"))


@query("clearing_zero_balance", "clearing/zero-balance", "instructions", """WITH a AS (SELECT party_id, settlement_date, SUM(CASE WHEN instruction_type IN ('Receive', 'Collect') THEN quantity ELSE -quantity END) AS eod, MAX(quantity) AS peak, SUM(quantity) AS turnover FROM instructions GROUP BY 1, 2)
 SELECT party_id, COUNT(*) AS days, COUNT(*) FILTER (WHERE eod = 0) AS zero_days, ROUND(AVG(CASE WHEN eod = 0 THEN 1 ELSE 0 END), 6) AS frequency, ROUND(AVG(eod), 6) AS avg_eod, MAX(peak) AS peak, ROUND(AVG(turnover), 6) AS avg_turnover FROM a GROUP BY 1""")  # fmt: skip
def _(i):
    return op.zero_balance(_activity(i)).select("party_id", "days", "zero_days", r("frequency", 6), r("avg_eod", 6), "peak", r("avg_turnover", 6))


@query("clearing_settlement_efficiency", "clearing/zero-balance", "instructions", """WITH x AS (SELECT *, id % 5 * 100 AS late, id % 4 <> 0 AS timed FROM instructions)
 SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'Settled' AND NOT (timed AND late > 0)) AS on_time, COUNT(*) FILTER (WHERE status = 'Settled' AND timed AND late > 0) AS late, COUNT(*) FILTER (WHERE status = 'Failed') AS failed,
 ROUND(AVG(late) FILTER (WHERE status = 'Settled' AND timed AND late > 0), 6) AS avg_delay, ROUND(COUNT(*) FILTER (WHERE status = 'Settled' AND NOT (timed AND late > 0)) / COUNT(*), 8) AS on_time_rate FROM x""")  # fmt: skip
def _(i):
    times = i.where("id % 4 <> 0").select("id", F.col("settlement_date").alias("expected"), (F.col("settlement_date") + F.col("id") % 5 * 100).alias("actual"))
    return op.settlement_efficiency(i, times).select("total", "on_time", "late", "failed", r("avg_delay", 6), r("on_time_rate", 8))


@query("clearing_settlement_velocity", "clearing/zero-balance", "instructions", "SELECT ROUND(COUNT(*) / 86400, 8) AS per_second, ROUND(SUM(payment_amount) / 86400, 6) AS value_per_second, ROUND(SUM(quantity) / 86400, 6) AS securities_per_second, ROUND(COUNT(*) / 86400 * 2, 8) AS peak FROM instructions WHERE status = 'Settled'")
def _(i):
    return op.settlement_velocity(i, 86400).select(r("per_second", 8), r("value_per_second", 6), r("securities_per_second", 6), r("peak", 8))


@query("clearing_score_parties", "clearing/zero-balance", "instructions", "SELECT party_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'Settled') AS settled, COUNT(*) FILTER (WHERE status = 'Failed') AS failed, COUNT(*) FILTER (WHERE status NOT IN ('Settled', 'Failed', 'Partial')) AS pending, ROUND(GREATEST((COUNT(*) FILTER (WHERE status = 'Settled') * 100 - COUNT(*) FILTER (WHERE status = 'Failed') * 50) / COUNT(*), 0), 6) AS score FROM instructions GROUP BY 1")
def _(i):
    return op.score_parties(i).withColumn("score", r("score", 6))


@query("clearing_liquidity_usage", "clearing/zero-balance", "instructions", "SELECT CAST(SUM(payment_amount) FILTER (WHERE status <> 'Failed') AS BIGINT) AS processed, CAST(SUM(payment_amount) FILTER (WHERE status = 'Settled') AS BIGINT) AS settled, ROUND(LEAST(SUM(payment_amount) FILTER (WHERE status <> 'Failed') / 5000000000, 1), 8) AS utilisation, ROUND(SUM(payment_amount) FILTER (WHERE status = 'Settled') / 5000000000, 8) AS turnover FROM instructions")
def _(i):
    return op.liquidity_usage(i, 5_000_000_000).select("processed", "settled", r("utilisation", 8), r("turnover", 8))
