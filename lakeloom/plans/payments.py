"""Queries over payments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import payments as op
from lakeloom.plans.registry import query, r

_FLOWS = "SELECT payer_account AS source, payee_account AS target, SUM(amount) AS volume, COUNT(*) AS n FROM payments WHERE status IN ('Completed', 'Processing') GROUP BY 1, 2"


@query("payments_build_flows", "payments/flow-analysis", "payments", f"SELECT source, target, ROUND(volume, 2) AS volume, n, ROUND(volume / n, 6) AS avg_amount FROM ({_FLOWS})")
def _(p):
    return op.build_flows(p).select("source", "target", r("volume", 2), "n", r("avg_amount", 6))


_NODES = """
n AS (SELECT payer_account AS node, 0.0 AS i, CASE WHEN status IN ('Completed', 'Processing') THEN amount ELSE 0 END AS o, 0 AS ni, CASE WHEN status IN ('Completed', 'Processing') THEN 1 ELSE 0 END AS no FROM payments
      UNION ALL SELECT payee_account, CASE WHEN status IN ('Completed', 'Processing') THEN amount ELSE 0 END, 0, CASE WHEN status IN ('Completed', 'Processing') THEN 1 ELSE 0 END, 0 FROM payments),
m AS (SELECT node, SUM(i) AS inflow, SUM(o) AS outflow, CAST(SUM(ni) AS BIGINT) AS inbound, CAST(SUM(no) AS BIGINT) AS outbound FROM n GROUP BY node)
"""


@query("payments_node_metrics", "payments/flow-analysis", "payments", f"""WITH {_NODES}
SELECT node, ROUND(inflow, 2) AS inflow, ROUND(outflow, 2) AS outflow, ROUND(inflow - outflow, 2) AS net, inbound, outbound,
  ROUND((inflow + outflow) / (2 * (SELECT SUM(outflow) FROM m)), 8) AS centrality FROM m""")  # fmt: skip
def _(p):
    return op.node_metrics(p).select("node", r("inflow", 2), r("outflow", 2), r("net", 2), "inbound", "outbound", r("centrality", 8))


@query("payments_overall_metrics", "payments/flow-analysis", "payments", """
WITH d AS (SELECT * FROM payments WHERE status IN ('Completed', 'Processing')),
h AS (SELECT initiated_at // 3600 % 24 AS hour, ROUND(SUM(amount), 2) AS v FROM d GROUP BY 1),
nodes AS (SELECT COUNT(*) AS k FROM (SELECT payer_account FROM payments UNION SELECT payee_account FROM payments))
SELECT ROUND(SUM(amount), 2) AS total_volume, COUNT(*) AS n, COUNT(DISTINCT payer_account) AS payers, COUNT(DISTINCT payee_account) AS payees, ROUND(SUM(amount) / COUNT(*), 4) AS avg_size,
  (SELECT hour FROM h ORDER BY v DESC, hour DESC LIMIT 1) AS peak_hour,
  ROUND(COUNT(DISTINCT payer_account || '>' || payee_account) / (SELECT k * (k - 1) FROM nodes), 8) AS density FROM d""")  # fmt: skip
def _(p):
    return op.overall_metrics(p).select(r("total_volume", 2), "n", "payers", "payees", r("avg_size"), "peak_hour", r("density", 8))


@query("payments_flow_anomalies", "payments/flow-analysis", "payments", f"""WITH f AS ({_FLOWS}), s AS (SELECT AVG(volume) AS mv, STDDEV_POP(volume) AS sv, AVG(n) AS mn FROM f), {_NODES}
SELECT 'UnusualVolume' AS kind, source || '->' || target AS entity, ROUND(LEAST((volume - mv) / sv / 10, 1), 4) AS severity FROM f, s WHERE volume > mv + 3 * sv
UNION ALL SELECT 'UnusualFrequency', source || '->' || target, ROUND(LEAST(n / mn / 5, 1), 4) FROM f, s WHERE n > mn * 5
UNION ALL SELECT 'CircularFlow', a.source || '<->' || a.target, 0.7 FROM f a JOIN f b ON a.source = b.target AND a.target = b.source WHERE a.source <= a.target
UNION ALL SELECT 'RapidMovement', node, ROUND(LEAST(inflow, outflow) / ((inflow + outflow) / 2), 4) FROM m WHERE inflow + outflow > 0 AND LEAST(inflow, outflow) / ((inflow + outflow) / 2) > 0.8 AND inbound >= 2 AND outbound >= 2""")  # fmt: skip
def _(p):
    return op.flow_anomalies(p).select("kind", "entity", r("severity"))


@query("payments_top_flows_by_volume", "payments/flow-analysis", "payments", f"SELECT source, target, ROUND(volume, 2) AS volume, n FROM ({_FLOWS}) q ORDER BY q.volume DESC, source, target LIMIT 20")
def _(p):
    return op.top_flows(p, 20).select("source", "target", r("volume", 2), "n")


@query("payments_top_flows_by_count", "payments/flow-analysis", "payments", f"SELECT source, target, ROUND(volume, 2) AS volume, n FROM ({_FLOWS}) q ORDER BY n DESC, source, target LIMIT 20")
def _(p):
    return op.top_flows(p, 20, "n").select("source", "target", r("volume", 2), "n")


@query("payments_account_flows", "payments/flow-analysis", "payments", """
SELECT ROUND(COALESCE(SUM(CASE WHEN payee_account = a THEN amount END), 0), 2) AS total_inbound, ROUND(COALESCE(SUM(CASE WHEN payer_account = a THEN amount END), 0), 2) AS total_outbound,
  COUNT(CASE WHEN payee_account = a THEN 1 END) AS inbound, COUNT(CASE WHEN payer_account = a THEN 1 END) AS outbound, COUNT(DISTINCT CASE WHEN payee_account = a THEN payer_account END) AS sources,
  COUNT(DISTINCT CASE WHEN payer_account = a THEN payee_account END) AS destinations,
  ROUND(COALESCE(SUM(CASE WHEN payee_account = a THEN amount END), 0) - COALESCE(SUM(CASE WHEN payer_account = a THEN amount END), 0), 2) AS net
FROM payments, (SELECT 'Supplier#000000007' AS a) WHERE payee_account = a OR payer_account = a""")  # fmt: skip
def _(p):
    return op.account_flows(p, "Supplier#000000007").select(r("total_inbound", 2), r("total_outbound", 2), "inbound", "outbound", "sources", "destinations", r("net", 2))


@query("payments_account_types", "payments/flow-analysis", "payments", "SELECT payment_type, COUNT(*) AS n, ROUND(SUM(amount), 2) AS amount FROM payments WHERE payee_account = 'Supplier#000000007' GROUP BY 1")
def _(p):
    return op.account_types(p, "Supplier#000000007").select("payment_type", "n", r("amount", 2))


_ERR = """CASE WHEN amount <= 0 THEN 'Invalid amount: must be positive' WHEN a.status IS NULL THEN 'Payer account not found' WHEN a.status <> 'Active' THEN 'Payer account is not active'
 WHEN a.available_balance < amount THEN 'Insufficient funds' WHEN a.daily_limit IS NOT NULL AND a.daily_used + amount > a.daily_limit THEN 'Daily limit exceeded'
 WHEN b.account_id IS NULL THEN 'Payee account not found' WHEN a.currency <> p.currency THEN 'Currency mismatch' WHEN amount < 0.01 THEN 'Amount below minimum' WHEN amount > 1000000 THEN 'Amount exceeds maximum' END"""
_JOINED = "payments p LEFT JOIN payment_accounts a ON p.payer_account = a.account_id LEFT JOIN payment_accounts b ON p.payee_account = b.account_id"
_OUT = f"""o AS (SELECT p.id, p.amount, p.priority, p.payment_type, p.initiated_at, {_ERR} AS err FROM {_JOINED}),
q AS (SELECT *, CASE WHEN amount > 50000 THEN 'Velocity check failed' WHEN payment_type = 'RealTime' AND amount > 50000 THEN 'Large payment requires manual review' END AS fraud,
  payment_type NOT IN ('RealTime', 'Internal') AND NOT ((initiated_at // 86400 + 4) % 7 BETWEEN 1 AND 5 AND initiated_at % 86400 // 3600 BETWEEN 9 AND 16) AS waits FROM o),
z AS (SELECT id, amount, priority, CASE WHEN err IS NOT NULL THEN 'Failed' WHEN waits THEN 'Pending' WHEN fraud IS NOT NULL THEN 'Failed' ELSE 'Processed' END AS outcome,
  CASE WHEN err IS NOT NULL THEN err WHEN waits THEN NULL ELSE fraud END AS reason FROM q)"""
_CONFIG = op.ProcessingConfig(velocity_limit=5000.0, outside_hours=False)


@query("payments_process", "payments/processing", "payments payment_accounts", f"WITH {_OUT} SELECT id, ROUND(amount, 2) AS amount, priority, outcome, reason FROM z")
def _(p, a):
    return op.process_payments(p, a, _CONFIG).select("id", r("amount", 2), "priority", "outcome", "reason")


@query("payments_process_by_priority", "payments/processing", "payments payment_accounts", f"""WITH {_OUT} SELECT priority, COUNT(*) AS total, COUNT(*) FILTER (WHERE outcome = 'Processed') AS processed, COUNT(*) FILTER (WHERE outcome = 'Failed') AS failed,
  COUNT(*) FILTER (WHERE outcome = 'Pending') AS pending, ROUND(COALESCE(SUM(amount) FILTER (WHERE outcome = 'Processed'), 0), 2) AS processed_amount, ROUND(COALESCE(SUM(amount) FILTER (WHERE outcome = 'Failed'), 0), 2) AS failed_amount FROM z GROUP BY priority""")  # fmt: skip
def _(p, a):
    return op.process_by_priority(p, a, _CONFIG).select("priority", "total", "processed", "failed", "pending", r("processed_amount", 2), r("failed_amount", 2))


@query("payments_validate_only", "payments/processing", "payments payment_accounts", f"""SELECT id, err IS NULL AS is_valid, err AS error, warnings FROM (SELECT p.id, {_ERR} AS err,
  CONCAT_WS(',', CASE WHEN amount > 5000 THEN 'LARGE_AMOUNT' END, CASE WHEN payment_type = 'Check' THEN 'SLOW_PAYMENT' END) AS warnings FROM {_JOINED})""")  # fmt: skip
def _(p, a):
    return op.validate_only(p, a)


@query("payments_routing", "payments/processing", "payments", """
SELECT id, CASE payment_type WHEN 'RealTime' THEN 'RTP' WHEN 'Wire' THEN 'FEDWIRE' WHEN 'ACH' THEN 'ACH' WHEN 'Internal' THEN 'INTERNAL' WHEN 'Check' THEN 'CHECK' ELSE 'CARD_NETWORK' END AS rail,
  CAST(CASE payment_type WHEN 'RealTime' THEN 0 WHEN 'Internal' THEN 0 WHEN 'Wire' THEN CASE WHEN priority IN ('High', 'Urgent') THEN 0 ELSE 1 END WHEN 'ACH' THEN 2 WHEN 'Check' THEN 5 ELSE 1 END AS BIGINT) AS settlement_days,
  amount > 10000 OR priority = 'Urgent' AS requires_approval,
  ROUND(CASE payment_type WHEN 'RealTime' THEN 0.5 WHEN 'Wire' THEN CASE WHEN priority = 'Urgent' THEN 25 ELSE 15 END WHEN 'ACH' THEN amount * 0.001 WHEN 'Internal' THEN 0 WHEN 'Check' THEN 1 ELSE amount * 0.029 + 0.3 END, 6) AS fees FROM payments""")  # fmt: skip
def _(p):
    return op.routing(p).select("id", "rail", "settlement_days", "requires_approval", r("fees", 6))


del F
