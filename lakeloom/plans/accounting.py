"""Queries over accounts and journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import accounting as op
from lakeloom.plans.registry import query, r

_ACC = "acc AS (SELECT DISTINCT account_code FROM journal)"
_RULES = [(1, "1*", "ASSETS", 1, None), (2, "110*", None, 5, [("CASH", 0.6), ("BANK", 0.4)]), (3, "4*", "INCOME", 1, None), (4, "2*5", "TRADE", 3, None), (5, "", "X", 0, None), (6, "9*", None, 0, [("Y", 0.5)])]


def _rules(j):
    return j.sparkSession.createDataFrame(_RULES, "rule_id int, pattern string, target string, priority int, splits array<struct<target:string,ratio:double>>")


def _accounts(j):
    return j.select("account_code").distinct()


def _mapping(j):
    return op.map_accounts(_accounts(j), _rules(j), "MISC")


_MAP = f"""{_ACC}, b AS (SELECT account_code, CASE WHEN account_code LIKE '110%' THEN 2 WHEN account_code LIKE '2%5' THEN 4 WHEN account_code LIKE '1%' THEN 1 WHEN account_code LIKE '4%' THEN 3 ELSE 0 END AS rule_id FROM acc),
m AS (SELECT account_code, rule_id, unnest(CASE rule_id WHEN 2 THEN [('CASH', 0.6::DOUBLE), ('BANK', 0.4::DOUBLE)] WHEN 4 THEN [('TRADE', 1.0::DOUBLE)] WHEN 1 THEN [('ASSETS', 1.0::DOUBLE)] WHEN 3 THEN [('INCOME', 1.0::DOUBLE)] ELSE [('MISC', 1.0::DOUBLE)] END) AS p FROM b),
mp AS (SELECT account_code, rule_id, p[1] AS target, p[2] AS ratio FROM m)"""


@query("accounting_map_accounts", "accounting/coa-mapping", "journal", f"WITH {_MAP} SELECT account_code, target, ratio, rule_id FROM mp")
def _(j):
    return _mapping(j).withColumn("rule_id", F.coalesce("rule_id", F.lit(0)))


@query("accounting_unmapped_accounts", "accounting/coa-mapping", "journal", f"WITH {_ACC} SELECT account_code FROM acc WHERE NOT (account_code LIKE '1%' OR account_code LIKE '4%' OR account_code LIKE '2%5')")
def _(j):
    return op.unmapped_accounts(_accounts(j), op.map_accounts(_accounts(j), _rules(j)))


@query("accounting_validate_rules", "accounting/coa-mapping", "journal", "SELECT * FROM (VALUES (5, 'EMPTY_PATTERN'), (6, 'SPLIT_SUM')) t(rule_id, error)")
def _(j):
    return op.validate_rules(_rules(j))


@query("accounting_children", "accounting/coa-mapping", "journal", f"WITH {_ACC} SELECT account_code[1:1] AS parent, array_to_string(list(account_code ORDER BY account_code), ',') AS children FROM acc GROUP BY 1")
def _(j):
    return op.account_children(_accounts(j).withColumn("parent", F.substring("account_code", 1, 1))).withColumn("children", F.array_join("children", ","))


def _broken(j):
    """The journal with some entries out of balance, two-sided or without accounts."""
    e = F.col("entry_id")
    return j.withColumn("credit", F.when((e % 50 == 1) & (F.col("line_number") == 0), F.col("credit") + 5).when((e % 70 == 2) & (F.col("line_number") > 0), 1.0).otherwise(F.col("credit"))).withColumn("account_code", F.when((e % 90 == 3) & (F.col("line_number") == 0), "").otherwise(F.col("account_code")))


_BROKEN = "br AS (SELECT entry_id, line_number, posting_date, debit, entity_id, CASE WHEN entry_id % 50 = 1 AND line_number = 0 THEN credit + 5 WHEN entry_id % 70 = 2 AND line_number > 0 THEN 1 ELSE credit END AS credit, CASE WHEN entry_id % 90 = 3 AND line_number = 0 THEN '' ELSE account_code END AS account_code FROM journal)"
_ERR = f"""{_BROKEN}, g AS (SELECT entry_id, ABS(SUM(debit) - SUM(credit)) > 0.01 AS u, bool_or(debit > 0 AND credit > 0) AS d, bool_or(debit = 0 AND credit = 0) AS z, bool_or(account_code = '') AS e FROM br GROUP BY 1),
er AS (SELECT entry_id, unnest(list_filter([CASE WHEN u THEN 'UNBALANCED' END, CASE WHEN d THEN 'DUAL_SIDED' END, CASE WHEN z THEN 'ZERO_AMOUNT' END, CASE WHEN e THEN 'EMPTY_ACCOUNT' END], lambda x: x IS NOT NULL)) AS error FROM g)"""


@query("accounting_validate_entries", "accounting/journal-transform", "journal", f"WITH {_ERR} SELECT * FROM er")
def _(j):
    return op.validate_entries(_broken(j))


@query("accounting_transform_journal", "accounting/journal-transform", "journal", f"""WITH {_ERR}, {_MAP}, k AS (SELECT entry_id, line_number AS old, target AS account_code, debit * ratio AS debit, credit * ratio AS credit FROM br JOIN mp USING (account_code) WHERE entry_id NOT IN (SELECT entry_id FROM er))
SELECT account_code, COUNT(*) AS lines, ROUND(SUM(debit), 2) AS debit, ROUND(SUM(credit), 2) AS credit, COUNT(DISTINCT entry_id) AS entries FROM k GROUP BY 1""")  # fmt: skip
def _(j):
    t = op.account_totals(op.transform_journal(_broken(j), _mapping(j)))
    return t.select("account_code", "lines", r("debit", 2), r("credit", 2), "entries")


@query("accounting_account_totals", "accounting/journal-transform", "journal", "SELECT account_code, ROUND(SUM(debit), 2) AS debit, ROUND(SUM(credit), 2) AS credit, COUNT(*) AS lines, COUNT(DISTINCT entry_id) AS entries FROM journal GROUP BY 1")
def _(j):
    return op.account_totals(j).select("account_code", r("debit", 2), r("credit", 2), "lines", "entries")


@query("accounting_period_totals", "accounting/journal-transform", "journal", "SELECT posting_date // (86400 * 90) AS period, COUNT(DISTINCT entry_id) AS entries, ROUND(SUM(debit), 2) AS debit FROM journal GROUP BY 1")
def _(j):
    return op.period_totals(j, "quarter").select("period", "entries", r("debit", 2))


def _items(o):
    k = F.col("o_orderkey")
    s = o.select(k.alias("id"), F.concat(F.lit("A"), (F.col("o_custkey") % 40).cast("string")).alias("account_code"), F.col("o_totalprice").alias("amount"), F.when(k % 5 == 0, "EUR").otherwise("USD").alias("currency"), F.unix_timestamp("o_orderdate").alias("date"), F.concat(F.lit("R"), (k % 900).cast("string")).alias("reference"))
    t = s.where("id % 9 <> 0").withColumn("amount", F.col("amount") + F.when(F.col("id") % 4 == 0, 0.005).when(F.col("id") % 4 == 1, 20.0).otherwise(0.0)).withColumn("date", F.col("date") + F.col("id") % 5 * 86_400)
    return s, t


@query("accounting_reconcile", "accounting/gl-reconciliation", "orders")
def _(o):
    return op.reconcile(*_items(o)).select("source_id", "target_id", r("confidence", 6), r("variance", 4), "match_type")


@query("accounting_reconciliation_stats", "accounting/gl-reconciliation", "orders")
def _(o):
    s, t = _items(o)
    return op.reconciliation_stats(op.reconcile(s, t), s, t).select("items", "pairs", "unmatched", r("match_rate", 6), r("variance", 2))


@query("accounting_reconcile_totals", "accounting/gl-reconciliation", "orders", """WITH s AS (SELECT 'A' || o_custkey % 40 AS account_code, SUM(o_totalprice) AS a, SUM(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice + CASE o_orderkey % 4 WHEN 0 THEN 0.005 WHEN 1 THEN 20 ELSE 0 END END) AS b FROM orders GROUP BY 1)
SELECT account_code, ROUND(a, 2) AS source_total, ROUND(b, 1) AS target_total, ROUND(a - b, 1) AS variance, ABS(a - b) <= 0.01 AS matched FROM s""")  # fmt: skip
def _(o):
    return op.reconcile_totals(*_items(o)).select("account_code", r("source_total", 2), r("target_total", 1), r("variance", 1), "matched")


@query("accounting_duplicate_items", "accounting/gl-reconciliation", "orders", """WITH RECURSIVE i AS (SELECT o_orderkey AS id, o_custkey % 40 AS a, CAST(o_totalprice AS INTEGER) // 20000 AS v, o_orderkey % 3 AS ref, epoch(o_orderdate) AS d FROM orders),
p AS (SELECT x.id AS a, y.id AS b FROM i x JOIN i y ON x.a = y.a AND x.v = y.v AND x.ref = y.ref AND x.id <> y.id AND ABS(x.d - y.d) <= 604800), q(a, b) AS (SELECT a, a FROM p UNION SELECT q.a, p.b FROM q JOIN p ON q.b = p.a) SELECT MIN(b) AS "group", a AS id FROM q GROUP BY a""")  # fmt: skip
def _(o):
    k = F.col("o_orderkey")
    i = o.select(k.alias("id"), (F.col("o_custkey") % 40).alias("account_code"), (F.round("o_totalprice").cast("int") / 20000).cast("int").cast("double").alias("amount"), F.lit("USD").alias("currency"), F.unix_timestamp("o_orderdate").alias("date"), (k % 3).alias("reference"))
    return op.duplicate_items(i)


_KINDS = "['Sale', 'Service', 'Loan', 'Dividend', 'Other']"
_DEALS = f"""dl AS (SELECT o_orderkey AS id, 'E' || c_nationkey % 8 AS from_entity, 'E' || o_custkey * 7 % 9 AS to_entity, o_totalprice AS amount, {_KINDS}[o_orderkey % 5 + 1] AS kind, CASE o_orderstatus WHEN 'F' THEN 'Confirmed' WHEN 'P' THEN 'Pending' ELSE 'Eliminated' END AS status FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _deals(o, c):
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("E"), (F.col("c_nationkey") % 8).cast("string")).alias("from_entity"), F.concat(F.lit("E"), (F.col("o_custkey") * 7 % 9).cast("string")).alias("to_entity"), F.col("o_totalprice").alias("amount"), F.element_at(F.array(*[F.lit(x) for x in ("Sale", "Service", "Loan", "Dividend", "Other")]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("kind"), F.when(F.col("o_orderstatus") == "F", "Confirmed").when(F.col("o_orderstatus") == "P", "Pending").otherwise("Eliminated").alias("status"))


@query("accounting_entity_balances", "accounting/network-analysis", "orders customer", f"WITH {_DEALS}, s AS (SELECT from_entity AS entity, to_entity AS other, amount AS r, 0 AS p FROM dl WHERE status <> 'Eliminated' UNION ALL SELECT to_entity, from_entity, 0, amount FROM dl WHERE status <> 'Eliminated') SELECT entity, ROUND(SUM(r), 2) AS receivable, ROUND(SUM(p), 2) AS payable, COUNT(DISTINCT other) AS counterparties, ROUND(SUM(r) - SUM(p), 2) AS net FROM s GROUP BY 1")
def _(o, c):
    return op.entity_balances(_deals(o, c)).select("entity", r("receivable", 2), r("payable", 2), "counterparties", r("net", 2))


@query("accounting_entity_relations", "accounting/network-analysis", "orders customer", f"WITH {_DEALS} SELECT LEAST(from_entity, to_entity) AS a, GREATEST(from_entity, to_entity) AS b, ROUND(SUM(amount), 2) AS volume, COUNT(*) AS n, ROUND(SUM(CASE WHEN from_entity <= to_entity THEN amount ELSE -amount END), 2) AS net FROM dl GROUP BY 1, 2")
def _(o, c):
    return op.entity_relations(_deals(o, c)).select("a", "b", r("volume", 2), "n", r("net", 2))


@query("accounting_circular_references", "accounting/network-analysis", "orders customer", f"""WITH RECURSIVE {_DEALS}, e AS (SELECT from_entity AS u, to_entity AS v, SUM(amount) AS w FROM dl GROUP BY 1, 2 HAVING u <> v),
p(root, pos, path, amount) AS (SELECT u, v, [u, v], w FROM e WHERE u < v UNION ALL SELECT root, v, list_append(path, v), amount + w FROM p JOIN e ON pos = u WHERE v > root AND NOT list_contains(path, v) AND len(path) < 4),
z AS (SELECT path, amount, list_sort(path) AS s FROM p WHERE (pos, root) IN (SELECT (u, v) FROM e)) SELECT array_to_string(MIN(path), '>') AS path, ROUND(arg_min(amount, path), 2) AS amount FROM z GROUP BY s""")  # fmt: skip
def _(o, c):
    return op.circular_references(_deals(o, c), 4).select(F.array_join("path", ">").alias("path"), r("amount", 2))


@query("accounting_eliminations", "accounting/network-analysis", "orders customer", f"""WITH {_DEALS} SELECT id, CASE kind WHEN 'Sale' THEN 'IC_REVENUE' WHEN 'Service' THEN 'IC_SERVICE_REVENUE' WHEN 'Loan' THEN 'IC_LOAN_PAYABLE' WHEN 'Dividend' THEN 'IC_DIVIDEND_INCOME' ELSE 'IC_OTHER_INCOME' END AS debit_account,
CASE kind WHEN 'Sale' THEN 'IC_COGS' WHEN 'Service' THEN 'IC_SERVICE_EXPENSE' WHEN 'Loan' THEN 'IC_LOAN_RECEIVABLE' WHEN 'Dividend' THEN 'IC_DIVIDEND_PAID' ELSE 'IC_OTHER_EXPENSE' END AS credit_account, ROUND(amount, 2) AS amount FROM dl WHERE status = 'Confirmed' AND amount >= 100000""")  # fmt: skip
def _(o, c):
    return op.eliminations(_deals(o, c), 100_000.0).withColumn("amount", r("amount", 2))


@query("accounting_netting_opportunities", "accounting/network-analysis", "orders customer", f"WITH {_DEALS}, g AS (SELECT LEAST(from_entity, to_entity) AS a, GREATEST(from_entity, to_entity) AS b, SUM(CASE WHEN from_entity < to_entity THEN amount ELSE 0 END) AS f, SUM(CASE WHEN from_entity > to_entity THEN amount ELSE 0 END) AS k FROM dl WHERE from_entity <> to_entity GROUP BY 1, 2) SELECT a, b, ROUND(f, 2) AS forward, ROUND(k, 2) AS backward, ROUND(ABS(f - k), 2) AS net, ROUND(2 * LEAST(f, k), 2) AS reduction FROM g WHERE f > 0 AND k > 0")
def _(o, c):
    return op.netting_opportunities(_deals(o, c)).select("a", "b", r("forward", 2), r("backward", 2), r("net", 2), r("reduction", 2))


@query("accounting_correlations", "accounting/temporal-correlation", "customer_series", "SELECT a.series_id AS a, b.series_id AS b, ROUND(corr(a.value, b.value), 6) AS r, COUNT(*) AS n FROM customer_series a JOIN customer_series b ON a.t = b.t AND a.series_id < b.series_id GROUP BY 1, 2 HAVING COUNT(*) >= 10")
def _(s):
    return op.account_correlations(s).select("a", "b", r("r", 6), "n")


@query("accounting_correlation_p_values", "accounting/temporal-correlation", "customer_series")
def _(s):
    return op.account_correlations(s).select("a", "b", r("p_value", 6))


_ROLL = "j AS (SELECT a.t, a.value AS x, b.value AS y FROM customer_series a JOIN customer_series b ON a.t = b.t AND a.series_id = '3' AND b.series_id = '4'), c AS (SELECT t, corr(x, y) OVER w AS r, COUNT(*) OVER w AS n FROM j WINDOW w AS (ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), ro AS (SELECT t, r FROM c WHERE n = 30)"


@query("accounting_rolling_correlation", "accounting/temporal-correlation", "customer_series", f"WITH {_ROLL} SELECT t, ROUND(r, 6) AS r FROM ro")
def _(s):
    return op.rolling_correlation(s, "3", "4", 30).select("t", r("r", 6))


@query("accounting_correlation_breaks", "accounting/temporal-correlation", "customer_series", f"WITH {_ROLL}, b AS (SELECT t, r, r - LAG(r) OVER (ORDER BY t) AS change FROM ro) SELECT t, ROUND(change, 6) AS change FROM b WHERE ABS(change) > 0.1")
def _(s):
    return op.correlation_breaks(op.rolling_correlation(s, "3", "4", 30), 0.1).select("t", r("change", 6))


@query("accounting_point_anomalies", "accounting/temporal-correlation", "customer_series", """WITH z AS (SELECT series_id, t, (value - AVG(value) OVER (PARTITION BY series_id)) / STDDEV_SAMP(value) OVER (PARTITION BY series_id) AS z FROM customer_series), c AS (SELECT a.series_id AS a, b.series_id AS b, corr(a.value, b.value) AS r FROM customer_series a JOIN customer_series b ON a.t = b.t AND a.series_id <> b.series_id GROUP BY 1, 2 HAVING ABS(r) >= 0.08),
e AS (SELECT a AS series_id, t, AVG(r * z) AS expected FROM c JOIN z ON z.series_id = b GROUP BY 1, 2) SELECT series_id, t, ROUND(z - expected, 5) AS z FROM z JOIN e USING (series_id, t) WHERE ABS(z - expected) > 2""")  # fmt: skip
def _(s):
    return op.point_anomalies(s, 0.08).select("series_id", "t", r("z", 5))


@query("accounting_generate_flows", "accounting/network-generation", "journal", "SELECT entry_id, MAX(account_code) FILTER (WHERE credit > 0) AS from_account, COUNT(*) FILTER (WHERE debit > 0) AS n, ROUND(SUM(debit), 2) AS amount FROM journal GROUP BY 1")
def _(j):
    f = op.generate_flows(j)
    return f.groupBy("entry_id").agg(F.max("from_account").alias("from_account"), F.count(F.lit(1)).alias("n"), r(F.sum("amount"), 2, "amount"))


@query("accounting_network_stats", "accounting/network-generation", "journal")
def _(j):
    return op.network_stats(op.generate_flows(_broken(j).where("account_code <> ''"))).select("method", "n", r("amount", 0), r("weighted_confidence", 6))


@query("accounting_entry_patterns", "accounting/network-generation", "journal", "WITH e AS (SELECT entry_id, bool_or(debit > 0 AND account_code[1:1] = '1') AS sale, COUNT(DISTINCT entity_id) > 2 AS apart FROM journal GROUP BY 1) SELECT CASE WHEN apart THEN 'Intercompany' ELSE '' END || CASE WHEN sale THEN 'SimpleSale' ELSE 'Other' END AS pattern, COUNT(*) AS n FROM e GROUP BY 1")
def _(j):
    return op.entry_pattern(j).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("accounting_account_flows", "accounting/network-generation", "journal", "SELECT d.account_code AS to_account, ROUND(SUM(d.debit), 2) AS amount FROM journal d JOIN journal c USING (entry_id) WHERE d.debit > 0 AND c.credit > 0 AND c.account_code = '4105' GROUP BY 1")
def _(j):
    return op.account_flows(op.generate_flows(j), "4105", "out").groupBy("to_account").agg(r(F.sum("amount"), 2, "amount"))


_PAIR = "d AS (SELECT entry_id, line_number AS dl, account_code AS da, debit FROM journal WHERE debit > 0), c AS (SELECT entry_id, line_number AS cl, account_code AS ca, credit FROM journal WHERE credit > 0), pr AS (SELECT *, LEAST(debit, credit) AS amount FROM d JOIN c USING (entry_id))"
_MEAS = f"""{_PAIR}, e AS (SELECT DISTINCT ca AS a, da AS b FROM pr), tc AS (SELECT x, COUNT(*) AS touch FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e WHERE a <> b) GROUP BY 1), cp AS (SELECT x, GREATEST(SUM(o), SUM(i)) AS cps FROM (SELECT a AS x, 1 AS o, 0 AS i FROM e UNION ALL SELECT b, 0, 1 FROM e) GROUP BY 1),
m AS (SELECT account_code, SUM(debit) + SUM(credit) AS turnover, SUM(debit) - SUM(credit) AS balance, (MAX(posting_date) - MIN(posting_date)) / 86400 / COUNT(*) AS holding, 1 - ABS(SUM(debit) - SUM(credit)) / (SUM(debit) + SUM(credit)) AS br FROM journal GROUP BY 1),
ms AS (SELECT m.*, CAST(cps AS BIGINT) AS cps, touch / (SELECT COUNT(*) FROM e) AS centrality FROM m JOIN tc ON x = account_code JOIN cp ON cp.x = account_code)"""


@query("accounting_account_measures", "accounting/suspense-detection", "journal", f"WITH {_MEAS} SELECT account_code, ROUND(turnover, 2) AS turnover, ROUND(balance, 2) AS balance, ROUND(br, 6) AS balance_ratio, ROUND(holding, 6) AS holding_days, cps AS counterparties, ROUND(centrality, 8) AS centrality FROM ms")
def _(j):
    return op.account_measures(j).select("account_code", r("turnover", 2), r("balance", 2), r("balance_ratio", 6), r("holding_days", 6), "counterparties", r("centrality", 8))


@query("accounting_suspense_accounts", "accounting/suspense-detection", "journal", f"""WITH {_MEAS}, f AS (SELECT account_code, centrality, centrality >= 0.05 AS c1, ABS(balance) > 0 AND turnover >= 10 * ABS(balance) / 2 AS c2, holding <= 7 AS c3, br >= 0.9 AS c4, cps >= 5 AS c5, ABS(balance) < 100 AS c6 FROM ms),
s AS (SELECT *, 20 * CAST(c1 AS INT) + 15 * CAST(c2 AS INT) + 15 * CAST(c3 AS INT) + 15 * CAST(c4 AS INT) + 10 * CAST(c5 AS INT) + 15 * CAST(c6 AS INT) AS b, CAST(c1 AS INT) + CAST(c2 AS INT) + CAST(c3 AS INT) + CAST(c4 AS INT) + CAST(c5 AS INT) + CAST(c6 AS INT) AS k FROM f),
z AS (SELECT *, LEAST(b + CASE WHEN c1 AND k >= 3 THEN centrality * 10 ELSE 0 END, 100) AS score FROM s) SELECT account_code, ROUND(score, 4) AS score, CASE WHEN (c1 AND c4 AND c6) OR score >= 80 THEN 'Critical' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END AS risk FROM z""")  # fmt: skip
def _(j):
    return op.suspense_accounts(j, centrality=0.05).select("account_code", r("score"), "risk")


_GAAP = f"""{_PAIR}, ty AS (SELECT DISTINCT account_code, CASE account_code[1:1] WHEN '1' THEN 'Asset' WHEN '2' THEN 'Liability' WHEN '4' THEN 'Revenue' WHEN '5' THEN 'Expense' ELSE 'Equity' END AS t FROM journal), q AS (SELECT pr.*, x.t AS dt, y.t AS ct FROM pr JOIN ty x ON x.account_code = da JOIN ty y ON y.account_code = ca),
a AS (SELECT entry_id, arg_min((ca, da, amount), (dl, cl)) AS f FROM q WHERE ct = 'Revenue' AND dt = 'Expense' GROUP BY 1), w AS (SELECT ca AS u, da AS v, SUM(amount) AS w FROM pr GROUP BY 1, 2 HAVING SUM(amount) > 1000),
gv AS (SELECT 'DirectRevenueExpense' AS violation, entry_id, f[1] || '>' || f[2] AS accounts, f[3] AS amount, 'Major' AS severity FROM a
UNION ALL SELECT 'RevenueInflation', NULL, p.u || '>' || p.v, LEAST(p.w, o.w), 'Critical' FROM w p JOIN w o ON p.u = o.v AND p.v = o.u JOIN ty x ON x.account_code = p.u JOIN ty y ON y.account_code = p.v WHERE p.u < p.v AND (x.t = 'Revenue' OR y.t = 'Revenue'))"""


def _types(j):
    d = F.substring("account_code", 1, 1)
    return j.select("account_code").distinct().withColumn("account_type", F.when(d == "1", "Asset").when(d == "2", "Liability").when(d == "4", "Revenue").when(d == "5", "Expense").otherwise("Equity"))


@query("accounting_gaap_violations", "accounting/gaap-violation", "journal", f"WITH {_GAAP} SELECT violation, COALESCE(entry_id, -1) AS entry_id, accounts, ROUND(amount, 2) AS amount, severity FROM gv")
def _(j):
    return op.gaap_violations(j, _types(j)).select("violation", F.coalesce("entry_id", F.lit(-1)).alias("entry_id"), "accounts", r("amount", 2), "severity")


@query("accounting_gaap_summary", "accounting/gaap-violation", "journal", f"WITH {_GAAP} SELECT COUNT(*) AS violations, ROUND(SUM(amount), 0) AS amount_at_risk, COUNT(*) AS major, GREATEST(100 - 12.0 * COUNT(*), 0) AS score FROM gv")
def _(j):
    return op.gaap_summary(op.gaap_violations(j, _types(j))).select("violations", r("amount_at_risk", 0), "major", "score")


_RATES = "rt(k, rate, place, kind) AS (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, '{p}', '{k}')" for i, (x, p, k) in enumerate(op.VAT_RATES)) + ")"


@query("accounting_vat_splits", "accounting/network-generation", "orders", f"""WITH {_RATES}, a AS (SELECT o_orderkey AS entry_id, o_totalprice AS g, o_totalprice / (1 + [0.2, 0.19, 0.055, 0.42][o_orderkey % 4 + 1]) AS n FROM orders),
h AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY k) AS first FROM a JOIN rt ON ABS((g - n) / n - rate) < 0.001) SELECT entry_id, ROUND(n + 0.0123, 0) AS net, ROUND(g - n + 0.0123, 0) AS tax, rate, place, kind FROM h WHERE first = 1""")  # fmt: skip
def _(o):
    rate = F.element_at(F.array(*[F.lit(x) for x in (0.2, 0.19, 0.055, 0.42)]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    amounts = o.select(F.col("o_orderkey").alias("entry_id"), F.explode(F.array(F.col("o_totalprice"), F.col("o_totalprice") / (1 + rate))).alias("amount"))
    return op.vat_splits(amounts).select("entry_id", r(F.col("net") + 0.0123, 0, "net"), r(F.col("tax") + 0.0123, 0, "tax"), "rate", "place", "kind")  # off rounding ties


def _taxed(o):
    """Sales and purchases with tax, some of them between entities."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    rate = F.element_at(F.array(*[F.lit(x) for x in (0.2, 0.19, 0.08)]), (k % 3 + 1).cast("int"))
    line = lambda n, sale, buy, amount, sold: F.struct(F.lit(n).alias("line_number"), F.when(k % 2 == 0, sale).otherwise(buy).alias("account_code"), F.when((k % 2 == 0) != F.lit(sold), amount).otherwise(0.0).alias("debit"), F.when((k % 2 == 0) == F.lit(sold), amount).otherwise(0.0).alias("credit"), F.when((k % 5 == 0) & F.lit(n == 2), "B").otherwise("A").alias("entity_id"))
    lines = F.array(line(1, "1000", "2000", v * (1 + rate), False), line(2, "4000", "5000", v, True), line(3, "OUTPUT_TAX", "INPUT_TAX", v * rate, True))
    return o.select(k.alias("entry_id"), F.explode(lines).alias("l")).select("entry_id", "l.*")


@query("accounting_vat_patterns", "accounting/network-generation", "orders", "SELECT o_orderkey AS entry_id, o_orderkey % 2 = 0 AS is_output, ROUND(o_totalprice, 2) AS net, ROUND(o_totalprice * [0.2, 0.19, 0.08][o_orderkey % 3 + 1], 2) AS tax, ROUND([0.2, 0.19, 0.08][o_orderkey % 3 + 1], 6) AS rate, ['UK', 'DE', 'Generic'][o_orderkey % 3 + 1] AS place, CASE WHEN o_orderkey % 2 = 0 THEN 'OUTPUT_TAX' ELSE 'INPUT_TAX' END AS accounts FROM orders")
def _(o):
    return op.vat_patterns(_taxed(o)).select("entry_id", "is_output", r("net", 2), r("tax", 2), r("rate", 6), "place", F.array_join("tax_accounts", ",").alias("accounts"))


@query("accounting_transaction_patterns", "accounting/network-generation", "orders", "SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Intercompany' WHEN o_orderkey % 2 = 0 THEN 'SaleWithVat' ELSE 'PurchaseWithVat' END AS pattern, CASE WHEN o_orderkey % 5 = 0 THEN 0.05 ELSE 0.15 END AS boost FROM orders")
def _(o):
    return op.transaction_pattern(_taxed(o))


@query("accounting_entity_flows", "accounting/network-generation", "orders", """WITH l AS (SELECT o_orderkey AS e, o_totalprice AS v, [0.2, 0.19, 0.08][o_orderkey % 3 + 1] AS t, o_orderkey % 2 = 0 AS sale, o_orderkey % 5 = 0 AS apart FROM orders),
d AS (SELECT e, '1000' AS a, v * (1 + t) AS m, 'A' AS n FROM l WHERE sale UNION ALL SELECT e, '5000', v, CASE WHEN apart THEN 'B' ELSE 'A' END FROM l WHERE NOT sale UNION ALL SELECT e, 'INPUT_TAX', v * t, 'A' FROM l WHERE NOT sale),
c AS (SELECT e, '2000' AS a, v * (1 + t) AS m, 'A' AS n FROM l WHERE NOT sale UNION ALL SELECT e, '4000', v, CASE WHEN apart THEN 'B' ELSE 'A' END FROM l WHERE sale UNION ALL SELECT e, 'OUTPUT_TAX', v * t, 'A' FROM l WHERE sale),
p AS (SELECT d.e, c.a AS f, d.a AS t, d.m AS dm, c.m AS cm FROM d JOIN c ON d.e = c.e WHERE d.n = c.n OR NOT EXISTS (SELECT 1 FROM c x WHERE x.e = d.e AND x.n = d.n))
SELECT e AS entry_id, f AS from_account, t AS to_account, ROUND(dm * cm / SUM(cm) OVER (PARTITION BY e, t), 2) AS amount FROM p""")  # fmt: skip
def _(o):
    return op.entity_flows(_taxed(o)).select("entry_id", "from_account", "to_account", r("amount", 2))


_FLOWS = f"{_PAIR}, ts AS (SELECT entry_id, MIN(posting_date) AS ts FROM journal GROUP BY 1), fl AS (SELECT entry_id, ts, ca AS from_account, da AS to_account, debit FROM pr JOIN ts USING (entry_id))"


@query("accounting_recent_flows", "accounting/network-generation-ring", "journal", f"WITH {_FLOWS}, k AS (SELECT *, row_number() OVER (ORDER BY ts DESC, entry_id, from_account, to_account, debit) AS k FROM fl WHERE (from_account = '4105' OR to_account = '4105') AND ts BETWEEN 788918400 AND 852076800) SELECT entry_id, ts, to_account, ROUND(debit, 2) AS amount FROM k WHERE k <= 50")
def _(j):
    return op.recent_flows(op.dated_flows(op.generate_flows(j), j), "4105", 788_918_400, 852_076_800, 50).select("entry_id", "ts", "to_account", r("amount", 2))


@query("accounting_flows_between", "accounting/network-generation", "journal", f"WITH {_FLOWS} SELECT from_account, COUNT(*) AS n, ROUND(SUM(debit), 1) AS amount FROM fl WHERE ts BETWEEN 788918400 AND 852076800 GROUP BY 1")
def _(j):
    f = op.flows_between(op.dated_flows(op.generate_flows(j), j), 788_918_400, 852_076_800)
    return f.groupBy("from_account").agg(F.count(F.lit(1)).alias("n"), r(F.sum("amount"), 1, "amount"))


@query("accounting_boosted_flows", "accounting/network-generation", "journal", f"WITH {_PAIR}, n AS (SELECT entry_id, COUNT(*) AS n FROM d GROUP BY 1) SELECT 'Intercompany' AS pattern, ROUND(CASE WHEN n.n = 1 THEN 1.0 ELSE 0.9 END, 4) AS confidence, COUNT(*) AS n FROM pr JOIN n USING (entry_id) GROUP BY 2")
def _(j):
    f = op.boosted_flows(op.generate_flows(j), op.transaction_pattern(j), op.vat_patterns(j))
    return f.groupBy("pattern", r("confidence")).agg(F.count(F.lit(1)).alias("n"))
