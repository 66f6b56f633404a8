"""Canonical input views over the relational tables, as SQL that Spark and DuckDB both run.

``{name}`` stands for a table; ``EPOCH(x)`` for the seconds of a timestamp.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_ROW_ID = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"

VIEWS: dict[str, str] = {
    # id, source_id, dest_id, amount, ts: one id space of 100 accounts
    "transactions": f"""SELECT {_ROW_ID} AS id, o_custkey % 100 AS source_id, l_suppkey % 100 AS dest_id,
        l_extendedprice * (1 - l_discount) AS amount, CAST(FLOOR(EPOCH(l_shipdate)) AS BIGINT) AS ts
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    # the same for 2,000 accounts, in cents
    "transfers": f"""SELECT {_ROW_ID} AS id, o_custkey % 2000 AS source_id, (l_partkey * 3 + l_suppkey) % 2000 AS dest_id,
        CAST(ROUND(l_extendedprice * 100) AS BIGINT) / 100.0e0 AS amount, CAST(FLOOR(EPOCH(l_shipdate)) AS BIGINT) AS ts
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    # an edge for every order, from its customer to another one; customers of low numbers are met more often
    "edges": """SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, CAST(FLOOR(x * 1.0e0 * x / n) AS BIGINT) AS dst
        FROM (SELECT o_custkey, (o_orderkey * 7 + o_custkey * 13) % n AS x, n FROM {orders} CROSS JOIN (SELECT COUNT(*) AS n FROM {customer}) c) o) q WHERE src <> dst""",
    # both directions between each supplier and two others: one of its group of three, one anywhere
    "links": """SELECT DISTINCT src, dst FROM (
        SELECT s_suppkey AS src, LEAST(s_suppkey - s_suppkey % 3 + (s_suppkey + 1) % 3, n - 1) AS dst FROM {supplier} CROSS JOIN (SELECT COUNT(*) AS n FROM {supplier}) c
        UNION ALL SELECT LEAST(s_suppkey - s_suppkey % 3 + (s_suppkey + 1) % 3, n - 1), s_suppkey FROM {supplier} CROSS JOIN (SELECT COUNT(*) AS n FROM {supplier}) c
        UNION ALL SELECT s_suppkey, (s_suppkey * 7 + s_nationkey * 3) % n FROM {supplier} CROSS JOIN (SELECT COUNT(*) AS n FROM {supplier}) c
        UNION ALL SELECT (s_suppkey * 7 + s_nationkey * 3) % n, s_suppkey FROM {supplier} CROSS JOIN (SELECT COUNT(*) AS n FROM {supplier}) c) q WHERE src <> dst""",
    "nodes": "SELECT c_custkey AS id FROM {customer}",
    "link_nodes": "SELECT s_suppkey AS id FROM {supplier}",
    "series": """SELECT 'revenue' AS series_id, CAST(FLOOR(EPOCH(o_orderdate)) AS BIGINT) AS t, SUM(o_totalprice) AS value FROM {orders} GROUP BY o_orderdate""",
    # a series for every 100 customers
    "customer_series": """SELECT CAST(CAST(FLOOR(o_custkey / 100e0) AS BIGINT) AS VARCHAR(20)) AS series_id, CAST(FLOOR(EPOCH(o_orderdate)) AS BIGINT) AS t, SUM(o_totalprice) AS value
        FROM {orders} GROUP BY CAST(FLOOR(o_custkey / 100e0) AS BIGINT), o_orderdate""",
    "payments": f"""SELECT CAST({_ROW_ID} AS VARCHAR(40)) AS id, c_name AS payer_account, s_name AS payee_account, l_extendedprice AS amount,
        CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Processing' ELSE 'Initiated' END AS status,
        CASE l_linenumber % 6 WHEN 0 THEN 'ACH' WHEN 1 THEN 'Wire' WHEN 2 THEN 'RealTime' WHEN 3 THEN 'Internal' WHEN 4 THEN 'Check' ELSE 'Card' END AS payment_type,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '5-LOW' THEN 'Low' ELSE 'Normal' END AS priority,
        CASE WHEN l_linenumber = 7 THEN 'EUR' ELSE 'USD' END AS currency,
        CAST(FLOOR(EPOCH(l_shipdate)) AS BIGINT) + l_partkey * 61 AS initiated_at
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "payment_accounts": """SELECT c_name AS account_id, c_acctbal * 10 AS available_balance, 'USD' AS currency,
        CASE WHEN c_custkey % 17 = 0 THEN 'Frozen' ELSE 'Active' END AS status,
        CASE WHEN c_custkey % 3 = 0 THEN 40000.0e0 END AS daily_limit, CAST(c_custkey % 1000 AS DOUBLE) AS daily_used FROM {customer}
        UNION ALL SELECT s_name, s_acctbal * 10, 'USD', 'Active', CAST(NULL AS DOUBLE), 0.0e0 FROM {supplier} WHERE s_suppkey % 11 <> 0""",
    "trades": f"""SELECT {_ROW_ID} AS id, p_brand AS security_id, cn.n_name AS buyer_id, sn.n_name AS seller_id, CAST(l_quantity AS BIGINT) AS quantity,
        CAST(FLOOR(l_extendedprice / l_quantity) AS BIGINT) AS price, CAST(FLOOR(EPOCH(o_orderdate)) AS BIGINT) AS trade_date, CAST(FLOOR(EPOCH(l_shipdate)) AS BIGINT) AS settlement_date,
        CASE l_returnflag WHEN 'N' THEN 'Pending' WHEN 'A' THEN 'Matched' ELSE 'Failed' END AS status,
        CASE WHEN l_linenumber <= 4 THEN 'USD' ELSE 'EUR' END AS currency
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} cn ON c_nationkey = cn.n_nationkey
        JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} sn ON s_nationkey = sn.n_nationkey JOIN {{part}} ON l_partkey = p_partkey""",
    "instructions": f"""SELECT {_ROW_ID} AS id, n_name AS party_id, p_brand AS security_id,
        CASE l_linenumber % 4 WHEN 0 THEN 'Deliver' WHEN 1 THEN 'Receive' WHEN 2 THEN 'Pay' ELSE 'Collect' END AS instruction_type,
        CAST(l_quantity AS BIGINT) AS quantity, CAST(FLOOR(l_extendedprice) AS BIGINT) AS payment_amount, CAST(FLOOR(EPOCH(l_shipdate)) AS BIGINT) AS settlement_date,
        CASE l_returnflag WHEN 'N' THEN 'Pending' WHEN 'A' THEN 'Settled' ELSE 'Failed' END AS status
        FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{part}} ON l_partkey = p_partkey""",
    "audit_records": """SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR(20)) AS entity_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'JournalEntry' WHEN '2-HIGH' THEN 'Payment' WHEN '3-MEDIUM' THEN 'Invoice' WHEN '5-LOW' THEN 'Receipt' ELSE 'Transfer' END AS record_type,
        CAST(FLOOR(EPOCH(o_orderdate)) AS BIGINT) AS ts, o_totalprice AS amount, CAST(o_custkey % 50 AS VARCHAR(20)) AS account,
        CAST(o_orderkey % 40 AS VARCHAR(20)) AS counter_party, o_orderstatus AS category FROM {orders}""",
    "user_events": """SELECT event_id AS id, user_id, event_type, CAST(FLOOR(EPOCH(ts)) AS BIGINT) AS ts, value,
        user_id * 1000 + CAST(FLOOR(EPOCH(ts) / 86400) AS BIGINT) % 1000 AS session_id,
        CONCAT('dev', CAST(event_id % 3 AS VARCHAR(10))) AS device_id, CONCAT('loc', CAST((event_id * 7 + user_id) % 4 AS VARCHAR(10))) AS location FROM {events}""",
    "process_events": "SELECT event_id AS id, user_id AS case_id, event_type AS activity, CAST(FLOOR(EPOCH(ts)) AS BIGINT) AS ts, CONCAT('r', CAST(event_id % 5 AS VARCHAR(10))) AS resource, value FROM {events}",
    "obligors": """SELECT c_custkey AS obligor_id, (c_custkey % 60) / 100.0e0 AS debt_to_income, (c_custkey % 90) / 100.0e0 AS loan_to_value, (c_custkey % 95) / 100.0e0 AS credit_utilization,
        CAST(60 + c_custkey % 40 AS DOUBLE) AS payment_history, CAST(c_custkey % 12 AS DOUBLE) AS employment_years, CAST(c_custkey % 7 AS BIGINT) AS recent_inquiries, CAST(c_custkey % 4 AS BIGINT) AS delinquencies,
        CAST(c_custkey % 20 AS DOUBLE) AS credit_history_years, 1000 + ABS(c_acctbal) AS ead, 1.0e0 + c_custkey % 5 AS maturity FROM {customer}""",
    "kyc": """SELECT c_custkey AS customer_id, CAST(c_custkey * 7 % 101 AS DOUBLE) AS country_risk, CAST(c_custkey * 13 % 101 AS DOUBLE) AS industry_risk, CAST(c_custkey * 17 % 101 AS DOUBLE) AS product_risk,
        CAST(c_custkey * 29 % 101 AS DOUBLE) AS transaction_risk, CAST(c_custkey * 31 % 101 AS DOUBLE) AS documentation_score, CAST(c_custkey % 15 AS DOUBLE) AS tenure_years FROM {customer}""",
    "positions": """SELECT p_brand AS asset_id, SUM(p_retailprice) AS value, 0.02e0 + AVG(p_size) / 500 AS mu, 0.05e0 + AVG(p_size) / 200 AS sigma FROM {part} GROUP BY p_brand""",
    "points": f"""SELECT {_ROW_ID} AS row_id, l_quantity AS x0, l_discount * 100 AS x1, l_tax * 100 AS x2, l_extendedprice AS y FROM {{lineitem}}""",
    "journal": f"""SELECT l_orderkey AS entry_id, (l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS line_number, CAST(FLOOR(EPOCH(o_orderdate)) AS BIGINT) AS posting_date,
        CONCAT(CAST(1 + l_partkey % 5 AS VARCHAR(4)), CAST(100 + l_suppkey % 20 AS VARCHAR(6))) AS account_code, l_extendedprice AS debit, 0.0e0 AS credit, n_name AS entity_id
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey
        UNION ALL SELECT l_orderkey, 0, CAST(FLOOR(EPOCH(MAX(o_orderdate))) AS BIGINT), CONCAT('4', CAST(100 + l_orderkey % 10 AS VARCHAR(6))), 0.0e0, SUM(l_extendedprice), 'HQ'
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey GROUP BY l_orderkey""",
    "cash_flows": """SELECT o_orderkey AS id, CAST(FLOOR(EPOCH(o_orderdate) / 86400) AS BIGINT) AS day, CASE WHEN o_orderstatus = 'O' THEN -o_totalprice ELSE o_totalprice END AS amount,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Operating' WHEN '2-HIGH' THEN 'Debt' WHEN '5-LOW' THEN 'Tax' ELSE 'Trading' END AS category,
        0.5e0 + (o_orderkey % 6) / 10.0e0 AS certainty, CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM {orders}""",
    "vectors": "SELECT vec_id AS id, embedding AS vector, label FROM {embeddings}",
}


def view_sql(name: str, spark_dir: str | None = None) -> str:
    """The SQL of a view: over files in ``spark_dir`` for Spark, or over table names for DuckDB."""
    text = VIEWS[name]
    if spark_dir is None:
        text = text.replace("EPOCH(", "epoch(")
        return re.sub(r"\{(\w+)\}", r"\1", text)
    text = text.replace("EPOCH(", "unix_timestamp(")
    return re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{spark_dir}/{m[1]}.parquet`", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical view, or a table of that name."""
    if name in VIEWS:
        return spark.sql(view_sql(name, sf_dir))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
