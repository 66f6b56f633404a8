"""Small fixtures and invariants."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import names, normal
from lakeloom.operators import accounting, banking, behavioral, clearing, compliance, graph, joins, ml, orderbook, payments, process, risk, temporal, treasury


def edges(spark, pairs, both=False):
    pairs = pairs + [(b, a) for a, b in pairs] if both else pairs
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, n):
    return spark.range(n).select(F.col("id"))


def test_pagerank_is_even_on_a_cycle(spark):
    s = graph.pagerank(edges(spark, [(0, 1), (1, 2), (2, 3), (3, 0)]), nodes(spark, 4)).collect()
    assert all(abs(r.score - 0.25) < 0.01 for r in s)


def test_star_centre_leads(spark):
    e, n = edges(spark, [(0, i) for i in range(1, 5)], both=True), nodes(spark, 5)
    for scores in (graph.degree_centrality(e, n), graph.closeness_centrality(e, n), graph.betweenness_centrality(e, n)):
        assert graph.top_k(scores, 1).first().id == 0
    assert graph.betweenness_centrality(e, n).where("id = 0").first().score == pytest.approx(1.0)


def test_similarity_fixture(spark):
    e = edges(spark, [(0, 1), (1, 2), (0, 3), (1, 4), (2, 5), (3, 4), (4, 5)], both=True)
    pair = lambda kind: {(r.a, r.b): r.score for r in graph.similarity(e, kind).collect()}
    assert pair("jaccard")[0, 2] == pytest.approx(1 / 3)
    assert pair("cosine")[0, 2] == pytest.approx(0.5)
    assert pair("common")[0, 2] == 1 and (0, 1) not in pair("common")


def test_components_and_strong_components(spark):
    e = edges(spark, [(1, 2), (2, 3), (5, 6)])
    assert {r.id: r.label for r in graph.connected_components(e, nodes(spark, 8)).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)], "a long, b long")
    assert {r.id: r.label for r in graph.strong_components(pairs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_triangle_counts(spark):
    e, n = edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3)], both=True), nodes(spark, 4)
    assert [r.triangles for r in graph.triangle_counts(e, n).orderBy("id").collect()] == [1, 1, 1, 0]
    assert graph.cliques(e, 3).count() == 1
    assert {r.motif: r.n for r in graph.triads(e, n).collect()} == {"triangle": 1, "wedge": 2, "edge": 4}


def test_shortest_paths(spark):
    e = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0)], "src long, dst long, w double")
    got = {r.id: (r.distance, r.predecessor) for r in graph.shortest_paths(e, spark.createDataFrame([(0,)], "id long"), "w").collect()}
    assert got[1] == (2.0, 2) and got[3] == (3.0, 1)
    assert graph.path_between(e, 0, 3).first().path == [0, 1, 3]
    assert graph.path_between(e, 3, 0).count() == 0
    assert [r.hops for r in graph.k_shortest_paths(e, 0, 3, 3).collect()] == [2, 3]


def test_louvain_separates_cliques(spark):
    clique = [(a, b) for k in (0, 10) for a in range(k, k + 4) for b in range(k, k + 4) if a < b] + [(0, 10)]
    e = edges(spark, clique, both=True)
    c = {r.id: r.community for r in graph.louvain(e, e.select(F.col("src").alias("id")).distinct()).collect()}
    assert c[1] == c[2] == c[3] and c[11] == c[12] == c[13] and c[1] != c[11]


def transactions(spark, rows):
    return spark.createDataFrame(rows, "id long, source_id long, dest_id long, amount double, ts long")


def test_circular_and_reciprocal_flows(spark):
    t = transactions(spark, [(1, 1, 2, 1000.0, 100), (2, 2, 3, 950.0, 200), (3, 3, 1, 900.0, 300)])
    assert compliance.circular_ratio(t).first().ratio == 1.0
    t = transactions(spark, [(1, 1, 2, 5000.0, 100), (2, 2, 1, 4800.0, 200)])
    assert compliance.reciprocal_pairs(t).first().reciprocal == 9600.0
    assert compliance.flow_reversals(t).first().risk == "High"


def test_flow_splits_of_overlapping_windows(spark):
    t = transactions(spark, [(i, 1, 100 + i, 3200.0, 1000 * i) for i in range(3)] + [(9, 2, 5, 100.0, 0)])
    s = compliance.flow_splits(t).collect()
    assert len(s) == 1 and s[0].n == 3 and s[0].risk == "High"


def test_structuring(spark):
    t = transactions(spark, [(i, 7, 100 + i, 9500.0, 3600 * i) for i in range(4)])
    assert compliance.structuring(t).first().n == 4


def test_names():
    assert names.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert names.jaro_winkler_score("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert names.jaro("", "") == 1.0 and names.jaro("a", "") == 0.0


def test_normal_functions(spark):
    rows = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999)], "p double")
    for r in rows.select("p", normal.cdf(normal.inverse(F.col("p"))).alias("q")).collect():
        assert r.q == pytest.approx(r.p, abs=2e-5)
    assert normal.quantile(0.95) == pytest.approx(1.6449, abs=1e-3)


def test_credit_risk_orders_obligors(spark):
    cols = "obligor_id long, debt_to_income double, loan_to_value double, credit_utilization double, payment_history double, employment_years double, recent_inquiries long, delinquencies long, credit_history_years double, ead double, maturity double"
    o = spark.createDataFrame([(1, 0.25, 0.6, 0.15, 95.0, 10.0, 1, 0, 15.0, 1e5, 2.5), (2, 0.55, 0.95, 0.85, 60.0, 1.0, 6, 3, 2.0, 1e5, 2.5)], cols)
    good, bad = risk.credit_scores(o).orderBy("obligor_id").collect()
    assert good.pd < bad.pd and good.rwa < bad.rwa


def test_value_at_risk(spark):
    p = spark.createDataFrame([("A", 1e5, 0.08, 0.15), ("B", 1e5, 0.10, 0.20)], "asset_id string, value double, mu double, sigma double")
    c = spark.createDataFrame([("A", "B", 0.5)], "i string, j string, rho double")
    a, b = (risk.portfolio_risk(p, c, 0.95, d).first() for d in (10, 20))
    assert a.diversification_benefit > 0 and b["var"] == pytest.approx(a["var"] * math.sqrt(2))
    parts = risk.component_var(p, c, a["var"]).collect()
    assert sum(r.component for r in parts) == pytest.approx(a["var"])
    mc = [risk.monte_carlo_var(risk.simulate_pnl(p, c, 10, 4000), 4000, q).first() for q in (0.95, 0.99)]
    assert 0 < mc[0]["var"] < mc[1]["var"] and mc[0].expected_shortfall >= mc[0]["var"]
    assert risk.monte_carlo_var(risk.simulate_pnl(p, c, 10, 4000), 4000).first() == mc[0]


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "series_id string, t long, value double")


def test_change_point(spark):
    s = series(spark, [10 + math.sin(0.1 * i) for i in range(50)] + [20 + math.sin(0.1 * i) for i in range(50)])
    for method, penalty in (("pelt", 10.0), ("binary", 50.0)):
        starts = [r.start for r in temporal.change_points(s, method, penalty, 5).orderBy("start").collect()]
        assert any(abs(x - 50) <= 2 for x in starts)


def test_anomalies_are_found(spark):
    v = [10 + math.sin(0.1 * i) for i in range(100)]
    v[25], v[75] = 50.0, -30.0
    for method, threshold in (("zscore", 3.0), ("iqr", 3.0), ("moving_average", 8.0), ("seasonal_esd", 3.0)):
        hits = {r.i for r in temporal.anomalies(series(spark, v), method, threshold).where("is_anomaly").collect()}
        assert {25, 75} <= hits


def test_arima_follows_a_line(spark):
    f = [r.forecast for r in temporal.arima_forecast(series(spark, [10 + 2 * t for t in range(50)]), 1, 1, 0, 5).orderBy("step").collect()]
    assert f == pytest.approx([110, 112, 114, 116, 118])


def test_seasonal_period(spark):
    s = series(spark, [100 + 0.5 * t + 10 * math.sin(2 * math.pi * t / 12) for t in range(60)])
    d = temporal.decompose(s, 12).orderBy("i").collect()
    assert max(x.seasonal for x in d) == pytest.approx(10, abs=1.0)
    assert all(a.seasonal == b.seasonal for a, b in zip(d, d[12:], strict=False))


def test_garch_is_stationary(spark):
    rng = np.random.default_rng(1)
    r = temporal.garch(series(spark, rng.standard_normal(300) * 0.01)).first()
    assert r.alpha + r.beta < 1 and r.omega > 0


def test_clusters(spark):
    p = spark.createDataFrame([(i, list(x)) for i, x in enumerate([(0.0, 0.0), (0.1, 0.1), (0.2, 0.0), (10.0, 10.0), (10.1, 10.1), (10.2, 10.0)])], "id long, x array<double>")
    split = lambda d: len({frozenset(r.id for r in d if r.cluster == c) for c in {r.cluster for r in d}})
    assert split(ml.kmeans(p, 2)[1].collect()) == 2
    assert {r.id: r.cluster for r in ml.dbscan(p, 0.5, 2).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    for linkage in ("single", "complete", "average", "ward"):
        assert {r.id: r.cluster for r in ml.hierarchical(p, 2, linkage).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_outlier(spark):
    p = spark.createDataFrame([(i, [0.1 * i, 0.05 * (i % 3)]) for i in range(12)] + [(99, [100.0, 100.0])], "id long, x array<double>")
    assert ml.isolation_forest(p, 50, 13).orderBy(F.col("score").desc()).first().id == 99
    assert ml.local_outlier_factor(p, 3).orderBy(F.col("lof").desc()).first().id == 99


def test_regression(spark):
    x = [(1, 1), (2, 1), (1, 2), (2, 2), (3, 1), (1, 3)]
    rows = spark.createDataFrame([([float(a), float(b)], 2.0 * a + 3 * b + 1) for a, b in x], "x array<double>, y double")
    r = ml.linear_regression(rows).first()
    assert r.coefficients == pytest.approx([2, 3]) and r.intercept == pytest.approx(1) and r.r2 == pytest.approx(1)
    assert abs(ml.ridge(rows, 10.0).first().coefficients[0]) < 2


def test_shap_values_of_a_line(spark):
    bg = [[0.0, 0.0], [2.0, 4.0]]
    rows = spark.createDataFrame([(1, [3.0, 1.0])], "id long, x array<double>")
    r = ml.shap_values(rows, bg, lambda m: m @ np.array([1.0, 2.0])).first()
    assert r["base"] == pytest.approx(5.0)
    assert r["values"] == pytest.approx([2.0, -2.0], abs=0.05)


def test_masks_cancel(spark):
    u = spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(4)], "participant long, x array<double>, n long")
    masked = ml.masked_updates(u).collect()
    assert all(abs(m.x[0] - m.participant) > 1e-6 for m in masked)
    assert sum(m.x[0] for m in masked) == pytest.approx(6)


def test_directly_follows(spark):
    log = [(c, a, 1000 * i) for c, t in (("c1", "ABCD"), ("c2", "ABCD"), ("c3", "ABED")) for i, a in enumerate(t)]
    e = spark.createDataFrame([(i, c, a, t, "r") for i, (c, a, t) in enumerate(log)], "id long, case_id string, activity string, ts long, resource string")
    assert {(r.a, r.b): r.n for r in process.directly_follows(e).collect()}["A", "B"] == 3
    net = [("A", ("s",), ("p",)), ("B", ("p",), ("q",)), ("C", ("q",), ("r",)), ("E", ("q",), ("r",)), ("D", ("r",), ("t",))]
    assert all(r.fitness == 1.0 for r in process.replay(e, net, {"s": 1}, {"t": 1}).collect())


def test_behaviour_signatures(spark):
    rows = [(i, 1, "login_attempt", 5 * i, None, None, None) for i in range(10)] + [(20 + i, 2, a, 60 * i, None, None, None) for i, a in enumerate(("reset", "login", "change"))]
    e = spark.createDataFrame(rows, "id long, user_id long, event_type string, ts long, session_id long, device_id string, location string")
    assert behavioral.match_count(e, "login_attempt", 5, 300, 80.0).first().n == 10
    assert behavioral.match_sequence(e, ["reset", "login", "change"], 90.0).first().user_id == 2
    assert behavioral.match_time_window(e, ["reset", "change"], 600, 50.0).first().span == 120


def test_liquidity_coverage_by_hand(spark):
    a = spark.createDataFrame([(1, "CashReserves", 100e3, 0.0, 0), (2, "Level1HQLA", 200e3, 0.0, 1), (3, "Level2AHQLA", 100e3, 0.15, 3)], "id long, asset_type string, amount double, haircut double, days_to_liquidate long")
    o = spark.createDataFrame([(1, "RetailDeposits", 500e3, 0.05, 30), (2, "WholesaleFunding", 200e3, 0.25, 30)], "id long, category string, amount double, runoff double, days long")
    i = spark.createDataFrame([(100e3, 0.5, 30)], "amount double, rate double, days long")
    r = treasury.lcr(a, o, i).first()
    assert (r.hqla, r.net_outflows) == (385e3, 25e3) and r.ratio == pytest.approx(15.4)


def test_cash_balance_runs(spark):
    f = spark.createDataFrame([(1, 1, 10_000.0, "x", 1.0), (2, 1, -5_000.0, "x", 1.0), (3, 2, -8_000.0, "x", 1.0)], "id long, day long, amount double, category string, certainty double")
    b = [r.balance for r in treasury.cash_forecast(f, 1, 3).orderBy("day").collect()]
    assert b == [5000.0, -3000.0, -3000.0]
    g = treasury.funding_gaps(treasury.cash_forecast(f, 1, 3), 0.0).first()
    assert (g.start, g.end, g.days, g.shortfall) == (2, 3, 2, 3000.0)


def test_duration_sums_coupons(spark):
    p = spark.createDataFrame([(1, "FixedBond", 100.0, 0.06, 3 * 365 * 86_400, None, "USD")], "id long, instrument string, notional double, rate double, maturity long, next_reset long, currency string")
    r = treasury.ir_measures(p, 0, 0.05, 2).first()
    cf = [(k, (0.03 + (k == 6)) / 1.025**k) for k in range(1, 7)]
    assert r.duration == pytest.approx(sum(k * v for k, v in cf) / sum(v for _, v in cf) / 2)


def test_netting(spark):
    t = spark.createDataFrame([(1, "AAPL", "A", "B", 100, 150, 0, 0, "Pending", "USD"), (2, "AAPL", "B", "A", 50, 151, 0, 0, "Pending", "USD"), (3, "AAPL", "A", "C", 30, 149, 0, 0, "Pending", "USD")], "id long, security_id string, buyer_id string, seller_id string, quantity long, price long, trade_date long, settlement_date long, status string, currency string")
    net = {r.party_id: r.net_quantity for r in clearing.net_positions(t).collect()}
    assert net["A"] == 80 and sum(net.values()) == 0


def test_dvp_matches_mirrored_parties(spark):
    d = spark.createDataFrame([(1, "X", 0, "A", "B", -100, -15_000, "USD", "Pending"), (2, "X", 0, "B", "A", 100, 15_000, "USD", "Pending"), (3, "X", 0, "B", "C", 100, 15_000, "USD", "Pending")], "id long, security_id string, settlement_date long, deliverer string, receiver string, quantity long, payment_amount long, currency string, status string")
    assert [(r.delivery_id, r.receipt_id) for r in clearing.match_dvp(d).collect()] == [(1, 2)]


def test_reconciliation(spark):
    cols = "id long, account_code string, amount double, currency string, date long, reference string"
    s = spark.createDataFrame([(1, "A", 1000.0, "USD", 0, ""), (2, "A", 2500.0, "USD", 0, "")], cols)
    t = spark.createDataFrame([(7, "A", 1000.0, "USD", 0, ""), (8, "A", 2500.5, "USD", 0, "")], cols)
    m = {r.source_id: r for r in accounting.reconcile(s, t, 1.0).collect()}
    assert m[1].match_type == "Exact" and m[2].target_id == 8 and m[2].match_type == "Tolerance"


def test_flow_methods(spark):
    cols = "entry_id long, line_number long, posting_date long, account_code string, debit double, credit double, entity_id string"
    j = spark.createDataFrame([(1, 1, 0, "1000", 1000.0, 0.0, "E"), (1, 2, 0, "4000", 0.0, 1000.0, "E"), (2, 1, 0, "1000", 300.0, 0.0, "E"), (2, 2, 0, "1100", 200.0, 0.0, "E"), (2, 3, 0, "4000", 0.0, 200.0, "E"), (2, 4, 0, "4100", 0.0, 300.0, "E"), (3, 1, 0, "1000", 500.0, 0.0, "E"), (3, 2, 0, "4000", 0.0, 200.0, "E"), (3, 3, 0, "4100", 0.0, 300.0, "E"), (4, 1, 0, "1000", 50.0, 0.0, "E"), (4, 2, 0, "4000", 0.0, 40.0, "E")], cols)
    f = accounting.generate_flows(j)
    assert {r.entry_id: r.method for r in f.collect()} == {1: "A", 2: "B", 3: "C", 4: "C"}
    sums = {r.entry_id: r.s for r in f.groupBy("entry_id").agg(F.sum("amount").alias("s")).collect()}
    assert sums == {1: 1000.0, 2: 500.0, 3: 500.0, 4: 50.0}
    assert {r.pattern for r in accounting.entry_pattern(j).collect()} == {"SimpleSale"}


def test_t_distribution():
    assert accounting.t_p_value(np.array([0.0, 2.228, 4.587, 12.706]), np.array([10, 10, 10, 1])) == pytest.approx([1.0, 0.05, 0.001, 0.05], abs=2e-4)


def test_orders_match_in_price_time_order():
    b = orderbook.Book()
    order = lambda i, side, price, q, trader, kind="Limit", tif="GTC": {"id": i, "symbol": 1, "side": side, "order_type": kind, "price": price, "quantity": q, "tif": tif, "ts": i, "trader": trader}
    for o in (order(1, "Buy", 100, 10, 1), order(2, "Buy", 101, 5, 2), order(3, "Sell", 100, 12, 3)):
        b.submit(o)
    assert [(t[1], t[2], t[3], t[4]) for t in b.trades] == [(2, 3, 101, 5), (1, 3, 100, 7)]
    assert b.states[1] == ("PartiallyFilled", 3) and b.states[3] == ("Filled", 0)
    b.submit(order(4, "Sell", 90, 3, 1))  # does not trade with itself
    assert b.states[4] == ("New", 3)
    b.submit(order(5, "Buy", 80, 1, 9, tif="IOC"))
    assert b.states[5] == ("Canceled", 1)
    assert b.modify(1, price=99) and b.open[1]["left"] == 3 and b.cancel(1) and not b.cancel(1)


def test_rapid_split(spark):
    t = spark.createDataFrame([(i, 1, 2, 9000.0 + i, 3600 * i, "US") for i in range(4)], "id long, source_id long, dest_id long, amount double, ts long, location string")
    assert {r.id for r in banking.rapid_split(banking.account_rows(t)).collect()} == {2, 3}


def test_payment_flows(spark):
    p = spark.createDataFrame([(str(i), a, b, float(v), "Completed", "ACH", "Normal", "USD", 0) for i, (a, b, v) in enumerate([("A", "B", 1000), ("A", "B", 500), ("B", "C", 800), ("C", "A", 600), ("A", "C", 300)])], "id string, payer_account string, payee_account string, amount double, status string, payment_type string, priority string, currency string, initiated_at long")
    f = {(r.source, r.target): r.volume for r in payments.build_flows(p).collect()}
    assert len(f) == 4 and f["A", "B"] == 1500


def test_range_and_as_of_joins(spark):
    a = spark.createDataFrame([("x", 5), ("x", 25)], "k string, t long")
    b = spark.createDataFrame([("x", 0, "p"), ("x", 20, "q")], "key string, s long, v string")
    assert {(r.t, r.v) for r in joins.range_join(a, b, [("k", "key")], "t", "s", 10).collect()} == {(5, "p"), (25, "q")}
    prices = b.select(F.col("key").alias("k"), F.col("s").alias("t"), "v")
    assert {(r.t, r.v) for r in joins.as_of_join(a, prices, "k", "t", ["v"]).collect()} == {(5, "p"), (25, "q")}


def test_many_names_score_as_one_does():
    import random

    from lakeloom.functions.names import jaro_winkler, jaro_winkler_score, jaro_winkler_scores

    rng = random.Random(1)
    names = ["", "a", "martha", "marhta", "dixon", "dicksonx", "é" * 5, "x" * 300] + ["".join(rng.choices("abc d", k=rng.randrange(12))) for _ in range(300)]
    a, b = rng.choices(names, k=2000), rng.choices(names, k=2000)
    want = [jaro_winkler_score(x, y) for x, y in zip(a, b, strict=True)]
    assert jaro_winkler_scores(a, b).tolist() == want
    assert jaro_winkler.func(pd.Series(a), pd.Series(b)).tolist() == want
    assert len(jaro_winkler_scores([], [])) == 0


def test_semantic_dedup_loses_no_pair(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((600, 48))
    y -= (x * y).sum(1)[:, None] * x
    y = 0.81 * x + (1 - 0.81**2) ** 0.5 * y / np.linalg.norm(y, axis=1)[:, None]
    v = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(np.concatenate([x, y]))], "id long, vector array<double>")
    assert {r.id for r in ml.semantic_dedup(v, 0.8, block=256).collect()} == set(range(600))


def test_entities_need_no_common_first_letter(spark):
    people = [(1, "Katherine Mills", [], 19800101, "US"), (2, "Catherine Mills", [], 19800101, "US"), (3, " Katherine Mills", [], 19800101, "US"), (4, "Wu", [], 19400101, "CN")]
    df = spark.createDataFrame(people, "id long, name string, aliases array<string>, birth_date long, country string")
    got = compliance.resolve_entities(df.where("id = 1"), df).collect()
    assert {r.entity_id for r in got} == {2, 3} and all(r.score > 0.9 for r in got)


def test_embedding_queries_read_whole_texts(spark, tmp_path):
    from lakeloom.plans import registry

    head = " ".join(f"w{i}" for i in range(64))
    rows = [(1, 0, "user", head), (1, 1, "user", head + " another ending")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for pool in ("mean", "max", "attention"):
        a, b = registry.queries()[f"ml_embed_{pool}"](spark, str(tmp_path)).orderBy("id").collect()
        assert (a.v0, a.v63) != (b.v0, b.v63)
    cut = ml.embed(spark.createDataFrame([(1, head), (2, head + " another ending")], "id long, text string"), 64, longest=64).orderBy("id").collect()
    assert cut[0].vector == cut[1].vector


def test_moving_averages_are_recovered():
    rng = np.random.default_rng(1)
    for theta in ([0.6], [-0.5], [0.5, 0.3], [-0.8, 0.2]):
        e = rng.standard_normal(6_000)
        x = e.copy()
        for j, t in enumerate(theta, 1):
            x[j:] += t * e[:-j]
        assert temporal.fit_ma(x, len(theta)) == pytest.approx(theta, abs=0.06)
    assert (temporal.fit_ma(np.ones(40), 2) == 0).all() and (temporal.fit_ma(np.arange(2.0), 1) == 0).all()


def test_garch_is_recovered_and_likelier_than_its_neighbours():
    rng = np.random.default_rng(1)
    v, x = 1.0, []
    for _ in range(6_000):
        x.append(rng.standard_normal() * v**0.5)
        v = 0.1 + 0.1 * x[-1] ** 2 + 0.8 * v
    x = np.array(x)
    omega, alpha, beta = temporal.fit_garch(x)
    assert (omega, alpha, beta) == pytest.approx((0.1, 0.1, 0.8), abs=0.06)
    best, var = temporal._garch_scores(x, x.var(ddof=1), alpha, beta)[0], x.var(ddof=1)
    assert all(temporal._garch_scores(x, var, alpha + a, beta + b)[0] <= best + 1e-6 for a, b in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)))


def test_forecast_goes_on_with_a_trend(spark):
    rng = np.random.default_rng(2)
    v = [100 + 2 * t + rng.standard_normal() for t in range(60)]
    for q in (0, 1):
        f = [r.forecast for r in temporal.arima_forecast(series(spark, v), 1, 1, q, 5).orderBy("step").collect()]
        assert len(f) == 5 and all(x > 0.8 * v[-1] for x in f) and f[-1] > f[0]


def test_change_points_are_the_best_partition(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.standard_normal(n) + m for n, m in ((12, 0), (9, 6), (14, 1), (10, 9))])
    penalty, least = 8.0, 3
    cost = lambda a, b: float(((v[a:b] - v[a:b].mean()) ** 2).sum())
    best = {0: (-penalty, [])}
    for e in range(least, len(v) + 1):
        options = [(best[s][0] + cost(s, e) + penalty, [*best[s][1], s]) for s in best if e - s >= least]
        if options:
            best[e] = min(options)
    got = [r.start for r in temporal.change_points(series(spark, v), "pelt", penalty, least).orderBy("start").collect()]
    assert got == best[len(v)][1]


def _entry(spark, *lines):
    rows_ = [(1, i, a, float(d), float(c), e) for i, (a, d, c, e) in enumerate(lines, 1)]
    return spark.createDataFrame(rows_, "entry_id long, line_number long, account_code string, debit double, credit double, entity_id string").withColumn("posting_date", F.lit(1_700_000_000).cast("long"))


def test_value_added_tax(spark):
    split = lambda *v: [tuple(r) for r in accounting.vat_splits(spark.createDataFrame([(1, float(x)) for x in v], "entry_id long, amount double")).collect()]
    assert split(1000, 1200) == [(1, 1000.0, 200.0, 0.2, "UK", "Standard")] and split(1190, 1000, 3)[0][3:5] == (0.19, "DE") and split(1000, 1421) == []
    sale = accounting.vat_patterns(_entry(spark, ("1000", 1200, 0, "A"), ("4000", 0, 1000, "A"), ("VAT_PAYABLE", 0, 200, "A"))).first()
    assert (sale.is_output, sale.net, sale.tax, sale.rate, sale.tax_accounts) == (True, 1000.0, 200.0, 0.2, ["VAT_PAYABLE"])
    buy = accounting.vat_patterns(_entry(spark, ("5000", 1000, 0, "A"), ("INPUT_TAX", 123, 0, "A"), ("2000", 0, 1123, "A"))).first()
    assert (buy.is_output, buy.net, buy.place) == (False, 1000.0, "Generic") and buy.rate == pytest.approx(0.123)


def test_patterns_between_entities(spark):
    pattern = lambda *v: accounting.transaction_pattern(_entry(spark, *v)).first().pattern
    assert pattern(("1000", 5000, 0, "A"), ("4000", 0, 5000, "B")) == "Intercompany"
    assert pattern(("1000", 500, 0, "A"), ("4000", 0, 500, "A")) == "SimpleSale"
    assert pattern(("1000", 1200, 0, "A"), ("4000", 0, 1000, "A"), ("VAT", 0, 200, "A")) == "SaleWithVat"
    assert pattern(("5000", 500, 0, "A"), ("2000", 0, 500, "A")) == "SimplePurchase"
    assert pattern(("2000", 500, 0, "A"), ("1000", 0, 500, "A")) == "Payment"


def test_subsets_of_credits():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(60):
        v = rng.integers(1, 40, rng.integers(1, 9)).astype(float).tolist()
        target = float(rng.integers(1, 80))
        got = accounting._subset(v, target, 0.01)
        there = any(abs(sum(c) - target) <= 0.01 for n in range(1, len(v) + 1) for c in itertools.combinations(v, n))
        assert (got is not None) == there and (got is None or abs(sum(v[i] for i in got) - target) <= 0.01)
    assert accounting._subset([50.0, *[1.0] * 20], 52.0, 0.01) == [0, 1, 2]


def test_large_entries_are_taken_apart_by_entity(spark):
    lines = [(f"1{i:03}", 10, 0, "A") for i in range(12)] + [("4000", 0, 70, "A"), ("4001", 0, 50, "A"), ("5000", 30, 0, "B"), ("2000", 0, 30, "C"), *((f"6{i}", 1, 0, "C") for i in range(8)), ("2001", 0, 8, "C")]
    e = accounting.generate_flows(_entry(spark, *lines), aggregate=False)
    f = {(r.from_account, r.to_account): r.amount for r in e.collect()}
    assert {r.method for r in e.collect()} == {"E"} and {r.confidence for r in e.collect()} == {0.5}
    assert f["4000", "1000"] == pytest.approx(10 * 70 / 120) and ("2000", "1000") not in f
    assert f["4000", "5000"] == pytest.approx(30 * 70 / 158) and f["2000", "60"] == pytest.approx(30 / 38)
    none = accounting.generate_flows(_entry(spark, *lines), aggregate=False, decompose=False).collect()
    assert all("SUSPENSE" in (r.from_account, r.to_account) and r.confidence == 0 for r in none)
    assert {r.method for r in accounting.generate_flows(_entry(spark, *lines)).collect()} == {"D"}


def test_people_with_dates_and_countries_in_common(spark, capsys):
    rng = np.random.default_rng(6)
    some = lambda of: None if rng.random() < 0.2 else of[int(rng.integers(len(of)))]
    people = [(i, some(["Ann Lee", "Anne Leigh", "Bo", "", "x" * 70]), [some(["A. Lee", "Bo Li"])] if i % 3 else None, some([19800101, 19800131, 19820101]), some(["US", "CN"])) for i in range(60)]
    df = spark.createDataFrame(people, "id long, name string, aliases array<string>, birth_date long, country string")
    got = compliance.resolve_entities(df.where("id % 4 = 0"), df, top=5)
    got.explain()
    assert "ArrowEvalPython" not in capsys.readouterr().out  # pairs are scored in blocks, not one row each

    def rest(a, b):
        x, y = a[3], b[3]
        day = 0.0 if x is None or y is None else 1.0 if x == y else 0.9 if x // 100 == y // 100 else 0.5
        return (day * 0.25 or 0.125) + (0.15 if a[4] is not None and a[4] == b[4] else 0.0)

    known = lambda p: {(x or "").lower() for x in (p[1], *(p[2] or []))}
    want = []
    for a in people[::4]:
        scores = [(max(names.jaro_winkler_score(x, y) for x in known(a) for y in known(b)) * 0.6 + rest(a, b), -b[0]) for b in people if b[0] != a[0]]
        want += [(a[0], -minus, round(s, 9)) for s, minus in sorted(x for x in scores if x[0] >= 0.7)[-5:]]
    assert sorted((r.query_id, r.entity_id, round(r.score, 9)) for r in got.collect()) == sorted(want)


def test_squares_without_ways_of_three_edges(spark):
    import collections

    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in zip(rng.integers(0, 14, 70), rng.integers(0, 14, 70) ** 2 // 14, strict=True) if a != b}
    pairs |= {(20, i) for i in range(14)} | {(i, 21) for i in range(14)} | {(20, 21), (21, 22), (22, 23)}  # a node of many edges
    out = collections.defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    want = collections.Counter()
    for u, v in pairs:
        for w in out[v] - {u}:
            for x in out[w] - {u, v}:
                if x in out[u]:
                    want.update((u, v, w, x))
    e = edges(spark, sorted(pairs))
    assert {r.id: r.n for r in graph._squares(e).groupBy("id").agg(F.sum("n").alias("n")).collect()} == dict(want)
    got = {r.id: r.c4 for r in graph.cycle_counts(edges(spark, [*sorted(pairs), *sorted(pairs)[:5], (3, 3)]), nodes(spark, 24)).collect()}
    assert got == {i: want[i] // 4 for i in range(24)}


def test_recent_flows(spark):
    f = accounting.dated_flows(accounting.generate_flows(_entry(spark, ("1000", 5, 0, "A"), ("4000", 0, 5, "A"))), _entry(spark, ("1000", 5, 0, "A")))
    assert accounting.recent_flows(f, "1000", 0, 1 << 40, 100).count() == 1 and accounting.recent_flows(f, "1000", 0, 5, 100).count() == 0
    assert accounting.flows_between(f, 1_700_000_000, 1_700_000_000).count() == 1


def test_orders_are_cancelled_and_modified(spark):
    o = lambda i, side, price, n, ts, action="submit": (i, "S", side, "Limit", price, n, "GTC", ts, i, action)
    rows_ = [o(1, "Buy", 10, 5, 1), o(2, "Buy", 11, 5, 2), o(2, "Buy", 11, 5, 3, "cancel"), o(3, "Buy", 9, 4, 4), o(3, "Buy", 12, 6, 5, "modify"), o(4, "Sell", 10, 8, 6), o(9, "Buy", 1, 1, 7, "cancel")]
    orders = spark.createDataFrame(rows_, "id long, symbol string, side string, order_type string, price long, quantity long, tif string, ts long, trader long, action string")
    assert [tuple(r)[1:6] for r in orderbook.match_orders(orders).collect()] == [(1, 3, 4, 12, 6), (2, 1, 4, 10, 2)]
    assert {r.id: (r.status, r.remaining) for r in orderbook.order_states(orders).collect()} == {1: ("PartiallyFilled", 3), 2: ("Canceled", 5), 3: ("Filled", 0), 4: ("Filled", 0)}


def test_standard_signatures(spark):
    e = [(i, 1, "login_attempt", 1000 + 5 * i) for i in range(10)] + [(20, 2, "password_reset", 0), (21, 2, "login", 60), (22, 2, "profile_change", 120), (30, 3, "bought gift.*card", 5)]
    events = spark.createDataFrame(e, "id long, user_id long, event_type string, ts long")
    got = {(r.signature, r.user_id): r.score for r in behavioral.match_signatures(events).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 3)} and got[2, 2] == 90.0
    assert behavioral.standard_signatures(spark).count() == 4


def test_liquidity_actions_mend_the_buffer(spark):
    assets = spark.createDataFrame([(1, "Level1HQLA", 10.0, 0.0, 1), (2, "Illiquid", 100.0, 0.1, 90)], "id long, asset_type string, amount double, haircut double, days_to_liquidate long")
    out = spark.createDataFrame([(1, "CommittedFacilities", 100.0, 0.5, 10)], "id long, category string, amount double, runoff double, days long")
    inflow = spark.createDataFrame([(0.0, 0.5, 10)], "amount double, rate double, days long")
    funding = spark.createDataFrame([(1, "WholesaleDeposit", 40.0, 100, False)], "id long, funding_type string, amount double, days long, stable boolean")
    actions = treasury.optimise_liquidity(assets, out, inflow, funding)
    got = {(r.ratio, r.action): (r.amount, r.impact, r.cost) for r in actions.collect()}
    assert got["LCR", "ConvertToHQLA"] == pytest.approx((40.0, 36.0, 0.4)) and got["LCR", "ReduceCommitment"] == pytest.approx((10.0, 5.0, 0.05))
    assert got["NSFR", "IssueTerm"] == pytest.approx((40.0, 20.0, 40 * 0.02 * 265 / 365)) and got["NSFR", "SellIlliquid"] == pytest.approx((80.0, 80.0, 8.0))
    better = treasury.lcr_improvement(assets, out, inflow, actions.where("ratio = 'LCR'")).first()
    assert (better.before, better.after, better.improvement) == pytest.approx((-40.0, 5.0, 45.0))


def test_value_at_risk_after_updates(spark):
    p = spark.createDataFrame([("a", 100.0, 0.0, 0.2), ("b", 50.0, 0.0, 0.3)], "asset_id string, value double, mu double, sigma double")
    corr = spark.createDataFrame([("a", "b", 0.5)], "i string, j string, rho double")
    more = spark.createDataFrame([("b", 500.0, 0.0, 0.3), ("c", 10.0, 0.0, 0.1)], p.schema)
    var = lambda u: risk.recalculated_var(p, u, corr, n=4_000).first()["var"]
    assert var(more) > 3 * var(more.limit(0))
    assert {r.asset_id for r in risk.upsert_positions(p, spark.createDataFrame([("a", 0.0, 0.0, 0.2)], p.schema)).collect()} == {"b"}


def test_rounds_of_federated_learning(spark):
    u = spark.createDataFrame([("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 1), ("c", [1.0, 1.0], 2)], "participant string, x array<double>, n long")
    model = spark.createDataFrame([(0, 10.0), (1, 20.0)], "feature int, value double")
    step = {r.feature: r.value - r.before for r in ml.simulate_round(model, u, clip=100.0).collect()}
    assert step == pytest.approx({0: 0.75, 1: 0.75})
    assert ml.aggregation_is_sound(u, ml.secure_aggregate(u)).first().sound
    assert not ml.aggregation_is_sound(u, ml.secure_aggregate(u).limit(1)).first().sound
    assert {r.value - r.before for r in ml.simulate_round(model, u.limit(2)).collect()} == {0.0}


def test_circular_share_of_an_entity(spark):
    tx = spark.createDataFrame([(1, 2, 10.0), (2, 1, 5.0), (2, 3, 15.0), (4, 4, 7.0)], "source_id long, dest_id long, amount double")
    assert {r.entity_id: (r.ratio, r.groups, r.amount) for r in compliance.entity_circularity(tx).collect()} == {1: (1.0, 1, 10.0), 2: (0.25, 1, 5.0), 3: (0.0, 0, 0.0), 4: (0.0, 0, 0.0)}


def test_drug_triplets(spark):
    drugs = spark.createDataFrame([(1, ["t1"], [1.0, 0.0]), (2, ["t1"], [1.0, 0.0]), (3, ["t2"], [0.0, 1.0])], "drug long, targets array<string>, mechanism array<double>")
    r = ml.drug_triplets(spark.createDataFrame([(7, [3, 1, 2, 1])], "patient long, drugs array<long>"), drugs).first()
    assert (r.a, r.b, r.c, r.severity) == (1, 2, 3, "Minor") and r.risk == pytest.approx(1 / 3 * 0.4 + 1 / 3 * 0.6)


@pytest.mark.parametrize("k", [1, 7, 50, 300, 2_999])
def test_kth_largest(spark, k):
    v = np.concatenate([np.random.default_rng(1).random(2_000), np.full(1_000, 0.5)])
    assert ml._kth_largest(spark.createDataFrame([(float(x),) for x in v], "s double"), "s", k, 0.0, 1.0, bins=64) == np.sort(v)[::-1][k - 1]


def test_rounds_that_do_not_settle_are_errors(spark):
    from lakeloom.operators import iterate

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        iterate.components(chain, limit=1)
    e = edges(spark, [(i, i + 1) for i in range(12)], both=True)
    with pytest.raises(RuntimeError):
        graph.distances(e, nodes(spark, 1), limit=5).count()
    with pytest.raises(RuntimeError):
        graph.path_between(e, 0, 11, limit=5)
    assert graph.path_between(e, 0, 11).first().hops == 11


def test_entities_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    names_ = ["".join(rng.choice(list("abcde"), 6)) for _ in range(60)]
    people = [(i, names_[i], [names_[(i * 7) % 60]] if i % 3 else None, int(19700101 + i % 4 * 10000 + i % 5 * 100) if i % 11 else None, i % 3) for i in range(60)]
    df = spark.createDataFrame(people, "id long, name string, aliases array<string>, birth_date long, country long")
    date = lambda a, b: 0.0 if a is None or b is None else 1.0 if a == b else 0.9 if a // 100 == b // 100 else {0: 0.7, 1: 0.5, 2: 0.5, 3: 0.3, 4: 0.3, 5: 0.3}.get(abs(a // 10000 - b // 10000), 0.0)
    want = []
    for q in people[::5]:
        scores = []
        for c in people:
            if c[0] != q[0]:
                s = max(names.jaro_winkler_score(x, y) for x in [q[1], *(q[2] or [])] for y in [c[1], *(c[2] or [])])
                d = date(q[3], c[3])
                scores.append((-(s * 0.6 + (d * 0.25 if d > 0 else 0.125) + (0.15 if q[4] == c[4] else 0)), c[0]))
        want += [(q[0], c, round(-v, 9)) for v, c in sorted(scores)[:4] if -v >= 0.7]
    got = [(r.query_id, r.entity_id, round(r.score, 9)) for r in compliance.resolve_entities(df.where("id % 5 = 0"), df, top=4).collect()]
    assert sorted(got) == sorted(want)


def test_soft_votes_of_classes_with_equal_terms(spark):
    # 0.3 + 0.2 + 0.1 < 0.1 + 0.2 + 0.3 in floating point
    p = [(i, m, [0.0, x, y]) for i in range(20) for m, (x, y) in enumerate(((0.3, 0.1), (0.2, 0.2), (0.1, 0.3)))]
    a, b = (spark.createDataFrame(rows, "sample int, model int, p array<double>").coalesce(1) for rows in (p, p[::-1]))
    for rows in (a, b):
        got = ml.soft_vote(rows).collect()
        assert len(got) == 20 and {r["class"] for r in got} == {1} and {r.probability for r in got} == {0.6000000000000001 / 3}
    # a model counts for the classes that it has
    short = spark.createDataFrame([(1, 0, [0.2, 0.8]), (1, 1, [0.9])], "sample int, model int, p array<double>")
    assert [tuple(r) for r in ml.soft_vote(short).collect()] == [(1, 1, 0.8)]


def test_all_pairs_are_those_of_the_level_by_level_search(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a) * 3, int(b) * 3) for a, b in rng.integers(0, 90, (200, 2)) if a != b] + [(600, 603), (603, 606), (0, 900)]
    e, n = edges(spark, pairs), spark.range(100).select((F.col("id") * 3).alias("id"))  # not all ends are nodes
    old = {(r.source, r.id): (r.hops, r.paths) for r in graph.distances(e, n).collect()}
    assert old == {(r.source, r.id): (r.hops, r.paths) for r in graph.all_distances(e, n).collect()}
    counts = {}
    for (s, _), (h, _p) in old.items():
        counts[s, h] = counts.get((s, h), 0) + 1
    reached = graph.reached_by_hops(e, n)
    assert counts == {(r.source, r.hops): r.n for r in reached.collect()}
    # no plan has a shuffle of pairs: a row a source and level is all that leaves a task
    assert "Join" not in reached._jdf.queryExecution().toString()
    share = {}
    for (s, v), (h, k) in old.items():
        for (v2, t), (h2, k2) in old.items():
            if v2 == v and h and h2 and (s, t) in old and old[s, t][0] == h + h2:
                share[v] = share.get(v, 0.0) + k * k2 / old[s, t][1]
    got = {r.id: r.score for r in graph.betweenness_centrality(e, n, normalized=False).collect()}
    assert len(got) == 100 and all(got[v] == pytest.approx(share.get(v, 0.0)) for v in got)


def test_sources_that_do_not_fit_at_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "_SOURCE_BYTES", 1)
    ring = edges(spark, [(i, (i + 1) % 200) for i in range(200)])
    assert {tuple(r)[1:] for r in graph.reached_by_hops(ring, nodes(spark, 200)).collect()} == {(h, 1) for h in range(200)}
    assert {r.score for r in graph.betweenness_centrality(ring, nodes(spark, 200), normalized=False).collect()} == {199 * 198 / 2}


def test_order_states_go_out_as_orders_end():
    o = lambda i, side, price, q, trader=1, action="submit": {"id": i, "symbol": "x", "side": side, "order_type": "Limit", "price": price, "quantity": q, "tif": "GTC", "ts": i, "trader": trader, "action": action}
    seen = []

    def rows():
        for x in (o(1, "Buy", 10, 5), o(2, "Sell", 10, 5, 2), o(3, "Buy", 9, 4), o(1, "Buy", 8, 7), o(3, "Buy", 9, 4, action="cancel")):
            seen.append(x["id"])
            yield x

    states = orderbook._states(("x",), rows())
    assert next(states)[1:4] == (1, "Filled", 0) and len(seen) == 2
    assert [s[1:4] for s in states] == [(2, "Filled", 0), (3, "Canceled", 4), (1, "New", 7)]
    assert [t[1:] for t in orderbook._trades(("x",), rows())] == [(1, 1, 2, 10, 5, 2)]


def test_the_path_of_one_point_is_that_of_many():
    x = np.random.default_rng(1).random((300, 3))
    for tree in ml.grow_trees(x, 5, 64, 1):
        assert [ml.path_length(tree, p.tolist()) for p in x] == ml.path_lengths(tree, x).tolist()


def _made_series(spark):
    rng = np.random.default_rng(5)
    common = rng.normal(size=80)
    rows = [(f"s{i}", t, float(1e6 + 50 * (common[t] * (i % 3) + rng.normal()))) for i in range(30) for t in range(80) if rng.random() < 0.8]
    rows += [("flat", t, 7.0) for t in range(80)] + [("few", t, float(t * t)) for t in range(9)]
    return spark.createDataFrame(rows, "series_id string, t long, value double")


def test_correlations_by_blocks_are_those_of_a_join(spark):
    s = _made_series(spark)
    x, y = (s.select(F.col("series_id").alias(n), "t", F.col("value").alias(f"v{n}")) for n in "ab")
    joined = x.join(y, "t").where("a < b AND a <> 'flat' AND b <> 'flat'").groupBy("a", "b").agg(F.corr("va", "vb").alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 10 AND r IS NOT NULL")
    want = {(r.a, r.b): (r.r, r.n) for r in joined.collect()}
    made = accounting._block_pairs
    for block in (256, 7):
        accounting._block_pairs = lambda *a, block=block, **k: made(*a, block=block, **k)
        try:
            got = accounting.account_correlations(s)
            rows = {(r.a, r.b): (r.r, r.n) for r in got.collect()}
            odd = {(r.series_id, r.t): r.z for r in accounting.point_anomalies(s, 0.2).collect()}
        finally:
            accounting._block_pairs = made
        assert rows.keys() == want.keys() and all(rows[k] == (pytest.approx(want[k][0], abs=1e-9), want[k][1]) for k in want)
        assert "SortMergeJoin" not in got._jdf.queryExecution().toString()  # none on time, whose groups are pairs
        p = s.toPandas().pivot(index="t", columns="series_id", values="value").drop(columns="flat")
        z = (p - p.mean()) / p.std()
        expected = {a: pd.DataFrame({b: z[b] * want[min(a, b), max(a, b)][0] for b in z if b != a and (min(a, b), max(a, b)) in want and abs(want[min(a, b), max(a, b)][0]) >= 0.2}).mean(axis=1) for a in z}
        brute = {(a, t): z[a][t] - v for a, e in expected.items() for t, v in e.items() if abs(z[a][t] - v) > 2}
        assert odd.keys() == brute.keys() and all(odd[k] == pytest.approx(brute[k]) for k in brute)


def test_p_values_of_many_pairs():
    t, df = np.array([0.0, 1.0, 2.5, 12.0, 1.0, 3.0]), np.array([8.0, 8.0, 8.0, 8.0, 98.0, 150.0])
    assert accounting.t_p_value(t, df) == pytest.approx([1.0, 0.346594, 0.036938, 2.1e-6, 0.319771, 0.0027], abs=1e-5)
    assert len(accounting.t_p_value(np.array([]), np.array([]))) == 0
    began = time.perf_counter()
    accounting.t_p_value(np.linspace(0, 5, 200_000), np.full(200_000, 40.0))
    assert time.perf_counter() - began < 30  # one call of the fraction a pair took minutes


def test_masks_of_many_participants_cancel(spark):
    u = spark.range(700).select(F.col("id").alias("participant"), F.array(F.col("id") * 0.5, F.lit(1.0)).alias("x"), F.lit(1).alias("n"))
    m = ml.masked_updates(u)
    assert "Cartesian" not in m._jdf.queryExecution().toString() and "NestedLoop" not in m._jdf.queryExecution().toString()
    rows = m.collect()
    assert len(rows) == 700 and [sum(r.x[i] for r in rows) for i in range(2)] == pytest.approx([0.5 * 700 * 699 / 2, 700.0])
    assert np.std([r.x[1] for r in rows]) > 5  # of 699 masks in [-1, 1)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, ml.masked_updates(u.repartition(5)).collect()))


def test_folds_over_nodes_with_few_and_many_neighbours():
    rng = np.random.default_rng(4)
    e = np.unique(np.concatenate([rng.integers(0, 40, (60, 2)), np.stack([np.full(40, 3), np.arange(40)], 1), np.stack([np.arange(40), np.full(40, 5)], 1)]), axis=0).astype(np.int32)
    g, x = graph._Adjacency(np.arange(50), e[:, 0], e[:, 1]), rng.random((50, 3))
    into, out = (np.stack([x[e[e[:, k] == i, 1 - k]].sum(axis=0) for i in range(50)]) for k in (1, 0))
    assert np.allclose(g.pull(x), into) and np.allclose(g.push(x), out)
    bits = rng.integers(0, 1 << 62, (50, 2)).astype(np.uint64)
    assert all((g.pull(bits, np.bitwise_or)[i] == np.bitwise_or.reduce(bits[e[e[:, 1] == i, 0]], axis=0)).all() for i in range(50))
    assert len(g._pull[1]) == 8 and len(g._pull[2])  # short and long runs
    assert not graph._Adjacency(np.arange(2), e[:0, 0], e[:0, 1]).pull(np.ones((2, 1))).any()


def _slow_history(rows, i, window):
    return [x for x in rows if x[0] == rows[i][0] and rows[i][4] - window <= x[4] < rows[i][4]]


def test_bank_patterns_against_plain_python_and_a_busy_account(spark):
    rng = np.random.default_rng(5)
    tx = [(i, int(a), int(b), float(v), int(t)) for i, (a, b, v, t) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 9, 300), rng.integers(60, 110, 300), rng.integers(0, 120, 300), strict=True))]
    rows = banking.account_rows(spark.createDataFrame([(*x, "US") for x in tx], "id long, source_id long, dest_id long, amount double, ts long, location string"))
    plain = [(a, b, i, v, t, True) for i, a, b, v, t in tx] + [(b, a, i, v, t, False) for i, a, b, v, t in tx]
    split, layer, circle = {}, {}, set()
    for k, (a, b, i, v, t, out) in enumerate(plain):
        if out:
            before = _slow_history(plain, k, 15)
            near = [x[3] for x in before if x[5] and 80 <= x[3] < 100] + [v] * (80 <= v < 100)
            if len(near) >= 3:
                split[i] = 80.0 if sum(near) > 100 else 60.0
            n = len({x[1] for x in before} | {a, b})
            if n >= 6:
                layer[i] = min(n * 10.0, 90.0)
            sent = [x for x in before if x[5]] + [(a, b, i, v, t, True)]
            if any(x[1] == y[1] for x in sent for y in before if not y[5]):
                circle.add(i)
    assert {r.id: r.score for r in banking.rapid_split(rows, 15, 100.0).collect()} == split
    assert {r.id: r.score for r in banking.layering(rows, 15).collect()} == layer
    assert {r.id for r in banking.circular_flow(rows, 15).collect()} == circle
    busy = spark.range(120_000).select("id", F.lit(0).cast("long").alias("source_id"), (F.col("id") % 5000 + 1).alias("dest_id"), F.lit(90.0).alias("amount"), F.col("id").alias("ts"), F.lit("US").alias("location"))
    start = time.time()
    rows = banking.account_rows(busy)
    assert banking.rapid_split(rows, 50_000, 100.0).count() == 119_998
    assert banking.layering(rows, 50_000).count() == 119_996
    assert banking.circular_flow(rows, 50_000).count() == 0
    assert time.time() - start < 60


def test_event_correlation_against_plain_python_and_copies(spark):
    rng = np.random.default_rng(3)
    ev = [(i, int(u), int(t), int(s), f"d{d}" if d else None, f"l{p}") for i, (u, t, s, d, p) in enumerate(zip(rng.integers(0, 12, 250), rng.integers(0, 2_000, 250), rng.integers(0, 9, 250), rng.integers(0, 3, 250), rng.integers(0, 3, 250), strict=True))]
    df = spark.createDataFrame(ev, "id long, user_id long, ts long, session_id long, device_id string, location string")
    weights = list(behavioral.WEIGHTS.values())

    def pairs(least):
        for a in ev:
            for b in ev:
                gap = a[2] - b[2]
                if a[0] != b[0] and abs(gap) <= 400:
                    score = (1 - abs(gap) / 400) * weights[0]
                    for k, w in zip((1, 3, 4, 5), weights[1:], strict=True):
                        score += w if a[k] is not None and a[k] == b[k] else 0.0
                    if score / sum(weights) >= least:
                        yield a[0], -score / sum(weights), b[0], gap

    for least, queries in ((0.4, None), (0.1, df.where("id % 3 = 0"))):
        want, n = [], {}
        for a, s, b, gap in sorted(pairs(least)):
            n[a] = n.get(a, 0) + 1
            if n[a] <= 4 and (queries is None or a % 3 == 0):
                want.append((a, b, round(-s, 12), gap))
        got = [(r.id, r.other, round(r.score, 12), r.gap) for r in behavioral.correlate(df, 400, least, 4, queries).collect()]
        assert sorted(got) == sorted(want)
    for least in (0.7, 0.15):
        label = {x[0]: x[0] for x in ev}
        links = [(a, b) for a, _, b, _ in pairs(least)]
        for _ in range(60):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        sizes = {x: list(label.values()).count(x) for x in set(label.values())}
        assert {r.label: r.size for r in behavioral.event_clusters(df, 400, least).collect()} == {k: v for k, v in sizes.items() if v > 1}
    # 70 copies at one time would crowd out an event that links two groups
    copies = spark.range(141).select("id", F.lit(1).alias("user_id"), F.when(F.col("id") < 70, 0).when(F.col("id") < 140, 600).otherwise(300).cast("long").alias("ts"), F.lit(1).alias("session_id"), F.lit("d").alias("device_id"), F.lit("l").alias("location"))
    assert [r.size for r in behavioral.event_clusters(copies, 400, 0.8).collect()] == [141]


def test_neighbours_and_clusters_by_blocks(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.integers(0, 40, (160, 3)) / 4, np.zeros((40, 3))])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    near = (d <= 1.0) & ~np.eye(200, dtype=bool)
    assert sorted(map(tuple, ml.neighbour_pairs(p, 1.0).collect())) == [(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)]
    core = near.sum(1) + 1 >= 3
    label = np.arange(200)
    for _ in range(200):
        for i in np.flatnonzero(core):
            label[i] = min(label[i], label[near[i] & core].min(initial=200))
    want = {i: int(label[i]) if core[i] else int(label[near[i] & core].min(initial=200)) for i in range(200)}
    assert {r.id: r.cluster for r in ml.dbscan(p, 1.0, 3).collect()} == {i: -1 if c == 200 else c for i, c in want.items()}
    for metric in ("euclidean", "cosine", "manhattan", "chebyshev"):
        far = ml._distances(x, x, metric)
        np.fill_diagonal(far, np.inf)
        want = sorted((i, r + 1, int(j)) for i in range(200) for r, j in enumerate(np.lexsort((np.arange(200), far[i].round(12)))[:4]))
        got = ml.knn(p, 4, metric, block=64).select("id", "rank", "other", "distance").collect()
        assert np.allclose(sorted((r.id, r.rank, r.distance) for r in got), sorted((i, r, far[i, j]) for i, r, j in want))
        assert metric == "cosine" or sorted((r.id, r.rank, r.other) for r in got) == want
    # blocks are compared by a product of matrices, and a cell of many points is counted without a list of pairs
    v = rng.normal(size=(12_000, 64))
    start = time.time()
    n = ml._Nearest(np.arange(2_000), v[:2_000], 5, "euclidean", False)
    for i in range(0, 12_000, 2_000):
        n.add(np.arange(i, i + 2_000), v[i : i + 2_000])
    assert time.time() - start < 10 and len(n.d) == 10_000
    assert ml.dbscan(spark.range(6_000).select("id", F.array(F.lit(1.0), F.col("id") / 6_000).alias("x")), 2.0, 3).groupBy("cluster").count().collect()[0]["count"] == 6_000


def test_screening_by_tables_of_names(spark):
    rng = np.random.default_rng(4)
    some = lambda n, most: ["".join(rng.choice(list("abcé "), int(rng.integers(0, most)))) for _ in range(n)]
    plain = some(150, 12) + some(5, 90) + ["", "abc"]
    table = names.NameTable(plain)
    for name in [*some(60, 12), *some(5, 90), "", "abc"]:
        want = np.array([names.jaro_winkler_score(name, x) for x in plain])
        assert table.scores(name).tolist() == want.tolist()
        got = table.scores(name, 0.8)
        assert np.array_equal(got[want >= 0.8], want[want >= 0.8])
    asked, listed = some(40, 9), [(i, x, y) for i, (x, y) in enumerate(zip(some(300, 9), some(300, 9), strict=True))]
    q = spark.createDataFrame(list(enumerate(asked)), "id long, name string")
    w = spark.createDataFrame([(i, x, [y]) for i, x, y in listed], "id long, name string, aliases array<string>")
    score = names.jaro_winkler_score
    want = []
    for i, name in enumerate(asked):
        best = sorted((-max((s := score(name, x)), (t := score(name, y))), e, max(z for z, v in ((x, s), (y, t)) if v == max(s, t))) for e, x, y in listed)
        want += [(i, e, -s, z) for s, e, z in best[:5] if -s >= 0.7]
    assert sorted((r.query_id, r.entry_id, r.score, r.matched_name) for r in compliance.screen(q, w, top=5).collect()) == sorted(want)
    p = w.select("id", "name", (F.col("id") % 3).alias("level"))
    want = []
    for i, name in enumerate(asked):
        want += [(i, e, k, -s) for s, k, e in sorted((-score(name, x), e % 3, e) for e, x, _ in listed)[:5] if -s >= 0.7]
    assert sorted((r.query_id, r.entry_id, r.level, r.score) for r in compliance.screen_pep(q, p, top=5).collect()) == sorted(want)
    big = names.NameTable([f"customer#{i:09d}" for i in range(4_096)])
    start = time.time()
    for i in range(100):
        big.scores(f"customer#{i * 7:09d}", 0.9)
    assert time.time() - start < 10


def test_duplicate_items_of_a_busy_account(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "A", "USD", int(k), float(v) / 100, int(d) * 86_400) for i, (k, v, d) in enumerate(zip(rng.integers(0, 3, 120), rng.integers(0, 12, 120), rng.integers(0, 200, 120), strict=True))]
    rows.append((500, "A", "USD", None, 0.0, 0))
    label = {r[0]: r[0] for r in rows}
    pairs = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[3] is not None and x[3] == y[3] and abs(x[4] - y[4]) <= 0.01 and abs(x[5] - y[5]) <= 7 * 86_400]
    for _ in range(120):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(rows, "id long, account_code string, currency string, reference long, amount double, date long")
    assert {r.id: r.group for r in accounting.duplicate_items(df).collect()} == {x: label[x] for x in {i for p in pairs for i in p}}
    busy = spark.range(60_000).select("id", F.lit("A").alias("account_code"), F.lit("USD").alias("currency"), F.lit(1).alias("reference"), F.lit(5.0).alias("amount"), F.col("id").alias("date"))
    start = time.time()
    assert accounting.duplicate_items(busy).count() == 60_000
    assert time.time() - start < 90
