"""Anti-money-laundering patterns, customer scoring, screening and monitoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakeloom.functions.names import NameTable
from lakeloom.operators.graph import strong_components
from lakeloom.operators.groupmap import ordered_groups
from lakeloom.operators.joins import range_join
from lakeloom.storage import materialise


def circular_flow(tx: DataFrame, min_amount: float = 0.0) -> DataFrame:
    """label, size and amount of each strongly connected group of over one account, if the amount
    that moves inside is at least ``min_amount``."""
    scc = strong_components(tx.select(F.col("source_id").alias("a"), F.col("dest_id").alias("b")))
    side = {c: scc.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("source_id", "dest_id")}
    inside = tx.join(side["source_id"], "source_id").join(side["dest_id"], "dest_id").where("source_id_label = dest_id_label")
    amounts = inside.groupBy(F.col("source_id_label").alias("label")).agg(F.sum("amount").alias("amount"))
    return scc.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1").join(amounts, "label").where(F.col("amount") >= min_amount)


def circular_ratio(tx: DataFrame, min_amount: float = 0.0) -> DataFrame:
    """One row: circular amount, total and their ratio."""
    inside = circular_flow(tx, min_amount).agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("circular"), F.count(F.lit(1)).alias("groups"))
    total = tx.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))
    return inside.crossJoin(F.broadcast(total)).withColumn("ratio", F.when(F.col("total") > 0, F.col("circular") / F.col("total")).otherwise(0.0))


def entity_circularity(tx: DataFrame) -> DataFrame:
    """entity_id, ratio, groups, amount: what an account pays within its strongly connected group, also as
    a share of all it pays; groups is 1 for accounts in a group of over one, else 0."""
    scc = strong_components(tx.select(F.col("source_id").alias("a"), F.col("dest_id").alias("b")))
    size = scc.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    scc = scc.join(size, "label").select("id", "label", "size")
    inside = tx.join(scc.toDF("source_id", "la", "size"), "source_id").join(scc.select(F.col("id").alias("dest_id"), F.col("label").alias("lb")), "dest_id")
    own = (F.col("la") == F.col("lb")) & (F.col("size") > 1)
    g = inside.groupBy("source_id").agg(F.sum("amount").alias("out"), F.coalesce(F.sum(F.when(own, F.col("amount"))), F.lit(0.0)).alias("amount"))
    j = scc.join(g, scc["id"] == g["source_id"], "left")
    return j.select(F.col("id").alias("entity_id"), F.coalesce(F.try_divide("amount", "out"), F.lit(0.0)).alias("ratio"), F.when(F.col("size") > 1, 1).otherwise(0).alias("groups"), F.coalesce("amount", F.lit(0.0)).alias("amount"))


def reciprocal_pairs(tx: DataFrame, min_amount: float = 0.0, start: int | None = None, end: int | None = None) -> DataFrame:
    """a <= b, forward, backward and reciprocal = 2 min of pairs that pay one another, by one
    aggregation over unordered pairs.  An account that pays itself is paired with itself."""
    if start is not None:
        tx = tx.where((F.col("ts") >= start) & (F.col("ts") < end))
    ahead = F.col("source_id") <= F.col("dest_id")
    p = tx.groupBy(F.least("source_id", "dest_id").alias("a"), F.greatest("source_id", "dest_id").alias("b")).agg(F.sum(F.when(ahead, F.col("amount"))).alias("forward"), F.sum(F.when(~ahead, F.col("amount"))).alias("backward"))
    p = p.withColumn("backward", F.when(F.col("a") == F.col("b"), F.col("forward")).otherwise(F.col("backward")))
    low = F.least("forward", "backward")
    return p.where(F.col("forward").isNotNull() & F.col("backward").isNotNull() & (low >= min_amount)).withColumn("reciprocal", 2 * low)


def _sides(tx: DataFrame) -> DataFrame:
    return tx.withColumn("entity_id", F.explode(F.array("source_id", "dest_id")))


def rapid_movement(tx: DataFrame, hours: float = 24.0, velocity: float = 5.0, amount: float = 10_000.0) -> DataFrame:
    """entity_id, velocity (most transactions an hour in any window of ``hours`` that starts at one of
    its transactions), amount of that window (the earliest of equals) and flagged."""
    span = W.partitionBy("entity_id").orderBy("ts").rangeBetween(0, int(hours * 3600) - 1)
    w = _sides(tx).select("entity_id", "ts", F.count(F.lit(1)).over(span).alias("n"), F.sum("amount").over(span).alias("s"))
    best = w.groupBy("entity_id").agg(F.max_by(F.struct("n", "s"), F.struct("n", -F.col("ts"))).alias("m"))
    out = best.select("entity_id", (F.col("m.n") / hours).alias("velocity"), F.col("m.s").alias("amount"))
    return out.withColumn("flagged", (F.col("velocity") >= velocity) & (F.col("amount") >= amount))


def structuring(tx: DataFrame, threshold: float = 10_000.0, hours: float = 24.0) -> DataFrame:
    """entity_id, n, amount and confidence: the first window in which an account sends three or more
    amounts between 70 and 100 percent of the threshold that exceed it together."""
    under = tx.where((F.col("amount") > 0.7 * threshold) & (F.col("amount") < threshold))
    span = W.partitionBy("source_id").orderBy("ts").rangeBetween(0, int(hours * 3600) - 1)
    hit = under.select("source_id", "ts", F.count(F.lit(1)).over(span).alias("n"), F.sum("amount").over(span).alias("amount")).where((F.col("n") >= 3) & (F.col("amount") > threshold))
    return hit.groupBy("source_id").agg(F.min_by(F.struct("n", "amount"), "ts").alias("f")).select(F.col("source_id").alias("entity_id"), "f.n", "f.amount", F.least(F.col("f.n") / 10, F.lit(1.0)).alias("confidence"))


def _fan(tx: DataFrame, hub: str, other: str, least: int) -> DataFrame:
    g = tx.groupBy(F.col(hub).alias("entity_id")).agg(F.count_distinct(other).alias("n"), F.sum("amount").alias("amount"))
    return g.where(F.col("n") >= least).withColumn("confidence", F.least(F.col("n") / 20, F.lit(1.0)))


def funnel_accounts(tx: DataFrame, least: int = 5) -> DataFrame:
    """Accounts that many distinct accounts pay."""
    return _fan(tx, "dest_id", "source_id", least)


def fan_out(tx: DataFrame, least: int = 5) -> DataFrame:
    """Accounts that pay many distinct accounts."""
    return _fan(tx, "source_id", "dest_id", least)


def aml_patterns(tx: DataFrame, threshold: float = 10_000.0, hours: float = 24.0) -> DataFrame:
    """pattern, entity_id, n, amount, confidence of the three detectors."""
    named = [("Structuring", structuring(tx, threshold, hours)), ("FunnelAccount", funnel_accounts(tx)), ("FanOut", fan_out(tx))]
    out = [d.select(F.lit(k).alias("pattern"), "entity_id", F.col("n").cast("long").alias("n"), "amount", "confidence") for k, d in named]
    return out[0].unionByName(out[1]).unionByName(out[2])


def aml_risk(patterns: DataFrame) -> DataFrame:
    """One row: the number of patterns and the risk, confidence weighed by 25, 20 and 15, 100 at most."""
    weight = F.when(F.col("pattern") == "Structuring", 25.0).when(F.col("pattern") == "FunnelAccount", 20.0).otherwise(15.0)
    return patterns.agg(F.count(F.lit(1)).alias("patterns"), F.least(F.coalesce(F.sum(weight * F.col("confidence")), F.lit(0.0)), F.lit(100.0)).alias("risk"))


def flow_reversals(tx: DataFrame, window: int = 86_400, suspicious: int = 3_600, critical: int = 300, ratio: float = 0.9) -> DataFrame:
    """Pairs of a transaction and a later one back, at most ``window`` seconds after and of nearly the
    same amount: ids, delay, ratio and risk."""
    back = tx.select(F.col("id").alias("reversal_id"), F.col("source_id").alias("r_source"), F.col("dest_id").alias("r_dest"), F.col("amount").alias("r_amount"), F.col("ts").alias("r_ts"))
    pairs = range_join(back, tx, [("r_source", "dest_id"), ("r_dest", "source_id")], "r_ts", "ts", window).where("r_ts > ts")
    match = F.when(F.col("amount") > 0, F.least(F.col("r_amount") / F.col("amount"), F.try_divide(F.col("amount"), F.col("r_amount")))).otherwise(0.0)
    pairs = pairs.withColumn("delay", F.col("r_ts") - F.col("ts")).withColumn("ratio", match).where(F.col("ratio") >= ratio)
    exact, fast, very = F.col("ratio") >= 0.99, F.col("delay") < suspicious, F.col("delay") < critical
    risk = F.when(very & exact, "Critical").when(very, "High").when(fast & exact, "High").when(fast | exact, "Suspicious").otherwise("Normal")
    return pairs.select(F.col("id").alias("original_id"), "reversal_id", "source_id", "dest_id", "amount", "r_amount", "delay", "ratio", risk.alias("risk"))


def reversal_summary(reversals: DataFrame, tx: DataFrame) -> DataFrame:
    """One row: reversals, volume, ratio to all volume, repeat offenders and the risk score."""
    a = reversals.agg(F.count(F.lit(1)).alias("reversals"), F.coalesce(F.sum(F.col("amount") + F.col("r_amount")), F.lit(0.0)).alias("volume"), F.count(F.when(F.col("risk").isin("High", "Critical"), 1)).alias("high"))
    repeat = reversals.select(F.explode(F.array("source_id", "dest_id")).alias("e")).groupBy("e").count().where("count >= 2").agg(F.count(F.lit(1)).alias("repeat_offenders"))
    one = a.crossJoin(F.broadcast(repeat)).crossJoin(F.broadcast(tx.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))))
    one = one.withColumn("ratio", F.when(F.col("total") > 0, F.col("volume") / F.col("total")).otherwise(0.0))
    score = F.least(F.col("reversals") * 5.0 + F.col("high") * 15.0 + F.col("repeat_offenders") * 10.0 + F.col("ratio") * 50.0, F.lit(100.0))
    return one.select("reversals", "volume", "ratio", "repeat_offenders", score.alias("risk_score"))


def split_risk(total: float, n: int, near: int, threshold: float) -> str:
    """Within five percent of the threshold: Critical with three amounts near it, else High; three near
    it otherwise: High; five or more that exceed it: Elevated."""
    if 0.95 * threshold <= total <= 1.05 * threshold:
        return "Critical" if near >= 3 else "High"
    if near >= 3:
        return "High"
    return "Elevated" if n >= 5 and total > threshold else "Normal"


def flow_splits(tx: DataFrame, threshold: float = 10_000.0, window: int = 86_400, least: int = 3) -> DataFrame:
    """source_id, n, amount, span and risk of runs of transactions under a reporting threshold; of
    runs of one account that share half their transactions or more the riskiest, then largest, stays.
    Only transactions under the threshold travel."""
    under = tx.where(F.col("amount") < threshold).select("source_id", "ts", "id", "amount")
    rank = {"Critical": 0, "High": 1, "Elevated": 2}

    def account(key: tuple, rows: list[dict]) -> list[tuple]:
        found, end, total = [], 0, 0.0
        for i, first in enumerate(rows):
            while end < len(rows) and rows[end]["ts"] <= first["ts"] + window:
                total += rows[end]["amount"]
                end += 1
            run = rows[i:end]
            if len(run) >= least and total >= 0.8 * threshold:
                near = sum(x["amount"] > 0.7 * threshold for x in run)
                risk = split_risk(total, len(run), near, threshold)
                if risk != "Normal":
                    found.append((rank[risk], -round(total, 6), i, risk, [x["id"] for x in run], run[-1]["ts"] - first["ts"]))
            total -= first["amount"]
        kept, used = [], set()
        for _, minus, _, risk, ids, span in sorted(found):
            if sum(x in used for x in ids) < len(ids) / 2:
                used.update(ids)
                kept.append((key[0], len(ids), -minus, span, risk))
        return kept

    return ordered_groups(under, ["source_id"], ["ts", "id"], account, "source_id long, n long, amount double, span long, risk string")


KYC_WEIGHTS = {"country_risk": 0.25, "industry_risk": 0.20, "product_risk": 0.15, "transaction_risk": 0.20, "documentation_gap": 0.10, "tenure_risk": 0.10}


def kyc_scores(factors: DataFrame, weights: dict[str, float] = KYC_WEIGHTS) -> DataFrame:
    """customer_id, the two derived factors, risk_score (weighted mean) and risk_tier."""
    df = factors.withColumn("documentation_gap", 100 - F.col("documentation_score")).withColumn("tenure_risk", (10 - F.least("tenure_years", F.lit(10.0))) * 10)
    total = sum(weights.values())
    score = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)) / total if total > 0 else F.lit(0.0)
    return df.select("customer_id", "documentation_gap", "tenure_risk", score.alias("risk_score")).withColumn("risk_tier", tier("risk_score"))


def tier(column: str) -> Column:
    c = F.col(column)
    return F.when(c < 25, "Low").when(c < 50, "Medium").when(c < 75, "High").otherwise("VeryHigh")


def date_similarity(a: Column, b: Column) -> Column:
    """Of two yyyymmdd integers; null if either is."""
    gap = F.abs(F.floor(a / 10000) - F.floor(b / 10000))
    month = F.floor(a / 100) == F.floor(b / 100)
    return F.when(a == b, 1.0).when(month, 0.9).when(gap == 0, 0.7).when(gap <= 2, 0.5).when(gap <= 5, 0.3).when(a.isNotNull() & b.isNotNull(), 0.0)


def _names(df: DataFrame, key: str, prefix: str) -> DataFrame:
    names = F.array_distinct(F.concat(F.array("name"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))) if "aliases" in df.columns else F.array("name")
    return df.select(F.col(key).alias(f"{prefix}_id"), F.explode(names).alias(f"{prefix}_name"))


def _tasks(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _best_names(queries: DataFrame, entries: DataFrame, least: float, top: int, block: int = 4_096) -> DataFrame:
    """query_id, entry_id, level, score, matched_name, rank of the ``top`` best of entries(entry_id, names, level)
    for each of queries(query_id, query_name), ties by level and id.  Both are packed into blocks; a task holds
    the names of one against entries of another and keeps ``top`` a query, so pairs never leave it."""
    schema = "query_id long, entry_id long, level long, score double, matched_name string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(0)[i].as_py()
                if number not in blocks:
                    rows = batch.column(1)[i].values
                    of = np.repeat(np.arange(len(rows)), rows.field("names").value_lengths().to_numpy())
                    plain = rows.field("names").flatten().to_pylist()
                    blocks.clear()
                    blocks[number] = (NameTable([x.lower() for x in plain]), plain, of, rows.field("entry_id").to_numpy(), rows.field("level").to_numpy())
                names, plain, of, ids, level = blocks[number]
                asked, out = batch.column(2)[i].values, []
                for query, name in zip(asked.field("query_id").to_pylist(), asked.field("query_name").to_pylist(), strict=True):
                    s = names.scores(name.lower(), least)
                    best = np.full(len(ids), -1.0)
                    np.maximum.at(best, of, s)
                    found = np.flatnonzero(best >= least)
                    if len(found) > top:
                        found = found[best[found] >= np.partition(best[found], -top)[-top]]
                    for e in found[np.lexsort((ids[found], level[found], -best[found]))][:top].tolist():
                        out.append((query, int(ids[e]), int(level[e]), float(best[e]), max(plain[k] for k in range(*np.searchsorted(of, [e, e + 1])) if s[k] == best[e])))
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)], names=["query_id", "entry_id", "level", "score", "matched_name"])

    def packed(d: DataFrame, key: str, size: int) -> DataFrame:
        n = max(1, -(-d.count() // size))
        return materialise(d.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("long").alias("block")).agg(F.collect_list(F.struct(*d.columns)).alias("rows")), "names")

    q = packed(queries.select(F.col("query_id").cast("long"), F.coalesce("query_name", F.lit("")).alias("query_name")), "query_id", 256)
    e = packed(entries.select(F.col("entry_id").cast("long"), "names", F.col("level").cast("long")), "entry_id", block)
    many, few = 4 * queries.sparkSession.sparkContext.defaultParallelism, max(1, -(-e.count() // 16))
    asked = q.select(F.col("rows").alias("asked")).repartition(many)
    near = e.select("block", "rows").repartition(few).crossJoin(asked.hint("shuffle_replicate_nl")).mapInArrow(task, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "level", "entry_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top)


def screen(names: DataFrame, watchlist: DataFrame, least: float = 0.7, top: int = 10, hit: float = 0.85) -> DataFrame:
    """query_id, entry_id, score, matched_name and is_hit: the best ``top`` entries of each name with a
    score of ``least`` or more.  names(id, name), watchlist(id, name, aliases).  All names are held against
    the whole watchlist."""
    q, e = _names(names.drop("aliases"), "id", "query"), _names(watchlist, "id", "entry")
    e = e.groupBy("entry_id").agg(F.collect_set(F.coalesce("entry_name", F.lit(""))).alias("names"), F.lit(0).alias("level"))
    return _best_names(q, e, least, top).drop("level").withColumn("is_hit", F.col("score") >= hit)


def screen_pep(names: DataFrame, peps: DataFrame, least: float = 0.7, top: int = 10, hit: float = 0.85) -> DataFrame:
    """screen against politically exposed persons (id, name, level): ties of score by level."""
    q, e = _names(names.drop("aliases"), "id", "query"), peps.select(F.col("id").alias("entry_id"), F.array(F.coalesce("name", F.lit(""))).alias("names"), "level")
    return _best_names(q, e, least, top).select("query_id", "entry_id", "level", "score", "rank", (F.col("score") >= hit).alias("is_pep"))


def resolve_entities(queries: DataFrame, candidates: DataFrame, least: float = 0.7, top: int = 10) -> DataFrame:
    """query_id, entity_id, score of entities(id, name, aliases, birth_date, country): name 0.6, date
    0.25 (half of it where no date agrees or is known) and country 0.15.  Every query is held against
    every candidate.

    Dates and countries are compared once for all rows that have them in common.  Names are compared only
    where they can matter: the candidates that are best by date and country, ``top`` of a query at least, are
    scored first; of the others those can still come in that would reach the query's ``top``-th score with an
    equal name, and the rest cannot.  A task holds the names of a block of candidates and keeps ``top`` a
    query, so pairs never leave it."""
    n = _tasks(queries)
    alike = F.concat(F.coalesce(F.col("birth_date").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.concat(F.lit("="), F.col("country").cast("string")), F.lit("")))

    def people(df: DataFrame, key: str) -> DataFrame:
        names = _names(df, "id", "p").groupBy("p_id").agg(F.collect_list(F.coalesce("p_name", F.lit(""))).alias("names"))
        return materialise(df.withColumn(key, alike).join(names, F.col("id") == F.col("p_id")).select(key, F.col("id").cast("long"), "names", "birth_date", "country").dropDuplicates([key, "id"]), key)

    q, e = people(queries, "qk"), people(candidates, "ek")
    a = q.select("qk", F.col("birth_date").alias("qd"), F.col("country").alias("qc")).distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    b = e.groupBy("ek", F.col("birth_date").alias("ed"), F.col("country").alias("ec")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.pmod(F.xxhash64("ek"), F.lit(n)))
    date = F.coalesce(date_similarity(F.col("qd"), F.col("ed")), F.lit(0.0))
    rest = F.when(date > 0, date * 0.25).otherwise(0.125) + F.when(F.col("qc") == F.col("ec"), 0.15).otherwise(0.0)
    pairs = a.join(b.hint("shuffle_hash"), "part").select("qk", "ek", "n", rest.alias("rest")).where(F.col("rest") + 0.6 >= least - 1e-9)
    steps = pairs.groupBy("qk", "rest").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy("qk").orderBy(F.col("rest").desc())))
    floor = materialise(steps.where(F.col("upto") > top).groupBy("qk").agg(F.max("rest").alias("floor")), "floors")  # one may be the query itself

    shares = max(4, -(-q.count() // 4_096))

    def scored(some: DataFrame, asked: DataFrame) -> DataFrame:
        size = some.groupBy("qk").agg(F.ceil(F.sum("n") / 4_096).alias("blocks"))
        rows = some.join(e.select("ek", "id", "names"), "ek").join(size, "qk")
        blocks = rows.groupBy("qk", F.pmod(F.xxhash64("id"), "blocks").alias("block")).agg(F.collect_list(F.struct("id", "names", "rest")).alias("entities"))
        packed = asked.groupBy("qk", F.pmod(F.xxhash64("id"), F.lit(shares)).alias("share")).agg(F.collect_list(F.struct("id", "names", "bar")).alias("asked"))
        many = 4 * queries.sparkSession.sparkContext.defaultParallelism
        return blocks.join(packed, "qk").select("entities", "asked").repartition(many).mapInArrow(_score_people(least, top), "query_id long, entity_id long, name_score double, score double")

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "entity_id"))
    near = pairs.join(floor, "qk", "left").where(F.col("rest") >= F.coalesce("floor", F.lit(0.0)))
    first = materialise(scored(near.select("qk", "ek", "n", "rest"), q.withColumn("bar", F.lit(least))).withColumn("rank", rank).where(F.col("rank") <= top), "first_scores")
    bars = q.join(first.where(F.col("rank") == top).select(F.col("query_id").alias("id"), F.col("score").alias("bar")), "id", "left").select("qk", "id", "names", F.coalesce("bar", F.lit(least)).alias("bar"))
    lowest = bars.groupBy("qk").agg(F.min("bar").alias("lowest"))
    far = pairs.join(floor, "qk").where(F.col("rest") < F.col("floor")).join(lowest, "qk").where(F.col("rest") + 0.6 >= F.col("lowest") - 1e-9)
    every = first.drop("rank").unionByName(scored(far.select("qk", "ek", "n", "rest"), bars))
    return every.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "entity_id", "name_score", "score", "rank")


def _score_people(least: float, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """query_id, entity_id, name_score, score of rows of entities(id, names, rest) and asked(id, names, bar): the
    ``top`` best entities of a row for each of its queries, with a score of ``least`` or more."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entities, asked = batch.column(0)[i].values, batch.column(1)[i].values
                of = np.repeat(np.arange(len(entities)), entities.field("names").value_lengths().to_numpy())
                names = NameTable([x.lower() for x in entities.field("names").flatten().to_pylist()])
                ids, rest = entities.field("id").to_numpy(), entities.field("rest").to_numpy()
                out: list[np.ndarray] = []
                for query, own, bar in zip(asked.field("id").to_pylist(), asked.field("names").to_pylist(), asked.field("bar").to_pylist(), strict=True):
                    can = (rest + 0.6 >= bar - 1e-9) & (ids != query)
                    if not can.any():
                        continue
                    need = np.where(can, (bar - rest) / 0.6 - 1e-9, 2.0)[of]
                    best = np.full(len(ids), -1.0)
                    for name in own:
                        np.maximum.at(best, of, names.scores(name.lower(), need))
                    score = best * 0.6 + rest
                    found = np.flatnonzero(can & (best >= 0) & (score >= least))
                    found = found[np.lexsort((ids[found], -score[found]))][:top]
                    out.append(np.stack([np.full(len(found), query, np.int64), ids[found], best[found].view(np.int64), score[found].view(np.int64)]))
                got = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), pa.array(got[2].view(np.float64)), pa.array(got[3].view(np.float64))], names=["query_id", "entity_id", "name_score", "score"])

    return task


#: id, type, threshold, window in seconds, severity
DEFAULT_RULES = ((1, "SingleAmount", 10_000.0, 0, "High"), (2, "AggregateAmount", 10_000.0, 86_400, "Medium"), (3, "TransactionCount", 50.0, 86_400, "Medium"), (4, "Velocity", 5_000.0, 3_600, "High"))


def monitor(tx: DataFrame, now: int, rules: tuple[tuple, ...] = DEFAULT_RULES) -> DataFrame:
    """rule_id, entity_id, tx_id (of single amounts), severity and value of the alerts at ``now``.  All
    windowed rules are one aggregation over the transactions of the longest window."""
    out = None
    windowed = [x for x in rules if x[1] in ("AggregateAmount", "TransactionCount", "Velocity")]
    for rid, kind, threshold, _, severity in rules:
        if kind == "SingleAmount":
            one = tx.where(F.col("amount") >= threshold).select(F.lit(rid).alias("rule_id"), F.col("source_id").alias("entity_id"), F.col("id").alias("tx_id"), F.lit(severity).alias("severity"), F.col("amount").alias("value"))
            out = one if out is None else out.unionByName(one)
    if windowed:
        longest = max(x[3] for x in windowed)
        recent = _sides(tx.where((F.col("ts") >= now - longest) & (F.col("ts") < now)))
        aggs = []
        for rid, kind, _, window, _ in windowed:
            inside = F.when(F.col("ts") >= now - window, F.col("amount"))
            value = F.count(inside).cast("double") if kind == "TransactionCount" else F.coalesce(F.sum(inside), F.lit(0.0))
            aggs.append((value / (window / 3600) if kind == "Velocity" and window else value).alias(f"v{rid}"))
        wide = recent.groupBy("entity_id").agg(*aggs)
        alert = F.array_compact(F.array(*[F.when(F.col(f"v{rid}") >= t, F.struct(F.lit(rid).alias("rule_id"), F.lit(sev).alias("severity"), F.col(f"v{rid}").alias("value"))) for rid, _, t, _, sev in windowed]))
        many = wide.select("entity_id", F.explode(alert).alias("a")).select("a.rule_id", "entity_id", F.lit(-1).cast("long").alias("tx_id"), "a.severity", "a.value")
        out = many if out is None else out.unionByName(many)
    return out
