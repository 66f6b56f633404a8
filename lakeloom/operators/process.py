"""Process mining over events(id, case_id, activity, ts, resource)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lakeloom.operators.groupmap import ordered_groups


def _case():
    return W.partitionBy("case_id").orderBy("ts", "id")


def _steps(events: DataFrame) -> DataFrame:
    return events.select("case_id", F.col("activity").alias("a"), F.col("ts").alias("ta"), F.lead("activity").over(_case()).alias("b"), F.lead("ts").over(_case()).alias("tb"), F.row_number().over(_case()).alias("k"))


def directly_follows(events: DataFrame) -> DataFrame:
    """a, b, n and mean duration of activities that follow one another in a case."""
    return _steps(events).where("b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("tb") - F.col("ta")).alias("duration"))


def activity_counts(events: DataFrame) -> DataFrame:
    """activity, n, starts and ends."""
    s = _steps(events)
    return s.groupBy(F.col("a").alias("activity")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("k") == 1, 1)).alias("starts"), F.count(F.when(F.col("b").isNull(), 1)).alias("ends"))


def frequent_edges(dfg: DataFrame, least: int) -> DataFrame:
    return dfg.where(F.col("n") >= least)


def dfg_metrics(dfg: DataFrame, activities: DataFrame) -> DataFrame:
    """One row: nodes, edges, density (edges over nodes squared) and mean count."""
    e = dfg.agg(F.count(F.lit(1)).alias("edges"), F.avg("n").alias("mean_count"))
    n = activities.agg(F.count_distinct("activity").alias("nodes"))
    return n.crossJoin(F.broadcast(e)).select("nodes", "edges", F.when(F.col("nodes") > 0, F.col("edges") / (F.col("nodes") * F.col("nodes"))).otherwise(0.0).alias("density"), F.coalesce("mean_count", F.lit(0.0)).alias("mean_count"))


# --- order relations


def order_relations(events: DataFrame, sequential: float = 0.8, concurrent: float = 0.5) -> DataFrame:
    """a < b, cases with both, how many event pairs have a first, b first, and a relation: Exclusive
    (never together), Sequential (one way only, in enough cases), Concurrent (both ways evenly), None.

    Event pairs are counted without joining events: each case folds its events into running counts by
    activity, as many as there are activities."""
    names = events.select("activity").distinct()
    counts = events.groupBy("case_id", "activity", "ts").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.select("case_id", F.col("activity").alias("x"), F.col("ts").alias("tx"), F.sum("n").over(W.partitionBy("case_id", "activity").orderBy("ts")).alias("upto"))
    # for an event of y at ty, the x before it are those up to the last x time before ty
    times = counts.select("case_id", F.col("activity").alias("y"), F.col("ts").alias("ty"), F.col("n").alias("ny")).crossJoin(F.broadcast(names.withColumnRenamed("activity", "x")))
    marks = times.select("case_id", "x", F.col("ty").alias("t"), F.lit(0).alias("side"), "y", "ny", F.lit(None).cast("long").alias("upto"))
    facts = ahead.select("case_id", "x", F.col("tx").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("y"), F.lit(None).cast("long").alias("ny"), "upto")
    w = W.partitionBy("case_id", "x").orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    seen = marks.unionByName(facts).withColumn("before", F.coalesce(F.last("upto", ignorenulls=True).over(w), F.lit(0))).where("side = 0 AND x <> y")
    pairs = seen.groupBy("x", "y").agg(F.sum(F.col("before") * F.col("ny")).alias("n"))
    both = events.select("case_id", "activity").distinct()
    co = both.select("case_id", F.col("activity").alias("a")).join(both.select("case_id", F.col("activity").alias("b")), "case_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("cases"))
    every = names.select(F.col("activity").alias("a")).crossJoin(F.broadcast(names.select(F.col("activity").alias("b")))).where("a < b").join(co, ["a", "b"], "left")
    ab, ba = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("n").alias("ab")), pairs.select(F.col("y").alias("a"), F.col("x").alias("b"), F.col("n").alias("ba"))
    df = every.join(ab, ["a", "b"], "left").join(ba, ["a", "b"], "left").na.fill(0)
    enough = F.floor(F.col("cases") * sequential)
    low, high = F.least("ab", "ba"), F.greatest("ab", "ba")
    kind = F.when(F.col("cases") == 0, "Exclusive").when((F.col("ab") >= enough) & (F.col("ba") == 0), "Sequential").when((F.col("ba") >= enough) & (F.col("ab") == 0), "Sequential").when((high > 0) & (low / F.when(high > 0, high) >= concurrent), "Concurrent").otherwise("None")
    return df.withColumn("relation", kind)


def immediate_loops(events: DataFrame, longest: int = 5) -> DataFrame:
    """pattern (activities joined by commas), length and n of stretches that repeat at once, seen twice
    or more; per length k, an event starts one if the next k activities equal the k after them."""
    ahead = [F.col("activity"), *[F.lead("activity", i).over(_case()) for i in range(1, 2 * longest)]]
    s = events.select("case_id", *[c.alias(f"x{i}") for i, c in enumerate(ahead)])
    found = None
    for k in range(2, longest + 1):
        same = F.lit(True)
        for i in range(k):
            same = same & (F.col(f"x{i}") == F.col(f"x{i + k}"))
        hit = s.where(same).select(F.concat_ws(",", *[f"x{i}" for i in range(k)]).alias("pattern"), F.lit(k).alias("length"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("pattern", "length").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def independence(events: DataFrame) -> DataFrame:
    """a < b and 1 - min(p_ab / (p_a p_b), 1) over cases; 1 for pairs that never meet."""
    has = events.select("case_id", "activity").distinct()
    total = F.broadcast(events.agg(F.count_distinct("case_id").alias("total")))
    p = has.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))
    co = has.select("case_id", F.col("activity").alias("a")).join(has.select("case_id", F.col("activity").alias("b")), "case_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("nab"))
    pairs = p.select(F.col("activity").alias("a"), F.col("n").alias("na")).crossJoin(F.broadcast(p.select(F.col("activity").alias("b"), F.col("n").alias("nb")))).where("a < b")
    df = pairs.join(co, ["a", "b"], "left").crossJoin(total)
    return df.select("a", "b", (1 - F.least(F.coalesce("nab", F.lit(0)) * F.col("total") / (F.col("na") * F.col("nb")), F.lit(1.0))).alias("independence"))


# --- conformance


def conformance(events: DataFrame, model: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """case_id, sync, log_moves, fitness and precision of each case against model(a, b), starts(activity) and
    ends(activity).  Every event is checked by the edge that leads to it (the first by the starts), and
    the last by the ends.  precision is used over possible steps: the sum of 1 over the sum of out-degrees."""
    s = events.select("case_id", "activity", F.lag("activity").over(_case()).alias("before"), F.lead("activity").over(_case()).alias("after"))
    m = model.select(F.col("a").alias("before"), F.col("b").alias("activity"), F.lit(True).alias("edge")).distinct()
    st, en = (d.select("activity", F.lit(True).alias(n)).distinct() for d, n in ((starts, "is_start"), (ends, "is_end")))
    degree = model.groupBy(F.col("a").alias("activity")).agg(F.count_distinct("b").alias("options"))
    df = s.join(m, ["before", "activity"], "left").join(st, "activity", "left").join(en, "activity", "left").join(degree, "activity", "left")
    ok = F.when(F.col("before").isNull(), F.col("is_start").isNotNull()).otherwise(F.col("edge").isNotNull())
    bad_end = F.col("after").isNull() & F.col("is_end").isNull()
    moves = F.count(F.when(~ok, 1)) + F.count(F.when(bad_end, 1))
    g = df.groupBy("case_id").agg(F.count(F.when(ok, 1)).alias("sync"), moves.alias("log_moves"), F.count(F.when(F.col("after").isNotNull() & F.col("options").isNotNull(), 1)).alias("used"), F.sum(F.when(F.col("after").isNotNull(), F.col("options"))).alias("possible"))
    return g.select("case_id", "sync", "log_moves", F.coalesce(F.try_divide(F.col("sync"), F.col("sync") + F.col("log_moves")), F.lit(1.0)).alias("fitness"), F.coalesce(F.try_divide(F.col("used"), F.col("possible")), F.lit(1.0)).alias("precision"))


def deviations(events: DataFrame, model: DataFrame, starts: DataFrame, ends: DataFrame, top: int | None = None) -> DataFrame:
    """kind (WrongStart, UnexpectedStep, WrongEnd), activity, n; the ``top`` commonest."""
    s = events.select("case_id", "activity", F.lag("activity").over(_case()).alias("before"), F.lead("activity").over(_case()).alias("after"))
    first = s.where("before IS NULL").join(starts.select("activity"), "activity", "left_anti").select(F.lit("WrongStart").alias("kind"), "activity")
    step = s.where("before IS NOT NULL").join(model.select(F.col("a").alias("before"), F.col("b").alias("activity")), ["before", "activity"], "left_anti").select(F.lit("UnexpectedStep").alias("kind"), "activity")
    last = s.where("after IS NULL").join(ends.select("activity"), "activity", "left_anti").select(F.lit("WrongEnd").alias("kind"), "activity")
    out = first.unionByName(step).unionByName(last).groupBy("kind", "activity").agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.col("n").desc(), "kind", "activity").limit(top)


def conformance_stats(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("log_moves") == 0, 1)).alias("conforming"), F.avg("fitness").alias("fitness"), F.avg("precision").alias("precision"))


def replay(events: DataFrame, transitions: list[tuple[str, tuple[str, ...], tuple[str, ...]]], initial: dict[str, int], final: dict[str, int]) -> DataFrame:
    """Token replay of each case on a Petri net of (label, places in, places out): case_id, consumed,
    produced, missing, remaining, fitness."""
    by = {}
    for label, ins, outs in transitions:
        by.setdefault(label, (ins, outs))

    def run(key: tuple, rows: list[dict]) -> list[tuple]:
        marks, made, used, missing = dict(initial), sum(initial.values()), 0, 0
        for r in rows:
            if r["activity"] not in by:
                missing += 1
                used += 1
                continue
            for p in by[r["activity"]][0]:
                if marks.get(p, 0) == 0:
                    missing += 1
                    marks[p] = 1
                marks[p] -= 1
                used += 1
            for p in by[r["activity"]][1]:
                marks[p] = marks.get(p, 0) + 1
                made += 1
        for p, n in final.items():
            short = max(n - marks.get(p, 0), 0)
            missing += short
            used += n
            marks[p] = max(marks.get(p, 0) - n, 0)
        left = sum(marks.values())
        return [(key[0], used, made, missing, left, 0.5 * (1 - missing / max(used, 1)) + 0.5 * (1 - left / max(made, 1)))]

    kind = events.schema["case_id"].dataType.simpleString()
    return ordered_groups(events.select("case_id", "activity", "ts", "id"), ["case_id"], ["ts", "id"], run, f"case_id {kind}, consumed long, produced long, missing long, remaining long, fitness double")


# --- prediction


def transition_counts(events: DataFrame, order: int = 1) -> DataFrame:
    """context (the last ``order`` activities joined by >), next and n."""
    context = [F.lag("activity", i).over(_case()) for i in range(order, 0, -1)]
    s = events.select(F.when(context[0].isNotNull(), F.concat_ws(">", *context)).alias("context"), F.col("activity").alias("next"))
    return s.where("context IS NOT NULL").groupBy("context", "next").agg(F.count(F.lit(1)).alias("n"))


def predict_next(counts: DataFrame, contexts: DataFrame, activities: DataFrame, top: int = 5, least: float = 0.01) -> DataFrame:
    """context, next, probability ((n + 1) / (N + V)) and confidence (halved where N <= 10) of the likeliest
    activities after contexts(context)."""
    v = F.broadcast(activities.agg(F.count(F.lit(1)).alias("v")))
    total = counts.groupBy("context").agg(F.sum("n").alias("total"))
    grid = contexts.select("context").distinct().crossJoin(F.broadcast(activities.select(F.col("activity").alias("next"))))
    df = grid.join(counts, ["context", "next"], "left").join(total, "context", "left").crossJoin(v).na.fill(0, ["n", "total"])
    p = (F.col("n") + 1) / (F.col("total") + F.col("v"))
    df = df.withColumn("probability", p).where(F.col("probability") >= least)
    rank = F.row_number().over(W.partitionBy("context").orderBy(F.col("probability").desc(), "next"))
    return df.withColumn("rank", rank).where(F.col("rank") <= top).select("context", "next", "rank", "probability", F.when(F.col("total") > 10, F.col("probability")).otherwise(F.col("probability") / 2).alias("confidence"))


# --- log repair


def expected_next(events: DataFrame, support: float = 0.1) -> DataFrame:
    """a, b, n, probability of steps seen in enough cases."""
    cases = F.broadcast(events.agg(F.count_distinct("case_id").alias("cases")))
    dfg = directly_follows(events).select("a", "b", "n")
    return dfg.withColumn("probability", F.col("n") / F.sum("n").over(W.partitionBy("a"))).crossJoin(cases).where(F.col("n") >= F.greatest(F.floor(F.col("cases") * support), F.lit(1))).drop("cases")


def out_of_order(events: DataFrame) -> DataFrame:
    """case_id, id and confidence of events whose place by id is not their place by time."""
    a, b = F.row_number().over(W.partitionBy("case_id").orderBy("id")), F.row_number().over(_case())
    return events.select("case_id", "id", a.alias("stored"), b.alias("timed")).where("stored <> timed").select("case_id", "id", F.lit(0.9).alias("confidence"))


def duplicates(events: DataFrame, within: int = 60) -> DataFrame:
    """id and how many earlier events of its case and activity are at most ``within`` seconds before."""
    w = W.partitionBy("case_id", "activity").orderBy("ts")
    n = F.count(F.lit(1)).over(w.rangeBetween(-within, 0))
    tie = F.row_number().over(W.partitionBy("case_id", "activity", "ts").orderBy(F.col("id").desc())) - 1
    return events.select("case_id", "id", (n - 1 - tie).alias("earlier")).where("earlier > 0").withColumn("confidence", F.lit(0.7))


def missing_events(events: DataFrame, support: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """case_id, a, missing, b and confidence 0.8 p: steps a to b that are not expected, but a to x and x to b
    are, with p the product of their probabilities' larger share."""
    e = expected_next(events, support)
    odd = _steps(events).where("b IS NOT NULL").join(e.select("a", "b"), ["a", "b"], "left_anti").select("case_id", "k", "a", "b")
    via = e.select("a", F.col("b").alias("missing"), F.col("probability").alias("p1")).join(e.select(F.col("a").alias("missing"), "b", F.col("probability").alias("p2")), "missing")
    best = via.withColumn("p", F.least("p1", "p2")).groupBy("a", "b").agg(F.max(F.struct("p", "missing")).alias("m"))
    hit = odd.join(best, ["a", "b"]).where(F.col("m.p") >= threshold)
    return hit.select("case_id", "k", "a", F.col("m.missing").alias("missing"), "b", (0.8 * F.col("m.p")).alias("confidence"))


def incomplete_cases(events: DataFrame, support: float = 0.1) -> DataFrame:
    """case_id, kind (start or end), activity of cases that start or end as few others do."""
    s = _steps(events)
    cases = F.broadcast(events.agg(F.count_distinct("case_id").alias("cases")))
    out = None
    for kind, rows in (("start", s.where("k = 1")), ("end", s.where("b IS NULL"))):
        n = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        odd = rows.select("case_id", "a").join(n, "a").crossJoin(cases).where(F.col("n") < F.greatest(F.floor(F.col("cases") * support), F.lit(1)))
        odd = odd.select("case_id", F.lit(kind).alias("kind"), F.col("a").alias("activity"))
        out = odd if out is None else out.unionByName(odd)
    return out


def repair(events: DataFrame, within: int = 60) -> DataFrame:
    """The events without duplicates, in time order: case_id, position, id, activity, ts."""
    clean = events.join(duplicates(events, within).select("id"), "id", "left_anti")
    return clean.select("case_id", F.row_number().over(_case()).alias("position"), "id", "activity", "ts")


def log_quality(events: DataFrame, within: int = 60) -> DataFrame:
    """One row: events, issues by kind, and quality 1 - issues / events, at least 0."""
    n = events.agg(F.count(F.lit(1)).alias("events"))
    parts = [d.agg(F.count(F.lit(1)).alias(c)) for c, d in (("misordered", out_of_order(events)), ("duplicated", duplicates(events, within)), ("incomplete", incomplete_cases(events)))]
    for p in parts:
        n = n.crossJoin(F.broadcast(p))
    issues = F.col("misordered") + F.col("duplicated") + F.col("incomplete")
    return n.withColumn("quality", F.greatest(1 - issues / F.greatest("events", F.lit(1)), F.lit(0.0)))


# --- object-centric logs: events(id, activity, ts, objects), objects(object_id, object_type)


def _touches(events: DataFrame) -> DataFrame:
    return events.select("id", "activity", "ts", F.explode(F.array_distinct("objects")).alias("object_id"))


def lifecycles(events: DataFrame, objects: DataFrame, object_type: str) -> DataFrame:
    """object_id, sequence, kind and score of the objects of a type: single, full (a create or start first
    and a complete, close or end last), loop (under half distinct) or sequential."""
    t = _touches(events).join(objects.where(F.col("object_type") == object_type), "object_id")
    s = t.groupBy("object_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "id", "activity"))), lambda x: F.lower(x["activity"])).alias("s"))
    first, last = F.element_at("s", 1), F.element_at("s", -1)
    starts, stops = first.rlike("create|start|signup"), last.rlike("complete|close|end|purchase")
    unique = F.size(F.array_distinct("s")) / F.size("s")
    kind = F.when(F.size("s") == 1, "single").when(starts & stops, "full").when(unique < 0.5, "loop").otherwise("sequential")
    score = 0.5 * unique + F.when(starts, 0.25).otherwise(0.0) + F.when(stops, 0.25).otherwise(0.0)
    return s.select("object_id", F.array_join("s", ">").alias("sequence"), kind.alias("kind"), score.alias("score"))


def interactions(events: DataFrame, least: int = 2) -> DataFrame:
    """a < b, n and share of events of object pairs that meet often."""
    t = _touches(events).select("id", "object_id")
    total = F.broadcast(events.agg(F.count(F.lit(1)).alias("total")))
    n = t.withColumnRenamed("object_id", "a").join(t.withColumnRenamed("object_id", "b"), "id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= least).crossJoin(total).select("a", "b", "n", (F.col("n") / F.col("total")).alias("score"))


def convergence(events: DataFrame, least: int = 3) -> DataFrame:
    """Events that bring several distinct objects together."""
    k = F.size(F.array_distinct("objects"))
    return events.where(k >= least).select("id", "activity", k.alias("objects"))


def divergence(events: DataFrame) -> DataFrame:
    """Events that several objects first appear in."""
    first = _touches(events).groupBy("object_id").agg(F.min(F.struct("ts", "id")).alias("f"))
    return first.groupBy(F.col("f.id").alias("id")).agg(F.count(F.lit(1)).alias("introduced")).where("introduced >= 2")


def batches(events: DataFrame, gap: int = 1_000, least: int = 3) -> DataFrame:
    """activity, start, end, events and objects of runs of one activity with short gaps."""
    w = W.partitionBy("activity").orderBy("ts", "id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= gap, 0).otherwise(1)
    runs = events.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    g = runs.groupBy("activity", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"), F.size(F.array_distinct(F.flatten(F.collect_list("objects")))).alias("objects"))
    return g.where(F.col("objects") >= least).drop("run")


def synchronised(events: DataFrame, window: int = 1_000, least: int = 3) -> DataFrame:
    """first, n, objects of runs of events within ``window`` of their first that share objects with those
    before them in the run.  Time is cut into buckets of 100 windows, each swept in order, and a run
    belongs to the bucket it starts in."""
    cut = 100 * window
    here = F.floor(F.col("ts") / cut)
    both = events.withColumn("bucket", F.explode(F.array(here, here - 1))).withColumn("home", here == F.col("bucket"))

    def sweep(_: tuple, rows: list[dict]) -> list[tuple]:
        out = []
        for i, first in enumerate(rows):
            if not first["home"]:
                break
            group, objects = [first["id"]], set(first["objects"])
            for x in rows[i + 1 :]:
                if x["ts"] > first["ts"] + window:
                    break
                if objects & set(x["objects"]):
                    group.append(x["id"])
                    objects |= set(x["objects"])
            if len(group) >= least and len(objects) >= 2:
                out.append((first["id"], len(group), len(objects)))
        return out

    rows = both.select("bucket", "ts", "id", "objects", "home")
    return ordered_groups(rows, ["bucket"], [F.col("home").desc(), "ts", "id"], sweep, "first long, n long, objects long")


def flow_metrics(events: DataFrame) -> DataFrame:
    t = _touches(events)
    per_event = events.agg(F.count(F.lit(1)).alias("events"), F.avg(F.size(F.array_distinct("objects"))).alias("objects_per_event"))
    per_object = t.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), (F.max("ts") - F.min("ts")).alias("span")).agg(F.count(F.lit(1)).alias("objects"), F.avg("n").alias("events_per_object"), F.avg("span").alias("mean_span"))
    return per_event.crossJoin(F.broadcast(per_object))


# --- simulation


def simulate(spark, activities: list[tuple[str, str, float, int]], arrivals_per_hour: float = 10.0, hours: float = 24.0, replications: int = 20, seed: int = 7) -> DataFrame:
    """replication, case_id, activity, resource, queued, start, end (hours) of a line of activities(name,
    distribution, mean, servers): exponential arrivals, first come first served, the server free first.
    Replications are independent and seeded by their number, so they run anywhere in any order."""

    def draw(rng: np.random.Generator, kind: str, mean: float) -> float:
        if kind == "constant":
            return mean
        if kind == "uniform":
            return rng.uniform(0.5 * mean, 1.5 * mean)
        if kind == "normal":
            return max(rng.normal(mean, 0.2 * mean), 0.0)
        if kind == "triangular":
            return rng.triangular(0.5 * mean, mean, 1.5 * mean)
        return rng.exponential(mean)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rep in b["id"]:
                rng = np.random.default_rng([seed, int(rep)])
                ready, t = [], 0.0
                while (t := t + rng.exponential(1 / arrivals_per_hour)) < hours:
                    ready.append(t)
                rows = []
                for name, kind, mean, servers in activities:
                    free, done = [0.0] * servers, {}
                    for case in sorted(range(len(ready)), key=ready.__getitem__):
                        s = min(range(servers), key=free.__getitem__)
                        start = max(ready[case], free[s])
                        done[case] = free[s] = start + draw(rng, kind, mean)
                        rows.append((int(rep), case, name, f"{name}-{s}", ready[case], start, free[s]))
                    ready = [done[c] for c in range(len(ready))]
                yield pd.DataFrame(rows, columns=["replication", "case_id", "activity", "resource", "queued", "start", "end"])

    return spark.range(replications).repartition(min(replications, 64)).mapInPandas(run, "replication long, case_id long, activity string, resource string, queued double, start double, end double")


def simulation_kpis(steps: DataFrame) -> DataFrame:
    """replication, cases, mean, least, largest and ranks floor((n - 1) p) of cycle times, throughput an hour."""
    case = steps.groupBy("replication", "case_id").agg(F.min("queued").alias("a"), F.max("end").alias("z"))
    c = case.withColumn("cycle", F.col("z") - F.col("a")).groupBy("replication").agg(F.count(F.lit(1)).alias("cases"), F.avg("cycle").alias("mean"), F.min("cycle").alias("least"), F.max("cycle").alias("largest"), F.stddev_pop("cycle").alias("sd"), F.max("z").alias("until"), F.sort_array(F.collect_list("cycle")).alias("s"))
    ranks = [F.element_at("s", (F.floor((F.size("s") - 1) * p) + 1).cast("int")).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)]
    return c.select("replication", "cases", "mean", "least", "largest", "sd", *ranks, (F.col("cases") / F.col("until")).alias("throughput"))


def bottlenecks(steps: DataFrame) -> DataFrame:
    """activity, mean wait and duration, and wait / (wait + duration)."""
    g = steps.groupBy("activity").agg(F.avg(F.col("start") - F.col("queued")).alias("wait"), F.avg(F.col("end") - F.col("start")).alias("duration"))
    return g.withColumn("score", F.when(F.col("wait") + F.col("duration") > 0, F.col("wait") / (F.col("wait") + F.col("duration"))).otherwise(0.0))


def utilisation(steps: DataFrame) -> DataFrame:
    """resource and its busy share of each replication's length, on average."""
    until = steps.groupBy("replication").agg(F.max("end").alias("until"))
    busy = steps.groupBy("replication", "resource").agg(F.sum(F.col("end") - F.col("start")).alias("busy"))
    return busy.join(until, "replication").groupBy("resource").agg(F.avg(F.col("busy") / F.col("until")).alias("utilisation"))


