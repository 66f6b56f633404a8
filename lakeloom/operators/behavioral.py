"""User behaviour: profiles, anomalies, fraud signatures, causal graphs, forensic queries and event
correlation, over events(id, user_id, event_type, ts, session_id, device_id, location)."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakeloom.operators.iterate import components


def _user():
    return W.partitionBy("user_id").orderBy("ts", "id")

_GLOBAL_BUCKET = 86_400


def _hour(ts: str = "ts") -> Column:
    return (F.floor(F.col(ts) / 3600) % 24).cast("int")


def temporal_features(events: DataFrame) -> DataFrame:
    """peak_hour (the later of equals), shares of 9-17 h and 22-5 h, of days 5 and 6 of the epoch week, and
    the entropy of hours in nats."""
    h = events.select("user_id", _hour().alias("hour"), (F.floor(F.col("ts") / 86400) % 7).alias("day"))
    by = h.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("day").isin(5, 6), 1)).alias("odd"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("user_id"))
    by = by.withColumn("p", p)
    return by.groupBy("user_id").agg(
        F.max(F.struct("n", "hour"))["hour"].cast("double").alias("peak_hour"), F.sum(F.when(F.col("hour").between(9, 17), F.col("p")).otherwise(0.0)).alias("business_ratio"),
        F.sum(F.when((F.col("hour") >= 22) | (F.col("hour") < 6), F.col("p")).otherwise(0.0)).alias("night_ratio"), (F.sum("odd") / F.sum("n")).alias("weekend_ratio"), (-F.sum(F.col("p") * F.log("p"))).alias("hour_entropy"),
    )


def frequency_features(events: DataFrame) -> DataFrame:
    """Events a day (of at least one), share of the commonest type, types an event, and mean and population
    deviation of the seconds between events."""
    gap = events.select("user_id", "event_type", "ts", (F.col("ts") - F.lag("ts").over(_user())).alias("gap"))
    a = gap.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), ((F.max("ts") - F.min("ts")) / 86400).alias("days"), F.count_distinct("event_type").alias("types"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"), F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("sd_gap"))
    top = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("k")).groupBy("user_id").agg(F.max("k").alias("top"))
    return a.join(top, "user_id").select("user_id", (F.col("n") / F.greatest("days", F.lit(1.0))).alias("avg_events_per_day"), (F.col("top") / F.col("n")).alias("dominant_ratio"), (F.col("types") / F.col("n")).alias("diversity"), "mean_gap", "sd_gap")


def session_features(events: DataFrame) -> DataFrame:
    s = events.where("session_id IS NOT NULL").groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("n"), (F.max("ts") - F.min("ts")).alias("span"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("session_count"), F.avg("n").alias("events_per_session"), F.avg("span").alias("session_seconds"))


def device_features(events: DataFrame) -> DataFrame:
    """Distinct devices and locations, and the share of events that switch them."""
    s = events.select("user_id", "device_id", "location", F.lag("device_id").over(_user()).alias("d"), F.lag("location").over(_user()).alias("l"))
    switch = lambda a, b: F.count(F.when(F.col(a) != F.col(b), 1)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))
    return s.groupBy("user_id").agg(F.count_distinct("device_id").cast("double").alias("unique_device_count"), F.count_distinct("location").cast("double").alias("unique_location_count"), switch("device_id", "d").alias("device_switch_rate"), switch("location", "l").alias("location_switch_rate"))


def stability(events: DataFrame) -> DataFrame:
    """1 - |a - b| / (a + b + 0.001) of the events a day in a user's first and second half; 0.5 for under ten
    events; never below 0."""
    k, n = F.row_number().over(_user()), F.count(F.lit(1)).over(W.partitionBy("user_id"))
    h = events.select("user_id", "ts", k.alias("k"), n.alias("n")).withColumn("half", F.when(F.col("k") <= F.floor(F.col("n") / 2), "a").otherwise("b"))
    rate = lambda x: F.count(F.when(F.col("half") == x, 1)) / F.greatest((F.max(F.when(F.col("half") == x, F.col("ts"))) - F.min(F.when(F.col("half") == x, F.col("ts")))) / 86400, F.lit(1.0))
    g = h.groupBy("user_id").agg(F.max("n").alias("n"), rate("a").alias("a"), rate("b").alias("b"))
    return g.select("user_id", F.when(F.col("n") < 10, 0.5).otherwise(F.greatest(1 - F.abs(F.col("a") - F.col("b")) / (F.col("a") + F.col("b") + 0.001), F.lit(0.0))).alias("stability"))


def confidence(events: DataFrame) -> DataFrame:
    """0.4 n / 100 + 0.3 days / 30 + 0.3 (events a day) / 10, each at most its weight."""
    g = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.greatest((F.max("ts") - F.min("ts")) / 86400, F.lit(1.0)).alias("days"))
    one = F.lit(1.0)
    return g.select("user_id", (0.4 * F.least(F.col("n") / 100, one) + 0.3 * F.least(F.col("days") / 30, one) + 0.3 * F.least(F.col("n") / F.col("days") / 10, one)).alias("confidence"))


def profiles(events: DataFrame) -> DataFrame:
    """All features of each user in one row."""
    out = temporal_features(events)
    for fn in (frequency_features, device_features, stability, confidence):
        out = out.join(fn(events), "user_id", "left")
    return out.join(session_features(events), "user_id", "left")


def profile_features(profile: DataFrame) -> DataFrame:
    """user_id, feature, value."""
    return profile.unpivot("user_id", [c for c in profile.columns if c != "user_id"], "feature", "value").where("value IS NOT NULL")


def anomaly_scores(events: DataFrame, profile: DataFrame, threshold: float = 50.0) -> DataFrame:
    """id, score (100 at most), kind (Temporal, Geographic, Device, Velocity, Mixed or null) and is_anomaly.
    Hours are compared around the clock; places and devices with those of the user's earlier events, for
    users that have under three; velocity with five times what an hour should have."""
    prior = W.partitionBy("user_id").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, -1)
    first = lambda c: F.row_number().over(W.partitionBy("user_id", c).orderBy("ts", "id")) == 1
    hour_back = W.partitionBy("user_id").orderBy("ts").rangeBetween(-3600, 0)
    same = F.row_number().over(W.partitionBy("user_id", "ts").orderBy(F.col("id").desc()))
    e = events.withColumn("new_place", first("location")).withColumn("new_device", first("device_id")).withColumn("recent", F.count(F.lit(1)).over(hour_back) - same).withColumn("seen", F.count(F.lit(1)).over(prior))
    p = profile.select("user_id", "peak_hour", "unique_location_count", "unique_device_count", "avg_events_per_day")
    e = e.join(p, "user_id")
    gap = F.abs(_hour() - F.col("peak_hour"))
    hour = F.least(gap, 24 - gap) / 12 * 100
    place = F.col("location").isNotNull() & F.col("new_place") & (F.col("unique_location_count") < 3)
    device = F.col("device_id").isNotNull() & F.col("new_device") & (F.col("unique_device_count") < 3)
    rate = F.col("avg_events_per_day") / 24
    fast = F.col("recent") > rate * 5
    e = e.withColumn("h", hour).withColumn("velocity", F.when(fast, F.least(F.col("recent") / rate - 1, F.lit(100.0))).otherwise(0.0))
    kinds = F.array_compact(F.array(F.when(F.col("h") > 30, "Temporal"), F.when(place, "Geographic"), F.when(device, "Device"), F.when(fast, "Velocity")))
    score = F.col("h") * 0.2 + F.when(place, 12.5).otherwise(0.0) + F.when(device, 8.0).otherwise(0.0) + F.col("velocity") * 0.35
    kind = F.when(F.size(kinds) > 1, "Mixed").when(F.size(kinds) == 1, kinds[0])
    return e.select("id", "user_id", F.least(score, F.lit(100.0)).alias("score"), kind.alias("kind"), (score >= threshold).alias("is_anomaly"))


# --- signatures


def match_sequence(events: DataFrame, sequence: list[str], severity: float) -> DataFrame:
    """user_id, start, span, score of users whose events follow a sequence without others between: 100, 80, 60
    or 40 for spans under 5 minutes, an hour, a day or more, times severity / 100; the best of each user."""
    hit = F.col("event_type") == sequence[0]
    for i, x in enumerate(sequence[1:], 1):
        hit = hit & (F.lead("event_type", i).over(_user()) == x)
    last = F.lead("ts", len(sequence) - 1).over(_user()) if len(sequence) > 1 else F.col("ts")
    s = events.select("user_id", "ts", last.alias("until"), hit.alias("hit")).where("hit").withColumn("span", F.col("until") - F.col("ts"))
    base = F.when(F.col("span") < 300, 100.0).when(F.col("span") < 3600, 80.0).when(F.col("span") < 86400, 60.0).otherwise(40.0)
    best = s.withColumn("score", base * severity / 100).groupBy("user_id").agg(F.max(F.struct("score", (-F.col("ts")).alias("t"), "span")).alias("b"))
    return best.select("user_id", (-F.col("b.t")).alias("start"), "b.span", "b.score")


def match_attributes(events: DataFrame, event_type: str, attributes: dict[str, str], severity: float) -> DataFrame:
    """user_id, n, score of users with events of a type and the given attribute values."""
    same = F.col("event_type") == event_type
    for k, v in attributes.items():
        same = same & (F.abs(F.col(k) - v) < 1e-4 if isinstance(v, float) else F.col(k) == v)
    return events.where(same).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("score", F.lit(float(severity)))


def match_time_window(events: DataFrame, types: list[str], window: int, severity: float) -> DataFrame:
    """user_id, start, span, score of users with all types within a window; shorter spans score higher."""
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(0, window)
    e = events.where(F.col("event_type").isin(types))
    firsts = [F.min(F.when(F.col("event_type") == t, F.col("ts"))).over(w) for t in types]
    s = e.select("user_id", "ts", F.greatest(*firsts).alias("until") if len(firsts) > 1 else firsts[0].alias("until"), *[f.alias(f"f{i}") for i, f in enumerate(firsts)])
    ok = F.lit(True)
    for i in range(len(types)):
        ok = ok & F.col(f"f{i}").isNotNull()
    s = s.where(ok).withColumn("span", F.col("until") - F.col("ts")).withColumn("score", severity * (0.5 + 0.5 * (1 - F.col("span") / window)))
    best = s.groupBy("user_id").agg(F.max(F.struct("score", (-F.col("ts")).alias("t"), "span")).alias("b"))
    return best.select("user_id", (-F.col("b.t")).alias("start"), "b.span", "b.score")


def match_count(events: DataFrame, event_type: str, least: int, window: int, severity: float) -> DataFrame:
    """user_id, n, score of users with many events of a type within a window."""
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(0, window)
    n = events.where(F.col("event_type") == event_type).select("user_id", F.count(F.lit(1)).over(w).alias("n")).groupBy("user_id").agg(F.max("n").alias("n"))
    return n.where(F.col("n") >= least).withColumn("score", F.least(severity * F.col("n") / least, F.lit(100.0)))


def match_substring(events: DataFrame, pattern: str, columns: list[str], severity: float) -> DataFrame:
    """user_id, n, score of users with the pattern, taken literally, in a column."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").contains(pattern), F.lit(False))
    return events.where(hit).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("score", F.lit(float(severity)))


# fixed values: the signatures that come with the engine
SIGNATURES = [
    (1, "Rapid Login Attempts", "CountThreshold", {"event_type": "login_attempt", "least": 5, "window": 60}, 70.0),
    (2, "Account Takeover Sequence", "EventSequence", {"sequence": ["password_reset", "login", "profile_change"]}, 90.0),
    (3, "Suspicious Time Window", "TimeWindow", {"types": ["login", "high_value_purchase", "logout"], "window": 300}, 80.0),
    (4, "Gift Card Fraud Pattern", "Regex", {"pattern": "gift.*card"}, 60.0),
]


def standard_signatures(spark) -> DataFrame:
    """signature, name, pattern, severity."""
    return spark.createDataFrame([(i, name, kind, severity) for i, name, kind, _, severity in SIGNATURES], "signature int, name string, pattern string, severity double")


def match_signatures(events: DataFrame, signatures: list[tuple] | None = None) -> DataFrame:
    """signature, user_id, score of users that match a signature, from the best score down within each."""
    found = None
    for i, _, kind, spec, severity in SIGNATURES if signatures is None else signatures:
        if kind == "CountThreshold":
            hit = match_count(events, spec["event_type"], spec["least"], spec["window"], severity)
        elif kind == "EventSequence":
            hit = match_sequence(events, spec["sequence"], severity)
        elif kind == "TimeWindow":
            hit = match_time_window(events, spec["types"], spec["window"], severity)
        else:
            hit = match_substring(events, spec["pattern"], spec.get("columns", ["event_type"]), severity)
        hit = hit.select(F.lit(i).alias("signature"), "user_id", "score")
        found = hit if found is None else found.unionByName(hit)
    return found


# --- causality


def causal_edges(events: DataFrame, max_lag: int = 3_600, least: int = 3, strength: float = 0.1) -> DataFrame:
    """source, target, n, strength, mean_lag: event types that come right after one another, at most an hour,
    in the order of all events.  The order is global; days are ordered apart, and the last event of a day
    hands over to the first of the next, so no task has all events."""
    day = F.floor(F.col("ts") / _GLOBAL_BUCKET)
    w = W.partitionBy("day").orderBy("ts", "id")
    e = events.select(day.alias("day"), "ts", "id", "event_type").withColumn("next", F.lead(F.struct("event_type", "ts")).over(w))
    heads = e.groupBy("day").agg(F.min(F.struct("ts", "id", "event_type")).alias("h")).select(F.lag("day").over(W.orderBy("day")).alias("day"), F.struct("h.event_type", "h.ts").alias("head"))
    e = e.join(heads, "day", "left").withColumn("next", F.coalesce("next", "head"))  # a row for each day
    pairs = e.where("next IS NOT NULL").select(F.col("event_type").alias("source"), F.col("next.event_type").alias("target"), (F.col("next.ts") - F.col("ts")).alias("lag")).where((F.col("lag") <= max_lag) & (F.col("source") != F.col("target")))
    g = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.avg("lag").alias("mean_lag"))
    g = g.withColumn("strength", F.col("n") / F.sum("n").over(W.partitionBy("source")))
    return g.where((F.col("n") >= least) & (F.col("strength") >= strength))


def prune_to_dag(edges: DataFrame) -> DataFrame:
    """Edges taken by falling strength unless they close a cycle.  Event types are few, so the edges between
    them are too; they are ordered on the driver."""
    kept, reach = [], {}
    rows = edges.select("source", "target", "n", "strength", "mean_lag").orderBy(F.col("strength").desc(), "source", "target").collect()
    for r in rows:
        if r.source != r.target and r.source not in reach.get(r.target, set()):
            kept.append(tuple(r))
            new = {r.target} | reach.get(r.target, set())
            for x in [k for k, v in reach.items() if r.source in v] + [r.source]:
                reach.setdefault(x, set()).update(new)
    return edges.sparkSession.createDataFrame(kept, "source string, target string, n long, strength double, mean_lag double")


def causal_roles(edges: DataFrame) -> DataFrame:
    """event_type, root (out-degree / (in-degree + 1)) and effect (in / (out + 1)) scores; 1 or more makes a
    root cause or an effect."""
    d = edges.select(F.col("source").alias("event_type"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("event_type"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    g = d.groupBy("event_type").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return g.select("event_type", (F.col("o") / (F.col("i") + 1)).alias("root"), (F.col("i") / (F.col("o") + 1)).alias("effect"))


def causal_impact(edges: DataFrame, event_type: str) -> DataFrame:
    """target, depth and strength of what an event type leads to: itself at depth 0, then types it has not
    passed at depths 1 and 2, where strength is divided by depth + 1."""
    e = edges.select("source", "target", "strength")
    direct = e.where(F.col("source") == event_type)
    out = direct.select("target", F.lit(0).alias("depth"), "strength")
    seen = edges.sparkSession.createDataFrame([(event_type,)], "node string")
    level = direct.select(F.col("target").alias("node")).distinct()
    for depth in (1, 2):
        level = level.join(seen, "node", "left_anti")
        step = e.join(level, e["source"] == level["node"])
        out = out.unionByName(step.select("target", F.lit(depth).alias("depth"), (F.col("strength") / (depth + 1)).alias("strength")))
        seen, level = seen.unionByName(level), step.select(F.col("target").alias("node")).distinct()
    return out


# --- forensic queries


def in_scope(events: DataFrame, start: int, end: int, users: list[int] | None = None, types: list[str] | None = None) -> DataFrame:
    out = events.where(F.col("ts").between(start, end))
    out = out if users is None else out.where(F.col("user_id").isin(users))
    return out if types is None else out.where(F.col("event_type").isin(types))


def pattern_search(events: DataFrame, type_contains: str | None = None, device: str | None = None, location: str | None = None) -> DataFrame:
    for test in (type_contains and F.col("event_type").contains(type_contains), device and F.col("device_id") == device, location and F.col("location") == location):
        if test is not None:
            events = events.where(test)
    return events


def timeline(events: DataFrame) -> DataFrame:
    """One row: start, end, duration, events, events an hour (of at least one), users and sessions."""
    a = events.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.count_distinct("session_id").alias("sessions"))
    span = F.col("end") - F.col("start")
    return a.withColumn("duration", span).withColumn("events_per_hour", F.col("events") / F.greatest(span / 3600, F.lit(1.0)))


def activity_summary(events: DataFrame) -> DataFrame:
    """name, value: counts and shares by type, the peak hour, and events a user."""
    total = F.broadcast(events.agg(F.count(F.lit(1)).alias("total")))
    by = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(total)
    counts = by.select(F.explode(F.array(F.struct(F.concat(F.lit("count_"), "event_type").alias("name"), F.col("n").cast("double").alias("value")), F.struct(F.concat(F.lit("ratio_"), "event_type").alias("name"), (F.col("n") / F.col("total")).alias("value")))).alias("x")).select("x.*")
    peak = events.groupBy(_hour().alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "h"))["h"].cast("double").alias("value")).select(F.lit("peak_hour").alias("name"), "value")
    users = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("avg_events_per_user"), F.max("n").cast("double").alias("max_events_per_user"), F.count(F.lit(1)).cast("double").alias("users"))
    users = users.select(F.stack(F.lit(3), *[x for c in ("avg_events_per_user", "max_events_per_user", "users") for x in (F.lit(c), F.col(c))]).alias("name", "value"))
    return counts.unionByName(peak).unionByName(users)


def anomaly_hunt(events: DataFrame, busy: int = 10) -> DataFrame:
    """id and reasons of events in a user's trailing hour of over ``busy`` events, or before 6 h."""
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(-3599, 0)
    e = events.withColumn("n", F.count(F.lit(1)).over(w))
    why = F.concat_ws(",", F.when(F.col("n") > busy, "burst"), F.when(_hour() < 6, "night"))
    return e.select("id", why.alias("reasons")).where("reasons <> ''")


def correlated_types(events: DataFrame, top: int = 5) -> DataFrame:
    """a, b, n and lift of types that follow one another within a user, the highest first."""
    s = events.select(F.col("event_type").alias("a"), F.lead("event_type").over(_user()).alias("b")).where("b IS NOT NULL")
    n = s.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    p = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("k"))
    total = F.broadcast(events.agg(F.count(F.lit(1)).alias("total")))
    j = n.join(p.toDF("a", "ka"), "a").join(p.toDF("b", "kb"), "b").crossJoin(total)
    return j.select("a", "b", "n", (F.col("n") / F.col("total") / (F.col("ka") / F.col("total") * F.col("kb") / F.col("total"))).alias("lift")).orderBy(F.col("lift").desc(), "a", "b").limit(top)


# --- correlation

WEIGHTS = {"temporal": 0.20, "user": 0.30, "session": 0.25, "device": 0.15, "location": 0.10}


_KEYS = {"user": "user_id", "session": "session_id", "device": "device_id", "location": "location"}


def _key_sets(window: int, least: float) -> list[tuple[tuple[bool, ...], int]]:
    """Sets of keys, as a flag for each of ``_KEYS``, that reach the score if two events share them, with the
    longest gap at which they may."""
    out = []
    for flags in itertools.product((False, True), repeat=len(_KEYS)):
        missing = least * sum(WEIGHTS.values()) - sum(WEIGHTS[k] for k, f in zip(_KEYS, flags, strict=True) if f)
        if missing <= WEIGHTS["temporal"] + 1e-9:
            out.append((flags, min(window, math.ceil(window * (1 - missing / WEIGHTS["temporal"])) + 1)))
    return out


def _best_partners(left: dict[str, np.ndarray], right: dict[str, np.ndarray], window: int, least: float, top: int) -> dict[str, np.ndarray]:
    """The ``top`` best partners of each left event.  Of the events that share a set of keys nearer ones score
    higher, so the ``top`` nearest of each set, which are slices of its events in order of time, have them all;
    a pair is taken from the set of all that it shares."""
    first = min(int(left["ts"].min(initial=0)), int(right["ts"].min(initial=0)))
    t, last = right["ts"] - first, int(right["ts"].max(initial=0)) - first
    span = last + int(left["ts"].max(initial=0)) - first + window + 2
    tables = []
    for flags, limit in _key_sets(window, least):
        both = [np.concatenate([right[k], left[k]]) for k, f in zip(_KEYS, flags, strict=True) if f]
        known = np.all([c >= 0 for c in both], axis=0) if both else np.ones(len(t) + len(left["ts"]), bool)
        group = np.zeros(len(known), np.int64)
        for c in both:
            group = np.unique(group * (c.max(initial=0) + 2) + c + 1, return_inverse=True)[1].reshape(-1)
        g, of = group[: len(t)], np.flatnonzero(known[: len(t)])
        ahead = of[np.lexsort((right["id"][of], g[of] * span + t[of]))]
        back = of[np.lexsort((right["id"][of], g[of] * span + last - t[of]))]
        tables.append((np.array(flags), limit, group[len(t) :], known[len(t) :], ahead, g[ahead] * span + t[ahead], back, g[back] * span + last - t[back]))
    found = []
    for start in range(0, len(left["ts"]), 4_096):
        rows = np.arange(start, min(start + 4_096, len(left["ts"])))
        pairs = []
        for flags, limit, group, known, ahead, at, back, at_back in tables:
            q = rows[known[rows]]
            k = group[q] * span + left["ts"][q] - first
            k_back = group[q] * span + last - (left["ts"][q] - first)
            lo, hi = np.searchsorted(at, k), np.searchsorted(at, k, "right")
            lo_back = np.searchsorted(at_back, k_back, "right")
            slices = ((ahead, lo, np.minimum(hi - lo, top + 1)), (ahead, hi, np.minimum(np.searchsorted(at, k + limit, "right") - hi, top)), (back, lo_back, np.minimum(np.searchsorted(at_back, k_back + limit, "right") - lo_back, top)))
            for order, begin, n in slices:
                p = np.repeat(q, n)
                o = order[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
                exact = left["id"][p] != right["id"][o]
                for name, f in zip(_KEYS, flags, strict=True):
                    exact &= ((left[name][p] == right[name][o]) & (left[name][p] >= 0)) == f
                pairs.append((p[exact], o[exact], np.full(exact.sum(), len(pairs) // 3)))
        p, o, which = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        gap = left["ts"][p] - right["ts"][o]
        near = 1 - np.abs(gap) / window
        shared = np.array([x[0] for x in tables]).reshape(-1, len(_KEYS))[which]
        score = near * WEIGHTS["temporal"]
        for i, name in enumerate(_KEYS):
            score = score + np.where(shared[:, i], WEIGHTS[name], 0.0)
        score = score / sum(WEIGHTS.values())
        keep = (score >= least) & (np.abs(gap) <= window)
        p, o, gap, near, shared, score = (x[keep] for x in (p, o, gap, near, shared, score))
        order = np.lexsort((right["id"][o], -score, p))
        order = order[np.arange(len(order)) - np.searchsorted(p[order], p[order]) < top]
        p, o, gap, near, shared, score = (x[order] for x in (p, o, gap, near, shared, score))
        kind = np.select([shared[:, 0], shared[:, 1], near > 0.5, shared[:, 2], shared[:, 3]], ["User", "Session", "Temporal", "Device", "Location"], "Temporal")
        found.append({"id": left["id"][p], "other": right["id"][o], "score": score, "kind": kind, "gap": gap})
    return {c: np.concatenate([x[c] for x in found]) for c in found[0]} if found else {}


def correlate(events: DataFrame, window: int = 3_600, least: float = 0.3, top: int = 50, queries: DataFrame | None = None) -> DataFrame:
    """id, other, score, kind, gap of event pairs within ``window`` seconds that share a user, session, device
    or place (what a score of 0.3 needs), the ``top`` best of each event.  Time is cut into buckets; a task has
    the events of one and those within the window around it, and looks up the best partners of each, so pairs
    beyond these are never listed.  ``queries`` restricts the left side."""
    names = {"id": "long", "ts": "long"} | dict.fromkeys(_KEYS.values())
    cast = lambda d: d.select(*[F.col(c).cast(kind) if kind else F.col(c) for c, kind in names.items()]).where("id IS NOT NULL AND ts IS NOT NULL")
    own = F.floor(F.col("ts") / window)
    right = cast(events).withColumn("bucket", F.explode(F.array(own - 1, own, own + 1)))
    sides = right.withColumn("side", F.when(F.col("bucket") == own, 2).otherwise(1)) if queries is None else right.withColumn("side", F.lit(1)).unionByName(cast(queries).withColumn("bucket", own).withColumn("side", F.lit(0)))
    schema = "id long, other long, score double, kind string, gap long"
    kinds = {"id": pa.int64(), "other": pa.int64(), "score": pa.float64(), "kind": pa.string(), "gap": pa.int64()}

    def bucket(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        columns = {c: rows[c].to_numpy().astype(np.int64) for c in ("id", "ts")} | {k: rows[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) for k, c in _KEYS.items()}
        left, right = ({k: v[at] for k, v in columns.items()} for at in (side != 1, side != 0))
        best = _best_partners(left, right, window, least, top)
        return pa.table({c: pa.array(best[c] if best else [], kind) for c, kind in kinds.items()})

    n = max(4 * events.sparkSession.sparkContext.defaultParallelism, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sides.repartition(n, "bucket").groupBy("bucket").applyInArrow(bucket, schema)


def _clusters(links: DataFrame) -> DataFrame:
    return components(links).groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1")


def correlation_clusters(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """label and size of the connected groups of strongly correlated events."""
    return _clusters(pairs.where(F.col("score") >= threshold).select(F.col("id").alias("a"), F.col("other").alias("b")))


def event_clusters(events: DataFrame, window: int = 3_600, threshold: float = 0.7) -> DataFrame:
    """correlation_clusters of all pairs within ``window``, without listing them: of events that share a set of
    keys, those between two that are near enough are nearer still, so each is linked to the one before only."""
    e = events.select("id", "ts", *_KEYS.values()).where("id IS NOT NULL AND ts IS NOT NULL")
    links = None
    for flags, limit in _key_sets(window, threshold):
        on = [c for c, f in zip(_KEYS.values(), flags, strict=True) if f]
        known = e.dropna(subset=on) if on else e
        before = F.lag(F.struct(*e.columns)).over(W.partitionBy(*(on or [F.floor(F.col("ts") / window)])).orderBy("ts", "id"))
        if not on:  # the order of all events is cut by buckets; the first of one follows the last of the bucket before
            cut = known.withColumn("bucket", F.floor(F.col("ts") / window))
            ends = cut.groupBy((F.col("bucket") + 1).alias("bucket")).agg(F.max_by(F.struct(*e.columns), F.struct("ts", "id")).alias("end"))
            step = cut.join(ends, "bucket", "left").select(*e.columns, F.coalesce(before, F.col("end")).alias("o"))
        else:
            step = known.select(*e.columns, before.alias("o"))
        near = 1 - F.abs(F.col("ts") - F.col("o.ts")) / window
        score = near * WEIGHTS["temporal"]
        for k, c in _KEYS.items():
            score = score + F.when(F.col(c) == F.col(f"o.{c}"), WEIGHTS[k]).otherwise(0.0)
        link = step.where((F.col("ts") - F.col("o.ts") <= limit) & (score / sum(WEIGHTS.values()) >= threshold)).select(F.col("id").alias("a"), F.col("o.id").alias("b"))
        links = link if links is None else links.unionByName(link)
    return _clusters(links if links is not None else e.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))


def regular_pairs(events: DataFrame, least: int = 3, variation: float = 0.5) -> DataFrame:
    """a, b, n, score of types that follow one another within a user at regular gaps: 1 - sd / mean."""
    s = events.select(F.col("event_type").alias("a"), F.lead("event_type").over(_user()).alias("b"), (F.lead("ts").over(_user()) - F.col("ts")).alias("gap")).where("b IS NOT NULL")
    g = s.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("sd"))
    cv = F.try_divide(F.col("sd"), F.col("m"))
    return g.where((F.col("n") >= least) & (cv < variation)).select("a", "b", "n", (1 - cv).alias("score"))


def pairs_of_kinds(events: DataFrame, kinds: list[str], window: int = 3_600) -> DataFrame:
    """a < b and gap of event pairs within a window that share all of the given: user, session, device,
    location."""
    keys = {"user": "user_id", "session": "session_id", "device": "device_id", "location": "location"}
    on = [keys[k] for k in kinds if k in keys]
    cut = F.floor(F.col("ts") / window)
    a = events.select(F.col("id").alias("a"), F.col("ts").alias("ta"), *on, F.explode(F.array(cut - 1, cut, cut + 1)).alias("bucket"))
    b = events.select(F.col("id").alias("b"), F.col("ts").alias("tb"), *on, cut.alias("bucket"))
    return a.join(b, [*on, "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= window)).select("a", "b", F.abs(F.col("ta") - F.col("tb")).alias("gap"))
