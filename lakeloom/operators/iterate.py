"""Fixpoint loops over DataFrames.  Every round's state is written to the shared folder, so plans
stay short and a lost executor costs a reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lakeloom.storage import discard, materialise


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, DataFrame], bool] | None, limit: int, name: str = "state", must_settle: bool = False) -> DataFrame:
    """Applies ``step`` until ``done(before, after)`` or ``limit`` rounds (all of them without ``done``).
    With ``must_settle`` it is an error if the limit comes first."""
    state = materialise(state, f"{name}_0")
    for i in range(limit):
        after = materialise(step(state, i), f"{name}_{i + 1}")
        settled = done is not None and done(state, after)
        discard(state)
        state = after
        if settled:
            return state
    if must_settle:
        raise RuntimeError(f"{name} did not settle in {limit} rounds")
    return state


def components(edges: DataFrame, limit: int = 200) -> DataFrame:
    """id and label (smallest id of the component) for every id of the edges (a, b), which count in
    both directions: alternating large-star and small-star rounds."""
    state = edges.select("a", "b").where("a <> b").distinct()

    def step(e: DataFrame, _: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("v"), F.col("b").alias("u")).where("v <> u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return star.where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    stars = fixpoint(state, step, lambda x, y: mark(x) == mark(y), limit, "stars", must_settle=True)
    ids = stars.select(F.col("b").alias("id"), F.col("a").alias("label")).unionByName(stars.select(F.col("a").alias("id"), F.col("a").alias("label")))
    alone = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(ids.select("id"), "id", "left_anti").select("id", F.col("id").alias("label"))
    return ids.groupBy("id").agg(F.min("label").alias("label")).unionByName(alone)
