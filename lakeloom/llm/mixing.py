"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lakeloom.storage import discard, materialise

WORDS = r"[^\x20\x09-\x0D]+"
BINS = 1 << 16


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _numbered(names: DataFrame) -> DataFrame:
    """``names`` with i, the place of ``source`` in code-point order, null last.  Ranges of sources are
    numbered apart and shifted by what stands before them, so no task has all sources."""
    parts = materialise(names.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = sizes.select("_part", (F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("i", own).join(before, "_part").withColumn("i", F.col("i") - 1 + F.col("_before")).drop("_part", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_copies: float) -> DataFrame:
    """One row per source: source_size and target.  Water filling: every source gets
    min(cap, level * weight).  The level starts where no cap binds and rises by what the bound ones
    leave over, until no more are bound."""
    s = materialise(_numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    level, bound = -1.0, -1
    budget = F.lit(float((s.agg(F.sum("source_size")).first()[0] or 0) * 1.0) * float(share))
    while True:
        full = (F.col("cap") / F.col("w") < F.lit(level)) if level >= 0 else F.lit(False)
        spent = F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0))
        row = s.agg(((budget - spent) / F.sum(F.when(~full, F.col("w")))).alias("level"), F.count(F.when(full, 1)).alias("bound")).first()
        if row["level"] is None or row["bound"] == bound:  # every cap binds, or no other one does
            level = level if row["level"] is not None else None
            break
        level, bound = row["level"], row["bound"]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame, seed: str, importance: str | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """_size, _u and _imp of every row, with doc_id, source and the columns to keep."""
    imp = F.lit(1.0) if importance is None else F.greatest(F.coalesce(F.nanvl(F.col(importance).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1e-9))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    own = [c for c in keep if c not in ("doc_id", "source")]
    return docs.select("doc_id", "source", *own, size.alias("_size"), uniform(F.col("doc_id"), seed).alias("_u"), imp.alias("_imp"))


def rates(sizes: DataFrame, targets: DataFrame, max_copies: float, rounds: int = 60) -> DataFrame:
    """Per source (src, target, source_size) the factor ``scale`` by which importances become rates: a
    document is wanted min(max_copies, scale * importance) times, and over the source that comes to the
    target.  Each round solves for the documents that the cap does not bind yet and finds those that it
    binds then; all sources at once, in partial aggregates."""
    plan = materialise(targets.select(F.col("source").alias("src"), "source_size", "target", F.lit(0.0).alias("scale")), "scale")
    for _ in range(rounds):
        full = F.col("scale") * F.col("_imp") >= max_copies
        rows = sizes.join(plan, F.col("source").eqNullSafe(F.col("src")))
        free = rows.groupBy(F.col("src").alias("f_src")).agg(F.sum(F.when(full, F.col("_size")).otherwise(0)).alias("bound"), F.sum(F.when(~full, F.col("_size") * F.col("_imp"))).alias("free"))
        scale = F.greatest("scale", F.coalesce(F.try_divide(F.col("target") - max_copies * F.col("bound"), F.col("free")), F.lit(0.0)))
        after = materialise(plan.join(free, F.col("src").eqNullSafe(F.col("f_src")), "left").select("src", "source_size", "target", scale.alias("scale"), (scale > F.col("scale") * (1 + 1e-12)).alias("rose")), "scale")
        done = after.where("rose").isEmpty()
        plan = after.drop("rose")
        if done:
            break
    return plan


def _rate(max_copies: float) -> Column:
    """How often a document is wanted.  Without importances it is its source's rate, to the last bit."""
    own = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    return F.when(F.col("scale").isNull(), own).otherwise(F.least(F.lit(float(max_copies)), F.col("scale") * F.col("_imp")))


def _with_odds(rows: DataFrame, max_copies: float) -> DataFrame:
    """certain (whole copies), p (inclusion probability of one more) and q, Pareto's rank: the odds of
    the random number over the odds of inclusion; null where whole copies are all there is."""
    rows = rows.withColumn("certain", F.floor(_rate(max_copies)).cast("long"))
    rows = rows.withColumn("p", F.least(_rate(max_copies) - F.col("certain"), F.lit(1 - 1e-9)))
    return rows.withColumn("q", F.when(F.col("p") > 0, F.col("_u") / (1 - F.col("_u")) / (F.col("p") / (1 - F.col("p")))))


def _order(q: Column) -> Column:
    return F.struct(q.alias("q"), F.col("doc_id").alias("id"), F.col("_size").alias("size"))


def _words_before(bins: DataFrame) -> DataFrame:
    """bins(b_src, b_bin, words) with the words of their source's bins before them.  256 bins at a time are
    summed apart and shifted by what stands before those, so no task has all bins of a source."""
    bins = bins.withColumn("b_group", F.floor(F.col("b_bin") / 256))
    groups = bins.groupBy(F.col("b_src").alias("g_src"), F.col("b_group").alias("g_group")).agg(F.sum("words").alias("g_words"))
    shift = F.sum("g_words").over(W.partitionBy("g_src").orderBy("g_group").rowsBetween(W.unboundedPreceding, 0)) - F.col("g_words")
    own = F.sum("words").over(W.partitionBy("b_src", "b_group").orderBy("b_bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")
    groups = groups.select("g_src", "g_group", shift.alias("g_before"))
    bins = bins.withColumn("before", own).join(groups, F.col("b_src").eqNullSafe(F.col("g_src")) & (F.col("b_group") == F.col("g_group")))
    return bins.select("b_src", "b_bin", (F.col("before") + F.col("g_before")).alias("before"))


def mix_plan(sizes: DataFrame, weights: tuple[int, ...], share: float, max_copies: float, importance: bool = False) -> DataFrame:
    """One row per source: source_size, target, scale, the rank up to which documents are sampled (cut)
    and one more document (more)."""
    targets = source_targets(sizes.select("source", F.col("_size").alias("size")), weights, share, max_copies)
    if importance:
        plan = rates(sizes, targets, max_copies)
    else:
        plan = materialise(targets.select(F.col("source").alias("src"), "source_size", "target", F.lit(None).cast("double").alias("scale")), "plan")
    ranked = _with_odds(sizes.join(plan, F.col("source").eqNullSafe(F.col("src"))), max_copies)
    # what whole copies leave over, and the odds of a typical document, by which ranks are dealt over bins
    base = ranked.groupBy(F.col("src").alias("r_src")).agg((F.max("target") - F.sum(F.col("certain") * F.col("_size"))).alias("rest"), F.avg("p").alias("mean_p"))
    plan = materialise(plan.join(base, F.col("src").eqNullSafe(F.col("r_src")), "left").drop("r_src"), "rest")
    ranked = _with_odds(sizes.join(plan, F.col("source").eqNullSafe(F.col("src"))), max_copies).where(F.col("q").isNotNull())
    odds = F.col("q") * F.greatest(F.col("mean_p") / (1 - F.col("mean_p")), F.lit(1e-12))
    ranked = ranked.withColumn("bin", F.floor(odds / (1 + odds) * BINS).cast("int")).select("doc_id", "source", "_size", "rest", "q", "bin")
    bins = ranked.groupBy(F.col("source").alias("b_src"), F.col("bin").alias("b_bin")).agg(F.sum("_size").alias("words"))
    bins = _words_before(bins)
    ranked = ranked.join(bins, F.col("source").eqNullSafe(F.col("b_src")) & (F.col("bin") == F.col("b_bin"))).drop("b_src", "b_bin")
    within = W.partitionBy("source", "bin").orderBy("q", "doc_id", "_size").rowsBetween(W.unboundedPreceding, 0)
    inside = F.col("before") + F.sum("_size").over(within) <= F.col("rest")
    ranked = materialise(ranked.withColumn("inside", inside).select("doc_id", "source", "_size", "rest", "q", "inside"), "ranked")
    cuts = ranked.groupBy(F.col("source").alias("c_src")).agg(
        (F.max("rest") - F.sum(F.when(F.col("inside"), F.col("_size")).otherwise(0))).alias("gap"),
        F.max(F.when(F.col("inside"), _order(F.col("q")))).alias("cut"),
    )
    cuts = materialise(cuts, "cuts")
    miss = F.abs(F.col("_size") - F.col("gap"))
    more = ranked.where(~F.col("inside") & (F.col("_size") > 0)).join(cuts, F.col("source").eqNullSafe(F.col("c_src"))).where(miss < F.col("gap"))
    more = more.groupBy(F.col("c_src").alias("m_src")).agg(F.min(F.struct(miss.alias("miss"), _order(F.col("q")).alias("more"))).alias("m")).select("m_src", F.col("m.more").alias("more"))
    plan = plan.join(cuts.select("c_src", "cut"), F.col("src").eqNullSafe(F.col("c_src")), "left").join(more, F.col("src").eqNullSafe(F.col("m_src")), "left")
    plan = materialise(plan.drop("c_src", "m_src", "rest", "mean_p"), "full_plan")
    discard(ranked)
    return plan


def apply_plan(sizes: DataFrame, plan: DataFrame, max_copies: float) -> DataFrame:
    """Adds source_size, target, certain, sampled and taken; each row is decided by itself against
    its source's plan."""
    out = _with_odds(sizes.join(plan, F.col("source").eqNullSafe(F.col("src"))), max_copies)
    own = _order(F.col("q"))
    sampled = F.col("q").isNotNull() & (F.coalesce(own <= F.col("cut"), F.lit(False)) | F.coalesce(own == F.col("more"), F.lit(False)))
    out = out.withColumn("sampled", sampled).withColumnRenamed("_size", "size")
    return out.withColumn("taken", (F.col("certain") + F.col("sampled").cast("long")) * F.col("size")).drop("src", "scale", "p", "cut", "more", "_u", "_imp", "q")


#: Columns that mix_sources uses or adds; of these names none is kept.
_OWN = ("size", "source_size", "target", "certain", "sampled", "taken", "scale", "p", "q", "cut", "more", "src", "_size", "_u", "_imp")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_copies: float = 2.0, seed: str = "mix-1", importance: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document a mix takes.

    Sources in code-point order (null last) get the weights in turn and share ``share`` times all
    words; a source gets at most ``max_copies`` times its own.  A document is wanted ``rate`` times:
    target / source_size, or with ``importance`` (a column) min(max_copies, scale * importance), scale
    being such that the rates of a source come to its target.  It is certain of floor(rate) whole
    copies, and p = rate - floor(rate) is the inclusion probability of one more.  What is left of the
    target is a sample of fixed size in words: documents are ranked by Pareto's q = odds(u) / odds(p),
    u a hash of seed and doc_id, and taken in that order until the first that does not fit in the words
    left.  One document more is taken if one brings the total nearer to the target.  Shorter documents
    behind the first that does not fit are left out, so a source of a few very long documents can miss
    its target by far.

    Ranks are summed by 65,536 bins and ordered within a bin, so a source that holds any share of the
    rows is dealt over all tasks; bins are even in u where all p of a source are equal, however small,
    as q is taken by the odds of the source's mean p.  What comes of it is a cut per source, and
    documents are decided against it one by one, without moving their texts.

    Returns doc_id, source, the columns named in ``keep`` (but for names that this function uses), size,
    source_size, target, certain, sampled, taken, one row per row of ``docs``.  Null text has size 0 and
    takes 0; null sources are one source, the last; a null doc_id hashes as the string 'null'; rows that
    repeat a doc_id have one rank; importances that are null, NaN or not positive count as 1e-9; an
    empty table gives no rows.
    """
    keep = tuple(c for c in keep if c not in _OWN)
    sizes = materialise(sized(docs, seed, importance), "sizes")
    plan = mix_plan(sizes, weights, share, max_copies, importance is not None)
    return apply_plan(sized(docs, seed, importance, keep) if keep else sizes, plan, max_copies)
