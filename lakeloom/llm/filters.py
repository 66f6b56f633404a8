"""A bit-set filter of fixed size, applied as a broadcast join inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the set; it travels as at most a million rows of 16 bytes (BITS / 64).
BITS = 1 << 26


def _slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def key_words(keys: DataFrame, column: str) -> DataFrame:
    """The set of the keys as (word, bits) rows."""
    return keys.groupBy(F.shiftright(_slot(column), 6).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))")).alias("_bits"))


def flag_maybe(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` with a column maybe: false if ``column`` is surely not among the ``keys``."""
    found = rows.withColumn("_word", F.shiftright(_slot(column), 6)).join(F.broadcast(key_words(keys, column)), "_word", "left")
    hit = F.coalesce(F.getbit("_bits", (_slot(column) % 64).cast("int")) == 1, F.lit(False))
    return found.withColumn("maybe", hit).drop("_word", "_bits")


def maybe_among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` may be among the ``keys``; all that are, and by chance a few
    others.  However many keys there are, what is sent to every task stays under 16 MB."""
    found = rows.withColumn("_word", F.shiftright(_slot(column), 6)).join(F.broadcast(key_words(keys, column)), "_word")
    return found.where(F.getbit("_bits", (_slot(column) % 64).cast("int")) == 1).drop("_word", "_bits")


def without_rows(rows: DataFrame, gone: DataFrame, row_key: Column) -> DataFrame:
    """``rows`` without those in ``gone`` (doc_id, row_key), with the columns of ``rows``, whatever
    their names.  Rows that the filter clears pass without a shuffle; only the others are joined."""
    columns = rows.columns
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("row_key").alias("_row_key"))
    flagged = flag_maybe(rows.select(F.struct(*columns).alias("_row"), row_key.alias("_row_key")), gone, "_row_key")
    clear = flagged.where(~F.col("maybe")).select("_row.*")
    left = flagged.where("maybe").alias("r").join(gone.alias("g"), (F.col("r._row_key") == F.col("g._row_key")) & F.col("r._row.doc_id").eqNullSafe(F.col("g._gone_id")), "left_anti")
    return clear.unionByName(left.select("_row.*")).toDF(*columns)


def one_of_each(rows: DataFrame, repeated: DataFrame, row_key: Column) -> DataFrame:
    """``rows`` with one row only for each key in ``repeated`` (doc_id, row_key), any one of those that
    have it.  Rows that the filter clears pass as they are; copies meet in partial aggregation."""
    columns = rows.columns
    keys = repeated.select(F.col("doc_id").alias("_own_id"), F.col("row_key").alias("_row_key"))
    flagged = flag_maybe(rows.select(F.struct(*columns).alias("_row"), row_key.alias("_row_key")), keys, "_row_key")
    clear = flagged.where(~F.col("maybe")).select("_row.*")
    some = flagged.where("maybe").alias("r").join(keys.withColumn("_twice", F.lit(True)).alias("g"), (F.col("r._row_key") == F.col("g._row_key")) & F.col("r._row.doc_id").eqNullSafe(F.col("g._own_id")), "left").select("_row", F.col("r._row_key").alias("_row_key"), "_twice")
    single = some.where("_twice IS NULL").select("_row.*")
    once = some.where("_twice").groupBy(F.col("_row.doc_id").alias("_own_id"), "_row_key").agg(F.first("_row").alias("_row")).select("_row.*")
    return clear.unionByName(single).unionByName(once).toDF(*columns)
