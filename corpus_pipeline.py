"""A training corpus from raw documents: toxic documents out, boilerplate lines out, one document of
each group of near copies, benchmark passages out, sources mixed to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.

In every stage null and empty texts are texts without words, rows are judged one by one even where
they repeat, columns beyond those of documents pass through whatever their names, and an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeloom.llm import decontaminate, filters, line_dedup, mixing, near_dedup, toxicity
from lakeloom.storage import materialise, table


_REST = "_rest_of_row"


def _wrapped(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that an operator reads, and all others in one column, so that no name that the
    operator adds meets a column of ``docs``."""
    return docs.select(*own, F.struct(*[c for c in docs.columns if c not in own]).alias(_REST))


def _unwrapped(out: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The given columns of a result of wrapped documents, some of them new."""
    rest = out.schema[_REST].dataType.names
    return out.select(*[new.get(c, F.col(f"{_REST}.`{c}`" if c in rest else f"`{c}`")).alias(c) for c in columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    It learns from the labels that are not held out, of documents that are here.  Without labels of
    both kinds no score reaches the threshold unless most labels are toxic; rows without doc_id are
    scored like others; rows that repeat a text get one score and go or stay together.
    """
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), toxicity.held_out())
    return _unwrapped(toxicity.score(_wrapped(docs, "text"), model).where("predicted = 0"), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines that stand in another one; n_chars follows the text.

    A line stays in the document with the smallest doc_id that has it, and in every row with that id;
    a null doc_id is larger than any other.  No document goes: one that was boilerplate throughout is
    left with an empty text.  Null texts stay null, and n_chars of texts that lose nothing as it is.
    """
    out = line_dedup.line_dedup(_wrapped(docs, "doc_id", "source", "text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(f"{_REST}.n_chars"))
    return _unwrapped(out, docs.columns, n_chars=n_chars)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id, of several with this
    id the one whose text has the smallest hash, and of rows that repeat both any one.

    Empty and null texts are one class; texts of fewer than five words are compared as one shingle;
    a null doc_id stays only where its class has no other.
    """
    found = near_dedup.near_dedup(docs.select("doc_id", "text")).where("class_size > 1")
    keys = found.groupBy("doc_id", "row_key").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    keys = materialise(keys, "near_copies")
    left = filters.without_rows(docs, keys.where("NOT stays"), near_dedup.row_key())
    return filters.one_of_each(left, keys.where("stays AND n > 1"), near_dedup.row_key())


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark: ten words in sequence, or all words of a
    shorter item.

    Items without id, text or words match nothing, and an empty benchmark drops nothing; rows that
    repeat go or stay together.
    """
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    gone = materialise(found.where("contaminated").select("doc_id", "row_key"), "contaminated")
    return filters.without_rows(docs, gone, near_dedup.row_key())


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies (whole copies, repeats
    counted) and taken (words), which replace columns of these names.

    Null sources are one source, the last; texts without words have size 0 and are taken as copies
    where their source's rate is 1 or more; rows that repeat a doc_id are ranked by size; a null
    doc_id hashes as the string 'null'.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    kept = docs.drop(*added)
    out = mixing.mix_sources(_wrapped(kept, "doc_id", "source", "text"), keep=(_REST, "text"))
    out = out.withColumn("copies", F.col("certain") + F.col("sampled").cast("long")).where("copies > 0")
    return _unwrapped(out, [*kept.columns, *added])


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mix", mix_stage),
]

#: A classifier and similarity classes have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"after_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
