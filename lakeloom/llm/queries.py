"""The corpus operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeloom.llm import chat_format, decontaminate, exact_dedup, line_dedup, mixing, near_dedup, pii, substring_dedup, token_rollup, toxicity
from lakeloom.storage import scratch_path, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


OP1 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "row_key")


OP2 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, g.n, item FROM grams g JOIN windows v ON g.n = v.n AND g.phrase = v.phrase),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS item_list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(item_list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.token_totals(table(spark, sf_dir, "documents"), scratch_path(spark, "token_rollup"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (gram) WHERE first_doc < doc_id),
k AS (SELECT d.doc_id, r.p IS NOT NULL AS gone, d.word, d.i
      FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) d LEFT JOIN r ON d.doc_id = r.doc_id AND d.i = r.p),
a AS (SELECT doc_id, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line
      FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
b AS (SELECT line, min(doc_id) AS first_doc FROM l WHERE len(regexp_extract_all(line, '[^ ]+')) >= 1
      GROUP BY line HAVING count(DISTINCT source) >= CASE WHEN len(regexp_extract_all(line, '[^ ]+')) >= 3 THEN 8 ELSE 16 END),
k AS (SELECT l.*, b.line IS NOT NULL AND b.first_doc <> l.doc_id AS gone FROM l LEFT JOIN b USING (line))
SELECT doc_id, CAST(max(i) AS BIGINT) * max(CASE WHEN line <> '' OR i > 1 THEN 1 ELSE 0 END) AS n_lines,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s0),
s2 AS (SELECT *, CAST([5.0, 2.0, 1.0][1 + i % 3] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget,
              sum(cap) OVER (ORDER BY cap / w, i ROWS UNBOUNDED PRECEDING) - cap AS before,
              sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM s2),
s4 AS (SELECT *, max(CASE WHEN cap / w >= (budget - before) / w_left THEN (budget - before) / w_left END) OVER () AS level FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS certain,
              CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM s5),
s7 AS (SELECT *, least(rate - certain, 1 - 1e-9::DOUBLE) AS p, target - certain * source_size AS rest FROM s6),
r AS (SELECT doc_id, source, size, source_size, target, certain, rest,
             CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS q
      FROM d JOIN s7 USING (source)),
c AS (SELECT *, coalesce(q IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest, false) AS inside FROM r),
g AS (SELECT *, rest - sum(CASE WHEN inside THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY source, NOT inside AND q IS NOT NULL AND size > 0 AND abs(size - gap) < gap
                                   ORDER BY abs(size - gap), q, doc_id) = 1
             AND NOT inside AND q IS NOT NULL AND size > 0 AND abs(size - gap) < gap AS last FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((certain + CASE WHEN inside OR coalesce(last, false) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM b
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).drop("row_key")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    message = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.lit(None).cast("string").alias("content"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("value"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), message.alias("m")))).alias("ts"))
    chats = chats.select("conv_id", chat_format.as_record({"messages": F.transform("ts", lambda t: t["m"])}, ("role", "text")).alias("r"))
    back = chat_format.read_back(chat_format.format_records(chats))
    lines = F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS body,
             replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_mix_sources": op3_mix_sources,
    "op4_token_counts": op4_token_counts,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pii": op6_pii,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_near_dedup": op9_near_dedup,
    "op10_chat_format": op10_chat_format,
}
ORACLE: dict[str, str] = {"op1_exact_dedup": OP1, "op2_decontaminate": OP2, "op5_substring_dedup": OP5, "op7_line_dedup": OP7, "op3_mix_sources": OP3, "op10_chat_format": OP10}
