"""Chat formatting: schema fingerprints pick the mapping, SQL functions do the rest."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A known record layout: its nested field paths, and its turns as a SQL expression over the
    record ``r``."""

    name: str
    paths: tuple[str, ...]
    turns: str

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()


def _pair(user: str, assistant: str, system: str | None = None) -> str:
    first = f"named_struct('role', 'system', 'text', {system}), " if system else ""
    return f"array({first}named_struct('role', 'user', 'text', {user}), named_struct('role', 'assistant', 'text', {assistant}))"


def _listed(field: str, role: str, text: str) -> tuple[tuple[str, ...], str]:
    speaker = f"CASE m.{role} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE m.{role} END" if role == "from" else f"m.{role}"
    return (f"{field}", f"{field}[].{role}", f"{field}[].{text}"), f"transform(filter(r.{field}, m -> m IS NOT NULL), m -> named_struct('role', {speaker}, 'text', m.{text}))"


LAYOUTS = (
    *(Layout(f"{field}/{role}/{text}", *_listed(field, role, text)) for field in ("messages", "conversations", "turns") for role, text in (("role", "content"), ("role", "text"), ("from", "value"))),
    Layout("empty messages", ("messages",), f"cast(array() as {TURNS})"),
    Layout("prompt and response", ("prompt", "response"), _pair("r.prompt", "r.response")),
    Layout("prompt and completion", ("prompt", "completion"), _pair("r.prompt", "r.completion")),
    Layout("system, prompt and response", ("prompt", "response", "system"), _pair("r.prompt", "r.response", "r.system")),
    Layout("question and answer", ("question", "answer"), _pair("r.question", "r.answer")),
    Layout("instruction", ("instruction", "output"), _pair("r.instruction", "r.output")),
    Layout("instruction with input", ("instruction", "input", "output"), _pair("concat_ws('\\n\\n', r.instruction, nullif(r.input, ''))", "r.output")),
    Layout("instruction and response", ("instruction", "response"), _pair("r.instruction", "r.response")),
)
_LISTS = ("messages", "conversations", "turns")
_ITEM = ("role", "content", "text", "from", "value")
_FLAT = ("prompt", "response", "completion", "system", "question", "answer", "instruction", "input", "output")
_VALUES = T.StructType([T.StructField(x, T.ArrayType(T.StructType([T.StructField(y, T.StringType()) for y in _ITEM]))) for x in _LISTS] + [T.StructField(x, T.StringType()) for x in _FLAT])
#: All known fields, null where absent, and the known paths that the record's schema has, whether or not
#: it has values there.
RECORD = T.StructType([*_VALUES.fields, T.StructField("paths", T.ArrayType(T.StringType()))])
_SPEAKER = "CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE m.from END"
#: Lists whose messages differ in their fields: whichever are there.
MIXED = tuple(Layout(f"{field}, mixed", (field,), f"transform(filter(r.{field}, m -> m IS NOT NULL), m -> named_struct('role', coalesce(m.role, {_SPEAKER}), 'text', coalesce(m.content, m.text, m.value)))") for field in _LISTS)


def _below(field: str):
    return lambda name: F.concat(F.lit(f"{field}[]."), name)


def parse_record(payload: Column) -> Column:
    """A JSON payload as a RECORD; all null where it is no JSON object."""
    options = {"maxStringLen": "2147483647"}
    values = F.from_json(payload, _VALUES, options)
    top = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    paths = [F.array_intersect(top, F.array(*[F.lit(x) for x in _LISTS + _FLAT]))]
    known = F.array(*[F.lit(y) for y in _ITEM])
    for x in _LISTS:
        items = F.from_json(F.get_json_object(payload, f"$.{x}"), "array<string>", options)
        keys = F.flatten(F.transform(items, lambda m: F.coalesce(F.json_object_keys(m), F.array().cast("array<string>"))))
        paths.append(F.coalesce(F.transform(F.array_intersect(keys, known), _below(x)), F.array().cast("array<string>")))
    return F.struct(*[values[f.name].alias(f.name) for f in _VALUES], F.concat(*paths).alias("paths"))


def as_record(fields: dict[str, Column], items: tuple[str, ...] = ()) -> Column:
    """A RECORD with only the given fields, for tables whose layout is already typed; ``items`` names the
    fields of their lists' messages."""
    paths = [*fields, *(f"{x}[].{y}" for x in fields if x in _LISTS for y in items)]
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _VALUES], F.array(*[F.lit(x) for x in paths]).alias("paths"))


def fingerprint(r: Column) -> Column:
    """SHA-256 of the sorted known field paths of a record's schema."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(r["paths"])), "\n"), 256)


def canonical_turns(records: DataFrame, record: str = "r") -> DataFrame:
    """Adds layout and turns, array<struct<role, text>>, to records with a RECORD column.

    The fingerprint of the record's schema selects the layout.  A record that no fingerprint fits, as it
    has further known fields, gets the layout with most paths that are all there, lists first; one whose
    messages differ in their fields takes from each what it has.  Null messages are no turns;
    null roles and texts become empty strings; an unknown layout is null and gives null turns.  fingerprint, layout and turns replace
    columns of these names.
    """
    named = records.withColumn("fingerprint", fingerprint(F.col(record)))
    paths = F.col(f"{record}.paths")
    expr = lambda x: F.expr(x.turns.replace("r.", f"{record}.")).cast(TURNS)
    several = lambda x: F.size(F.array_intersect(paths, F.array(*[F.lit(f"{x}[].{y}") for y in _ITEM])))
    bare = F.coalesce(F.size(F.filter(F.col(f"{record}.messages"), lambda m: m.isNotNull())), F.lit(0)) <= 0  # else its messages have no known field
    cases = [((F.col("fingerprint") == x.fingerprint) & (bare if x.name == "empty messages" else F.lit(True)), x) for x in LAYOUTS]
    cases += [((several(x.paths[0]) > 0) & F.array_contains(paths, x.paths[0]), x) for x in MIXED]
    flat = sorted((x for x in LAYOUTS if x.paths[0] not in _LISTS), key=lambda x: -len(x.paths))
    cases += [(F.size(F.array_except(F.array(*[F.lit(p) for p in x.paths]), paths)) == 0, x) for x in flat]
    layout, turns = F, F
    for hit, x in cases:
        layout, turns = layout.when(hit, F.lit(x.name)), turns.when(hit, expr(x))
    empty = F.lit("")
    clean = F.transform(F.filter(turns, lambda t: t.isNotNull()), lambda t: F.struct(F.coalesce(t["role"], empty).alias("role"), F.coalesce(t["text"], empty).alias("text")))
    # a list field that is null itself is a layout without turns
    clean = F.when(layout.isNotNull(), F.coalesce(clean, F.array().cast(TURNS)))
    return named.withColumn("layout", layout).withColumn("turns", clean)


HEAD, END, BREAK = "### ", "</turn>\n", "</turn>"


def escape(text: Column, name: bool = False) -> Column:
    """Backslashes and control strings as two-character codes, so that neither a header nor an end
    mark is left; ``name`` also takes the colon that ends a role."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(F.replace(text, F.lit("###"), F.lit("\\h")), F.lit(BREAK), F.lit("\\t"))
    return F.replace(text, F.lit(":"), F.lit("\\c")) if name else text


def unescape(text: Column) -> Column:
    """The inverse of escape.  Codes are read from the left, so text is split at doubled
    backslashes before single codes are resolved."""

    def part(x: Column) -> Column:
        return F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("###")), F.lit("\\t"), F.lit(BREAK)), F.lit("\\c"), F.lit(":"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def format_chats(turn_rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Formats turn rows (conv_id, pos, role, text) into one string per conversation.

    A turn is ``### role: text</turn>`` and a newline, role and text escaped.  loss_spans lists
    the code-point spans of the trained role's texts within ``formatted``.
    Equal positions are ordered by role, then text; a null conv_id is a conversation; null
    positions come first; other columns are ignored; an empty table gives no rows.
    """
    return _formatted(turn_rows.select("conv_id", "pos", "role", "text", F.lit(True).alias("real"), F.lit(True).alias("known")), trained_role)


def _formatted(turn_rows: DataFrame, trained_role: str) -> DataFrame:
    """format_chats, of rows that tell whether they are a turn (real), and whether their layout is known."""
    trained = F.col("real") & (F.col("role") == trained_role)
    rows = turn_rows.select("conv_id", "pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "real", "known")
    rows = rows.withColumn("head", F.concat(F.lit(HEAD), escape(F.col("role"), True), F.lit(": "))).withColumn("body", escape(F.col("text")))
    order = W.partitionBy("conv_id").orderBy(F.col("pos").asc_nulls_first(), "role", "text").rowsBetween(W.unboundedPreceding, 0)
    long = F.when(F.col("real"), F.length("head") + F.length("body") + len(END)).otherwise(0)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(order)).withColumn("at", F.sum(long.cast("long")).over(order) - long + F.length("head"))
    span = F.when(trained, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    rows = rows.select("conv_id", "known", F.struct("n", F.when(F.col("real"), F.concat("head", "body", F.lit(END))).alias("piece"), span.alias("span")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.max("known").alias("known"))
    spans = F.array_compact(F.transform("ts", lambda t: t["span"]))
    text = F.array_join(F.array_compact(F.transform("ts", lambda t: t["piece"])), "")
    return out.select("conv_id", F.when(F.col("known"), text).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what a formatted conversation holds, parsed from the string and its mask alone:
    read_turns, array<struct<role, text>>, and loss_text."""
    pieces = F.filter(F.split("formatted", F.lit(END)), lambda p: p != "")

    def parse(p: Column) -> Column:
        body = F.substring(p, len(HEAD) + 1, 2147483647)
        cut = F.locate(": ", body)
        return F.struct(unescape(F.left(body, cut - 1)).alias("role"), unescape(F.substring(body, cut + 2, F.lit(2147483647))).alias("text"))

    text = F.col("formatted")
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("read_turns", F.transform(pieces, parse)).withColumn("loss_text", F.array_join(masked, ""))


def format_records(records: DataFrame, id_column: str = "conv_id", record: str = "r") -> DataFrame:
    """Canonical turns of every record, formatted: conv_id, formatted, loss_spans, one row per conv_id.
    Records of one conv_id are one conversation, their turns in the order of position, role and text.
    Records without turns give an empty string, and where no layout is known a null one."""
    turns = canonical_turns(records, record).select(F.col(id_column).alias("conv_id"), F.col("layout").isNotNull().alias("known"), F.posexplode_outer("turns").alias("pos", "t"))
    return _formatted(turns.select("conv_id", "pos", "t.role", "t.text", F.col("t").isNotNull().alias("real"), "known"), "assistant")
