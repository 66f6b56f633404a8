"""Line dedup by the number of distinct sites a line appears on, estimated by HyperLogLog."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from lakeloom.llm.text import NOT_NEWLINE, Texts, blob_column, in_batches, lean, mix, pieces_of
from lakeloom.storage import materialise

#: Registers of a sketch: 2 ** PRECISION.  Its relative error is 1.04 / sqrt(registers), 3.3 %.
PRECISION = 10
#: At most so many line hashes are sent to every task (32 MB); a larger set is joined.
BROADCAST_LINES = 4_000_000
#: Bytes of the corpus for each part that lines are merged in.
PART_BYTES = 64_000_000


def _register(site: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and rank that a site's hash gives in a sketch."""
    at = (site >> np.uint64(64 - PRECISION)).astype(np.uint16)
    rest = (site << np.uint64(PRECISION)) | np.uint64((1 << PRECISION) - 1)
    rank = (63 - np.floor(np.log2(rest.astype(np.float64)))).clip(0) + 1
    return at, rank.astype(np.uint16)


def _lines(rows: Texts, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts, ends and rows of the lines that have words.  The lowest bit of a hash tells lines
    of fewer than ``min_words`` words."""
    s, e, first = rows.spans(NOT_NEWLINE)
    words = np.frombuffer(rows.raw + b" ", np.uint8) != 32
    begins = np.concatenate([[0], np.cumsum(words[1:] & ~words[:-1])]) if len(words) > 1 else np.zeros(1, np.int64)
    n_words = begins[e - 1] - begins[s] + words[s] if len(s) else s
    row = np.repeat(np.arange(rows.rows), np.diff(first))
    keep = n_words >= 1
    s, e, row, n_words = s[keep], e[keep], row[keep], n_words[keep]
    return rows.hashes(s, e, seed=7) & ~np.uint64(1) | (n_words < min_words).astype(np.uint64), s, e, row


def _reduced(line: np.ndarray, reg: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per line and register: the highest rank; and the line's smallest document."""
    if not len(line):
        return line, reg, doc
    order = np.lexsort((reg, line))
    line, reg, doc = line[order], reg[order], doc[order]
    new = np.concatenate([[True], line[1:] != line[:-1]])
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(doc, first)[np.cumsum(new) - 1]
    last = np.concatenate([(line[1:] != line[:-1]) | (reg[1:] >> 6 != reg[:-1] >> 6), [True]])
    return line[last], reg[last], least[last]


def sketch_lines(docs: DataFrame, min_words: int, n_parts: int, table_lines: int = 1 << 20) -> DataFrame:
    """Sparse sketches, by line hash.  A task merges what it reads before it sends anything, so a
    line that every document has sends one entry per task and register."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            line, reg, doc = _reduced(*(np.concatenate(x) for x in zip(*held, strict=True)))
            part = ((line >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(n_parts + 1))  # lines are sorted, and so are parts
            full = np.flatnonzero(np.diff(cuts))
            first = np.append(cuts[full], cuts[-1])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), blob_column(line, first), blob_column(reg, first), blob_column(doc, first)], names=["part", "line", "reg", "doc"])

        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
            sites = Texts.of(batch.column(1).cast(pa.string()).fill_null("\0"))
            site = mix(sites.hashes(sites.offsets[:-1], sites.offsets[1:], seed=11))
            at, rank = _register(site)
            code = (at << 6) | rank
            for a, rows in Texts.of(batch.column(2)).chunks():
                line, _, _, row = _lines(rows, min_words)
                held.append(_reduced(line, code[a + row], ids[a + row]))
                count += len(held[-1][0])
                if count >= table_lines:
                    yield flush()
                    count = 0
        if held and count:
            yield flush()

    return docs.select("doc_id", "source", "text").mapInArrow(lean(task), "part int, line binary, reg binary, doc binary")


def spread(sketches: DataFrame, at_least: float, short_at_least: float | None = None) -> DataFrame:
    """Merged sketches: line, estimated sites and first document of lines with ``at_least`` sites, short
    ones with ``short_at_least``."""
    m = 1 << PRECISION
    short_at_least = at_least if short_at_least is None else short_at_least

    def shard(part) -> object:
        import pandas as pd

        line = np.concatenate([np.frombuffer(x, np.uint64) for x in part["line"]])
        reg = np.concatenate([np.frombuffer(x, np.uint16) for x in part["reg"]])
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in part["doc"]])
        line, reg, doc = _reduced(line, reg, doc)
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        used = np.diff(np.append(first, len(line)))
        inverse = np.add.reduceat(np.exp2(-(reg & 63).astype(np.float64)), first) + (m - used)
        raw = 0.7213 / (1 + 1.079 / m) * m * m / inverse
        empty = m - used
        est = np.where((raw <= 2.5 * m) & (empty > 0), m * np.log(m / np.maximum(empty, 1)), raw)
        ok = est >= np.where(line[first] & np.uint64(1), short_at_least, at_least)
        return pd.DataFrame({"line": line[first][ok].view(np.int64), "sites": est[ok], "first_doc": doc[first][ok]})

    return sketches.groupBy("part").applyInPandas(shard, "line long, sites double, first_doc long")


def _line_sites(docs: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """Distinct (line, source) rows of the given lines."""
    known = _sorted_set(lines)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, rows in Texts.of(batch.column(1)).chunks():
                line, _, _, row = _lines(rows, min_words)
                if known is not None:
                    ok = _member(known, line)
                    line, row = line[ok], row[ok]
                pairs = pa.table({"line": pa.array(line.view(np.int64)), "source": batch.column(0).take(pa.array(a + row))}).group_by(["line", "source"]).aggregate([])
                yield from pairs.to_batches()

    pairs = docs.select(F.col("source").cast("string"), "text").mapInArrow(lean(task), "line long, source string")
    return pairs if known is not None else pairs.join(lines.select("line"), "line", "left_semi")


def _sorted_set(lines: DataFrame) -> np.ndarray | None:
    """The line hashes as an array if they are few enough to send around, else None."""
    if lines.count() > BROADCAST_LINES:
        return None
    return np.sort(lines.select("line").toPandas()["line"].to_numpy(np.int64).view(np.uint64))


def _member(known: np.ndarray, line: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(line), bool)
    return known[np.minimum(np.searchsorted(known, line), len(known) - 1)] == line


def _margin(sites: int) -> float:
    """Four standard errors of an estimate of so many sites, and two sites."""
    return 2 + 4 * 1.04 / (1 << PRECISION) ** 0.5 * sites


def boilerplate_lines(docs: DataFrame, min_sites: int, min_words: int, short_sites: int) -> DataFrame:
    """line (hash) and first_doc of the lines on at least ``min_sites`` distinct sources (short lines:
    ``short_sites``).  Lines whose estimate is near the limit are counted exactly."""
    n_parts = pieces_of(docs, PART_BYTES)
    wide = materialise(spread(sketch_lines(docs, min_words, n_parts), min_sites - _margin(min_sites), short_sites - _margin(short_sites)), "spread")
    short = F.col("line").bitwiseAND(F.lit(1).cast("long")) == 1
    limit = F.when(short, short_sites).otherwise(min_sites)
    clear = F.when(short, short_sites + _margin(short_sites)).otherwise(min_sites + _margin(min_sites))
    sure, near = wide.where(F.col("sites") > clear), wide.where(F.col("sites") <= clear)
    exact = _line_sites(docs, near, min_words).distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
    return materialise(sure.select("line", "first_doc").unionByName(near.join(exact, "line", "left_semi").select("line", "first_doc")), "boilerplate")


def line_dedup(docs: DataFrame, min_sites: int = 8, min_words: int = 3, short_sites: int = 16) -> DataFrame:
    """The rows of ``docs`` with boilerplate lines removed from text, and n_lines and n_removed.

    A line is what stands between newlines, byte for byte; its words are runs without spaces.  One on at
    least ``min_sites`` distinct sources is boilerplate; one of fewer than ``min_words`` words, which
    comes about by chance more easily (or is written without spaces), needs ``short_sites`` of them;
    lines of spaces alone are none.  Boilerplate stays in the document with the smallest doc_id that
    has it, wherever it stands there, and goes from all others, newline included.

    A null source is a site of its own; a null doc_id is larger than any other; rows that repeat a
    doc_id are one document here, and each loses lines by its own text; null texts have no lines and
    stay null; other columns are kept, but for columns named n_lines and n_removed, which are
    replaced; an empty table gives no rows.
    """
    lines = boilerplate_lines(in_batches(docs), min_sites, min_words, short_sites)
    known = None
    if lines.count() <= BROADCAST_LINES:
        table = lines.toPandas().sort_values("line", key=lambda x: x.to_numpy(np.int64).view(np.uint64))
        known = table["line"].to_numpy(np.int64).view(np.uint64), table["first_doc"].to_numpy(np.int64)
    docs = docs.drop("n_lines", "n_removed")
    if known is None:
        return _joined(docs, lines, min_words)
    names, schema = docs.columns, _with_counts(docs)
    doc_at, text_at = names.index("doc_id"), names.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(doc_at).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = []
            for a, rows in Texts.of(batch.column(text_at)).chunks():
                line, s, _, row = _lines(rows, min_words)
                hit = np.flatnonzero(_member(known[0], line))
                hit = hit[known[1][np.searchsorted(known[0], line[hit])] != ids[a + row[hit]]]
                cuts += zip((a + row[hit]).tolist(), (s[hit] - rows.offsets[row[hit]]).tolist(), strict=True)
            yield _without(batch, text_at, cuts)

    return docs.mapInArrow(lean(task), schema)


def _with_counts(docs: DataFrame) -> T.StructType:
    return T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])


def _without(batch: pa.RecordBatch, text_at: int, cuts: list[tuple[int, int]]) -> pa.RecordBatch:
    """The batch without the lines that start at (row, byte); only texts that lose any are rebuilt."""
    column = batch.column(text_at)
    gone: dict[int, set[int]] = {}
    for row, start in cuts:
        gone.setdefault(row, set()).add(start)
    n_lines = np.zeros(len(column), np.int64)
    removed = np.zeros(len(column), np.int64)
    mask, new = np.zeros(len(column), bool), []
    for a, rows in Texts.of(column).chunks():
        feeds = np.flatnonzero(np.frombuffer(rows.raw, np.uint8) == 10)
        n_lines[a : a + rows.rows] = np.diff(np.searchsorted(feeds, rows.offsets)) + (np.diff(rows.offsets) > 0)
        for i in range(rows.rows):
            if starts := gone.get(a + i):
                at, kept = 0, []
                for part in rows.raw[rows.offsets[i] : rows.offsets[i + 1]].split(b"\n"):
                    if at not in starts:
                        kept.append(part)
                    at += len(part) + 1
                new.append(b"\n".join(kept).decode())
                mask[a + i], removed[a + i] = True, len(starts)
    if new:
        column = pc.replace_with_mask(column, pa.array(mask), pa.array(new, column.type))
    arrays = [column if i == text_at else batch.column(i) for i in range(batch.num_columns)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines), pa.array(removed)], names=[*batch.schema.names, "n_lines", "n_removed"])


def _joined(docs: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """line_dedup for more lines than can be sent around: occurrences are joined by hash, and what
    goes is joined back by row: doc_id and a hash of the text, which rows of one doc_id share only if
    their texts are equal."""
    names, schema = docs.columns, _with_counts(docs)
    text_at = names.index("text")
    row = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("row_key"))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, rows in Texts.of(batch.column(2)).chunks():
                line, s, _, row = _lines(rows, min_words)
                at = pa.array(a + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(line.view(np.int64)), pa.array(s - rows.offsets[row])], names=["id", "row_key", "line", "start"])

    found = docs.select(row.alias("r"), "text").select("r.id", "r.row_key", "text").mapInArrow(lean(occurrences), "id long, row_key long, line long, start long").join(lines, "line")
    cut = found.where(F.coalesce("id", F.lit(np.iinfo(np.int64).max)) != F.col("first_doc")).groupBy("id", "row_key").agg(F.collect_set("start").alias("starts"))
    both = docs.select(F.struct(*names).alias("whole"), row.alias("r")).join(cut, F.col("r.row_key").eqNullSafe(F.col("row_key")) & F.col("r.id").eqNullSafe(F.col("id")), "left").select("whole", "starts")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [(i, s) for i, starts in enumerate(batch.column(1).to_pylist()) for s in starts or ()]
            yield _without(pa.RecordBatch.from_arrays(batch.column(0).flatten(), names=names), text_at, cuts)

    return both.mapInArrow(lean(task), schema)
