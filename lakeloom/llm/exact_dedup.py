"""Exact dedup through a log-structured merge index of text digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakeloom.llm.filters import flag_maybe, maybe_among
from lakeloom.llm.text import pieces_of
from lakeloom.storage import discard, materialise

RUN = "shard int, run string, level int, digests binary, ids binary, counts binary, filter binary"
_RUN_ARROW = pa.schema([("shard", pa.int32()), ("run", pa.string()), ("level", pa.int32()), ("digests", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary())])
NO_ID = -(1 << 63)
#: Bytes of the corpus for each shard of the index.
SHARD_BYTES = 1_000_000_000


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _reduce(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct digests with the preferred id and the number of rows of each."""
    order = np.argsort(digests, kind="stable")
    digests, ids, counts = digests[order], ids[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], digests[1:] != digests[:-1]])) if len(digests) else np.zeros(0, np.int64)
    if not len(first):
        return digests, ids, counts
    return digests[first], (np.maximum if largest else np.minimum).reduceat(ids, first), np.add.reduceat(counts, first)


def bloom_of(digests: np.ndarray, bits_per_key: int = 10) -> np.ndarray:
    """A Bloom filter with four probes, as bytes of bits; a digest's own bytes are the hashes."""
    size = max(64, len(digests) * bits_per_key)
    bits = np.zeros(size, bool)
    for at in _probes(digests, size):
        bits[at] = True
    return np.packbits(bits)


def bloom_has(packed: np.ndarray, n_keys: int, digests: np.ndarray, bits_per_key: int = 10) -> np.ndarray:
    size = max(64, n_keys * bits_per_key)
    bits = np.unpackbits(packed, count=size).astype(bool)
    hit = np.ones(len(digests), bool)
    for at in _probes(digests, size):
        hit &= bits[at]
    return hit


def _probes(digests: np.ndarray, size: int) -> Iterator[np.ndarray]:
    words = np.frombuffer(digests.astype("S32").tobytes(), "<u8").reshape(-1, 4)
    for i in range(4):
        yield words[:, i] % np.uint64(size)


def _shards(digests: np.ndarray, n: int) -> np.ndarray:
    """Digests are uniform, so ranges of their first four bytes are even shards."""
    head = np.frombuffer(digests.astype("S32").tobytes(), ">u4").reshape(-1, 8)[:, 0].astype(np.uint64)
    return (head * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _runs(level: int, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, n_shards: int, run: str) -> pa.RecordBatch:
    """One run per shard out of sorted entries."""
    cuts = np.searchsorted(_shards(digests, n_shards), np.arange(n_shards + 1))
    rows = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    parts = [[s, run, level, digests[a:b].tobytes(), ids[a:b].tobytes(), counts[a:b].tobytes(), bloom_of(digests[a:b]).tobytes()] for s, a, b in rows]
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], f.type) for i, f in enumerate(_RUN_ARROW)], schema=_RUN_ARROW)


def flush_memtables(entries: DataFrame, n_shards: int, memtable_rows: int, largest: bool) -> DataFrame:
    """Level-0 runs of (digest, doc_id) rows: each task holds a memtable of at most
    ``memtable_rows`` rows, which merges copies before it is flushed, sorted, with a filter."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, table, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            digests = np.frombuffer(b"".join(batch.column(0).to_pylist()), "S32")
            ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(digests), memtable_rows):
                d, i = digests[a : a + memtable_rows], ids[a : a + memtable_rows]
                table.append(_reduce(d, i, np.ones(len(d), np.int64), largest))
                held += len(table[-1][0])
                if held >= memtable_rows:
                    merged = _reduce(*(np.concatenate(x) for x in zip(*table, strict=True)), largest)
                    table, held = [merged], len(merged[0])
                    if held >= memtable_rows // 2:
                        yield _runs(0, *merged, n_shards, f"{part}-{seq}")
                        table, held, seq = [], 0, seq + 1
        if held:
            yield _runs(0, *_reduce(*(np.concatenate(x) for x in zip(*table, strict=True)), largest), n_shards, f"{part}-{seq}")

    return entries.select("digest", "doc_id").mapInArrow(task, RUN)


def _entries(runs: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    return [(np.frombuffer(d, "S32"), np.frombuffer(i, np.int64), np.frombuffer(c, np.int64), np.frombuffer(f, np.uint8)) for d, i, c, f in zip(runs["digests"], runs["ids"], runs["counts"], runs["filter"], strict=True)]


def compact(runs: DataFrame, largest: bool, fan_in: int = 8) -> DataFrame:
    """Merges the runs of each shard, ``fan_in`` at a time, into one run.  A run's filter tells
    which entries another run may hold; only those are merged, the others pass."""

    def merge(a: tuple, b: tuple) -> tuple:
        maybe_a, maybe_b = bloom_has(b[3], len(b[0]), a[0]), bloom_has(a[3], len(a[0]), b[0])
        both = _reduce(*(np.concatenate([x[maybe_a], y[maybe_b]]) for x, y in zip(a[:3], b[:3], strict=True)), largest)
        parts = [np.concatenate([x[~maybe_a], y[~maybe_b], z]) for x, y, z in zip(a[:3], b[:3], both, strict=True)]
        order = np.argsort(parts[0], kind="stable")
        parts = [p[order] for p in parts]
        return (*parts, bloom_of(parts[0]))

    def shard(runs: pd.DataFrame) -> pd.DataFrame:
        tier, level = _entries(runs), int(runs["level"].max()) + 1
        while len(tier) > 1:
            after = []
            for k in range(0, len(tier), fan_in):
                group = tier[k : k + fan_in]
                while len(group) > 1:  # pairwise, so that equal sizes meet
                    group = [merge(*group[j : j + 2]) if len(group[j : j + 2]) == 2 else group[j] for j in range(0, len(group), 2)]
                after += group
            tier = after
        d, i, c, f = tier[0]
        return pd.DataFrame([[int(runs["shard"].iloc[0]), "compacted", level, d.tobytes(), i.tobytes(), c.tobytes(), f.tobytes()]], columns=list(_RUN_ARROW.names))

    return runs.groupBy("shard").applyInPandas(shard, RUN)


def repeated_entries(runs: DataFrame) -> DataFrame:
    """digest, keep_id and rows of the entries with more than one row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, i, c, _ in _entries(batch.to_pandas()):
                at = np.flatnonzero(c > 1)
                yield pa.RecordBatch.from_arrays([pa.array([x.ljust(32, b"\0") for x in d[at].tolist()], pa.binary()), pa.array(i[at]), pa.array(c[at])], names=["digest", "entry_id", "entry_rows"])

    return runs.mapInArrow(task, "digest binary, entry_id long, entry_rows long")


def exact_dedup(docs: DataFrame, keep: str = "min", n_shards: int | None = None, memtable_rows: int = 1 << 17, digest=digest_of) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null is the empty text.  ``keep`` ("min" or "max") names
    the doc_id that stays of each group.  Digests go through the index (memtables, runs, and
    compaction, both written to the shared folder), whose entries hold the id that stays and the
    number of rows.  Rows probe it with their digest and take both from the entry they hit.  A hit is
    verified by bytes: the texts behind each digest that the index holds twice, found through a filter
    of fixed size, are grouped; where they are not all equal, the digest collides, and the groups'
    own id and number count.  Copies merge in memtables and in partial aggregation before any
    shuffle, so a text that a third of the rows have sends one entry per task; rows that the filter
    clears are not moved.  The index has a shard for each SHARD_BYTES of the corpus.

    Null doc_ids count as smaller than any other ("max") and never stay unless alone ("min":
    ignored too); rows that repeat a doc_id and text count in group_size and answer alike; other
    columns are ignored; an empty table gives no rows.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    largest = keep == "max"
    n_shards = n_shards or pieces_of(docs, SHARD_BYTES)
    text = F.coalesce(F.col("text"), F.lit(""))
    entries = docs.select(F.col("doc_id"), digest(F.col("text")).alias("digest"))
    worst = NO_ID if largest else (1 << 63) - 1
    level0 = materialise(flush_memtables(entries.withColumn("doc_id", F.coalesce("doc_id", F.lit(worst))), n_shards, memtable_rows, largest), "lsm_level0")
    index = materialise(compact(level0, largest), "lsm_index", blobs=True)
    discard(level0)
    hits = materialise(repeated_entries(index), "lsm_hits")
    rows = maybe_among(docs.select("doc_id", text.alias("text"), digest(F.col("text")).alias("digest")), hits, "digest")
    pick = F.max if largest else F.min
    groups = rows.groupBy("digest", "text").agg(pick("doc_id").alias("own_id"), F.count(F.lit(1)).alias("own_rows"))
    groups = materialise(groups.select("digest", F.xxhash64("text").alias("check"), "own_id", "own_rows"), "verified")
    texts = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    of_entry = F.col("texts") == 1
    no_id = F.col("entry_id") == worst
    answers = hits.join(texts, "digest").join(groups, "digest").select(
        "digest", "check", F.when(of_entry, F.when(~no_id, F.col("entry_id"))).otherwise(F.col("own_id")).alias("keep_id"), F.when(of_entry, F.col("entry_rows")).otherwise(F.col("own_rows")).alias("group_size")
    )
    answers = materialise(answers, "answers")
    probes = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.xxhash64(text).alias("check"), F.sha2(text, 256).alias("text_sha256"))
    probes = flag_maybe(probes, hits, "digest")
    found = probes.where("maybe").join(answers, ["digest", "check"], "left").select("doc_id", "keep_id", "group_size", "text_sha256")
    alone = probes.where(~F.col("maybe")).select("doc_id", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"), "text_sha256")
    out = found.unionByName(alone)
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = out.withColumn("keep_id", keep_id).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
