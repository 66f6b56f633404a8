"""Substring dedup: repeated word windows, found by an FM-index per shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lakeloom.llm.filters import BITS, flag_maybe
from lakeloom.llm.fm_index import FMIndex
from lakeloom.llm.text import MIX1, SOLID, Texts, blob_column, in_batches, lean, mix, pieces_of, shingle_hashes
from lakeloom.storage import materialise

WINDOW = 13
#: Words of an anchor: each window belongs to the smallest hash of its runs of so many words.
ANCHOR = 7
#: Windows of one piece of text that goes to a shard.
PIECE = 7
_ID_BYTES = 5
#: Bytes of the corpus for each shard: building an index takes some thirty times the bytes of its words.
SHARD_BYTES = 4_000_000
#: Windows that are searched for at a time.
STREAMED = 1 << 18


def _anchors(rows: Texts, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; and for each window of each row its first word, anchor and row."""
    s, e, first = rows.spans(SOLID)
    h = rows.hashes(s, e)
    g = shingle_hashes(h, anchor)
    need = window - anchor + 1
    width, low = 1, g
    while width < need:
        step = min(width, need - width)
        low = np.minimum(low[: len(low) - step], low[step:]) if len(low) > step else low[:0]
        width += step
    row = np.repeat(np.arange(rows.rows), np.diff(first))[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + window <= first[1:][row]) if len(low) else np.zeros(0, np.int64)
    return h, at, low[at], row[at]


def _pieces(at: np.ndarray, anchor: np.ndarray, row: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at most PIECE consecutive kept windows of one anchor and row: index of the first,
    and how many."""
    idx = np.flatnonzero(keep)
    if not len(idx):
        return idx, idx
    new = np.concatenate([[True], (idx[1:] != idx[:-1] + 1) | (anchor[idx[1:]] != anchor[idx[:-1]]) | (row[idx[1:]] != row[idx[:-1]]) | (at[idx[1:]] != at[idx[:-1]] + 1)])
    start = np.maximum.accumulate(np.where(new, np.arange(len(idx)), 0))
    new |= (np.arange(len(idx)) - start) % PIECE == 0
    first = np.flatnonzero(new)
    return idx[first], np.diff(np.append(first, len(idx)))


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] values, and so on."""
    off = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(start - off[:-1], size) + np.arange(off[-1])


def _piece_keys(h: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    key = mix(words.astype(np.uint64))
    for i in range(int(words.max()) if len(words) else 0):
        on = words > i
        key[on] = mix(key[on] * MIX1 + h[start[on] + i])
    return key


def _by_part(part: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    return order, full, np.append(cuts[full], len(order))


def repeated_anchors(docs: DataFrame, window: int, anchor: int, n_parts: int) -> np.ndarray:
    """A bit set of fixed size that has every anchor found twice or more.  Each task sends the
    upper 48 bits of its distinct anchors, twice if it met them twice; a shard has a range of the set
    and sorts what it gets."""
    edges = (np.arange(n_parts + 1, dtype=np.uint64) * np.uint64(BITS // 8) // np.uint64(n_parts)) * np.uint64(8)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, rows in Texts.of(batch.column(0)).chunks():
                _, at, a, row = _anchors(rows, window, anchor)
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]) if len(a) else np.zeros(0, bool)
                found.append(a[new] >> np.uint64(16))
            if not found or not sum(map(len, found)):
                continue
            a = np.sort(np.concatenate(found))
            same = np.concatenate([[False], a[1:] == a[:-1]])
            again = same & np.concatenate([[True], ~same[:-1]])  # the second of each
            a = a[~same | again]
            slot = a % np.uint64(BITS)
            a = a[np.argsort(slot, kind="stable")]
            cuts = np.searchsorted(np.sort(slot), edges)
            full = np.flatnonzero(np.diff(cuts))
            six = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :6]).view("S6").reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), blob_column(six, np.append(cuts[full], cuts[-1]))], names=["part", "anchors"])

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part["part"].iloc[0])
        six = np.frombuffer(b"".join(part["anchors"]), np.uint8).reshape(-1, 6)
        a = np.zeros((len(six), 8), np.uint8)
        a[:, :6] = six
        a = np.sort(a.view(np.uint64).reshape(-1))
        bits = np.zeros(int(edges[number + 1] - edges[number]), np.uint8)
        bits[(a[1:][a[1:] == a[:-1]] % np.uint64(BITS) - edges[number]).astype(np.int64)] = 1
        return pd.DataFrame({"part": [number], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    sent = docs.select("text").mapInArrow(lean(task), "part int, anchors binary")
    table = np.zeros(BITS // 8, np.uint8)
    for number, bits in sent.groupBy("part").applyInPandas(shard, "part int, bits binary").toLocalIterator():  # BITS / 8 bytes in all
        start = int(edges[number]) // 8
        table[start : start + len(bits)] = np.frombuffer(bits, np.uint8)
    return table


def _among(table: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    slot = (anchor >> np.uint64(16)) % np.uint64(BITS)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def shard_pieces(docs: DataFrame, table: Broadcast, window: int, anchor: int, n_parts: int) -> DataFrame:
    """The pieces of text around repeated anchors, by shard of their anchor: distinct within a
    batch, with the smallest and largest document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys, anchors, docs_of, sizes, ids5 = [], [], [], [], []
            for a0, rows in Texts.of(batch.column(1)).chunks():
                h, at, a, row = _anchors(rows, window, anchor)
                i, n = _pieces(at, a, row, _among(table.value, a))
                if not len(i):
                    continue
                words = n + window - 1
                keys.append(_piece_keys(h, at[i], words))
                anchors.append(a[i])
                docs_of.append(ids[a0 + row[i]])
                sizes.append(words)
                ids5.append(np.ascontiguousarray(h[_ragged(at[i], words)].view(np.uint8).reshape(-1, 8)[:, 8 - _ID_BYTES :]).view(f"S{_ID_BYTES}").reshape(-1))
            if not keys:
                continue
            key, a, doc, size, ids5 = (np.concatenate(x) for x in (keys, anchors, docs_of, sizes, ids5))
            start = np.concatenate([[0], np.cumsum(size)])[:-1]
            order = np.lexsort((key, a))
            new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (a[order][1:] != a[order][:-1])])
            first = np.flatnonzero(new)
            pick, least, most = order[first], np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
            part = ((mix(a[pick]) >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)  # anchors are minima, so not even themselves
            by, full, cuts = _by_part(part, n_parts)
            pick, least, most = pick[by], least[by], most[by]
            off = np.concatenate([[0], np.cumsum(size[pick])])
            arrays = [blob_column(x, cuts) for x in (a[pick], key[pick], least, most, size[pick].astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *arrays, blob_column(ids5[_ragged(start[pick], size[pick])], off[cuts])], names=["part", "anchor", "key", "least", "most", "size", "words"])

    return docs.select(_doc_id(), "text").mapInArrow(lean(task), "part int, anchor binary, key binary, least binary, most binary, size binary, words binary")


def _doc_id():
    """A null doc_id is larger than any other."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id")


def first_documents(pieces: DataFrame, window: int) -> DataFrame:
    """For each piece that needs it, the smallest document of each of its windows: (anchor, key,
    firsts).  Every window is looked up by backward search in its shard's index."""

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        def joined(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(part[name]), kind)

        anchor, key, least, most, size = joined("anchor", np.uint64), joined("key", np.uint64), joined("least", np.int64), joined("most", np.int64), joined("size", np.uint8).astype(np.int64)
        raw = joined("words", np.uint8).reshape(-1, _ID_BYTES)
        # the same piece from several batches is one piece
        order = np.lexsort((key, anchor))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])])
        at = np.flatnonzero(new)
        pick, lo_doc, hi_doc = order[at], np.minimum.reduceat(least[order], at), np.maximum.reduceat(most[order], at)
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        n = size[pick]
        ids = np.zeros((int(n.sum()), 8), np.uint8)
        ids[:, :_ID_BYTES] = raw[_ragged(start[pick], n)]
        _, dense = np.unique(ids.view(np.uint64).reshape(-1), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(n + 1)])
        text = np.zeros(int(begin[-1]), np.int64)
        text[_ragged(begin[:-1], n)] = dense + 1
        index = FMIndex(text, window)
        n_windows = n - window + 1
        ends = _ragged(begin[:-1] + window, n_windows)
        owner = np.repeat(np.arange(len(n)), n_windows)
        found = lo_doc[owner].copy()
        for c in range(0, len(ends), STREAMED):
            # a match at one place only is the window's own piece: no need to follow it further
            length, lo, hi = index.matching(text, ends[c : c + STREAMED], stop=2)
            hit = np.flatnonzero(length == window)
            if len(hit):
                u, where = np.unique(lo[hit], return_index=True)
                size_of = hi[hit][where] - u
                docs_at = lo_doc[index.sequences(_ragged(u, size_of))]
                mins = np.minimum.reduceat(docs_at, np.concatenate([[0], np.cumsum(size_of)])[:-1])
                found[c + hit] = mins[np.searchsorted(u, lo[hit])]
        need = np.add.reduceat(found < hi_doc[owner], np.concatenate([[0], np.cumsum(n_windows)])[:-1]) > 0
        some = np.flatnonzero(need)
        off = np.concatenate([[0], np.cumsum(n_windows)])
        return pd.DataFrame({"anchor": anchor[pick][some].view(np.int64), "key": key[pick][some].view(np.int64), "firsts": [found[off[i] : off[i + 1]].tobytes() for i in some]})

    return pieces.groupBy("part").applyInPandas(shard, "anchor long, key long, firsts binary")


def occurrences(docs: DataFrame, table: Broadcast, window: int, anchor: int) -> DataFrame:
    """Every piece of every document: (row_key, doc_id, anchor, key, start)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for a0, rows in Texts.of(batch.column(1)).chunks():
                h, at, a, row = _anchors(rows, window, anchor)
                i, n = _pieces(at, a, row, _among(table.value, a))
                if len(i):
                    first = rows.spans(SOLID)[2]
                    r = row[i]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[a0 + r], ids[a0 + r], a[i].view(np.int64), _piece_keys(h, at[i], n + window - 1).view(np.int64), (at[i] - first[r]).astype(np.int32))], names=["row_key", "doc_id", "anchor", "key", "start"])

    return docs.select(_doc_id(), "text", row_key().alias("row_key")).mapInArrow(lean(task), "row_key long, doc_id long, anchor long, key long, start int")


def row_key():
    return F.xxhash64("doc_id", "text")


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, n_shards: int | None = None) -> DataFrame:
    """row_key and starts (int32 word positions) of the windows that also start in a document with
    a smaller doc_id, for the documents that have any."""
    n_shards = n_shards or pieces_of(docs, SHARD_BYTES)
    table = docs.sparkSession.sparkContext.broadcast(repeated_anchors(in_batches(docs, 4), window, anchor, n_shards))
    firsts = materialise(first_documents(shard_pieces(docs, table, window, anchor, n_shards), window), "firsts")
    known = occurrences(docs, table, window, anchor).join(firsts, ["anchor", "key"])

    def earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob = Texts.of(batch.column(3))
            first = np.frombuffer(blob.raw, np.int64)
            n = np.diff(blob.offsets) // 8
            owner = np.repeat(np.arange(batch.num_rows), n)
            start = _ragged(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), n)
            hit = first < batch.column(1).to_numpy(zero_copy_only=False)[owner]
            cuts = np.searchsorted(owner[hit], np.arange(batch.num_rows + 1))
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), blob_column(start[hit].astype(np.int32), np.append(cuts[some], cuts[-1]))], names=["row_key", "starts"])

    hits = known.select("row_key", "doc_id", "start", "firsts").mapInArrow(lean(earlier), "row_key long, starts binary")
    return hits.groupBy("row_key").agg(F.collect_list("starts").alias("starts"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, n_shards: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text.

    Words are runs without white space.  A word goes if a window of ``window`` consecutive words
    that covers it also starts in a document with a smaller doc_id; windows are those of the
    input.  kept_text is the kept words joined by one space.

    How: a window belongs to its anchor, the smallest hash among its runs of ``anchor`` words, so
    equal windows meet in one shard.  Anchors met once cannot repeat and are left out by a bit
    set of fixed size (as it fills, more is looked up, never less).  A shard, of which there is one for
    each SHARD_BYTES of the corpus, builds a compressed FM-index of its distinct pieces of text and
    streams the pieces of its documents against it: backward search gives how far back from each word
    the text matches elsewhere, up to the window's length, and where; the smallest document among the
    places found is joined back to every occurrence.  A passage that very many documents
    share is one piece per batch in its shard, and its occurrences are a join that can be split.

    Null and short texts have no windows; a null doc_id is larger than any other; rows that repeat
    a doc_id do not count as smaller than one another; other columns are ignored; word identity
    within a shard is 40 bits of a hash, next to the 64-bit anchor.
    """
    starts = materialise(repeated_windows(docs, window, anchor, n_shards), "repeats")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("row_key"))
    rows = flag_maybe(rows, starts, "row_key")
    hit = rows.where("maybe").join(starts, "row_key", "left").select("doc_id", "text", "starts")
    clean = rows.where(~F.col("maybe")).select("doc_id", "text", F.lit(None).cast("array<binary>").alias("starts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts.of(batch.column(1))
            n_words, n_removed, kept = [], [], []
            for i, blobs in enumerate(batch.column(2).to_pylist()):
                words = texts.raw[texts.offsets[i] : texts.offsets[i + 1]].split()
                n_words.append(len(words))
                if blobs:
                    cover = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.frombuffer(b"".join(blobs), np.int32))
                    np.add.at(cover, at, 1)
                    np.add.at(cover, np.minimum(at + window, len(words)), -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    n_removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words))
            shas = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([x.decode() for x in kept], pa.string()), pa.array(shas)], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return hit.unionByName(clean).mapInArrow(lean(finish), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
