"""Benchmark decontamination with a positional inverted index over the training tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeloom.llm.text import ALNUM, Texts, blob_column, in_batches, lean
from lakeloom.storage import materialise

WINDOW = 10
SEGMENT_BYTES = 2_000_000
#: A block of items that is sent to every task holds at most so much text.
BLOCK_CHARS = 16_000_000

SEGMENT = "row_id long, row_ids binary, doc_ids binary, doc_null binary, row_keys binary, first binary, terms binary, starts binary, postings binary"
_SEGMENT_NAMES = [x.split()[0] for x in SEGMENT.split(", ")]


def _sorted_postings(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms, the start of each one's list, and all positions, by term and then position."""
    n = len(h)
    bits = np.uint64(max(1, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
    at = (packed & low).astype(np.int64)
    hs = h[at]
    if n and bool(np.any(hs[1:] < hs[:-1])):  # two terms agree in the high bits
        at = np.argsort(h, kind="stable")
        hs = h[at]
    start = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if n else np.zeros(0, np.int64)
    return hs[start], np.append(start, n).astype(np.int32), at.astype(np.int32)


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index: one row per segment, a run of whole documents of about ``segment_bytes`` (a
    longer document is a segment of its own).  A segment holds its documents, the sorted 64-bit
    hashes of its terms, and for each term the list of word positions.  The lists of all terms are
    stored, so that other benchmarks can be looked up without reading the corpus again.  Write it as a
    table of blobs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = Texts.of(batch.column(1))
            ids, null = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for a, rows in texts.chunks(segment_bytes):
                rows = rows.lower()
                s, e, first = rows.spans(ALNUM)
                terms, starts, postings = _sorted_postings(rows.hashes(s, e))
                row_ids = part + seq + np.arange(rows.rows, dtype=np.int64)
                row_keys = batch.column(2).to_numpy(zero_copy_only=False)[a : a + rows.rows]
                blobs = [row_ids, ids[a : a + rows.rows].astype(np.int64), null[a : a + rows.rows].astype(np.uint8), row_keys, first.astype(np.int32), terms, starts, postings]
                out = pa.RecordBatch.from_arrays([pa.array([part + seq]), *[blob_column(x, np.array([0, len(x)])) for x in blobs]], names=_SEGMENT_NAMES)
                seq += rows.rows
                del rows, s, e, first, terms, starts, postings, blobs
                yield out
                del out

    return in_batches(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key")).mapInArrow(lean(task), SEGMENT)


@dataclass
class Segment:
    row_ids: np.ndarray
    doc_ids: np.ndarray
    doc_null: np.ndarray
    row_keys: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    postings: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Segment:
        """Segment i of a batch, without copies of its lists."""
        kinds = {"row_ids": np.int64, "doc_ids": np.int64, "doc_null": np.uint8, "row_keys": np.int64, "first": np.int32, "terms": np.uint64, "starts": np.int32, "postings": np.int32}
        return cls(**{k: np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in kinds.items()})

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each term's list; length 0 for terms that do not occur."""
        if not len(self.terms):
            z = np.zeros(terms.shape, np.int64)
            return z, z
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        n = np.where(self.terms[at] == terms, self.starts[at + 1] - self.starts[at], 0)
        return self.starts[at].astype(np.int64), n

    def phrase(self, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Positions where the terms with these lists follow one another within one document.  The
        rarest term's list, moved back by its offset, is intersected with the others by rarity."""
        order = np.argsort(counts, kind="stable")
        at = None
        for j in order:
            own = self.postings[starts[j] : starts[j] + counts[j]]
            if at is None:
                at = own - np.int32(j)
                at = at[at >= 0]
            else:
                k = np.searchsorted(own, at + np.int32(j))
                at = at[(k < len(own)) & (own[np.minimum(k, len(own) - 1)] == at + np.int32(j))]
            if not len(at):
                return at
        return at[np.searchsorted(self.first, at, "right") == np.searchsorted(self.first, at + np.int32(len(counts) - 1), "right")]

    def near(self, starts: np.ndarray, counts: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest term that have every other term at most ``within`` words away
        in the same document."""
        order = np.argsort(counts, kind="stable")
        at = self.postings[starts[order[0]] : starts[order[0]] + counts[order[0]]]
        doc = np.searchsorted(self.first, at, "right")
        lo, hi = np.maximum(at - within, self.first[doc - 1]), np.minimum(at + within, self.first[np.minimum(doc, len(self.first) - 1)] - 1)
        ok = np.ones(len(at), bool)
        for j in order[1:]:
            own = self.postings[starts[j] : starts[j] + counts[j]]
            ok &= np.searchsorted(own, hi, "right") > np.searchsorted(own, lo, "left")
        return at[ok]


@dataclass
class Phrases:
    """Distinct windows of a block of items: their words are vocabulary[term[w, :size[w]]], and items[w]
    has those that hold them."""

    vocabulary: np.ndarray
    term: np.ndarray
    size: np.ndarray
    items: list[list[int]]
    names: list[str]


def item_phrases(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    """The windows of (item id, text) rows: each run of ``window`` words, or all words of an item
    that has fewer but some."""
    found: dict[tuple, list[int]] = {}
    names = [name for name, _ in items]
    texts = Texts.of(pa.array([t for _, t in items], pa.large_string())).lower()
    s, e, first = texts.spans(ALNUM)
    vocabulary, term_of = np.unique(texts.hashes(s, e), return_inverse=True)
    for i in range(len(items)):
        words = term_of[first[i] : first[i + 1]]
        for k in range(max(1, len(words) - window + 1) if len(words) else 0):
            found.setdefault(tuple(words[k : k + window].tolist()), []).append(i)
    keys = list(found)
    term = np.zeros((len(keys), window), np.int64)
    for w, k in enumerate(keys):
        term[w, : len(k)] = k
    return Phrases(vocabulary, term, np.array([len(k) for k in keys], np.int64), [sorted(set(found[k])) for k in keys], names)


HITS = "row_id long, doc_id long, row_key long, n_words long, spans binary, items array<string>"
FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, row_key long"


def _answers(doc_id: pa.Array, n_words: pa.Array, n_hit: list[int], items: list[list[str]], row_key: pa.Array) -> pa.RecordBatch:
    shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    arrays = [doc_id, n_words, pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(shas), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(items, pa.list_(pa.string())), row_key]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in FOUND.split(", ")])


def _covered(blobs: list[bytes]) -> int:
    return sum(b - a for a, b in _union([tuple(x) for blob in blobs for x in np.frombuffer(blob, np.int32).reshape(-1, 2).tolist()]))


def search(index: DataFrame, phrases: Phrases, within: int | None = None, finish: bool = False) -> DataFrame:
    """One row per document: its words, the spans [start, end) of words that phrases hit (int32
    pairs) and the ids of the items found.  ``within`` looks for the phrases' words in any order,
    each at most that many words from the rarest, instead of the exact sequence.  ``finish`` gives
    the rows of decontaminate, where these phrases are all."""
    inside = np.arange(phrases.term.shape[1]) < phrases.size[:, None]

    def found(seg: Segment) -> pa.RecordBatch:
        docs = len(seg.row_ids)
        start_of, count_of = seg.lists(phrases.vocabulary)
        live = ((count_of > 0)[phrases.term] | ~inside).all(1) if len(phrases.vocabulary) else np.zeros(0, bool)
        spans, items = [[] for _ in range(docs)], [set() for _ in range(docs)]
        for w in np.flatnonzero(live):
            n = int(phrases.size[w])
            starts, counts = start_of[phrases.term[w, :n]], count_of[phrases.term[w, :n]]
            at = seg.phrase(starts, counts) if within is None else seg.near(starts, counts, within)
            for d, p in zip((np.searchsorted(seg.first, at, "right") - 1).tolist(), at.tolist(), strict=True):
                spans[d].append((p - int(seg.first[d]), p - int(seg.first[d]) + (n if within is None else 1)))
                items[d].update(phrases.items[w])
        spans = [_union(x) for x in spans]
        names = [sorted(phrases.names[i] for i in x) for x in items]
        doc_id, row_key, n_words = pa.array(seg.doc_ids, mask=seg.doc_null.astype(bool)), pa.array(seg.row_keys), pa.array(np.diff(seg.first).astype(np.int64))
        if finish:
            return _answers(doc_id, n_words, [sum(b - a for a, b in x) for x in spans], names, row_key)
        blobs = pa.array([np.array(x, np.int32).tobytes() for x in spans], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(seg.row_ids), doc_id, row_key, n_words, blobs, pa.array(names, pa.list_(pa.string()))], names=[x.split()[0] for x in HITS.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield found(Segment.of(batch, i))

    return index.mapInArrow(lean(task), FOUND if finish else HITS)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded text, streamed to the driver, which holds one block at a time."""
    block, size = [], 0
    for item, text in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if size and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, index: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    items, row_key (a hash of doc_id and text).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; the index knows them
    by 64-bit hashes, and a window matches where all its hashes follow one another.  An item's
    windows are its runs of ``window`` words, or all its words if fewer.  Document words inside an
    exact occurrence of any window are hit.  Rarity, by which lists are intersected, is that within
    a segment.  The benchmark is the query set: it goes to every task in blocks of at most
    ``block_chars`` characters, each a pass over the stored index.

    Null texts have no words; items without words or id match nothing; equal items and repeated
    rows each answer; other columns are ignored; an empty benchmark hits nothing; an empty table
    gives no rows.
    """
    index = materialise(build_index(docs), "postings", blobs=True) if index is None else index
    blocks = _blocks(benchmark, block_chars)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return search(index, item_phrases(block, window), finish=True)
    passes = []
    while block is not None:  # documents without hits come from the first pass alone
        hits = search(index, item_phrases(block, window))
        passes.append(materialise(hits if not passes else hits.where(F.size("items") > 0), "hits"))
        block, after = after, next(blocks, None)
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    found = found.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("row_key").alias("row_key"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _answers(batch.column(1), batch.column(3), [_covered(x) for x in batch.column(4).to_pylist()], [sorted(x) for x in batch.column(5).to_pylist()], batch.column(2))

    return found.select("row_id", "doc_id", "row_key", "n_words", "spans", "items").mapInArrow(lean(several), FOUND)
