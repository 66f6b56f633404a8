"""Near-duplicate documents: BagMinHash signatures, bands, and exact multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeloom.llm.filters import maybe_among
from lakeloom.llm.text import MIX1, SOLID, Texts, blob_column, in_batches, lean, mix, shingle_hashes
from lakeloom.storage import materialise

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: A bucket of at most so many texts is compared pair by pair.
SMALL = 8
#: Texts whose signatures one task compares; a bucket of more is compared block against block.
BLOCK = 2_048
#: Likely pairs a text from which a bucket is compared in one piece.
DENSE = 8
#: Bytes of text in one of the two blocks whose texts are compared with one another at once.
DENSE_BYTES = 2_000_000
_ROW_BITS = 13


def bags(rows: Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 51-bit shingle and count of every distinct shingle of every row, sorted.  A text of
    fewer than ``k`` words has one shingle of all its words, one without words none."""
    s, e, first = rows.spans(SOLID)
    h = rows.hashes(s, e)
    n = np.diff(first)
    row = np.repeat(np.arange(rows.rows), n)
    sh = shingle_hashes(h, k)
    inside = np.arange(len(sh)) + k <= first[1:][row[: len(sh)]]
    keys = [(row[: len(sh)][inside].astype(np.uint64) << np.uint64(64 - _ROW_BITS)) | (sh[inside] >> np.uint64(_ROW_BITS))]
    for short in range(1, k):
        at = np.flatnonzero(n == short)
        if len(at):
            keys.append((at.astype(np.uint64) << np.uint64(64 - _ROW_BITS)) | (shingle_hashes(h, short)[first[at]] >> np.uint64(_ROW_BITS)))
    key = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(key)))
    u = key[new]
    return (u >> np.uint64(64 - _ROW_BITS)).astype(np.int64), u & ((np.uint64(1) << np.uint64(64 - _ROW_BITS)) - np.uint64(1)), counts


def bag_min_hash(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_rows: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures of weighted bags: two of them agree in a slot with probability equal to the
    weighted Jaccard similarity, the sum of minima over the sum of maxima of the counts.

    Every shingle has a Poisson process over time and weight, of rate one a slot, the same in all
    documents; a slot's value is the time of the first point whose weight is within the shingle's
    count.  The weight axis is cut at 1, 2, 4, 8, ...; a strip's process has the rate of its width
    and its points fall anywhere in it, so a count costs its logarithm.  A bag of total weight W
    has its slots filled by about time log(slots) / W, and no process is followed beyond that: long
    texts touch most shingles once.
    """
    sig = np.full((n_rows, slots), np.inf)
    weight = np.bincount(row, count, n_rows)
    level, todo = 2.0, np.flatnonzero(weight)
    while len(todo):
        until = np.zeros(n_rows)
        until[todo] = (np.log(slots) + level) / weight[todo]
        sig[todo] = np.inf
        own = until[row] > 0
        r0, s0, c0 = row[own], shingle[own], count[own]
        strip = 0
        while len(r0):
            low, width = (0.0, 1.0) if strip == 0 else (2.0 ** (strip - 1), 2.0 ** (strip - 1))
            over = c0 > low
            r0, s0, c0 = r0[over], s0[over], c0[over]
            r, c, seed = r0, c0, mix(s0 * MIX1 + np.uint64(strip + 1))
            t, i = np.zeros(len(r)), 0
            while len(r):
                i += 1
                x = mix(seed + np.uint64(i * int(MIX1) & (1 << 64) - 1))
                t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (slots * width)
                live = t <= until[r]
                r, c, seed, t, x = r[live], c[live], seed[live], t[live], x[live]
                y = mix(x)
                at, when = r * slots + (y % np.uint64(slots)).astype(np.int64), t
                if strip:
                    inside = low + width * (((mix(y) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) <= c
                    at, when = at[inside], when[inside]
                np.minimum.at(sig.reshape(-1), at, when)
            strip += 1
        todo = todo[np.isinf(sig[todo]).any(1)]
        level *= 2
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.full((len(sig), BANDS), np.uint64(0)) + np.arange(1, BANDS + 1, dtype=np.uint64) * MIX1
    for i in range(ROWS):
        key = mix(key * MIX1 + bits[:, :, i])
    return key


def sketch(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """node (128 bits of the text's SHA-256), doc_id, row_key, band keys (none without words) and the
    signature, one byte a slot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, bytes_of = [], []
            for _, rows in Texts.of(batch.column(2)).chunks(1_000_000, (1 << _ROW_BITS) - 1):
                row, sh, count = bags(rows, k)
                sig = bag_min_hash(row, sh, count, rows.rows)
                keys = band_keys(sig)
                bytes_of.append((mix(sig.view(np.uint64)) & np.uint64(255)).astype(np.uint8))
                some = np.bincount(row, minlength=rows.rows) > 0
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(keys[some].reshape(-1).view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64())), blob_column(np.concatenate(bytes_of).reshape(-1) if bytes_of else np.zeros(0, np.uint8), np.arange(batch.num_rows + 1) * SLOTS)], names=["node", "doc_id", "row_key", "bands", "sig"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(node_of(text).alias("node"), F.col("doc_id").cast("long"), text.alias("text"), row_key().alias("row_key")).mapInArrow(lean(task), "node binary, doc_id long, row_key long, bands array<long>, sig binary")


def row_key():
    return F.xxhash64("doc_id", "text")


def node_of(text) -> object:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def verify(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """a, b and the exact weighted Jaccard similarity of their texts' shingle bags."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = Texts.of(batch.column(2)), Texts.of(batch.column(3))
            sims, a = np.zeros(batch.num_rows), 0
            size = ta.offsets + tb.offsets
            while a < batch.num_rows:
                b = min(max(a + 1, int(np.searchsorted(size, size[a] + 4_000_000, "right")) - 1), a + (1 << _ROW_BITS) - 1, batch.num_rows)
                (ra, sa, ca), (rb, sb, cb) = (bags(t.part(a, b), k) for t in (ta, tb))
                key_a, key_b = ((r.astype(np.uint64) << np.uint64(64 - _ROW_BITS)) | s for r, s in ((ra, sa), (rb, sb)))
                both = np.zeros(b - a)
                if len(key_a) and len(key_b):
                    at = np.minimum(np.searchsorted(key_b, key_a), len(key_b) - 1)
                    same = key_b[at] == key_a
                    both = np.bincount(ra[same], np.minimum(ca[same], cb[at[same]]), b - a)
                total = np.bincount(ra, ca, b - a) + np.bincount(rb, cb, b - a)
                sims[a:b] = both / np.maximum(total - both, 1)
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["a", "b", "sim"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(task), "a long, b long, sim double")


def _least_agreement(similarity: float) -> int:
    return int(SLOTS * similarity - 5.4 * (SLOTS * similarity * (1 - similarity)) ** 0.5)


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose signatures agree in enough slots: a pair of the given similarity is lost with
    a probability under 1e-7 (5.4 standard deviations)."""
    least = _least_agreement(similarity)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(Texts.of(batch.column(i)).raw, np.uint8).reshape(-1, SLOTS) for i in (2, 3))
            at = pa.array(np.flatnonzero((x == y).sum(1) >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    left, right = (nodes.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lean(task), "a long, b long")


def _complete_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket after another (first column), from partitions sorted by bucket."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        bucket = held.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist()]
        for u, v in zip(cuts[:-1], cuts[1:], strict=True):
            yield held.slice(u, v - u)
        held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def in_groups(members: DataFrame) -> DataFrame:
    """members(bucket, id, label, n) dealt into groups of about BLOCK texts that hold every pair of one
    bucket and different labels: bucket (the group's key), id, label, side.

    A bucket of up to BLOCK texts is one group.  The texts of a larger one are dealt into blocks of
    half that, those of a label with more than a block apart from the others; a group is two blocks
    (side 0 and 1), of which only pairs across count, or one block by itself.  Blocks of one label
    do not meet.
    """
    half = max(BLOCK // 2, 1)
    small = members.where(F.col("n") <= BLOCK).select("bucket", "id", "label", F.lit(0).alias("side"))
    large = members.where(F.col("n") > BLOCK).select("bucket", "id", "label")
    own = large.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m")).withColumn("own", F.when(F.col("m") > half, F.col("label")).otherwise(-1))
    size = own.groupBy("bucket", "own").agg(F.ceil(F.sum("m") / half).alias("blocks"))
    size = materialise(size, "blocks")
    cells = size.select("bucket", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"))
    x, y = (cells.select("bucket", F.col("own").alias(f"own_{c}"), F.col("part").alias(f"part_{c}")) for c in "xy")
    meet = x.join(y, "bucket").where("own_x < own_y OR own_x = -1 AND own_y = -1 AND part_x <= part_y")
    meet = meet.withColumn("group", F.xxhash64("bucket", "own_x", "part_x", "own_y", "part_y"))
    twice = "own_x <> own_y OR part_x <> part_y"
    places = meet.select("bucket", F.col("own_x").alias("own"), F.col("part_x").alias("part"), "group", F.lit(0).alias("side")).unionByName(meet.where(twice).select("bucket", F.col("own_y").alias("own"), F.col("part_y").alias("part"), "group", F.lit(1).alias("side")))
    placed = large.join(own.where("own <> -1").select("bucket", "label", "own"), ["bucket", "label"], "left").withColumn("own", F.coalesce("own", F.lit(-1).cast("long")))
    placed = placed.join(size, ["bucket", "own"]).withColumn("part", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")))
    dealt = placed.join(places, ["bucket", "own", "part"]).select(F.col("group").alias("bucket"), "id", "label", "side")
    return small.unionByName(dealt)


def close_in_blocks(members: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts of one group and different labels whose signatures agree as in likely, in a
    group of two sides those across; b is null and bucket set for the texts of groups with over DENSE
    such pairs a text.  A group's signatures (SLOTS bytes each) are compared in the task that has it,
    block by block."""
    least = _least_agreement(similarity)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _complete_groups(batches):
            ids, label, side = (group.column(i).to_numpy() for i in (1, 2, 4))
            sig = np.frombuffer(Texts.of(group.column(3).combine_chunks()).raw, np.uint8).reshape(-1, SLOTS)
            one = np.arange(len(ids))
            left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (one, one)
            out, count, dense = [np.zeros((0, 2), np.int64)], 0, False
            for i in range(0, len(left), 256):
                for j in range(0 if side.any() else i - i % BLOCK, len(right), BLOCK):
                    x, y = left[i : i + 256], right[j : j + BLOCK]
                    agree = np.zeros((len(x), len(y)), np.uint8)
                    for c in range(SLOTS):
                        agree += sig[x, c][:, None] == sig[y, c]
                    p, q = np.nonzero((agree >= least) & (label[x][:, None] != label[y]) & (side.any() | (x[:, None] < y)))
                    out.append(np.sort(np.stack([ids[x][p], ids[y][q]], 1), 1))
                    count += len(p)
                dense = count > DENSE * len(ids)
                if dense:
                    break
            bucket = group.column(0).to_numpy()
            if dense:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(bucket)], names=["a", "b", "bucket"])
            elif count:
                got = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), pa.nulls(len(got), pa.int64())], names=["a", "b", "bucket"])

    members = members if "side" in members.columns else members.withColumn("side", F.lit(0))
    rows = members.join(nodes.select("id", "sig"), "id").select("bucket", "id", "label", "sig", "side")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(task), "a long, b long, bucket long")


def _overlaps(texts: Texts, k: int) -> np.ndarray:
    """Weighted Jaccard similarities of all rows with one another: the k-th time that a text has a
    shingle is a feature of its own, so a multiset overlap is a product of 0-1 rows."""
    row, shingle, count = bags(texts, k)
    total = np.bincount(row, count, texts.rows).astype(np.float32)
    rows, keys = [row], [mix(shingle)]
    again, nth = np.flatnonzero(count > 1), 2
    while len(again):
        rows.append(row[again])
        keys.append(mix(mix(shingle[again]) + np.uint64(nth)))
        nth += 1
        again = again[count[again] >= nth]
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(key)
    row, key = row[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else new
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((texts.rows, texts.rows), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else 0) + 4096, 4096))
    for n, (u, v) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        x = np.zeros((texts.rows, 4096), np.float32)
        x[row[u:v], column[u:v] - n * 4096] = 1
        both += x @ x.T
    return both / np.maximum(total[:, None] + total - both, 1)


def link_dense(dense: DataFrame, texts: DataFrame, similarity: float, k: int) -> DataFrame:
    """Links (a, b) that connect what all links within each bucket of dense(bucket, id) connect, by
    exact similarities of the whole texts, computed in the task that has the bucket, two blocks of
    about DENSE_BYTES at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _complete_groups(batches):
            ids = group.column(1).to_numpy()
            column = group.column(2).combine_chunks()
            whole = Texts.of(column)
            cuts, pairs = [0], []
            while cuts[-1] < len(ids):
                full = int(np.searchsorted(whole.offsets, whole.offsets[cuts[-1]] + DENSE_BYTES, "right")) - 1
                cuts.append(min(max(full, cuts[-1] + 1), cuts[-1] + BLOCK, len(ids)))
            blocks = [np.arange(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            for i, x in enumerate(blocks):
                for y in blocks[i + 1 :] or blocks[i:]:
                    at = x if y is x else np.concatenate([x, y])
                    hit = _overlaps(Texts.of(column.take(pa.array(at))), k) >= similarity
                    pairs += _spanning(hit, ids[at])
            if pairs:
                got = np.array(pairs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    rows = dense.join(texts, "id").select("bucket", "id", "text")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(task), "a long, b long")


def _spanning(hit: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """A star for each connected part of a symmetric matrix of links."""
    left, out = np.ones(len(ids), bool), []
    for i in range(len(ids)):
        if left[i]:
            part = np.zeros(len(ids), bool)
            part[i] = True
            edge = part
            while edge.any():
                edge = hit[edge].any(0) & ~part
                part = part | edge
            left &= ~part
            out += [(int(ids[i]), int(x)) for x in ids[part] if x != ids[i]]
    return out


def link_texts(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """id and label of the texts that have a link: one label for all that links connect, directly
    or through others.  Links are pairs that share a band and are verified.

    Only pairs of different labels are compared, and a bucket (the texts that share a band) is
    done once it has one label.  Buckets of up to SMALL texts are compared pair by pair.  In a
    larger one every text is first compared with a leader, the text with the most company over all
    its bands: copies differ from one another more than from what they were made of, whose bands
    are the commonest.  Labels are merged then, so a group of near copies is mostly done.  In
    buckets that still have several labels all signatures of different labels are compared, in
    groups of about BLOCK texts that a task has (in_groups); if nearly all agree there, so are the
    whole texts of the group, and no pair leaves the task.
    """
    shared = nodes.select("id", F.explode("bands").alias("bucket"))
    full = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(shared.join(full, "bucket"), "shared")
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    lead = members.where(F.col("n") > SMALL).join(company, "id").groupBy("bucket").agg(F.max(F.struct("company", F.col("id").alias("leader"))).alias("l")).select("bucket", "l.leader")
    led = members.where(F.col("n") > SMALL).join(lead, "bucket").where("id <> leader").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b"))
    few = members.where(F.col("n") <= SMALL)
    close = few.withColumnRenamed("id", "a").join(few.select("bucket", F.col("id").alias("b")), "bucket").where("a < b").select("a", "b")
    pairs = materialise(led.unionByName(close).distinct(), "pairs")
    near = materialise(likely(pairs, nodes, similarity), "near0")
    labels = _merge(near, None, nodes, docs, similarity, k, 0)
    mine = _labelled(members.where(F.col("n") > SMALL).select("id", "bucket"), labels)
    mixed = mine.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket", "n")
    members = materialise(mine.join(mixed, "bucket"), "members1")
    if members.isEmpty():
        return labels
    found = materialise(close_in_blocks(in_groups(members), nodes, similarity), "found1")
    near = found.where("b IS NOT NULL").select("a", "b").distinct()
    near = materialise(near.join(pairs, ["a", "b"], "left_anti"), "near1")
    return _merge(near, labels, nodes, docs, similarity, k, 1, found.where("b IS NULL").select("bucket", F.col("a").alias("id")))


def _merge(near: DataFrame, labels: DataFrame | None, nodes: DataFrame, docs: DataFrame, similarity: float, k: int, level: int, dense: DataFrame | None = None) -> DataFrame:
    """Labels after the links among the pairs ``near`` and within ``dense`` buckets are added."""
    ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id")))
    ids = ids if dense is None else ids.unionByName(dense.select("id"))
    if ids.isEmpty():
        return nodes.sparkSession.createDataFrame([], "id long, label long") if labels is None else labels
    texts = _texts(ids.distinct(), nodes, docs, level)
    links = verify(near, texts, k).where(F.col("sim") >= similarity).select("a", "b")
    if dense is not None and not dense.isEmpty():
        links = links.unionByName(link_dense(dense, texts, similarity, k))
    if labels is not None:
        links = links.unionByName(labels.select(F.col("label").alias("a"), F.col("id").alias("b")))
    return materialise(components(links), f"labels{level}")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _texts(ids: DataFrame, nodes: DataFrame, docs: DataFrame, level: int) -> DataFrame:
    """id and text of the texts ``ids``; those that a filter of fixed size clears are not moved."""
    wanted = materialise(nodes.select("id", "node").join(ids, "id", "left_semi"), f"wanted{level}")
    whole = docs.select(node_of(F.coalesce("text", F.lit(""))).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    one = maybe_among(whole, wanted, "node").groupBy("node").agg(F.any_value("text").alias("text"))
    return materialise(one.join(wanted, "node").select("id", "text"), f"texts{level}")


def components(links: DataFrame, limit: int = 200) -> DataFrame:
    """id and label (the smallest id of its component) for every id of the links (a, b), by alternating
    large-star and small-star rounds until nothing changes, which takes about the square of the
    logarithm of the ids; an error if ``limit`` rounds do not do."""
    edges = materialise(links.select("a", "b").where("a <> b").distinct(), "edges0")
    before = None
    for i in range(limit):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small_least = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(small_least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(small_least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = materialise(star.where("a <> b").distinct(), f"edges{i + 1}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {limit} rounds")


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, n_texts, kept, row_key (a hash of
    doc_id and text).

    Documents are in one class if their texts are equal or linked, directly or through others, by
    a weighted Jaccard similarity of at least ``similarity`` of their bags of ``k``-word shingles
    (words are runs without white space, case kept; a shorter text is one shingle).  class_id is the
    smallest doc_id of the class.  kept marks one row of each class: one that has this doc_id, of
    several that with the smallest row_key, and of rows that repeat both any one.

    Equal texts are one node from the start, so copies cost nothing more.  A link is verified on
    whole texts; a pair of similarity 0.8 shares no band with probability 5e-8.  Null texts are
    empty; empty texts equal one another and nothing else; a null doc_id is in a class but gives
    it no id and is kept only where the class has no other; other columns are ignored; an empty
    table gives no rows.
    """
    rows = materialise(sketch(in_batches(docs), k).withColumn("rid", F.monotonically_increasing_id()), "sketches")  # rids are fixed once they are written
    nodes = rows.groupBy("node").agg(F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig")).withColumn("id", F.monotonically_increasing_id())
    nodes = materialise(nodes, "nodes")
    labels = link_texts(nodes.where(F.size("bands") > 0), docs, similarity, k)
    ids = nodes.select("node", "id").join(labels, "id", "left").select("node", F.coalesce("label", "id").alias("label"))
    member = materialise(rows.select("doc_id", "row_key", "rid", "node").join(ids, "node"), "members")
    classes = member.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.count_distinct("node").alias("n_texts"))
    out = member.drop("node").join(classes, "label")
    first = out.where(F.col("doc_id").eqNullSafe(F.col("class_id")))  # without copies of one doc_id, a row a class
    order = F.struct("row_key", "rid")
    first = first.groupBy(F.col("label").alias("first_label")).agg(F.min(order).alias("first"))
    out = out.join(first, F.col("label") == F.col("first_label"))
    return out.select("doc_id", "class_id", "class_size", "n_texts", (F.col("rid") == F.col("first.rid")).alias("kept"), "row_key")
