"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lakeloom.llm.text import ALNUM, Texts, in_batches, lean
from lakeloom.storage import materialise

#: The model is fitted on at most so many labelled rows, those with the smallest doc_id hashes.
MAX_TRAIN = 20_000
#: Terms of the learned lexicon, at most.
MAX_TERMS = 4_096
FOLDS = 3
THRESHOLD = 0.3
INSULTS = "idiot stupid moron dumb loser trash scum worthless pathetic disgusting clown jerk fool ugly shut hate kill".split()
PRONOUNS = "you your yours u ur du dich dir dein ihr euch tu te toi ton vous votre tú ti usted ustedes vosotros".split()
#: Letters that digits and signs stand for in disguised words.
LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
_SPACED = bytes(1 if 97 <= b <= 122 or b >= 128 or 48 <= b <= 57 or b in b"@$!*" else 0 for b in range(256))
_UPPER, _LETTER, _PUNCT, _DIGIT, _CONT = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _DIGIT[48:58] = True
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_CONT[128:192] = True
FEATURES = 24


def _hashes_of(words: list[str]) -> np.ndarray:
    t = Texts.of(pa.array(words))
    return np.sort(t.hashes(t.offsets[:-1], t.offsets[1:]))


def _has(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def _terms(rows: Texts, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """Three terms of each word: itself, and its first 5 and 7 bytes."""
    return [rows.hashes(s, e), rows.hashes(s, np.minimum(e, s + 5), seed=5), rows.hashes(s, np.minimum(e, s + 7), seed=7)]


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
    return c[first[1:]] - c[first[:-1]]


def _maxima(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.maximum.reduceat(x, first[:-1][full])
    return out


@dataclass
class Lexicon:
    terms: np.ndarray
    weights: np.ndarray

    def weigh(self, h: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, self.weights[at], 0.0)


def features(texts: Texts, lexicon: Lexicon) -> np.ndarray:
    """FEATURES numbers per row, from whole texts; no label, language, source or id goes in."""
    out = np.zeros((texts.rows, FEATURES))
    insults, pronouns = _hashes_of(INSULTS), _hashes_of(PRONOUNS)
    for a, raw in texts.chunks(500_000):
        low = raw.lower()
        s, e, first = low.spans(ALNUM)
        n = np.diff(first).astype(np.float64)
        per = 1 / np.maximum(n, 1)
        h, h5, h7 = _terms(low, s, e)
        weight = np.maximum(np.maximum(lexicon.weigh(h), lexicon.weigh(h5)), lexicon.weigh(h7))
        insult, second = _has(insults, h), _has(pronouns, h)
        hit = insult | (weight > 0)
        b = np.frombuffer(raw.raw, np.uint8)
        size = np.maximum(np.diff(raw.offsets), 1).astype(np.float64)
        chars = lambda m: _sums(m[b], raw.offsets)
        upper, letters, word_upper = chars(_UPPER), chars(_LETTER), np.concatenate([[0], np.cumsum(_UPPER[b])])
        shouted = (word_upper[e] - word_upper[s] == e - s) & (e - s > 2) if len(s) else insult
        near = np.zeros(len(h))
        at = np.flatnonzero(second)
        if len(at):
            k = np.searchsorted(at, np.arange(len(h)))
            far = np.minimum(np.abs(at[np.minimum(k, len(at) - 1)] - np.arange(len(h))), np.abs(np.arange(len(h)) - at[np.maximum(k - 1, 0)]))
            near = np.where(hit, 1 / (1.0 + far), 0.0)
        # disguised words: runs that may hold signs, read with signs as letters
        ds, de, dfirst = low.spans(_SPACED)
        plain = Texts(low.raw.translate(LEET), low.offsets)
        mixed = np.concatenate([[0], np.cumsum((_DIGIT | _PUNCT)[np.frombuffer(low.raw, np.uint8)])])
        odd = mixed[de] - mixed[ds] if len(ds) else ds
        cand = np.flatnonzero((odd > 0) & (odd < de - ds))
        masked = np.zeros(len(ds), bool)
        masked[cand] = _has(insults, plain.hashes(ds[cand], de[cand]))
        some = np.zeros(len(ds), bool)
        some[cand] = True
        single = (e - s) == 1
        b3 = (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (_LETTER | _PUNCT)[b[2:]] if len(b) > 2 else np.zeros(0, bool)
        stretch = np.zeros(len(b), bool)
        stretch[: len(b3)] = b3
        total, top = _sums(weight, first), _maxima(weight, first)
        strong = weight >= 1.5
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        cols = [
            np.log1p(n), np.log1p(size), _sums(insult, first), _sums(insult, first) * per, total, total * per, top, _sums(weight > 0, first) * per,
            _sums(weight > 0, first), _sums(strong, first), _sums(strong, first) * per, _sums(near, first), _maxima(near, first), _sums(second, first) * per,
            upper / np.maximum(letters, 1), _sums(shouted, first) * per, chars(_PUNCT) / size, _sums(b == 33, raw.offsets) / size, _sums(b == 63, raw.offsets) / size,
            _sums(masked, dfirst), _sums(some, dfirst) * per, _sums(stretch, raw.offsets) / size, _sums(single, first) * per, _sums(again, first) * per,
        ]
        out[a : a + raw.rows] = np.stack(cols, 1)
    return out


def _count_terms(train: DataFrame, min_docs: int) -> dict[int, Lexicon]:
    """For each fold, and -1, the lexicon learned from the labelled rows outside of it: terms by
    the log-odds of toxic documents, the MAX_TERMS with most evidence."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            fold = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = []
            for a, rows in Texts.of(batch.column(0)).chunks(500_000):
                rows = rows.lower()
                s, e, first = rows.spans(ALNUM)
                row = np.repeat(np.arange(rows.rows), np.diff(first))
                for h in _terms(rows, s, e):
                    pair = np.unique(np.stack([h, row.astype(np.uint64)], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                    r = a + pair[:, 1].astype(np.int64)
                    keys.append(pa.table({"term": pair[:, 0].view(np.int64) if len(pair) else np.zeros(0, np.int64), "cls": toxic[r] + 2 * fold[r]}))
            if keys:
                t = pa.concat_tables(keys).group_by(["term", "cls"]).aggregate([([], "count_all")])
                yield from t.rename_columns(["term", "cls", "n"]).to_batches()

    counts = train.select("text", "toxic", "fold").mapInArrow(lean(task), "term long, cls long, n long")
    wide = counts.groupBy("term").agg(*[F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)])
    toxic = sum((F.col(f"c{2 * f + 1}") for f in range(FOLDS)), F.lit(0))
    clean = sum((F.col(f"c{2 * f}") for f in range(FOLDS)), F.lit(0))
    evidence = toxic / F.sqrt(toxic + 20 * clean + 1)
    table = wide.where(toxic >= min_docs).orderBy(evidence.desc(), "term").limit(4 * MAX_TERMS).toPandas()
    sizes = np.zeros(2 * FOLDS)
    for cls, n in train.groupBy((F.col("toxic") + 2 * F.col("fold")).alias("cls")).count().collect():
        sizes[cls] = n
    c = table[[f"c{i}" for i in range(2 * FOLDS)]].to_numpy(np.float64).reshape(-1, 2 * FOLDS)
    terms = table["term"].to_numpy(np.int64).view(np.uint64)
    found = {}
    for out in range(-1, FOLDS):
        use = [f for f in range(FOLDS) if f != out]
        t, k = c[:, [2 * f + 1 for f in use]].sum(1), c[:, [2 * f for f in use]].sum(1)
        nt, nk = sizes[[2 * f + 1 for f in use]].sum(), sizes[[2 * f for f in use]].sum()
        odds = np.log((t + 0.25) / (nt + 0.5)) - np.log((k + 0.5) / (nk + 1))
        score = odds * np.sqrt(t)
        ok = np.flatnonzero((t >= min_docs) & (odds > 0.7) & (score > 2.0))
        ok = ok[np.argsort(-score[ok], kind="stable")][:MAX_TERMS]
        order = ok[np.argsort(terms[ok])]
        found[out] = Lexicon(terms[order], odds[order])
    return found


@dataclass
class Trees:
    """Boosted trees of one depth, as arrays: split feature, threshold and leaf values."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            score += v[node - (len(f))]
        return score


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 3, rate: float = 0.12, bins: int = 48, l2: float = 2.0) -> Trees:
    """Histogram boosting of the logistic loss."""
    p = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) < 20 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [e if len(e) else np.zeros(1) for e in edges]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    d = x.shape[1]
    flat = code + np.arange(d) * bins
    score = np.full(len(y), base)
    out_f, out_c, out_v = [], [], []
    for _ in range(n_trees):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        f, c, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            start, width = 2**level - 1, 2**level
            idx = ((node - start)[:, None] * (d * bins) + flat).ravel()
            gs = np.bincount(idx, np.repeat(g, d), width * d * bins).reshape(width, d, bins).cumsum(2)
            hs = np.bincount(idx, np.repeat(h, d), width * d * bins).reshape(width, d, bins).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < 1) | (ht - hs < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    f[start + k], c[start + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > c[node])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        score += v[leaf]
        out_f.append(f)
        out_c.append(c)
        out_v.append(v)
    return Trees(base, np.array(out_f), np.array(out_c), np.array(out_v))


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots of a rising curve from raw score to probability."""
    if not len(raw):
        return np.array([0.0]), np.array([0.0])
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of raw scores
    for r, t in zip(raw[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, r2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2] + r2]
    x = np.array([b[2] / b[1] for b in blocks])
    p = np.array([(b[0] + 0.02) / (b[1] + 0.2) for b in blocks])
    return x, np.maximum.accumulate(p)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: Texts) -> np.ndarray:
        raw = self.trees.raw(features(texts, self.lexicon))
        x, p = self.knots
        # ties that the steps leave are ordered by the raw score
        return np.clip(0.998 * np.interp(raw, x, p) + 0.002 / (1 + np.exp(-raw)), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, held_out: object = None, max_train: int = MAX_TRAIN) -> Model:
    """Fits on labelled rows for which ``held_out`` (a Column over labels) is not true, at most
    ``max_train`` of them.  Lexicon, trees and calibration use cross-fitting: a row's lexicon
    features and the score it is calibrated on come from models that did not see it."""
    use = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if held_out is not None:
        use = use.where(~held_out)
    key = F.xxhash64(F.col("doc_id"), F.lit("train"))
    use = use.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).orderBy(key, "doc_id").limit(max_train)
    rows = in_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(use), "doc_id")  # max_train rows of two numbers
    rows = materialise(rows.select("doc_id", "text", "toxic", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(FOLDS)).alias("fold")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id"), "train")
    lexica = _count_terms(rows, 3)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts.of(batch.column(3))
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            both = np.zeros((texts.rows, FEATURES))
            for f in range(FOLDS):
                at = np.flatnonzero(fold == f)
                sub = Texts.of(batch.column(3).take(pa.array(at)))
                both[at] = features(sub, lexica[f])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(list(both), pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    seen = rows.select("doc_id", "toxic", "fold", "text").mapInArrow(lean(task), "doc_id long, toxic long, fold long, x array<double>").toPandas().sort_values(["doc_id", "toxic"])
    x = np.array(seen["x"].tolist(), np.float64).reshape(-1, FEATURES)
    y, fold = seen["toxic"].to_numpy(np.float64), seen["fold"].to_numpy()
    unseen = np.zeros(len(y))
    for f in range(FOLDS):
        at = fold == f
        unseen[at] = fit_trees(x[~at], y[~at]).raw(x[at])
    return Model(lexica[-1], fit_trees(x, y), fit_isotonic(unseen, y))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with score and predicted (columns of these names are replaced)."""
    docs = in_batches(docs).drop("score", "predicted")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(Texts.of(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(lean(task), schema)


def held_out() -> object:
    """True for rows whose crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: its columns, held_out, score (0 to 1, higher: likelier toxic)
    and predicted (1 if score >= ``threshold``).

    Labels are learned from rows that are not held out only.  Null and empty texts score as texts
    without words; a null doc_id is not held out and has no label; labels other than 0 and 1 are
    ignored and of several labels of a document the higher counts; with fewer than 20 labels, or
    labels of one kind, every score is near the share of toxic labels; clashing columns held_out,
    score and predicted are replaced.
    """
    model = train(docs, labels, held_out())
    return score(docs.withColumn("held_out", held_out()), model, threshold)
