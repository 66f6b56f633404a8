"""The stages in order, each against the operator it applies and against plain Python."""

from __future__ import annotations

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import decontaminate, mixing, near_dedup, toxicity
from lakeloom.storage import materialise, table
from tests.compare import DATA, rows
from tests.llm.test_corpus import _classes, _edited, _hits, _without_boilerplate, words

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, seen[-1], SF), name)
        if name != "mix":
            assert out.schema.names == docs.schema.names
        seen.append(out)
    start, clean, lines, single, free, mixed = seen
    labels = table(spark, SF, "labels")
    scored = toxicity.score(start, toxicity.train(start, labels, toxicity.held_out()))
    assert rows(clean.select("doc_id").toPandas()) == rows(scored.where("predicted = 0").select("doc_id").toPandas())
    assert lines.count() == clean.count()
    kept = near_dedup.near_dedup(lines).where("kept").select("doc_id")
    assert rows(single.select("doc_id").toPandas()) == rows(kept.toPandas())
    assert near_dedup.near_dedup(single).where("NOT kept").count() == 0
    assert decontaminate.decontaminate(free, table(spark, SF, "benchmark")).where("contaminated").count() == 0
    bad = decontaminate.decontaminate(single, table(spark, SF, "benchmark")).where("contaminated").count()
    assert free.count() == single.count() - bad
    mix = mixing.mix_sources(free)
    assert rows(mixed.select("doc_id", "taken").toPandas()) == rows(mix.where("certain > 0 OR sampled").select("doc_id", "taken").toPandas())
    assert rows(corpus_pipeline.run(spark, SF).select("doc_id", "copies").toPandas()) == rows(mixed.select("doc_id", "copies").toPandas())


CLASHES = "score double, predicted int, held_out boolean, size long, source_size long, target double, copies long, taken long, certain int, sampled int, row_key string, maybe int, _bits int, _word int, n_lines int, n_removed int, starts int, kept int, class_id int, _row int, whole int, r int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def _documents():
    """Near and exact copies, boilerplate, benchmark passages, nulls, repeated rows and ids, long and empty texts."""
    base = [words(90, 700 + i) for i in range(8)]
    docs = [(i, _edited(base[i % 8], i % 4, i), f"s{i % 12}") for i in range(60)]
    docs += [(100 + i, f"{words(40, i)}\nthis line is on every site\nThe end.\n{words(5, i)}", f"s{i % 20}") for i in range(40)]
    docs += [(200 + i, f"{words(30, 300 + i)} {words(14, 9000 + i % 3)} {words(20, 400 + i)}", "s1") for i in range(12)]
    docs += [(300, None, "a"), (301, "", None), (302, " \n ", "a"), (303, words(9000, 5), "a"), (304, "short one", "b"), (None, words(30, 6), "b"), (None, words(30, 6), None), (3, docs[3][1], "s3"), (3, docs[3][1], "s3"), (3, words(33, 8), "s3"), (305, "é " * 500, "c"), (306, words(30, 6), "b")]
    return docs


BENCHMARK = [(1, words(14, 9000)), (2, words(14, 9001) + " more"), (3, "Short ONE"), (4, None), (None, "w1"), (5, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def _frame(spark, docs):
    n = len(SCHEMA.split(", ")) - 5
    values = [0.5, 1, True, 1, 1, 0.5, 1, 1, 1, 1, "x"] + [1] * (n - 11)
    return spark.createDataFrame([(i, t, "en", s, -1, *values) for i, t, s in docs], SCHEMA)


def _out(spark, folder, name, docs):
    df = _frame(spark, docs)
    out = dict(corpus_pipeline.STAGES)[name](spark, df, folder)
    kept = materialise(out, name)
    assert kept.columns[:5] == df.columns[:5] and (name == "mix" or kept.schema.names == df.schema.names)
    return kept


def test_toxicity_stage_keeps_what_it_has_no_reason_to_drop(spark, folder):
    docs = _documents()
    out = _out(spark, folder, "toxicity", docs)
    assert out.count() == len(docs) and {(r.score, r.predicted, r.size) for r in out.collect()} == {(0.5, 1, 1)}


def test_line_stage_against_plain_python(spark, folder):
    docs = _documents()
    out = _out(spark, folder, "line_dedup", docs)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == _without_boilerplate(docs)
    before = collections.Counter((i, t) for i, t, _ in docs)
    assert all(r.n_chars == (-1 if (r.doc_id, r.text) in before else len(r.text)) for r in out.collect())


def test_near_stage_against_plain_python(spark, folder):
    docs = _documents()
    got = collections.Counter((r.doc_id, r.text) for r in _out(spark, folder, "near_dedup", docs).collect())
    groups = collections.defaultdict(list)
    label = _groups(docs)
    for k, d in enumerate(docs):
        groups[label[k]].append(d)
    assert sum(got.values()) == len(groups)
    for members in groups.values():
        ids = [i for i, _, _ in members if i is not None]
        stays = {(i, t) for i, t, _ in members if i == (min(ids) if ids else None)}
        assert sum(got[x] for x in stays) == 1


def _groups(docs):
    """The class of every row, by its position, as _classes forms them."""
    own = _classes([(k, t, s) for k, (_, t, s) in enumerate(docs)])
    return [own[k] for k in range(len(docs))]


def test_benchmark_stage_against_plain_python(spark, folder):
    docs = _documents()
    items = [(i, t) for i, t in BENCHMARK if i is not None]
    got = collections.Counter((r.doc_id, r.text) for r in _out(spark, folder, "decontaminate", docs).collect())
    assert got == collections.Counter((i, t) for i, t, _ in docs if not _hits(t, items)[1])


def _mixed(docs, weights=(5, 2, 1), share=1.5, most=2.0):
    """How often the mix takes each row, by the rule and nothing else."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    total = collections.Counter()
    for (_, _, s), n in zip(docs, size, strict=True):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, budget = {}, set(names), share * sum(size)
    while left:
        level = budget / sum(w[s] for s in left)
        full = {s for s in left if most * total[s] < level * w[s]}
        if not full:
            target |= {s: level * w[s] for s in left}
            break
        target |= {s: most * total[s] for s in full}
        budget -= sum(most * total[s] for s in full)
        left -= full
    times = [0] * len(docs)
    for s in names:
        rows_ = [k for k, d in enumerate(docs) if d[2] == s]
        rate = target[s] / total[s] if total[s] else 0.0
        sure = int(rate)
        p, rest = min(rate - sure, 1 - 1e-9), target[s] - sure * total[s]
        rank = {}
        for k in rows_:
            times[k] = sure
            u = (int(hashlib.md5(f"mix-1:{'null' if docs[k][0] is None else docs[k][0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if p > 0:
                rank[k] = (u / (1 - u) / (p / (1 - p)), -1 if docs[k][0] is None else docs[k][0], size[k])
        order, at = sorted(rank, key=rank.get), 0
        while at < len(order) and sum(size[k] for k in order[: at + 1]) <= rest:
            times[order[at]] += 1
            at += 1
        gap = rest - sum(size[k] for k in order[:at])
        more = [(abs(size[k] - gap), rank[k], k) for k in order[at:] if size[k] and abs(size[k] - gap) < gap]
        if more:
            times[min(more)[2]] += 1
    return times, size, target


def test_mix_stage_against_plain_python(spark, folder):
    docs = [d for k, d in enumerate(_documents()) if (d[0], d[1]) not in [(x[0], x[1]) for x in _documents()[:k]]]
    times, size, target = _mixed(docs)
    got = {(r.doc_id, r.text): (r.copies, r.taken, r.size, round(r.target, 6)) for r in _out(spark, folder, "mix", docs).collect()}
    assert got == {(i, t): (n, n * k, k, round(target[s], 6)) for (i, t, s), n, k in zip(docs, times, size, strict=True) if n}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, folder, name):
    assert _out(spark, folder, name, []).count() == 0


def test_stages_one_after_another_on_odd_documents(spark, folder):
    docs = _frame(spark, _documents())
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder), name)
    assert 0 < docs.count() and docs.where(F.col("taken") != F.col("copies") * F.col("size")).count() == 0
