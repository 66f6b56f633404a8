"""Edge cases and brute force for the corpus operators."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import chat_format, decontaminate, exact_dedup, filters, line_dedup, mixing, near_dedup, pii, substring_dedup, token_rollup, toxicity
from lakeloom.llm.fm_index import FMIndex, WaveletMatrix
from lakeloom.llm.queries import ORACLE, QUERIES
from lakeloom.llm.text import ALNUM, NOT_NEWLINE, SOLID, Texts
from tests.compare import DATA, connect, rows

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, n_lines long"
WORDS = [f"w{i}" for i in range(400)]


def words(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def make(spark, docs):
    """Documents of (doc_id, text, source), with columns whose names clash with results'."""
    return spark.createDataFrame([(i, t, "en", s, 0, 1, True, 0.5, 9) for i, t, s in docs], COLUMNS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, very long and repeated texts, ties and a row twice."""
    long = words(30_000, 1)
    docs = [(1, None, "a"), (2, "", None), (3, "x", "b"), (3, "x", "b"), (4, long, "a"), (5, long, "c"), (6, " \n\t ", "a"), (None, "lost id", "a"), (7, words(50, 2), None), (8, words(50, 2) + " tail", "b"), (9, "é" * 1000, "b"), (10, "a" * 100_000, "c")]
    return make(spark, docs)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, name):
    got = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    assert rows(got) == rows(connect("sf0.001").execute(ORACLE[name]).df())


# --- text kernels


@pytest.mark.parametrize("cls,pattern", [(SOLID, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NOT_NEWLINE, r"[^\n]+")])
def test_spans_are_regex_matches(cls, pattern):
    texts = ["", "one two", "é à  ü", "tail ", " x", "y", "", "a\nb\n\nc", "z" * 50]
    t = Texts.of(pa.array(texts))
    s, e, first = t.spans(cls)
    got = [[t.raw[a:b].decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [re.findall(pattern, x) for x in texts]
    h = t.hashes(s, e)
    flat = [w for x in got for w in x]
    assert len({int(v) for v in h}) == len(set(flat))


def test_chunks_cover_all_rows():
    texts = [words(n, n) for n in (0, 5, 400, 1, 0, 90)]
    t = Texts.of(pa.array([None, *texts]))
    assert [c.raw[c.offsets[i] : c.offsets[i + 1]].decode() for _, c in t.chunks(300, 2) for i in range(c.rows)] == ["", *texts]


# --- exact dedup


def test_exact_dedup_edge_cases(spark, odd, empty):
    r = exact_dedup.exact_dedup(odd, keep="max").collect()
    by = collections.defaultdict(list)
    for x in r:
        by[x.doc_id].append(x)
    assert len(r) == 12
    assert by[1][0].keep_id == 2 and not by[1][0].kept and by[2][0].kept and by[1][0].group_size == 2
    assert by[4][0].keep_id == 5 and [x.group_size for x in by[3]] == [2, 2]
    assert by[None][0].kept and by[None][0].group_size == 1
    assert by[6][0].text_sha256 == hashlib.sha256(b" \n\t ").hexdigest()
    assert exact_dedup.exact_dedup(odd, keep="min").where("doc_id = 5").first().keep_id == 4
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_bytes_decide_when_digests_collide(spark):
    docs = make(spark, [(i, f"t{i % 3}", "a") for i in range(12)])
    weak = lambda text: F.unhex(F.rpad(F.substring(F.sha2(F.lit("same"), 256), 1, 64), 64, "0"))
    r = exact_dedup.exact_dedup(docs, keep="min", digest=weak).collect()
    assert {x.doc_id: (x.keep_id, x.group_size) for x in r} == {i: (i % 3, 4) for i in range(12)}


def test_small_memtables_give_the_same_index(spark):
    docs = make(spark, [(i, f"t{i % 40}", "a") for i in range(400)]).repartition(4)
    a, b = (rows(exact_dedup.exact_dedup(docs, memtable_rows=n).toPandas()) for n in (7, 1 << 17))
    assert a == b


def test_bloom_filter_has_no_false_negatives():
    d = np.array([hashlib.sha256(str(i).encode()).digest() for i in range(500)], "S32")
    assert exact_dedup.bloom_has(exact_dedup.bloom_of(d), len(d), d).all()


# --- decontamination


def _hits(text, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, cover, found = low(text), set(), set()
    for item, t in items:
        v = low(t)
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                cover.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(cover), sorted(found)


def test_decontamination_against_brute_force(spark, odd):
    items = [(1, words(40, 5)), (2, words(12, 6)), (10, "Short one"), (11, ""), (12, None), (13, "!!"), (14, words(40, 5))]
    docs = [(i, t, "a") for i, t in enumerate([words(30, 7) + " " + words(40, 5)[10:90] + " " + words(9, 8), words(12, 6).upper(), "a SHORT, one here. short one", words(50, 9), None, "", "short\none"])]
    df = make(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 30, 60):  # in one pass, and in several
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(df, bench, block_chars=block).collect()}
        assert got == {i: _hits(t, items) for i, t, _ in docs}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(odd, none).where("contaminated").count() == 0
    assert decontaminate.decontaminate(make(spark, []), bench).count() == 0


def test_proximity_search(spark):
    df = make(spark, [(1, "alpha x beta y gamma", "a"), (2, "alpha " + "x " * 30 + "beta gamma", "a"), (3, "gamma beta alpha", "a")])
    index = decontaminate.build_index(df, 64)
    phrases = decontaminate.item_phrases([("q", "alpha beta gamma")])
    assert {r.doc_id for r in decontaminate.search(index, phrases, within=5).where(F.size("items") > 0).collect()} == {1, 3}
    assert decontaminate.search(index, phrases).where(F.size("items") > 0).count() == 0


# --- mixing


def test_mix_edge_cases(spark, odd, empty):
    r = mixing.mix_sources(odd).collect()
    assert len(r) == 12 and all(0 <= x.taken <= 2 * x.size for x in r)
    assert sum(x.target for x in {x.source: x for x in r}.values()) == pytest.approx(1.5 * sum(x.size for x in r))
    assert mixing.mix_sources(empty).count() == 0


def test_mix_hits_its_targets_and_repeats(spark):
    docs = make(spark, [(i, words(1 + i % 97, i), "abcde"[i % 5] if i % 3 else "a") for i in range(900)])
    a, b = (sorted(map(tuple, mixing.mix_sources(d).select("doc_id", "taken", "target", "source").collect())) for d in (docs, docs.repartition(3)))
    assert a == b
    taken, target = collections.Counter(), {}
    for _, t, g, s in a:
        taken[s] += t
        target[s] = g
    assert all(abs(taken[s] - target[s]) <= 48 for s in target)  # half the largest document


def test_important_documents_come_first(spark):
    docs = make(spark, [(i, words(10, i), "ab"[i % 2]) for i in range(600)]).withColumn("weight", F.when(F.col("doc_id") < 300, 20.0).otherwise(1.0))
    r = mixing.mix_sources(docs, weights=(1, 3), share=0.6, importance="weight").groupBy((F.col("doc_id") < 300).alias("w")).agg(F.sum("taken").alias("t")).collect()
    t = {x.w: x.t for x in r}
    assert t[True] > 1.5 * t[False]


def test_importances_become_rates_that_sum_to_the_target(spark):
    docs = make(spark, [(i, words(10 + i % 7, i), "abc"[i % 3]) for i in range(900)]).withColumn("weight", F.when(F.col("doc_id") < 90, 1000.0).when(F.col("doc_id") < 500, F.col("doc_id") / 50.0))
    sizes = mixing.sized(docs, "x", "weight")
    targets = mixing.source_targets(sizes.select("source", F.col("_size").alias("size")), (5, 2, 1), 1.2, 2.0)
    plan = {r.src: r for r in mixing.rates(sizes, targets, 2.0).collect()}
    total = collections.Counter()
    for r in sizes.collect():
        total[r.source] += r._size * min(2.0, plan[r.source].scale * r._imp)
    assert all(total[s] == pytest.approx(plan[s].target) for s in plan)
    r = mixing.mix_sources(docs, share=1.2, importance="weight").collect()
    taken = collections.Counter()
    for x in r:
        taken[x.source] += x.taken
        assert x.taken in (0, x.size, 2 * x.size) and (x.doc_id >= 90 or x.taken > 0)  # certain copies of what weighs most
    assert all(abs(taken[s] - plan[s].target) <= 16 for s in plan)


@pytest.mark.parametrize("share", [1e-5, 1e-3, 0.5, 0.9999])
def test_bins_stay_even_at_any_rate(spark, share):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("one").alias("text"))
    sizes = mixing.sized(docs, "x", None).withColumn("target", F.lit(200_000.0 * share)).withColumn("source_size", F.lit(200_000)).withColumn("scale", F.lit(None).cast("double"))
    q = mixing._with_odds(sizes, 2.0)
    odds = F.col("q") * share / (1 - share)
    assert q.groupBy(F.floor(odds / (1 + odds) * 1000)).count().agg(F.max("count")).first()[0] < 2 * 200


def test_sources_are_numbered_in_code_point_order(spark):
    names = [None, "", "a", "Z", "é", "zz", *(f"host{i}" for i in range(300))]
    got = mixing._numbered(spark.createDataFrame([(n,) for n in names], "source string").repartition(7)).collect()
    want = sorted(names, key=lambda x: (x is None, x or ""))
    assert [r.source for r in sorted(got, key=lambda r: r.i)] == want and sorted(r.i for r in got) == list(range(len(names)))


# --- token counts


def test_rollup_matches_direct_counts(spark, tmp_path, odd):
    import tiktoken

    ranks = token_rollup.byte_pairs()
    enc = tiktoken.Encoding("t", pat_str=token_rollup.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {(r.source, r.tokenizer): (r.docs, r.chars, r.tokens) for r in token_rollup.token_totals(odd, f"file://{tmp_path}/r").collect()}
    want = collections.defaultdict(lambda: [0, 0, 0])
    for d in odd.collect():
        t = d.text or ""
        for v, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", t))), ("byte-bpe-50k", len(enc.encode_ordinary(t)))):
            for i, x in enumerate((1, len(t), n)):
                want[d.source, v][i] += x
    assert got == {k: tuple(v) for k, v in want.items()}


def test_rollup_deletes_revises_and_commits_once(spark, tmp_path, empty):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r", {"words-1": None})
    docs = make(spark, [(i, words(10, i), "a") for i in range(20)])
    assert rollup.commit("1", inserts=docs) and not rollup.commit("1", inserts=docs)
    assert rollup.totals().first().tokens == 200
    assert rollup.commit("2", deletes=docs.where("doc_id < 5"), revisions=make(spark, [(10, "only three words", "b"), (11, None, "a")]))
    assert {r.source: (r.docs, r.tokens) for r in rollup.totals().collect()} == {"a": (14, 130), "b": (1, 3)}
    assert rollup.commit("3", deletes=docs.select("doc_id"))
    assert rollup.totals().count() == 0
    assert rollup.commit("4", inserts=empty) and rollup.totals().count() == 0
    # a run that died before its entry was in the log leaves nothing that counts
    docs.withColumn("x", F.lit(1)).write.parquet(f"file://{tmp_path}/r/data/dead/delta")
    (tmp_path / "r" / "aside").mkdir(exist_ok=True)
    (tmp_path / "r" / "aside" / "half").write_text("")
    assert rollup.totals().count() == 0


def test_rollup_that_dies_before_its_rename_can_run_again(spark, tmp_path, monkeypatch):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r", {"words-1": None})
    docs = make(spark, [(i, words(10, i), "a") for i in range(20)])

    def dies(self, entry):
        raise KeyboardInterrupt

    monkeypatch.setattr(token_rollup.TokenRollup, "_append", dies)
    with pytest.raises(KeyboardInterrupt):
        rollup.commit("1", inserts=docs)
    assert rollup.totals().count() == 0
    monkeypatch.undo()
    assert rollup.commit("1", inserts=docs) and rollup.totals().first().tokens == 200


def test_overlapping_deletes_take_a_document_away_once(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/r"
    a, b = (token_rollup.TokenRollup(spark, path, {"words-1": None}) for _ in range(2))
    docs = make(spark, [(i, words(10, i), "a") for i in range(20)])
    a.commit("1", inserts=docs)
    whole, turns = token_rollup.TokenRollup._append, iter([True])

    def overtaken(self, entry):
        if next(turns, False):  # b deletes and inserts while a is at work
            assert b.commit("3", deletes=docs.where("doc_id < 8")) and b.commit("4", inserts=docs.where("doc_id = 2"))
        return whole(self, entry)

    monkeypatch.setattr(token_rollup.TokenRollup, "_append", overtaken)
    assert a.commit("2", deletes=docs.where("doc_id BETWEEN 4 AND 9"))
    assert {(r.docs, r.tokens) for r in a.totals().collect()} == {(11, 110)}
    assert not a.commit("3", deletes=docs)


def test_compaction_changes_no_total_and_remembers_batches(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r", {"words-1": None})
    docs = make(spark, [(i, words(10, i), "ab"[i % 2]) for i in range(20)])
    assert not rollup.compact()
    for k in range(4):
        rollup.commit(str(k), inserts=docs.where(F.col("doc_id") % 4 == k))
    before = sorted(map(tuple, rollup.totals().collect()))
    assert rollup.compact() and len(rollup.log()) == 1
    rollup.commit("more", deletes=docs.where("doc_id = 3"))
    assert rollup.compact() and len(rollup.log()) == 1
    assert not rollup.commit("2", inserts=docs) and not rollup.commit("more", inserts=docs)
    rollup.commit("back", inserts=docs.where("doc_id = 3"))
    assert sorted(map(tuple, rollup.totals().collect())) == before


# --- substring dedup


def test_wavelet_ranks():
    x = np.random.default_rng(1).integers(0, 37, 500)
    w = WaveletMatrix(x, 37)
    at, sym = np.arange(0, 501, 7), np.arange(0, 501, 7) % 37
    assert w.rank(sym, at).tolist() == [int((x[:a] == s).sum()) for a, s in zip(at, sym, strict=True)]


def test_backward_search_counts():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (30, 25, 40)])
    index = FMIndex(text, 6)
    s = text.tolist()
    length, lo, hi = index.matching(text, np.array([i for i in range(6, len(s)) if 0 not in s[i - 6 : i]]), stop=1)
    assert (length == 6).all()
    ends = [i for i in range(6, len(s)) if 0 not in s[i - 6 : i]]
    assert (hi - lo).tolist() == [sum(s[j : j + 6] == s[e - 6 : e] for j in range(len(s) - 5)) for e in ends]


def _kept(docs, n=13):
    first = {}
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (i, t, _) in enumerate(docs)}
    ids = [i if i is not None else 1 << 62 for i, _, _ in docs]
    for k, w in split.items():
        for j in range(len(w) - n + 1):
            g = tuple(w[j : j + n])
            first[g] = min(first.get(g, 1 << 63), ids[k])
    out = []
    for k, w in split.items():
        gone = set()
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < ids[k]:
                gone.update(range(j, j + n))
        out.append((docs[k][0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_substrings_against_brute_force(spark, odd):
    shared, few = words(60, 3), words(13, 4)
    docs = [(i, f"{words(20 + i, 100 + i)} {shared if i % 3 == 0 else few if i % 3 == 1 else ''} {words(15, 200 + i)}", "a") for i in range(30)]
    docs += [(90, "q " * 60, "a"), (91, "q " * 40, "a"), (50, few[:-3], "a"), (None, shared, "a"), (92, None, "a"), (93, "", "a"), (3, docs[6][1], "a"), (92, shared, "b")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(make(spark, docs).repartition(5), n_shards=7).collect())
    want = _kept(docs)
    assert got == sorted((i if i is not None else -1, a, b, t) for i, a, b, t in want)
    assert substring_dedup.substring_dedup(odd).count() == 12
    assert substring_dedup.substring_dedup(make(spark, [])).count() == 0


# --- personal data


def _base(x):
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((*m.span(), 2))
    return out + [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_patterns_against_re(spark, odd):
    rng = random.Random(3)
    pool = ["a.b@c.de", "x@y", "é", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "1..2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "++4912345678901", "word", "a@b@c.d.", "(012) 345-6789", "\n", "12345678901234567890", "0 0 0 0 0 0 0 0 0 0 0 0 0 0"]
    docs = [(i, rng.choice(["", " ", "ü"]).join(rng.choice(pool) + rng.choice([" ", "", ",", "  "]) for _ in range(12)), "a") for i in range(200)]
    got = {r.doc_id: r for r in pii.find_pii(make(spark, docs)).collect()}
    for i, t, _ in docs:
        b = _base(t)
        assert got[i].base_sha256 == hashlib.sha256(pii._digest(b).encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == j for _, _, k in b) for j in range(4)]
        assert set(filter(None, pii._digest(b).split(","))) <= set(got[i].spans.split(","))
    assert pii.find_pii(odd).count() == 12 and pii.find_pii(make(spark, [])).count() == 0


def test_field_finds_other_forms_and_leaves_prose_alone(spark):
    docs = make(spark, [(1, "call me at (555) 123-4567 now", "a"), (2, "john(at)mail.com please", "a"), (3, "in 2024 there were 15 of 300 at 10:20 on 2024-05-06", "a"), (4, words(300, 4), "a")])
    got = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert got == {1: "phone:11:25", 2: "email:0:16", 3: "", 4: ""}
    more = ["555.123.4567 is my phone", "bob[at]corp.co.uk", "fe80::1", "Tel:030-123456", "mail jane.doe (at) example.org now", "flight 020 7946 0958 seats", 'token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" est']
    got = {r.doc_id: r.spans for r in pii.find_pii(make(spark, list(zip(range(7), more, "aaaaaaa", strict=True)))).collect()}
    assert got == {0: "phone:0:12", 1: "email:0:17", 2: "ip:0:7", 3: "phone:4:14", 4: "email:5:30", 5: "", 6: "secret:9:49"}


def _spans_of(rows_, field):
    """(found and right, found, there) by whole spans."""
    texts = [" ".join(w) for w, _ in rows_]
    found = {(r, a, b, k) for r, a, b, k in pii.field_spans(Texts.of(pa.array(texts)), field)}
    want = set()
    for i, (w, labels) in enumerate(rows_):
        at = np.cumsum([0, *(len(x) + 1 for x in w)])
        for j, label in enumerate(labels):
            if label % 2 == 1:
                e = next((x for x in range(j + 1, len(w)) if labels[x] != label + 1), len(w))
                want.add((i, *pii._trimmed(texts[i].encode(), int(at[j]), int(at[e]) - 1, pii.FIELD_KINDS[label // 2]), label // 2))
    return len(found & want), len(found), len(want)


@pytest.fixture(scope="module")
def field():
    return pii.train_field(pii.labelled_rows())


def test_field_on_lines_it_has_not_seen(field):
    seen = {" ".join(w) for w, _ in pii.labelled_rows()}
    rows_ = [x for x in pii.labelled_rows(seed=9, held_out=True) if " ".join(x[0]) not in seen]
    right, found, there = _spans_of(rows_, field)
    assert there > 100 and right / found >= 0.95 and right / there >= 0.95


def test_field_adds_spans_to_documents(spark):
    got = pii.find_pii(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"))
    r = got.agg(F.sum("n_added").alias("added"), F.sum("n_spans").alias("all"), F.sum(F.expr("n_email + n_ip + n_card + n_phone")).alias("base")).first()
    assert r.added > 0 and r["all"] == r.base + r.added


def test_time_follows_the_length_of_a_text(field):
    import time

    def seconds(text):
        rows_ = Texts.of(pa.array([text]))
        t = time.perf_counter()
        pii.base_spans(rows_)
        pii.field_spans(rows_, field)
        return time.perf_counter() - t

    for unit in ("a.", "a@", "12 34 ", "+1 ", "1.", "(at) "):
        seconds(unit * 1000)
        short, long = seconds(unit * (100_000 // len(unit))), seconds(unit * (1_000_000 // len(unit)))
        assert long < 40 * short + 2, unit


def test_words_certain_to_be_outside_do_not_change_the_path():
    rng = np.random.default_rng(3)
    k = len(pii.LABELS)
    for n in (1, 2, 7, 60, 333):
        for _ in range(20):
            emit, step = rng.standard_normal((n, k)) * 3, np.where(pii._ALLOWED < 0, -1e4, rng.standard_normal((k + 1, k)))
            emit[:, 0] += rng.choice([0, 14], n)
            new = rng.random(n) < 0.1
            new[0] = True
            whole = pii.viterbi(emit, np.append(np.flatnonzero(new), n), step)
            assert (whole == pii.decode(emit, new, step)).all()
            assert (pii.viterbi(emit, np.array([0, n]), step) == pii.viterbi_blocks(emit, step, step[k], np.zeros(k))).all()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    emit, step = rng.standard_normal((7, 3)), rng.standard_normal((4, 3))
    first = np.array([0, 3, 3, 7])
    got = pii.viterbi(emit, first, step)
    import itertools

    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            score = lambda p, a=a: step[3, p[0]] + emit[a, p[0]] + sum(step[p[i - 1], p[i]] + emit[a + i, p[i]] for i in range(1, len(p)))
            assert tuple(got[a:b]) == max(itertools.product(range(3), repeat=b - a), key=score)


# --- line dedup


def test_lines_edge_cases_and_both_ways(spark, odd, monkeypatch):
    line = "this line is everywhere"
    docs = [(i, f"own words of document {i}\n{line}\n\nmore text here {i}\n{line}", f"s{i % 10}") for i in range(30)] + [(99, "two words\nshort", None), (None, line, "s1"), (98, None, "s2")]
    want = {i: (t if i == 0 else "\n".join(x for x in t.split("\n") if x != line)) if t else t for i, t, _ in docs}
    for limit in (line_dedup.BROADCAST_LINES, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        df = line_dedup.line_dedup(make(spark, docs))
        assert {r.doc_id: r.text for r in df.collect()} == want
        assert df.where("doc_id = 5").first().n_removed == 2 and df.where("doc_id = 5").first().n_lines == 5
        assert set(make(spark, docs).columns) == set(df.columns) - {"n_removed"}
    assert line_dedup.line_dedup(odd).count() == 12 and line_dedup.line_dedup(make(spark, [])).count() == 0


def _without_boilerplate(docs, sites=8, short=16):
    spread, first = collections.defaultdict(set), {}
    for i, t, s in docs:
        for line in (t or "").split("\n"):
            if line.strip(" "):
                spread[line].add(s)
                first[line] = min(first.get(line, 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for i, t, _ in docs:
        own = (1 << 63) - 1 if i is None else i
        gone = lambda x: x.strip(" ") and len(spread[x]) >= (sites if len([w for w in x.split(" ") if w]) >= 3 else short) and first[x] != own  # noqa: B023, E731
        out.append((i, t if t is None else "\n".join(x for x in t.split("\n") if not gone(x))))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_LINES, 0])
def test_rows_that_share_an_id_lose_their_own_lines(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
    line = "this line is everywhere today"
    docs = [(i, f"{line}\nThe end.\nOften here\nown {i} words", f"s{i % 20}" if i % 2 else f"s{i % 12}") for i in range(60)]
    docs += [(5, f"{line}\nown words", "s1"), (5, "precious unique line here now\nmore", "s2"), (None, f"{line}\nfirst", "s3"), (None, "another unique line of words\nThe end.", "s4"), (None, None, "s5"), (5, f"{line}\nown words", "s1"), (7, f"  \n{line}\n\n", None)]
    docs += [(100 + i, "Rare", f"s{i}") for i in range(15)]
    df = make(spark, docs).withColumn("starts", F.lit(3)).withColumn("row_key", F.lit("x"))
    got = line_dedup.line_dedup(df)
    assert got.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == _without_boilerplate(docs)


def test_spread_is_close_at_any_size(spark):
    docs = [(i, f"common line of many sites\nrare line number {i % 50}", f"site{i}") for i in range(3000)]
    got = {round(r.sites) for r in line_dedup.spread(line_dedup.sketch_lines(make(spark, docs), 3, 4), 100).collect()}
    assert len(got) == 1 and abs(got.pop() - 3000) < 300


# --- toxicity


def _labelled(spark, n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        docs.append((i, words(40, i) + (" you stupid idiot" if toxic and i % 8 else " blorfex grandu" if toxic else ""), "a"))
        labels.append((i, 1, int(toxic) if rng.random() > 0.01 else 1 - int(toxic)))
    return make(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found(spark):
    docs, labels = _labelled(spark)
    r = toxicity.toxicity(docs, labels).collect()
    held = [x for x in r if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in r)
    assert sum((x.predicted == 1) == (x.doc_id % 4 == 0) for x in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 for x in r)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = _labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({x.doc_id: x.score for x in toxicity.toxicity(docs, y).collect()} for y in (labels, flipped))
    assert a == b


def test_toxicity_edge_cases(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bad = spark.createDataFrame([(1, 0, None), (None, 0, 1), (4, 0, 7), (3, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, bad):
        assert toxicity.toxicity(odd, labels).where("score IS NOT NULL").count() == 12
    assert toxicity.toxicity(empty, bad).count() == 0


def test_isotonic_rises_and_trees_learn():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 4))
    y = (x[:, 1] + 0.3 * rng.standard_normal(600) > 0.5).astype(float)
    raw = toxicity.fit_trees(x, y).raw(x)
    assert ((raw > 0) == (y == 1)).mean() > 0.9
    k, p = toxicity.fit_isotonic(raw, y)
    assert (np.diff(p) >= 0).all() and (np.diff(k) > 0).all()


# --- near dedup


def test_bag_min_hash_is_unbiased():
    a = Texts.of(pa.array(["x " * 30 + words(80, 1), "x " * 12 + words(80, 1) + " " + words(30, 2)]))
    row, sh, count = near_dedup.bags(a, 1)
    bags = [dict(zip(sh[row == i].tolist(), count[row == i].tolist(), strict=True)) for i in (0, 1)]
    keys = set(bags[0]) | set(bags[1])
    true = sum(min(b.get(k, 0) for b in bags) for k in keys) / sum(max(b.get(k, 0) for b in bags) for k in keys)
    sig = near_dedup.bag_min_hash(row, sh, count, 2, slots=8192)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def _classes(docs):
    bag, text = {}, {}
    for k, (_, t, _) in enumerate(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bag[k] = collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))
        text[k] = t or ""
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = sum((bag[a] & bag[b]).values())
            if text[a] == text[b] or (both and both >= 0.8 * (sum(bag[a].values()) + sum(bag[b].values()) - both)):
                parent[find(a)] = find(b)
    group = collections.defaultdict(list)
    for k in range(len(docs)):
        group[find(k)].append(docs[k][0])
    return {k: min((x for x in group[find(k)] if x is not None), default=None) for k in range(len(docs))}


def _edited(text, n, seed):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def test_near_classes_against_brute_force(spark, odd, monkeypatch):
    base = [words(120, 900 + i) for i in range(6)]
    docs = [(i, _edited(base[i % 6], i % 5, i), "a") for i in range(150)] + [(500 + i, words(60, i), "a") for i in range(30)] + [(800, None, "a"), (801, "", "b"), (802, "a b", "b"), (803, "a  b", "c"), (None, base[0], "a")]
    want = _classes(docs)
    for small, dense in ((8, 8), (2, 0), (8, 1 << 40)):  # leaders and pairs; dense buckets; neither
        monkeypatch.setattr(near_dedup, "SMALL", small)
        monkeypatch.setattr(near_dedup, "DENSE", dense)
        got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(make(spark, docs)).collect()}
        assert got == {docs[k][0]: v for k, v in want.items()}
    monkeypatch.undo()
    assert near_dedup.near_dedup(odd).count() == 12 and near_dedup.near_dedup(make(spark, [])).count() == 0


def test_one_row_of_each_class_is_kept(spark):
    base = words(80, 4)
    docs = [(1, base, "a"), (1, base + " tail", "b"), (1, base, "c"), (2, base, "a"), (3, words(50, 5), "a"), (3, words(50, 5), "a"), (None, words(40, 6), "a"), (None, words(40, 6), "b"), (None, base, "a"), (None, None, "a"), (9, "", "a")]
    r = near_dedup.near_dedup(make(spark, docs)).collect()
    kept = collections.Counter((x.class_id, x.class_size) for x in r if x.kept)
    assert kept == {(1, 5): 1, (3, 2): 1, (None, 2): 1, (9, 2): 1} and len(r) == len(docs)
    assert all(x.doc_id == x.class_id for x in r if x.kept)


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.label for r in near_dedup.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        near_dedup.components(chain, limit=1)


def test_smaller_buckets_keep_all_links(spark, monkeypatch):
    base = words(150, 77)
    docs = [(i, _edited(base, i % 12, i), "a") for i in range(120)]
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(make(spark, docs)).collect()}
    assert got == {docs[k][0]: v for k, v in _classes(docs).items()}


def _bucket(spark, n, seed):
    """Members of one bucket in random order, their signatures, and pairs of equal signatures far apart."""
    rng = np.random.default_rng(seed)
    sig = rng.integers(0, 256, (n, near_dedup.SLOTS), np.uint8)
    sig[n // 2 :] = sig[: n // 2]
    order = rng.permutation(n).tolist()
    members = spark.createDataFrame([(7, i, i) for i in order], "bucket long, id long, label long").coalesce(1)
    nodes = spark.createDataFrame([(i, bytes(sig[i])) for i in range(n)], "id long, sig binary")
    return members, nodes, {(i, i + n // 2) for i in range(n // 2)}


@pytest.mark.parametrize("block", [None, 512])
def test_blocks_of_a_large_bucket_lose_no_pair(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(near_dedup, "BLOCK", block)
    members, nodes, want = _bucket(spark, 5_000, 3)
    got = near_dedup.close_in_blocks(members, nodes, 0.8).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_groups_hold_every_pair_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    monkeypatch.setattr(near_dedup, "DENSE", 1_000)
    sig = bytes(near_dedup.SLOTS)
    labels = [(b, i, 1 if i < 150 else 2 if i < 200 else i) for b, n in ((7, 300), (8, 40), (9, 65)) for i in range(n)]
    members = spark.createDataFrame([(*x, {7: 300, 8: 40, 9: 65}[x[0]]) for x in labels], "bucket long, id long, label long, n long")
    nodes = spark.createDataFrame([(i, sig) for i in range(300)], "id long, sig binary")
    groups = near_dedup.in_groups(members)
    assert groups.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 120
    got = {(r.a, r.b) for r in near_dedup.close_in_blocks(groups, nodes, 0.8).collect()}
    label = {i: x for b, i, x in labels if b == 7}
    assert got == {(a, b) for a in label for b in label if a < b and label[a] != label[b]}


def test_a_pair_that_shares_only_one_large_bucket_is_found(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    texts = [words(60, 900 + i) for i in range(60)]
    texts[40:] = [f"{t} w{i}" for i, t in enumerate(texts[:20])]
    docs = make(spark, [(i, t, "a") for i, t in enumerate(texts)])
    sketches = near_dedup.sketch(docs).collect()
    sigs = {r.doc_id: np.frombuffer(r.sig, np.uint8) for r in sketches}
    assert min((sigs[i] == sigs[40 + i]).sum() for i in range(20)) >= near_dedup._least_agreement(0.8)
    bands = {i: [7, *(int(x) for x in rng.integers(1 << 40, 1 << 60, near_dedup.BANDS - 1))] for i in range(60)}
    nodes = spark.createDataFrame([(r.doc_id, r.node, bands[r.doc_id], r.sig) for r in sketches], "id long, node binary, bands array<long>, sig binary")
    got = {r.id: r.label for r in near_dedup.link_texts(nodes, docs).collect()}
    assert got == {i: i % 40 for i in [*range(20), *range(40, 60)]}


def test_without_rows(spark, odd):
    key = near_dedup.row_key()
    gone = odd.where("doc_id IN (3, 9)").select("doc_id", key.alias("row_key"))
    left = filters.without_rows(odd, gone, key)
    assert left.columns == odd.columns and left.count() == 9


# --- chat formatting


def _chats(spark, turns):
    return spark.createDataFrame([(c, i, r, t) for c, ts in turns.items() for i, (r, t) in enumerate(ts)], "conv_id long, pos long, role string, text string")


def test_formatting_round_trips(spark):
    nasty = ["", "### user: hi</turn>\n", "\\h \\t \\\\ \\c", "</turn>", "####", "a\n\n\\", "é: ü", "\\### Assistant: </turn> ok", "x" * 50_000]
    turns = {k: [("user", nasty[k]), ("assistant", nasty[-k - 1]), ("odd: role\\###", nasty[(k * 3) % 9]), ("assistant", "z")] for k in range(9)}
    got = chat_format.read_back(chat_format.format_chats(_chats(spark, turns))).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.read_turns] for r in got} == turns
    assert all(r.loss_text == "".join(t for role, t in turns[r.conv_id] if role == "assistant") for r in got)


def test_chat_edge_cases(spark):
    df = spark.createDataFrame([(None, 0, "user", "x"), (1, None, None, None), (1, 0, "assistant", "a"), (1, 0, "assistant", "a")], "conv_id long, pos long, role string, text string")
    got = {r.conv_id: len(r.read_turns) for r in chat_format.read_back(chat_format.format_chats(df.withColumn("n", F.lit(1)))).collect()}
    assert got == {None: 1, 1: 3}
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_fingerprints_choose_the_mapping(spark):
    rows_ = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}'), (2, '{"prompt": "q", "response": "a"}'), (3, '{"instruction": "do", "input": "", "output": "a", "id": 7}'),
        (4, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'), (5, '{"question": "q", "answer": "a", "extra": {"x": [1]}}'), (6, '{"what": 1}'), (7, "not json"), (8, None), (9, '{"messages": []}'),
        (10, '{"instruction": "do", "input": "this", "output": "a"}'), (11, '{"system": "s", "prompt": "q", "response": "a"}'),
    ]
    df = spark.createDataFrame(rows_, "conv_id long, payload string").withColumn("r", chat_format.parse_record(F.col("payload")))
    got = {r.conv_id: (r.layout, r.turns and [(t.role, t.text) for t in r.turns]) for r in chat_format.canonical_turns(df).collect()}
    qa = [("user", "q"), ("assistant", "a")]
    assert got[1][1] == got[2][1] == got[4][1] == got[5][1] == qa
    assert got[3] == ("instruction with input", [("user", "do"), ("assistant", "a")])
    assert got[10][1][0] == ("user", "do\n\nthis") and got[11][1][0] == ("system", "s") and got[9][1] == []
    assert got[6] == got[7] == got[8] == (None, None)
    made = {r.conv_id: (r.formatted, r.loss_spans) for r in chat_format.format_records(df).collect()}
    assert len(made) == 11 and made[6] == made[7] == made[8] == (None, []) and made[9] == ("", [])
    assert chat_format.format_records(df.limit(0)).count() == 0


def test_fingerprints_are_of_fields_not_values(spark):
    rows_ = [
        (1, '{"prompt": "q", "response": null}'), (2, '{"messages": [{"role": "user", "content": null}, {"role": null, "content": null}]}'), (3, '{"messages": [{"role": "user", "content": "q"}, {"from": "gpt", "value": "a"}]}'),
        (4, '{"prompt": "q", "response": "a", "input": "x"}'), (5, '{"messages": null}'), (6, '[1]'), (7, '{"prompt": null, "response": null, "system": null}'), (8, '{"messages": [null, {"role": "user", "content": "q"}]}'), (9, '{"messages": [{"who": "x"}]}'),
    ]
    df = spark.createDataFrame(rows_, "conv_id long, payload string").withColumn("r", chat_format.parse_record(F.col("payload"))).withColumn("layout", F.lit("clash")).withColumn("turns", F.lit(0))
    got = {r.conv_id: r.turns and [(t.role, t.text) for t in r.turns] for r in chat_format.canonical_turns(df).collect()}
    assert got[1] == [("user", "q"), ("assistant", "")] and got[2] == [("user", ""), ("", "")] and got[3] == [("user", "q"), ("assistant", "a")]
    assert got[4] == [("user", "q"), ("assistant", "a")] and got[5] == [] and got[6] is None and len(got[7]) == 3
    assert got[8] == [("user", "q")] and got[9] is None
    assert chat_format.format_records(df).count() == 9
