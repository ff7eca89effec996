import random

import numpy as np
import pytest

from flowloom.llm import mixing as M
from flowloom.llm import near_dedup as N

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _kept_id string, bucket string"


def _word_sets(text, words=5):
    w = text.lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def _classes(docs):
    """Brute force: components of all pairs at 0.8 or more."""
    sets = {i: _word_sets(t or "") for i, t in docs}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, t in docs:
        for j, u in docs:
            if i < j:
                a, b = sets[i], sets[j]
                if (t or "") == (u or "") or (a and b and len(a & b) >= 0.8 * len(a | b)):
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    return {i: find(i) for i in sets}


def _families(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = []
    for family in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 400))]
        docs.append(" ".join(text))
        for _ in range(rng.randrange(0, 8)):
            copy = list(text)
            for _ in range(max(1, int(len(copy) * rng.choice([0.005, 0.01, 0.02, 0.04])))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [docs[0], docs[0].upper(), "", "", None, "one two", "One Two", "one two three", " ".join(vocabulary * 4)]
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes_against_brute_force(spark, seed):
    docs = _families(seed)
    frame = spark.createDataFrame([(i, t, None, "s", None, "x", None) for i, t in docs], SCHEMA).repartition(3)
    rows = N.near_classes(frame).collect()
    want = _classes(docs)
    assert {r.doc_id: r.class_id for r in rows} == want
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in rows)
    kept = N.drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_classes_with_nulls_and_repeats(spark):
    text = "a b c d e f g h"
    frame = spark.createDataFrame([(None, text), (5, text), (5, text), (None, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in N.near_classes(frame).collect()), key=str)
    assert got == sorted([(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (None, None, 1, True)], key=str)
    assert sorted(str(r.doc_id) for r in N.drop_near_copies(frame).collect()) == ["5", "None"]
    assert N.near_classes(frame.limit(0)).count() == 0


def test_drop_near_copies_keeps_every_class_of_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, b), (None, b + " tail"), (5, c), (5, "other words"), (7, "other words"), (4, "other words")]
    kept = N.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text.split()[0]) for r in kept) == [
        ("4", "other"), ("5", "c0"), ("None", "a0"), ("None", "b0")]


def test_a_hot_group_has_few_pairs(spark, monkeypatch):
    """A family that fills most of the table is verified against a pivot, not in pairs."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(copy)))
    seen = []
    verified = N.verified

    def counting(pairs, *args):
        seen.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(N, "verified", counting)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert {r.class_id for r in N.near_classes(frame).collect()} == {0}
    assert sum(seen) < 300 * 24


def _far_family(n, seed=5):
    """Copies of one text, each edited elsewhere so far that it is alike to nothing."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        copy = list(base)
        for j in rng.sample(range(200), 14):
            copy[j] = f"x{i}_{j}"
        out.append(" ".join(copy))
    return " ".join(base), out


@pytest.mark.parametrize("n", [150, 600])
def test_a_family_of_distant_copies_makes_few_pairs(spark, monkeypatch, n):
    base, far = _far_family(n)
    rng = random.Random(9)
    near = []
    for i in range(n):
        copy = base.split()
        copy[rng.randrange(200)] = f"y{i}"
        near.append(" ".join(copy))
    docs = list(enumerate([base, *near, *far, far[0] + " tail", far[1] + " tail"]))
    made = []
    found = N.pairs_by_differences

    def counting(*args):
        out = found(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(N, "pairs_by_differences", counting)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    # More bands of fewer rows: distant texts share buckets.
    got = {r.doc_id: r.class_id for r in N.near_classes(frame, bands=40, band_rows=2).collect()}
    assert all(got[i] == 0 for i in range(n + 1))
    assert got[2 * n + 1] == n + 1 and got[2 * n + 2] == n + 2
    assert sum(v != k for k, v in got.items()) == n + 2
    assert sum(made) < n


def test_texts_alike_to_each_other_and_not_to_their_pivot(spark):
    """Sub-families around a base: all links inside a bucket are found, whatever its pivot is."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for f in range(25):
        middle = list(base)
        for j in rng.sample(range(120), rng.randrange(3, 9)):
            middle[j] = f"f{f}_{j}"
        for i in range(4):
            copy = list(middle)
            for j in rng.sample(range(120), rng.randrange(0, 3)):
                copy[j] = f"z{f}_{i}_{j}"
            texts.append(" ".join(copy[:rng.randrange(105, 121)]))
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in N.near_classes(frame, bands=60, band_rows=1).collect()}
    assert got == _classes(docs) and len(set(got.values())) > 3


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    a = {int(e): float(w) for e, w in zip(rng.integers(0, 2**62, 400), rng.integers(1, 6, 400))}
    b = {e: w * float(rng.integers(1, 3)) for e, w in list(a.items())[100:]}
    b |= {int(e): 1.0 for e in rng.integers(0, 2**62, 80)}
    def probability_jaccard(x, y):
        total = 0.0
        for d in set(x) & set(y):
            total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in set(x) | set(y))
        return total

    def signed(x):
        return N.prob_minhash(np.array(list(x), np.uint64), np.array(list(x.values())), 4096)

    got = (signed(a) == signed(b)).mean()
    assert abs(got - probability_jaccard(a, b)) < 0.03
    few = N.prob_minhash(np.array([7, 9], np.uint64), np.array([3.0, 1.0]), 4096)
    assert abs((few == 7).mean() - 0.75) < 0.03


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(bytes([i // 256, i % 256]), bytes([(i + 1) // 256, (i + 1) % 256]))
                                   for i in range(300)], "a binary, b binary")
    rows = N.components(chain).collect()
    assert len(rows) == 301 and {bytes(r.component) for r in rows} == {b"\0\0"}


def _documents(spark, n=3000):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["mountain", "rivers", "a", "banks", "letters"]) for _ in range(rng.randrange(1, 60))),
             rng.choice(["en"] * 6 + ["de", "fr", None]), rng.choice(["s0"] * 5 + ["s1", "s2", "s3", None]))
            for i in range(n)]
    rows += [(None, None, None, None), (1, rows[1][1], rows[1][2], rows[1][3])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3), rows


def test_raking_against_numpy(spark):
    docs, rows = _documents(spark)
    plan = M.sampling_plan(docs).collect()
    assert len(plan) == len(rows)
    names = [sorted({getattr(r, c) for r in plan}) for c in ("source", "lang", "topic")]
    cells = np.zeros([len(x) for x in names])
    place = {id(r): tuple(x.index(getattr(r, c)) for x, c in zip(names, ("source", "lang", "topic"))) for r in plan}
    for r in plan:
        cells[place[id(r)]] += r.tokens
    cells /= cells.sum()
    targets = []
    for axis in range(3):
        share = cells.sum(axis=tuple(a for a in range(3) if a != axis)) ** M.TEMPER
        targets.append(share / share.sum())
    raked = cells.copy()
    for _ in range(200):
        for axis in range(3):
            got = raked.sum(axis=tuple(a for a in range(3) if a != axis))
            raked *= (targets[axis] / got).reshape([-1 if a == axis else 1 for a in range(3)])
    weights = np.divide(raked, cells, out=np.zeros_like(raked), where=cells > 0)
    for r in plan:
        assert r.weight == pytest.approx(weights[place[id(r)]], rel=1e-3)
        assert 0 < r.probability <= 1 + 1e-9
        assert r.topic == M.topic_of(next(t or "" for i, t, _, _ in rows if i == r.doc_id), M.TOPICS)


def test_sample_follows_the_probabilities(spark):
    docs, _ = _documents(spark)
    plan = M.sampling_plan(docs).collect()
    expected = sum(r.probability for r in plan)
    assert abs(sum(r.kept for r in plan) - expected) < 4 * expected ** 0.5
    kept = M.mix(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in plan if r.kept}
    assert M.mix(docs.limit(0)).count() == 0


def _odd_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["mountain", "rivers", "banks"]) for _ in range(rng.randrange(20, 60))),
             rng.choice(["en"] * 4 + ["de"]), rng.choice(["s0", "s0", "s1"])) for i in range(4000)]
    rows += [(9000, "word", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)


def test_a_tiny_cell_does_not_set_the_rate(spark):
    plan = M.sampling_plan(_odd_rows(spark)).collect()
    total = sum(r.tokens for r in plan)
    assert sum(r.probability * r.tokens for r in plan) == pytest.approx(0.5 * total, rel=1e-3)
    assert next(r.probability for r in plan if r.doc_id == 9000) == 1
    # Where supply suffices, shares follow the targets.
    got = {s: sum(r.probability * r.tokens for r in plan if r.source == s) for s in ("s0", "s1")}
    had = {s: sum(r.tokens for r in plan if r.source == s) for s in ("s0", "s1")}
    assert got["s0"] / got["s1"] == pytest.approx((had["s0"] / had["s1"]) ** M.TEMPER, rel=1e-3)


def test_languages_of_any_number_meet_their_targets(spark):
    rng = random.Random(9)
    rows = [(i, "word " * rng.randrange(1, 40), f"l{int(100 * rng.random() ** 2):02d}", "s0") for i in range(6000)]
    plan = M.sampling_plan(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    had, got = {}, {}
    for r in plan:
        had[r.lang] = had.get(r.lang, 0) + r.tokens
        got[r.lang] = got.get(r.lang, 0) + r.tokens * r.weight
    total = sum(had.values())
    norm = sum((n / total) ** M.TEMPER for n in had.values())
    assert len(had) == 100
    for lang, n in had.items():
        assert got[lang] / total == pytest.approx((n / total) ** M.TEMPER / norm, rel=1e-3)


def test_cells_as_a_table_give_the_same_fit(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "en", 0, 900, 1.0), ("a", "de", 1, 300, 1.0), ("b", "en", 1, 200, 1.0), ("", "", 0, 1, 1.0)],
                                  "source string, lang string, topic int, tokens bigint, w double").coalesce(1)
    for rate in (None, 0.5):
        monkeypatch.setattr(M, "LOCAL_CELLS", 50_000)
        want = {r.source + r.lang: r.w for r in M.rake(cells, rounds=3, rate=rate)[0].collect()}
        monkeypatch.setattr(M, "LOCAL_CELLS", 0)
        got = {r.source + r.lang: r.w for r in M.rake(cells, rounds=3, rate=rate)[0].collect()}
        assert got == pytest.approx(want)


def _mixed_rows(n, doc_id, text):
    return [(doc_id, text(i), ["en", "fr"][i % 2], ["a", "b", "c"][i % 3], 0, "x", "y") for i in range(n)]


@pytest.mark.parametrize("text", [lambda i: f"word{i} some more words", lambda i: "the same words"])
@pytest.mark.parametrize("seed", [7, 8])
def test_rows_without_an_id_are_drawn_one_by_one(spark, text, seed):
    docs = spark.createDataFrame(_mixed_rows(2000, None, text) + _mixed_rows(2000, 5, text), SCHEMA).repartition(6)
    kept = M.mix(docs, seed=seed)
    assert kept.columns == docs.columns
    by_id = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert all(850 < by_id[i] < 1150 for i in (None, 5))
    plan = M.sampling_plan(docs, seed=seed)
    assert plan.filter("kept").count() == sum(by_id.values())


def test_a_callers_shares_are_met(spark):
    docs = spark.createDataFrame(_mixed_rows(6000, 1, lambda i: f"word{i % 50} some more words {i}"), SCHEMA).repartition(4)
    shares = {"source": {"a": 0.6}, "lang": {"en": 0.3, "fr": 0.7}}
    plan = M.sampling_plan(docs, rate=0.2, shares=shares).collect()
    assert {r.raking_error for r in plan}.pop() < 1e-5
    total = sum(r.probability * r.tokens for r in plan)
    for name, value, share in (("source", "a", 0.6), ("lang", "en", 0.3), ("source", "b", 0.2)):
        assert abs(sum(r.probability * r.tokens for r in plan if r[name] == value) / total - share) < 0.01
    # More of a source than there is: it is kept whole, and what is missed is told.
    plan = M.sampling_plan(docs, rate=0.8, shares={"source": {"a": 0.9}}).collect()
    assert all(r.probability > 0.999 for r in plan if r.source == "a")
