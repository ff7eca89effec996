import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowloom.llm import lm_scoring as L
from flowloom.llm import toxicity as X


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", _lower(text)), "\n"]


ROWS = [(i, " ".join(random.Random(i % 40).choices(["The", "cat", "Sat", "É", "é", "zz"], k=1 + i % 50)))
        for i in range(200)] + [(None, None), (950, "The cat\x0b x"), (950, "The cat\x0b x"), (900, ""),
                                (901, "unseen words only here " * 500)]


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_base_scores_and_counts(spark, block_bytes):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id bigint, text string, score string")
    rows = L.score_documents(docs.repartition(3), block_bytes=block_bytes).collect()
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in ROWS}
    counts = Counter(w for i, t in ROWS if not held[i] for w in _tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    assert len(rows) == len(ROWS)
    texts = dict(ROWS)
    for r in rows:
        words = _tokens(texts[r.doc_id])
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), total)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score <= 0 and math.isfinite(r.score)
    assert L.score_documents(docs.limit(0)).count() == 0


def test_scores_follow_witten_bell(spark):
    """With small counts the filter is exact but for its levels' rounding."""
    rows = [(i, "a b c d" if i % 3 else f"x{i} y{i}") for i in range(60)]
    got = {r.doc_id: r for r in L.score_documents(
        spark.createDataFrame(rows, "doc_id bigint, text string"), base=1.05).collect()}
    train = [_tokens(t) for i, t in rows if not L.is_held_out(i)]
    unigrams = Counter(w for t in train for w in t)
    bigrams = Counter(p for t in train for p in zip(["\n", *t], t))
    followers = Counter(h for h, _ in bigrams)
    total, distinct = sum(unigrams.values()), len(unigrams)
    for i, t in rows:
        want = 0.0
        for h, w in zip(["\n", *_tokens(t)], _tokens(t)):
            p = (unigrams[w] + 0.5) / (total + 0.5 * (distinct + 1))
            if unigrams[h]:
                p = (bigrams[h, w] + followers[h] * p) / (unigrams[h] + followers[h])
            want += math.log10(p)
        assert got[i].score == pytest.approx(want, rel=0.02, abs=0.05)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_log_bloom_levels():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 5000).astype(np.uint64)
    levels = rng.integers(1, 9, 5000)
    bits = np.zeros(12 * int(levels.sum()), bool)
    for level in range(1, 9):
        L.LogBloom.fill(bits, items[levels >= level], level)
    bloom = L.LogBloom(np.packbits(bits, bitorder="little"), np.zeros(1, np.uint64),
                       np.array([len(bits)], np.uint64), 0, 1.5)
    got = bloom.level(items, np.zeros(len(items), np.int64))
    assert (got >= levels).all() and (got == levels).mean() > 0.97
    other = bloom.level(rng.integers(0, 2**63, 5000).astype(np.uint64), np.zeros(5000, np.int64))
    assert (other > 0).mean() < 0.03


def test_scores_depend_neither_on_slices_nor_on_partitions(spark, monkeypatch):
    """Small shards, so that words with many tokens are cut by the following word."""
    monkeypatch.setattr(L, "SHARD_TOKENS", 1 << 9)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(200)], weights=[200 // (j + 1) for j in range(200)], k=200)))
            for i in range(100)] + [(None, None), (3, "w1 w2"), (3, "w1 w2"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def scores(max_bits, partitions):
        got = L.score_documents(docs.repartition(partitions), max_bits=max_bits, block_bytes=1 << 14).collect()
        return sorted((-1 if r.doc_id is None else r.doc_id, r.base_score, r.score) for r in got)

    want = scores(1 << 29, 1)
    assert len(want) == len(rows)
    for max_bits, partitions in ((1 << 12, 3), (1 << 15, 1), (1 << 29, 4), (1 << 29, 16)):
        got = scores(max_bits, partitions)
        assert [i for i, _, _ in got] == [i for i, _, _ in want]
        assert np.array([x[1:] for x in got]) == pytest.approx(np.array([x[1:] for x in want]), rel=1e-9)


def test_slices_cover_all_shards(spark):
    entries = [5_000, 0, 40, 9_000, 1, 1, 70_000, 300, 300, 300, 300, 300, 300, 300]
    summed = spark.createDataFrame(list(enumerate(entries)), "shard bigint, entries bigint")
    for max_bits in (1, 5_000, 100_000, 1 << 20, 1 << 29):
        parts = L.slices(summed, 4, max_bits)
        assert parts[0][0] == 0 and parts[-1][1] == 16 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        for a, b in parts:
            held = [L.segment_bits(n) for n in entries[a:b] if n]
            assert sum(held) <= max_bits or len(held) == 1


def test_a_repeated_id_is_one_training_row(spark):
    docs = spark.createDataFrame([(2, f"text {i:04}") for i in range(3000)] + [(3, "b"), (3, "a"), (None, "z")],
                                 "doc_id bigint, text string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 0), (None, 1)], "doc_id bigint, toxic int")
    in_training = [i for i in (2, 3) if zlib.crc32(str(i).encode()) % 5 != 0]
    want = {2: ("text 0000", 1), 3: ("a", 0)}
    got = {r.doc_id: (r.text, r.toxic) for r in X.training_sample(docs.repartition(5), labels).collect()}
    assert got == {i: want[i] for i in in_training} and got


def test_gradients():
    rng = np.random.default_rng(0)
    net = X.Network({"ab": 1, "cd": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words, which, mask = X._matrix([["ab", "cd", "xyz"], ["q"], ["cd"] * X.WINDOW])
    y, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])
    _, g = net.loss(words, which, mask, y, weight)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        used = np.flatnonzero(g[name].reshape(-1)) if name in ("word", "char") else np.arange(flat.size)
        for i in rng.choice(used, min(6, len(used)), replace=False):
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up, _ = net.loss(words, which, mask, y, weight)
            flat[i] = old - eps
            down, _ = net.loss(words, which, mask, y, weight)
            flat[i] = old
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_windows_cover_every_token():
    for n in (1, 31, 32, 33, 48, 49, 500):
        seen = {t for s in X.window_starts(n) for t in range(s, min(n, s + X.WINDOW))}
        assert seen == set(range(n))


def test_toxic_remarks_are_found_in_long_texts(spark):
    rng = random.Random(7)
    clean = ["river", "mountain", "letter", "quiet", "window", "garden", "paper", "stone"]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choices(clean, k=rng.choice([5, 20, 120]))
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "scumlord", "scummy", "idiot"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    rows += [(None, None, "x"), (2000, "", "x"), (2001, " ".join(clean * 3000) + " you idiot", "x"),
             (2002, " ".join(clean * 3000), "x"), (5, rows[5][1], "x"), (2003, "scumling", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(4)
    table = spark.createDataFrame([*labels, (None, 1), (7000, 1), (3, None)], "doc_id bigint, toxic int")
    got = X.score_texts(docs, table).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2001].predicted == 1 and by_id[2002].predicted == 0 and by_id[2003].predicted == 1
    assert by_id[2000].predicted == 0 and by_id[None].predicted == 0
    kept = X.drop_toxic(docs, table)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)
    assert X.score_texts(docs.limit(0), table).count() == 0
    assert {r.score for r in X.score_texts(docs, table.limit(0)).collect()} == {0.0}
