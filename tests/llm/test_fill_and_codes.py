import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import fill_middle as FM
from flowloom.llm import vector_codes as VC


# --- fill in middle ---------------------------------------------------------------------

def _formed(doc_id, text, percent=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(lines), "plain", None, None, text
    if h4 % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "\n", "\n\n\n", "a", "a\nb\nc", "a\nb\n", "é😀\nß\r\nx y", "<P>", "a<S>\nb", "x<M", "<\nP>", "<P\n>", "S>\n<", "<<\n>>\nP>",
         "no line end " * 50, "\0\n\0", "z" * 3_000_000 + "\n" + "é\n" * 200_000, "a\n" * 20]


@pytest.mark.parametrize(("percent", "spm"), [(100, 50), (40, 0), (0, 50)])
def test_forms_against_plain_python(spark, percent, spm):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["a", "é", "😀", "\n", "<", "P>", "S", " "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a\nb\nc\n", "x", 1), (5, TEXTS[5], "x", 1), (5, "other\ntext", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, n int").repartition(4)
    formed = FM.restore(FM.fill_in_middle(docs, percent=percent, spm_percent=spm)).collect()
    got = sorted(((r.doc_id, r.restored, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in formed), key=str)
    want = sorted(((i, t or "", *_formed(i, t, percent, spm)) for i, t, *_ in rows), key=str)
    assert got == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert FM.restore(FM.fill_in_middle(docs)).columns[-1] == "restored"
    assert FM.restore(FM.fill_in_middle(docs)).count() == 0


def test_an_output_without_markers_is_an_error(spark):
    broken = spark.createDataFrame([(1, "psm", "<P>ab<S>c")], "doc_id int, form string, output string")
    with pytest.raises(Exception, match="three markers"):
        FM.restore(broken).collect()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(FM.FORMS)), max_size=12),
       st.sampled_from([1, 2, 3, 7, 1 << 20]))
def test_scatter_and_gather_in_any_block_size(texts, block):
    clean = [(re.sub(rb"<", b"(", t), *sorted((min(a, len(t)), min(b, len(t)))), f) for t, a, b, f in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t, *_ in clean], dtype=np.int64)]).astype(np.int64)
    body = np.frombuffer(b"".join(t for t, *_ in clean), np.uint8)
    form = np.array([f for *_, f in clean], dtype="<U5")
    cut1, cut2 = (at[:-1] + np.array([c[i] for c in clean], np.int64) for i in (1, 2))
    old, FM.BLOCK = FM.BLOCK, block
    try:
        out_at, out = FM.scatter(body, at, form, cut1, cut2)
        back_at, back = FM.gather(out, out_at, form)
    finally:
        FM.BLOCK = old
    for i, (t, a, b, f) in enumerate(clean):
        p, m, s = t[:a], t[a:b], t[b:]
        want = {"plain": t, "psm": b"<P>" + p + b"<S>" + s + b"<M>" + m, "spm": b"<S>" + s + b"<P>" + p + b"<M>" + m}[f]
        assert out[out_at[i]:out_at[i + 1]].tobytes() == want
        assert back[back_at[i]:back_at[i + 1]].tobytes() == t


# --- vector codes -----------------------------------------------------------------------

def _brute(rows, parts=8, entries=16, rounds=6):
    """Codes by vec_id order, errors, final entries; rows are (vec_id, vector, label) that all take part."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [int(np.floor(4096 * float(x))) for x in rows[i][1]]))
    x = np.array([[int(np.floor(4096 * float(v))) for v in r[1]] for r in rows], dtype=object).reshape(len(rows), parts, -1)
    books = [[list(x[i, p]) for i in order[:entries]] for p in range(parts)]

    def near(p, v):
        return min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[near(p, x[i, p])[1] for p in range(parts)] for i in range(len(rows))]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [x[i, p] for i in range(len(rows)) if found[i][p] == k]
                if mine:
                    books[p][k] = [sum(int(v[j]) for v in mine) // len(mine) for j in range(x.shape[2])]
    last = [[near(p, x[i, p]) for p in range(parts)] for i in range(len(rows))]
    flat = ",".join(str(v) for part in books for e in part for v in e)
    error = [sum(d for d, _ in r) for r in last]
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in c), e, by_label[r[2]], hashlib.sha256(flat.encode()).hexdigest())
                   for r, c, e in zip(rows, last, error)), key=str)


def _run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, codes string")
    return sorted((tuple(r) for r in VC.compress(df.repartition(5), **kw).collect()), key=str)


def _vectors(n, dims=16, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dims)) * scale).astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e-3, 5000.0])
def test_codes_against_brute_force(spark, scale):
    rows = [(i * 3 + 1, v, i % 5 or None) for i, v in enumerate(_vectors(150, scale=scale))]
    assert _run(spark, rows) == _brute(rows)


def test_ties_repeats_and_a_hot_vector(spark):
    hot = [0.5] * 16
    rows = [(i, hot, 1) for i in range(80)] + [(1000 + i, [float((i >> j) & 1) for j in range(16)], 2) for i in range(60)]
    rows += [(7, hot, None), (7, [0.25] * 16, None), (None, [-1.5] * 16, 3)]
    assert _run(spark, rows) == _brute(rows)


def test_unusable_vectors_and_few_rows(spark):
    good = [(i + 5, v, 1) for i, v in enumerate(_vectors(7))]
    bad = [(1, None, 1), (2, [None] + [0.0] * 15, 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, 1), (90, [1.0] * 8, 1), (91, [], 1)]
    assert _run(spark, good + bad) == _brute(good)
    assert _run(spark, []) == [] and _run(spark, bad[:4]) == []


def test_zeros_fill_the_last_part(spark):
    rows = [(i, v, 0) for i, v in enumerate(_vectors(40, dims=13))]
    assert _run(spark, rows) == _brute([(i, v + [0.0] * 3, x) for i, v, x in rows])


def test_too_large_numbers_are_an_error(spark):
    with pytest.raises(ValueError, match="too large"):
        _run(spark, [(1, [1e9] * 16, 0)])


def test_decoded_vectors_are_the_entries(spark):
    rows = [(i, v, 0) for i, v in enumerate(_vectors(60))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    stored, books = VC.train(df)
    for r in VC.decode(VC.encode(stored, books), books).collect():
        x = np.floor(4096 * np.array(rows[r.vec_id][1]))
        assert int(((x - 4096 * np.array(r.approximation)) ** 2).sum()) == r.error


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-3000, 3000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))
    pivots = VC.choose_pivots(centres[None], 4)[0]
    near = np.sqrt(VC.squared(x[:, None], pivots[None]).astype(float)).astype(np.float32)
    index, best, evaluated = VC.nearest_entries(x, near, centres, pivots)
    all_d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (index == all_d.argmin(axis=1)).all() and (best == all_d.min(axis=1)).all()
    assert evaluated < 0.2 * all_d.size
