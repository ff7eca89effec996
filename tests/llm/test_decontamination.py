import random
import re

from flowloom.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(D.UPPER, D.LOWER)


def _words(text):
    return WORD.findall((text or "").translate(LOW))


def _brute(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w, hit, names = _words(text), set(), set()
        for item_id, item in items:
            iw = _words(item)
            k = min(size, len(iw))
            for window in {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if iw else ():
                for s in range(len(w) - k + 1):
                    if tuple(w[s:s + k]) == window:
                        hit.update(range(s, s + k))
                        names.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def _run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, term string, pos int").repartition(5)
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, key string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in D.contamination(d, b, **kw).collect()), key=str)


def test_random_texts_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["a", "B", "the", "é", "ÉT", "x9", "of", "Straße", "日本", "zz"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "!", "-"]) for _ in range(n))
    items = [(i, make(rng.randrange(1, 9))) for i in range(12)] + [(3, make(4)), (None, "the of the"), (50, ""), (51, None), (52, " -- ")]
    docs = [(i, make(rng.randrange(0, 80))) for i in range(60)]
    docs += [(None, "the of the of the"), (4, docs[4][1]), (4, "a b"), (70, None), (71, ""), (72, "?!"), (73, "a " * 20_000)]
    for size in (3, 10):
        assert _run(spark, docs, items, size=size) == _brute(docs, items, size)


def test_passages_and_a_hot_copy(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(i, passage if i < 3 else f"other{i} " * 12) for i in range(6)]
    near = passage.replace("w15", "w99")  # two runs of 15 and 14 words are left
    docs = [(i, "head " + passage.upper() + " tail") for i in range(400)] + [(900, near), (901, " ".join(passage.split()[:9])), (902, "clean text")]
    got = {r[0]: r[1:] for r in _run(spark, docs, items)}
    assert got[0] == got[399] == (32, 30, ["0", "1", "2"])
    assert got[900] == (30, 29, ["0", "1", "2"]) and got[901] == (9, 0, []) and got[902] == (2, 0, [])


def test_repeated_words_overlap(spark):
    docs, items = [(1, "a a a a b a a a"), (2, "a b"), (3, "b a a")], [(1, "a a a")]
    assert _run(spark, docs, items) == _brute(docs, items)


def test_empty_tables(spark):
    assert _run(spark, [], [(1, "a b")]) == []
    assert _run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_proximity_in_any_order(spark):
    docs = spark.createDataFrame([(1, "red x x blue x x green"), (2, "green blue red"), (3, "red " + "x " * 9 + "blue green"), (4, "red blue"),
                                  (5, "red " * 3)], "doc_id int, text string")
    index = D.postings(docs)
    keys = {r.key: r.doc_id for r in docs.select("doc_id", D.text_key(docs.text).alias("key")).collect()}
    phrases = spark.createDataFrame([(["red", "blue", "green"],), (["red", "red"],)], "phrase array<string>")
    got = sorted((keys[r.key], tuple(r.phrase)) for r in D.near_phrases(phrases, index, 3).collect())
    words = {1: "red x x blue x x green".split(), 2: "green blue red".split(), 3: ("red " + "x " * 9 + "blue green").split(),
             4: ["red", "blue"], 5: ["red"] * 3}
    counts = {t: sum(w.count(t) for w in words.values()) for t in ("red", "blue", "green")}
    want = []
    for phrase in (("red", "blue", "green"), ("red", "red")):
        # The rarest term; of equally rare ones the first in the phrase.
        anchor = min(phrase, key=lambda t: (counts[t], phrase.index(t)))
        for d, w in words.items():
            want += [(d, phrase) for p, t in enumerate(w) if t == anchor
                     and all(any(x == o and abs(q - p) <= 3 for q, x in enumerate(w)) for o in set(phrase) - {anchor})]
    assert got == sorted(want)


def test_main_path_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    plan = D.contamination(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
