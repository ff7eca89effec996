import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import exact_dedup as X
from flowloom.llm import packing as P
from flowloom.llm import token_counts as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _kept_id string, kept string"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(1, "The Cat."), (2, "the cat."), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "only null id"),
        (7, "the cat, <|endoftext|> and 's  two  spaces \n"), (7, "the cat, <|endoftext|> and 's  two  spaces \n"),
        (8, "word " * 9000), (9, "x" * 50_000), (10, "the ca")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "clash", None) for i, t in ROWS], SCHEMA).repartition(3)


def test_trie_against_dictionary():
    rng = random.Random(4)
    trie, want = X.RadixTrie(), {}
    for i in range(4000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) * rng.choice([1, 1, 40])
        trie.insert(key, i)
        owner, n = want.get(key, (0, 0))
        want[key] = (i, n + 1)
    first = trie.heaviest()
    spilled = list(trie.take(first))
    assert all(k[0] == first for k, _, _ in spilled)
    got = {k: (o, n) for k, o, n in [*spilled, *trie.take()]}
    assert got == want and trie.weight == 0


@pytest.mark.parametrize("budget", [1, 1 << 20])
def test_find_copies(spark, docs, budget):
    got = [tuple(r) for r in X.find_copies(docs, budget).collect()]
    texts = [(i, X.normalise(t or "")) for i, t in ROWS]
    want = []
    for i, t in texts:
        group = [j for j, u in texts if u == t]
        keep = max((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep, hashlib.sha256(t).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_drop_copies(spark, docs):
    kept = X.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8, 9, 10]
    assert X.drop_copies(docs.limit(0)).count() == 0


def test_drop_copies_keeps_every_text_of_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "b"), (None, "B"), (5, "A text"), (5, "copied"), (9, "Copied"), (7, "x"), (7, "y"), (7, "y")]
    kept = X.drop_copies(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == [
        ("5", "a text"), ("7", "x"), ("7", "y"), ("9", "copied"), ("None", "a"), ("None", "b")]


def _check_packing(rows, docs, length, tokenizer):
    ids = {}
    for i, t in docs:
        ids[i] = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    assert all(r.length > 0 and r.offset + r.length <= length for r in rows)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(part))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in by_doc.items():
        copies = sum(1 for j, _ in docs if j == i)
        assert sum(n for _, n in pieces) == copies * len(ids[i])
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
    assert set(by_doc) == set(ids)
    return by_seq


def test_pack_documents(spark, docs):
    tokenizer = T.load_tokenizer(WORDS)
    rows = P.pack_documents(docs, WORDS, length=64, open_windows=2).collect()
    _check_packing(rows, ROWS, 64, tokenizer)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert P.pack_documents(docs.limit(0), WORDS).count() == 0


def test_packing_has_little_padding(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["the", "cat", "zorblat,", "und"]) for _ in range(rng.randrange(1, 900))))
             for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    rows = P.pack_documents(docs, WORDS, with_ids=False).collect()
    by_seq = _check_packing(rows, texts, 2048, T.load_tokenizer(WORDS))
    assert sum(r.length for r in rows) > 0.99 * 2048 * len(by_seq)


TEXTS = st.text(st.one_of(st.sampled_from(" \n\t,.'sé<|a1É　\x1cΣ"), st.characters(exclude_categories=["Cs"])),
                max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_memo_gives_the_librarys_tokens(text):
    byte_level, encoder = T.counter(BYTES), P.word_encoder(WORDS)
    words = encoder.tokenizer
    assert byte_level.count(text) == len(byte_level.tokenizer.encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


def test_words_before_punctuation_give_the_librarys_tokens():
    """All letters below U+0250, combining marks and title case, in front of what the shortcut cuts off."""
    rng = random.Random(8)
    encoder = P.WordEncoder(WORDS)
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()] + list("İıſŉǅǈǋǲẞﬁ") + [chr(c) for c in (0x300, 0x301, 0x307, 0x323, 0x345)]
    words = [a + end for a in letters for end in (".", ",", "..", ".,", "")]
    words += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) + rng.choice([".", ",", "'s.", "1.", ".,", ""]) for _ in range(100_000)]
    want = encoder.tokenizer.encode_batch(words, add_special_tokens=False)
    assert [w for w, e in zip(words, want) if np.frombuffer(encoder.encode(w), "<u4").tolist() != e.ids] == []


def test_count_tokens_uses_the_cache(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    tokenizer = T.load_tokenizer(BYTES)
    want = sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids))
                   for i, t in ROWS), key=str)
    for _ in range(2):
        assert sorted((tuple(r) for r in T.count_tokens(docs, BYTES, cache).collect()), key=str) == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in ROWS})
    assert T.count_tokens(docs.limit(0), BYTES, cache).count() == 0
