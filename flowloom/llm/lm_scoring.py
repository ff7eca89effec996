"""Bigram language model in a log-frequency Bloom filter.

Tokens are runs of characters other than space and tab to carriage return, A-Z lower-cased; every text ends with an
end token, which is also the context of its first word. A count c is quantised to level 1 + floor(log_base c), and an
n-gram is put into the filter once per level up to its own. A reader probes level after level until one is missing.
The filter holds bigram counts and, per context, the number of different followers. Witten-Bell smoothing mixes the
bigram estimate with the add-half unigram estimate, whose counts are exact:

    P(w | h) = (c(hw) + T(h) P(w)) / (c(h) + T(h))

Jobs:

1. Every task turns its texts into blocks of about ``BLOCK_BYTES``: the block's word hashes and the texts as
   numbers of words. The blocks are stored, and everything below works on them.
2. Words: one row per block and word. Of words that several blocks have, each gets the whole table's counts back. The
   blocks are stored again with the counts, so that no later job shuffles them.
3. Bigrams: every block sends its different bigrams with counts, cut into shards by context. Words that fill a shard of
   their own as contexts are cut by the following word instead. The number of shards follows the training tokens.
   Shards sum counts and are stored.
4. Filter: shards fill segments of it, ``BITS_PER_ENTRY`` bits for each entry. All n-grams of all levels are in it.
5. Scoring: ``max_bits`` bounds what is broadcast at a time. A larger filter is cut into slices of shards; each slice is
   broadcast in turn, and every block adds up the tokens whose bigrams lie in it. Only these sums, one number for each
   text and slice, are brought together at the end. A slice costs one pass over the stored blocks, so give
   ``max_bits`` the memory that a worker can spare.

Scores depend neither on ``max_bits`` nor on the partitioning of the table.

Word identity is a 64-bit hash. Training rows are those whose crc32(doc_id as text) mod 5 is not 1. Null texts are
empty; a null id counts as the empty text for the fold; repeated rows count each time; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import ids_and_texts
from flowloom.llm.near_dedup import mix
from flowloom.session import materialize

FOLDS, HELD_OUT = 5, 1
BLOCK_BYTES = 8 << 20
MAX_BITS = 1 << 28
BITS_PER_ENTRY = 12
PROBES = 4
BASE = 1.5
LEVELS = 256
BATCH_BYTES = str(8 << 20)  # of stored blocks or shards that a worker gets at a time, one row at least
SCORE_TOKENS = 1 << 18  # tokens whose probabilities are computed at a time
SHARD_TOKENS, MAX_HOT = 1 << 18, 1 << 16
END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds white space
_G = np.uint64(0x9E3779B97F4A7C15)
_FOLLOWERS = np.uint64(0xD6E8FEB86659FD93)

BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                    ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("tokens", pa.binary())])
_BLOCKS = ("block bigint, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, words binary, "
           "tokens binary")


def tokens(text: str) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII only, as the token rule does."""
    return text.encode().lower().split()


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def _pack_planes(a: np.ndarray) -> bytes:
    """32-bit numbers by byte, since the upper bytes are mostly equal."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


# --- blocks -----------------------------------------------------------------------------

class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _block(block: int, numbers: _Numbers, rows: list[tuple]) -> pa.RecordBatch:
    hashes = np.fromiter((END if w is None else xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64,
                         len(numbers))
    flat = np.concatenate([d for _, d in rows])
    return pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array([[i for i, _ in rows]], pa.list_(pa.int64())),
         pa.array([[is_held_out(i) for i, _ in rows]], pa.list_(pa.bool_())),
         pa.array([[len(d) for _, d in rows]], pa.list_(pa.int64())),
         pa.array([hashes.tobytes()]), pa.array([_pack_planes(flat)])], schema=BLOCKS)


def _blocks(incoming: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    numbers, rows, size = _Numbers({None: 0}), [], 0  # number 0 is the end token
    for batch in incoming:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            text = text.as_py()
            words = tokens(text)
            numbered = np.zeros(len(words) + 1, np.uint32)
            numbered[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
            rows.append((doc_id.as_py(), numbered))
            size += len(text)
            if size >= block_bytes:
                yield _block(block, numbers, rows)
                block, numbers, rows, size = block + 1, _Numbers({None: 0}), [], 0
    if rows:
        yield _block(block, numbers, rows)


class Block:
    """A stored block in memory: words sorted, tokens as places among them. Stored words come by first appearance,
    which gives frequent words small numbers."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, i: int):
        at = {c: batch.column(c)[i] for c in ("doc_ids", "held", "lengths", "words", "tokens")}
        self.doc_ids = at["doc_ids"].as_py()
        self.held = np.array(at["held"].as_py(), bool)
        self.lengths = np.array(at["lengths"].as_py(), np.int64)
        words = np.frombuffer(at["words"].as_py(), np.uint64)
        order = np.argsort(words)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        self.words = words[order]
        self.tokens = rank[_unpack_planes(at["tokens"].as_py())]

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def contexts(self) -> np.ndarray:
        """The token before each token; the end token before the first."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = np.searchsorted(self.words, np.uint64(END))
        return before

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)


# --- words ------------------------------------------------------------------------------

WORD_ROWS = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("word", pa.int64()), ("n", pa.int64())])


def _word_rows(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        for i in range(batch.num_rows):
            b = Block(batch, i)
            n = np.bincount(b.tokens[b.training()], minlength=len(b.words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), batch["block"][i].as_py())), pa.array(np.arange(len(n), dtype=np.int32)),
                 pa.array(b.words.view(np.int64)), pa.array(n)],
                schema=WORD_ROWS)


# --- bigrams ----------------------------------------------------------------------------

SHARDS = pa.schema([("shard", pa.int64()), ("contexts", pa.binary()), ("sizes", pa.binary()),
                    ("words", pa.binary()), ("counts", pa.binary())])
_SHARDS = "shard bigint, contexts binary, sizes binary, words binary, counts binary"
SUMMED = pa.schema([("shard", pa.int64()), ("contexts", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()),
                    ("levels", pa.binary()), ("entries", pa.int64()),
                    ("hot", pa.list_(pa.int64())), ("hot_sizes", pa.list_(pa.int64()))])
_SUMMED = ("shard bigint, contexts binary, sizes binary, words binary, levels binary, entries bigint, "
           "hot array<bigint>, hot_sizes array<bigint>")


def shard_of(contexts: np.ndarray, words: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """Shards by context, of hot contexts by word."""
    return (np.where(np.isin(contexts, hot), words, contexts) >> np.uint64(64 - bits)).astype(np.int64)


def _grouped(contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by context: contexts once, their sizes, words."""
    first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(contexts) else np.empty(0, np.int64)
    return contexts[first], np.diff(np.r_[first, len(contexts)]).astype(np.uint32), words


def _bigrams(incoming: Iterator[pa.RecordBatch], hot: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        for i in range(batch.num_rows):
            b = Block(batch, i)
            train = b.training()
            pairs = (b.contexts()[train].astype(np.uint64) << np.uint64(32)) | b.tokens[train]
            pairs.sort()
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.empty(0, np.int64)
            counts = np.diff(np.r_[first, len(pairs)])
            pairs = pairs[first]
            contexts, words = b.words[pairs >> np.uint64(32)], b.words[pairs & np.uint64(0xFFFFFFFF)]
            shards = shard_of(contexts, words, hot, bits)
            order = np.argsort(shards, kind="stable")
            present, first = np.unique(shards[order], return_index=True)
            rows = []
            for s, part in zip(present, np.split(order, first[1:])):
                c, sizes, w = _grouped(contexts[part], (words[part] >> np.uint64(32)).astype(np.uint32))
                rows.append((int(s), c.tobytes(), _pack(sizes), w.tobytes(), _pack(counts[part].astype(np.uint32))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), SHARDS)],
                                                 schema=SHARDS)


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    return np.minimum(LEVELS - 1, 1 + np.floor(np.log(counts) / np.log(base) + 1e-9)).astype(np.int64)


def count_at(levels: np.ndarray, base: float) -> np.ndarray:
    """The mean count of a level; 0 of level 0."""
    low = np.ceil(base ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(base ** levels.astype(np.float64) - 1e-9) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def _sum_shard(key: tuple, table: pa.Table, hot: np.ndarray, base: float) -> pa.Table:
    def column(name: str, read) -> np.ndarray:
        return np.concatenate([read(x.as_py()) for x in table[name]])

    contexts = np.repeat(column("contexts", lambda x: np.frombuffer(x, np.uint64)),
                         column("sizes", lambda x: _unpack(x, np.uint32)))
    words = column("words", lambda x: np.frombuffer(x, np.uint32))
    counts = column("counts", lambda x: _unpack(x, np.uint32)).astype(np.int64)
    known, number = np.unique(contexts, return_inverse=True)
    code = (number.astype(np.uint64) << np.uint64(32)) | words
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    counts = np.add.reduceat(counts[order], first)
    contexts, sizes, words = _grouped(known[code[first] >> np.uint64(32)],
                                      (code[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    levels = level_of(counts, base)
    is_hot = np.isin(contexts, hot)
    followers = level_of(sizes[~is_hot & (sizes > 1)], base)
    entries = int(levels.sum() + followers.sum())  # one for each level up to an n-gram's own
    return pa.Table.from_arrays(
        [pa.array([key[0].as_py()]), pa.array([contexts.tobytes()]), pa.array([_pack(sizes)]),
         pa.array([words.tobytes()]), pa.array([_pack(levels.astype(np.uint8))]),
         pa.array([entries]),
         pa.array([contexts[is_hot].view(np.int64).tolist()], pa.list_(pa.int64())),
         pa.array([sizes[is_hot].tolist()], pa.list_(pa.int64()))], schema=SUMMED)


# --- filter -----------------------------------------------------------------------------

class LogBloom:
    """Log-frequency Bloom filter of the shards from ``first`` on, a segment for each."""

    def __init__(self, bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: int, base: float):
        self.bits, self.starts, self.sizes, self.first, self.base = bits, starts, sizes, first, base

    def holds(self, shards: np.ndarray) -> np.ndarray:
        return (shards >= self.first) & (shards < self.first + len(self.sizes))

    @staticmethod
    def hashes(items: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First hash and step of the probes of one level."""
        h = mix(items + np.uint64(level * int(_G) % (1 << 64)))
        return h, (h << np.uint64(32)) | np.uint64(1)

    @staticmethod
    def place(h: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
        return ((h >> np.uint64(32)) * size) >> np.uint64(32)

    @classmethod
    def fill(cls, bits: np.ndarray, items: np.ndarray, level: int) -> None:
        h, step = cls.hashes(items, level)
        for _ in range(PROBES):
            bits[cls.place(h, np.uint64(len(bits)))] = True
            h = h + step

    def level(self, items: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """Probe one level after the other until one is missing. All shards are held ones."""
        found = np.zeros(len(items), np.int64)
        shards = shards - self.first
        at = np.flatnonzero(self.sizes[shards] > 0)
        level = 1
        while len(at):
            h, step = self.hashes(items[at], level)
            size, start = self.sizes[shards[at]], self.starts[shards[at]]
            for _ in range(PROBES):
                bit = start + self.place(h, size)
                there = (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                at, h, step, size, start = at[there], h[there], step[there], size[there], start[there]
                h = h + step
            found[at] = level
            level += 1
        return found


def bigram_items(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Items from context hashes and the upper halves of word hashes."""
    return mix(contexts * _G + words.astype(np.uint64))


def follower_items(contexts: np.ndarray) -> np.ndarray:
    return mix(contexts ^ _FOLLOWERS)


def segment_bits(entries: int) -> int:
    return 8 * (entries * BITS_PER_ENTRY // 8 + 1) if entries else 0


def _segments(incoming: Iterator[pa.RecordBatch], hot: np.ndarray, base: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shard", pa.int64()), ("bits", pa.binary())])
    for batch in incoming:
        for row in batch.to_pylist():
            contexts, n = np.frombuffer(row["contexts"], np.uint64), _unpack(row["sizes"], np.uint32)
            several = ~np.isin(contexts, hot) & (n > 1)
            items = np.concatenate([bigram_items(np.repeat(contexts, n), np.frombuffer(row["words"], np.uint32)),
                                    follower_items(contexts[several])])
            levels = np.concatenate([_unpack(row["levels"], np.uint8), level_of(n[several], base)])
            bits = np.zeros(segment_bits(row["entries"]), bool)
            for level in range(1, int(levels.max(initial=0)) + 1):
                LogBloom.fill(bits, items[levels >= level], level)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], schema=schema)


def unigram(counts: np.ndarray, total: int, distinct: int) -> np.ndarray:
    return (counts + 0.5) / (total + 0.5 * (distinct + 1))


def base_scores(block: Block, counts: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: known tokens, base score. counts: of the block's words over all training texts."""
    return (np.add.reduceat((counts > 0)[block.tokens].astype(np.int64), block.starts),
            np.add.reduceat(np.log10(unigram(counts, total, distinct))[block.tokens], block.starts))


class Model:
    """A slice of the filter, followers of hot contexts (MAX_HOT at most, read by level like all others), totals."""

    def __init__(self, bloom: LogBloom, hot: np.ndarray, hot_sizes: np.ndarray, bits: int, total: int, distinct: int):
        self.bloom, self.shard_bits, self.total, self.distinct = bloom, bits, total, distinct
        self.hot = hot
        self.hot_sizes = np.maximum(1.0, count_at(level_of(np.maximum(hot_sizes, 1), bloom.base), bloom.base))

    def followers(self, words: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> np.ndarray:
        """T(h) of the block's words as far as the slice has it; a context met once has one follower."""
        several = np.flatnonzero((counts > 1) & self.bloom.holds(shards))
        out = np.ones(len(words))
        levels = self.bloom.level(follower_items(words[several]), shards[several])
        out[several] = np.maximum(1.0, count_at(levels, self.bloom.base))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
            out = np.where(self.hot[at] == words, self.hot_sizes[at], out)
        return np.minimum(out, np.maximum(counts, 1))

    def score(self, block: Block, counts: np.ndarray) -> np.ndarray:
        """Per text: log10 probability of the tokens whose bigrams lie in the slice."""
        shards = (block.words >> np.uint64(64 - self.shard_bits)).astype(np.int64)
        is_hot = np.isin(block.words, self.hot)
        p1, followers = unigram(counts, self.total, self.distinct), self.followers(block.words, counts, shards)
        contexts, now = block.contexts(), block.tokens
        score = np.zeros(len(now))
        for at in range(0, len(now), SCORE_TOKENS):
            h, w = contexts[at:at + SCORE_TOKENS], now[at:at + SCORE_TOKENS]
            shard = np.where(is_hot[h], shards[w], shards[h])
            mine = np.flatnonzero(self.bloom.holds(shard))
            score[at + mine] = np.log10(self._probability(block.words, h[mine], w[mine], shard[mine], counts, p1,
                                                          followers))
        return np.add.reduceat(score, block.starts)

    def _probability(self, words: np.ndarray, contexts: np.ndarray, now: np.ndarray, shards: np.ndarray,
                     counts: np.ndarray, p1: np.ndarray, followers: np.ndarray) -> np.ndarray:
        known = counts[contexts] > 0
        p = p1[now]
        contexts, now = contexts[known], now[known]
        levels = self.bloom.level(bigram_items(words[contexts], words[now] >> np.uint64(32)), shards[known])
        c_h, t = counts[contexts].astype(np.float64), followers[contexts]
        # A bigram is no more frequent than its context or its word; this also bounds a false positive.
        c_hw = np.minimum(count_at(levels, self.bloom.base), np.minimum(c_h, counts[now]))
        p[known] = (c_hw + t * p[known]) / (c_h + t)
        return p


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                    ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                    ("score", pa.float64())])
_RESULT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
           "base_score double, score double")
COUNTED = pa.schema([*BLOCKS, ("counts", pa.binary()), ("firsts", pa.int64()), ("hot", pa.list_(pa.int64()))])
_COUNTED = f"{_BLOCKS}, counts binary, firsts bigint, hot array<bigint>"
SUMS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("scores", pa.binary())])
_SUMS = "block bigint, part int, scores binary"


def _with_counts(blocks: pa.Table, shared: pa.Table, hot_count: int) -> pa.Table:
    """A block with the whole table's training counts of its words, in the order of the words; the number of those
    that it is the first block to have, and the hot ones among these. shared: words that other blocks count, too."""
    batch = blocks.combine_chunks()
    block = Block(batch, 0)
    counts = np.bincount(block.tokens[block.training()], minlength=len(block.words))
    is_first = counts > 0
    at = shared["at"].to_numpy()
    counts[at] = shared["n"].to_numpy() >> 1
    is_first[at] = shared["n"].to_numpy() & 1 > 0
    hot = block.words[is_first & (counts >= hot_count)].view(np.int64)
    return pa.Table.from_arrays(
        [*(batch[f.name].cast(f.type) for f in BLOCKS), pa.array([_pack(counts.astype(np.int64))]),
         pa.array([int(is_first.sum())]), pa.array([hot.tolist()], pa.list_(pa.int64()))], schema=COUNTED)


def _counted(batch: pa.RecordBatch, i: int) -> tuple[Block, np.ndarray]:
    """A block and its words' counts over all training texts."""
    return Block(batch, i), _unpack(batch["counts"][i].as_py(), np.int64)


def _score_slice(incoming: Iterator[pa.RecordBatch], shared, part: int) -> Iterator[pa.RecordBatch]:
    """Per block the sums of its texts over one slice."""
    for batch in incoming:
        for i in range(batch.num_rows):
            scores = shared.value.score(*_counted(batch, i))
            yield pa.RecordBatch.from_arrays([batch["block"].slice(i, 1), pa.array([part], pa.int32()),
                                              pa.array([scores.tobytes()])], schema=SUMS)


PLAIN = pa.schema([("block", pa.int64()), *((f.name, pa.list_(f.type)) for f in RESULT if f.name not in ("train_tokens", "score"))])
_PLAIN = ("block bigint, doc_id array<bigint>, held_out array<boolean>, n_tokens array<bigint>, "
          "n_known array<bigint>, base_score array<double>")


def _base_scores(incoming: Iterator[pa.RecordBatch], total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Per block all of its texts' results but the score."""
    for batch in incoming:
        for i in range(batch.num_rows):
            block, counts = _counted(batch, i)
            known, base = base_scores(block, counts, total, distinct)
            columns = (block.doc_ids, block.held, block.lengths, known, base)
            yield pa.RecordBatch.from_arrays(
                [batch["block"].slice(i, 1), *(pa.array([c], f.type) for c, f in zip(columns, list(PLAIN)[1:]))], schema=PLAIN)


def _results(incoming: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    """Results of the texts; the slices' sums are added up in their order."""
    for batch in incoming:
        for i in range(batch.num_rows):
            score = 0.0
            for part in batch["sums"][i].as_py():
                score = score + np.frombuffer(part["scores"], np.float64)
            doc_id, held, n, known, base = (batch[f.name][i].values for f in list(PLAIN)[1:])
            yield pa.RecordBatch.from_arrays(
                [doc_id, held, n, known, pa.array(np.full(len(n), total)), base, pa.array(score)], schema=RESULT)


def shared_words(blocks: DataFrame) -> DataFrame:
    """block, at (place among the block's words), n of the words that other blocks count as well: n is twice the whole table's training count, plus
    one in the first block that counts the word."""
    words = blocks.mapInArrow(_word_rows, "block bigint, at int, word bigint, n bigint")
    # A word has one row per block at most, so no word can fill a task.
    whole = Window.partitionBy("word")
    seen = (words.withColumn("total", F.sum("n").over(whole))
            .withColumn("first", F.min(F.when(F.col("n") > 0, F.col("block"))).over(whole)))
    coded = 2 * F.col("total") + F.when(F.col("first") == F.col("block"), 1).otherwise(0)
    return seen.filter("total <> n").select("block", "at", coded.cast("bigint").alias("n"))


def with_counts(blocks: DataFrame, hot_count: int) -> DataFrame:
    """Stored blocks with the counts of their words."""
    return materialize(blocks.groupBy("block").cogroup(shared_words(blocks).groupBy("block")).applyInArrow(
        lambda block, shared: _with_counts(block, shared, hot_count), _COUNTED), "lm-counted")


def drop_stored(table: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    jvm = table.sparkSession._jvm
    conf = table.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bigram_shards(blocks: DataFrame, hot: np.ndarray, bits: int, base: float) -> DataFrame:
    """Stored sums of bigrams, one row per shard."""
    sharded = blocks.mapInArrow(lambda it: _bigrams(it, hot, bits), _SHARDS)
    return materialize(sharded.groupBy("shard").applyInArrow(
        lambda key, table: _sum_shard(key, table, hot, base), _SUMMED), "bigram-shards")


def slices(summed: DataFrame, bits: int, max_bits: int) -> list[tuple[int, int]]:
    """Ranges of shards whose segments have ``max_bits`` bits at most; a single shard with more is a slice of its own."""
    needed = F.when(F.col("entries") > 0, F.col("entries") * BITS_PER_ENTRY + 8).otherwise(0)
    total = summed.agg(F.coalesce(F.sum(needed), F.lit(0)).alias("n")).first()["n"]
    if total <= max_bits:
        return [(0, 1 << bits)]
    # About 16 runs of shards for each slice.
    run_bits = min(bits, (16 * total // max_bits).bit_length())
    width = 1 << (bits - run_bits)
    runs = summed.groupBy(F.floor(F.col("shard") / width).alias("run")).agg(F.sum(needed).alias("n")).collect()
    cuts, filled = [0], 0
    for run in sorted(runs, key=lambda r: r["run"]):
        if filled and filled + run["n"] > max_bits:
            cuts.append(run["run"] * width)
            filled = 0
        filled += run["n"]
    return list(zip(cuts, [*cuts[1:], 1 << bits]))


def fill_slice(summed: DataFrame, first: int, end: int, hot: np.ndarray, base: float) -> LogBloom:
    """The filter of the shards from ``first`` to ``end``, as large as ``slices`` allows."""
    filled = (summed.filter(F.col("shard").between(first, end - 1))
              .mapInArrow(lambda it: _segments(it, hot, base), "shard bigint, bits binary").collect())
    filled.sort(key=lambda r: r["shard"])
    sizes, starts = np.zeros(end - first, np.uint64), np.zeros(end - first, np.uint64)
    at = np.array([r["shard"] - first for r in filled], np.int64)
    sizes[at] = np.array([8 * len(r["bits"]) for r in filled], np.uint64)
    starts[at] = np.cumsum(sizes[at]) - sizes[at]
    bits = np.zeros(int(sizes.sum()) // 8 + 1, np.uint8)
    for i in at:
        row = filled.pop(0)
        bits[int(starts[i]) // 8:int(starts[i]) // 8 + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return LogBloom(bits, starts, sizes, first, base)


def score_documents(docs: DataFrame, base: float = BASE, max_bits: int = MAX_BITS,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    context = docs.sparkSession.sparkContext
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    blocks = materialize(ids_and_texts(docs).mapInArrow(lambda it: _blocks(it, block_bytes), _BLOCKS), "lm-blocks")
    trained = F.filter(F.arrays_zip("lengths", "held"), lambda d: ~d["held"])
    total = blocks.agg(F.coalesce(F.sum(F.aggregate(trained, F.lit(0).cast("bigint"), lambda n, d: n + d["lengths"])),
                                  F.lit(0)).alias("n")).first()["n"]
    counted = with_counts(blocks, max(SHARD_TOKENS, -(-total // MAX_HOT)))
    drop_stored(blocks)  # the counted ones hold all of it
    distinct = counted.agg(F.coalesce(F.sum("firsts"), F.lit(0)).alias("n")).first()["n"]
    # MAX_HOT words at most: each has at least that share of the training tokens.
    hot = np.sort(np.array([r["hot"] for r in counted.select(F.explode("hot").alias("hot")).collect()],
                           np.int64).view(np.uint64))

    bits = max(4, (total // SHARD_TOKENS).bit_length())
    summed = bigram_shards(counted, hot, bits, base)
    followers = {r["hot"] % (1 << 64): r["n"] for r in summed.select(F.explode(F.arrays_zip("hot", "hot_sizes")).alias("x"))
                 .groupBy("x.hot").agg(F.sum("x.hot_sizes").alias("n")).collect()}
    hot_sizes = np.array([followers.get(int(h), 0) for h in hot], np.int64)

    def broadcast(first: int, end: int):
        bloom = fill_slice(summed, first, end, hot, base)
        return context.broadcast(Model(bloom, hot, hot_sizes, bits, total, distinct))

    sums = []
    for part, (first, end) in enumerate(slices(summed, bits, max_bits)):
        shared = broadcast(first, end)
        sums.append(materialize(counted.mapInArrow(lambda it, shared=shared, part=part: _score_slice(it, shared, part), _SUMS),
                                "lm-slice"))
        shared.unpersist()
    added = reduce(DataFrame.unionByName, sums).groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("part", "scores"))).alias("sums"))
    plain = counted.mapInArrow(lambda it: _base_scores(it, total, distinct), _PLAIN)
    return plain.join(added, "block").mapInArrow(lambda it: _results(it, total), _RESULT)
