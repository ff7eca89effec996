"""Token counts through a cache of digests.

The content digest (SHA-256 of the normalised text) and the tokenizer-version digest (SHA-256 of the vocabulary
file) are the key of a stored table. Documents are joined to it; only distinct contents that are missing are encoded,
and their counts are appended. Normalisation may not change a count, so it is null to empty and nothing else.

Encoding works on chunks that begin at a lone space between two visible characters: the vocabulary's splitting
pattern never crosses such a place, so counts add up. Chunks met before come from a bounded memo, all others
and all texts where the rule can't be applied go through the library as they are.

Null texts are empty (0 tokens). Repeated rows and null ids give one result row each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import ids_and_texts
from flowloom.session import scratch_path

MEMO_CHUNKS = 400_000
CACHE = "content string, tokenizer string, n_tokens bigint"
COUNTS = pa.schema([("content", pa.string()), ("n_tokens", pa.int64())])
# A space beside white space or at an end: such texts are not cut.
_UNCUT = regex.compile(r" \s|\s |^ | $")

_loaded: dict[str, ChunkCounter] = {}


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class ChunkCounter(dict):
    """Tokens of a word with its leading space, filled on demand and emptied when it is full."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load_tokenizer(path)
        self.model = self.tokenizer.model

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> int:
        # ASCII letters behind a space are one piece, whose space the byte alphabet writes as the letter below.
        if word.isascii() and word.isalpha():
            n = len(self.model.tokenize("\u0120" + word))
        # A comma or full stop behind a letter is a piece of its own for the pattern, and one token.
        elif len(word) > 1 and word[-1] in ",." and word[-2].isalpha() and word[-2] < "\u0250":
            n = self[word[:-1]] + 1
        else:
            n = self.whole(" " + word)
        self[word] = n
        return n

    def count(self, text: str) -> int:
        if _UNCUT.search(text):
            return self.whole(text)
        if len(self) > MEMO_CHUNKS:
            self.clear()
        first, *words = text.split(" ")
        return self.whole(first) + sum(map(self.__getitem__, words))


def counter(path: str) -> ChunkCounter:
    """The counter of this worker process."""
    if path not in _loaded:
        _loaded[path] = ChunkCounter(path)
    return _loaded[path]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _encode(incoming: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        counts = [counter(path).count(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["content"], pa.array(counts, pa.int64())], schema=COUNTS)


def cached_counts(spark, cache: str, version: str) -> DataFrame:
    """content, n_tokens of one tokenizer version. Appends that ran twice count once."""
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    return (spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
            .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens. ``cache`` is a folder all executors reach; without it the
    cache starts empty in the shared scratch folder. The vocabulary file must be at the same path on all machines."""
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    texts = ids_and_texts(docs).withColumn("content", F.sha2("text", 256))
    # Copies meet in the map-side half of this aggregate, so a text that fills a third of the table is sent few times.
    misses = (texts.join(cached_counts(spark, cache, version), "content", "left_anti")
              .select("content", "text").dropDuplicates(["content"]))
    (misses.mapInArrow(lambda it: _encode(it, tokenizer_path), "content string, n_tokens bigint")
     .select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache))
    keys = texts.select("doc_id", "content", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return (keys.join(cached_counts(spark, cache, version), "content")
            .select("doc_id", "n_bytes", "n_tokens"))
