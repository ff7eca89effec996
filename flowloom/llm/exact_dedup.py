"""Exact duplicates by Patricia tries that own texts.

Texts are normalised (A-Z to a-z, nothing else) and compared as whole byte strings.

1. Every input task inserts its texts into a compressed radix trie whose terminal nodes hold the owner (the
   largest identifier) and the number of rows. When the trie passes its byte budget, the heaviest subtree is
   spilled: its terminals go to Spark's shuffle as partial owners and their memory is freed. A text that fills a
   third of the table so leaves every task as one row.
2. Partial owners are dealt by (length, content hash), sorted by them, and inserted into tries again. As the rows
   come sorted, a trie is complete whenever the hash changes and is given out as soon as it passes the budget.

Rows with a null ``doc_id`` take part; they own a text only if all its rows have a null id. A null text is empty.
Repeated rows are members like any other; those that repeat the owner's id are all marked kept. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import batches, ids_and_texts, keep_rows

TRIE_BYTES = 48 << 20
NODE_BYTES = 250

PARTIAL = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("body", pa.binary()),
                     ("owner", pa.int64()), ("members", pa.int64())])
OWNERS = pa.schema([("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()),
                    ("group_size", pa.int64())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string())])


def normalise(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased; other letters stay."""
    return text.encode().lower()


def shared_prefix(edge: bytes, key: bytes, at: int) -> int:
    """Length of the common start of ``edge`` and ``key[at:]``."""
    most = min(len(edge), len(key) - at)
    done, step = 0, 64
    while done < most:
        a, b = edge[done:min(done + step, most)], key[at + done:at + min(done + step, most)]
        if a != b:
            unequal = np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8)
            return done + int(unequal.argmax())
        done += len(a)
        step *= 4
    return most


class Node:
    __slots__ = ("edge", "children", "owner", "members")

    def __init__(self, edge: bytes, owner: int | None = None, members: int = 0):
        self.edge, self.children, self.owner, self.members = edge, {}, owner, members


class RadixTrie:
    """Compressed trie of byte strings; a terminal node holds the largest identifier and the number of rows."""

    def __init__(self):
        self.root, self.weight = Node(b""), 0

    def insert(self, key: bytes, owner: int | None, members: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.weight += NODE_BYTES + len(child.edge)
                at = len(key)
            elif key.startswith(child.edge, at):
                at += len(child.edge)
            else:
                n = shared_prefix(child.edge, key, at)
                upper = node.children[key[at]] = Node(child.edge[:n])
                child.edge = child.edge[n:]
                upper.children[child.edge[0]] = child
                self.weight += NODE_BYTES
                child, at = upper, at + n
            node = child
        if owner is not None and (node.owner is None or owner > node.owner):
            node.owner = owner
        node.members += members

    def take(self, first: int | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """Remove and give out all texts, or those of the subtree below byte ``first`` of the root."""
        if first is None:
            top, self.root, self.weight = self.root, Node(b""), 0
        else:
            top = Node(b"")
            top.children[first] = self.root.children.pop(first)
            self.weight -= _weight(top)
        stack = [(top, b"")]
        while stack:
            node, before = stack.pop()
            text = before + node.edge
            if node.members:
                yield text, node.owner, node.members
            stack.extend((child, text) for child in node.children.values())

    def heaviest(self) -> int | None:
        """First byte of the root's subtree that holds the most memory."""
        return max(self.root.children, key=lambda b: _weight(self.root.children[b]), default=None)


def _weight(top: Node) -> int:
    total, stack = 0, [top]
    while stack:
        node = stack.pop()
        total += NODE_BYTES + len(node.edge)
        stack.extend(node.children.values())
    return total


def _partial_owners(incoming: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        trie = RadixTrie()
        for batch in incoming:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                trie.insert(normalise(text), doc_id)
                while trie.weight > budget and (first := trie.heaviest()) is not None:
                    yield from map(_keyed, trie.take(first))
        yield from map(_keyed, trie.take())

    return batches(rows(), PARTIAL, weight=2)


def _keyed(entry: tuple[bytes, int | None, int]) -> tuple:
    body, owner, members = entry
    return len(body), xxhash.xxh3_64_intdigest(body) - (1 << 63), body, owner, members


def _whole_owners(incoming: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        trie, last = RadixTrie(), None
        for batch in incoming:
            for n, h, body, owner, members in zip(*(batch[f.name].to_pylist() for f in PARTIAL), strict=True):
                if (n, h) != last and trie.weight > budget:
                    yield from map(_digested, trie.take())
                last = (n, h)
                trie.insert(body, owner, members)
        yield from map(_digested, trie.take())

    return batches(rows(), OWNERS)


def _digested(entry: tuple[bytes, int | None, int]) -> tuple:
    body, owner, members = entry
    return hashlib.sha256(body).hexdigest(), len(body), owner, members


def _digests(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        shas = [hashlib.sha256(normalise(t)).hexdigest() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(shas, pa.string())], schema=DIGESTS)


def text_owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per different text: text_sha256, n_bytes, keep_id (its largest doc_id), group_size."""
    partial = ids_and_texts(docs).mapInArrow(
        lambda it: _partial_owners(it, trie_bytes), "n_bytes bigint, content_hash bigint, body binary, "
                                                    "owner bigint, members bigint")
    dealt = partial.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    return dealt.mapInArrow(lambda it: _whole_owners(it, trie_bytes),
                            "text_sha256 string, n_bytes bigint, keep_id bigint, group_size bigint")


def find_copies(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = ids_and_texts(docs).mapInArrow(_digests, "doc_id bigint, text_sha256 string")
    return (digests.join(text_owners(docs, trie_bytes).drop("n_bytes"), "text_sha256")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))


def drop_copies(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``docs`` with one row per different text; of rows that repeat the owner's id and text, one stays."""
    owners = text_owners(docs, trie_bytes).select(F.col("text_sha256").alias("key"), F.col("keep_id").alias("doc_id"))
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return keep_rows(docs, F.sha2(lowered, 256), owners)
