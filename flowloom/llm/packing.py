"""Packing documents into sequences with a bounded number of open windows.

Every task tokenises its documents and keeps at most ``open_windows`` windows open. A document is cut into whole
sequences; its rest goes to the open window it fits best. When none fits and no further window may be opened, the
fullest is filled with the head of the rest and given out. What is open at the end of a task is merged afterwards,
over the leftovers of ``MERGE_TASKS`` neighbouring tasks at a time.

Word encodings are memoised per worker. Texts are cut for that at spaces and line ends only, which the vocabulary
drops and never joins over, so the identifiers are those of the whole text.

A null text is empty: its document is the end identifier alone. Null ids and repeated rows are packed like others.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import batches, ids_and_texts
from flowloom.llm.token_counts import load_tokenizer
from flowloom.session import materialize

LENGTH, OPEN_WINDOWS, END_ID = 2048, 64, 1
MEMO_WORDS = 400_000
TASK_BITS = 32
MERGE_TASKS = 64
MERGED = 1 << 30  # task numbers of merged sequences begin here

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("open", pa.bool_()), ("ids", pa.binary())])
_DDL = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, open boolean, ids binary")

_loaded: dict[str, WordEncoder] = {}


class WordEncoder(dict):
    """Little-endian identifiers of a word, filled on demand and emptied when it is full."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load_tokenizer(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one piece for the pattern, which the model takes as it is
            ids = np.array([t.id for t in self.model.tokenize(word.lower())], "<u4").tobytes()
        elif len(word) > 1 and word[-1] in ",." and word[-2].isalpha() and word[-2] < "ɐ" and len(word[-2].lower()) == 1:
            # İ is out: lower-cased it ends in a combining dot, which makes one piece with punctuation.
            ids = self[word[:-1]] + self[word[-1]]  # the pattern splits punctuation from letters
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > MEMO_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


class Packer:
    """Open windows of one task. Pieces are (doc_id, start, length, crc, doc_tokens, ids)."""

    def __init__(self, task: int, length: int, open_windows: int):
        self.length, self.most = length, open_windows
        self.next_id = task << TASK_BITS
        self.windows: dict[int, list[tuple]] = {}
        self.room: list[tuple[int, int]] = []  # (free places, sequence id), ascending

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        """Place one document and give out the rows of all windows this closes."""
        total = len(ids) // 4
        start = 0
        while total - start >= self.length:
            yield self._row(_piece(doc_id, start, self.length, total, ids), self._new(), 0, False)
            start += self.length
        if start < total:
            yield from self.place(_piece(doc_id, start, total - start, total, ids))

    def place(self, piece: tuple) -> Iterator[tuple]:
        """Best fit. When nothing fits, the head of the piece fills the fullest window, which is given out."""
        while True:
            size = piece[2]
            at = bisect_left(self.room, (size, -1))
            if at == len(self.room) and len(self.room) == self.most:
                free, window = self.room.pop(0)
                head, piece = _cut(piece, free)
                self.windows[window].append(head)
                yield from self._close(window, False)
                continue
            free, window = self.room.pop(at) if at < len(self.room) else (self.length, self._new())
            self.windows.setdefault(window, []).append(piece)
            if free == size:
                yield from self._close(window, False)
            else:
                insort(self.room, (free - size, window))
            return

    def _close(self, window: int, is_open: bool) -> Iterator[tuple]:
        offset = 0
        for piece in self.windows.pop(window):
            yield self._row(piece, window, offset, is_open)
            offset += piece[2]

    @staticmethod
    def _row(piece: tuple, window: int, offset: int, is_open: bool) -> tuple:
        return (*piece[:5], window, offset, is_open, piece[5])

    def leftovers(self) -> Iterator[tuple]:
        for _, window in self.room:
            yield from self._close(window, True)
        self.room = []


def _piece(doc_id: int | None, start: int, length: int, total: int, ids: bytes) -> tuple:
    part = ids[4 * start:4 * (start + length)]
    return doc_id, start, length, zlib.crc32(part), total, part


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    """The first ``n`` identifiers of a piece, and the others."""
    doc_id, start, length, _, total, ids = piece
    return ((doc_id, start, n, zlib.crc32(ids[:4 * n]), total, ids[:4 * n]),
            (doc_id, start + n, length - n, zlib.crc32(ids[4 * n:]), total, ids[4 * n:]))


def _pack(incoming: Iterator[pa.RecordBatch], path: str, length: int, open_windows: int, end_id: int,
          with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, end = word_encoder(path), np.array([end_id], "<u4").tobytes()

    def rows() -> Iterator[tuple]:
        packer = Packer(TaskContext.get().partitionId(), length, open_windows)
        for batch in incoming:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                yield from packer.add(doc_id, encoder.encode(text) + end)
        yield from packer.leftovers()

    return batches((row if with_ids or row[7] else (*row[:8], b"") for row in rows()), PIECES, weight=8)


def merge_leftovers(pieces: pd.DataFrame, length: int) -> pd.DataFrame:
    """Pack open pieces again, fullest windows first, with a single open window: one of a group stays part full."""
    fill = pieces.groupby("sequence_id")["length"].transform("sum")
    pieces = pieces.assign(fill=fill).sort_values(["fill", "sequence_id", "offset"], ascending=[False, True, True])
    packer = Packer(MERGED + int(pieces["part"].iloc[0]), length, 1)
    rows = []
    for row in pieces.itertuples(index=False):
        doc_id = None if row.doc_id is None else int(row.doc_id)
        rows.extend(packer.place((doc_id, row.start, row.length, row.ids_crc32, row.doc_tokens, bytes(row.ids))))
    rows.extend(packer.leftovers())
    return pd.DataFrame(rows, columns=PIECES.names).astype({"doc_id": "Int64"}).drop(columns="open")


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, open_windows: int = OPEN_WINDOWS,
                   end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, the
    identifiers as little-endian unsigned 32-bit bytes."""
    pieces = materialize(ids_and_texts(docs).mapInArrow(
        lambda it: _pack(it, tokenizer_path, length, open_windows, end_id, with_ids), _DDL), "pieces")
    # At most open_windows windows per task: MERGE_TASKS * open_windows windows of identifiers in a group.
    part = F.shiftright("sequence_id", TASK_BITS + MERGE_TASKS.bit_length() - 1)
    merged = (pieces.filter("open").withColumn("part", part)
              .withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make floats of ids with a null
              .groupBy("part")
              .applyInPandas(lambda group: merge_leftovers(group, length), _DDL.replace("open boolean, ", "")))
    rows = pieces.filter("not open").drop("open").unionByName(merged)
    return rows if with_ids else rows.drop("ids")
