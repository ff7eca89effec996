"""Fill-in-middle documents by a displacement scatter.

Every text is cut at two line ends into prefix, middle and suffix, and written with markers in one of two orders:
``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle). Cuts and form follow from a digest of the
identifier, so that every run and every partitioning gives the same documents.

The work is done on the bytes of a whole batch at once. Line feeds and the cuts are found by scans. A piece moves as
one block, so its bytes share one displacement; a difference array holds, at the first byte of each piece, by how much
the displacement changes there. Its cumulative sum is the displacement of every byte, and one scatter writes all
outputs. Restoring finds the markers, makes the same difference array and gathers. Both go over the batch in blocks of
``BLOCK`` bytes, so what they hold besides input and output is bounded.

A text stays ``plain`` where it is empty or contains a marker itself, and in the stated share of all cases. A null
text is empty; a null identifier is written as the empty string; repeated rows give a row each; an empty table gives
no rows. Only ``doc_id`` and ``text`` are read, so other columns can't clash. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import ids_and_texts

MARKERS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
FORMS = ("plain", "psm", "spm")
SEED, APPLY_PERCENT, SPM_PERCENT = 7, 100, 50
# Bytes that are displaced at once, and bytes of texts that are handled together (a longer text comes alone).
BLOCK = 1 << 20
TOGETHER = 8 << 20

_MARK = len("<P>")
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                  ("middle_chars", pa.int64()), ("output", pa.string())])


# --- bytes ------------------------------------------------------------------------------

def text_bytes(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return at - at[0], body[at[0]:at[-1]]


def string_column(at: np.ndarray, body: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body))


def groups(sizes: np.ndarray) -> Iterator[slice]:
    """Rows that are handled together: ``TOGETHER`` bytes, or one row."""
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > TOGETHER:
            yield slice(first, i)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def places(starts: np.ndarray, targets: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Where every byte goes, block by block. ``starts`` (ascending) are the first bytes of the pieces, ``targets``
    their places in the output; a piece reaches to the next one's start."""
    change = np.diff(targets - starts, prepend=0)
    carried = 0
    for low in range(0, size, BLOCK):
        high = min(size, low + BLOCK)
        first, last = np.searchsorted(starts, [low, high])
        step = np.zeros(high - low, np.int64)
        np.add.at(step, starts[first:last] - low, change[first:last])
        step[0] += carried
        shift = np.cumsum(step)
        carried = shift[-1]
        yield slice(low, high), np.arange(low, high) + shift


def marker_places(body: np.ndarray) -> np.ndarray:
    """First bytes of all markers."""
    opened = np.flatnonzero(body[:max(0, len(body) - 2)] == ord("<"))
    inner = np.isin(body[opened + 1], [ord(m[1]) for m in MARKERS.values()])
    return opened[inner & (body[opened + 2] == ord(">"))]


def rows_with_markers(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts contain a marker; what straddles two texts is none."""
    found = marker_places(body)
    row = np.searchsorted(at, found, "right") - 1
    out = np.zeros(len(at) - 1, bool)
    out[row[found + _MARK <= at[row + 1]]] = True
    return out


def line_ends(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line feeds, the first one of each text, and the number of lines of each text."""
    feeds = np.flatnonzero(body == ord("\n"))
    first = np.searchsorted(feeds, at)
    n = np.diff(first)
    filled = np.diff(at) > 0
    closed = np.zeros(len(n), bool)
    closed[filled] = body[at[1:][filled] - 1] == ord("\n")
    return feeds, first[:-1], n + (filled & ~closed)


def cut_after(lines: np.ndarray, feeds: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte behind the given number of lines of each text."""
    out = np.where(lines == 0, at[:-1], at[1:])
    fed = (lines > 0) & (first + lines <= np.append(first[1:], len(feeds)))
    out[fed] = feeds[first[fed] + lines[fed] - 1] + 1
    return out


def char_counts(body: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Code points between two bytes: all bytes but continuations."""
    starts = np.flatnonzero((body & 0xC0) != 0x80)
    return np.searchsorted(starts, high) - np.searchsorted(starts, low)


# --- there and back ---------------------------------------------------------------------

def targets(form: np.ndarray, begin: np.ndarray, prefix: np.ndarray, middle: np.ndarray,
            suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the three pieces and of their markers in the output, a row per text, from the pieces' lengths.
    Pieces of plain texts follow each other without markers."""
    mark = np.where(form == "plain", 0, _MARK)
    spm = form == "spm"
    first = np.where(spm, suffix, prefix)
    p = begin + np.where(spm, mark + first + mark, mark)
    s = begin + np.where(spm, mark, mark + first + mark)
    m = begin + 3 * mark + prefix + suffix
    plain = form == "plain"
    m[plain], s[plain] = (begin + prefix)[plain], (begin + prefix + middle)[plain]
    pieces = np.stack([p, m, s], axis=1)
    return pieces, pieces - mark[:, None]


def scatter(body: np.ndarray, at: np.ndarray, form: np.ndarray, cut1: np.ndarray, cut2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the outputs."""
    sizes = np.diff(at) + np.where(form == "plain", 0, 3 * _MARK)
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    pieces, marks = targets(form, out_at[:-1], cut1 - at[:-1], cut2 - cut1, at[1:] - cut2)
    out = np.empty(out_at[-1], np.uint8)
    starts = np.stack([at[:-1], cut1, cut2], axis=1).ravel()
    for part, to in places(starts, pieces.ravel(), len(body)):
        out[to] = body[part]
    for column, name in enumerate(("prefix", "middle", "suffix")):
        to = marks[form != "plain", column]
        for i, byte in enumerate(MARKERS[name].encode()):
            out[to + i] = byte
    return out_at, out


def gather(body: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the texts that outputs were made from, by output and form alone."""
    moved = form != "plain"
    found = marker_places(body)
    row = np.searchsorted(at, found, "right") - 1
    found = found[moved[row] & (found + _MARK <= at[row + 1])]
    if len(found) != 3 * moved.sum():
        raise ValueError("an output that is not plain must hold three markers")
    found = found.reshape(-1, 3)
    begin, end = at[:-1][moved], at[1:][moved]
    one, two = found[:, 1] - begin - _MARK, found[:, 2] - found[:, 1] - _MARK
    lengths = np.zeros((len(form), 3), np.int64)  # prefix, middle, suffix
    spm = form[moved] == "spm"
    lengths[moved] = np.stack([np.where(spm, two, one), end - found[:, 2] - _MARK, np.where(spm, one, two)], axis=1)
    lengths[~moved, 0] = np.diff(at)[~moved]
    pieces, _ = targets(form, at[:-1], *lengths.T)
    text_at = np.concatenate([[0], np.cumsum(lengths.sum(axis=1))])
    starts = text_at[:-1, None] + np.stack([np.zeros(len(form), np.int64), lengths[:, 0], lengths[:, 0] + lengths[:, 1]], axis=1)
    text = np.empty(text_at[-1], np.uint8)
    for part, source in places(starts.ravel(), pieces.ravel(), len(text)):
        text[part] = body[source]
    return text_at, text


# --- Spark ------------------------------------------------------------------------------

def _transform(incoming: Iterator[pa.RecordBatch], percent: int, spm_percent: int) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        sizes = np.diff(text_bytes(batch["text"])[0])
        for rows in groups(sizes):
            part = batch.slice(rows.start, rows.stop - rows.start)
            at, body = text_bytes(part["text"])
            h1, h2, h3, h4 = (part[f"h{i}"].to_numpy() for i in (1, 2, 3, 4))
            feeds, first, n = line_ends(body, at)
            plain = (np.diff(at) == 0) | rows_with_markers(body, at) | (h3 % 100 >= percent)
            form = np.where(plain, "plain", np.where(h4 % 100 < spm_percent, "spm", "psm"))
            a, b = h1 % (n + 1), h2 % (n + 1)
            cut1 = cut_after(np.minimum(a, b), feeds, first, at)
            cut2 = cut_after(np.maximum(a, b), feeds, first, at)
            out_at, out = scatter(body, at, form, cut1, cut2)
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
                pa.array(char_counts(body, at[:-1], cut1), pa.int64(), mask=plain),
                pa.array(char_counts(body, cut1, cut2), pa.int64(), mask=plain), string_column(out_at, out)], schema=_OUT)


def _restore(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        sizes = np.diff(text_bytes(batch["output"])[0])
        for rows in groups(sizes):
            part = batch.slice(rows.start, rows.stop - rows.start)
            at, body = text_bytes(part["output"])
            text = string_column(*gather(body, at, np.array(part["form"].to_pylist())))
            columns = [*part.columns, text]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "restored"])


def _hash(group: int, seed: int) -> Column:
    """The unsigned number in an 8-digit group (from 0) of the digest of the seeded identifier."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(named, 256), 8 * group + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, seed: int = SEED, percent: int = APPLY_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars (code points, null for plain), output: the whole text in
    its form. ``percent`` of all texts are transformed, ``spm_percent`` of these with the suffix first."""
    rows = ids_and_texts(docs).select("doc_id", "text", *[_hash(i - 1, seed).alias(f"h{i}") for i in (1, 2, 3, 4)])
    return rows.mapInArrow(lambda it: _transform(it, percent, spm_percent),
                           "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(formed: DataFrame) -> DataFrame:
    """Add ``restored``, the text rebuilt from ``output`` and ``form``; a form that misses its markers is an error."""
    schema = formed.drop("restored").schema.add("restored", "string")
    return formed.drop("restored").mapInArrow(_restore, schema)
