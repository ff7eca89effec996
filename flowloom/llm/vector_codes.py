"""Product codes of vectors in exact integers, with LAESA pivots to save distance evaluations.

A vector becomes integers floor(4096 x) and is cut into ``parts`` equal parts. Each part position has a codebook of at
most ``entries`` entries, which starts as that part of the vectors with the smallest identifiers; rounds of
assignment and integer means follow. A part's code is the index of its nearest entry.

Nearest entries are found as in LAESA. The Euclidean distances of every part to a few fixed pivots are computed once
and stored beside the integers. In each round the distances of pivots and entries are computed (a handful), and by the
triangle inequality |d(part, pivot) - d(pivot, entry)| is a lower bound of d(part, entry). Entries are looked at in the
order of their largest bound; the exact squared distance, in 64-bit integers, is evaluated until the bound alone
exceeds the best one. Bounds are floating point and are lowered by more than their rounding, so no nearest entry and
no tie is pruned.

Tasks see one part of the table and give out sums and counts per codebook entry, combined by Spark; the driver holds
the codebooks only. Nothing is shuffled by vector or entry in the rounds, so a vector that a third of all rows share
does no harm; the sums by label use a join that spreads frequent labels.

Vectors that are null, empty, or hold null or non-finite components take no part, and neither do those of another
length than the smallest identifier's. If a length is no multiple of ``parts``, zeros are appended. Rows that repeat are
coded alike, each for itself; equal identifiers are ordered by their components, null ones come last. With fewer
vectors than entries the codebooks are smaller. An empty table gives no rows. Components whose squared distances could
leave the 64-bit range are an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import free_name
from flowloom.operators.lookups import lookup_join
from flowloom.session import materialize

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
# Distances to pivots are stored in single precision: a bound is lowered by this share of the distances it came from.
SLACK = 1e-6

_STORED = "vec_id bigint, label {label}, numbers array<int>, near array<float>"
_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_CODED = pa.schema([("codes", pa.list_(pa.int32())), ("error", pa.int64())])


@dataclass(frozen=True)
class Codebooks:
    """``entries``: (parts, entries, width) integers. ``pivots``: (parts, pivots, width), fixed."""

    entries: np.ndarray
    pivots: np.ndarray

    def digest(self) -> str:
        """Of all entries' integers by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


# --- numpy ------------------------------------------------------------------------------

def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def largest(dims: int) -> int:
    """Integers below this keep every squared distance of ``dims`` dimensions inside 62 bits."""
    return math.isqrt((1 << 62) // max(1, dims)) // 2


def choose_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """Of each part's first entries ``n`` that lie far from each other, beginning with the first."""
    out = []
    for part in entries:
        chosen, gap = [0], squared(part, part[0])
        while len(chosen) < min(n, len(part)):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, squared(part, part[chosen[-1]]))
        out.append(part[chosen])
    return np.stack(out)


def nearest_entries(x: np.ndarray, near: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For the rows of one part: index of the nearest entry (the lowest of several), its squared distance, and how
    many distances were evaluated. ``near`` are the rows' distances to the pivots."""
    between = np.sqrt(squared(pivots[:, None], entries[None]).astype(np.float64))  # pivot, entry
    bound = np.zeros((len(x), len(entries)))
    for p, row in enumerate(between):
        mine = near[:, p, None].astype(np.float64)
        np.maximum(bound, np.abs(mine - row) - SLACK * (mine + row), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.square(np.take_along_axis(bound, order, axis=1))
    best = np.full(len(x), np.iinfo(np.int64).max)
    index = np.full(len(x), len(entries))
    alive, evaluated = np.arange(len(x)), 0
    for place in range(len(entries)):
        # Later bounds are no smaller, so a row that stops here has stopped for good.
        alive = alive[bound[alive, place] <= best[alive] * (1 + SLACK)]
        if not len(alive):
            break
        tried = order[alive, place]
        d = squared(x[alive], entries[tried])
        evaluated += len(alive)
        better = (d < best[alive]) | ((d == best[alive]) & (tried < index[alive]))
        rows = alive[better]
        best[rows], index[rows] = d[better], tried[better]
    return index, best, evaluated


def _matrix(column: pa.Array, shape: tuple[int, ...], kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), *shape)


def assign(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers (rows, parts, width), codes and squared distances (rows, parts) of a batch of stored vectors."""
    parts, _, width = books.entries.shape
    x = _matrix(batch["numbers"], (parts, width), np.int64)
    near = _matrix(batch["near"], (parts, books.pivots.shape[1]), np.float32)
    found = [nearest_entries(x[:, p], near[:, p], books.entries[p], books.pivots[p])[:2] for p in range(parts)]
    return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


# --- Spark ------------------------------------------------------------------------------

def whole_numbers(vector: Column, parts: int, scale: int = SCALE) -> Column:
    """floor(scale x) of all components, zeros appended up to a multiple of ``parts``."""
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.concat(numbers, F.array_repeat(F.lit(0).cast("bigint"), F.pmod(-F.size(vector), F.lit(parts))))


def usable(vector: Column) -> Column:
    """Whether a vector has components and all are finite numbers; a null vector has not."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def _with_pivots(incoming: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, n, width = pivots.shape
    for batch in incoming:
        x = _matrix(batch["numbers"], (parts, width), np.int64)
        near = np.sqrt(squared(x[:, :, None], pivots[None]).astype(np.float64)).astype(np.float32)
        at = np.arange(len(x) + 1, dtype=np.int32) * (parts * n)
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], batch["label"], batch["numbers"], pa.ListArray.from_arrays(at, near.ravel())],
            names=["vec_id", "label", "numbers", "near"])


def _entry_sums(incoming: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    parts, entries, width = books.entries.shape
    n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)

    def filled() -> pa.RecordBatch:
        part, entry = np.nonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
                                           pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], schema=_SUMS)

    rows = 0
    for batch in incoming:
        x, codes, _ = assign(batch, books)
        for p in range(parts):
            n[p] += np.bincount(codes[:, p], minlength=entries)
            np.add.at(sums[p], codes[:, p], x[:, p])
        rows += len(x)
        if rows >= 1 << 30:  # far from where a sum of the largest integers would leave 64 bits
            yield filled()
            rows, n[:], sums[:] = 0, 0, 0
    yield filled()


def _codes(incoming: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        _, codes, gaps = assign(batch, books)
        coded = pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], coded, pa.array(gaps.sum(axis=1), pa.int64())],
                                         names=["vec_id", "label", *_CODED.names])


def prepare(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
            pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks | None]:
    """The stored table (vec_id, label, numbers, near) and the first codebooks; none for an empty table."""
    kept = vectors.filter(usable(F.col(vector)))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"),
                       whole_numbers(F.col(vector), parts).alias("numbers"), F.size(vector).alias("dims"))
    order = (F.col("vec_id").asc_nulls_last(), "numbers")
    lead = rows.orderBy(*order).select("dims").first()
    if lead is None:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("numbers"),
                           F.array().cast("array<float>").alias("near")), None
    rows = rows.filter(F.col("dims") == lead["dims"])
    most = rows.agg(F.max(F.array_max(F.transform("numbers", F.abs))).alias("most")).first()["most"]
    first = np.array([r["numbers"] for r in rows.orderBy(*order).select("numbers").limit(entries).collect()], np.int64)
    if most >= min(largest(first.shape[1]), 1 << 31):
        raise ValueError(f"a component of {most} / {SCALE} is too large for exact 64-bit distances")
    first = first.reshape(len(first), parts, -1).transpose(1, 0, 2)
    books = Codebooks(first, choose_pivots(first, pivots))
    schema = _STORED.format(label=dict(rows.dtypes)["label"])
    narrow = rows.select("vec_id", "label", F.col("numbers").cast("array<int>").alias("numbers"))
    return materialize(narrow.mapInArrow(lambda it: _with_pivots(it, books.pivots), schema), "vector-parts"), books


def refine(stored: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; an unused one stays."""
    width = books.entries.shape[2]
    sums = stored.mapInArrow(lambda it: _entry_sums(it, books), "part int, entry int, n bigint, sums array<bigint>")
    total = sums.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
    entries = books.entries.copy()
    for r in total.collect():  # parts x entries rows
        entries[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return Codebooks(entries, books.pivots)


def train(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
          pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks | None]:
    """The stored table and the final codebooks."""
    stored, books = prepare(vectors, vector, parts, entries, pivots)
    for _ in range(rounds if books else 0):
        books = refine(stored, books)
    return stored, books


def encode(stored: DataFrame, books: Codebooks | None) -> DataFrame:
    """vec_id, label, codes, error (squared distances summed over parts)."""
    label = dict(stored.dtypes)["label"]
    schema = f"vec_id bigint, label {label}, codes array<int>, error bigint"
    if books is None:
        return stored.select("vec_id", "label", F.col("numbers").alias("codes"), F.lit(0).cast("bigint").alias("error"))
    return stored.mapInArrow(lambda it: _codes(it, books), schema)


def decode(coded: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """Add ``approximation``: the entries that the codes name, as numbers of the original scale."""
    table = F.lit([[[x / scale for x in entry] for entry in part] for part in books.entries.tolist()])
    parts = F.transform("codes", lambda c, p: F.element_at(F.element_at(table, p + 1), c + 1))
    return coded.withColumn("approximation", F.flatten(parts))


def compress(vectors: DataFrame, vector: str = "embedding", **options) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (error summed over equal labels, nulls together),
    codebooks_sha256."""
    stored, books = train(vectors, vector, **options)
    coded = encode(stored, books)
    if books is not None:
        coded = materialize(coded, "codes")
    nameless, named = free_name(coded, "nameless"), free_name(coded, "named")
    keyed = coded.withColumn(nameless, F.col("label").isNull()).withColumn(
        named, F.coalesce(F.col("label").cast("string"), F.lit("")))
    by_label = keyed.groupBy(nameless, named).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"),
                                                  F.count(F.lit(1)).alias("weight"))
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 2, "0")), "")
    joined = lookup_join(keyed, by_label, [nameless, named], "weight", ["vec_id"])
    return joined.select("vec_id", hexed.alias("code"), "error", "label_error",
                         F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
