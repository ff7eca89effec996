"""Mixing sources to target weights by iterative proportional fitting.

Token counts per (source, language, topic) are raked until their weights meet the target share of every source,
language and topic. ``rate`` is the share of all tokens to sample: a document's probability is its weight times
``rate`` where no cell passes one. Otherwise the probabilities are raked once more, at most one each: a value whose
target is more than its supply gets its supply, full cells are kept whole and the others share what is left, so a
tiny cell does not set the rate of the others. The sample's tokens have the target shares in expectation as far as
the supply allows.

Sources and languages may be as many as they like: cells are a stored table, and every step is an aggregate by one
of the three names, joined back to the cells. Up to ``LOCAL_CELLS`` cells are fitted on the driver with the same
steps, since jobs over so few rows are mostly waiting.

Target shares come from the caller or from the table itself: observed token shares to the power ``temper``, so that
large sources, languages and topics are damped. A value that can't supply its target is kept whole, with probability 1;
by how much targets are missed when the rounds end is ``raking_error``.

Topic of a text: its most frequent word of five or more letters (ties: the smallest), hashed to ``topics`` classes; 0
if it has none. Tokens are words cut at white space, at least one per document. A null source, language or text is a
value of its own: "" for the names, an empty text. Every row is drawn for itself, by its id, its text and its number
among rows that repeat both; null ids make no difference. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import free_name
from flowloom.session import materialize

TOPICS, TEMPER = 8, 0.7
# The share of all tokens in the sample.
RATE = 0.5
ROUNDS, TOLERANCE = 40, 1e-6
NAMES = ("source", "lang", "topic")
LOCAL_CELLS = 50_000
_LONG = regex.compile(r"\p{L}{5,}")

# Target shares of a caller: of each name any values; what they leave is split over the values not named.
Shares = dict[str, dict[object, float]]

FEATURES = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), ("source", pa.string()), ("lang", pa.string()), ("topic", pa.int32()),
                      ("tokens", pa.int64())])


def topic_of(text: str, topics: int) -> int:
    counts = Counter(_LONG.findall(text.lower()))
    if not counts:
        return 0
    most = max(counts.values())
    word = min(w for w, n in counts.items() if n == most)
    return xxhash.xxh3_64_intdigest(word.encode()) % topics


def _features(incoming: Iterator[pa.RecordBatch], topics: int) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        texts = batch["text"].to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["row_key"], batch["source"], batch["lang"],
             pa.array([topic_of(t, topics) for t in texts], pa.int32()),
             pa.array([max(1, len(t.split())) for t in texts], pa.int64())], schema=FEATURES)


def features(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """doc_id, row_key (of id and text), source, lang, topic, tokens of every document."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row_key"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang", "text")])
    return known.mapInArrow(lambda it: _features(it, topics),
                            "doc_id bigint, row_key binary, source string, lang string, topic int, tokens bigint")


def targets(cells: DataFrame, name: str, total: float, temper: float, rate: float | None, given: dict | None = None) -> DataFrame:
    """(name, target): tokens wanted of each value. With a ``rate`` they add up to that share of all tokens, and
    what a value can't supply is wanted of the others. ``given`` shares take the place of the tempered ones."""
    supply = cells.groupBy(name).agg(F.sum("tokens").alias("supply"))
    rows = materialize(supply.withColumn("share", F.pow(F.col("supply") / F.lit(total), F.lit(temper))), "mix-targets")
    if given:
        table = F.create_map(*[F.lit(x) for item in given.items() for x in item])
        named = F.try_element_at(table, F.col(name))
        others = rows.filter(named.isNull()).agg(F.sum("share")).first()[0]
        left = max(0.0, 1.0 - sum(given.values()))
        rows = rows.withColumn("share", F.coalesce(named, F.col("share") * F.lit(left / others if others else 0.0)))
    if rate is None:
        norm = rows.agg(F.sum("share")).first()[0]
        return rows.select(name, (F.col("share") * F.lit(total) / norm).alias("target"))
    scale = 0.0
    while True:  # ends: scale grows until no further value is short
        short = F.col("share") * F.lit(scale) >= F.col("supply")
        whole, free = rows.agg(F.sum(F.when(short, F.col("supply")).otherwise(0)),
                               F.sum(F.when(short, 0.0).otherwise(F.col("share")))).first()
        further = (rate * total - whole) / free if free else scale
        if further <= scale * (1 + 1e-12):
            break
        scale = further
    return rows.select(name, F.least(F.col("share") * F.lit(scale), F.col("supply").cast("double")).alias("target"))


def _local_targets(supply: np.ndarray, total: float, temper: float, rate: float | None, values: list, given: dict | None) -> np.ndarray:
    """``targets`` of arrays."""
    share = (supply / total) ** temper
    if given:
        named = np.array([v in given for v in values])
        others = share[~named].sum()
        share = share * (max(0.0, 1.0 - sum(given.values())) / others if others else 0.0)
        share[named] = [given[v] for v in values if v in given]
    if rate is None:
        return share / share.sum() * total
    scale = 0.0
    while True:
        short = share * scale >= supply
        further = (rate * total - supply[short].sum()) / share[~short].sum() if not short.all() else scale
        if further <= scale * (1 + 1e-12):
            return np.minimum(share * scale, supply)
        scale = further


def _rake_local(cells: DataFrame, temper: float, rounds: int, tolerance: float,
                rate: float | None, shares: Shares) -> tuple[DataFrame, int, float]:
    """``rake`` on the driver."""
    table = cells.toArrow()
    tokens, w = table["tokens"].to_numpy().astype(float), table["w"].to_numpy().copy()
    total = tokens.sum()
    codes, wanted = [], []
    for name in NAMES:
        numbers: dict = {}
        codes.append(np.array([numbers.setdefault(v, len(numbers)) for v in table[name].to_pylist()]))
        wanted.append(_local_targets(np.bincount(codes[-1], tokens), total, temper, rate, list(numbers), shares.get(name)))
    error, done = float("inf"), 0
    while done < rounds and error > tolerance:
        done += 1
        error = 0.0
        for code, target in zip(codes, wanted, strict=True):
            full = w >= 1 if rate is not None else np.zeros(len(w), bool)
            whole = np.bincount(code, np.where(full, tokens, 0.0), len(target))
            part = np.bincount(code, np.where(full, 0.0, tokens * w), len(target))
            left = target - whole
            ratio = np.where(left < 0, target / (whole + part), 1.0)
            grow = (left > 0) & (part > 0)
            ratio[grow] = left[grow] / part[grow]
            error = max(error, np.abs(left - part).max() / total)
            w *= ratio[code]
    fitted = table.set_column(table.schema.get_field_index("w"), "w", pa.array(w))
    return materialize(cells.sparkSession.createDataFrame(fitted, cells.schema), "mix-cells"), done, error


def rake(cells: DataFrame, temper: float = TEMPER, rounds: int = ROUNDS, tolerance: float = TOLERANCE,
         rate: float | None = None, shares: Shares | None = None) -> tuple[DataFrame, int, float]:
    """Iterative proportional fitting of ``cells`` (source, lang, topic, tokens, w): the cells with w fitted, the rounds
    taken and the largest error of a target as a share of all tokens. With a ``rate`` w is at most one where it is
    used, and may pass one meanwhile."""
    if cells.count() <= LOCAL_CELLS:
        return _rake_local(cells, temper, rounds, tolerance, rate, shares or {})
    total = float(cells.agg(F.sum("tokens")).first()[0])
    wanted = {name: materialize(targets(cells, name, total, temper, rate, (shares or {}).get(name)), "mix-targets") for name in NAMES}
    full = F.lit(False) if rate is None else F.col("w") >= 1
    error, done = float("inf"), 0
    while done < rounds and error > tolerance:
        done += 1
        error = 0.0
        for name in NAMES:
            sums = cells.groupBy(name).agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double").alias("whole"),
                                           F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("w"))).alias("part"))
            left = F.col("target") - F.col("whole")
            ratio = F.when((left > 0) & (F.col("part") > 0), left / F.nullif("part", F.lit(0.0))).otherwise(
                F.when(left < 0, F.col("target") / (F.col("whole") + F.col("part"))).otherwise(1.0))
            ratios = materialize(sums.join(wanted[name], name).select(
                name, ratio.alias("ratio"), F.abs(left - F.col("part")).alias("off")), "mix-ratios")
            error = max(error, ratios.agg(F.max("off")).first()[0] / total)
            cells = (cells.join(ratios.drop("off"), name).withColumn("w", F.col("w") * F.col("ratio")).drop("ratio"))
        cells = materialize(cells, "mix-cells")
    return cells, done, error


def row_key() -> Column:
    """Of a row's id and text, both of which may be null."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                                     F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))))


def occurrence() -> Column:
    """Number of a row among those of the same id and text, from 1."""
    return F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))


def sampling_plan(docs: DataFrame, topics: int = TOPICS, temper: float = TEMPER, seed: int = 7,
                  rate: float = RATE, shares: Shares | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, weight (mean 1 over all tokens), probability, kept, and
    raking_error: by how much, as a share of all tokens, the target that is missed most is missed. ``rate`` (above 0, at
    most 1) is the expected share of all tokens that is kept; ``shares`` are the caller's target shares by name."""
    return _plan(docs, topics, temper, seed, rate, shares).drop("row_key")


def _plan(docs: DataFrame, topics: int = TOPICS, temper: float = TEMPER, seed: int = 7, rate: float = RATE,
          shares: Shares | None = None) -> DataFrame:
    rows = materialize(features(docs, topics), "mix-features")
    if rows.isEmpty():
        return rows.select("*", F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability"),
                           F.lit(True).alias("kept"), F.lit(0.0).alias("raking_error"))
    cells = materialize(rows.groupBy(*NAMES).agg(F.sum("tokens").alias("tokens")).withColumn("w", F.lit(1.0)), "mix-cells")
    cells, _, error = rake(cells, temper, shares=shares)
    cells = cells.withColumnRenamed("w", "weight").withColumn("w", F.col("weight") * F.lit(rate))
    if cells.agg(F.max("w")).first()[0] > 1:
        cells, _, error = rake(cells, temper, rate=rate, shares=shares)
    few = cells.count() <= LOCAL_CELLS
    cells = cells.select(*NAMES, "weight", F.least(F.col("w"), F.lit(1.0)).alias("probability"))
    # A source may hold most rows. Few cells are sent to all tasks; more make no cell so large that AQE can't split it.
    return (rows.join(F.broadcast(cells) if few else cells, list(NAMES))
            .withColumn("kept", uniform(seed) < F.col("probability"))
            .select("doc_id", "row_key", "source", "lang", "topic", "tokens", "weight", "probability", "kept",
                    F.lit(float(error)).alias("raking_error")))


def uniform(seed: int) -> Column:
    """A number in [0, 1) that depends on the row's id, its text, its number among equal rows, and the seed."""
    h = F.xxhash64("row_key", occurrence(), F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` sampled row by row by their calibrated probabilities."""
    kept = _plan(docs, **options).filter("kept").groupBy("row_key").agg(F.count(F.lit(1)).alias("n"))
    mine, number, theirs, n = (free_name(docs, base) for base in ("_row_key", "_row_number", "_kept_key", "_kept_rows"))
    # Rows of one key are equal in id and text: as many of them stay as were drawn.
    numbered = docs.withColumn(mine, row_key()).withColumn(
        number, F.row_number().over(Window.partitionBy(mine).orderBy(mine)))
    right = kept.select(F.col("row_key").alias(theirs), F.col("n").alias(n))
    return numbered.join(right, (numbered[mine] == right[theirs]) & (numbered[number] <= right[n]), "left_semi").drop(mine, number)
