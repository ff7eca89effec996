"""Exact ranks and running sums without a single-task sort.

Two ways to cut the order into slices:

* ``hashed_rank`` orders by an MD5 key, so the first hex digits cut the rows into
  equal slices whatever the data looks like.
* ``running_sums`` orders by values: a range partitioning over (group, order), stored
  once so that every later step sees the same cut points. A group larger than one
  partition is simply cut by it; the sums stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import materialize

def hash_key(keys: list[str], seed: int) -> Column:
    """The seeded order of a permutation: MD5 over seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


# Rows that one task ranks, by hash slices and by range parts.
SLICE_ROWS = 500_000
PART_ROWS = 1_000_000


def slice_digits(n: int) -> int:
    """Hex digits that cut ``n`` hashed rows into slices of ``SLICE_ROWS`` at most, on average."""
    digits = 1
    while n > SLICE_ROWS * 16 ** digits:
        digits += 1
    return digits


def seeded_prefix(stored: DataFrame, keys: list[str], n: int, seed: int = 0) -> Column:
    """Whether a row is among the first ``n`` in the seeded order of ``stored`` (unique ``keys``).

    Counts of three hex digits at a time narrow down where row ``n`` lies, until few enough rows are left to be
    sorted. The answer is a comparison with that row, so the table it is asked of needs no shuffle.
    """
    rows = stored.withColumn("_h", hash_key(keys, seed))
    prefix, left = "", n
    while True:
        counts = {r["s"]: r["n"] for r in rows.groupBy(F.substring("_h", 1, len(prefix) + 3).alias("s"))
                  .agg(F.count(F.lit(1)).alias("n")).collect()}  # 4096 rows at most
        for part in sorted(counts):
            if left <= counts[part]:
                break
            left -= counts[part]
        else:
            return F.lit(n > 0)
        prefix = part
        rows = rows.filter(F.col("_h").startswith(prefix))
        if counts[part] <= SLICE_ROWS or len(prefix) >= 30:
            break
    if left == 0:
        return F.lit(False)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", *keys))
    last = rows.withColumn("_r", rank).filter(F.col("_r") == left).first()
    h = hash_key(keys, seed)
    return (h < F.lit(last["_h"])) | ((h == F.lit(last["_h"])) & (
        F.struct(*keys) <= F.struct(*[F.lit(last[k]).cast(stored.schema[k].dataType).alias(k) for k in keys])))


def hashed_rank(df: DataFrame, keys: list[str], seed: int = 0, within: list[str] | None = None,
                name: str = "rank", digits: int | None = None) -> DataFrame:
    """0-based exact rank of every row in seeded random order, optionally inside groups.

    ``keys`` must be unique. ``within`` may only name columns with few values (size classes, labels): the table of
    slice counts has ``16**digits`` rows per value. Without ``digits`` they follow from the number of rows.
    """
    within = within or []
    digits = digits or slice_digits(df.count())
    rows = df.withColumn("_h", hash_key(keys, seed)).withColumn("_slice", F.substring("_h", 1, digits))
    counts = rows.groupBy(*within, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy("_slice")
    offsets = counts.select(
        *within, "_slice",
        F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*within, "_slice").orderBy("_h", *keys)
    return (rows.withColumn("_local", F.row_number().over(local))
            .join(offsets, [*within, "_slice"])
            .withColumn(name, (F.col("_offset") + F.col("_local") - 1).cast("bigint"))
            .drop("_h", "_slice", "_local", "_offset"))


def running_sums(df: DataFrame, group: list[str], order: list[str], values: list[str],
                 parts: int | None = None) -> DataFrame:
    """Add ``<value>_before`` and ``<value>_total`` per group in ascending ``order``.

    ``df`` must hold one row per (group, order): aggregate ties first, which also
    takes care of a value shared by many rows. The number of parts follows the rows: a part's
    window is one task, which the runtime can't split.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(least, -(-df.count() // PART_ROWS))
    rows = materialize(df.repartitionByRange(parts, *group, *order)
                       .withColumn("_part", F.spark_partition_id()), "ranged")
    local = Window.partitionBy(*group, "_part")
    before = local.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_part").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    # Only groups met in several range partitions need an offset. Neighbouring
    # partitions share at most one group, so these are at most 2 * parts rows.
    offsets = (sums.withColumn("_n", F.count(F.lit(1)).over(whole)).filter("_n > 1")
               .select(*group, "_part",
                       *[F.coalesce(F.sum(f"_s_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values],
                       *[F.sum(f"_s_{v}").over(whole).alias(f"_t_{v}") for v in values]))
    out = rows
    for v in values:
        out = (out.withColumn(f"{v}_before", F.coalesce(F.sum(v).over(before), F.lit(0)))
               .withColumn(f"{v}_total", F.sum(v).over(local)))
    out = out.join(F.broadcast(offsets), [*group, "_part"], "left")
    for v in values:
        out = (out.withColumn(f"{v}_before", F.col(f"{v}_before") + F.coalesce(f"_o_{v}", F.lit(0)))
               .withColumn(f"{v}_total", F.coalesce(f"_t_{v}", f"{v}_total"))
               .drop(f"_o_{v}", f"_t_{v}"))
    return out.drop("_part")


def sorted_rank(df: DataFrame, order: list[str], group: list[str] | None = None,
                name: str = "rank", parts: int | None = None) -> DataFrame:
    """0-based exact rank in ascending ``order`` (unique inside a group)."""
    ranked = running_sums(df.withColumn("_one", F.lit(1)), group or [], order, ["_one"], parts)
    return ranked.withColumn(name, F.col("_one_before").cast("bigint")).drop("_one", "_one_before", "_one_total")


def first_few(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group for a small ``n`` (a report cap): for those Spark limits groups before it
    shuffles them, so at most ``n`` rows of a group leave a task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_n(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, or of the table; ``order`` must be unique inside a group. ``n`` may be
    any number and a group may be most of the table: a range partitioning cuts it, and no task holds a whole group."""
    return sorted_rank(df, order, group, "_rank").filter(F.col("_rank") < n).drop("_rank")
