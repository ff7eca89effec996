"""As-of join with a table of any size: each row gets the nearest edge at or behind it in its group.

Both sides are united, dealt by range over (group, value) and stored, so that every later step sees the same cut points.
Inside a part the last edge is carried along by a window; a group cut by a part's border takes over the last edge of
the parts before it, which is one row per part and group that goes on. So a group with most rows is cut over many tasks,
no pair of rows is made, and neither side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import materialize

ROWS_PER_PART = 1_000_000


def asof_join(rows: DataFrame, edges: DataFrame, by: list[str], value: str, edge: str, keep: list[str] | None = None,
              forward: bool = False, parts: int | None = None) -> DataFrame:
    """``rows`` with ``edge`` and the ``keep`` columns of the edge row that is nearest to ``value`` and not above it
    (``forward``: not below it) among those with equal ``by``; nulls where there is none.

    An edge equal to the value counts. Null groups meet null groups; a null value meets no edge, a null edge is ignored.
    Of equal edges the one with the largest ``keep`` columns is taken. Names of ``rows`` must differ from ``edge`` and ``keep``.
    """
    keep = keep or []
    taken = F.struct(F.col(edge).alias("edge"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)])
    left = rows.select(F.struct(*by).alias("_g"), F.col(value).alias("_v"), F.struct("*").alias("_row"))
    right = (edges.filter(F.col(edge).isNotNull()).groupBy(F.struct(*by).alias("_g"), F.col(edge).alias("_v"))
             .agg(F.max(taken).alias("_edge")))
    parts = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                         (rows.count() + edges.count()) // ROWS_PER_PART + 1)
    # In the order of the scan an edge stands before the rows of its value.
    toward = F.col("_v").desc() if forward else F.col("_v").asc()
    both = left.filter(F.col("_v").isNotNull()).unionByName(right, allowMissingColumns=True).withColumn("_is_row", F.col("_edge").isNull())
    stored = materialize(both.repartitionByRange(parts, "_g", toward, "_is_row").withColumn("_part", F.spark_partition_id()), "asof")

    inside = Window.partitionBy("_g", "_part").orderBy(toward, "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    carried = stored.withColumn("_last", F.last("_edge", ignorenulls=True).over(inside)).filter("_is_row")
    # The last edge of each part of a group that is cut; neighbouring parts share one group at most.
    ends = stored.groupBy("_g", "_part").agg(_last_of("_edge", toward, forward).alias("_end"))
    group = Window.partitionBy("_g")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    borders = (ends.withColumn("_n", F.count(F.lit(1)).over(group)).filter("_n > 1")
               .select("_g", "_part", F.last("_end", ignorenulls=True).over(before).alias("_before")))
    # At most two rows per part, by the line above.
    same = carried["_g"].eqNullSafe(borders["_g"]) & (carried["_part"] == borders["_part"])
    joined = carried.join(F.broadcast(borders), same, "left").select("_row", F.coalesce("_last", "_before").alias("_found"))
    unmet = left.filter(F.col("_v").isNull()).select("_row", F.lit(None).cast(joined.schema["_found"].dataType).alias("_found"))
    return joined.unionByName(unmet).select(
        "_row.*", F.col("_found.edge").alias(edge), *[F.col(f"_found.k{i}").alias(k) for i, k in enumerate(keep)])


def _last_of(column: str, toward: Column, forward: bool) -> Column:
    """The edge that a scan of the part meets last."""
    return F.min(column) if forward else F.max(column)
