"""Joins of many rows to one row per key, safe when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 1000
SALTS = 512


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, spread: list[str],
                relevant: Column | None = None, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """Left join to ``right``, one row per key, where ``weight`` counts the key's left rows.

    Keys holding at least ``1/heavy_keys`` of the total weight form the broadcast side,
    which by that share never has more than ``heavy_keys`` rows. All other keys are
    joined by shuffle. Rows of heavy keys, already served, are dealt over ``SALTS``
    parts by ``spread`` in that shuffle instead of meeting in one task.

    ``relevant`` drops light rows that cannot change the result; heavy rows always
    stay, since they are what keeps their key out of the shuffle.
    """
    cols = [n for n in right.columns if n not in (*keys, weight)]
    total = right.agg(F.sum(weight)).scalar()
    is_heavy = F.col(weight) * heavy_keys >= total
    heavy = right.filter(is_heavy).select(*keys, *[F.col(n).alias(f"_h_{n}") for n in cols],
                                          F.lit(True).alias("_heavy"))
    light = right.filter(~is_heavy if relevant is None else ~is_heavy & relevant)
    light = light.select(*keys, *cols, F.lit(0).alias("_salt"))
    salt = F.when(F.col("_heavy"), F.pmod(F.hash(*spread), F.lit(SALTS)) + 1).otherwise(0)
    return (left.join(F.broadcast(heavy), keys, "left")
            .withColumn("_salt", salt)
            .join(light, [*keys, "_salt"], "left")
            .select(*left.columns,
                    *[F.when(F.col("_heavy"), F.col(f"_h_{n}")).otherwise(F.col(n)).alias(n) for n in cols]))
