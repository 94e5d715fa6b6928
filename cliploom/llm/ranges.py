"""Global order without a global task: ranges, totals per range, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.storage import partitions, stored


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name in ``sums``, the sum of its expression over all rows before this one in ``order``.

    Rows are range-partitioned once and written with their range number; a window runs inside each range
    and the ranges' totals (one row per range) give the offsets. ``order`` should be unique up to identical rows."""
    ranged = stored(
        df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_total_{k}") for k, v in sums.items()])
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_total_{k}").over(before), F.lit(0)).alias(f"_offset_{k}") for k in sums]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: bounded by the number of shuffle partitions
    return ranged.withColumns({f"_in_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()}).join(
        F.broadcast(offsets), "_range"
    ).withColumns({k: F.col(f"_in_{k}") + F.col(f"_offset_{k}") for k in sums}).drop(
        "_range", *[f"_in_{k}" for k in sums], *[f"_offset_{k}" for k in sums]
    )
