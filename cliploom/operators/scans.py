"""Ordered scans that never put a whole key into one task.

A window partitioned by source alone sends a hot source to one task. These
helpers partition by (key, time bucket), scan inside the bucket, and carry the
bucket edges across with a window over one small row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


def with_bucket(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(BUCKET, F.floor(F.col(order) / width))


def _local(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, BUCKET).orderBy(*order)


def _across(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(BUCKET)


def neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str], width: int) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` of the adjacent row of the same key; ``order[0]`` is the time."""
    rows = with_bucket(df, order[0], width)
    packed = F.struct(*columns)
    edges = rows.groupBy(*keys, BUCKET).agg(
        F.min_by(packed, F.struct(*order)).alias("__first"), F.max_by(packed, F.struct(*order)).alias("__last")
    )
    w = _across(keys)
    edges = edges.select(
        *keys, BUCKET, F.lag("__last").over(w).alias("__before"), F.lead("__first").over(w).alias("__after")
    )
    local = _local(keys, order)
    scanned = rows.withColumn("__prev", F.lag(packed).over(local)).withColumn("__next", F.lead(packed).over(local))
    joined = scanned.join(edges, [*keys, BUCKET])
    prev, following = F.coalesce("__prev", "__before"), F.coalesce("__next", "__after")
    return joined.select(
        *df.columns,
        *[prev[c].alias(f"prev_{c}") for c in columns],
        *[following[c].alias(f"next_{c}") for c in columns],
    )


def running(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: int,
    exclusive: bool = False,
) -> DataFrame:
    """Add the running sum of ``value`` per key in ``order``."""
    rows = with_bucket(df, order[0], width).withColumn("__value", value)
    carried = rows.groupBy(*keys, BUCKET).agg(F.sum("__value").alias("__total"))
    carried = carried.select(
        *keys, BUCKET,
        F.sum("__total").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"),
    )
    upto = F.sum("__value").over(_local(keys, order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    scanned = rows.withColumn("__upto", upto)
    return scanned.join(carried, [*keys, BUCKET]).select(
        *df.columns, (F.coalesce("__upto", F.lit(0)) + F.coalesce("__carry", F.lit(0))).alias(name)
    )


def gap_groups(df: DataFrame, keys: list[str], order: list[str], gap: int, name: str, width: int) -> DataFrame:
    """Number the runs of rows whose distance to the row before is at most ``gap``."""
    time = order[0]
    near = neighbours(df, keys, order, [time], width)
    starts = (F.col(f"prev_{time}").isNull() | (F.col(time) - F.col(f"prev_{time}") > gap)).cast("bigint")
    return running(near, keys, order, starts, name, width).select(*df.columns, name)
