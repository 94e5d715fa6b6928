"""Sharding by sampled splitters: size-weighted samples, quantile ranges, overfull ranges split again."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cliploom.llm.storage import partitions, stored

#: Ranges aimed at for each shard (and at least one for each shuffle partition), sampled keys for each range, passes that split overfull ranges.
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 24
PASSES = 24


@dataclass(frozen=True)
class Splitter:
    """First key of a range; ``tie`` is null where the range starts with a whole key."""

    key: int
    tie: int | None


def range_number(splitters: list[Splitter]) -> Column:
    """Number of splitters at or below the row's (key, tie); a splitter without a tie is below all ties of its key."""
    low = np.iinfo(np.int64).min
    marks = np.array([(s.key, low if s.tie is None else s.tie) for s in splitters], np.int64).reshape(-1, 2)

    @F.pandas_udf(IntegerType())
    def numbered(key: pd.Series, tie: pd.Series) -> pd.Series:
        keys, ties = np.concatenate((marks[:, 0], key)), np.concatenate((marks[:, 1], tie))
        is_row = np.arange(len(keys)) >= len(marks)
        order = np.lexsort((is_row, ties, keys))
        seen = np.empty(len(keys), np.int32)
        seen[order] = np.cumsum(~is_row[order])
        return pd.Series(seen[len(marks):])

    return numbered("_key", "_tie")


def _draw(rows: DataFrame, total: float, count: int, turn: int) -> list[tuple[int, int, float]]:
    """About ``count`` (key, tie) of the rows, each with chance in proportion to its size; the same on every run."""
    dice = (F.xxhash64("_key", "_tie", F.lit(turn)).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    chance = F.col("_size") * F.lit(count / max(total, 1.0))
    drawn = rows.filter(dice < chance).select("_key", "_tie", F.greatest(F.lit(1.0), chance).alias("w"))
    return sorted((r[0], r[1], r[2]) for r in drawn.collect())  # about ``count`` rows whatever the input


def _quantiles(drawn: list[tuple[int, int, float]], ranges: int) -> set[Splitter]:
    """Boundaries that share the drawn weight evenly: at a whole key, and inside it where it fills more than one range."""
    weight, step, out, passed, before = sum(w for *_, w in drawn), 0, set(), 0.0, None
    for key, tie, w in drawn:
        passed += w
        if passed >= weight * (step + 1) / ranges:
            step = int(passed * ranges / weight)
            out.add(Splitter(key, tie if key == before else None))
            before = key
    return out


def _ordered(splitters: set[Splitter]) -> list[Splitter]:
    return sorted(splitters, key=lambda s: (s.key, s.tie is not None, s.tie or 0))


def splitters_for(rows: DataFrame, shards: int) -> tuple[list[Splitter], dict[int, tuple[int, int]]]:
    """Splitters and the exact (size, rows) of each range; ``rows`` has _key, _tie and _size.

    A range above twice its share besides its largest row is sampled again and subdivided.
    The driver holds splitters and range totals only: a number set by the shard count, not by the rows."""
    ranges = max(shards * RANGES_PER_SHARD, partitions(rows.sparkSession))
    total = float(rows.agg(F.sum("_size")).first()[0] or 0)
    splitters = _quantiles(_draw(rows, total, ranges * SAMPLES_PER_RANGE, 0), ranges) if total else set()
    for turn in range(1, PASSES + 1):
        ordered = _ordered(splitters)
        numbered = rows.withColumn("_range", range_number(ordered))
        totals = {
            r["_range"]: (r["size"], r["rows"], r["size"] - r["most"]) for r in numbered.groupBy("_range").agg(
                F.sum("_size").alias("size"), F.count("*").alias("rows"), F.max("_size").alias("most")
            ).collect()
        }
        over = [n for n, v in totals.items() if v[2] > 2 * total / ranges]
        added: set[Splitter] = set()
        if over:
            share = float(sum(totals[n][0] for n in over))
            pieces = max(2, round(share * ranges / total))
            picked = numbered.filter(F.col("_range").isin(over))
            added = _quantiles(_draw(picked, share, pieces * SAMPLES_PER_RANGE, turn), pieces)
        if not added - splitters:
            break
        splitters |= added
    return ordered, {n: v[:2] for n, v in totals.items()}


def shard_by_ranges(docs: DataFrame, key: Column, tie: Column, size: Column, shards: int, snap: float = 0.005) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Rows stand in the order (key, tie); shards are consecutive and equal in bytes. Rows of one key stay together
    unless their bytes exceed ``snap`` of a shard; a larger group is cut at the byte where the shard is full.
    A null key or tie stands first; repeated rows get slots of their own; no rows give no rows. Sorting happens only
    inside a range, and no range holds more than twice its share besides its largest row."""
    rows = docs.withColumns({"_key": F.coalesce(key, F.lit(-(2**63))), "_tie": F.coalesce(tie, F.lit(-(2**63))), "_size": size})
    splitters, totals = splitters_for(rows, shards)
    total = sum(s for s, _ in totals.values())
    offsets, bytes_before, rows_before = [], 0, 0
    for n in sorted(totals):
        offsets.append((n, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + totals[n][0], rows_before + totals[n][1]
    spark = docs.sparkSession
    starts = spark.createDataFrame(offsets, "_range int, _bytes long, _rows long")  # one row per range
    inside = Window.partitionBy("_range").orderBy("_key", "_tie", "_size")
    placed = rows.withColumn("_range", range_number(splitters)).join(F.broadcast(starts), "_range").withColumns({
        "_from": F.col("_bytes") + F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"),
        "_place": F.col("_rows") + F.row_number().over(inside) - 1,
    })
    group = Window.partitionBy("_range", "_key")
    full = max(total, 1) / shards
    group_size = F.sum("_size").over(group)
    middle = F.when(group_size <= F.lit(snap * full), F.min("_from").over(group) + group_size / 2).otherwise(
        F.col("_from") + F.col("_size") / 2
    )
    # only a key that fills more than one range is cut by a splitter, and such a key is above the limit anyway
    dealt = stored(
        placed.withColumn("shard", F.least(F.floor(middle / F.lit(full)), F.lit(shards - 1)).cast("int")).drop(
            "_from", "_bytes", "_rows", "_key", "_tie", "_size", "_range"
        ), "dealt",
    )
    first = dealt.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row per shard
    return dealt.join(F.broadcast(first), "shard").withColumn("slot", F.col("_place") - F.col("_first")).drop("_place", "_first")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents by the law ``bytes``: equal texts are neighbours, sizes are UTF-8 bytes plus one.

    Null text has size 1 and crc of the empty text; extra columns are ignored; rows without an id are rows like others."""
    slim = stored(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.encode("text", "utf-8"), F.lit(b""))).alias("text_crc32"),
            F.xxhash64("text").alias("text_key"),
        ), "sizes",
    )
    dealt = shard_by_ranges(slim, F.col("text_key"), F.xxhash64("doc_id"), F.col("size"), shards)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
