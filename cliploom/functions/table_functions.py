"""Table functions that SQL users call by name; the DataFrame operators of the same names are the faster way.

``register(spark)`` adds

- ``adaptive_samples(TABLE(clips) PARTITION BY (id), maximum)``: the clips with an array ``sample_ms`` of frame times;
- ``slot_instants(TABLE(slots) PARTITION BY id)``: the slots with their UTC instant ``planned_at``.

Spark spreads the rows by the partitioning the caller names; a function sees one row at a time and keeps nothing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, LongType, StructType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from cliploom import config


def _with(table: AnalyzeArgument, name: str, kind) -> AnalyzeResult:
    return AnalyzeResult(StructType([*table.dataType.fields]).add(name, kind))


def sample_times(start: int, event: int, end: int, maximum: int) -> list[int]:
    """Frame times of one clip, as ``operators.events.adaptive_samples`` picks them."""
    p = config.SAMPLING
    limit, radius = max(p["minimum"], min(p["maximum"], maximum)), p["radius"]
    grids = [
        (start, event - radius - 1, p["sparse"]),
        (max(start, event - 3000), event - radius - 1, p["approach"]),
        (max(start, event - radius), min(end, event + radius), p["burst"]),
        (event + radius, min(end, event + p["payoff_span"]), p["payoff"]),
    ]
    times = {start + 100, event, end - 100}.union(*(range(low, high + 1, step) for low, high, step in grids))
    times = sorted({max(start, min(end, t)) for t in times})
    if len(times) <= limit:
        return times
    kept = list(dict.fromkeys([times[0], event, times[-1], *(t for t in times if abs(t - event) <= radius)]))
    rest = [t for t in times if t not in kept]
    while len(kept) < limit and rest:
        kept.append(rest.pop(max(0, math.floor((len(kept) + 1) / limit * (len(rest) - 1) + 0.5))))
    return sorted(kept)[:limit]


class AdaptiveSamples:
    """Clips (start_ms, event_ms, end_ms and any other columns); a clip with a null time has null samples."""

    @staticmethod
    def analyze(clips: AnalyzeArgument, maximum: AnalyzeArgument) -> AnalyzeResult:
        return _with(clips, "sample_ms", ArrayType(LongType()))

    def eval(self, clip: Row, maximum: int) -> Iterator[tuple]:
        times = [clip["start_ms"], clip["event_ms"], clip["end_ms"]]
        yield *clip, None if None in times else sample_times(*times, maximum)


class SlotInstants:
    """Slots (local_date, local_time as HH:mm, zone and any other columns); null for a wall time that is skipped, happens twice or
    is not given."""

    @staticmethod
    def analyze(slots: AnalyzeArgument) -> AnalyzeResult:
        return _with(slots, "planned_at", TimestampType())

    def eval(self, slot: Row) -> Iterator[tuple]:
        given = [slot["local_date"], slot["local_time"], slot["zone"]]
        yield *slot, None if None in given else _instant(*given)


def _instant(day, time: str, zone: str) -> datetime | None:
    wall, place = datetime.fromisoformat(f"{day} {time}"), ZoneInfo(zone)
    found = set()
    for fold in (0, 1):
        instant = wall.replace(tzinfo=place, fold=fold).astimezone(timezone.utc)
        if instant.astimezone(place).replace(tzinfo=None) == wall:
            found.add(instant)
    return found.pop() if len(found) == 1 else None


def register(spark: SparkSession) -> None:
    spark.udtf.register("adaptive_samples", udtf(AdaptiveSamples))
    spark.udtf.register("slot_instants", udtf(SlotInstants))
