"""Interval joins and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000


def interval_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str],
    width: int = MINUTE, how: str = "inner",
) -> DataFrame:
    """Rows whose half-open spans overlap on equal keys: ``r.end > l.start and r.start < l.end``.

    Both sides are spread over the time blocks they touch and joined on (keys,
    block); a pair is kept only in the first block it shares, so nothing repeats.
    Right columns must not clash with left ones except for the keys.
    """
    def blocks(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        low, high = (F.floor(F.col(c) / width) for c in span)
        return df.withColumn(f"__{name}0", low).withColumn("__block", F.explode(F.sequence(low, F.greatest(low, high))))

    if how == "left":
        return _left_interval_join(left, right, keys, left_span, right_span, width)
    a, b = blocks(left, left_span, "a"), blocks(right, right_span, "b")
    hit = (F.col(right_span[1]) > F.col(left_span[0])) & (F.col(right_span[0]) < F.col(left_span[1]))
    joined = a.join(b, [*keys, "__block"]).filter(hit & (F.col("__block") == F.greatest("__a0", "__b0")))
    return joined.drop("__a0", "__b0", "__block")


def _left_interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span, right_span, width: int) -> DataFrame:
    """Every left row with its matches gathered per distinct row and exploded outer, so nulls in the left columns and repeated
    rows neither lose nor repeat anything."""
    rest = [c for c in right.columns if c not in keys]
    name = F.xxhash64(*[F.struct(F.col(c)) for c in left.columns])
    row = F.to_json(F.struct(*left.columns), {"ignoreNullFields": "false"})
    marked = left.withColumn("__row", F.concat(name.cast("string"), F.lit(":"), row))
    spans = marked.select("__row", *keys, *left_span).distinct()
    hits = interval_join(spans, right, keys, left_span, right_span, width).select("__row", *rest)
    return marked.join(hits, "__row", "left").select(*left.columns, *rest)


def point_join(
    points: DataFrame, spans: DataFrame, keys: list[str], point: str, span: tuple[str, str], width: int = MINUTE,
    closed: bool = True,
) -> DataFrame:
    """Points inside spans of the same key; only the spans are spread over blocks."""
    low, high = (F.floor(F.col(c) / width) for c in span)
    b = spans.withColumn("__block", F.explode(F.sequence(low, F.greatest(low, high))))
    a = points.withColumn("__block", F.floor(F.col(point) / width))
    inside = (F.col(point) >= F.col(span[0])) & ((F.col(point) <= F.col(span[1])) if closed else (F.col(point) < F.col(span[1])))
    return a.join(b, [*keys, "__block"]).filter(inside).drop("__block")


def interval_subtract(clips: DataFrame, silences: DataFrame, minimum: int = 1200, margin: int = 750, sliver: int = 100) -> DataFrame:
    """Kept pieces of every clip after long interior silences are taken out.

    Silences shorter than ``minimum`` or within ``margin`` of a clip edge stay;
    pieces of at most ``sliver`` are dropped; a clip that would vanish is kept whole.
    """
    s = silences.select("source_id", F.col("t_ms").alias("__s"), (F.col("t_ms") + F.col("dur_ms")).alias("__e"))
    base = clips.select("clip_id", "source_id", "start_ms", "end_ms")
    hits = interval_join(base, s, ["source_id"], ("start_ms", "end_ms"), ("__s", "__e"))
    cut = hits.select(
        "clip_id", "start_ms", "end_ms", F.greatest("start_ms", "__s").alias("__s"), F.least("end_ms", "__e").alias("__e")
    ).filter(
        (F.col("__e") - F.col("__s") >= minimum) & (F.col("__s") > F.col("start_ms") + margin)
        & (F.col("__e") < F.col("end_ms") - margin)
    )
    closing = base.select("clip_id", "start_ms", "end_ms", F.col("end_ms").alias("__s"), F.col("end_ms").alias("__e"))
    # Silences inside one clip of at most a minute: a short window per clip.
    w = Window.partitionBy("clip_id").orderBy("__s", "__e").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.greatest(F.col("start_ms"), F.coalesce(F.max("__e").over(w), F.col("start_ms")))
    pieces = cut.unionByName(closing).withColumn("source_start", cursor).withColumn("source_end", F.col("__s")).filter(
        F.col("source_end") > F.col("source_start") + sliver
    ).select("clip_id", "source_start", "source_end")
    gone = base.join(pieces.select("clip_id").distinct(), "clip_id", "left_anti").select(
        "clip_id", F.col("start_ms").alias("source_start"), F.col("end_ms").alias("source_end")
    )
    return with_output_offsets(pieces.unionByName(gone))


def with_output_offsets(pieces: DataFrame) -> DataFrame:
    """Position of each kept piece on the output timeline: the kept time before it."""
    w = Window.partitionBy("clip_id").orderBy("source_start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum(F.col("source_end") - F.col("source_start")).over(w)
    return pieces.withColumn("output_start", F.coalesce(before, F.lit(0).cast("bigint")))


def mapped(time: Column, speed: Column | float = 1.0) -> Column:
    """Output time of a source time inside a cut."""
    factor = speed if isinstance(speed, Column) else F.lit(speed)
    return F.col("output_start") + (time - F.col("source_start")) / factor
