"""Peaks, silences and summaries of per-source sample series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions import evidence
from cliploom.functions.numeric import bounded
from cliploom.operators import scans

SIGNAL_LIMIT = 10_000
SECOND = 1000
SERIES_BUCKET = 600 * SECOND


def signal_cap(signals: DataFrame, limit: int = SIGNAL_LIMIT) -> DataFrame:
    """The first ``limit`` signals of each source in time order, the published size of a signal list.

    Everything downstream of this cap may treat a source as a bounded group.
    """
    numbered = scans.running(signals, ["source_id"], ["t_ms", "signal_id"], F.lit(1).cast("bigint"), "__n", SERIES_BUCKET)
    return numbered.filter(F.col("__n") <= limit).drop("__n")


def motion_peaks(frames: DataFrame, value: str = "luma") -> DataFrame:
    """Local maxima above the scene threshold (mean + 3 sd) or the motion threshold (mean + 1.25 sd)."""
    near = scans.neighbours(frames, ["source_id"], ["t_ms"], [value], SERIES_BUCKET)
    stats = frames.groupBy("source_id").agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    v = F.col(value)
    peak = (v >= F.coalesce(f"prev_{value}", F.lit(-1.0))) & (v >= F.coalesce(f"next_{value}", F.lit(-1.0)))
    scene = F.greatest(F.lit(0.18), F.col("__mean") + F.col("__sd") * 3)
    motion = F.greatest(F.lit(0.04), F.col("__mean") + F.col("__sd") * 1.25)
    kind = F.when(peak & (v >= scene), "SCENE_CHANGE").when(peak & (v >= motion), "MOTION_PEAK")
    return near.join(stats, "source_id").select("source_id", "t_ms", kind.alias("kind"), v.alias("value")).filter(
        F.col("kind").isNotNull()
    )


def audio_peaks(loudness: DataFrame) -> DataFrame:
    """Local loudness maxima at or above min(-8, mean + max(3, 1.5 sd)) dB."""
    near = scans.neighbours(loudness, ["source_id"], ["t_ms"], ["db"], SERIES_BUCKET)
    stats = loudness.groupBy("source_id").agg(F.avg("db").alias("__mean"), F.stddev_pop("db").alias("__sd"))
    floor = F.least(F.lit(-8.0), F.col("__mean") + F.greatest(F.lit(3.0), F.col("__sd") * 1.5))
    low = F.lit(float("-inf"))
    peak = (F.col("db") >= F.coalesce("prev_db", low)) & (F.col("db") >= F.coalesce("next_db", low))
    return near.join(stats, "source_id").filter(peak & (F.col("db") >= floor)).select(
        "source_id", "t_ms", F.lit("AUDIO_PEAK").alias("kind"), F.col("db").alias("value")
    )


def silence_runs(loudness: DataFrame, level: float = -45.0, minimum_ms: int = 1500, step_ms: int = 500) -> DataFrame:
    """Runs of samples at or below ``level``: start, length to the next loud sample, lowest value."""
    near = scans.neighbours(loudness, ["source_id"], ["t_ms"], ["t_ms"], SERIES_BUCKET)
    loud = (F.col("db") > level).cast("bigint")
    numbered = scans.running(near, ["source_id"], ["t_ms"], loud, "__run", SERIES_BUCKET)
    end = F.max(F.coalesce(F.col("next_t_ms"), F.col("t_ms") + step_ms))
    return (
        numbered.filter(F.col("db") <= level).groupBy("source_id", "__run")
        .agg(F.min("t_ms").alias("t_ms"), end.alias("__end"), F.min("db").alias("value"))
        .select("source_id", "t_ms", (F.col("__end") - F.col("t_ms")).alias("dur_ms"), "value")
        .filter(F.col("dur_ms") >= minimum_ms)
    )


def signal_summary(frames: DataFrame, loudness: DataFrame, points: int = 400) -> DataFrame:
    """Mean and maximum motion and loudness, and every k-th loudness sample (at most ``points``)."""
    motion = frames.groupBy("source_id").agg(F.avg("luma").alias("mean_motion"), F.max("luma").alias("max_motion"))
    loud = loudness.groupBy("source_id").agg(
        F.avg("db").alias("mean_db"), F.max("db").alias("max_db"), F.count("*").alias("samples")
    )
    numbered = scans.running(
        loudness, ["source_id"], ["t_ms"], F.lit(1).cast("bigint"), "__n", SERIES_BUCKET, exclusive=True
    )
    stride = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("samples") / points))
    wave = (
        numbered.join(loud.select("source_id", "samples"), "source_id").filter(F.col("__n") % stride == 0)
        .groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("__n", "db"))).alias("__w"))
        .select("source_id", F.transform("__w", lambda s: s["db"]).alias("waveform"))
    )
    return motion.join(loud, "source_id", "full_outer").join(wave, "source_id", "left")


def signal_counts(signals: DataFrame) -> DataFrame:
    kinds = {"SCENE_CHANGE": "scene", "MOTION_PEAK": "motion_peak", "AUDIO_PEAK": "audio_peak", "SILENCE": "silence"}
    return signals.groupBy("source_id").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"{name}_count") for kind, name in kinds.items()]
    )


def rms_loudness(samples: DataFrame, window_ms: int = 500) -> DataFrame:
    """20 log10 of the root mean square per half-second window."""
    rms = F.sqrt(F.avg(F.col("sample") * F.col("sample")))
    return samples.groupBy("source_id", F.floor(F.col("t_ms") / window_ms).alias("window_no")).agg(
        (F.log10(F.greatest(rms, F.lit(1e-6))) * 20).alias("db")
    )


def track_jitter(points: DataFrame) -> DataFrame:
    """Mean step length, missing share and blended confidence of a tracked point per source."""
    seen = points.filter(~F.col("missing"))
    near = scans.neighbours(seen, ["source_id"], ["t_ms"], ["x", "y"], SERIES_BUCKET)
    step = F.hypot(F.col("x") - F.col("prev_x"), F.col("y") - F.col("prev_y"))
    moved = near.groupBy("source_id").agg(F.avg(step).alias("__step"), F.avg("confidence").alias("mean_confidence"))
    frames = points.groupBy("source_id").agg(
        F.count("*").alias("frames"), F.count_if(F.col("missing")).alias("missing_frames")
    )
    jitter = F.coalesce("__step", F.lit(1.0))
    missing = F.col("missing_frames") / F.col("frames")
    mean = F.coalesce("mean_confidence", F.lit(0.0))
    blend = mean * 0.65 + (F.lit(1.0) - missing) * 0.25 + (F.lit(1.0) - F.least(F.lit(1.0), jitter * 4)) * 0.1
    return frames.join(moved, "source_id", "left").select(
        "source_id", jitter.alias("jitter"), missing.alias("missing_ratio"), bounded(blend, 0.0, 1.0).alias("confidence")
    )


def frame_differences(frames: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Luma difference of every frame to the frame before it."""
    near = scans.neighbours(frames, ["source_id"], ["t_ms"], [pixels], SERIES_BUCKET)
    return near.filter(F.col(f"prev_{pixels}").isNotNull()).select(
        "source_id", "t_ms", evidence.frame_difference(pixels, f"prev_{pixels}").alias("value")
    )


def motion_centroid(frames: DataFrame, width: int, height: int, pixels: str = "pixels") -> DataFrame:
    """Difference-weighted centre of the changed pixels of each frame; null when too few changed."""
    near = scans.neighbours(frames, ["source_id"], ["t_ms"], [pixels], SERIES_BUCKET).filter(
        F.col(f"prev_{pixels}").isNotNull()
    )
    gap = F.zip_with(pixels, f"prev_{pixels}", lambda a, b: F.abs(a - b))
    weights = F.transform(gap, lambda d: F.when(d >= 24, d - 23).otherwise(0))
    size = width * height

    def weighted(at) -> Column:
        return F.aggregate(F.transform(F.col("__w"), at), F.lit(0).cast("bigint"), lambda s, v: s + v)

    mass = weighted(lambda w, i: w.cast("bigint"))
    active = F.size(F.filter("__w", lambda w: w > 0))
    usable = (F.col("__mass") > 0) & (F.col("__active") >= size * 0.002)
    return (
        near.withColumn("__w", weights).withColumn("__mass", mass).withColumn("__active", active)
        .select(
            "source_id", "t_ms", (~usable).alias("missing"),
            F.when(usable, weighted(lambda w, i: (w * (i % width)).cast("bigint")) / F.col("__mass") / (width - 1)).alias("x"),
            F.when(usable, weighted(lambda w, i: (w * F.floor(i / width)).cast("bigint")) / F.col("__mass") / (height - 1)).alias("y"),
            F.when(usable, bounded(F.col("__active") / size / 0.12, 0.0, 1.0)).alias("confidence"),
        )
    )


def frame_diversity(frames: DataFrame, key: str, digest: str) -> DataFrame:
    return frames.groupBy(key).agg(
        F.count("*").alias("sampled_frames"), F.countDistinct(digest).alias("unique_frames")
    )
