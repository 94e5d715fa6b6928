"""Features, horizon outcomes, segment lift, strategy versions and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom import config
from cliploom.functions import text, times
from cliploom.functions.numeric import (
    bounded, col, confidence_level, deterministic_arm, half_up, learning_bucket, outcome_score, ratio,
    recommendation_delta, recommendation_direction, score_components,
)
from cliploom.operators.reporting import activity_weight, first_per_key, latest_observation, weighted_average
from cliploom.session import small_or_keyed

DIMENSIONS = [
    "game", "event_type", "duration_bucket", "posting_time", "day_of_week", "hook_type", "opening_frame_style",
    "caption_style", "edit_intensity", "facecam_presence", "emoji_usage", "editorial_role",
]


def extract_features(items: DataFrame, zone: str = "UTC") -> DataFrame:
    """Descriptive features of each published item from its timeline document and schedule."""
    edl = F.col("edl")
    length = F.greatest(F.lit(1.0), edl["output_duration"])
    caption_time = F.aggregate(
        edl["captions"], F.lit(0.0), lambda s, c: s + F.greatest(F.lit(0.0), c["end"] - c["start"])
    )
    actions = (
        F.greatest(F.lit(0), F.size(edl["cuts"]) - 1) + F.size(edl["zooms"]) + F.size(edl["freeze_frames"]) * 2
        + F.size(edl["overlays"]) + F.size(edl["replays"]) * 2
    )
    per_ten = actions / length * 10
    facecam = edl["crop_strategy"] == "GAMEPLAY_PLUS_FACE_CAM"
    local = times.local_time("publish_at", zone)
    return items.select(
        "short_id", "owner_id", "publication_id", "publish_at", "game", "event_type", "duration_s",
        learning_bucket("duration_s").alias("duration_bucket"),
        F.date_format(local, "HH:mm").alias("posting_time"), F.date_format(local, "EEEE").alias("day_of_week"),
        text.hook_type(edl["hook"]).alias("hook_type"),
        F.when(facecam, "FACECAM").otherwise("ACTION").alias("opening_frame_style"),
        F.when(F.size(edl["captions"]) == 0, "NONE").when(caption_time / length < 0.35, "SELECTIVE")
        .otherwise("CAPTION_HEAVY").alias("caption_style"),
        (F.size(edl["captions"]) > 0).alias("caption_usage"),
        F.when(per_ten < 1, "LOW").when(per_ten < 2.5, "MEDIUM").otherwise("HIGH").alias("edit_intensity"),
        facecam.alias("facecam_presence"), F.char_length("title").alias("title_length"),
        text.has_pictograph("title").alias("emoji_usage"), text.hashtag_set(F.col("hashtags")).alias("hashtag_set"),
        F.coalesce("editorial_role", F.lit("UNASSIGNED")).alias("editorial_role"),
    )


def horizon_outcomes(publications: DataFrame, activity: DataFrame, revenue: DataFrame, now: Column) -> DataFrame:
    """Totals of each published item through each horizon, with availability and its reason.

    Rows meet their one publication by video, and all five horizons are summed
    in a single pass, so neither side is multiplied by the horizons.
    """
    pubs = publications.filter(F.col("video_id").isNotNull()).select("owner_id", "video_id", "short_id", "publish_at")
    start = F.to_date("publish_at")

    def cutoff(hours: int) -> Column:
        return F.to_date(F.col("publish_at") + F.expr(f"INTERVAL {hours} HOURS"))

    def inside(hours: int) -> Column:
        return F.col("report_date").between(start, cutoff(hours))

    measures = ["views", "engaged_views", "watch_minutes", "likes", "comments", "shares", "subs_gained", "subs_lost"]
    weight = activity_weight()
    sums = []
    for name, hours, _ in config.HORIZONS:
        here = inside(hours)
        sums += [F.coalesce(F.sum(F.when(here, F.col(m))), F.lit(0)).alias(f"{m}_{name}") for m in measures]
        sums += [
            weighted_average("avg_pct", F.when(here, weight).otherwise(0)).alias(f"avg_pct_{name}"),
            F.count_if(here).alias(f"rows_{name}"), F.max(F.when(here, F.col("report_date"))).alias(f"through_{name}"),
        ]
    keys = ["owner_id", "video_id"]
    seen = latest_observation(activity.filter("scope = 'VIDEO'"), [*keys, "report_date"])
    acted = seen.join(pubs, keys).groupBy(*keys, "short_id", "publish_at").agg(*sums)
    money = latest_observation(revenue.filter("scope = 'VIDEO' AND currency = 'USD'"), [*keys, "report_date"])
    earned = money.join(pubs.drop("short_id"), keys).groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(inside(h), F.col("est_revenue"))), F.lit(0.0)).alias(f"revenue_{n}") for n, h, _ in config.HORIZONS]
    )
    wide = pubs.join(acted.drop("short_id", "publish_at"), keys, "left").join(earned, keys, "left")
    age = F.floor((F.unix_micros(now) - F.unix_micros("publish_at")) / 3_600_000_000).cast("bigint")
    horizons = []
    for name, hours, exact in config.HORIZONS:
        rows = F.coalesce(F.col(f"rows_{name}"), F.lit(0).cast("bigint"))
        available = (age >= hours) & F.lit(not exact) & (rows > 0)
        reason = (
            F.lit("Exact intraday observations are unavailable from the provider daily-report source.")
            if exact
            else F.when(age < hours, f"Waiting until the Short is {hours} hours old.").when(
                rows == 0, "No provider video-level observation is available through this horizon."
            )
        )
        parts = score_components(
            f"views_{name}", f"engaged_views_{name}", f"avg_pct_{name}", f"shares_{name}", f"subs_gained_{name}", F.lit(hours)
        )
        parts = {k: F.coalesce(v, F.lit(0.0)) for k, v in parts.items()}
        only = lambda c, a=available: F.when(a, c)
        horizons.append(F.struct(
            F.lit(name).alias("horizon"), F.lit(hours).alias("hours"), available.alias("available"),
            reason.alias("reason"), F.greatest(F.lit(0).cast("bigint"), age).alias("age_hours"),
            F.col(f"through_{name}").alias("report_through"),
            *[only(F.col(f"{m}_{name}")).alias(m) for m in measures],
            only(F.col(f"avg_pct_{name}")).alias("avg_pct"),
            only(F.coalesce(F.col(f"revenue_{name}"), F.lit(0.0))).alias("est_revenue"),
            only(outcome_score(parts)).alias("performance_score"),
        ))
    return wide.select("owner_id", "video_id", "short_id", "publish_at", F.explode(F.array(*horizons)).alias("h")).select(
        "owner_id", "video_id", "short_id", "publish_at", "h.*"
    )


def best_outcome(outcomes: DataFrame) -> DataFrame:
    """The longest available horizon with a score per item."""
    scored = outcomes.filter("available AND performance_score IS NOT NULL")
    return scored.groupBy("short_id").agg(
        F.max_by("performance_score", "hours").alias("performance_score"), F.max_by("horizon", "hours").alias("horizon")
    )


def feature_outcome_join(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    return features.join(best_outcome(outcomes), "short_id")


def record_windows(records: DataFrame, now: Column) -> DataFrame:
    """One copy of each record per learning window that reaches back to its publication."""
    marks = []
    for name, days in config.LEARNING_WINDOWS:
        keep = F.lit(True) if days is None else F.col("publish_at") >= now - F.expr(f"INTERVAL {days} DAYS")
        marks.append(F.when(keep, F.lit(name)))
    return records.withColumn("window", F.explode(F.array_compact(F.array(*marks))))


def winsor_bounds(records: DataFrame, by: list[str], value: str = "performance_score") -> DataFrame:
    """Order statistics at floor((n-1)·.05) and ceil((n-1)·.95).

    Counts per distinct score come first: scores have two decimals, so a group
    is at most 10 001 rows by the time it is ordered.
    """
    counted = records.groupBy(*by, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*by)
    upto = F.sum("__c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("__upto", upto).withColumn("__n", F.sum("__c").over(w))
    low, high = F.floor((F.col("__n") - 1) * 0.05), F.ceil((F.col("__n") - 1) * 0.95)
    return ranked.groupBy(*by).agg(
        F.max("__n").alias("records"),
        F.min(F.when(F.col("__upto") > low, F.col(value))).alias("low"),
        F.min(F.when(F.col("__upto") > high, F.col(value))).alias("high"),
    )


def recency(now: Column, published: str = "publish_at") -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(published)) / 86_400_000_000.0)
    return F.pow(F.lit(0.5), age / config.HALF_LIFE_DAYS)


def winsorize(records: DataFrame, by: list[str]) -> DataFrame:
    """Scores held within their group's bounds.

    The bounds, one row per group, are found first and counted: few go to every record where it lies, so that records are not
    dealt to as few tasks as there are groups; many are joined by key, which spreads."""
    score = "performance_score"
    clipped = F.greatest(F.col("low"), F.least(F.col("high"), F.col(score)))
    return records.join(small_or_keyed(winsor_bounds(records, by)), by).withColumn("clipped", clipped)


def segment_lift(records: DataFrame, now: Column, by: list[str], minimum: int = config.MIN_SAMPLE) -> DataFrame:
    """Recency-weighted score of every segment of every dimension against its group's baseline."""
    r = winsorize(records, by).filter(F.col("records") >= minimum).withColumn("__w", recency(now))
    stack = ", ".join(f"'{d}', CAST({d} AS STRING)" for d in DIMENSIONS)
    long = r.select(*by, "clipped", "__w", F.expr(f"stack({len(DIMENSIONS)}, {stack}) AS (dimension, segment)"))
    seg = long.groupBy(*by, "dimension", "segment").agg(
        F.count("*").alias("sample_size"), F.sum(F.col("clipped") * F.col("__w")).alias("__top"), F.sum("__w").alias("__bottom")
    )
    # Every record appears once in each dimension, so a dimension's totals are the group's totals.
    w = Window.partitionBy(*by, "dimension")
    scored = (
        seg.withColumn("__segments", F.count("*").over(w))
        .withColumn("__base", F.sum("__top").over(w) / F.sum("__bottom").over(w))
        .withColumn("__score", F.col("__top") / F.col("__bottom"))
    )
    lift = F.coalesce(ratio(F.col("__score") - F.col("__base"), F.col("__base")) * 100, F.lit(0.0))
    return (
        scored.filter((F.col("sample_size") >= minimum) & (F.col("__segments") >= 2))
        .withColumn("__lift", lift)
        .select(
            *by, "dimension", "segment", "sample_size", half_up("__score", 2).alias("score"),
            half_up("__base", 2).alias("baseline"), half_up("__lift", 1).alias("lift_percent"),
            confidence_level("sample_size", "__lift", minimum).alias("confidence"),
        )
    )


def insights(lift: DataFrame, by: list[str], minimum_lift: float = 8.0, limit: int = 12) -> DataFrame:
    """The strongest ``limit`` comparisons per group with their finding and recommendation."""
    order = [F.abs("lift_percent").desc(), F.col("sample_size").desc(), F.col("dimension"), F.col("segment")]
    best = first_per_key(lift.filter(F.abs("lift_percent") >= minimum_lift), by, order, limit, rank="rank")
    return (
        best.withColumn("finding", text.finding_text("segment", "lift_percent", "window"))
        .withColumn("delta", recommendation_delta("lift_percent"))
        .withColumn("direction", recommendation_direction("lift_percent"))
    )


def strongest_insight(found: DataFrame, key: str = "owner_id") -> DataFrame:
    order = [F.col("sample_size").desc(), F.col("window"), F.col("rank")]
    return first_per_key(found.filter("confidence = 'HIGH'"), [key], order)


def apply_recommendation(adjustments: DataFrame, recommended: DataFrame) -> DataFrame:
    """Add each delta to its (owner, dimension, segment) adjustment, clamped to ±0.15."""
    limit = config.MAX_ADJUSTMENT
    keys = ["owner_id", "dimension", "segment"]
    both = adjustments.join(recommended.select(*keys, "delta"), keys, "full_outer")
    moved = bounded(F.coalesce("adjustment", F.lit(0.0)) + F.col("delta"), -limit, limit)
    return both.select(*keys, F.when(F.col("delta").isNull(), F.col("adjustment")).otherwise(moved).alias("adjustment"))


def adjustments_map(adjustments: DataFrame) -> DataFrame:
    """The nested map form of an owner's adjustments."""
    inner = adjustments.groupBy("owner_id", "dimension").agg(
        F.map_from_entries(F.collect_list(F.struct("segment", "adjustment"))).alias("segments")
    )
    return inner.groupBy("owner_id").agg(
        F.map_from_entries(F.collect_list(F.struct("dimension", "segments"))).alias("adjustments")
    )


def predict_performance(items: DataFrame, adjustments: DataFrame, base: str, dimensions: list[str]) -> DataFrame:
    """base · (1 + Σ matched adjustments), 0..100 at 2 decimals; MEDIUM when anything matched."""
    stack = ", ".join(f"'{d}', CAST({d} AS STRING)" for d in dimensions)
    long = items.select("owner_id", "short_id", F.expr(f"stack({len(dimensions)}, {stack}) AS (dimension, segment)"))
    matched = long.join(adjustments, ["owner_id", "dimension", "segment"]).groupBy("short_id").agg(
        F.sum("adjustment").alias("__a"), F.count("*").alias("matched")
    )
    joined = items.join(matched, "short_id", "left")
    score = half_up(bounded(col(base) * (F.lit(1.0) + F.coalesce("__a", F.lit(0.0)))), 2)
    return joined.withColumn("predicted_score", score).withColumn(
        "prediction_confidence", F.when(F.col("matched") > 0, "MEDIUM").otherwise("LOW")
    ).withColumn("matched", F.coalesce("matched", F.lit(0).cast("bigint"))).drop("__a")


def assign_experiments(items: DataFrame, experiments: DataFrame) -> DataFrame:
    """Every item of an owner meets that owner's active experiments (one per dimension at most)."""
    live = experiments.filter("status = 'ACTIVE'").select("owner_id", "experiment_id", "allocation_rate")
    seed = F.concat_ws(":", "experiment_id", F.col("short_id").cast("string"))
    return items.select("owner_id", "short_id").join(live, "owner_id").select(
        "experiment_id", "short_id", deterministic_arm(seed, "allocation_rate").alias("arm")
    )


def experiment_results(assignments: DataFrame, outcomes: DataFrame, experiments: DataFrame) -> DataFrame:
    scored = assignments.join(outcomes.select("short_id", "performance_score"), "short_id")
    arm = lambda name: F.when(F.col("arm") == name, F.col("performance_score"))
    agg = scored.groupBy("experiment_id").agg(
        F.count(arm("CONTROL")).alias("control_sample"), F.avg(arm("CONTROL")).alias("control_score"),
        F.count(arm("VARIANT")).alias("variant_sample"), F.avg(arm("VARIANT")).alias("variant_score"),
    )
    zero = F.lit(0).cast("bigint")
    joined = experiments.join(agg, "experiment_id", "left").withColumn(
        "control_sample", F.coalesce("control_sample", zero)).withColumn("variant_sample", F.coalesce("variant_sample", zero))
    enough = (F.col("control_sample") >= F.col("minimum_sample")) & (F.col("variant_sample") >= F.col("minimum_sample"))
    lift = ratio(F.col("variant_score") - F.col("control_score"), "control_score") * 100
    return joined.withColumn("lift_percent", lift).withColumn(
        "confidence",
        F.when(enough & (F.abs("lift_percent") >= 15), "HIGH").when(enough, "MEDIUM").otherwise("LOW"),
    )


def experiment_transition(experiments: DataFrame, requests: DataFrame) -> DataFrame:
    """New status per requested action; activation conflicts with another active one of the dimension."""
    active = experiments.filter("status = 'ACTIVE'").groupBy("owner_id", "dimension").agg(
        F.count("*").alias("__active"), F.min("experiment_id").alias("__one")
    )
    joined = experiments.join(requests, "experiment_id").join(active, ["owner_id", "dimension"], "left")
    others = F.coalesce("__active", F.lit(0)) - F.when(F.col("status") == "ACTIVE", 1).otherwise(0)
    conflict = (F.col("action") == "ACTIVATE") & (others > 0)
    target = (
        F.when(F.col("action") == "ACTIVATE", "ACTIVE").when(F.col("action") == "PAUSE", "PAUSED")
        .when(F.col("action") == "COMPLETE", "COMPLETED").otherwise("CANCELLED")
    )
    return joined.select(
        "experiment_id", "action", conflict.alias("conflict"),
        F.when(conflict, F.col("status")).otherwise(target).alias("new_status"),
    )


def retry_backoff(runs: DataFrame, base_ms: int = 5000, cap: int = config.MAX_ATTEMPTS) -> DataFrame:
    """A failed attempt either ends the run or waits 2^attempt · base."""
    final = F.col("attempt") >= cap
    return runs.withColumn("next_state", F.when(final, "FAILED").otherwise("RETRYING")).withColumn(
        "delay_ms", F.when(~final, (F.pow(F.lit(2), F.col("attempt")) * base_ms).cast("bigint"))
    )


def readiness(features: DataFrame, minimum: int = config.MIN_SAMPLE) -> DataFrame:
    counted = features.groupBy("owner_id").agg(F.count("*").alias("features"))
    return counted.withColumn("needed", F.greatest(F.lit(0).cast("bigint"), F.lit(minimum) - F.col("features"))).withColumn(
        "ready", F.col("needed") == 0
    )


def insight_apply(found: DataFrame, adjustments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adjustments after the strongest usable insight per owner, and the refused LOW insights."""
    usable = found.filter("confidence <> 'LOW'")
    chosen = first_per_key(usable, ["owner_id"], [F.abs("lift_percent").desc(), F.col("rank"), F.col("window")])
    return apply_recommendation(adjustments, chosen), found.filter("confidence = 'LOW'")


def learning_run(
    items: DataFrame, publications: DataFrame, activity: DataFrame, revenue: DataFrame, adjustments: DataFrame,
    now: Column, zone: str = "UTC",
) -> dict[str, DataFrame]:
    """Features, outcomes, insights per window, and the next strategy, as one set of frames."""
    features = extract_features(items, zone)
    outcomes = horizon_outcomes(publications, activity, revenue, now)
    records = feature_outcome_join(features, outcomes)
    lift = segment_lift(record_windows(records, now), now, ["owner_id", "window"])
    found = insights(lift, ["owner_id", "window"])
    return {
        "features": features, "outcomes": outcomes, "records": records, "insights": found,
        "strategy": apply_recommendation(adjustments, strongest_insight(found)),
    }
