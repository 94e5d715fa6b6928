"""Latest observation, windowed totals, attribution, listings and campaign coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom import config
from cliploom.functions import times
from cliploom.functions.numeric import attribution_bucket, col, ratio

ACTIVITY_SUMS = [
    "views", "engaged_views", "watch_minutes", "likes", "comments", "shares", "subs_gained", "subs_lost",
]
REVENUE_SUMS = ["est_revenue", "ad_revenue", "premium_revenue", "playbacks"]


def first_per_key(df: DataFrame, keys: list, order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key. Spark trims each map partition to ``n`` rows per key
    before the shuffle, so a hot key costs at most ``n`` rows per task."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col(name) <= n
    )
    return ranked if rank else ranked.drop(name)


def latest_observation(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newest collected row per key; ties go to the larger observation id."""
    return first_per_key(df, keys, [F.col("collected_at").desc(), F.col("observation_id").desc()])


def latest_activity(df: DataFrame) -> DataFrame:
    return latest_observation(df, ["owner_id", "scope", "video_id", "report_date"])


def latest_revenue(df: DataFrame) -> DataFrame:
    return latest_observation(df, ["owner_id", "scope", "video_id", "report_date", "currency"])


def window_condition(date, today: str, days: int | None) -> Column:
    """Inclusive window of ``days`` ending today; None keeps everything."""
    return F.lit(True) if days is None else col(date) >= F.date_add(F.lit(today).cast("date"), 1 - days)


def with_windows(df: DataFrame, today: str, date: str = "report_date") -> DataFrame:
    """One copy of each row per report window it belongs to."""
    marks = [F.when(window_condition(date, today, days), F.lit(name)) for name, days in config.LEARNING_WINDOWS]
    return df.withColumn("window", F.explode(F.array_compact(F.array(*marks))))


def weighted_average(value, weight: Column) -> Column:
    """Null values count as 0, rows without a positive weight are skipped."""
    live = weight > 0
    top = F.sum(F.when(live, F.coalesce(col(value).cast("double"), F.lit(0.0)) * weight))
    return top / F.sum(F.when(live, weight))


def activity_weight() -> Column:
    return F.coalesce(F.col("engaged_views"), F.col("views"), F.lit(0).cast("bigint"))


def activity_aggregates() -> list[Column]:
    sums = [F.sum(c).alias(c) for c in ACTIVITY_SUMS]
    return sums + [
        weighted_average("avg_duration", activity_weight()).alias("avg_duration"),
        weighted_average("avg_pct", activity_weight()).alias("avg_pct"),
    ]


def activity_totals(latest: DataFrame, by: list[str]) -> DataFrame:
    return latest.groupBy(*by).agg(*activity_aggregates())


def revenue_aggregates() -> list[Column]:
    weight = F.coalesce(F.col("playbacks"), F.lit(0).cast("bigint"))
    return [F.sum(c).alias(c) for c in REVENUE_SUMS] + [weighted_average("cpm", weight).alias("cpm")]


def revenue_totals(latest: DataFrame, by: list[str]) -> DataFrame:
    return latest.groupBy(*by).agg(*revenue_aggregates())


def period_starts(today: str) -> list[tuple[str, Column]]:
    day = F.lit(today).cast("date")
    return [
        ("today", day), ("last7Days", F.date_add(day, -6)), ("last28Days", F.date_add(day, -27)),
        ("thisMonth", F.trunc(day, "MM")), ("lifetimeCaptured", F.lit("0001-01-01").cast("date")),
    ]


def with_periods(df: DataFrame, today: str, date: str = "report_date") -> DataFrame:
    """One copy of each row per revenue period it falls in; the day itself is the upper end."""
    inside = [
        F.when((col(date) >= start) & (col(date) <= F.lit(today).cast("date")), F.lit(name))
        for name, start in period_starts(today)
    ]
    return df.withColumn("period", F.explode(F.array_compact(F.array(*inside))))


def period_revenue(latest_rev: DataFrame, today: str) -> DataFrame:
    channel = latest_rev.filter("scope = 'CHANNEL'")
    return revenue_totals(with_periods(channel, today), ["owner_id", "currency", "period"])


def derived_rpm(latest_rev: DataFrame, latest_obs: DataFrame, today: str) -> DataFrame:
    """Revenue per thousand channel views and period; null without revenue or views."""
    channel = latest_obs.filter("scope = 'CHANNEL'")
    views = with_periods(channel, today).groupBy("owner_id", "period").agg(F.sum("views").alias("views"))
    joined = period_revenue(latest_rev, today).join(views, ["owner_id", "period"], "left")
    rpm = F.when(F.col("views") > 0, F.col("est_revenue") / F.col("views") * 1000)
    return joined.withColumn("rpm", rpm)


def video_publication_join(by_video: DataFrame, publications: DataFrame, items: DataFrame) -> DataFrame:
    """Video rows with their publication and item, and the published defaults where unmatched."""
    pubs = publications.filter(F.col("video_id").isNotNull()).select(
        "owner_id", "video_id", "short_id", "publish_at"
    )
    details = items.select("short_id", "title", "game", "event_type", "editorial_role", "duration_s")
    return (
        by_video.join(pubs, ["owner_id", "video_id"], "left")
        .join(details, "short_id", "left")
        .withColumn("title", F.coalesce("title", F.lit("Published Short")))
        .withColumn("game", F.coalesce("game", F.lit("Unknown game")))
        .withColumn("event_type", F.coalesce("event_type", F.lit("Unknown event")))
        .withColumn("editorial_role", F.coalesce("editorial_role", F.lit("Unassigned")))
        .withColumn("duration_bucket", attribution_bucket("duration_s"))
        .withColumn("posting_slot", F.coalesce(times.utc_slot_label("publish_at"), F.lit("Unknown slot")))
    )


def revenue_attribution(video_rows: DataFrame) -> DataFrame:
    """Revenue and item count by each of five dimensions, in one pass."""
    dimensions = {
        "game": "game", "event": "event_type", "role": "editorial_role",
        "duration": "duration_bucket", "slot": "posting_slot",
    }
    stack = ", ".join(f"'{name}', {column}" for name, column in dimensions.items())
    long = video_rows.select(
        "owner_id", "currency", "est_revenue", F.expr(f"stack({len(dimensions)}, {stack}) AS (dimension, label)")
    )
    return long.groupBy("owner_id", "currency", "dimension", "label").agg(
        F.coalesce(F.sum("est_revenue"), F.lit(0.0)).alias("est_revenue"), F.count("*").alias("shorts")
    )


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return first_per_key(df, by, order, n, rank="rank")


def paged(df: DataFrame, by: list[str], order: list[Column], page: int, size: int, total: str = "total") -> DataFrame:
    """Rows of one page per key with the key's total; only the rows up to the page are shuffled whole."""
    upto = first_per_key(df, by, order, page * size, rank="row_no").filter(F.col("row_no") > (page - 1) * size)
    return upto.join(df.groupBy(*by).agg(F.count("*").alias(total)), by)


def status_counts(sources: DataFrame, shorts: DataFrame) -> DataFrame:
    ready = shorts.groupBy("owner_id").agg(F.count_if(F.col("state") == "READY").alias("shorts_ready"))
    main = sources.groupBy("owner_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "READY").alias("ready"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status").isin("UPLOADED", "PROCESSING", "ANALYZING")).alias("processing"),
        F.coalesce(F.sum("bytes"), F.lit(0).cast("bigint")).alias("bytes"),
        F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("duration_s"),
    )
    return main.join(ready, "owner_id", "left").withColumn(
        "shorts_ready", F.coalesce("shorts_ready", F.lit(0).cast("bigint"))
    )


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    counted = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def slot_state(slots: DataFrame, publications: DataFrame) -> DataFrame:
    """Publication state of each slot, RESERVED or MISSING where it has none."""
    pubs = publications.select("short_id", F.col("state").alias("publication_state"))
    return slots.join(pubs, "short_id", "left").withColumn(
        "slot_state",
        F.coalesce("publication_state", F.when(F.col("short_id").isNotNull(), "RESERVED").otherwise("MISSING")),
    )


def date_spine(start: str, end: str, name: str = "day") -> Column:
    return F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(name)


def campaign_progress(campaigns: DataFrame, publications: DataFrame, slots: DataFrame) -> DataFrame:
    """Published, scheduled, reserved and missing against the goal of 90 per campaign."""
    pubs = publications.select(
        "owner_id", "publish_at", F.col("short_id").alias("pub_short"), F.col("state").alias("pub_state")
    )
    # Campaigns are a handful of rows per owner, so the date predicate rides on the owner join.
    inside = campaigns.join(pubs, "owner_id").filter(
        times.local_date("publish_at", F.col("timezone")).between(F.col("start_date"), F.col("end_date"))
    )
    done = inside.groupBy("campaign_id").agg(
        F.count_if(F.col("pub_state") == "PUBLISHED").alias("published"),
        F.count_if(F.col("pub_state") == "SCHEDULED").alias("scheduled"),
    )
    live = publications.filter("state <> 'CANCELLED'").select("short_id").distinct()
    open_slots = slots.filter(F.col("short_id").isNotNull()).join(live, "short_id", "left_anti")
    held = (
        campaigns.join(open_slots.select("owner_id", "local_date"), "owner_id")
        .filter(F.col("local_date").between(F.col("start_date"), F.col("end_date")))
        .groupBy("campaign_id").agg(F.count("*").alias("reserved"))
    )
    zero = F.lit(0).cast("bigint")
    joined = campaigns.join(done, "campaign_id", "left").join(held, "campaign_id", "left")
    for name in ("published", "scheduled", "reserved"):
        joined = joined.withColumn(name, F.coalesce(name, zero))
    covered = F.col("published") + F.col("scheduled") + F.col("reserved")
    return joined.withColumn("missing", F.greatest(zero, F.lit(config.CAMPAIGN_GOAL) - covered)).withColumn(
        "coverage_pct",
        F.least(F.lit(100).cast("bigint"), F.floor(covered / config.CAMPAIGN_GOAL * 100 + 0.5).cast("bigint")),
    )


def calendar_fill(slots: DataFrame, start: str, end: str, per_day: int = 3) -> DataFrame:
    """Reserved slots of each owner and calendar day, days without slots included."""
    owners = slots.select("owner_id").distinct()
    spine = owners.select("owner_id", date_spine(start, end, "local_date"))
    reserved = slots.groupBy("owner_id", "local_date").agg(F.count("short_id").alias("reserved"))
    return spine.join(reserved, ["owner_id", "local_date"], "left").select(
        "owner_id", "local_date", F.coalesce("reserved", F.lit(0).cast("bigint")).alias("reserved"),
        F.lit(per_day).alias("goal"),
    )


def slate_buffer(slots: DataFrame, now: Column, per_day: int = 3) -> DataFrame:
    future = F.col("planned_at") > now
    return slots.groupBy("owner_id").agg(
        F.count_if(future & F.col("short_id").isNotNull()).alias("reserved"),
        F.count_if(future & F.col("short_id").isNull()).alias("missing"),
    ).withColumn("days_of_buffer", F.floor(F.col("reserved") / per_day).cast("bigint"))


def segment_metrics(long: DataFrame, measures: list[str]) -> DataFrame:
    """Mean of each measure per segment and its ratio to the mean of the dimension's segments' rows."""
    per = long.groupBy("dimension", "segment").agg(
        F.count("*").alias("sample_size"),
        *[F.sum(F.col(m).cast("double")).alias(f"{m}__sum") for m in measures],
        *[F.count(m).alias(f"{m}__n") for m in measures],
    )
    overall = per.groupBy("dimension").agg(
        *[(F.sum(f"{m}__sum") / F.sum(f"{m}__n")).alias(f"{m}__base") for m in measures]
    )
    joined = per.join(overall, "dimension")
    return joined.select(
        "dimension", "segment", "sample_size",
        *[ratio(F.col(f"{m}__sum"), F.col(f"{m}__n")).alias(m) for m in measures],
        *[ratio(F.col(f"{m}__sum") / F.col(f"{m}__n"), F.col(f"{m}__base")).alias(f"{m}_ratio") for m in measures],
    )
