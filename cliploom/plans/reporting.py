"""Reporting queries."""

from pyspark.sql import functions as F

from cliploom.functions import times
from cliploom.functions.numeric import attribution_bucket, duration_class, learning_bucket
from cliploom.operators import reporting as r
from cliploom.plans.common import day, rounded, stamp
from cliploom.plans.registry import query
from cliploom.sources.tables import TODAY

ACT = """CAST(sum(views) AS BIGINT) AS views, CAST(sum(engaged_views) AS BIGINT) AS engaged_views,
  round(sum(watch_minutes), 6) AS watch_minutes, CAST(sum(likes) AS BIGINT) AS likes,
  CAST(sum(comments) AS BIGINT) AS comments, CAST(sum(shares) AS BIGINT) AS shares,
  CAST(sum(subs_gained) AS BIGINT) AS subs_gained, CAST(sum(subs_lost) AS BIGINT) AS subs_lost,
  round(sum(coalesce(avg_duration, 0) * coalesce(engaged_views, views, 0)) FILTER (coalesce(engaged_views, views, 0) > 0)
    / sum(coalesce(engaged_views, views, 0)) FILTER (coalesce(engaged_views, views, 0) > 0), 6) AS avg_duration,
  round(sum(coalesce(avg_pct, 0) * coalesce(engaged_views, views, 0)) FILTER (coalesce(engaged_views, views, 0) > 0)
    / sum(coalesce(engaged_views, views, 0)) FILTER (coalesce(engaged_views, views, 0) > 0), 6) AS avg_pct"""
REV = """round(sum(est_revenue), 6) AS est_revenue, round(sum(ad_revenue), 6) AS ad_revenue,
  round(sum(premium_revenue), 6) AS premium_revenue, CAST(sum(playbacks) AS BIGINT) AS playbacks,
  round(sum(cpm * playbacks) FILTER (playbacks > 0) / sum(playbacks) FILTER (playbacks > 0), 6) AS cpm"""


@query("latest_observation", """
SELECT owner_id, scope, video_id, strftime(report_date, '%Y-%m-%d') AS report_date, observation_id, views, engaged_views
FROM latest_obs""")
def _(t):
    return r.latest_activity(t.observation).select(
        "owner_id", "scope", "video_id", day("report_date").alias("report_date"), "observation_id", "views", "engaged_views"
    )


@query("latest_by_day", """
SELECT video_id, strftime(report_date, '%Y-%m-%d') AS report_date, observation_id, est_revenue
FROM revenue WHERE scope = 'VIDEO' AND currency = 'USD'
QUALIFY row_number() OVER (PARTITION BY video_id, report_date ORDER BY collected_at DESC, observation_id DESC) = 1""")
def _(t):
    rows = t.revenue.filter("scope = 'VIDEO' AND currency = 'USD'")
    return r.latest_observation(rows, ["video_id", "report_date"]).select(
        "video_id", day("report_date").alias("report_date"), "observation_id", "est_revenue"
    )


@query("activity_totals", f"SELECT owner_id, scope, {ACT} FROM latest_obs GROUP BY owner_id, scope")
def _(t):
    out = r.activity_totals(r.latest_activity(t.observation), ["owner_id", "scope"])
    return rounded(out, "watch_minutes", "avg_duration", "avg_pct")


@query("window_filter", f"""
SELECT owner_id, w AS "window", CAST(count(*) AS BIGINT) AS report_rows, {ACT}
FROM latest_obs JOIN (VALUES ('7', 7), ('28', 28), ('90', 90), ('lifetime', 100000)) AS ws(w, days)
  ON report_date >= DATE '2024-01-31' + (1 - days)
WHERE scope = 'CHANNEL' GROUP BY owner_id, w""")
def _(t):
    channel = r.latest_activity(t.observation.filter("scope = 'CHANNEL'"))
    out = r.with_windows(channel, TODAY).groupBy("owner_id", "window").agg(
        F.count("*").alias("report_rows"), *r.activity_aggregates()
    )
    return rounded(out, "watch_minutes", "avg_duration", "avg_pct")


@query("revenue_totals", f"SELECT owner_id, scope, currency, {REV} FROM latest_rev GROUP BY owner_id, scope, currency")
def _(t):
    out = r.revenue_totals(r.latest_revenue(t.revenue), ["owner_id", "scope", "currency"])
    return rounded(out, "est_revenue", "ad_revenue", "premium_revenue", "cpm")


PERIODS = """(VALUES ('today', DATE '2024-01-31'), ('last7Days', DATE '2024-01-25'), ('last28Days', DATE '2024-01-04'),
  ('thisMonth', DATE '2024-01-01'), ('lifetimeCaptured', DATE '0001-01-01')) AS p(period, since)"""


@query("period_revenue", f"""
SELECT owner_id, currency, period, {REV} FROM latest_rev JOIN {PERIODS}
  ON report_date >= since AND report_date <= DATE '2024-01-31'
WHERE scope = 'CHANNEL' GROUP BY owner_id, currency, period""")
def _(t):
    out = r.period_revenue(r.latest_revenue(t.revenue.filter("scope = 'CHANNEL'")), TODAY)
    return rounded(out, "est_revenue", "ad_revenue", "premium_revenue", "cpm")


@query("derived_rpm", f"""
WITH rev AS (
  SELECT owner_id, currency, period, sum(est_revenue) AS est_revenue FROM latest_rev JOIN {PERIODS}
    ON report_date >= since AND report_date <= DATE '2024-01-31' WHERE scope = 'CHANNEL' GROUP BY ALL),
act AS (
  SELECT owner_id, period, CAST(sum(views) AS BIGINT) AS views FROM latest_obs JOIN {PERIODS}
    ON report_date >= since AND report_date <= DATE '2024-01-31' WHERE scope = 'CHANNEL' GROUP BY ALL)
SELECT rev.owner_id, currency, rev.period, views, round(est_revenue, 6) AS est_revenue,
  CASE WHEN views > 0 THEN round(est_revenue / views * 1000, 6) END AS rpm
FROM rev LEFT JOIN act ON rev.owner_id = act.owner_id AND rev.period = act.period""")
def _(t):
    out = r.derived_rpm(
        r.latest_revenue(t.revenue.filter("scope = 'CHANNEL'")),
        r.latest_activity(t.observation.filter("scope = 'CHANNEL'")), TODAY,
    )
    return rounded(out.select("owner_id", "currency", "period", "views", "est_revenue", "rpm"), "est_revenue", "rpm")


def video_revenue(t):
    rows = r.latest_revenue(t.revenue.filter("scope = 'VIDEO'"))
    by_video = r.revenue_totals(rows, ["owner_id", "video_id", "currency"])
    return r.video_publication_join(by_video, t.publication, t.short)


VIDEO_REV = f"""
  SELECT b.owner_id, b.video_id, currency, est_revenue, playbacks, s.short_id,
    coalesce(s.title, 'Published Short') AS title, coalesce(s.game, 'Unknown game') AS game,
    coalesce(s.event_type, 'Unknown event') AS event_type, coalesce(s.editorial_role, 'Unassigned') AS editorial_role,
    CASE WHEN s.duration_s IS NULL THEN 'Unknown duration' WHEN s.duration_s < 20 THEN 'Under 20s'
      WHEN s.duration_s < 40 THEN '20–39s' ELSE '40s+' END AS duration_bucket,
    CASE WHEN p.publish_at IS NULL THEN 'Unknown slot' ELSE strftime(p.publish_at, '%H') || ':00 UTC' END AS posting_slot
  FROM (SELECT owner_id, video_id, currency, {REV} FROM latest_rev WHERE scope = 'VIDEO' GROUP BY ALL) b
  LEFT JOIN (SELECT * FROM publication WHERE video_id IS NOT NULL) p ON p.owner_id = b.owner_id AND p.video_id = b.video_id
  LEFT JOIN short s ON s.short_id = p.short_id"""


@query("video_publication_join", VIDEO_REV)
def _(t):
    return rounded(video_revenue(t), "est_revenue").select(
        "owner_id", "video_id", "currency", "est_revenue", "playbacks", "short_id", "title", "game", "event_type",
        "editorial_role", "duration_bucket", "posting_slot",
    )


@query("revenue_attribution", f"""
WITH v AS ({VIDEO_REV})
SELECT owner_id, currency, dimension, label, round(coalesce(sum(est_revenue), 0), 4) AS est_revenue, count(*) AS shorts
FROM (SELECT owner_id, currency, est_revenue, unnest(['game', 'event', 'role', 'duration', 'slot']) AS dimension,
        unnest([game, event_type, editorial_role, duration_bucket, posting_slot]) AS label FROM v)
GROUP BY ALL""")
def _(t):
    return rounded(r.revenue_attribution(rounded(video_revenue(t), "est_revenue")), "est_revenue", digits=4)


@query("top_revenue", f"""
WITH v AS ({VIDEO_REV})
SELECT owner_id, currency, video_id, title, est_revenue,
  CAST(row_number() OVER (PARTITION BY owner_id, currency ORDER BY est_revenue DESC NULLS LAST, video_id) AS INTEGER) AS rank
FROM v QUALIFY rank <= 10""")
def _(t):
    order = [F.col("est_revenue").desc_nulls_last(), F.col("video_id")]
    return r.top_n(rounded(video_revenue(t), "est_revenue"), ["owner_id", "currency"], order, 10).select(
        "owner_id", "currency", "video_id", "title", "est_revenue", "rank"
    )


@query("top_shorts", f"""
WITH b AS (SELECT owner_id, video_id, {ACT} FROM latest_obs WHERE scope = 'VIDEO' GROUP BY ALL)
SELECT b.owner_id, b.video_id, p.short_id, coalesce(s.title, 'Published Short') AS title, views, engaged_views,
  avg_pct,
  CAST(row_number() OVER (PARTITION BY b.owner_id ORDER BY coalesce(engaged_views, views, 0) DESC, b.video_id) AS INTEGER) AS rank
FROM b LEFT JOIN (SELECT * FROM publication WHERE video_id IS NOT NULL) p ON p.owner_id = b.owner_id AND p.video_id = b.video_id
LEFT JOIN short s ON s.short_id = p.short_id QUALIFY rank <= 10""")
def _(t):
    by_video = r.activity_totals(r.latest_activity(t.observation.filter("scope = 'VIDEO'")), ["owner_id", "video_id"])
    order = [r.activity_weight().desc(), F.col("video_id")]
    top = r.top_n(by_video, ["owner_id"], order, 10)
    joined = r.video_publication_join(top, t.publication, t.short)
    return rounded(joined, "avg_pct").select(
        "owner_id", "video_id", "short_id", "title", "views", "engaged_views", "avg_pct", "rank"
    )


@query("daily_series", """
SELECT owner_id, strftime(report_date, '%Y-%m-%d') AS report_date, views, engaged_views, watch_minutes
FROM latest_obs WHERE scope = 'CHANNEL'""")
def _(t):
    channel = r.latest_activity(t.observation.filter("scope = 'CHANNEL'"))
    return channel.select("owner_id", day("report_date").alias("report_date"), "views", "engaged_views", "watch_minutes") \
        .orderBy("owner_id", "report_date")


@query("subscriber_delta", """
SELECT owner_id, observation_id, subs_gained - subs_lost AS subscriber_delta FROM latest_obs WHERE scope = 'CHANNEL'""")
def _(t):
    channel = r.latest_activity(t.observation.filter("scope = 'CHANNEL'"))
    return channel.select("owner_id", "observation_id", (F.col("subs_gained") - F.col("subs_lost")).alias("subscriber_delta"))


@query("status_counts", """
SELECT s.owner_id, count(*) AS total, count(*) FILTER (status = 'READY') AS ready, count(*) FILTER (status = 'FAILED') AS failed,
  count(*) FILTER (status IN ('UPLOADED', 'PROCESSING', 'ANALYZING')) AS processing,
  CAST(sum(bytes) AS BIGINT) AS bytes, round(coalesce(sum(s.duration_s), 0), 6) AS duration_s, any_value(k.shorts_ready) AS shorts_ready
FROM source s LEFT JOIN (SELECT owner_id, count(*) FILTER (state = 'READY') AS shorts_ready FROM short GROUP BY 1) k
  ON k.owner_id = s.owner_id GROUP BY s.owner_id""")
def _(t):
    return rounded(r.status_counts(t.source, t.short), "duration_s")


@query("job_state_counts", """
SELECT s.owner_id, state, count(*) AS jobs FROM job JOIN source s ON s.source_id = job.source_id GROUP BY ALL""")
def _(t):
    return t.job.join(t.source.select("source_id", "owner_id"), "source_id").groupBy("owner_id", "state").agg(
        F.count("*").alias("jobs")
    )


@query("ai_usage_totals", """
SELECT model, count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
  round(coalesce(sum((input_tokens * 2.5 + output_tokens * 10.0) / 1000000), 0), 8) AS cost_usd FROM ai_cache GROUP BY model""")
def _(t):
    from cliploom.functions.numeric import token_cost

    zero = F.lit(0).cast("bigint")
    return t.ai_cache.groupBy("model").agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("input_tokens"), zero).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), zero).alias("output_tokens"),
        F.round(F.coalesce(F.sum(token_cost("input_tokens", "output_tokens", 2.5, 10.0)), F.lit(0.0)), 8).alias("cost_usd"),
    )


@query("child_counts", """
SELECT s.source_id, filename, count(k.short_id) AS shorts FROM source s LEFT JOIN short k ON k.source_id = s.source_id
GROUP BY s.source_id, filename""")
def _(t):
    return r.child_counts(t.source.select("source_id", "filename"), t.short, "source_id", "shorts")


@query("source_search", """
SELECT source_id, filename, status FROM source WHERE status = 'READY' AND filename ILIKE '%GTA%'""")
def _(t):
    return t.source.filter((F.col("status") == "READY") & F.col("filename").ilike("%GTA%")).select(
        "source_id", "filename", "status"
    )


@query("owner_scope", """
SELECT job_id, s.owner_id FROM job JOIN source s ON s.source_id = job.source_id WHERE s.owner_id = 3""")
def _(t):
    owned = t.source.filter("owner_id = 3").select("source_id", "owner_id")
    return t.job.select("job_id", "source_id").join(owned, "source_id").select("job_id", "owner_id")


@query("paged_listing", """
SELECT owner_id, short_id, title, row_no, total FROM (
  SELECT owner_id, short_id, title, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, short_id) AS INTEGER) AS row_no,
    count(*) OVER (PARTITION BY owner_id) AS total FROM short) WHERE row_no BETWEEN 26 AND 50""")
def _(t):
    order = [F.col("created_at").desc(), F.col("short_id")]
    return r.paged(t.short, ["owner_id"], order, 2, 25).select("owner_id", "short_id", "title", "row_no", "total")


@query("nulls_last_multikey", """
SELECT source_id, short_id, CAST(row_number() OVER (PARTITION BY source_id
  ORDER BY predicted DESC NULLS LAST, highlight DESC, event_ms, short_id) AS INTEGER) AS rank FROM short QUALIFY rank <= 24""")
def _(t):
    order = [F.col("predicted").desc_nulls_last(), F.col("highlight").desc(), F.col("event_ms"), F.col("short_id")]
    return r.top_n(t.short, ["source_id"], order, 24).select("source_id", "short_id", "rank")


@query("top3_per_source", """
SELECT source_id, short_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY highlight DESC, quality DESC, event_ms, short_id) AS INTEGER) AS rank
FROM short WHERE state = 'READY' QUALIFY rank <= 3""")
def _(t):
    order = [F.col("highlight").desc(), F.col("quality").desc(), F.col("event_ms"), F.col("short_id")]
    return r.top_n(t.short.filter("state = 'READY'"), ["source_id"], order, 3).select("source_id", "short_id", "rank")


@query("oldest_active_job", """
SELECT s.owner_id, min_by(job_id, (updated_at, job_id)) AS job_id, strftime(min(updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM job JOIN source s ON s.source_id = job.source_id WHERE state IN ('PENDING', 'RUNNING', 'RETRYING') GROUP BY s.owner_id""")
def _(t):
    active = t.job.filter(F.col("state").isin("PENDING", "RUNNING", "RETRYING"))
    return active.join(t.source.select("source_id", "owner_id"), "source_id").groupBy("owner_id").agg(
        F.min_by("job_id", F.struct("updated_at", "job_id")).alias("job_id"), stamp(F.min("updated_at")).alias("updated_at")
    )


@query("duration_buckets", """
SELECT short_id,
  CASE WHEN duration_s < 20 THEN 'Under 20s' WHEN duration_s < 40 THEN '20–39s' ELSE '40s+' END AS attribution,
  CASE WHEN duration_s < 14 THEN 'Under 14s' WHEN duration_s < 23 THEN '14–22s' WHEN duration_s < 40 THEN '23–39s' ELSE '40s+' END AS learning,
  CASE WHEN duration_s <= 12 THEN 'MICRO' WHEN duration_s <= 20 THEN 'QUICK' WHEN duration_s <= 35 THEN 'STANDARD'
    WHEN duration_s <= 50 THEN 'STORY' ELSE 'EXTENDED' END AS class
FROM short""")
def _(t):
    return t.short.select(
        "short_id", attribution_bucket("duration_s").alias("attribution"), learning_bucket("duration_s").alias("learning"),
        duration_class("duration_s").alias("class"),
    )


@query("segment_metrics", """
WITH v AS (SELECT owner_id, video_id, CAST(sum(views) AS BIGINT) AS views, CAST(sum(shares) AS BIGINT) AS shares,
    CAST(sum(subs_gained) AS BIGINT) AS subs_gained FROM latest_obs WHERE scope = 'VIDEO' GROUP BY ALL),
l AS (SELECT views, shares, subs_gained, unnest(['game', 'event', 'role']) AS dimension,
    unnest([game, event_type, coalesce(editorial_role, 'UNASSIGNED')]) AS segment
  FROM v JOIN short s ON s.short_id = v.video_id AND s.owner_id = v.owner_id),
b AS (SELECT dimension, avg(views) AS bv, avg(shares) AS bs, avg(subs_gained) AS bg FROM l GROUP BY 1)
SELECT dimension, segment, count(*) AS sample_size, round(avg(views), 6) AS views, round(avg(shares), 6) AS shares,
  round(avg(subs_gained), 6) AS subs_gained, round(avg(views) / any_value(bv), 6) AS views_ratio,
  round(avg(shares) / any_value(bs), 6) AS shares_ratio, round(avg(subs_gained) / any_value(bg), 6) AS subs_gained_ratio
FROM l JOIN b USING (dimension) GROUP BY dimension, segment""")
def _(t):
    by_video = r.activity_totals(r.latest_activity(t.observation.filter("scope = 'VIDEO'")), ["owner_id", "video_id"])
    items = t.short.select("owner_id", F.col("short_id").alias("video_id"), "game", "event_type", "editorial_role")
    joined = by_video.join(items, ["owner_id", "video_id"])
    measures = ["views", "shares", "subs_gained"]
    long = joined.select(
        *measures,
        F.expr("stack(3, 'game', game, 'event', event_type, 'role', coalesce(editorial_role, 'UNASSIGNED')) AS (dimension, segment)"),
    )
    out = r.segment_metrics(long, measures)
    return rounded(out, *measures, *[f"{m}_ratio" for m in measures])


@query("posting_slot", """
SELECT publication_id, strftime(publish_at, '%H') || ':00 UTC' AS utc_slot,
  strftime(publish_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%H:%M') AS posting_time,
  strftime(publish_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%A') AS day_of_week FROM publication""")
def _(t):
    local = times.local_time("publish_at", "America/New_York")
    return t.publication.select(
        "publication_id", times.utc_slot_label("publish_at").alias("utc_slot"),
        F.date_format(local, "HH:mm").alias("posting_time"), F.date_format(local, "EEEE").alias("day_of_week"),
    )
