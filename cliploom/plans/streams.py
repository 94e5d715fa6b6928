"""Streaming queries; each runs a stream over the event file and returns what it wrote."""

from pyspark.sql import functions as F

from cliploom.plans.common import day, now, stamp
from cliploom.plans.registry import query
from cliploom.streaming import pipelines as p


def shaped(raw):
    return raw.selectExpr(
        "event_id AS observation_id", "user_id", "user_id % 7 AS owner_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type",
        "CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END AS video_id", "CAST(ts AS DATE) AS report_date",
        "CAST(floor(value * 100) AS BIGINT) AS views")


def stream(t):
    return shaped(p.read_stream(t.spark, t.sf_dir, "events.parquet"))


@query("stream_snapshot_ingest", """
SELECT sha256(owner_id || chr(0) || coalesce(CAST(video_id AS VARCHAR), 'channel') || chr(0) || strftime(report_date, '%Y-%m-%d')) AS report_key,
  observation_id, views, strftime(collected_at, '%Y-%m-%d %H:%M:%S') AS collected_at FROM observation
QUALIFY row_number() OVER (PARTITION BY owner_id, video_id, report_date ORDER BY collected_at DESC, observation_id DESC) = 1""")
def _(t):
    reports = stream(t).withColumnRenamed("ts", "collected_at")
    kept = p.snapshot_ingest(reports, p.work_dir(t.spark, "snapshots"))
    return kept.select("report_key", "observation_id", "views", stamp("collected_at").alias("collected_at"))


@query("stream_latest_totals", """
SELECT owner_id, count(*) AS observations, CAST(sum(views) AS BIGINT) AS views FROM (
  SELECT owner_id, views FROM observation QUALIFY row_number() OVER (PARTITION BY owner_id, video_id, report_date ORDER BY collected_at DESC, observation_id DESC) = 1) GROUP BY 1""")
def _(t):
    reports = stream(t).withColumnRenamed("ts", "collected_at")
    latest = p.latest_totals(reports, p.work_dir(t.spark, "latest"), ["owner_id", "video_id", "report_date"])
    return latest.groupBy("owner_id").agg(F.count("*").alias("observations"), F.sum("views").alias("views"))


SESSIONS = """
WITH o AS (SELECT user_id AS k, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL {gap} HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WHERE {cond} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o),
g AS (SELECT k, s, count(*) AS c, min(ts) AS a, max(ts) AS b FROM n GROUP BY ALL)
"""


@query("stream_gap_sessions", SESSIONS.format(gap=6, cond="event_type = 'purchase'") + """
SELECT k AS source_id, c AS peaks, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_ts FROM g""")
def _(t):
    peaks = lambda df: df.filter("event_type = 'purchase'").withColumnRenamed("user_id", "source_id")
    out = p.gap_sessions(peaks(stream(t)), p.work_dir(t.spark, "sessions"), "6 hours")
    return out.select("source_id", "peaks", stamp("first_ts").alias("first_ts"), stamp("last_ts").alias("last_ts"))


@query("stream_daily_activity", """
SELECT owner_id, strftime(CAST(collected_at AS DATE), '%Y-%m-%d') AS day, count(*) AS observations, CAST(sum(views) AS BIGINT) AS views FROM observation GROUP BY ALL""")
def _(t):
    return p.daily_activity(stream(t), p.work_dir(t.spark, "days")).withColumn("day", day("day"))


@query("stream_rolling_activity", """
SELECT owner_id, strftime(d, '%Y-%m-%d') AS since, count(*) AS observations, CAST(sum(views) AS BIGINT) AS views
FROM observation JOIN (SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) - 7 FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS DATE) AS d) c ON collected_at >= d AND collected_at < d + INTERVAL 7 DAY GROUP BY ALL""")
def _(t):
    return p.rolling_activity(stream(t), p.work_dir(t.spark, "rolling")).withColumn("since", day("since"))


@query("stream_stale_jobs", SESSIONS.format(gap=12, cond="true").rstrip() + """,
x AS (SELECT *, lead(a) OVER (PARTITION BY k ORDER BY a) AS r FROM g WHERE a <= TIMESTAMP '2024-01-31')
SELECT k AS job_id, c AS beats, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_beat, strftime(b + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS stale_at,
  CASE WHEN r IS NULL THEN 'ACTIVE' ELSE 'RESOLVED' END AS state, strftime(r, '%Y-%m-%d %H:%M:%S') AS resolved_at FROM x
WHERE b + INTERVAL 12 HOUR <= TIMESTAMP '2024-01-31'""")
def _(t):
    beats = stream(t).withColumnRenamed("user_id", "job_id")
    out = p.stale_jobs(beats, p.work_dir(t.spark, "stale"), "12 hours", now())
    return out.select(
        "job_id", "beats", stamp("last_beat").alias("last_beat"), stamp("stale_at").alias("stale_at"), "state", stamp("resolved_at").alias("resolved_at"))


@query("stream_alert_dedupe", """
SELECT user_id % 7 AS owner_id, 'error:' || user_id AS dedupe_key, count(*) AS sightings, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events WHERE event_type = 'error' GROUP BY ALL""")
def _(t):
    alerts = stream(t).filter("event_type = 'error'").select(
        "owner_id", F.concat(F.lit("error:"), F.col("user_id").cast("string")).alias("dedupe_key"), F.col("ts").alias("seen_at"))
    out = p.alert_dedupe(alerts, p.work_dir(t.spark, "alerts"))
    return out.select("owner_id", "dedupe_key", "sightings", stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"))
