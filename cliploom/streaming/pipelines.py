"""Structured Streaming forms of ingest, latest totals, sessions, windows and alerts.

Every pipeline takes a streaming frame and a folder in shared storage, runs until
the available input is done, and leaves a bucketed table behind: a batch reads and
rewrites only the buckets of its keys, and a repeated batch overwrites itself. Late
rows and windows still open at the end are part of every result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliploom.functions.text import report_key
from cliploom.operators.reporting import latest_observation
from cliploom.session import checkpoint_dir
from cliploom.sources.bucketed import BUCKETS, BucketedTable


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """Streaming read of parquet files of a folder by name pattern, with the schema of what is there."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def finish_state(df: DataFrame, path: str, keys: list[str], reduce_rows, buckets: int = BUCKETS) -> DataFrame:
    """Fold every micro-batch into a bucketed table keyed by ``keys``; ``reduce_rows`` merges old rows and new ones.

    A batch reads and rewrites only the buckets its keys fall into; a repeated batch overwrites what it wrote, and a stream that is
    started again on the same path goes on where it stopped."""
    table = BucketedTable(df.sparkSession, f"{path}/state", df.schema, keys, buckets)
    query = (
        df.writeStream.foreachBatch(lambda batch, batch_id: table.merge(batch, reduce_rows, batch_id))
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return table.read()


def with_report_key(observations: DataFrame) -> DataFrame:
    return observations.withColumn("report_key", report_key(
        "owner_id", F.coalesce(F.col("video_id").cast("string"), F.lit("channel")), F.date_format("report_date", "yyyy-MM-dd")
    ))


def snapshot_ingest(observations: DataFrame, path: str) -> DataFrame:
    """Keep each report once, however late it comes or comes again: the newest by time of collection, then id."""
    keyed = with_report_key(observations)
    order = [c for c in ("collected_at", "ts", "observation_id") if c in keyed.columns]
    whole = F.struct(*[F.col(c) for c in keyed.columns])

    def newest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("report_key").agg(F.max_by(whole, F.struct(*[F.col(c) for c in order], whole.alias("all"))).alias("r"))
        return last.select("r.*")

    return finish_state(keyed, path, ["report_key"], newest)


def latest_totals(observations: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Newest observation per key over all batches."""
    return finish_state(observations, path, keys, lambda rows: latest_observation(rows, keys))


def _interval(gap: str | Column) -> Column:
    """A gap as an interval: text like ``6 hours``, or a number column of seconds for a gap of each row's own."""
    return F.expr(f"INTERVAL {gap}") if isinstance(gap, str) else F.make_dt_interval(secs=gap.cast("decimal(18,6)"))


def merge_sessions(rows: DataFrame, key: str) -> DataFrame:
    """Join sessions (key, n, first_ts, last_ts, closes_at) that reach into each other, in any order of arrival.

    A session that begins before the ones ahead have closed belongs to them. Rows of one key and day are joined first, so a hot
    key comes to the second step as a few sessions a day."""

    def joined(part: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("first_ts", "last_ts")
        reach = F.max("closes_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opens = part.withColumn("__opens", F.when(reach.isNull() | (F.col("first_ts") >= reach), 1).otherwise(0))
        named = opens.withColumn("__no", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return named.groupBy(*by, "__no").agg(
            F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("closes_at").alias("closes_at")
        ).drop("__no")

    days = joined(rows.withColumn("__day", F.date_trunc("day", "first_ts")), [key, "__day"]).drop("__day")
    return joined(days, [key])


def _sessions(stream: DataFrame, key: str, gap: str | Column, path: str) -> DataFrame:
    """All sessions of a stream as a table that grows by merging: open, closed and late rows alike."""
    one = stream.select(
        key, F.lit(1).cast("bigint").alias("n"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), (F.col("ts") + _interval(gap)).alias("closes_at")
    )
    return finish_state(one, path, [key], lambda rows: merge_sessions(rows, key))


def gap_sessions(peaks: DataFrame, path: str, gap: str | Column) -> DataFrame:
    """All sessions per source; a session ends when nothing follows within the gap. A late row joins its neighbours, and fuses
    two sessions it lies between; each batch works on the buckets of its own keys."""
    out = _sessions(peaks, "source_id", gap, path)
    return out.select("source_id", F.col("n").alias("peaks"), "first_ts", "last_ts")


def daily_activity(events: DataFrame, path: str) -> DataFrame:
    """Calendar-day totals per owner, open days and late rows included."""
    one = events.select("owner_id", F.date_trunc("day", "ts").alias("day"), F.lit(1).cast("bigint").alias("observations"), "views")
    return finish_state(one, path, ["owner_id", "day"], lambda rows: rows.groupBy("owner_id", "day").agg(
        F.sum("observations").alias("observations"), F.sum("views").alias("views")
    ))


def rolling_activity(events: DataFrame, path: str, days: int = 7) -> DataFrame:
    """Rolling totals of ``days`` days, one window starting each day, open windows included: days are summed in the stream's
    table and spread to their windows when read."""
    totals = daily_activity(events, path)
    since = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda back: F.date_sub(F.to_date("day"), back))
    return totals.withColumn("since", F.explode(since)).groupBy("owner_id", F.col("since").cast("timestamp").alias("since")).agg(
        F.sum("observations").alias("observations"), F.sum("views").alias("views")
    )


def stale_jobs(heartbeats: DataFrame, path: str, silence: str | Column, now: Column) -> DataFrame:
    """One alert per silence of a job as of ``now``: ACTIVE while it lasts, RESOLVED at the next heartbeat.

    The table of heartbeat sessions grows by merging, so a heartbeat that comes late takes back the alert of a silence that was none."""
    beats = _sessions(heartbeats, "job_id", silence, path)
    again = F.lead("first_ts").over(Window.partitionBy("job_id").orderBy("first_ts"))
    told = beats.filter(F.col("first_ts") <= now).withColumn("resolved_at", again).filter(F.col("closes_at") <= now)
    return told.select(
        "job_id", F.col("last_ts").alias("last_beat"), F.col("closes_at").alias("stale_at"), F.col("n").alias("beats"),
        F.when(F.col("resolved_at").isNull(), "ACTIVE").otherwise("RESOLVED").alias("state"), "resolved_at",
    )


def alert_dedupe(alerts: DataFrame, path: str) -> DataFrame:
    """One row per alert key with first and last sighting over all batches."""
    seen = alerts.select(
        "owner_id", "dedupe_key", F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"),
        F.lit(1).cast("bigint").alias("sightings"),
    )
    return finish_state(seen, path, ["owner_id", "dedupe_key"], lambda rows: rows.groupBy("owner_id", "dedupe_key").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sightings").alias("sightings")
    ))
