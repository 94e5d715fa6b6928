"""Jobs, alerts, budgets, quality rules and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import config
from cliploom.functions import times
from cliploom.functions.numeric import bounded, half_up
from cliploom.operators.reporting import first_per_key

ALERT_KEYS = ["owner_id", "dedupe_key"]


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each named rule; a rule that evaluates to null passes, as a CHECK does."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()])
    stack = ", ".join(f"'{name}', {name}" for name in rules)
    return counts.select(F.expr(f"stack({len(rules)}, {stack}) AS (rule, violations)"))


def active_uniqueness_violations(jobs: DataFrame) -> DataFrame:
    """(source, kind) with more than one active job; RENDER jobs may run in parallel."""
    active = jobs.filter(F.col("state").isin(config.ACTIVE_STATES) & (F.col("kind") != "RENDER"))
    return active.groupBy("source_id", "kind").agg(F.count("*").alias("active")).filter("active > 1")


def due_work(rows: DataFrame, now: Column, states: list[str], max_attempts: int, limit: int) -> DataFrame:
    """The earliest due rows per owner: wanted state, a requested cancellation, or missed with a video."""
    wanted = (
        F.col("state").isin(states) | F.col("cancel_requested")
        | ((F.col("state") == "MISSED") & F.col("video_id").isNotNull())
    )
    due = rows.filter((F.col("next_attempt_at") <= now) & (F.col("attempts") < max_attempts) & wanted)
    return first_per_key(due, ["owner_id"], [F.col("next_attempt_at"), F.col("publication_id")], limit, rank="rank")


def expired_sessions(sessions: DataFrame, parts: DataFrame, now: Column) -> DataFrame:
    """Open past expiry, already expired, or complete with parts left behind."""
    leftover = parts.select("upload_id").distinct().withColumn("__left", F.lit(True))
    joined = sessions.join(leftover, "upload_id", "left")
    gone = (
        ((F.col("state") == "OPEN") & (F.col("expires_at") < now)) | (F.col("state") == "EXPIRED")
        | ((F.col("state") == "COMPLETE") & F.coalesce("__left", F.lit(False)))
    )
    return joined.filter(gone).drop("__left")


def active_upload_quota(sessions: DataFrame, now: Column, cap: int) -> DataFrame:
    live = F.count_if((F.col("state") == "OPEN") & (F.col("expires_at") > now))
    return sessions.groupBy("owner_id").agg(live.alias("open_sessions")).withColumn("may_open", F.col("open_sessions") < cap)


def render_qc(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()
    ]))
    return df.withColumn("failed", F.concat_ws(", ", failed)).withColumn("passed", F.col("failed") == "")


def backfill_semi_anti(sources: DataFrame, have: DataFrame, have_not: list[DataFrame]) -> DataFrame:
    """READY sources with the prerequisite child and none of the excluded children."""
    out = sources.filter("status = 'READY'").join(have.select("source_id"), "source_id", "left_semi")
    for other in have_not:
        out = out.join(other.select("source_id"), "source_id", "left_anti")
    return out


def visible_jobs(jobs: DataFrame) -> DataFrame:
    """Hide failed jobs that a newer, not failed job of the same source and kind has replaced."""
    keys = ["source_id", "kind"]
    newest = jobs.filter("state <> 'FAILED'").groupBy(*keys).agg(F.max("created_at").alias("__newest"))
    joined = jobs.join(newest, keys, "left")
    replaced = (F.col("state") == "FAILED") & F.coalesce(F.col("__newest") > F.col("created_at"), F.lit(False))
    return joined.filter(~replaced).drop("__newest")


def nearest_event_join(new_items: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """For the strongest new item of each key, the baseline item nearest in event time."""
    strongest = first_per_key(new_items, [key], [F.col("highlight").desc(), F.col("short_id")]).select(
        key, F.col("short_id").alias("new_id"), F.col("event_ms").alias("__t")
    )
    joined = baseline.select(key, F.col("short_id").alias("old_id"), "event_ms").join(strongest, key)
    away = F.struct(F.abs(F.col("event_ms") - F.col("__t")), F.col("old_id"))
    return joined.groupBy(key, "new_id").agg(
        F.min_by("old_id", away).alias("old_id"), F.min(F.abs(F.col("event_ms") - F.col("__t"))).alias("distance_ms")
    )


def cache_lookup_join(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with a hit flag and the stored usage; one cache row per key."""
    stored = cache.groupBy(*keys).agg(
        F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens"), F.lit(True).alias("__hit")
    )
    return requests.join(stored, keys, "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def latest_child_lateral(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Each parent with its newest child and number of children."""
    place = F.struct("created_at", "job_id")
    newest = children.groupBy(key).agg(
        F.max_by("job_id", place).alias("job_id"), F.max_by("state", place).alias("job_state"), F.count("*").alias("jobs")
    )
    return parents.join(newest, key, "left").withColumn("jobs", F.coalesce("jobs", F.lit(0).cast("bigint")))


def superseded_assets(stored: DataFrame, current: DataFrame) -> DataFrame:
    return stored.join(current, ["short_id", "asset_no"], "left_anti")


def _admit(short_cap: int, batch_cap: int, count_cap: int):
    """Requests of a source one after the other, as they stream by: a refused one spends nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, batch_spent, items = None, 0, {}
        for batch in batches:
            out = []
            for at, short, number, kind, count, amount in zip(*[batch[c] for c in ("source_id", "short_id", "request_no", "kind", "n", "amount")]):
                if at != source:
                    source, batch_spent, items = at, 0, {}
                have, spent = items.get(short, (0, 0))
                if kind == 0:  # what the item held before
                    items[short] = (have + count, spent + amount)
                    batch_spent += amount
                    continue
                fits = have < count_cap and spent + amount <= short_cap and batch_spent + amount <= batch_cap
                if fits:
                    have, spent, batch_spent = have + 1, spent + amount, batch_spent + amount
                    items[short] = (have, spent)
                out.append((at, short, number, fits, spent, batch_spent))
            yield pd.DataFrame(out, columns=["source_id", "short_id", "request_no", "admitted", "short_spent", "batch_spent"])

    return run


def budget_ledger(
    ledger: DataFrame, requests: DataFrame, short_cap: float, batch_cap: float, count_cap: int,
) -> DataFrame:
    """Admit requests (source_id, short_id, request_no, estimate_usd) one after another, by number, item and amount within their source.

    A request needs room under the item's count and spend and under its source's spend, counting what ``ledger`` has reserved (actual
    cost where known) and what was admitted before; a refused request spends nothing. Money is counted in millionths. The
    decision of a request rests on all before it, so a source's requests stream in order through one task, sorted by Spark; the task
    holds a count and a sum per item, and no list of requests."""
    micro = lambda c: F.round(c * 1_000_000).cast("bigint")
    held = ledger.filter(F.col("status").isin(config.RESERVED_STATUSES)).groupBy("source_id", "short_id").agg(
        F.count("*").alias("n"), F.sum(micro(F.coalesce("actual_usd", "estimate_usd"))).alias("amount")
    )
    rows = held.select("source_id", "short_id", F.lit(-1).alias("request_no"), F.lit(0).alias("kind"), "n", "amount").unionByName(
        requests.select(
            "source_id", "short_id", F.col("request_no").cast("int").alias("request_no"), F.lit(1).alias("kind"),
            F.lit(1).cast("bigint").alias("n"), micro(F.col("estimate_usd")).alias("amount"),
        )
    )
    order = ["source_id", "kind", "request_no", "short_id", "amount"]
    told = rows.repartition("source_id").sortWithinPartitions(*order).mapInPandas(
        _admit(round(short_cap * 1_000_000), round(batch_cap * 1_000_000), count_cap),
        "source_id bigint, short_id bigint, request_no int, admitted boolean, short_spent bigint, batch_spent bigint",
    )
    return told.select(
        "source_id", "short_id", "request_no", "admitted", F.when(~F.col("admitted"), "OVER_BUDGET").alias("code"),
        (F.col("short_spent") / 1_000_000).alias("short_spent"), (F.col("batch_spent") / 1_000_000).alias("batch_spent"),
    )


def quality_report(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Before and after counts per key: items, distinct durations, captioned, high frame rate."""
    def measures(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(key).agg(
            F.count("*").alias(f"{p}_items"), F.countDistinct(F.format_string("%.2f", "duration_s")).alias(f"{p}_durations"),
            F.count_if(F.col("captions") > 0).alias(f"{p}_captioned"), F.count_if(F.col("frame_rate") >= 59).alias(f"{p}_smooth"),
        )
    fresh = new_items_except(after, before)
    joined = measures(before, "old").join(measures(fresh, "new"), key, "full_outer")
    counts = [c for c in joined.columns if c != key]
    return joined.select(key, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts])


def new_items_except(after: DataFrame, before: DataFrame) -> DataFrame:
    return after.filter("analysis_method = 'AI'").join(before.select("short_id"), "short_id", "left_anti")


def alert_order(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """Active alerts per owner: severity by name, newest first."""
    active = alerts.filter("state = 'ACTIVE'")
    return first_per_key(active, ["owner_id"], [F.col("severity"), F.col("last_seen").desc(), F.col("dedupe_key")], limit, rank="rank")


def stale_jobs(jobs: DataFrame, owners: DataFrame, now: Column, minutes: int = config.STALE_MINUTES) -> DataFrame:
    """One alert row per running job without progress for ``minutes``."""
    cutoff = now - F.expr(f"INTERVAL {minutes} MINUTES")
    stale = jobs.filter(F.col("state").isin("RUNNING", "RETRYING") & (F.col("updated_at") < cutoff))
    return stale.join(owners.select("source_id", "owner_id", "filename"), "source_id").select(
        "owner_id", F.concat(F.lit("stale-job:"), F.col("job_id").cast("string")).alias("dedupe_key"),
        F.lit("WARNING").alias("severity"), F.lit("STALE_JOB").alias("code"),
        F.concat(F.lower("kind"), F.lit(" job has not reported progress")).alias("title"),
        F.concat(
            F.col("filename"), F.lit(" has been "), F.lower("state"), F.lit(" for "),
            times.age_minutes("updated_at", now).cast("string"), F.lit(" minutes. Check worker/renderer logs before retrying."),
        ).alias("message"),
    )


def merge_alerts(current: DataFrame, firing: DataFrame, now: Column) -> DataFrame:
    """Upsert firing alerts by key: first seen is kept, last seen refreshed; the rest of the active ones resolve.

    Title and message ride along; of several alerts of one key the greatest text stays, so reruns agree."""
    active = current.filter("state = 'ACTIVE'").select(*ALERT_KEYS, "first_seen", F.lit(True).alias("__was"))
    told = [c for c in ("title", "message") if c in firing.columns]
    fresh = firing.groupBy(*ALERT_KEYS).agg(
        F.max(F.struct(*told) if told else F.lit(True)).alias("__told"), F.lit(True).alias("__fires")
    )
    joined = active.join(fresh, ALERT_KEYS, "full_outer")
    fires = F.coalesce("__fires", F.lit(False))
    return joined.select(
        *ALERT_KEYS, F.when(fires, "ACTIVE").otherwise("RESOLVED").alias("state"),
        F.coalesce("first_seen", now).alias("first_seen"), F.when(fires, now).alias("last_seen"),
        F.when(~fires, now).alias("resolved_at"), *[F.col("__told")[c].alias(c) for c in told],
    )


def alert_resolution(current: DataFrame, firing: DataFrame) -> DataFrame:
    return current.filter("state = 'ACTIVE'").join(firing.select(*ALERT_KEYS), ALERT_KEYS, "left_anti")


def exhausted_jobs(jobs: DataFrame, queued: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs after the retry limit is enforced, and the failure event of each one that just failed."""
    spent = F.col("state").isin(config.ACTIVE_STATES) & (F.col("attempt") >= config.MAX_ATTEMPTS)
    label = (
        F.when(F.col("kind") == "ANALYZE", "analysis").when(F.col("kind") == "RANK", "ranking")
        .when(F.col("kind") == "PLAN", "short planning").when(F.col("kind") == "RENDER", "rendering").otherwise("ingestion")
    )
    marks = queued.select("job_id", F.lit(True).alias("__queued"))
    marked = jobs.join(marks, "job_id", "left").withColumn("__spent", spent & F.col("__queued").isNull())
    out = marked.withColumn("state", F.when(F.col("__spent"), "FAILED").otherwise(F.col("state"))).withColumn(
        "error_message",
        F.when(F.col("__spent"), F.concat(
            F.lit("Worker retry limit reached. Check worker health and retry "), label, F.lit("."))),
    )
    events = out.filter("__spent").select(
        "job_id", F.lit(config.MAX_ATTEMPTS).alias("attempt"), F.lit("WORKER_INTERRUPTED").alias("error_code"),
        F.concat(F.lit("Worker retry limit reached during "), label, F.lit(".")).alias("error_message"),
    )
    return out.drop("__spent", "__queued"), events


def remote_state(now: Column) -> Column:
    """Publication state from the remote record (columns of the remote video and the wanted publish time)."""
    failed = F.col("upload_status").isin("failed", "rejected", "deleted") | F.col("processing_status").isin("failed", "terminated")
    public = F.col("privacy") == "public"
    on_time = F.coalesce((F.col("privacy") == "private") & (F.col("remote_publish_at") == F.col("publish_at")), F.lit(False))
    return (
        F.when(F.col("remote_channel").isNull() | (F.col("remote_channel") != F.col("channel")), "NEEDS_ATTENTION")
        .when(F.coalesce(failed, F.lit(False)), "FAILED")
        .when(public & (now < F.col("publish_at")), "NEEDS_ATTENTION").when(public, "PUBLISHED")
        .when(now >= F.col("publish_at"), "MISSED").when(~on_time, "NEEDS_ATTENTION")
        .when(F.col("upload_status") == "processed", "SCHEDULED").otherwise("PROCESSING")
    )


def readiness_status(services: list[str], critical: str) -> Column:
    degraded = F.exists(F.array(*services), lambda s: s != "healthy")
    return F.when(degraded, "degraded").when(F.col(critical) > 0, "attention").otherwise("healthy")


def backup_freshness(audits: DataFrame, owners: DataFrame, now: Column, max_hours: int) -> DataFrame:
    last = audits.groupBy("owner_id").agg(F.max("verified_at").alias("verified_at"))
    age = F.floor((F.unix_micros(now) - F.unix_micros("verified_at")) / 3_600_000_000).cast("bigint")
    return owners.join(last, "owner_id", "left").withColumn("age_hours", age).withColumn(
        "backup", F.when(F.col("verified_at").isNull(), "unverified").when(F.col("age_hours") <= max_hours, "current").otherwise("stale")
    )


def highlight_heuristic() -> dict[str, Column]:
    """Scores derived from the signal score and signal kinds alone, for items without a model verdict."""
    base = bounded(half_up(F.col("signal_score") * 0.72 + 18))
    audio, motion, scene = (F.array_contains("kinds", k) for k in ("AUDIO_PEAK", "MOTION_PEAK", "SCENE_CHANGE"))
    cap = lambda c: F.least(F.lit(100.0), c)
    floor = lambda c: F.greatest(F.lit(0.0), c)
    flag = lambda cond, yes, no: F.when(cond, float(yes)).otherwise(float(no))
    out = {
        "highlight": base, "event_importance": base, "excitement": cap(base + flag(audio, 6, 0)),
        "surprise": cap(base + flag(scene, 4, -8)), "skill": floor(base - 12), "humor": floor(base - 20),
        "tension": cap(base + flag(audio & motion, 5, 0)), "emotional": cap(base + flag(audio, 8, -10)),
        "chaos": cap(base + flag(motion & audio, 8, -12)), "reaction": cap(base + flag(audio, 6, -15)),
        "hook_potential": cap(base + 2), "retention": base, "share": floor(base - 3), "comment": floor(base - 8),
        "worthiness": floor(base - 20), "clarity": F.lit(55.0), "story": F.lit(35.0), "context": F.lit(50.0),
        "novelty": F.lit(45.0), "editability": F.lit(70.0), "confidence": F.lit(35.0),
    }
    return {name: value.cast("int") for name, value in out.items()}


def batch_scores(items: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str | None = None) -> DataFrame:
    """Scores of every item: by a user's function over Arrow batches (pandas in, pandas out, rows of ``schema``), else by
    the built-in heuristic as columns. The function sees some rows at a time and must not depend on which."""
    if scorer is None:
        return items.select("*", *[value.alias(name) for name, value in highlight_heuristic().items()])
    return items.mapInPandas(lambda batches: (scorer(batch) for batch in batches), schema)


def concept_select(context: str, tension: str) -> Column:
    return F.when(F.col(context) >= 60, "ACTION_FIRST").when(F.col(tension) >= 60, "TENSION_FIRST").otherwise("CONTEXT_FIRST")


RANKING = (
    "gameIdentification struct<game:string,edition:string,confidence:int>, rankings array<struct<candidateId:string,"
    "eventType:string,highlightScore:int,confidence:int,decision:string>>"
)
DECISIONS = [
    "SELECTED", "REJECTED_LOW_INTEREST", "REJECTED_NO_PAYOFF", "REJECTED_DUPLICATE", "REJECTED_TOO_MUCH_CONTEXT",
    "REJECTED_VISUALLY_WEAK", "REJECTED_LOW_CONFIDENCE", "REJECTED_NO_CLEAR_EVENT", "REJECTED_POOR_SHORT_FORMAT",
]


def ranking_payload_parse(df: DataFrame, text: str = "payload") -> DataFrame:
    """One row per ranking of a model payload with a validity flag; unreadable payloads give one invalid row."""
    doc = F.from_json(F.col(text), RANKING, {"mode": "PERMISSIVE"})
    rows = df.select("request_id", F.explode_outer(doc["rankings"]).alias("r"))
    in_range = lambda c: c.between(0, 100)
    valid = (
        in_range(F.col("r.highlightScore")) & in_range(F.col("r.confidence")) & F.col("r.decision").isin(DECISIONS)
        & F.length("r.eventType").between(1, 100)
    )
    return rows.select(
        "request_id", F.col("r.candidateId").alias("candidate_id"), F.col("r.highlightScore").alias("highlight"),
        F.col("r.decision").alias("decision"), F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def ranking_completeness(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Per request: every finalist exactly once, nothing missing, repeated or invented."""
    keys = ["request_id", "candidate_id"]
    seen = returned.groupBy(*keys).agg(F.count("*").alias("__n"))
    joined = expected.select(*keys, F.lit(True).alias("__want")).join(seen, keys, "full_outer")
    want, n = F.coalesce("__want", F.lit(False)), F.coalesce("__n", F.lit(0))
    return joined.groupBy("request_id").agg(
        F.count_if(want & (n == 0)).alias("missing"), F.count_if(n > 1).alias("repeated"), F.count_if(~want).alias("invented")
    ).withColumn("complete", (F.col("missing") == 0) & (F.col("repeated") == 0) & (F.col("invented") == 0))
