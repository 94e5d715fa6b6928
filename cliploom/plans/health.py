"""Job, alert, budget, quality and ranking-payload queries."""

from pyspark.sql import functions as F

from cliploom.functions import text, times
from cliploom.functions.numeric import logprob_confidence, token_cost
from cliploom.operators import events as e
from cliploom.operators import health as h
from cliploom.plans.common import now, rounded, stamp
from cliploom.plans.events import scored
from cliploom.plans.registry import query
from cliploom.sources.tables import DUCK_VIEWS

NOW = "TIMESTAMP '2024-01-31'"


@query("quality_rules", """
SELECT * FROM (SELECT 'positive_bytes' AS rule, count(*) FILTER (NOT bytes > 0) AS violations FROM source
  UNION ALL SELECT 'valid_duration', count(*) FILTER (duration_s IS NOT NULL AND NOT duration_s > 0) FROM source
  UNION ALL SELECT 'valid_progress', count(*) FILTER (NOT progress BETWEEN 0 AND 100) FROM job
  UNION ALL SELECT 'valid_attempt', count(*) FILTER (NOT attempt >= 0) FROM job)""")
def _(t):
    sources = h.violations(t.source, {"positive_bytes": F.col("bytes") > 0, "valid_duration": F.col("duration_s") > 0})
    jobs = h.violations(t.job, {"valid_progress": F.col("progress").between(0, 100), "valid_attempt": F.col("attempt") >= 0})
    return sources.unionByName(jobs)


@query("active_uniqueness_violations", """
SELECT source_id, kind, count(*) AS active FROM job WHERE state IN ('PENDING', 'RUNNING', 'RETRYING') AND kind <> 'RENDER' GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    return h.active_uniqueness_violations(t.job)


@query("due_work", f"""
SELECT owner_id, publication_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY next_attempt_at, publication_id) AS INTEGER) AS rank FROM publication
WHERE next_attempt_at <= {NOW} AND attempts < 5 AND (state IN ('PENDING', 'SCHEDULED') OR cancel_requested) QUALIFY rank <= 5""")
def _(t):
    return h.due_work(t.publication, now(), ["PENDING", "SCHEDULED"], 5, 5).select("owner_id", "publication_id", "rank")


DUCK_VIEWS["session_row"] = """
  SELECT o_orderkey AS upload_id, o_custkey AS owner_id, split_part('OPEN|EXPIRED|COMPLETE|OPEN', '|', CAST(o_orderkey % 4 AS INTEGER) + 1) AS state,
    make_timestamp(1706659200000000 + (o_custkey % 48 - 24) * 3600000000) AS expires_at FROM orders"""


def sessions(t):
    return t.base("orders").selectExpr(
        "o_orderkey AS upload_id", "o_custkey AS owner_id",
        "split_part('OPEN|EXPIRED|COMPLETE|OPEN', '|', CAST(o_orderkey % 4 AS INTEGER) + 1) AS state",
        "timestamp_micros(1706659200000000 + (o_custkey % 48 - 24) * 3600000000) AS expires_at")


@query("expired_sessions", f"""
SELECT upload_id, state FROM session_row s WHERE (state = 'OPEN' AND expires_at < {NOW}) OR state = 'EXPIRED'
  OR (state = 'COMPLETE' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = upload_id))""")
def _(t):
    left = t.base("lineitem").selectExpr("l_orderkey AS upload_id")
    return h.expired_sessions(sessions(t), left, now()).select("upload_id", "state")


@query("active_upload_quota", f"""
SELECT owner_id, count(*) FILTER (state = 'OPEN' AND expires_at > {NOW}) AS open_sessions, count(*) FILTER (state = 'OPEN' AND expires_at > {NOW}) < 3 AS may_open FROM session_row GROUP BY 1""")
def _(t):
    return h.active_upload_quota(sessions(t), now(), 3)


@query("render_qc", """
SELECT short_id, render_no, render_rank, coalesce(array_to_string(list_filter([CASE WHEN preset <> 'HIGH' THEN 'resolution' END, CASE WHEN abs(frame_rate - 60) > 0.12 THEN 'frameRate' END,
  CASE WHEN sha_no % 50 = 0 THEN 'duration' END, CASE WHEN store_no % 2 = 0 THEN 'audio' END, CASE WHEN sha_no % 20 <= 3 THEN 'openingFrame' END,
  CASE WHEN sha_no % 21 <= 3 THEN 'endingFrame' END, CASE WHEN state <> 'READY' THEN 'playable' END], lambda x: x IS NOT NULL), ', '), '') AS failed FROM render""")
def _(t):
    checks = {
        "resolution": F.col("preset") == "HIGH", "frameRate": F.abs(F.col("frame_rate") - 60) <= 0.12,
        "duration": F.abs(F.when(F.col("sha_no") % 50 == 0, 0.5).otherwise(0.1)) <= 0.25, "audio": F.col("store_no") % 2 != 0,
        "openingFrame": F.col("sha_no") % 20 > 3, "endingFrame": F.col("sha_no") % 21 > 3, "playable": F.col("state") == "READY",
    }
    return h.render_qc(t.render, checks).select("short_id", "render_no", "render_rank", "failed")


@query("backfill_semi_anti", """
SELECT source_id FROM source s WHERE status = 'READY' AND EXISTS (SELECT 1 FROM short k WHERE k.source_id = s.source_id AND highlight >= 50)
  AND NOT EXISTS (SELECT 1 FROM job j WHERE j.source_id = s.source_id AND kind = 'PLAN' AND j.state = 'SUCCEEDED')""")
def _(t):
    done = t.job.filter("kind = 'PLAN' AND state = 'SUCCEEDED'")
    return h.backfill_semi_anti(t.source, t.short.filter("highlight >= 50"), [done]).select("source_id")


@query("visible_jobs", """
SELECT job_id FROM job j WHERE state <> 'FAILED' OR NOT EXISTS (SELECT 1 FROM job n WHERE n.source_id = j.source_id AND n.kind = j.kind AND n.state <> 'FAILED' AND n.created_at > j.created_at)""")
def _(t):
    return h.visible_jobs(t.job).select("job_id")


@query("nearest_event_join", """
WITH s AS (SELECT source_id, short_id AS new_id, event_ms AS t FROM short WHERE analysis_method = 'AI' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY highlight DESC, short_id) = 1)
SELECT s.source_id, new_id, b.short_id AS old_id, abs(event_ms - t) AS distance_ms FROM s JOIN short b ON b.source_id = s.source_id AND b.analysis_method <> 'AI'
QUALIFY row_number() OVER (PARTITION BY s.source_id ORDER BY abs(event_ms - t), b.short_id) = 1""")
def _(t):
    return h.nearest_event_join(t.short.filter("analysis_method = 'AI'"), t.short.filter("analysis_method <> 'AI'"), "source_id")


@query("cache_lookup_join", """
SELECT l_orderkey AS input_hash, l_linenumber AS line_no, c.k IS NOT NULL AS hit, input_tokens, output_tokens FROM lineitem r LEFT JOIN (
  SELECT input_hash AS k, provider_no, model, prompt_version, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens
  FROM ai_cache GROUP BY ALL) c ON c.k = l_orderkey AND c.provider_no = l_partkey AND c.prompt_version = l_linestatus
  AND c.model = CASE WHEN l_linenumber % 3 = 0 THEN 'N' ELSE l_returnflag END""")
def _(t):
    requests = t.base("lineitem").selectExpr(
        "l_orderkey AS input_hash", "l_linenumber AS line_no", "l_partkey AS provider_no",
        "CASE WHEN l_linenumber % 3 = 0 THEN 'N' ELSE l_returnflag END AS model", "l_linestatus AS prompt_version")
    keys = ["input_hash", "provider_no", "model", "prompt_version"]
    return h.cache_lookup_join(requests, t.ai_cache, keys).select("input_hash", "line_no", "hit", "input_tokens", "output_tokens")


@query("latest_child_lateral", """
SELECT s.source_id, j.job_id, j.job_state, coalesce(n, 0) AS jobs FROM source s LEFT JOIN (
  SELECT source_id, arg_max(job_id, (created_at, job_id)) AS job_id, arg_max(state, (created_at, job_id)) AS job_state, count(*) AS n FROM job GROUP BY 1) j ON j.source_id = s.source_id""")
def _(t):
    return h.latest_child_lateral(t.source.select("source_id"), t.job, "source_id")


@query("superseded_assets", """
SELECT DISTINCT short_id, asset_no FROM (SELECT short_id, render_no AS asset_no FROM render WHERE state = 'READY') a
WHERE NOT EXISTS (SELECT 1 FROM render r WHERE r.short_id = a.short_id AND r.render_no = a.asset_no AND r.preset = 'HIGH')""")
def _(t):
    stored = t.render.filter("state = 'READY'").select("short_id", F.col("render_no").alias("asset_no")).distinct()
    current = t.render.filter("preset = 'HIGH'").select("short_id", F.col("render_no").alias("asset_no"))
    return h.superseded_assets(stored, current)


@query("budget_ledger", """
WITH RECURSIVE l AS (SELECT *, CAST(round(coalesce(actual_usd, estimate_usd) * 1000000) AS BIGINT) AS cost, CAST(round(estimate_usd * 1000000) AS BIGINT) AS asked FROM ledger),
e AS MATERIALIZED (SELECT source_id, short_id, count(*) AS n, CAST(sum(cost) AS BIGINT) AS spent FROM l WHERE line_no = 1 AND status <> 'FAILED' GROUP BY ALL),
b AS (SELECT source_id, CAST(sum(spent) AS BIGINT) AS spent FROM e GROUP BY 1),
q AS MATERIALIZED (SELECT l.source_id, l.short_id, line_no, asked, coalesce(n, 0) AS n0, coalesce(spent, 0) AS s0, row_number() OVER (PARTITION BY l.source_id ORDER BY line_no, l.short_id, asked) AS rn
  FROM l LEFT JOIN e ON e.source_id = l.source_id AND e.short_id = l.short_id WHERE line_no > 1),
f AS (
  SELECT s.source_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS short_id, CAST(NULL AS INTEGER) AS line_no, false AS admitted, CAST(0 AS BIGINT) AS item,
    CAST(coalesce(b.spent, 0) AS BIGINT) AS batch, CAST([] AS STRUCT(s BIGINT, c BIGINT)[]) AS kept FROM (SELECT DISTINCT source_id FROM q) s LEFT JOIN b ON b.source_id = s.source_id
  UNION ALL
  SELECT source_id, rn, short_id, line_no, ok, item + CASE WHEN ok THEN asked ELSE 0 END, batch + CASE WHEN ok THEN asked ELSE 0 END,
    CASE WHEN ok THEN list_append(kept, {'s': short_id, 'c': asked}) ELSE kept END FROM (
    SELECT *, n0 + len(mine) < 2 AND item + asked <= 100000 AND batch + asked <= 6000000 AS ok FROM (
      SELECT *, CAST(s0 + coalesce(list_sum(list_transform(mine, lambda x: x.c)), 0) AS BIGINT) AS item FROM (
        SELECT q.*, f.batch, f.kept, list_filter(f.kept, lambda x: x.s = q.short_id) AS mine FROM f JOIN q ON q.source_id = f.source_id AND q.rn = f.rn + 1))))
SELECT source_id, short_id, line_no AS request_no, admitted, CASE WHEN NOT admitted THEN 'OVER_BUDGET' END AS code, item / 1000000 AS short_spent, batch / 1000000 AS batch_spent
FROM f WHERE rn > 0""")
def _(t):
    held = t.ledger.filter("line_no = 1")
    requests = t.ledger.filter("line_no > 1").select("source_id", "short_id", F.col("line_no").alias("request_no"), "estimate_usd")
    return h.budget_ledger(held, requests, 0.1, 6.0, 2)


def report_items(t):
    return t.short.select(
        "short_id", "source_id", "duration_s", (F.col("short_id") % 6).alias("captions"), (F.col("short_id") % 40 + 30).alias("frame_rate"), "analysis_method")


@query("quality_report", """
WITH i AS (SELECT short_id, source_id, duration_s, short_id % 6 AS captions, short_id % 40 + 30 AS fr, analysis_method FROM short),
o AS (SELECT source_id, count(*) AS a, count(DISTINCT duration_s) AS b, count(*) FILTER (captions > 0) AS c, count(*) FILTER (fr >= 59) AS d FROM i WHERE analysis_method <> 'AI' GROUP BY 1),
n AS (SELECT source_id, count(*) AS a, count(DISTINCT duration_s) AS b, count(*) FILTER (captions > 0) AS c, count(*) FILTER (fr >= 59) AS d FROM i WHERE analysis_method = 'AI' GROUP BY 1)
SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.a, 0) AS old_items, coalesce(o.b, 0) AS old_durations, coalesce(o.c, 0) AS old_captioned, coalesce(o.d, 0) AS old_smooth,
  coalesce(n.a, 0) AS new_items, coalesce(n.b, 0) AS new_durations, coalesce(n.c, 0) AS new_captioned, coalesce(n.d, 0) AS new_smooth FROM o FULL JOIN n ON n.source_id = o.source_id""")
def _(t):
    items = report_items(t)
    return h.quality_report(items.filter("analysis_method <> 'AI'"), items, "source_id")


@query("new_items_except", "SELECT short_id FROM short WHERE analysis_method = 'AI' AND created_at >= TIMESTAMP '1999-01-01'")
def _(t):
    return h.new_items_except(t.short, t.short.filter("created_at < TIMESTAMP '1999-01-01'")).select("short_id")


DUCK_VIEWS["alert_row"] = """
  SELECT s.owner_id, 'stale-job:' || job_id AS dedupe_key, split_part('CRITICAL|WARNING|INFO', '|', CAST(job_id % 3 AS INTEGER) + 1) AS severity,
    CASE WHEN job_id % 5 = 0 THEN 'RESOLVED' ELSE 'ACTIVE' END AS state, j.created_at AS first_seen, updated_at AS last_seen FROM job j JOIN source s ON s.source_id = j.source_id"""


def alerts(t):
    jobs = t.job.join(t.source.select("source_id", "owner_id"), "source_id")
    return jobs.select(
        "owner_id", F.concat(F.lit("stale-job:"), F.col("job_id").cast("string")).alias("dedupe_key"),
        F.expr("split_part('CRITICAL|WARNING|INFO', '|', CAST(job_id % 3 AS INTEGER) + 1)").alias("severity"),
        F.when(F.col("job_id") % 5 == 0, "RESOLVED").otherwise("ACTIVE").alias("state"),
        F.col("created_at").cast("timestamp").alias("first_seen"), F.col("updated_at").alias("last_seen"))


@query("alert_order", """
SELECT owner_id, dedupe_key, severity, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY severity, last_seen DESC, dedupe_key) AS INTEGER) AS rank
FROM alert_row WHERE state = 'ACTIVE' QUALIFY rank <= 50""")
def _(t):
    return h.alert_order(alerts(t)).select("owner_id", "dedupe_key", "severity", "rank")


DUCK_VIEWS["stale_row"] = f"""
  SELECT s.owner_id, 'stale-job:' || job_id AS dedupe_key, lower(kind) || ' job has not reported progress' AS title,
    filename || ' has been ' || lower(state) || ' for ' || CAST(floor((epoch_us({NOW}) - epoch_us(updated_at)) / 60000000) AS BIGINT) || ' minutes. Check worker/renderer logs before retrying.' AS message
  FROM job j JOIN source s ON s.source_id = j.source_id WHERE state IN ('RUNNING', 'RETRYING') AND updated_at < {NOW} - INTERVAL 60 MINUTE"""


def firing(t):
    return h.stale_jobs(t.job, t.source, now())


@query("stale_watchdog", """
SELECT coalesce(a.owner_id, f.owner_id) AS owner_id, coalesce(a.dedupe_key, f.dedupe_key) AS dedupe_key, CASE WHEN f.dedupe_key IS NULL THEN 'RESOLVED' ELSE 'ACTIVE' END AS state,
  strftime(coalesce(a.first_seen, TIMESTAMP '2024-01-31'), '%Y-%m-%d %H:%M:%S') AS first_seen, f.message
FROM (SELECT * FROM alert_row WHERE state = 'ACTIVE') a FULL JOIN stale_row f ON f.owner_id = a.owner_id AND f.dedupe_key = a.dedupe_key""")
def _(t):
    return h.merge_alerts(alerts(t), firing(t), now()).select(
        "owner_id", "dedupe_key", "state", stamp("first_seen").alias("first_seen"), "message")


@query("alert_resolution", """
SELECT owner_id, dedupe_key FROM alert_row WHERE state = 'ACTIVE' AND dedupe_key NOT IN (SELECT dedupe_key FROM stale_row)""")
def _(t):
    return h.alert_resolution(alerts(t), firing(t)).select("owner_id", "dedupe_key")


@query("exhausted_jobs", """
SELECT job_id, CASE WHEN spent THEN 'FAILED' ELSE state END AS state, CASE WHEN spent THEN 'Worker retry limit reached. Check worker health and retry ' ||
  CASE kind WHEN 'ANALYZE' THEN 'analysis' WHEN 'RANK' THEN 'ranking' WHEN 'PLAN' THEN 'short planning' WHEN 'RENDER' THEN 'rendering' ELSE 'ingestion' END || '.' END AS error_message,
  CASE WHEN spent THEN 'WORKER_INTERRUPTED' END AS event_code, CASE WHEN spent THEN 3 END AS event_attempt
FROM (SELECT *, state IN ('PENDING', 'RUNNING', 'RETRYING') AND attempt >= 3 AND progress < 60 AS spent FROM job)""")
def _(t):
    jobs, events = h.exhausted_jobs(t.job, t.job.filter("progress >= 60"))
    told = events.select("job_id", F.col("error_code").alias("event_code"), F.col("attempt").alias("event_attempt"))
    return jobs.join(told, "job_id", "left").select("job_id", "state", "error_message", "event_code", "event_attempt")


@query("age_minutes", f"""
SELECT job_id, greatest(0, CAST(floor((epoch_us({NOW}) - epoch_us(updated_at)) / 60000000) AS BIGINT)) AS minutes FROM job""")
def _(t):
    return t.job.select("job_id", times.age_minutes("updated_at", now()).alias("minutes"))


@query("remote_state", f"""
WITH x AS (SELECT publication_id AS i, publish_at, split_part('uploaded|processed|failed|rejected', '|', CAST(publication_id % 4 AS INTEGER) + 1) AS up,
  split_part('private|public|unlisted', '|', CAST(publication_id // 4 % 3 AS INTEGER) + 1) AS pr FROM publication)
SELECT i AS publication_id, CASE WHEN i % 13 = 0 OR i % 17 = 0 THEN 'NEEDS_ATTENTION' WHEN up IN ('failed', 'rejected') OR i % 19 = 0 THEN 'FAILED'
  WHEN pr = 'public' THEN CASE WHEN TIMESTAMP '2024-01-15' < publish_at THEN 'NEEDS_ATTENTION' ELSE 'PUBLISHED' END
  WHEN TIMESTAMP '2024-01-15' >= publish_at THEN 'MISSED' WHEN pr <> 'private' OR i % 23 = 0 THEN 'NEEDS_ATTENTION' WHEN up = 'processed' THEN 'SCHEDULED' ELSE 'PROCESSING' END AS remote FROM x""")
def _(t):
    i = F.col("publication_id")
    rows = t.publication.select(
        "publication_id", "publish_at", F.lit("c1").alias("channel"),
        F.when(i % 13 == 0, F.lit(None).cast("string")).when(i % 17 == 0, "c2").otherwise("c1").alias("remote_channel"),
        F.expr("split_part('uploaded|processed|failed|rejected', '|', CAST(publication_id % 4 AS INTEGER) + 1)").alias("upload_status"),
        F.when(i % 19 == 0, "terminated").alias("processing_status"),
        F.expr("split_part('private|public|unlisted', '|', CAST(publication_id div 4 % 3 AS INTEGER) + 1)").alias("privacy"),
        F.when(i % 23 != 0, F.col("publish_at")).alias("remote_publish_at"))
    return rows.select("publication_id", h.remote_state(F.lit("2024-01-15").cast("timestamp")).alias("remote"))


@query("readiness_status", """
SELECT s.source_id, CASE WHEN mime = 'video/webm' OR status = 'FAILED' THEN 'degraded' WHEN coalesce(n, 0) > 0 THEN 'attention' ELSE 'healthy' END AS status
FROM source s LEFT JOIN (SELECT source_id, count(*) AS n FROM job WHERE state = 'RUNNING' AND attempt = 1 GROUP BY 1) j ON j.source_id = s.source_id""")
def _(t):
    critical = t.job.filter("state = 'RUNNING' AND attempt = 1").groupBy("source_id").agg(F.count("*").alias("critical"))
    rows = t.source.join(critical, "source_id", "left").select(
        "source_id", F.when(F.col("mime") == "video/webm", "unavailable").otherwise("healthy").alias("storage"),
        F.when(F.col("status") == "FAILED", "unavailable").otherwise("healthy").alias("worker"), F.coalesce("critical", F.lit(0)).alias("critical"))
    return rows.select("source_id", h.readiness_status(["storage", "worker"], "critical").alias("status"))


@query("backup_freshness", f"""
SELECT s.source_id AS owner_id, CAST(floor((epoch_us({NOW}) - epoch_us(v)) / 3600000000) AS BIGINT) AS age_hours, CASE WHEN v IS NULL THEN 'unverified'
  WHEN floor((epoch_us({NOW}) - epoch_us(v)) / 3600000000) <= 0 THEN 'current' ELSE 'stale' END AS backup
FROM source s LEFT JOIN (SELECT source_id, max(updated_at) AS v FROM job WHERE state = 'SUCCEEDED' GROUP BY 1) j ON j.source_id = s.source_id""")
def _(t):
    audits = t.job.filter("state = 'SUCCEEDED'").select(F.col("source_id").alias("owner_id"), F.col("updated_at").alias("verified_at"))
    owners = t.source.select(F.col("source_id").alias("owner_id"))
    return h.backup_freshness(audits, owners, now(), 0).select("owner_id", "age_hours", "backup")


@query("highlight_heuristic", """
WITH b AS (SELECT source_id, cluster_no, kinds, greatest(0, least(100, floor(signal_score * 0.72 + 18 + 0.5))) AS base FROM scored_sql)
SELECT source_id, cluster_no, CAST(base AS INTEGER) AS highlight, CAST(least(100, base + CASE WHEN list_contains(kinds, 'AUDIO_PEAK') THEN 8 ELSE -10 END) AS INTEGER) AS emotional,
  CAST(least(100, base + CASE WHEN list_contains(kinds, 'AUDIO_PEAK') AND list_contains(kinds, 'MOTION_PEAK') THEN 8 ELSE -12 END) AS INTEGER) AS chaos,
  CAST(greatest(0, base - 20) AS INTEGER) AS humor, CAST(least(100, base + CASE WHEN list_contains(kinds, 'SCENE_CHANGE') THEN 4 ELSE -8 END) AS INTEGER) AS surprise FROM b""")
def _(t):
    scores = h.highlight_heuristic()
    return e.profile_classify(scored(t)).select("source_id", "cluster_no", *[scores[c].alias(c) for c in ("highlight", "emotional", "chaos", "humor", "surprise")])


@query("concept_select", """
SELECT short_id, CASE WHEN context >= 60 THEN 'ACTION_FIRST' WHEN tension >= 60 THEN 'TENSION_FIRST' ELSE 'CONTEXT_FIRST' END AS concept_key FROM pool""")
def _(t):
    return t.pool.select("short_id", h.concept_select("context", "tension").alias("concept_key"))


@query("token_cost", """
SELECT price AS row_key, (input_tokens * 2.5::DOUBLE + output_tokens * 10.0::DOUBLE) / 1000000 AS cost_usd FROM ai_cache""")
def _(t):
    return t.ai_cache.select(F.col("price").alias("row_key"), token_cost("input_tokens", "output_tokens", 2.5, 10.0).alias("cost_usd"))


@query("logprob_confidence", """
SELECT signal_id, CASE WHEN signal_id % 11 <> 0 THEN round(greatest(0, least(1, exp(-value / 100))), 9) END AS confidence FROM signal""")
def _(t):
    return rounded(t.signal.select("signal_id", logprob_confidence(F.when(F.col("signal_id") % 11 != 0, -F.col("value") / 100)).alias("confidence")), "confidence", digits=9)


@query("readable_event", r"""
WITH x AS (SELECT short_id, split_part('COD_|FC-|GTA_|', '|', CAST(short_id % 4 AS INTEGER) + 1) || lower(event_type) || '_(big)__o''neil' AS t, event_type FROM short)
SELECT short_id, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || ' (Big) O''Neil' AS readable,
  upper(replace(replace(split_part('COD_|FC-|GTA_|', '|', CAST(short_id % 4 AS INTEGER) + 1), '_', ' '), '-', ' ') || event_type || ' (BIG) O''NEIL') AS label FROM x""")
def _(t):
    raw = F.concat(F.expr("split_part('COD_|FC-|GTA_|', '|', CAST(short_id % 4 AS INTEGER) + 1)"), F.lower("event_type"), F.lit("_(big)__o'neil"))
    return t.short.select("short_id", text.readable_event(raw).alias("readable"), text.truthful_label(raw).alias("label"))


@query("tag_clean_ban", r"""
SELECT short_id, array_to_string(list_filter(['#' || regexp_replace(lower(game), '[^a-z0-9_]', '', 'g'), CASE WHEN short_id % 2 = 0 THEN NULL ELSE '#gaming' END, '#shorts',
  '#' || lower(event_type)], lambda x: x IS NOT NULL), ',') AS tags FROM short""")
def _(t):
    banned = F.when(F.col("short_id") % 2 == 0, F.array(F.lit("#gaming"))).otherwise(F.array().cast("array<string>"))
    preferred = F.array(F.concat(F.lit("#"), F.lower("event_type")), F.lit("#shorts"))
    return t.short.select("short_id", F.array_join(text.tag_list("game", preferred, banned), ",").alias("tags"))


def payloads(t):
    i = F.col("source_id")
    row = F.concat(
        F.lit('{"candidateId":"c'), F.col("short_id").cast("string"), F.lit('","eventType":"'), "event_type", F.lit('","highlightScore":'),
        F.when(F.col("short_id") % 11 == 0, "140").otherwise(F.col("highlight").cast("string")), F.lit(',"confidence":'), F.col("confidence").cast("string"),
        F.lit(',"decision":"'), F.when(F.col("short_id") % 7 == 0, "MAYBE").otherwise("SELECTED"), F.lit('"}'))
    # An item's payload repeats it when its number ends in 5 and leaves it out when it ends in 8.
    kept = t.short.filter("short_id % 10 <> 8").select(i.alias("request_id"), F.when(F.col("short_id") % 10 == 5, F.concat(row, F.lit(","), row)).otherwise(row).alias("row"))
    listed = kept.groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_list("row")), ",").alias("rows"))
    whole = F.concat(F.lit('{"gameIdentification":{"game":"x","confidence":70},"rankings":['), "rows", F.lit("]}"))
    return listed.select("request_id", F.when(F.col("request_id") % 29 == 0, "not json").otherwise(whole).alias("payload"))


@query("ranking_payload_parse", """
SELECT source_id AS request_id, 'c' || short_id AS candidate_id, CASE WHEN short_id % 11 = 0 THEN 140 ELSE highlight END AS highlight,
  CASE WHEN short_id % 7 = 0 THEN 'MAYBE' ELSE 'SELECTED' END AS decision, short_id % 11 <> 0 AND short_id % 7 <> 0 AS valid
FROM short CROSS JOIN (SELECT unnest([1, 2]) AS n) WHERE short_id % 10 <> 8 AND (n = 1 OR short_id % 10 = 5) AND source_id % 29 <> 0
UNION ALL SELECT DISTINCT source_id, NULL, NULL, NULL, false FROM short WHERE source_id % 29 = 0 AND short_id % 10 <> 8""")
def _(t):
    return h.ranking_payload_parse(payloads(t))


@query("ranking_completeness", """
SELECT source_id AS request_id, count(*) FILTER (short_id % 10 = 8 OR source_id % 29 = 0) AS missing, count(*) FILTER (short_id % 10 = 5 AND source_id % 29 <> 0) AS repeated, CAST(0 AS BIGINT) AS invented,
  count(*) FILTER (short_id % 10 = 8 OR source_id % 29 = 0) = 0 AND count(*) FILTER (short_id % 10 = 5 AND source_id % 29 <> 0) = 0 AS complete FROM short GROUP BY 1""")
def _(t):
    expected = t.short.select(F.col("source_id").alias("request_id"), F.concat(F.lit("c"), F.col("short_id").cast("string")).alias("candidate_id"))
    returned = h.ranking_payload_parse(payloads(t)).filter("candidate_id IS NOT NULL")
    return h.ranking_completeness(expected, returned)
