"""Scan, parse, key and write queries."""

from pyspark.sql import functions as F

from cliploom.functions.text import joined_hash, report_key
from cliploom.functions.times import valid_date
from cliploom.plans.common import day, now
from cliploom.plans.registry import query
from cliploom.sources import ingest as i
from cliploom.sources.tables import TODAY
from cliploom.streaming.pipelines import work_dir


def result_tables(t):
    """One provider result table per observation row, as the provider would send it."""
    o = t.observation
    header = lambda name, kind, data: (
        '{"name":"' + name + '","columnType":"' + kind + '","dataType":"' + data + '"}'
    )
    heads = ",".join([
        header("day", "DIMENSION", "STRING"), header("video", "DIMENSION", "STRING"), header("views", "METRIC", "INTEGER"),
        header("likes", "METRIC", "INTEGER"), header("minutes", "METRIC", "FLOAT"),
    ])
    video = F.coalesce(F.concat(F.lit('"'), F.col("video_id").cast("string"), F.lit('"')), F.lit("null"))
    likes = F.when(F.col("observation_id") % 23 == 0, F.lit("-1")).when(
        F.col("observation_id") % 29 == 0, F.lit('""')).otherwise(F.col("likes").cast("string"))
    short_row = F.when(F.col("observation_id") % 31 == 0, "").otherwise(F.concat(F.lit(","), F.col("watch_minutes").cast("string")))
    body = F.concat(
        F.lit('{"kind":"report#resultTable","columnHeaders":[' + heads + '],"rows":[["'), day("report_date"), F.lit('",'),
        video, F.lit(","), F.col("views").cast("string"), F.lit(","), likes, short_row, F.lit("]]}"),
    )
    return o.select("observation_id", "owner_id", F.concat(F.lit("run"), F.col("observation_id") % 5).alias("run_id"), body.alias("body"))


@query("parse_result_table", """
SELECT observation_id, observation_id % 31 = 0 AS bad_width,
  CASE WHEN observation_id % 31 <> 0 THEN strftime(report_date, '%Y-%m-%d') END AS day,
  CASE WHEN observation_id % 31 <> 0 THEN CAST(video_id AS VARCHAR) END AS video,
  CASE WHEN observation_id % 31 <> 0 THEN CAST(views AS VARCHAR) END AS views
FROM observation""")
def _(t):
    f = lambda name: F.col("fields").getItem(name).alias(name)
    return i.parse_result_table(result_tables(t)).select("observation_id", "bad_width", f("day"), f("video"), f("views"))


@query("typed_metric_cast", """
SELECT observation_id, CASE WHEN observation_id % 23 = 0 OR observation_id % 29 = 0 THEN NULL ELSE likes END AS likes,
  observation_id % 23 = 0 AS rejected, watch_minutes AS minutes
FROM observation WHERE observation_id % 31 <> 0""")
def _(t):
    parsed = i.parse_result_table(result_tables(t)).filter("NOT bad_width")
    likes, minutes = F.col("fields").getItem("likes"), F.col("fields").getItem("minutes")
    return parsed.select(
        "observation_id", i.integer_value(likes).alias("likes"), i.integer_invalid(likes).alias("rejected"),
        i.number_value(minutes).alias("minutes"),
    )


@query("report_key", """
SELECT observation_id, sha256('run' || chr(0) || 'activity' || chr(0) || strftime(report_date, '%Y-%m-%d') || chr(0)
  || coalesce(CAST(video_id AS VARCHAR), 'channel')) AS report_key FROM observation""")
def _(t):
    return t.observation.select(
        "observation_id",
        report_key(F.lit("run"), F.lit("activity"), day("report_date"), F.coalesce(F.col("video_id").cast("string"), F.lit("channel")))
        .alias("report_key"),
    )


@query("observation_records", """
SELECT sha256('run' || (observation_id % 5) || chr(0) || 'activity' || chr(0) || strftime(report_date, '%Y-%m-%d') || chr(0)
    || coalesce(CAST(o.video_id AS VARCHAR), 'channel')) AS report_key, o.owner_id, scope, o.video_id,
  CASE WHEN observation_id % 23 = 0 OR observation_id % 29 = 0 THEN NULL ELSE likes END AS likes, views, watch_minutes,
  p.publication_id
FROM observation o LEFT JOIN (SELECT * FROM publication WHERE video_id IS NOT NULL) p
  ON p.owner_id = o.owner_id AND p.video_id = o.video_id
WHERE observation_id % 31 <> 0""")
def _(t):
    return i.observation_records(i.parse_result_table(result_tables(t)), t.publication).select(
        "report_key", "owner_id", "scope", "video_id", "likes", "views", "watch_minutes", "publication_id"
    )


@query("scan_union_reports", """
SELECT owner_id, report_date, video_id, views FROM (
  SELECT owner_id, strftime(report_date, '%Y-%m-%d') AS report_date, CAST(NULL AS BIGINT) AS video_id, views FROM observation WHERE scope = 'CHANNEL'
  UNION ALL SELECT owner_id, strftime(report_date, '%Y-%m-%d'), video_id, views FROM observation WHERE scope = 'VIDEO')""")
def _(t):
    o = t.observation.withColumn("report_date", day("report_date"))
    channel = o.filter("scope = 'CHANNEL'").select("owner_id", "report_date", "views")
    videos = o.filter("scope = 'VIDEO'").select("owner_id", "report_date", "views", "video_id")
    return i.scan_union_reports(channel, videos).select("owner_id", "report_date", "video_id", "views")


@query("idempotent_append", """
WITH k AS (SELECT observation_id, sha256(owner_id || chr(0) || coalesce(CAST(video_id AS VARCHAR), 'channel') || chr(0)
    || strftime(report_date, '%Y-%m-%d')) AS report_key, report_date FROM observation)
SELECT DISTINCT report_key FROM k""")
def _(t):
    keyed = t.observation.select(
        report_key("owner_id", F.coalesce(F.col("video_id").cast("string"), F.lit("channel")), day("report_date")).alias("report_key"),
        "report_date",
    )
    path = work_dir(t.spark, "reports")
    i.append_once(keyed.filter("report_date <= DATE '2024-01-20'").select("report_key"), path, "report_key")
    i.append_once(keyed.select("report_key"), path, "report_key")
    return t.spark.read.parquet(path).select("report_key")


@query("sync_window_plan", """
WITH runs AS (SELECT s.source_id AS owner_id, j.state, j.updated_at AS finished_at FROM source s JOIN job j ON j.source_id = s.source_id),
st AS (SELECT owner_id, bool_or(state NOT IN ('SUCCEEDED', 'FAILED', 'CANCELLED')) AS active,
    max(finished_at) FILTER (state = 'SUCCEEDED') AS latest FROM runs GROUP BY 1),
e AS (SELECT k.source_id AS owner_id, CAST(min(publish_at) AS DATE) AS earliest FROM publication p JOIN short k ON k.short_id = p.short_id
  WHERE video_id IS NOT NULL GROUP BY 1)
SELECT s.source_id AS owner_id, strftime(CASE WHEN latest IS NOT NULL THEN DATE '2024-01-04'
    ELSE least(DATE '2023-11-03', coalesce(earliest, DATE '2023-11-03')) END, '%Y-%m-%d') AS start_date, '2024-01-31' AS end_date
FROM source s LEFT JOIN st ON st.owner_id = s.source_id LEFT JOIN e ON e.owner_id = s.source_id
WHERE NOT coalesce(active, false) AND (latest IS NULL OR latest <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 MINUTE)""")
def _(t):
    connections = t.source.select(F.col("source_id").alias("owner_id"))
    runs = t.job.select(F.col("source_id").alias("owner_id"), "state", F.col("updated_at").alias("finished_at"))
    pubs = t.publication.select("short_id", "video_id", "publish_at").join(
        t.short.select("short_id", F.col("source_id").alias("owner_id")), "short_id")
    out = i.sync_window_plan(connections, pubs, runs, TODAY, now(), interval_minutes=30)
    return out.select("owner_id", day("start_date").alias("start_date"), day("end_date").alias("end_date"))


@query("availability_state", """
SELECT s.source_id, CASE WHEN segment = 'HOUSEHOLD' THEN 'REAUTH_REQUIRED' WHEN s.source_id % 13 = 0 THEN 'UNAVAILABLE'
  WHEN coalesce(n, 0) = 0 THEN 'NO_DATA' ELSE 'AVAILABLE' END AS state
FROM source s LEFT JOIN (SELECT video_id, count(*) AS n FROM observation GROUP BY 1) o ON o.video_id = s.source_id""")
def _(t):
    rows = t.observation.groupBy("video_id").agg(F.count("*").alias("n"))
    joined = t.source.join(rows, F.col("video_id") == F.col("source_id"), "left")
    return joined.select(
        "source_id",
        i.availability_state(F.col("segment") != "HOUSEHOLD", F.col("source_id") % 13 == 0, "n").alias("state"),
    )


PART_BYTES = 2000


@query("part_manifest_check", f"""
WITH up AS (SELECT doc_id AS upload_id, encode(coalesce(text, '')) AS body, octet_length(encode(coalesce(text, ''))) AS total_bytes FROM documents),
cut AS (SELECT upload_id, total_bytes, CAST(no AS BIGINT) AS no, body[no * {PART_BYTES} + 1:(no + 1) * {PART_BYTES}] AS content
  FROM (SELECT *, unnest(range(0, CAST(ceil(total_bytes / {PART_BYTES}) AS BIGINT))) AS no FROM up)),
listed AS (SELECT upload_id, no, CASE WHEN upload_id % 11 = 3 AND no = 1 THEN 0 ELSE no END AS part_no, content FROM cut
  WHERE NOT (upload_id % 11 = 2 AND no = total_bytes // {PART_BYTES})
  UNION ALL SELECT upload_id, no, no, content FROM cut WHERE upload_id % 11 = 1 AND no = 0),
judged AS (SELECT l.upload_id, part_no, octet_length(l.content) AS part_bytes,
    l.upload_id % 11 = 0 AND part_no = 1 OR l.upload_id % 11 = 4 AND part_no = 0 OR sha256(l.content) <> sha256(c.content) OR c.content IS NULL AS corrupt
  FROM listed l LEFT JOIN cut c ON c.upload_id = l.upload_id AND c.no = l.part_no),
g AS (SELECT upload_id, count(*) AS parts, count(DISTINCT part_no) AS numbers, count(*) - count(DISTINCT part_no) AS repeated,
    count(*) FILTER (part_bytes <> least({PART_BYTES}, total_bytes - part_no * {PART_BYTES})) AS wrong_size, count(*) FILTER (corrupt) AS corrupt
  FROM judged JOIN up USING (upload_id) GROUP BY 1),
f AS (SELECT up.upload_id, CAST(ceil(total_bytes / {PART_BYTES}) AS BIGINT) AS expected_parts, coalesce(parts, 0) AS parts, coalesce(numbers, 0) AS numbers,
    coalesce(repeated, 0) AS repeated, coalesce(wrong_size, 0) AS wrong_size, coalesce(corrupt, 0) AS corrupt FROM up LEFT JOIN g USING (upload_id)),
c AS (SELECT *, CASE WHEN numbers < expected_parts OR repeated > 0 OR parts <> expected_parts THEN 'MISSING_PARTS'
    WHEN corrupt > 0 OR wrong_size > 0 THEN 'CORRUPT_PART' END AS code FROM f)
SELECT upload_id, expected_parts, parts, expected_parts - numbers AS missing, repeated, wrong_size, corrupt, code, code IS NULL AS complete FROM c""")
def _(t):
    whole = t.base("documents").selectExpr("doc_id AS upload_id", "cast(coalesce(text, '') AS binary) AS body").selectExpr(
        "upload_id", "body", "cast(length(body) AS bigint) AS total_bytes")
    cut = whole.filter("total_bytes > 0").selectExpr(
        "upload_id", "total_bytes", "body", f"explode(sequence(0L, cast(ceil(total_bytes / {PART_BYTES}) - 1 AS bigint))) AS no"
    ).selectExpr("upload_id", "total_bytes", "no", f"substring(body, cast(no * {PART_BYTES} + 1 AS int), {PART_BYTES}) AS content")
    path = work_dir(t.spark, "parts")
    # what lies in storage: some contents are not what was sent, one upload in eleven lost its last part
    lost = f"upload_id % 11 = 2 AND no = total_bytes div {PART_BYTES}"
    bad = "(upload_id % 11 = 0 AND no = 1) OR (upload_id % 11 = 4 AND no = 0)"
    cut.filter(f"NOT ({lost})").selectExpr(
        "upload_id", "no AS part_no", f"CASE WHEN {bad} THEN cast(concat(cast(content AS string), '!') AS binary) ELSE content END AS content"
    ).write.parquet(path)
    listed = cut.filter(f"NOT ({lost})").selectExpr("upload_id", "CASE WHEN upload_id % 11 = 3 AND no = 1 THEN 0L ELSE no END AS part_no", "content").unionByName(
        cut.filter("upload_id % 11 = 1 AND no = 0").selectExpr("upload_id", "no AS part_no", "content"))
    manifest = listed.selectExpr("upload_id", "part_no", "cast(length(content) AS bigint) AS part_bytes", "sha2(content, 256) AS sha256")
    uploads = whole.selectExpr("upload_id", "total_bytes", f"cast({PART_BYTES} AS bigint) AS chunk_bytes")
    return i.part_manifest_check(uploads, manifest, t.spark.read.parquet(path))


@query("probe_validate", """
SELECT source_id,
  CASE WHEN source_id % 17 = 0 THEN 'INVALID_METADATA' WHEN mime = 'video/webm' AND source_id % 2 = 0 THEN 'FORMAT_MISMATCH'
    WHEN source_id % 9000 < 16 THEN 'INVALID_RESOLUTION' WHEN source_id % 7 = 3 THEN 'UNSUPPORTED_CODEC'
    WHEN duration_s IS NULL OR duration_s <= 0 THEN 'INVALID_DURATION' WHEN source_id % 11 = 5 THEN 'INVALID_FRAME_RATE' END AS code,
  CASE WHEN source_id % 17 <> 0 THEN duration_s END AS duration_s,
  CASE WHEN source_id % 17 <> 0 THEN CAST(source_id % 9000 AS INTEGER) END AS width,
  source_id % 17 <> 0 AND source_id % 4 <> 0 AS has_audio,
  CASE WHEN source_id % 17 <> 0 AND source_id % 11 <> 5 THEN 30000.0 / 1001 END AS frame_rate
FROM source""")
def _(t):
    s = t.source
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    width = (F.col("source_id") % 9000).cast("string")
    codec = F.when(F.col("source_id") % 7 == 3, "gif").otherwise("h264")
    fps = F.when(F.col("source_id") % 11 == 5, "30/0").otherwise("30000/1001")
    names = F.when(F.col("mime") == "video/webm", F.when(F.col("source_id") % 2 == 0, "mov,mp4").otherwise("matroska,webm")).otherwise("mov,mp4,m4a")
    audio = F.when(F.col("source_id") % 4 != 0, ',{"codec_type":"audio","codec_name":"aac"}').otherwise("")
    length = F.when(F.col("duration_s").isNull(), F.lit("")).otherwise(
        F.concat(F.lit(',"duration":'), quoted(F.col("duration_s").cast("string"))))
    probe = F.when(F.col("source_id") % 17 == 0, F.lit('{"streams": 1}')).otherwise(F.concat(
        F.lit('{"streams":[{"codec_type":"video","codec_name":'), quoted(codec), F.lit(',"width":'), width,
        F.lit(',"height":720,"avg_frame_rate":'), quoted(fps), F.lit("}"), audio, F.lit('],"format":{"format_name":'),
        quoted(names), length, F.lit("}}"),
    ))
    out = i.probe_validate(s.select("source_id", "mime", probe.alias("probe")))
    return out.select("source_id", "code", "duration_s", "width", "has_audio", "frame_rate")


@query("filename_mime_check", """
SELECT source_id, (mime = 'video/mp4' AND filename LIKE '%.mp4') OR (mime = 'video/quicktime' AND filename LIKE '%.mov')
  OR (mime = 'video/webm' AND filename LIKE '%.webm') AS matches FROM source""")
def _(t):
    return t.source.select("source_id", i.extension_matches("filename", "mime").alias("matches"))


@query("versioned_append", """
WITH v AS (SELECT source_id, max(job_id) AS version, max_by(state, job_id) AS status FROM job WHERE kind = 'ANALYZE' GROUP BY 1)
SELECT s.source_id, CASE WHEN v.status IN ('RUNNING', 'RETRYING') THEN version ELSE coalesce(version, 0) + 1 END AS version,
  CASE WHEN v.status IN ('RUNNING', 'RETRYING') THEN 'REUSED' ELSE 'CREATED' END AS action
FROM source s LEFT JOIN v ON v.source_id = s.source_id""")
def _(t):
    existing = t.job.filter("kind = 'ANALYZE'").select("source_id", F.col("job_id").alias("version"), F.col("state").alias("status"))
    return i.versioned_append(existing, t.source.select("source_id"), "source_id")


@query("keyed_upsert", """
WITH n AS (SELECT video_id, views, observation_id FROM observation WHERE scope = 'VIDEO' AND report_date > DATE '2024-01-20'),
c AS (SELECT video_id, arg_max(views, observation_id) AS views, max(observation_id) AS observation_id FROM observation
  WHERE scope = 'VIDEO' AND report_date <= DATE '2024-01-20' GROUP BY 1),
i AS (SELECT video_id, arg_max(views, observation_id) AS views, max(observation_id) AS observation_id FROM n GROUP BY 1)
SELECT coalesce(i.video_id, c.video_id) AS video_id, CASE WHEN i.video_id IS NULL THEN c.views ELSE i.views END AS views,
  coalesce(i.observation_id, c.observation_id) AS observation_id FROM c FULL OUTER JOIN i ON i.video_id = c.video_id""")
def _(t):
    rows = t.observation.filter("scope = 'VIDEO'").select("video_id", "views", "observation_id", "report_date")
    current = rows.filter("report_date <= DATE '2024-01-20'").drop("report_date")
    incoming = rows.filter("report_date > DATE '2024-01-20'").drop("report_date")
    path = work_dir(t.spark, "videos")
    i.upsert_table(current, path, ["video_id"], "observation_id")
    return i.upsert_table(incoming, path, ["video_id"], "observation_id").read().select("video_id", "views", "observation_id")


@query("content_hash_key", """
SELECT short_id, sha256('{"game":"' || game || '","eventType":"' || event_type || '","highlight":' || highlight || '}') AS input_hash FROM short""")
def _(t):
    return t.short.select("short_id", i.content_hash_key(game="game", eventType="event_type", highlight="highlight").alias("input_hash"))


@query("supersede_active", """
SELECT owner_id, version, config, lag(config) OVER (PARTITION BY owner_id ORDER BY version) AS previous_config,
  CASE WHEN version = max(version) OVER (PARTITION BY owner_id) THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS state
FROM (SELECT o_custkey AS owner_id, o_orderkey AS version, o_orderpriority AS config FROM orders)""")
def _(t):
    versions = t.base("orders").selectExpr("o_custkey AS owner_id", "o_orderkey AS version", "o_orderpriority AS config")
    return i.supersede_active(versions)


@query("report_sink", """
SELECT state, count(*) AS shorts, round(avg(quality), 6) AS mean_quality FROM short GROUP BY state""")
def _(t):
    report = t.short.groupBy("state").agg(F.count("*").alias("shorts"), F.round(F.avg("quality"), 6).alias("mean_quality"))
    path = work_dir(t.spark, "report")
    i.write_report(report, path)
    return i.read_report(t.spark, path, report.schema)


@query("backfill_columns", """
SELECT l_orderkey AS short_id, l_linenumber AS line_no, l_partkey AS part_no, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END, duration_s) AS duration_s
FROM lineitem LEFT JOIN short ON short_id = l_orderkey""")
def _(t):
    rows = t.base("lineitem").selectExpr(
        "l_orderkey AS short_id", "l_linenumber AS line_no", "l_partkey AS part_no",
        "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS duration_s")
    return i.backfill_columns(rows, t.short, "short_id", {"duration_s": "duration_s"})


@query("conditional_default_migration", """
SELECT source_id, CASE WHEN a = 2 AND b = 10 THEN 3 ELSE a END AS max_source_per_day, CASE WHEN a = 2 AND b = 10 THEN 0 ELSE b END AS cooldown_minutes
FROM (SELECT source_id, CAST(source_id % 3 + 1 AS INTEGER) AS a, CAST(source_id % 2 * 10 AS INTEGER) AS b FROM source)""")
def _(t):
    settings = t.source.selectExpr(
        "source_id", "CAST(source_id % 3 + 1 AS INTEGER) AS max_source_per_day", "CAST(source_id % 2 * 10 AS INTEGER) AS cooldown_minutes")
    return i.migrate_defaults(
        settings, {"max_source_per_day": 2, "cooldown_minutes": 10}, {"max_source_per_day": 3, "cooldown_minutes": 0})


@query("text_fingerprint", """
SELECT short_id, sha256(game || ' ' || event_type || ' ' || concept || ' ' || title || ' ' || hook) AS text_hash FROM pool""")
def _(t):
    return t.pool.select("short_id", joined_hash("game", "event_type", "concept", "title", "hook").alias("text_hash"))


@query("date_arith", """
SELECT DISTINCT strftime(report_date, '%Y-%m-%d') AS day, strftime(report_date - 1, '%Y-%m-%d') AS before,
  strftime(report_date + 28, '%Y-%m-%d') AS after, true AS valid, false AS valid_shifted FROM observation""")
def _(t):
    d = t.observation.select("report_date").distinct()
    text = day("report_date")
    return d.select(
        text.alias("day"), day(F.date_add("report_date", -1)).alias("before"), day(F.date_add("report_date", 28)).alias("after"),
        valid_date(text).alias("valid"), valid_date(F.regexp_replace(text, r"-\d\d$", "-32")).alias("valid_shifted"),
    )
