"""Planning, calendar and campaign queries."""

from pyspark.sql import functions as F

from cliploom.functions import table_functions, text, times
from cliploom.operators import planning as p
from cliploom.operators import reporting as r
from cliploom.operators import similarity as sim
from cliploom.plans import compare_sql as q
from cliploom.plans.common import day, now, rounded, stamp
from cliploom.plans.registry import query
from cliploom.session import cut_lineage
from cliploom.sources.tables import DUCK_VIEWS, TODAY

HERO = """(0.2 * highlight + 0.1 * {pred} + 0.15 * hook_potential + 0.15 * retention + 0.1 * emotional + 0.1 * novelty + 0.1 * share + 0.1 * quality)::DOUBLE"""
DISC = "(0.35 * context + 0.2 * clarity + 0.2 * surprise + 0.15 * humor + 0.1 * greatest(0, 100 - duration_s * 2))::DOUBLE"
ENG = "(0.35 * share + 0.25 * emotional + 0.2 * humor + 0.2 * tension)::DOUBLE"
PRED = "CASE WHEN short_id % 9 = 0 THEN highlight ELSE CAST((short_id * 17) % 1000 AS DOUBLE) / 10 END"
DUCK_VIEWS["role_sql"] = f"SELECT *, {HERO.format(pred=PRED)} AS hero, {DISC} AS discovery, {ENG} AS engagement FROM pool_t"


def scored_pool(t):
    predicted = F.when(F.col("short_id") % 9 != 0, (F.col("short_id") * 17 % 1000).cast("double") / 10)
    return p.with_role_scores(sim.comparable(t.pool, t.vector).withColumn("predicted", predicted))


@query("role_score", "SELECT short_id, round(hero, 6) AS hero, round(discovery, 6) AS discovery, round(engagement, 6) AS engagement FROM role_sql")
def _(t):
    predicted = F.when(F.col("short_id") % 9 != 0, (F.col("short_id") * 17 % 1000).cast("double") / 10)
    return rounded(p.with_role_scores(t.pool.withColumn("predicted", predicted)).select(
        "short_id", "hero", "discovery", "engagement"), "hero", "discovery", "engagement")


@query("tone_argmax", """
SELECT short_id, CASE greatest(humor, tension, emotional, skill, surprise) WHEN humor THEN 'humor' WHEN tension THEN 'tension' WHEN emotional THEN 'emotional'
  WHEN skill THEN 'skill' ELSE 'surprise' END AS tone FROM pool""")
def _(t):
    return t.pool.select("short_id", p.tone_argmax(["humor", "tension", "emotional", "skill", "surprise"]).alias("tone"))


@query("template_key", """
SELECT short_id, 'SMART_CROP:' || CASE WHEN short_id % 7 = 0 THEN 'REPLAY' WHEN short_id % 3 > 0 THEN 'ZOOM' ELSE 'CLEAN' END AS template FROM short""")
def _(t):
    return t.short.select("short_id", text.template_key(
        F.lit("SMART_CROP"), F.col("short_id") % 7 == 0, F.col("short_id") % 3 > 0).alias("template"))


@query("eligible_pool", """
SELECT short_id FROM short s WHERE state = 'READY' AND publishable AND analysis_method = 'AI' AND review_state <> 'REJECTED'
  AND EXISTS (SELECT 1 FROM render r WHERE r.short_id = s.short_id AND r.state = 'READY' AND preset = 'HIGH')""")
def _(t):
    return p.eligible_pool(t.short, t.render).select("short_id")


@query("eligible_autopilot", """
SELECT short_id, state = 'READY' AND rights_ok AND len(trim(title)) > 0 AND (review_state = 'APPROVED' OR (review_state = 'PENDING' AND s.owner_id % 2 = 0
  AND quality >= 50 AND confidence >= 40 AND highlight >= 45)) AS eligible FROM short s JOIN (SELECT source_id, rights_ok FROM source) USING (source_id)""")
def _(t):
    joined = t.short.join(t.source.select("source_id", "rights_ok"), "source_id")
    ok = (F.col("state") == "READY") & F.col("rights_ok") & (F.length(F.trim("title")) > 0)
    return joined.select("short_id", (ok & p.autopilot_ready(50, 40, 45, F.col("owner_id") % 2 == 0)).alias("eligible"))


DUCK_VIEWS["newest_render"] = "SELECT * FROM render QUALIFY row_number() OVER (PARTITION BY short_id ORDER BY created_at DESC, render_rank DESC) = 1"


@query("publication_preflight", """
SELECT slot_id, s.short_id, array_to_string(list_filter([CASE WHEN s.state = 'READY' THEN NULL ELSE 'state' END, CASE WHEN r.state = 'READY' THEN NULL ELSE 'render' END,
  CASE WHEN store_no IS NOT NULL THEN NULL ELSE 'stored' END, CASE WHEN sha_no IS NOT NULL THEN NULL ELSE 'hash' END, CASE WHEN qty > 0 THEN NULL ELSE 'bytes' END,
  CASE WHEN preset = 'HIGH' THEN NULL ELSE 'preset' END, CASE WHEN publishable THEN NULL ELSE 'publishable' END, CASE WHEN analysis_method = 'AI' THEN NULL ELSE 'method' END,
  CASE WHEN rights_ok THEN NULL ELSE 'rights' END,
  CASE WHEN review_state = 'APPROVED' OR (review_state = 'PENDING' AND quality >= 50 AND confidence >= 40 AND highlight >= 45) THEN NULL ELSE 'approved' END,
  CASE WHEN planned_at >= TIMESTAMP '2024-01-31 00:10:00' THEN NULL ELSE 'lead' END], lambda x: x IS NOT NULL), ',') AS failed
FROM slot k JOIN short s ON s.short_id = k.short_id LEFT JOIN newest_render r ON r.short_id = s.short_id
LEFT JOIN (SELECT source_id, rights_ok FROM source) c ON c.source_id = s.source_id""")
def _(t):
    rights = t.source.select("source_id", "rights_ok")
    out = p.publication_preflight(t.slot, t.short, t.render, rights, now())
    return out.select("slot_id", "short_id", F.array_join("failed", ",").alias("failed"))


@query("preferred_render", """
SELECT short_id, render_no, preset, frame_rate FROM render WHERE state = 'READY'
QUALIFY row_number() OVER (PARTITION BY short_id ORDER BY preset = 'HIGH' DESC, created_at DESC, render_rank DESC) = 1""")
def _(t):
    return p.preferred_render(t.render).select("short_id", "render_no", "preset", "frame_rate")


@query("publication_gate", """
SELECT publication_id FROM publication WHERE owner_id NOT IN (2, 5) OR cancel_requested""")
def _(t):
    paused = t.publication.select("owner_id").distinct().withColumn("paused", F.col("owner_id").isin(2, 5))
    return p.publication_gate(t.publication, paused).select("publication_id")


@query("slot_state_join", """
SELECT slot_id, k.short_id, coalesce(p.state, CASE WHEN k.short_id IS NULL THEN 'MISSING' ELSE 'RESERVED' END) AS slot_state
FROM slot k LEFT JOIN publication p ON p.short_id = k.short_id""")
def _(t):
    return r.slot_state(t.slot, t.publication).select("slot_id", "short_id", "slot_state")


@query("adjacent_slots", """
SELECT owner_id, arg_max(short_id, (planned_at, slot_id)) FILTER (local_date < DATE '2024-01-31') AS previous_id,
  arg_min(short_id, (planned_at, slot_id)) FILTER (local_date > DATE '2024-01-31') AS next_id FROM slot WHERE short_id IS NOT NULL GROUP BY 1""")
def _(t):
    return p.adjacent_slots(t.slot, TODAY)


@query("slate_buffer", """
SELECT owner_id, count(*) FILTER (f AND short_id IS NOT NULL) AS reserved, count(*) FILTER (f AND short_id IS NULL) AS missing,
  CAST(floor(count(*) FILTER (f AND short_id IS NOT NULL) / 3) AS BIGINT) AS days_of_buffer FROM (SELECT *, planned_at > TIMESTAMP '2024-01-31' AS f FROM slot) GROUP BY 1""")
def _(t):
    return r.slate_buffer(t.slot, now())


@query("calendar_fill", """
SELECT o.owner_id, strftime(d, '%Y-%m-%d') AS local_date, coalesce(n, 0) AS reserved
FROM (SELECT DISTINCT owner_id FROM slot) o CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-29', INTERVAL 1 DAY)) AS DATE) AS d) c
LEFT JOIN (SELECT owner_id, local_date, count(short_id) AS n FROM slot GROUP BY ALL) s ON s.owner_id = o.owner_id AND s.local_date = d""")
def _(t):
    return r.calendar_fill(t.slot, "2024-01-01", "2024-02-29").select("owner_id", day("local_date").alias("local_date"), "reserved")


def campaigns(t):
    """One 30-day campaign per owner, in the owner's zone."""
    zone = F.expr("CASE owner_id % 3 WHEN 0 THEN 'Africa/Accra' WHEN 1 THEN 'Asia/Kathmandu' ELSE 'America/New_York' END")
    start = F.expr("date_add(DATE'2024-01-01', CAST(owner_id * 2 AS INT))")
    return t.publication.select("owner_id").distinct().select(
        F.col("owner_id").alias("campaign_id"), "owner_id", zone.alias("timezone"), start.alias("start_date"),
        F.date_add(start, 29).alias("end_date"))


DUCK_VIEWS["campaign_sql"] = """
  SELECT owner_id AS campaign_id, owner_id, CASE owner_id % 3 WHEN 0 THEN 'Africa/Accra' WHEN 1 THEN 'Asia/Kathmandu' ELSE 'America/New_York' END AS timezone,
    DATE '2024-01-01' + CAST(owner_id * 2 AS INTEGER) AS start_date, DATE '2024-01-01' + CAST(owner_id * 2 + 29 AS INTEGER) AS end_date
  FROM (SELECT DISTINCT owner_id FROM publication)"""
LOCAL = "CAST(publish_at AT TIME ZONE 'UTC' AT TIME ZONE timezone AS DATE)"


@query("campaign_range_join", f"""
SELECT campaign_id, publication_id, strftime({LOCAL}, '%Y-%m-%d') AS local_date FROM campaign_sql c JOIN publication p ON p.owner_id = c.owner_id
WHERE {LOCAL} BETWEEN start_date AND end_date""")
def _(t):
    return p.campaign_range_join(campaigns(t), t.publication).select("campaign_id", "publication_id", day("local_date").alias("local_date"))


@query("campaign_progress", f"""
WITH d AS (SELECT campaign_id, count(*) FILTER (state = 'PUBLISHED') AS published, count(*) FILTER (state = 'SCHEDULED') AS scheduled
  FROM campaign_sql c JOIN publication p ON p.owner_id = c.owner_id WHERE {LOCAL} BETWEEN start_date AND end_date GROUP BY 1),
h AS (SELECT campaign_id, count(*) AS reserved FROM campaign_sql c JOIN slot s ON s.owner_id = c.owner_id WHERE local_date BETWEEN start_date AND end_date
  AND s.short_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM publication p WHERE p.short_id = s.short_id AND p.state <> 'PENDING') GROUP BY 1)
SELECT c.campaign_id, coalesce(published, 0) AS published, coalesce(scheduled, 0) AS scheduled, coalesce(reserved, 0) AS reserved,
  greatest(0, 90 - (coalesce(published, 0) + coalesce(scheduled, 0) + coalesce(reserved, 0))) AS missing,
  CAST(least(100, floor((coalesce(published, 0) + coalesce(scheduled, 0) + coalesce(reserved, 0)) / 90 * 100 + 0.5)) AS BIGINT) AS coverage_pct
FROM campaign_sql c LEFT JOIN d USING (campaign_id) LEFT JOIN h USING (campaign_id)""")
def _(t):
    pubs = t.publication.withColumn("state", F.when(F.col("state") == "PENDING", "CANCELLED").otherwise(F.col("state")))
    return r.campaign_progress(campaigns(t), pubs, t.slot).select(
        "campaign_id", "published", "scheduled", "reserved", "missing", "coverage_pct")


@query("reserved_unpublished", """
SELECT slot_id FROM slot s WHERE short_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM publication p WHERE p.short_id = s.short_id AND state <> 'PENDING')""")
def _(t):
    pubs = t.publication.withColumn("state", F.when(F.col("state") == "PENDING", "CANCELLED").otherwise(F.col("state")))
    return p.reserved_unpublished(t.slot, pubs).select("slot_id")


@query("frozen_slot_invalidate", """
SELECT slot_id, CASE WHEN inv THEN NULL ELSE short_id END AS short_id, inv AS invalidated FROM (
  SELECT slot_id, short_id, planned_at > TIMESTAMP '2024-01-31' AND short_id IS NOT NULL AND short_id NOT IN (SELECT short_id FROM publication WHERE state <> 'PENDING') AS inv FROM slot)""")
def _(t):
    pubs = t.publication.withColumn("state", F.when(F.col("state") == "PENDING", "CANCELLED").otherwise(F.col("state")))
    return p.frozen_slot_invalidate(t.slot, pubs, now()).select("slot_id", "short_id", "invalidated")


@query("archive_on_reanalysis", """
SELECT s.short_id, CASE WHEN c.status = 'ANALYZING' THEN 'ARCHIVED' ELSE s.state END AS state, CASE WHEN c.status = 'ANALYZING' THEN false ELSE publishable END AS publishable
FROM short s LEFT JOIN (SELECT source_id, status FROM source) c ON c.source_id = s.source_id""")
def _(t):
    again = t.source.filter("status = 'ANALYZING'")
    return p.archive_on_reanalysis(t.short, t.slot, again)[0].select("short_id", "state", "publishable")


def plan_runs(t):
    return t.job.select(
        (F.col("job_id") % 7).alias("owner_id"), F.expr("date_add(DATE'2024-01-01', CAST(source_id % 6000 AS INT))").alias("local_date"),
        "state", F.col("updated_at").alias("created_at"), "job_id")


@query("campaign_day_requests", """
SELECT campaign_id, strftime(d, '%Y-%m-%d') AS local_date FROM (SELECT campaign_id, owner_id, CAST(unnest(generate_series(start_date, start_date + 29, INTERVAL 1 DAY)) AS DATE) AS d FROM campaign_sql) c
WHERE NOT EXISTS (SELECT 1 FROM job j WHERE j.job_id % 7 = c.owner_id AND DATE '2024-01-01' + CAST(source_id % 6000 AS INTEGER) = d
  AND state IN ('PENDING', 'RUNNING', 'RETRYING', 'SUCCEEDED'))""")
def _(t):
    runs = plan_runs(t)
    return p.campaign_day_requests(campaigns(t), runs).select("campaign_id", day("local_date").alias("local_date"))


@query("horizon_plan_dates", """
WITH s AS (SELECT owner_id, timezone, CAST(TIMESTAMP '2024-01-31' AT TIME ZONE 'UTC' AT TIME ZONE timezone AS DATE) AS today FROM campaign_sql),
d AS (SELECT owner_id, timezone, CAST(unnest(generate_series(today, today + 6, INTERVAL 1 DAY)) AS DATE) AS local_date FROM s),
f AS (SELECT *, (local_date + INTERVAL 9 HOUR) AT TIME ZONE timezone AT TIME ZONE 'UTC' AS first_slot FROM d)
SELECT owner_id, strftime(local_date, '%Y-%m-%d') AS local_date, strftime(first_slot, '%Y-%m-%d %H:%M:%S') AS first_slot FROM f WHERE first_slot > TIMESTAMP '2024-01-31'
  AND NOT EXISTS (SELECT 1 FROM slot k WHERE k.owner_id = f.owner_id AND k.local_date = f.local_date GROUP BY k.owner_id HAVING count(*) >= 3 AND count(*) = count(short_id))
  AND NOT EXISTS (SELECT 1 FROM job j WHERE j.job_id % 7 = f.owner_id AND DATE '2024-01-01' + CAST(source_id % 6000 AS INTEGER) = f.local_date
    AND (state IN ('PENDING', 'RUNNING', 'RETRYING') OR updated_at > TIMESTAMP '2024-01-30 23:00:00'))""")
def _(t):
    settings = campaigns(t).select("owner_id", "timezone", F.lit("09:00").alias("first_time"), F.lit(7).alias("buffer_days"))
    runs = plan_runs(t)
    out = p.horizon_plan_dates(settings, t.slot, runs, now())
    return out.select("owner_id", day("local_date").alias("local_date"), stamp("first_slot").alias("first_slot"))


@query("local_date", """
SELECT publication_id, strftime(publish_at AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d') AS tokyo,
  strftime(publish_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS new_york FROM publication""")
def _(t):
    return t.publication.select(
        "publication_id", day(times.local_date("publish_at", "Asia/Tokyo")).alias("tokyo"),
        day(times.local_date("publish_at", "America/New_York")).alias("new_york"))


SLOT_INSTANT_SQL = """
WITH z AS (SELECT slot_id, DATE '2024-03-08' + CAST(slot_id % 5 AS INTEGER) AS d, split_part('01:30|02:30|12:00', '|', CAST(slot_id % 3 AS INTEGER) + 1) AS hm,
  split_part('America/New_York|Asia/Kathmandu|Africa/Accra', '|', CAST(slot_id // 15 % 3 AS INTEGER) + 1) AS tz FROM slot)
SELECT slot_id, CASE WHEN tz = 'America/New_York' AND d = DATE '2024-03-10' AND hm = '02:30' THEN NULL
  ELSE strftime((d + CAST(hm || ':00' AS TIME)) AT TIME ZONE tz AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS planned_at FROM z"""


@query("slot_instant", SLOT_INSTANT_SQL)
def _(t):
    z = t.slot.selectExpr(
        "slot_id", "date_add(DATE'2024-03-08', CAST(slot_id % 5 AS INT)) AS d",
        "split_part('01:30|02:30|12:00', '|', CAST(slot_id % 3 AS INTEGER) + 1) AS hm",
        "split_part('America/New_York|Asia/Kathmandu|Africa/Accra', '|', CAST(slot_id div 15 % 3 AS INTEGER) + 1) AS tz")
    return z.select("slot_id", stamp(times.slot_instant("d", F.col("hm"), F.col("tz"))).alias("planned_at"))


@query("sql_slot_instants", SLOT_INSTANT_SQL)
def _(t):
    table_functions.register(t.spark)
    return t.spark.sql("""
        SELECT slot_id, date_format(planned_at, 'yyyy-MM-dd HH:mm:ss') AS planned_at FROM slot_instants(TABLE(
          SELECT slot_id, date_add(DATE'2024-03-08', CAST(slot_id % 5 AS INT)) AS local_date,
            split_part('01:30|02:30|12:00', '|', CAST(slot_id % 3 AS INTEGER) + 1) AS local_time,
            split_part('America/New_York|Asia/Kathmandu|Africa/Accra', '|', CAST(slot_id div 15 % 3 AS INTEGER) + 1) AS zone
          FROM {slots}) PARTITION BY slot_id)""", slots=t.slot)


SETTINGS = {"similarity_threshold": 0.35, "max_source_per_day": 1, "cooldown_ms": 600000}


def slate_inputs(t):
    ready = cut_lineage(scored_pool(t).select(*sim.FIELDS, *p.ROLE_COLUMNS))  # texts are read and their tokens made once
    history = ready.filter("short_id div 20 % 5 = 0")
    pool = ready.filter("short_id div 20 % 5 <> 0")
    edge = history.groupBy("owner_id").agg(F.max("short_id").alias("hi"), F.min("short_id").alias("lo"))
    previous = history.join(edge.select(F.col("hi").alias("short_id")), "short_id", "left_semi")
    following = history.join(edge.select(F.col("lo").alias("short_id")), "short_id", "left_semi")
    return pool, history, previous, following


def _pair(a, b):
    """Side-by-side rule with either side possibly missing."""
    return f"({a}.short_id IS NULL OR {b}.short_id IS NULL OR (NOT {q.duplicate(a, b)} AND {q.score(a, b)} <= 0.35))"


def _ok(a, b):
    return f"(NOT {q.duplicate(a, b)} AND {q.score(a, b)} <= 0.35)"


def _clash(o, c):
    """Same id, duplicate, or (one item per source) the same source."""
    return f"({o}.short_id = {c}.short_id OR {q.duplicate(c, o)} OR {o}.source_hash = {c}.source_hash)"


def slate_day(k: str = "", whole: bool = False) -> str:
    """One day's choice from the tables hist, safe, prev and owners of that day, pl and nxt: the last table is fin. The pairs are of
    the best 100 items of each role, or (``whole``) of all."""
    listed, none = ("", 1 << 62) if whole else (" QUALIFY place <= 100", 101)
    return f"""
hero{k} AS MATERIALIZED (SELECT c.* FROM safe{k} c LEFT JOIN nxt n ON n.owner_id = c.owner_id WHERE {_pair('c', 'n')}
  QUALIFY row_number() OVER (PARTITION BY c.owner_id ORDER BY c.hero DESC, c.short_id) = 1),
dd{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY discovery DESC, short_id) AS place FROM safe{k}{listed}),
ee{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY engagement DESC, short_id) AS place FROM safe{k}{listed}),
used{k} AS (SELECT owner_id, source_hash, count(*) AS n FROM hist{k} GROUP BY ALL),
d1{k} AS MATERIALIZED (SELECT d.*, {_pair('d', 'h')} AS dh, {_pair('d', 'n')} AS dn, h.short_id IS NOT NULL AS has_hero FROM dd{k} d LEFT JOIN hero{k} h ON h.owner_id = d.owner_id
  LEFT JOIN prev{k} p ON p.owner_id = d.owner_id LEFT JOIN nxt n ON n.owner_id = d.owner_id
  WHERE (h.short_id IS NULL OR NOT {_clash('h', 'd')}) AND {_pair('p', 'd')}),
e1{k} AS MATERIALIZED (SELECT e.*, {_pair('e', 'h')} AS eh, {_pair('e', 'n')} AS en, {_pair('p', 'e')} AS pe, h.short_id IS NOT NULL AS has_hero FROM ee{k} e LEFT JOIN hero{k} h ON h.owner_id = e.owner_id
  LEFT JOIN prev{k} p ON p.owner_id = e.owner_id LEFT JOIN nxt n ON n.owner_id = e.owner_id
  WHERE h.short_id IS NULL OR NOT {_clash('h', 'e')}),
combos{k} AS (
  SELECT d.owner_id, d.short_id AS d_id, e.short_id AS e_id, d.place AS dp, e.place AS ep,
    2000 + d.discovery + e.engagement - 3 * (coalesce(ud.n, 0) + CASE WHEN d.source_hash = e.source_hash THEN 0 ELSE coalesce(ue.n, 0) END) AS score
  FROM d1{k} d JOIN e1{k} e ON e.owner_id = d.owner_id LEFT JOIN used{k} ud ON ud.owner_id = d.owner_id AND ud.source_hash = d.source_hash
    LEFT JOIN used{k} ue ON ue.owner_id = e.owner_id AND ue.source_hash = e.source_hash
  WHERE NOT {_clash('d', 'e')} AND {_ok('d', 'e')} AND CASE WHEN e.has_hero THEN eh ELSE en END
  UNION ALL
  SELECT d.owner_id, d.short_id, NULL, place, {none}, 1000 + discovery - 3 * coalesce(n, 0) FROM d1{k} d LEFT JOIN used{k} u ON u.owner_id = d.owner_id AND u.source_hash = d.source_hash
  WHERE CASE WHEN has_hero THEN dh ELSE dn END
  UNION ALL
  SELECT e.owner_id, NULL, e.short_id, {none}, place, 1000 + engagement - 3 * coalesce(n, 0) FROM e1{k} e LEFT JOIN used{k} u ON u.owner_id = e.owner_id AND u.source_hash = e.source_hash
  WHERE pe AND CASE WHEN has_hero THEN eh ELSE en END
  UNION ALL
  SELECT o.owner_id, NULL, NULL, {none}, {none}, 0 FROM owners{k} o LEFT JOIN hero{k} h ON h.owner_id = o.owner_id LEFT JOIN prev{k} p ON p.owner_id = o.owner_id LEFT JOIN nxt n ON n.owner_id = o.owner_id
  WHERE CASE WHEN h.short_id IS NOT NULL THEN {_pair('p', 'h')} ELSE {_pair('p', 'n')} END),
best{k} AS (SELECT * FROM combos{k} QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, dp, ep) = 1),
fin{k} AS (SELECT o.owner_id, CASE WHEN b.d_id IS NULL AND b.e_id IS NULL AND NOT {_pair('p', 'h')} THEN NULL ELSE h.short_id END AS hero_id, b.d_id AS discovery_id, b.e_id AS engagement_id, round(b.score, 6) AS score
  FROM owners{k} o LEFT JOIN hero{k} h ON h.owner_id = o.owner_id LEFT JOIN prev{k} p ON p.owner_id = o.owner_id LEFT JOIN best{k} b ON b.owner_id = o.owner_id)"""


SLATE_HEAD = f"""
WITH hist AS MATERIALIZED (SELECT * FROM role_sql WHERE short_id // 20 % 5 = 0),
pl AS MATERIALIZED (SELECT * FROM role_sql WHERE short_id // 20 % 5 <> 0),
safe AS MATERIALIZED (SELECT * FROM pl c WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.owner_id = c.owner_id AND {q.duplicate('c', 'h')})),
prev AS MATERIALIZED (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY short_id DESC) = 1),
nxt AS MATERIALIZED (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY short_id) = 1),
owners AS (SELECT DISTINCT owner_id FROM pl)"""
SLATE_SQL = f"{SLATE_HEAD},{slate_day()}\n"


@query("daily_slate", SLATE_SQL + "SELECT owner_id, hero_id, discovery_id, engagement_id, CAST(score AS DOUBLE) AS score FROM fin")
def _(t):
    return rounded(p.daily_slate(*slate_inputs(t), SETTINGS), "score")


@query("slate_rows", SLATE_SQL + """
SELECT r.owner_id, r.role, r.local_time, strftime(TIMESTAMP '2024-02-01' + to_minutes(mins), '%Y-%m-%d %H:%M:%S') AS planned_at, r.short_id,
  round(CASE r.role WHEN 'HERO' THEN hero WHEN 'DISCOVERY' THEN discovery ELSE engagement END, 6) AS score
FROM (SELECT owner_id, unnest(['DISCOVERY', 'ENGAGEMENT', 'HERO']) AS role, unnest(['12:00', '16:00', '20:00']) AS local_time, unnest([375, 615, 855]) AS mins,
    unnest([discovery_id, engagement_id, hero_id]) AS short_id FROM fin) r LEFT JOIN role_sql s ON s.short_id = r.short_id""")
def _(t):
    inputs = slate_inputs(t)
    rows = p.slate_rows(
        p.daily_slate(*inputs, SETTINGS), inputs[0], [("DISCOVERY", "12:00"), ("ENGAGEMENT", "16:00"), ("HERO", "20:00")],
        "2024-02-01", "Asia/Kathmandu")
    return rounded(rows.select("owner_id", "role", "local_time", stamp("planned_at").alias("planned_at"), "short_id", "score"), "score")


LAST = "coalesce(f.hero_id, f.engagement_id, f.discovery_id)"
DAYS_SQL = f"""{SLATE_HEAD},{slate_day(whole=True)},
picks AS MATERIALIZED (SELECT p.* FROM pl p JOIN fin f ON p.short_id IN (f.hero_id, f.discovery_id, f.engagement_id)),
hist2 AS MATERIALIZED (SELECT * FROM hist UNION ALL SELECT * FROM picks),
safe2 AS MATERIALIZED (SELECT * FROM pl c WHERE owner_id % 3 <> 0
  AND NOT EXISTS (SELECT 1 FROM hist2 h WHERE h.owner_id = c.owner_id AND (h.short_id = c.short_id OR {q.duplicate('c', 'h')}))),
prev2 AS MATERIALIZED (SELECT p.* FROM pl p JOIN fin f ON p.short_id = {LAST}
  UNION ALL SELECT * FROM prev p WHERE NOT EXISTS (SELECT 1 FROM fin f WHERE f.owner_id = p.owner_id AND {LAST} IS NOT NULL)),
owners2 AS (SELECT owner_id FROM owners WHERE owner_id % 3 <> 0),{slate_day('2', whole=True)}
"""


@query("plan_days", DAYS_SQL + """
SELECT owner_id, '2024-02-01' AS local_date, hero_id, discovery_id, engagement_id, CAST(score AS DOUBLE) AS score FROM fin
UNION ALL SELECT owner_id, '2024-02-02', hero_id, discovery_id, engagement_id, CAST(score AS DOUBLE) FROM fin2""")
def _(t):
    """Two days; a third of the owners have no open slot on the second."""
    pool, history, previous, following = slate_inputs(t)
    days = ["2024-02-01", "2024-02-02"]
    open_days = pool.select("owner_id").distinct().selectExpr("owner_id", "explode(array(DATE'2024-02-01', DATE'2024-02-02')) AS local_date").filter(
        "local_date = DATE'2024-02-01' or owner_id % 3 <> 0")
    out = p.plan_days(pool, history, days, previous, following, SETTINGS, open_days)
    return rounded(out.withColumn("local_date", day("local_date")), "score")


@query("evidence_objects", """
SELECT short_id, CASE WHEN short_id % 3 = 0 THEN NULL ELSE array_to_string([game, '7', title], ',') END AS objects FROM short""")
def _(t):
    body = F.when(F.col("short_id") % 3 == 0, F.lit('{"note": 1}')).otherwise(
        F.concat(F.lit('{"objects": ["'), "game", F.lit('", 7, "7", null, {"a": 1}, "'), "title", F.lit('"]}')))
    return t.short.select("short_id", F.array_join(p.evidence_objects(body), ",").alias("objects"))
