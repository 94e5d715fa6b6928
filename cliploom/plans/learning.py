"""Learning queries."""

from pyspark.sql import functions as F

from cliploom.functions import numeric as n
from cliploom.functions import text
from cliploom.operators import learning as l
from cliploom.plans.common import day, now, rounded
from cliploom.plans.registry import query
from cliploom.sources.tables import DUCK_VIEWS

CROPS = "split_part('CENTER_CROP|SMART_CROP|GAMEPLAY_PLUS_FACE_CAM|STACKED', '|', CAST(short_id % 4 AS INTEGER) + 1)"
HOOK = """CASE WHEN short_id % 10 = 0 THEN NULL WHEN short_id % 10 = 1 THEN title || ' why?' WHEN short_id % 10 = 2 THEN title || ' x2'
  WHEN short_id % 10 = 3 THEN title || ' 🔥' WHEN short_id % 10 = 4 THEN 'wait for the ' || title ELSE title END"""
HOOK_TYPE = """CASE WHEN short_id % 10 = 0 THEN 'ACTION_FIRST' WHEN short_id % 10 = 1 THEN 'QUESTION' WHEN short_id % 10 = 2 THEN 'NUMBER'
  WHEN short_id % 10 = 3 THEN 'REACTION' WHEN short_id % 10 = 4 THEN 'CURIOSITY' ELSE 'DIRECT' END"""
DUCK_VIEWS["feature_sql"] = f"""
  SELECT s.short_id, s.owner_id, publication_id, publish_at, game, event_type, duration_s, video_id,
    CASE WHEN duration_s < 14 THEN 'Under 14s' WHEN duration_s < 23 THEN '14–22s' WHEN duration_s < 40 THEN '23–39s' ELSE '40s+' END AS duration_bucket,
    strftime(publish_at, '%H:%M') AS posting_time, strftime(publish_at, '%A') AS day_of_week, {HOOK_TYPE.replace('short_id', 's.short_id')} AS hook_type,
    CASE WHEN s.short_id % 4 = 2 THEN 'FACECAM' ELSE 'ACTION' END AS opening_frame_style,
    CASE WHEN s.short_id % 6 = 0 THEN 'NONE' WHEN (s.short_id % 6) * 1.5 / greatest(1, duration_s) < 0.35 THEN 'SELECTIVE' ELSE 'CAPTION_HEAVY' END AS caption_style,
    CASE WHEN a / greatest(1, duration_s) * 10 < 1 THEN 'LOW' WHEN a / greatest(1, duration_s) * 10 < 2.5 THEN 'MEDIUM' ELSE 'HIGH' END AS edit_intensity,
    s.short_id % 4 = 2 AS facecam_presence, len(title) AS title_length, false AS emoji_usage,
    coalesce(editorial_role, 'UNASSIGNED') AS editorial_role, CAST((s.short_id * 7919) % 10001 AS DOUBLE) / 100 AS record_score
  FROM (SELECT *, short_id % 4 + short_id % 3 + (short_id % 2) * 2 + short_id % 5 + CASE WHEN short_id % 7 = 0 THEN 2 ELSE 0 END AS a FROM short) s
  JOIN publication p ON p.short_id = s.short_id"""


def items(t):
    """Items with their publication and a timeline document."""
    spread = lambda count, body: F.expr(f"transform(slice(sequence(0, 9), 1, CAST({count} AS INT)), i -> {body})")
    empty = "named_struct('start', CAST(i AS DOUBLE), 'end', i + 0.5D)"
    edl = F.struct(
        F.col("duration_s").alias("output_duration"), F.expr(CROPS).alias("crop_strategy"), F.expr(HOOK).alias("hook"),
        spread("short_id % 4 + 1", "named_struct('speed', 1.0D)").alias("cuts"), spread("short_id % 3", empty).alias("zooms"),
        spread("short_id % 2", empty).alias("freeze_frames"), spread("short_id % 5", empty).alias("overlays"),
        spread("CASE WHEN short_id % 7 = 0 THEN 1 ELSE 0 END", empty).alias("replays"),
        spread("short_id % 6", "named_struct('text', 'go', 'start', i * 2.0D, 'end', i * 2.0D + 1.5D)").alias("captions"),
    )
    pubs = t.publication.select("short_id", "publication_id", "publish_at", "video_id")
    tags = F.array(F.lit("#Gaming"), F.concat(F.lit("#"), F.regexp_replace("game", "#", "")), F.lit("#gaming"))
    return t.short.join(pubs, "short_id").withColumn("edl", edl).withColumn("hashtags", tags)


def records(t):
    score = (F.col("short_id") * 7919 % 10001).cast("double") / 100
    return l.extract_features(items(t)).withColumn("performance_score", score)


@query("extract_features", """
SELECT short_id, duration_bucket, posting_time, day_of_week, hook_type, opening_frame_style, caption_style, edit_intensity,
  facecam_presence, title_length, emoji_usage, editorial_role, '#' || lower(replace(game, '#', '')) || ',#gaming' AS hashtag_set FROM feature_sql""")
def _(t):
    return l.extract_features(items(t)).select(
        "short_id", "duration_bucket", "posting_time", "day_of_week", "hook_type", "opening_frame_style", "caption_style",
        "edit_intensity", "facecam_presence", F.col("title_length").cast("bigint").alias("title_length"), "emoji_usage",
        "editorial_role", F.array_join("hashtag_set", ",").alias("hashtag_set"))


@query("hook_type", f"SELECT short_id, {HOOK_TYPE} AS hook_type FROM short")
def _(t):
    return t.short.select("short_id", text.hook_type(F.expr(HOOK)).alias("hook_type"))


@query("title_features", """
SELECT short_id, CAST(len(title) AS BIGINT) AS title_length, regexp_matches(title, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}©®]') AS emoji FROM pool""")
def _(t):
    return t.pool.select(
        "short_id", F.char_length("title").cast("bigint").alias("title_length"), text.has_pictograph("title").alias("emoji"))


@query("hashtag_set", """
SELECT short_id, array_to_string(list_sort(list_distinct(['#' || lower(game), '#gaming', '#' || lower(event_type)])), ',') AS tags FROM short""")
def _(t):
    tags = F.array(F.concat(F.lit("#"), "game"), F.lit("#Gaming"), F.lit("#gaming"), F.concat(F.lit("#"), "event_type"))
    return t.short.select("short_id", F.array_join(text.hashtag_set(tags), ",").alias("tags"))


HORIZON_ROWS = "(VALUES ('1H', 1, true), ('6H', 6, true), ('24H', 24, false), ('72H', 72, false), ('7D', 168, false)) AS h(horizon, hours, exact)"
DUCK_VIEWS["outcome_sql"] = f"""
  WITH base AS MATERIALIZED (SELECT p.owner_id, p.video_id, short_id, publish_at, horizon, hours, exact,
      CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(publish_at)) / 3600000000) AS BIGINT) AS age
    FROM publication p CROSS JOIN {HORIZON_ROWS} WHERE video_id IS NOT NULL),
  act AS MATERIALIZED (SELECT b.short_id, b.horizon, count(*) AS n, max(report_date) AS report_through, sum(coalesce(views, 0)) AS views,
      sum(coalesce(engaged_views, 0)) AS engaged_views, sum(coalesce(shares, 0)) AS shares, sum(coalesce(subs_gained, 0)) AS subs_gained,
      sum(watch_minutes) AS watch_minutes,
      sum(coalesce(avg_pct, 0) * coalesce(engaged_views, views, 0)) FILTER (coalesce(engaged_views, views, 0) > 0)
        / sum(coalesce(engaged_views, views, 0)) FILTER (coalesce(engaged_views, views, 0) > 0) AS avg_pct
    FROM base b JOIN latest_obs o ON o.owner_id = b.owner_id AND o.video_id = b.video_id AND o.scope = 'VIDEO'
      AND report_date BETWEEN CAST(publish_at AS DATE) AND CAST(publish_at + to_hours(hours) AS DATE) GROUP BY ALL),
  rev AS MATERIALIZED (SELECT b.short_id, b.horizon, sum(coalesce(est_revenue, 0)) AS est_revenue
    FROM base b JOIN latest_rev o ON o.owner_id = b.owner_id AND o.video_id = b.video_id AND o.scope = 'VIDEO' AND currency = 'USD'
      AND report_date BETWEEN CAST(publish_at AS DATE) AND CAST(publish_at + to_hours(hours) AS DATE) GROUP BY ALL),
  j AS (SELECT b.*, coalesce(n, 0) AS n, report_through, views, engaged_views, shares, subs_gained, watch_minutes, avg_pct, est_revenue,
      age >= hours AND NOT exact AND coalesce(n, 0) > 0 AS available
    FROM base b LEFT JOIN act USING (short_id, horizon) LEFT JOIN rev USING (short_id, horizon))
  SELECT short_id, owner_id, horizon, hours, available, greatest(0, age) AS age_hours, strftime(report_through, '%Y-%m-%d') AS report_through,
    CASE WHEN exact THEN 'Exact intraday observations are unavailable from the provider daily-report source.'
      WHEN age < hours THEN 'Waiting until the Short is ' || hours || ' hours old.'
      WHEN n = 0 THEN 'No provider video-level observation is available through this horizon.' END AS reason,
    CASE WHEN available THEN CAST(views AS BIGINT) END AS views, CASE WHEN available THEN CAST(engaged_views AS BIGINT) END AS engaged_views,
    CASE WHEN available THEN round(watch_minutes, 6) END AS watch_minutes, CASE WHEN available THEN round(avg_pct, 6) END AS avg_pct,
    CASE WHEN available THEN round(coalesce(est_revenue, 0), 6) END AS est_revenue,
    CASE WHEN available THEN floor((0.3 * greatest(0, least(100, coalesce(avg_pct, 0)))
      + 0.25 * CASE WHEN views <> 0 THEN greatest(0, least(100, engaged_views / views * 125)) ELSE 0 END
      + 0.15 * CASE WHEN views <> 0 THEN greatest(0, least(100, shares / views * 10000)) ELSE 0 END
      + 0.15 * CASE WHEN views <> 0 THEN greatest(0, least(100, subs_gained / views * 20000)) ELSE 0 END
      + 0.15 * greatest(0, least(100, views / greatest(1, hours) * 2))) * 100 + 0.5) / 100 END AS performance_score
  FROM j"""
OUT_COLS = ["short_id", "horizon", "available", "reason", "age_hours", "report_through", "views", "engaged_views",
            "watch_minutes", "avg_pct", "est_revenue", "performance_score"]


def outcomes(t):
    return l.horizon_outcomes(t.publication, t.observation, t.revenue, now())


@query("horizon_outcomes", f"SELECT {', '.join(OUT_COLS)} FROM outcome_sql")
def _(t):
    out = outcomes(t).withColumn("report_through", day("report_through"))
    return rounded(out, "watch_minutes", "avg_pct", "est_revenue").select(*OUT_COLS)


@query("outcome_score", """
SELECT short_id, floor((0.3 * coalesce(CAST(c.quality AS DOUBLE), 0) + 0.25 * least(100, e / v * 125) + 0.15 * least(100, s / v * 10000) + 0.15 * least(100, g / v * 20000)
  + 0.15 * least(100, v / 24 * 2)) * 100 + 0.5) / 100 AS score
FROM (SELECT short_id, CASE WHEN short_id % 7 <> 0 THEN quality END AS quality, CAST(short_id % 900 + 100 AS DOUBLE) AS v, CAST(short_id % 90 AS DOUBLE) AS e, CAST(short_id % 5 AS DOUBLE) AS s,
  CAST(short_id % 3 AS DOUBLE) AS g FROM short) c""")
def _(t):
    rows = t.short.selectExpr(
        "short_id", "CASE WHEN short_id % 7 <> 0 THEN quality END AS quality", "CAST(short_id % 900 + 100 AS DOUBLE) AS v", "CAST(short_id % 90 AS DOUBLE) AS e",
        "CAST(short_id % 5 AS DOUBLE) AS s", "CAST(short_id % 3 AS DOUBLE) AS g")
    return rows.select("short_id", n.outcome_score(n.score_components("v", "e", "quality", "s", "g", F.lit(24))).alias("score"))


@query("outcome_availability_counts", "SELECT owner_id, horizon, available, count(*) AS outcomes FROM outcome_sql GROUP BY ALL")
def _(t):
    return outcomes(t).groupBy("owner_id", "horizon", "available").agg(F.count("*").alias("outcomes"))


@query("feature_outcome_join", """
SELECT f.short_id, game, hook_type, horizon, performance_score FROM feature_sql f JOIN (
  SELECT short_id, horizon, performance_score FROM outcome_sql WHERE available
  QUALIFY row_number() OVER (PARTITION BY short_id ORDER BY hours DESC) = 1) o ON o.short_id = f.short_id""")
def _(t):
    return l.feature_outcome_join(l.extract_features(items(t)), outcomes(t)).select(
        "short_id", "game", "hook_type", "horizon", "performance_score")


DUCK_VIEWS["record_win_sql"] = """
  SELECT f.*, w AS win FROM feature_sql f JOIN (VALUES ('7', 7), ('28', 28), ('90', 90), ('lifetime', 100000)) AS ws(w, days)
    ON publish_at >= TIMESTAMP '2024-01-31' - to_days(days)"""
DUCK_VIEWS["winsor_sql"] = """
  WITH o AS (SELECT *, row_number() OVER (PARTITION BY owner_id, win ORDER BY record_score, short_id) - 1 AS i,
      count(*) OVER (PARTITION BY owner_id, win) AS cnt FROM record_win_sql),
  b AS (SELECT owner_id, win, max(cnt) AS records, max(record_score) FILTER (i = floor((cnt - 1) * 0.05)) AS low,
      max(record_score) FILTER (i = ceil((cnt - 1) * 0.95)) AS high FROM o GROUP BY ALL)
  SELECT o.*, records, low, high, greatest(low, least(high, record_score)) AS clipped,
    pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(publish_at)) / 86400000000.0) / 28.0) AS wt
  FROM o JOIN b USING (owner_id, win)"""
_DIMS = ", ".join(f"'{d}'" for d in l.DIMENSIONS)
_VALS = ", ".join(f"CAST({d} AS VARCHAR)" for d in l.DIMENSIONS)
DUCK_VIEWS["lift_sql"] = f"""
  WITH base AS (SELECT owner_id, win, sum(clipped * wt) / sum(wt) AS base FROM winsor_sql WHERE records >= 5 GROUP BY ALL),
  l AS (SELECT owner_id, win, clipped, wt, unnest([{_DIMS}]) AS dimension, unnest([{_VALS}]) AS segment FROM winsor_sql WHERE records >= 5),
  g AS (SELECT owner_id, win, dimension, segment, count(*) AS sample_size, sum(clipped * wt) / sum(wt) AS score,
      count(*) OVER (PARTITION BY owner_id, win, dimension) AS segments FROM l GROUP BY owner_id, win, dimension, segment),
  x AS (SELECT g.*, base, (score - base) / base * 100 AS lift FROM g JOIN base USING (owner_id, win) WHERE sample_size >= 5 AND segments >= 2)
  SELECT owner_id, win, dimension, segment, sample_size, floor(score * 100 + 0.5) / 100 AS score, floor(base * 100 + 0.5) / 100 AS baseline,
    floor(lift * 10 + 0.5) / 10 AS lift_percent, CASE WHEN sample_size >= 20 AND abs(lift) >= 15 THEN 'HIGH'
      WHEN sample_size >= 10 AND abs(lift) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM x"""
DUCK_VIEWS["insight_sql"] = """
  SELECT *, CAST(row_number() OVER (PARTITION BY owner_id, win ORDER BY abs(lift_percent) DESC, sample_size DESC, dimension, segment) AS INTEGER) AS rank,
    floor(greatest(-0.15, least(0.15, lift_percent / 200)) * 1000 + 0.5) / 1000 AS delta,
    CASE WHEN lift_percent >= 0 THEN 'INCREASE' ELSE 'DECREASE' END AS direction,
    segment || ' is associated with ' || printf('%.1f', abs(lift_percent)) || '% ' || CASE WHEN lift_percent >= 0 THEN 'above' ELSE 'below' END
      || '-baseline performance in the ' || CASE WHEN win = 'lifetime' THEN 'captured lifetime' ELSE win || '-day' END || ' window.' AS finding
  FROM lift_sql WHERE abs(lift_percent) >= 8 QUALIFY rank <= 12"""


def windowed(t):
    return l.record_windows(records(t), now())


@query("winsorize", 'SELECT short_id, win AS "window", records, low, high, clipped FROM winsor_sql')
def _(t):
    return l.winsorize(windowed(t), ["owner_id", "window"]).select("short_id", "window", "records", "low", "high", "clipped")


@query("recency_weighted_avg", """
SELECT owner_id, round(sum(record_score * w) / sum(w), 6) AS score FROM (
  SELECT owner_id, record_score, pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(publish_at)) / 86400000000.0) / 28.0) AS w FROM feature_sql) GROUP BY 1""")
def _(t):
    w = l.recency(now())
    return records(t).groupBy("owner_id").agg(F.round(F.sum(F.col("performance_score") * w) / F.sum(w), 6).alias("score"))


@query("segment_lift", """
SELECT owner_id, dimension, segment, sample_size, score, baseline, lift_percent, confidence FROM lift_sql WHERE win = 'lifetime'""")
def _(t):
    return l.segment_lift(records(t), now(), ["owner_id"])


@query("lift_by_window", 'SELECT owner_id, win AS "window", rank, dimension, segment, lift_percent, confidence FROM insight_sql')
def _(t):
    return found(t).select("owner_id", "window", "rank", "dimension", "segment", "lift_percent", "confidence")


def found(t):
    return l.insights(l.segment_lift(windowed(t), now(), ["owner_id", "window"]), ["owner_id", "window"])


@query("finding_text", 'SELECT owner_id, win AS "window", rank, finding FROM insight_sql')
def _(t):
    return found(t).select("owner_id", "window", "rank", "finding")


@query("recommendation_delta", 'SELECT owner_id, win AS "window", rank, delta, direction FROM insight_sql')
def _(t):
    return found(t).select("owner_id", "window", "rank", "delta", "direction")


@query("strongest_insight", """
SELECT owner_id, win AS "window", dimension, segment, sample_size FROM insight_sql WHERE confidence = 'HIGH'
QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY sample_size DESC, win, rank) = 1""")
def _(t):
    return l.strongest_insight(found(t)).select("owner_id", "window", "dimension", "segment", "sample_size")


@query("confidence_level", """
SELECT short_id, CASE WHEN quality >= 20 AND abs(highlight - 50) >= 15 THEN 'HIGH' WHEN quality >= 10 AND abs(highlight - 50) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM short""")
def _(t):
    return t.short.select("short_id", n.confidence_level("quality", F.col("highlight") - 50).alias("level"))


ADJ = """SELECT owner_id, 'game' AS dimension, game AS segment, ((owner_id * 31 + CAST(replace(game, 'Brand#', '') AS BIGINT)) % 31 - 15) / 100.0 AS adjustment
  FROM (SELECT DISTINCT owner_id, game FROM short)"""
DUCK_VIEWS["adjustment_sql"] = ADJ.replace("/ 100.0", "/ CAST(100 AS DOUBLE)")


def adjustments(t):
    number = F.regexp_replace("game", "Brand#", "").cast("bigint")
    return t.short.select("owner_id", "game").distinct().select(
        "owner_id", F.lit("game").alias("dimension"), F.col("game").alias("segment"),
        (((F.col("owner_id") * 31 + number) % 31 - 15) / F.lit(100.0)).alias("adjustment"))


@query("apply_recommendation", """
WITH r AS (SELECT owner_id, dimension, segment, delta FROM insight_sql WHERE win = '28')
SELECT coalesce(a.owner_id, r.owner_id) AS owner_id, coalesce(a.dimension, r.dimension) AS dimension, coalesce(a.segment, r.segment) AS segment,
  CASE WHEN delta IS NULL THEN adjustment ELSE round(greatest(-0.15, least(0.15, coalesce(adjustment, 0) + delta)), 6) END AS adjustment
FROM adjustment_sql a FULL JOIN r ON r.owner_id = a.owner_id AND r.dimension = a.dimension AND r.segment = a.segment""")
def _(t):
    out = l.apply_recommendation(adjustments(t), found(t).filter("window = '28'"))
    return rounded(out, "adjustment")


@query("predict_performance", """
SELECT s.short_id, floor(greatest(0, least(100, highlight * (1 + coalesce(adjustment, 0)))) * 100 + 0.5) / 100 AS predicted_score,
  CASE WHEN adjustment IS NULL THEN 'LOW' ELSE 'MEDIUM' END AS prediction_confidence
FROM short s LEFT JOIN adjustment_sql a ON a.owner_id = s.owner_id AND a.segment = s.game""")
def _(t):
    return l.predict_performance(t.short, adjustments(t), "highlight", ["game", "event_type"]).select(
        "short_id", "predicted_score", "prediction_confidence")


@query("rank_predictions", """
SELECT s.short_id, floor(greatest(0, least(100, highlight * (1 + coalesce(adjustment, 0)))) * 100 + 0.5) / 100 AS predicted_score, v.version AS strategy_version
FROM short s LEFT JOIN adjustment_sql a ON a.owner_id = s.owner_id AND a.segment = s.game
LEFT JOIN (SELECT owner_id, max(short_id) AS version FROM short GROUP BY 1) v ON v.owner_id = s.owner_id""")
def _(t):
    active = t.short.groupBy("owner_id").agg(F.max("short_id").alias("strategy_version"))
    out = l.predict_performance(t.short, adjustments(t), "highlight", ["game", "event_type"])
    return out.join(active, "owner_id", "left").select("short_id", "predicted_score", "strategy_version")


@query("weights_valid", """
SELECT short_id, abs(a + b + c - 1) < 0.001 AND a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1 AS valid
FROM (SELECT short_id, CAST(quality AS DOUBLE) / 100 AS a, CAST(100 - quality AS DOUBLE) / 100 AS b, CAST(CASE WHEN short_id % 3 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS c FROM short)""")
def _(t):
    w = t.short.selectExpr(
        "short_id", "CAST(quality AS DOUBLE) / 100 AS a", "CAST(100 - quality AS DOUBLE) / 100 AS b",
        "CASE WHEN short_id % 3 = 0 THEN 0.5D ELSE 0D END AS c")
    return w.select("short_id", n.weights_valid(["a", "b", "c"]).alias("valid"))


FNV = """list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, len(seed) + 1), lambda i: CAST(unicode(substring(seed, i, 1)) AS BIGINT))),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295)"""


@query("deterministic_arm", f"""
SELECT short_id, CASE WHEN short_id % 13 <> 0 AND {FNV} / 4294967296.0 < 0.3 THEN 'VARIANT' ELSE 'CONTROL' END AS arm FROM (SELECT short_id, 'e1:s' || short_id AS seed FROM short)""")
def _(t):
    seed = F.concat(F.lit("e1:s"), F.col("short_id").cast("string"))
    return t.short.select("short_id", n.deterministic_arm(seed, F.when(F.col("short_id") % 13 != 0, 0.3)).alias("arm"))


def experiments(t):
    """One experiment per (owner, role, low or high status) combination found in the items."""
    status = F.expr("CASE WHEN owner_id % 3 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END")
    return t.short.select("owner_id").distinct().select(
        "owner_id", F.concat(F.lit("e"), F.col("owner_id").cast("string")).alias("experiment_id"), status.alias("status"),
        F.lit("hookType").alias("dimension"), (F.col("owner_id") / 10.0).alias("allocation_rate"), F.lit(5).alias("minimum_sample"))


DUCK_VIEWS["assignment_sql"] = f"""
  SELECT experiment_id, short_id, owner_id, CASE WHEN {FNV} / 4294967296.0 < least(0.5, owner_id / 10) THEN 'VARIANT' ELSE 'CONTROL' END AS arm
  FROM (SELECT short_id, owner_id, 'e' || owner_id AS experiment_id, 'e' || owner_id || ':' || short_id AS seed FROM short WHERE owner_id % 3 <> 0)"""


@query("experiment_assign", "SELECT experiment_id, short_id, arm FROM assignment_sql")
def _(t):
    return l.assign_experiments(t.short, experiments(t))


@query("experiment_results", """
WITH o AS (SELECT short_id, CAST((short_id * 7919) % 10001 AS DOUBLE) / 100 AS s FROM short),
g AS (SELECT experiment_id, count(*) FILTER (arm = 'CONTROL') AS control_sample, avg(s) FILTER (arm = 'CONTROL') AS c,
    count(*) FILTER (arm = 'VARIANT') AS variant_sample, avg(s) FILTER (arm = 'VARIANT') AS v FROM assignment_sql JOIN o USING (short_id) GROUP BY 1)
SELECT 'e' || k.owner_id AS experiment_id, coalesce(control_sample, 0) AS control_sample, coalesce(variant_sample, 0) AS variant_sample,
  round(c, 6) AS control_score, round(v, 6) AS variant_score, round((v - c) / c * 100, 6) AS lift_percent,
  CASE WHEN coalesce(least(control_sample, variant_sample), 0) >= 5 THEN CASE WHEN abs((v - c) / c * 100) >= 15 THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'LOW' END AS confidence
FROM (SELECT DISTINCT owner_id FROM short) k LEFT JOIN g ON g.experiment_id = 'e' || k.owner_id""")
def _(t):
    scores = t.short.select("short_id", ((F.col("short_id") * 7919 % 10001).cast("double") / 100).alias("performance_score"))
    out = l.experiment_results(l.assign_experiments(t.short, experiments(t)), scores, experiments(t))
    return rounded(out, "control_score", "variant_score", "lift_percent").select(
        "experiment_id", "control_sample", "variant_sample", "control_score", "variant_score", "lift_percent", "confidence")


@query("experiment_transition", """
WITH e AS (SELECT o_orderkey AS experiment_id, o_custkey AS owner_id, o_orderpriority AS dimension,
    CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'PAUSED' ELSE 'DRAFT' END AS status,
    split_part('ACTIVATE|PAUSE|COMPLETE|CANCEL', '|', CAST(o_orderkey % 4 AS INTEGER) + 1) AS action FROM orders)
SELECT experiment_id, action, conflict, CASE WHEN conflict THEN status WHEN action = 'ACTIVATE' THEN 'ACTIVE' WHEN action = 'PAUSE' THEN 'PAUSED'
  WHEN action = 'COMPLETE' THEN 'COMPLETED' ELSE 'CANCELLED' END AS new_status
FROM (SELECT e.*, action = 'ACTIVATE' AND EXISTS (SELECT 1 FROM e x WHERE x.owner_id = e.owner_id AND x.dimension = e.dimension
  AND x.status = 'ACTIVE' AND x.experiment_id <> e.experiment_id) AS conflict FROM e)""")
def _(t):
    rows = t.base("orders").selectExpr(
        "o_orderkey AS experiment_id", "o_custkey AS owner_id", "o_orderpriority AS dimension",
        "CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'PAUSED' ELSE 'DRAFT' END AS status",
        "split_part('ACTIVATE|PAUSE|COMPLETE|CANCEL', '|', CAST(o_orderkey % 4 AS INTEGER) + 1) AS action")
    return l.experiment_transition(rows.drop("action"), rows.select("experiment_id", "action"))


@query("retry_backoff", """
SELECT job_id, CASE WHEN attempt >= 3 THEN 'FAILED' ELSE 'RETRYING' END AS next_state,
  CASE WHEN attempt < 3 THEN CAST(pow(2, attempt) * 5000 AS BIGINT) END AS delay_ms FROM job""")
def _(t):
    return l.retry_backoff(t.job).select("job_id", "next_state", "delay_ms")


@query("readiness", """
SELECT source_id AS owner_id, count(*) AS features, greatest(0, 5 - count(*)) AS needed, count(*) >= 5 AS ready FROM short GROUP BY 1""")
def _(t):
    return l.readiness(t.short.select(F.col("source_id").alias("owner_id")))


@query("insight_apply", """
WITH c AS (SELECT owner_id, dimension, segment, delta FROM insight_sql WHERE confidence <> 'LOW'
  QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY abs(lift_percent) DESC, rank, win) = 1)
SELECT 'ADJUSTED' AS outcome, coalesce(a.owner_id, c.owner_id) AS owner_id, coalesce(a.dimension, c.dimension) AS dimension, coalesce(a.segment, c.segment) AS segment,
  CASE WHEN delta IS NULL THEN adjustment ELSE round(greatest(-0.15, least(0.15, coalesce(adjustment, 0) + delta)), 6) END AS adjustment
FROM adjustment_sql a FULL JOIN c ON c.owner_id = a.owner_id AND c.dimension = a.dimension AND c.segment = a.segment
UNION ALL SELECT 'REFUSED', owner_id, dimension, segment, NULL FROM insight_sql WHERE confidence = 'LOW'""")
def _(t):
    adjusted, refused = l.insight_apply(found(t), adjustments(t))
    keys = ["owner_id", "dimension", "segment"]
    return rounded(adjusted, "adjustment").select(F.lit("ADJUSTED").alias("outcome"), *keys, "adjustment").unionByName(
        refused.select(F.lit("REFUSED").alias("outcome"), *keys, F.lit(None).cast("double").alias("adjustment")))


_REC = "SELECT f.*, performance_score FROM feature_sql f JOIN (SELECT short_id, performance_score FROM outcome_sql WHERE available QUALIFY row_number() OVER (PARTITION BY short_id ORDER BY hours DESC) = 1) o ON o.short_id = f.short_id"


@query("learning_run", f"""
WITH rec AS ({_REC}),
rw AS (SELECT rec.*, w AS win FROM rec JOIN (VALUES ('7', 7), ('28', 28), ('90', 90), ('lifetime', 100000)) AS ws(w, days) ON publish_at >= TIMESTAMP '2024-01-31' - to_days(days)),
o AS (SELECT *, row_number() OVER (PARTITION BY owner_id, win ORDER BY performance_score, short_id) - 1 AS i, count(*) OVER (PARTITION BY owner_id, win) AS cnt FROM rw),
b AS (SELECT owner_id, win, max(cnt) AS records, max(performance_score) FILTER (i = floor((cnt - 1) * 0.05)) AS low, max(performance_score) FILTER (i = ceil((cnt - 1) * 0.95)) AS high FROM o GROUP BY ALL),
c AS (SELECT o.*, greatest(low, least(high, performance_score)) AS clipped, pow(0.5, greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(publish_at)) / 86400000000.0) / 28.0) AS wt FROM o JOIN b USING (owner_id, win) WHERE records >= 5),
l AS (SELECT owner_id, win, clipped, wt, unnest([{_DIMS}]) AS dimension, unnest([{_VALS}]) AS segment FROM c),
g AS (SELECT owner_id, win, dimension, segment, count(*) AS sample_size, sum(clipped * wt) / sum(wt) AS score, count(*) OVER (PARTITION BY owner_id, win, dimension) AS segments FROM l GROUP BY owner_id, win, dimension, segment),
base AS (SELECT owner_id, win, sum(clipped * wt) / sum(wt) AS base FROM c GROUP BY ALL),
x AS (SELECT g.*, (score - base) / base * 100 AS lift FROM g JOIN base USING (owner_id, win) WHERE sample_size >= 5 AND segments >= 2),
y AS (SELECT owner_id, win, dimension, segment, sample_size, lift, floor(lift * 10 + 0.5) / 10 AS lift_percent FROM x),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner_id, win ORDER BY abs(lift_percent) DESC, sample_size DESC, dimension, segment) AS INTEGER) AS rank
  FROM y WHERE abs(lift_percent) >= 8 QUALIFY rank <= 12),
best AS (SELECT owner_id, dimension, segment, floor(greatest(-0.15, least(0.15, lift_percent / 200)) * 1000 + 0.5) / 1000 AS delta
  FROM z WHERE sample_size >= 20 AND abs(lift) >= 15 QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY sample_size DESC, win, rank) = 1)
SELECT 'INSIGHT' AS part, owner_id, win AS "window", dimension, segment, sample_size, lift_percent, rank, NULL::DOUBLE AS adjustment FROM z
UNION ALL SELECT 'STRATEGY', coalesce(a.owner_id, b.owner_id), NULL, coalesce(a.dimension, b.dimension), coalesce(a.segment, b.segment), NULL, NULL, NULL,
  CASE WHEN delta IS NULL THEN round(adjustment, 6) ELSE round(greatest(-0.15, least(0.15, coalesce(adjustment, 0) + delta)), 6) END
FROM adjustment_sql a FULL JOIN best b ON b.owner_id = a.owner_id AND b.dimension = a.dimension AND b.segment = a.segment
UNION ALL SELECT 'FEATURES', owner_id, NULL, NULL, NULL, count(*), NULL, NULL, NULL FROM feature_sql GROUP BY owner_id
UNION ALL SELECT 'OUTCOMES', owner_id, horizon, NULL, NULL, count(*), round(sum(performance_score), 4), NULL, NULL FROM outcome_sql GROUP BY owner_id, horizon""")
def _(t):
    run = l.learning_run(items(t), t.publication, t.observation, t.revenue, adjustments(t), now())
    columns = {"part": "string", "owner_id": "bigint", "window": "string", "dimension": "string", "segment": "string",
               "sample_size": "bigint", "lift_percent": "double", "rank": "int", "adjustment": "double"}

    def part(name, df):
        df = df.withColumn("part", F.lit(name))
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in columns.items()])

    counted = run["features"].groupBy("owner_id").agg(F.count("*").alias("sample_size"))
    outcomes = run["outcomes"].groupBy("owner_id", F.col("horizon").alias("window")).agg(
        F.count("*").alias("sample_size"), F.round(F.sum("performance_score"), 4).alias("lift_percent"))
    return part("INSIGHT", run["insights"]).unionByName(part("STRATEGY", rounded(run["strategy"], "adjustment"))).unionByName(
        part("FEATURES", counted)).unionByName(part("OUTCOMES", outcomes))
