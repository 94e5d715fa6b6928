"""Signal series and event queries."""

from pyspark.sql import functions as F

from cliploom import config
from cliploom.functions import evidence as ev
from cliploom.functions import rules, table_functions
from cliploom.functions.text import content_type, identify_game
from cliploom.operators import events as e
from cliploom.operators import series as s
from cliploom.operators.intervals import point_join
from cliploom.operators.reporting import top_n
from cliploom.plans.common import rounded
from cliploom.plans.registry import query
from cliploom.sources.tables import DUCK_VIEWS

PROFILE_ROWS = ", ".join(
    f"({n}, '{name}', '{game}', '{event}', {gap}, {low})"
    for n, (name, game, event, gap, low) in enumerate(config.CLUSTERING_PROFILES)
)
DUCK_VIEWS["evidence_sql"] = f"""
  WITH prof AS (SELECT * FROM (VALUES {PROFILE_ROWS}) AS p(ord, policy_id, game_re, event_re, gap_ms, low)),
  ev AS (SELECT s.source_id, signal_id, t_ms, kind, value,
      CASE kind WHEN 'SCENE_CHANGE' THEN 'SCENE_TRANSITION' WHEN 'AUDIO_PEAK' THEN 'AUDIO_REACTION' ELSE 'ACTIVITY_BURST' END AS event_type,
      greatest(0.2, least(1.0, abs(value) / 100)) AS confidence, game, game_confidence
    FROM signal s JOIN media_source m ON m.source_id = s.source_id WHERE kind <> 'SILENCE')
  SELECT ev.*, prof.policy_id, prof.gap_ms, row_number() OVER (PARTITION BY source_id ORDER BY t_ms, signal_id) AS rn,
    CASE kind WHEN 'SCENE_CHANGE' THEN 0.75 WHEN 'MOTION_PEAK' THEN 0.8 ELSE 0.9 END * greatest(1.0, abs(value)) AS strength,
    CASE kind WHEN 'SCENE_CHANGE' THEN 36 WHEN 'MOTION_PEAK' THEN 32 ELSE 30 END AS weight
  FROM ev JOIN prof ON least(game_confidence, confidence) >= low AND regexp_matches(lower(game), game_re)
    AND regexp_matches(lower(event_type), event_re)
  QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY ord) = 1"""
DUCK_VIEWS["cluster_sql"] = """
  WITH RECURSIVE r AS (
    SELECT source_id, rn, t_ms, event_type AS ctype, gap_ms AS cgap, 1 AS cluster_no FROM evidence_sql WHERE rn = 1
    UNION ALL
    SELECT e.source_id, e.rn, e.t_ms, CASE WHEN ok THEN ctype ELSE e.event_type END,
      CASE WHEN ok THEN greatest(cgap, e.gap_ms) ELSE e.gap_ms END, cluster_no + CASE WHEN ok THEN 0 ELSE 1 END
    FROM (SELECT r.*, e2.rn AS next_rn, (ctype = e2.event_type OR contains(ctype, 'ACTIVITY') OR contains(e2.event_type, 'ACTIVITY'))
        AND e2.t_ms - r.t_ms <= greatest(cgap, e2.gap_ms) AS ok
      FROM r JOIN evidence_sql e2 ON e2.source_id = r.source_id AND e2.rn = r.rn + 1) x
    JOIN evidence_sql e ON e.source_id = x.source_id AND e.rn = x.next_rn)
  SELECT r.source_id, CAST(cluster_no AS BIGINT) AS cluster_no, arg_min(event_type, e.rn) AS event_type,
    CAST(min(e.t_ms) AS DOUBLE) AS start_ms, CAST(arg_max(e.t_ms, (strength, -e.rn)) AS DOUBLE) AS key_ms,
    CAST(max(e.t_ms) AS DOUBLE) AS end_ms, max(confidence) AS confidence, arg_max(policy_id, (gap_ms, -e.rn)) AS policy_id,
    list_sort(list(DISTINCT kind)) AS kinds, count(*) AS signal_count, CAST(sum(weight) AS BIGINT) AS weight_sum
  FROM r JOIN evidence_sql e ON e.source_id = r.source_id AND e.rn = r.rn GROUP BY r.source_id, cluster_no"""
DUCK_VIEWS["event_sql"] = """
  SELECT * FROM cluster_sql UNION ALL
  SELECT source_id, 1, 'ACTIVITY_BURST', greatest(0.0, duration_ms / 2 - 1000), duration_ms / 2, least(duration_ms, duration_ms / 2 + 1000),
    0.15, 'generic-v1', CAST([] AS VARCHAR[]), 0, 0 FROM media_source WHERE source_id NOT IN (SELECT source_id FROM evidence_sql)"""
_ALL = lambda names: " AND ".join(f"list_contains(kinds, '{n}')" for n in names)
TYPE_SQL = "CASE " + " ".join(
    f"WHEN profile = '{name}' THEN CASE "
    + " ".join(f"WHEN {_ALL(kinds)} THEN '{label}'" for kinds, label in rules)
    + f" ELSE '{fallback}' END"
    for name, _, rules, fallback, *_ in config.DETECTOR_PROFILES
) + " ELSE event_type END"
BOOST_SQL = "CASE " + " ".join(
    f"WHEN profile = '{p[0]}' THEN CASE WHEN {_ALL(p[4])} THEN {p[5]} ELSE {p[6]} END" for p in config.DETECTOR_PROFILES
) + " ELSE 0 END"
PROFILE_SQL = "CASE WHEN game_confidence < 0.55 THEN 'generic-gameplay-v1' " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(game), '{w}')" for w in words) + f" THEN '{name}'"
    for name, words, *_ in config.DETECTOR_PROFILES
) + " ELSE 'generic-gameplay-v1' END"
DUCK_VIEWS["scored_sql"] = f"""
  WITH p AS (SELECT e.*, {PROFILE_SQL} AS profile, duration_ms FROM event_sql e JOIN media_source m ON m.source_id = e.source_id)
  SELECT source_id, cluster_no, {TYPE_SQL} AS event_type, start_ms, key_ms, end_ms, kinds, profile, duration_ms,
    CAST(least(100, greatest(0, least(100, CASE WHEN signal_count > 0 THEN weight_sum + least(15, signal_count * 2) ELSE 10 END)) + {BOOST_SQL}) AS INTEGER) AS signal_score
  FROM p"""
DUCK_VIEWS["bounds_sql"] = """
  WITH a AS (SELECT *, greatest(0.0, start_ms - CASE WHEN list_contains(kinds, 'SCENE_CHANGE') THEN 1000 ELSE 2000 END) AS s0,
      least(duration_ms, end_ms + CASE WHEN list_contains(kinds, 'AUDIO_PEAK') THEN 2500 ELSE 1500 END) AS e0 FROM scored_sql),
  b AS (SELECT *, greatest(0.0, 6000 - (e0 - s0)) AS m, greatest(0.0, s0 - greatest(0.0, 6000 - (e0 - s0)) / 2) AS s1 FROM a),
  c AS (SELECT *, CASE WHEN m > 0 THEN least(duration_ms, e0 + m - CASE WHEN s1 = 0 THEN m / 2 ELSE 0 END) ELSE e0 END AS e1 FROM b),
  d AS (SELECT *, CASE WHEN e1 - s1 > 60000 THEN least(duration_ms, greatest(0.0, key_ms - 36000) + 60000) ELSE e1 END AS e2 FROM c)
  SELECT *, CAST(e2 AS DOUBLE) AS clip_end_ms, CAST(CASE WHEN e1 - s1 > 60000 THEN greatest(0.0, e2 - 60000) ELSE s1 END AS DOUBLE) AS clip_start_ms FROM d"""


@query("signal_kind_filter", "SELECT signal_id, source_id, kind FROM signal WHERE kind <> 'SILENCE'")
def _(t):
    return t.signal.filter("kind <> 'SILENCE'").select("signal_id", "source_id", "kind")


@query("signal_cap", """
SELECT source_id, signal_id FROM signal QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY t_ms, signal_id) <= 40""")
def _(t):
    return s.signal_cap(t.signal, limit=40).select("source_id", "signal_id")


@query("motion_peaks", """
WITH x AS (SELECT source_id, t_ms, luma, coalesce(lag(luma) OVER w, -1) AS p, coalesce(lead(luma) OVER w, -1) AS n,
    avg(luma) OVER (PARTITION BY source_id) AS m, stddev_pop(luma) OVER (PARTITION BY source_id) AS sd
  FROM frame_metric WINDOW w AS (PARTITION BY source_id ORDER BY t_ms))
SELECT source_id, t_ms, CASE WHEN luma >= greatest(0.18, m + 3 * sd) THEN 'SCENE_CHANGE' ELSE 'MOTION_PEAK' END AS kind, luma AS value
FROM x WHERE luma >= p AND luma >= n AND luma >= least(greatest(0.18, m + 3 * sd), greatest(0.04, m + 1.25 * sd))""")
def _(t):
    return s.motion_peaks(t.frame_metric)


@query("audio_peaks", """
WITH x AS (SELECT source_id, t_ms, db, lag(db) OVER w AS p, lead(db) OVER w AS n,
    avg(db) OVER (PARTITION BY source_id) AS m, stddev_pop(db) OVER (PARTITION BY source_id) AS sd
  FROM loudness WINDOW w AS (PARTITION BY source_id ORDER BY t_ms))
SELECT source_id, t_ms, 'AUDIO_PEAK' AS kind, db AS value FROM x
WHERE (p IS NULL OR db >= p) AND (n IS NULL OR db >= n) AND db >= least(-8, m + greatest(3, 1.5 * sd))""")
def _(t):
    return s.audio_peaks(t.loudness)


@query("silence_runs", """
WITH x AS (SELECT source_id, t_ms, db, coalesce(lead(t_ms) OVER w, t_ms + 500) AS nxt,
    count(*) FILTER (db > -45) OVER (PARTITION BY source_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS run
  FROM loudness WINDOW w AS (PARTITION BY source_id ORDER BY t_ms))
SELECT source_id, min(t_ms) AS t_ms, max(nxt) - min(t_ms) AS dur_ms, min(db) AS value FROM x WHERE db <= -45
GROUP BY source_id, run HAVING max(nxt) - min(t_ms) >= 1500""")
def _(t):
    return s.silence_runs(t.loudness)


@query("signal_summary", """
WITH l AS (SELECT source_id, db, row_number() OVER (PARTITION BY source_id ORDER BY t_ms) - 1 AS n, count(*) OVER (PARTITION BY source_id) AS samples FROM loudness),
w AS (SELECT source_id, count(*) AS points, round(sum(db), 6) AS wave_sum FROM l WHERE n % greatest(1, CAST(ceil(samples / 40.0) AS BIGINT)) = 0 GROUP BY 1)
SELECT f.source_id, round(f.mm, 8) AS mean_motion, mx AS max_motion, round(d.md, 6) AS mean_db, xd AS max_db, points, wave_sum
FROM (SELECT source_id, avg(luma) AS mm, max(luma) AS mx FROM frame_metric GROUP BY 1) f
JOIN (SELECT source_id, avg(db) AS md, max(db) AS xd FROM loudness GROUP BY 1) d USING (source_id) JOIN w USING (source_id)""")
def _(t):
    out = s.signal_summary(t.frame_metric, t.loudness, points=40)
    total = F.aggregate("waveform", F.lit(0.0), lambda a, v: a + v)
    return out.select(
        "source_id", F.round("mean_motion", 8).alias("mean_motion"), "max_motion", F.round("mean_db", 6).alias("mean_db"),
        "max_db", F.size("waveform").cast("bigint").alias("points"), F.round(total, 6).alias("wave_sum"),
    )


@query("signal_counts", """
SELECT source_id, count(*) FILTER (kind = 'SCENE_CHANGE') AS scene_count, count(*) FILTER (kind = 'MOTION_PEAK') AS motion_peak_count,
  count(*) FILTER (kind = 'AUDIO_PEAK') AS audio_peak_count, count(*) FILTER (kind = 'SILENCE') AS silence_count FROM signal GROUP BY 1""")
def _(t):
    return s.signal_counts(t.signal)


@query("rms_loudness", """
SELECT source_id, t_ms // 500 AS window_no, round(20 * log10(greatest(sqrt(avg((value / 500) * (value / 500))), 1e-6)), 6) AS db FROM signal GROUP BY ALL""")
def _(t):
    samples = t.signal.select("source_id", "t_ms", (F.col("value") / 500).alias("sample"))
    return rounded(s.rms_loudness(samples), "db")


@query("track_jitter", """
WITH p AS (SELECT source_id, signal_id * 500 AS t_ms, kind = 'SILENCE' AS missing, (signal_id * 37 % 1000) / 1000.0 AS x,
    (signal_id * 61 % 1000) / 1000.0 AS y, least(1.0, value / 100) AS confidence FROM signal),
d AS (SELECT source_id, confidence, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM p WHERE NOT missing
  WINDOW w AS (PARTITION BY source_id ORDER BY t_ms)),
g AS (SELECT source_id, coalesce(avg(step), 1.0) AS jitter, avg(confidence) AS c FROM d GROUP BY 1),
f AS (SELECT source_id, count(*) FILTER (missing) / count(*) AS missing_ratio FROM p GROUP BY 1)
SELECT f.source_id, round(coalesce(jitter, 1.0), 6) AS jitter, round(missing_ratio, 6) AS missing_ratio,
  round(greatest(0, least(1, coalesce(c, 0) * 0.65 + (1 - missing_ratio) * 0.25 + (1 - least(1, coalesce(jitter, 1.0) * 4)) * 0.1)), 6) AS confidence
FROM f LEFT JOIN g USING (source_id)""")
def _(t):
    points = t.signal.select(
        "source_id", (F.col("signal_id") * 500).alias("t_ms"), (F.col("kind") == "SILENCE").alias("missing"),
        (F.col("signal_id") * 37 % 1000 / 1000.0).alias("x"), (F.col("signal_id") * 61 % 1000 / 1000.0).alias("y"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
    )
    return rounded(s.track_jitter(points), "jitter", "missing_ratio", "confidence")


def pixel_frames(t):
    """Grey 9x8 frames made of the 64 vector components and the first 8 again."""
    grey = F.transform(F.concat("v", F.slice("v", 1, 8)), lambda x: F.floor(F.abs(x) * 1000).cast("int") % 256)
    return t.vector.select(
        F.floor(F.col("vec_id") / 50).alias("source_id"), (F.col("vec_id") * 500).alias("t_ms"), "vec_id", grey.alias("pixels")
    )


PIXELS = """(SELECT vec_id // 50 AS source_id, vec_id * 500 AS t_ms, vec_id,
  list_transform(list_concat(v, v[1:8]), lambda x: CAST(floor(abs(x) * 1000) AS INTEGER) % 256) AS pixels FROM vector)"""


@query("dhash_bits", f"""
WITH b AS (SELECT vec_id, i, pixels[i // 8 * 9 + i % 8 + 1] > pixels[i // 8 * 9 + i % 8 + 2] AS bit
  FROM {PIXELS} CROSS JOIN (SELECT unnest(range(64)) AS i)),
n AS (SELECT vec_id, i // 4 AS k, sum(CASE WHEN bit THEN 1 << CAST(3 - i % 4 AS INTEGER) ELSE 0 END) AS nib FROM b GROUP BY ALL)
SELECT vec_id, string_agg(substr('0123456789abcdef', CAST(nib AS INTEGER) + 1, 1), '' ORDER BY k) AS hash FROM n GROUP BY vec_id""")
def _(t):
    return pixel_frames(t).select("vec_id", ev.dhash_hex("pixels").alias("hash"))


@query("frame_difference", f"""
WITH p AS (SELECT source_id, t_ms, pixels, lag(pixels) OVER (PARTITION BY source_id ORDER BY t_ms) AS prev FROM {PIXELS})
SELECT source_id, t_ms, round(list_sum(list_transform(range(0, 72, 4), lambda i: abs(pixels[i + 1] - prev[i + 1]))) / 18.0 / 255, 9) AS value
FROM p WHERE prev IS NOT NULL""")
def _(t):
    return rounded(s.frame_differences(pixel_frames(t)), "value", digits=9)


@query("motion_centroid", f"""
WITH p AS (SELECT source_id, t_ms, pixels, lag(pixels) OVER (PARTITION BY source_id ORDER BY t_ms) AS prev FROM {PIXELS}),
w AS (SELECT source_id, t_ms, i, greatest(0, abs(pixels[i + 1] - prev[i + 1]) - 23) AS wt FROM p CROSS JOIN (SELECT unnest(range(72)) AS i) WHERE prev IS NOT NULL),
g AS (SELECT source_id, t_ms, sum(wt) AS mass, count(*) FILTER (wt > 0) AS active, sum(wt * (i % 9)) AS wx, sum(wt * (i // 9)) AS wy FROM w GROUP BY ALL)
SELECT source_id, t_ms, NOT (mass > 0 AND active >= 72 * 0.002) AS missing, CASE WHEN mass > 0 THEN round(wx / mass / 8, 9) END AS x,
  CASE WHEN mass > 0 THEN round(wy / mass / 7, 9) END AS y, CASE WHEN mass > 0 THEN round(least(1.0, active / 72 / 0.12), 9) END AS confidence FROM g""")
def _(t):
    return rounded(s.motion_centroid(pixel_frames(t), 9, 8), "x", "y", "confidence", digits=9)


@query("frame_diversity", """
SELECT source_hash, count(*) AS sampled_frames, count(DISTINCT h0) AS unique_frames FROM pool GROUP BY 1""")
def _(t):
    return s.frame_diversity(t.pool, "source_hash", "h0")


@query("policy_regex_join", "SELECT signal_id, policy_id, gap_ms FROM evidence_sql")
def _(t):
    rows = e.event_evidence(t.signal).join(t.media_source, "source_id")
    return rows.select(
        "signal_id", e.clustering_profile("game", "event_type", F.least("game_confidence", "confidence")).alias("p")
    ).select("signal_id", "p.*")


@query("event_evidence", """
SELECT source_id, signal_id, event_type, round(confidence, 9) AS confidence FROM evidence_sql""")
def _(t):
    return e.event_evidence(t.signal).select(
        "source_id", "signal_id", "event_type", F.round("confidence", 9).alias("confidence"))


CLUSTER_COLUMNS = ["source_id", "cluster_no", "event_type", "start_ms", "key_ms", "end_ms", "policy_id", "signal_count", "weight_sum"]


@query("event_clusters", f"SELECT {', '.join(CLUSTER_COLUMNS)}, round(confidence, 9) AS confidence, array_to_string(kinds, ',') AS kinds FROM cluster_sql")
def _(t):
    out = e.event_clusters(e.event_evidence(t.signal), t.media_source, e.EVENT_TYPES)
    return out.select(*CLUSTER_COLUMNS, F.round("confidence", 9).alias("confidence"), F.array_join("kinds", ",").alias("kinds"))


def scored(t):
    sources = t.media_source
    events = e.detected_events(t.signal, sources).join(
        sources.withColumn("profile", e.detector_profile("game", "game_confidence")).select("source_id", "profile", "duration_ms"), "source_id")
    return events


@query("event_score", """
SELECT source_id, cluster_no, CAST(greatest(0, least(100, CASE WHEN signal_count > 0 THEN weight_sum + least(15, signal_count * 2) ELSE 10 END)) AS INTEGER) AS score
FROM event_sql""")
def _(t):
    return scored(t).select("source_id", "cluster_no", e.event_score().cast("int").alias("score"))


@query("profile_classify", "SELECT source_id, cluster_no, profile, event_type, signal_score FROM scored_sql")
def _(t):
    return e.profile_classify(scored(t)).select("source_id", "cluster_no", "profile", "event_type", "signal_score")


BAND = """CASE WHEN clip_end_ms - clip_start_ms <= 12000 THEN 'MICRO' WHEN clip_end_ms - clip_start_ms <= 20000 THEN 'QUICK'
  WHEN clip_end_ms - clip_start_ms <= 35000 THEN 'STANDARD' WHEN clip_end_ms - clip_start_ms <= 50000 THEN 'STORY' ELSE 'EXTENDED' END"""


@query("content_bounds", f"SELECT source_id, cluster_no, clip_start_ms, clip_end_ms, {BAND} AS duration_class FROM bounds_sql")
def _(t):
    return e.content_bounds(scored(t)).select("source_id", "cluster_no", "clip_start_ms", "clip_end_ms", "duration_class")


@query("topk_candidates", """
SELECT source_id, cluster_no, CAST(row_number() OVER (PARTITION BY source_id ORDER BY signal_score DESC, key_ms, cluster_no) AS INTEGER) AS rank
FROM scored_sql QUALIFY rank <= 5""")
def _(t):
    order = [F.col("signal_score").desc(), F.col("key_ms"), F.col("cluster_no")]
    return top_n(e.profile_classify(scored(t)), ["source_id"], order, 5).select("source_id", "cluster_no", "rank")


@query("candidates_end_to_end", f"""
SELECT source_id, cluster_no, event_type, signal_score, clip_start_ms, key_ms, clip_end_ms, {BAND} AS duration_class
FROM bounds_sql QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY signal_score DESC, key_ms, cluster_no) <= 24""")
def _(t):
    return e.gameplay_candidates(t.signal, t.media_source).select(
        "source_id", "cluster_no", "event_type", "signal_score", "clip_start_ms", "key_ms", "clip_end_ms", "duration_class")


DUCK_VIEWS["session_sql"] = """
  WITH o AS (SELECT source_id, signal_id, t_ms, CASE WHEN t_ms - lag(t_ms) OVER w > 6000 OR lag(t_ms) OVER w IS NULL THEN 1 ELSE 0 END AS opens
    FROM signal WHERE kind = 'AUDIO_PEAK' WINDOW w AS (PARTITION BY source_id ORDER BY t_ms, signal_id)),
  n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY source_id ORDER BY t_ms, signal_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM o)
  SELECT n.source_id, session_no, count(*) AS peaks, any_value(duration_ms) AS duration_ms,
    least(CAST(any_value(duration_ms) AS DOUBLE), sum(t_ms) / count(*)) AS center_ms,
    greatest(0.0, min(t_ms) - 2000) AS start_ms, least(CAST(any_value(duration_ms) AS DOUBLE), max(t_ms) + 3000) AS end_ms,
    least(0.55, 0.2 + count(*) * 0.06) AS confidence
  FROM n JOIN media_source m ON m.source_id = n.source_id GROUP BY n.source_id, session_no"""


@query("gap_sessions", """
SELECT source_id, session_no, peaks, round(center_ms, 6) AS center_ms, CAST(start_ms AS DOUBLE) AS start_ms, CAST(end_ms AS DOUBLE) AS end_ms,
  round(CAST(confidence AS DOUBLE), 9) AS confidence FROM session_sql""")
def _(t):
    peaks = t.signal.filter("kind = 'AUDIO_PEAK'")
    out = e.gap_sessions(peaks, t.media_source).drop("duration_ms")
    return rounded(rounded(out, "center_ms"), "confidence", digits=9)


@query("podcast_candidates", """
WITH b AS (SELECT *, CAST(least(55, 18 + peaks * 8) AS INTEGER) AS signal_score, greatest(0.0, least(duration_ms - 6000, start_ms - 5000)) AS cs FROM session_sql
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY least(55, 18 + peaks * 8) DESC, center_ms, session_no) <= 24)
SELECT source_id, session_no, signal_score, CAST(cs AS DOUBLE) AS clip_start_ms, CAST(least(duration_ms, greatest(cs + 6000, end_ms + 5000)) AS DOUBLE) AS clip_end_ms,
  CASE WHEN least(duration_ms, greatest(cs + 6000, end_ms + 5000)) - cs < 20000 THEN 'QUICK' ELSE 'STANDARD' END AS duration_class FROM b""")
def _(t):
    return e.podcast_candidates(t.signal, t.media_source).select(
        "source_id", "session_no", "signal_score", "clip_start_ms", "clip_end_ms", "duration_class")


@query("candidate_audio_stats", """
WITH c AS (SELECT source_id, cluster_no, clip_start_ms, clip_end_ms FROM bounds_sql
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY signal_score DESC, key_ms, cluster_no) <= 24)
SELECT c.source_id, c.cluster_no, count(*) FILTER (kind = 'AUDIO_PEAK') AS peak_count,
  coalesce(max(abs(value)) FILTER (kind = 'AUDIO_PEAK'), 0) AS maximum_peak, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds
FROM c JOIN signal g ON g.source_id = c.source_id AND t_ms BETWEEN clip_start_ms AND clip_end_ms GROUP BY ALL""")
def _(t):
    clips = e.gameplay_candidates(t.signal, t.media_source).select("source_id", "cluster_no", "clip_start_ms", "clip_end_ms")
    inside = point_join(t.signal, clips, ["source_id"], "t_ms", ("clip_start_ms", "clip_end_ms"))
    audio = F.col("kind") == "AUDIO_PEAK"
    return inside.groupBy("source_id", "cluster_no").agg(
        F.count_if(audio).alias("peak_count"), F.coalesce(F.max(F.when(audio, F.abs("value"))), F.lit(0.0)).alias("maximum_peak"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


SAMPLE_SQL = """
WITH RECURSIVE g AS (
  SELECT short_id, start_ms, event_ms, end_ms, list_concat([start_ms + 100, event_ms, end_ms - 100],
    list_concat(range(start_ms, event_ms - 1100, 3000), list_concat(range(greatest(start_ms, event_ms - 3000), event_ms - 1100, 750),
    list_concat(range(greatest(start_ms, event_ms - 1100), least(end_ms, event_ms + 1100) + 1, 180),
      range(event_ms + 1100, least(end_ms, event_ms + 2000) + 1, 500))))) AS ts FROM pool),
a AS (SELECT short_id, event_ms, list_sort(list_distinct(list_transform(ts, lambda x: greatest(start_ms, least(end_ms, x))))) AS al FROM g),
k AS (SELECT short_id, al, list_distinct(list_concat([al[1], event_ms, al[-1]], list_filter(al, lambda x: abs(x - event_ms) <= 1100))) AS kept, event_ms FROM a),
r AS (SELECT short_id, event_ms, al, kept, list_filter(al, lambda x: NOT list_contains(kept, x)) AS rest, 0 AS n FROM k
  UNION ALL
  SELECT short_id, event_ms, al, list_append(kept, rest[at0 + 1]), list_concat(rest[1:at0], rest[at0 + 2:]), n + 1 FROM (
    SELECT *, CAST(greatest(0, floor((len(kept) + 1) / {limit} * (len(rest) - 1) + 0.5)) AS INTEGER) AS at0 FROM r WHERE len(kept) < {limit} AND len(rest) > 0)),
f AS (SELECT short_id, event_ms, CASE WHEN len(al) <= {limit} THEN al ELSE list_sort(kept)[1:{limit}] END AS samples FROM r QUALIFY row_number() OVER (PARTITION BY short_id ORDER BY n DESC) = 1)
"""


@query("adaptive_samples", SAMPLE_SQL.format(limit=18) + "SELECT short_id, array_to_string(samples, ',') AS samples FROM f")
def _(t):
    out = e.adaptive_samples(t.pool.select("short_id", "start_ms", "event_ms", "end_ms"), 18)
    return out.select("short_id", F.array_join(F.col("sample_ms").cast("array<string>"), ",").alias("samples"))


@query("key_frame_index", SAMPLE_SQL.format(limit=18) + """SELECT short_id, CAST(list_position(samples, event_ms) - 1 AS INTEGER) AS key_index,
  samples[1] AS first_ms, samples[-1] AS last_ms FROM f""")
def _(t):
    out = e.adaptive_samples(t.pool.select("short_id", "start_ms", "event_ms", "end_ms"), 18)
    return out.select(
        "short_id", e.key_frame_index(F.col("sample_ms"), F.col("event_ms")).alias("key_index"),
        F.element_at("sample_ms", 1).alias("first_ms"), F.element_at("sample_ms", -1).alias("last_ms"))


GAME_ROWS = ", ".join(f"({n}, '{p}', '{g}', {chr(39) + ed + chr(39) if ed else 'NULL'})" for n, (p, g, ed) in enumerate(config.GAME_PATTERNS))
DUCK_VIEWS["identified_sql"] = f"""
  SELECT s.source_id, filename, content_type, coalesce(g.game, 'Unknown gameplay') AS game, g.edition, CASE WHEN g.game IS NULL THEN 0.0 ELSE 0.82 END AS confidence
  FROM source s LEFT JOIN (VALUES {GAME_ROWS}) AS g(ord, re, game, edition)
    ON regexp_matches(regexp_replace(lower(filename), '[-_.]+', ' ', 'g'), re)
  QUALIFY row_number() OVER (PARTITION BY s.source_id ORDER BY g.ord) = 1"""


@query("identify_game", "SELECT source_id, game, edition, CAST(confidence AS DOUBLE) AS confidence FROM identified_sql")
def _(t):
    return t.source.select("source_id", identify_game("filename").alias("g")).select("source_id", "g.game", "g.edition", "g.confidence")


@query("content_type_resolve", r"""
SELECT source_id, CASE WHEN content_type <> 'AUTO' THEN content_type WHEN confidence >= 0.55 THEN 'GAMEPLAY'
    WHEN regexp_matches(lower(filename), '(?:^|[\s._-])(podcast|interview|conversation|roundtable|talkshow|debate)(?:[\s._-]|$)') THEN 'PODCAST' ELSE 'GAMEPLAY' END AS type,
  CASE WHEN content_type <> 'AUTO' THEN 'USER' WHEN confidence >= 0.55 THEN 'FILENAME'
    WHEN regexp_matches(lower(filename), '(?:^|[\s._-])(podcast|interview|conversation|roundtable|talkshow|debate)(?:[\s._-]|$)') THEN 'FILENAME' ELSE 'DEFAULT' END AS method
FROM identified_sql""")
def _(t):
    g = t.source.withColumn("g", identify_game("filename"))
    return g.select("source_id", content_type("content_type", "filename", F.col("g.confidence")).alias("c")).select(
        "source_id", "c.type", "c.method")


@query("game_override", """
SELECT i.source_id, CASE WHEN i.source_id % 6 = 0 THEN 'Fortnite' ELSE i.game END AS game,
  CASE WHEN i.source_id % 6 <> 0 AND i.source_id % 100 >= 60 THEN 'Valorant' WHEN i.source_id % 6 = 0 THEN 'Fortnite' ELSE i.game END AS refreshed
FROM identified_sql i""")
def _(t):
    g = t.source.select(
        "source_id", identify_game("filename")["game"].alias("inferred"), F.when(F.col("source_id") % 6 == 0, "Fortnite").alias("override"))
    game = F.coalesce("override", "inferred")
    refreshed = F.when(F.col("override").isNull() & (F.col("source_id") % 100 >= 60), "Valorant").otherwise(game)
    return g.select("source_id", game.alias("game"), refreshed.alias("refreshed"))


# rows a user adds to the published policies, for the three queries below
OWN_POLICY = (2.5, "own-burst-v1", None, "burst", 1800, 0.9)
OWN_GAME = (-1.0, r"\bfortnite\b", "Fortnite", "Own")
OWN_DETECTOR = (-1.0, "own-v1", "fortnite", 0.7, ["AUDIO_PEAK"], "OWN_REACTION")


@query("clustering_rule_rows", f"""
SELECT signal_id, policy_id, gap_ms FROM (
  SELECT signal_id, p.policy_id, p.gap_ms, row_number() OVER (PARTITION BY signal_id ORDER BY p.ord) AS place FROM evidence_sql e
  JOIN (SELECT * FROM (VALUES {PROFILE_ROWS}, (2.5, 'own-burst-v1', '.*', 'burst', 1800, 0.9)) AS v(ord, policy_id, game_re, event_re, gap_ms, low)) p
    ON least(game_confidence, confidence) >= low AND regexp_matches(lower(game), game_re) AND regexp_matches(lower(event_type), event_re))
WHERE place = 1""")
def _(t):
    table = rules.clustering_rules(t.spark).union(t.spark.createDataFrame([OWN_POLICY], rules.CLUSTERING))
    rows = e.event_evidence(t.signal).join(t.media_source, "source_id")
    fit = rules.clustering_of(F.col("game"), F.col("event_type"), F.least("game_confidence", "confidence"), table)
    return rows.select("signal_id", fit.alias("p")).select("signal_id", "p.*")


@query("game_rule_rows", """
SELECT source_id, CASE WHEN own THEN 'Fortnite' WHEN confidence > 0 THEN game END AS game, CASE WHEN own THEN 'Own' ELSE edition END AS edition
FROM (SELECT *, regexp_matches(regexp_replace(lower(filename), '[-_.]+', ' ', 'g'), '\\bfortnite\\b') AS own FROM identified_sql)""")
def _(t):
    table = rules.game_rules(t.spark).union(t.spark.createDataFrame([OWN_GAME], rules.GAMES))
    return t.source.select("source_id", rules.game_of(F.col("filename"), table).alias("g")).select("source_id", "g.*")


DETECTOR_ROWS = ", ".join(
    f"({n}, '{name}', '{'|'.join(words)}', {low}, {needs}, '{outcome}')" for n, (name, words, low, needs, outcome) in enumerate(
        (name, words, config.PROFILE_MIN_CONFIDENCE, needs, outcome)
        for name, words, types, fallback, *_ in config.DETECTOR_PROFILES for needs, outcome in [*types, ([], fallback)]))


@query("detector_rule_rows", f"""
SELECT signal_id, profile, told AS event_type FROM (
  SELECT signal_id, p.profile, p.told, row_number() OVER (PARTITION BY signal_id ORDER BY p.ord NULLS LAST) AS place FROM evidence_sql e
  LEFT JOIN (SELECT * FROM (VALUES {DETECTOR_ROWS}, (-1, 'own-v1', 'fortnite', 0.7, ['AUDIO_PEAK'], 'OWN_REACTION'))
      AS v(ord, profile, game_re, low, needs, told)) p
    ON game_confidence >= low AND regexp_matches(lower(game), game_re) AND list_has_all([kind], needs))
WHERE place = 1""")
def _(t):
    table = rules.detector_rules(t.spark).union(t.spark.createDataFrame([OWN_DETECTOR], rules.DETECTORS))
    rows = e.event_evidence(t.signal).join(t.media_source, "source_id")
    fit = rules.detected_type(F.col("game"), F.col("game_confidence"), F.array("kind"), table)
    return rows.select("signal_id", fit.alias("d")).select("signal_id", "d.*")


@query("sql_adaptive_samples", SAMPLE_SQL.format(limit=18) + "SELECT short_id, array_to_string(samples, ',') AS samples FROM f")
def _(t):
    table_functions.register(t.spark)
    return t.spark.sql("""
        SELECT short_id, array_join(CAST(sample_ms AS ARRAY<STRING>), ',') AS samples
        FROM adaptive_samples(TABLE(SELECT short_id, start_ms, event_ms, end_ms FROM {pool}) PARTITION BY (short_id), 18)""", pool=t.pool)
