"""Interval, transcript and timeline queries."""

from pyspark.sql import functions as F

from cliploom.operators import intervals as iv
from cliploom.operators import timeline as tl
from cliploom.operators import transcript as tr
from cliploom.plans.common import rounded
from cliploom.plans.registry import query
from cliploom.sources.tables import DUCK_VIEWS


def pieces_sql(clips, silences):
    return f"""
  WITH r AS (SELECT c.clip_id, c.start_ms, c.end_ms, greatest(c.start_ms, s.t_ms) AS s, least(c.end_ms, s.t_ms + s.dur_ms) AS e
    FROM {clips} c JOIN {silences} s ON s.source_id = c.source_id AND s.t_ms + s.dur_ms > c.start_ms AND s.t_ms < c.end_ms),
  k AS (SELECT * FROM r WHERE e - s >= 1200 AND s > start_ms + 750 AND e < end_ms - 750
    UNION ALL SELECT clip_id, start_ms, end_ms, end_ms, end_ms FROM {clips}),
  p AS (SELECT clip_id, greatest(start_ms, coalesce(max(e) OVER (PARTITION BY clip_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ms)) AS source_start, s AS source_end FROM k),
  q AS (SELECT * FROM p WHERE source_end > source_start + 100),
  a AS (SELECT * FROM q UNION ALL SELECT clip_id, start_ms, end_ms FROM {clips} WHERE clip_id NOT IN (SELECT clip_id FROM q))
  SELECT *, CAST(coalesce(sum(source_end - source_start) OVER (PARTITION BY clip_id ORDER BY source_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS output_start FROM a"""


DUCK_VIEWS["media_cut"] = pieces_sql("media_clip", "(SELECT * FROM signal WHERE kind = 'SILENCE')")
DUCK_VIEWS["talk_cut"] = pieces_sql("talk_clip", "talk_silence")


def media_cuts(t):
    return iv.interval_subtract(t.media_clip, t.signal.filter("kind = 'SILENCE'").select("source_id", "t_ms", "dur_ms"))


def talk_cuts(t):
    return iv.interval_subtract(t.talk_clip, t.talk_silence)


@query("interval_subtract", "SELECT clip_id, source_start, source_end FROM media_cut")
def _(t):
    return media_cuts(t).select("clip_id", "source_start", "source_end")


@query("running_output_offset", "SELECT clip_id, source_start, output_start FROM talk_cut")
def _(t):
    return talk_cuts(t).select("clip_id", "source_start", "output_start")


@query("point_in_cut_join", """
SELECT signal_id, c.clip_id, CAST(output_start + (t_ms - source_start) AS DOUBLE) AS output_ms FROM media_cut c JOIN media_clip m ON m.clip_id = c.clip_id
JOIN signal s ON s.source_id = m.source_id AND t_ms BETWEEN source_start AND source_end WHERE kind <> 'SILENCE'""")
def _(t):
    points = t.signal.filter("kind <> 'SILENCE'").select("signal_id", "source_id", "t_ms")
    return tl.remap_points(points, t.media_clip, media_cuts(t)).select("signal_id", "clip_id", "output_ms")


@query("interval_overlap_join", """
SELECT c.clip_id, count(*) AS words, substr(trim(string_agg(w, ' ' ORDER BY word.start_ms, chunk_index, pos)), 1, 4000) AS excerpt
FROM talk_clip c JOIN word ON transcript_id = c.source_id AND word.end_ms > c.start_ms AND word.start_ms < c.end_ms GROUP BY c.clip_id""")
def _(t):
    return tr.excerpts(t.talk_clip, t.word)


@query("midpoint_speaker_join", """
SELECT w.transcript_id, w.chunk_index, w.pos, s.speaker AS segment_speaker FROM word w LEFT JOIN turn_span s ON s.transcript_id = w.transcript_id
  AND (w.start_ms + w.end_ms) / 2 BETWEEN s.start_ms AND s.end_ms
QUALIFY row_number() OVER (PARTITION BY w.transcript_id, w.chunk_index, w.pos ORDER BY s.start_ms, s.end_ms) = 1""")
def _(t):
    return tr.midpoint_speaker_join(t.word, t.turn_span).select("transcript_id", "chunk_index", "pos", "segment_speaker")


DUCK_VIEWS["chunk_sql"] = """
  SELECT source_id, i AS chunk_index, i * 480000 AS core_start, least(duration_ms, i * 480000 + 480000) AS core_end, greatest(0, i * 480000 - 1000) AS chunk_start,
    least(duration_ms, least(duration_ms, i * 480000 + 480000) + 1000) AS chunk_end, i * 480000 - greatest(0, i * 480000 - 1000) AS overlap_before
  FROM (SELECT source_id, duration_ms, unnest(range((duration_ms - 1) // 480000 + 1)) AS i FROM (SELECT source_id, CAST(floor(duration_s * 1000) AS BIGINT) AS duration_ms FROM source) WHERE duration_ms > 0)"""


def source_chunks(t):
    return tr.chunk_plan(t.source.selectExpr("source_id", "CAST(floor(duration_s * 1000) AS BIGINT) AS duration_ms"))


@query("chunk_plan", "SELECT * FROM chunk_sql")
def _(t):
    return source_chunks(t)


@query("chunk_word_assign", """
SELECT source_id, chunk_index, w, greatest(core_start, chunk_start + ws) AS start_ms, least(core_end, chunk_start + we) AS end_ms FROM (
  SELECT transcript_id AS source_id, start_ms // 60000 AS chunk_index, w, start_ms - greatest(0, start_ms // 60000 * 60000 - 1000) - pos % 5 * 700 AS ws,
    end_ms - greatest(0, start_ms // 60000 * 60000 - 1000) - pos % 5 * 700 AS we, start_ms // 60000 * 60000 AS core_start,
    least(max(end_ms) OVER (PARTITION BY transcript_id), start_ms // 60000 * 60000 + 60000) AS core_end,
    greatest(0, start_ms // 60000 * 60000 - 1000) AS chunk_start FROM word)
WHERE chunk_start + (ws + we) / 2 >= core_start AND chunk_start + (ws + we) / 2 < core_end AND least(core_end, chunk_start + we) > greatest(core_start, chunk_start + ws)""")
def _(t):
    talks = t.word.groupBy(F.col("transcript_id").alias("source_id")).agg(F.max("end_ms").alias("duration_ms"))
    chunks = tr.chunk_plan(talks, 60000, 1000)
    index = F.floor(F.col("start_ms") / 60000)
    offset = F.greatest(F.lit(0).cast("bigint"), index * 60000 - 1000) + F.col("pos") % 5 * 700
    words = t.word.select(
        F.col("transcript_id").alias("source_id"), index.alias("chunk_index"), "w",
        (F.col("start_ms") - offset).alias("w_start"), (F.col("end_ms") - offset).alias("w_end"))
    return tr.chunk_word_assign(words, chunks)


def planned_chunks(t):
    status = F.when(F.col("conv_id") % 9 == 0, "FAILED").otherwise("SUCCEEDED")
    return t.base("conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("chunk_index"), status.alias("status"))


@query("transcript_chunks", """
SELECT c.conv_id AS transcript_id, c.turn AS chunk_index, status, bool_and(status = 'SUCCEEDED') OVER (PARTITION BY c.conv_id) AS complete, txt AS chunk_text
FROM (SELECT *, CASE WHEN conv_id % 9 = 0 AND turn % 2 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status FROM conversations) c
LEFT JOIN (SELECT transcript_id, chunk_index, string_agg(w, ' ' ORDER BY start_ms, pos) AS txt FROM word GROUP BY ALL) x
  ON x.transcript_id = c.conv_id AND x.chunk_index = c.turn""")
def _(t):
    failed = F.when((F.col("transcript_id") % 9 == 0) & (F.col("chunk_index") % 2 == 0), "FAILED").otherwise("SUCCEEDED")
    return tr.transcript_chunks(t.word, planned_chunks(t).withColumn("status", failed))


@query("transcript_assemble", """
SELECT c.conv_id AS transcript_id, bool_and(c.conv_id % 9 <> 0) AS complete, CASE WHEN bool_and(c.conv_id % 9 <> 0) THEN coalesce(string_agg(txt, ' ' ORDER BY turn), '') END AS full_text
FROM conversations c LEFT JOIN (SELECT transcript_id, chunk_index, string_agg(w, ' ' ORDER BY start_ms, pos) AS txt FROM word GROUP BY ALL) x
  ON x.transcript_id = c.conv_id AND x.chunk_index = c.turn GROUP BY c.conv_id""")
def _(t):
    return tr.transcript_assemble(t.word, planned_chunks(t))


@query("pending_chunks", """
SELECT source_id, chunk_index FROM chunk_sql c WHERE NOT EXISTS (SELECT 1 FROM job j WHERE j.source_id = c.source_id AND attempt = c.chunk_index AND state = 'SUCCEEDED')""")
def _(t):
    finished = t.job.select("source_id", F.col("attempt").cast("bigint").alias("chunk_index"), F.col("state").alias("status"))
    return tr.pending_chunks(source_chunks(t), finished).select("source_id", "chunk_index")


DUCK_VIEWS["subtitle_sql"] = """
  WITH RECURSIVE m AS (SELECT c.clip_id, w.w, output_start + (w.start_ms - source_start) AS s, output_start + (w.end_ms - source_start) AS e,
      row_number() OVER (PARTITION BY c.clip_id ORDER BY w.start_ms, pos) AS rn
    FROM talk_cut c JOIN talk_clip k ON k.clip_id = c.clip_id JOIN word w ON w.transcript_id = k.source_id AND w.start_ms BETWEEN source_start AND source_end
      AND w.end_ms <= source_end AND w.start_ms BETWEEN event_ms - 4000 AND event_ms + 4000),
  g AS (SELECT clip_id, rn, s, e, w, 1 AS group_no, s AS first_s, 1 AS size FROM m WHERE rn = 1
    UNION ALL
    SELECT m.clip_id, m.rn, m.s, m.e, m.w, group_no + CASE WHEN size >= 5 OR m.s - g.e > 450 OR m.e - first_s > 1600 THEN 1 ELSE 0 END,
      CASE WHEN size >= 5 OR m.s - g.e > 450 OR m.e - first_s > 1600 THEN m.s ELSE first_s END,
      CASE WHEN size >= 5 OR m.s - g.e > 450 OR m.e - first_s > 1600 THEN 1 ELSE size + 1 END FROM g JOIN m ON m.clip_id = g.clip_id AND m.rn = g.rn + 1)
  SELECT clip_id, group_no, substr(string_agg(w, ' ' ORDER BY rn), 1, 80) AS caption, CAST(min(s) AS DOUBLE) AS start_ms,
    CAST(greatest(max(e), min(s) + 450) AS DOUBLE) AS end_ms, CAST(count(*) AS INTEGER) AS tokens FROM g WHERE group_no <= 6 GROUP BY ALL"""


@query("subtitle_groups", "SELECT * FROM subtitle_sql")
def _(t):
    return tl.subtitle_groups(t.talk_clip, t.word, talk_cuts(t))


EFFECT = "split_part('CLEAN|PUNCH_IN|IMPACT|REPLAY', '|', CAST(clip_id % 4 AS INTEGER) + 1)"


def documents(t):
    cuts = talk_cuts(t)
    clips = t.talk_clip.withColumns({
        "effect": F.expr(EFFECT), "hook": F.when(F.col("clip_id") % 5 == 0, "").otherwise("watch this")})
    return tl.edl_build(clips, cuts, tl.subtitle_groups(t.talk_clip, t.word, cuts))


DUCK_VIEWS["edl_sql"] = f"""
  WITH b AS (SELECT clip_id, sum(source_end - source_start) AS base, count(*) AS cuts FROM talk_cut GROUP BY 1),
  c AS (SELECT clip_id, count(*) AS captions FROM subtitle_sql GROUP BY 1),
  x AS (SELECT k.*, {EFFECT} AS effect, base, cuts, coalesce(captions, 0) AS captions,
      least(60000.0, base + CASE WHEN clip_id % 4 = 3 THEN 1600 / CAST(0.65 AS DOUBLE) ELSE 0 END) AS output_ms FROM talk_clip k JOIN b USING (clip_id) LEFT JOIN c USING (clip_id)),
  y AS (SELECT *, greatest(400.0, least(output_ms - 200, event_ms - start_ms)) AS at0 FROM x)
  SELECT *, greatest(0.0, at0 - 300) AS fx_start, least(output_ms, at0 + 500) AS fx_end FROM y"""


@query("edl_build", """
SELECT clip_id, round(output_ms, 6) AS output_ms, CAST(cuts AS INTEGER) AS cuts, CAST(captions AS INTEGER) AS captions, clip_id % 5 <> 0 AS has_hook,
  CASE effect WHEN 'REPLAY' THEN 'PAYOFF_TEASE' WHEN 'IMPACT' THEN 'ACTION_FIRST' ELSE 'IMMEDIATE_CONTEXT' END AS hook_kind,
  CASE WHEN effect IN ('PUNCH_IN', 'IMPACT') THEN round(fx_start, 6) END AS zoom_start, CASE WHEN effect IN ('PUNCH_IN', 'IMPACT') THEN round(fx_end, 6) END AS zoom_end,
  CAST(CASE effect WHEN 'IMPACT' THEN 2 ELSE 1 END AS INTEGER) AS overlays, CASE effect WHEN 'CLEAN' THEN 'LOW' ELSE 'MEDIUM' END AS intensity FROM edl_sql""")
def _(t):
    zoom = F.get("zooms", F.lit(0))
    out = documents(t).select(
        "clip_id", "output_ms", F.size("cuts").alias("cuts"), F.size("captions").alias("captions"), F.col("hook").isNotNull().alias("has_hook"),
        "hook_kind", zoom["start"].alias("zoom_start"), zoom["end"].alias("zoom_end"), F.size("overlays").alias("overlays"), "intensity")
    return rounded(out, "output_ms", "zoom_start", "zoom_end")


@query("effect_count", """
SELECT clip_id, CAST(CASE WHEN effect IN ('PUNCH_IN', 'IMPACT') THEN 1 ELSE 0 END + CASE effect WHEN 'REPLAY' THEN 1 ELSE 0 END
  + CASE effect WHEN 'IMPACT' THEN 3 ELSE 1 END AS INTEGER) AS effects FROM edl_sql""")
def _(t):
    return documents(t).select(
        "clip_id", tl.effect_count("zooms", "freeze_frames", "replays", "overlays", "sound_effects").alias("effects"))


@query("caption_every_other", """
SELECT clip_id, array_to_string(list_transform(list_filter(list(caption ORDER BY start_ms), lambda x, i: i % 2 = 1), lambda x: x), '|') AS captions FROM subtitle_sql GROUP BY 1""")
def _(t):
    kept = tl.caption_every_other(F.col("captions"))
    return documents(t).filter(F.size("captions") > 0).select(
        "clip_id", F.array_join(F.transform(kept, lambda c: c["caption"]), "|").alias("captions"))


def broken_documents(t):
    """Documents with planted faults, by item number."""
    i = F.col("short_id")
    length = F.col("duration_s") * 1000
    faulty = lambda n, bad, good: F.when(i % n == 0, bad).otherwise(good)
    timed = F.array(F.struct(F.lit(0.0).alias("start"), faulty(7, length + 500, length).alias("end")))
    cuts = F.array(F.struct(
        F.lit(1000.0).alias("source_start"), faulty(11, length * 2 + 2000, length + 1000).alias("source_end"), F.lit(0.0).alias("output_start"), F.lit(1.0).alias("speed")))
    return t.short.select(
        "short_id", F.lit(1000.0).alias("clip_start"), faulty(13, F.lit(500.0), length + 1000).alias("clip_end"), length.alias("output_ms"),
        F.lit(1000.0).alias("event_start"), faulty(17, F.lit(0.0), F.lit(1500.0)).alias("key_moment"), F.lit(2000.0).alias("payoff_end"),
        timed.alias("timed"), cuts.alias("cuts"), faulty(19, F.lit(200.0), F.lit(0.0)).alias("hook_start"),
        F.when(i % 3 == 0, "TRACKED_CROP").otherwise("SMART_CROP").alias("crop"), (i % 10 / 10.0).alias("track_confidence"), (i % 4).cast("int").alias("track_points"))


@query("edl_validate", """
WITH x AS (SELECT short_id AS i, duration_s * 1000 AS len FROM short)
SELECT i AS short_id, array_to_string(list_filter([CASE WHEN i % 13 = 0 THEN 'clipEnd' END, CASE WHEN i % 17 = 0 THEN 'eventAnchors' END, CASE WHEN i % 7 = 0 THEN 'timeline' END,
  CASE WHEN i % 11 = 0 OR i % 13 = 0 THEN 'cuts' END, CASE WHEN i % 19 = 0 THEN 'hook' END, CASE WHEN i % 3 = 0 AND (i % 10 < 8 OR i % 4 = 0) THEN 'trackingConfidence' END,
  CASE WHEN i % 4 > 0 AND i % 3 <> 0 THEN 'trackedSubject' END], lambda x: x IS NOT NULL), ',') AS issues FROM x""")
def _(t):
    return tl.edl_validate(broken_documents(t)).select("short_id", F.array_join("issues", ",").alias("issues"))


@query("edl_schema_rules", """
SELECT short_id, array_to_string(list_filter([CASE WHEN duration_s * 1000 - 2000 <= 0 THEN 'clipEnd' END, CASE WHEN short_id % 9 = 0 THEN 'outputDuration' END,
  CASE WHEN short_id % 8 = 0 THEN 'cropStrategy' END, CASE WHEN short_id % 21 = 0 THEN 'cuts' END, CASE WHEN short_id % 6 = 0 THEN 'hashtags' END,
  CASE WHEN short_id % 7 = 0 THEN 'duplicateScore' END], lambda x: x IS NOT NULL), ',') AS violations FROM short""")
def _(t):
    i = F.col("short_id")
    docs = t.short.select(
        "short_id", F.lit(0.0).alias("clip_start"), (F.col("duration_s") * 1000 - 2000).alias("clip_end"),
        F.when(i % 9 == 0, 60001.0).otherwise(F.col("duration_s") * 1000).alias("output_ms"), F.lit("QUICK").alias("duration_class"),
        F.when(i % 8 == 0, "CENTER").otherwise("SMART_CROP").alias("crop"), F.array_repeat(F.lit(1), F.when(i % 21 == 0, 81).otherwise(3)).alias("cuts"),
        F.array_repeat(F.lit(1), (i % 5).cast("int")).alias("zooms"), "title",
        F.when(i % 6 == 0, F.array(F.lit("#ok"), F.lit("no hash"))).otherwise(F.array(F.lit("#ok"))).alias("hashtags"), "highlight",
        F.when(i % 7 == 0, 1.5).otherwise(0.5).alias("duplicate_score"))
    return tl.schema_rules(docs, tl.edl_field_rules()).select("short_id", F.array_join("violations", ",").alias("violations"))


@query("edl_migrate_v1", """
SELECT short_id, CASE WHEN short_id % 2 = 0 THEN CASE short_id % 6 WHEN 0 THEN 'CENTER_CROP' WHEN 2 THEN 'BLURRED_BACKGROUND' ELSE 'STACKED' END
    ELSE 'SMART_CROP' END AS crop, CASE WHEN short_id % 2 = 0 THEN 10 + duration_s / 2 ELSE 1.0 END AS key_moment_s,
  CASE WHEN short_id % 2 = 0 THEN CASE WHEN duration_s <= 12 THEN 'MICRO' WHEN duration_s <= 20 THEN 'QUICK' WHEN duration_s <= 35 THEN 'STANDARD'
    WHEN duration_s <= 50 THEN 'STORY' ELSE 'EXTENDED' END ELSE 'QUICK' END AS duration_class,
  CASE WHEN short_id % 2 = 0 THEN CASE WHEN short_id % 5 > 0 THEN 1.0 ELSE 0.0 END ELSE 0.25 END::DOUBLE AS track_confidence,
  CASE WHEN short_id % 2 = 0 THEN CASE WHEN short_id % 4 > 0 THEN 'IMMEDIATE_CONTEXT' END ELSE 'COLD_OPEN' END AS hook_kind,
  CASE WHEN short_id % 2 = 0 THEN 'HEURISTIC_FALLBACK' ELSE 'AI' END AS analysis_method FROM short""")
def _(t):
    i = F.col("short_id")
    old = i % 2 == 0
    docs = t.short.select(
        "short_id", F.when(old, 1).otherwise(2).alias("schema_version"),
        F.when(~old, "SMART_CROP").when(i % 6 == 0, "CENTER").when(i % 6 == 2, "BACKGROUND_BLUR").otherwise("STACKED").alias("crop"),
        F.lit(10.0).alias("clip_start_s"), (F.col("duration_s") + 10).alias("clip_end_s"), F.when(i % 10 != 0, F.col("duration_s")).alias("output_s"),
        F.lit(0.5).alias("event_start_s"), F.lit(1.0).alias("key_moment_s"), F.lit(2.0).alias("payoff_end_s"), F.lit("QUICK").alias("duration_class"),
        F.array_repeat(F.lit(1), (i % 5).cast("int")).alias("tracked"), F.lit(0.25).alias("track_confidence"),
        F.when(i % 4 > 0, "hook").alias("hook"), F.lit("COLD_OPEN").alias("hook_kind"), F.lit("AI").alias("analysis_method"))
    return tl.edl_migrate_v1(docs).select("short_id", "crop", "key_moment_s", "duration_class", "track_confidence", "hook_kind", "analysis_method")


@query("tracking_crop", """
WITH x AS (SELECT short_id, split_part('TRACKED_CROP|CENTER_CROP', '|', CAST(short_id % 2 AS INTEGER) + 1) AS req, CAST(confidence AS DOUBLE) / 100 AS c,
  CAST(quality AS DOUBLE) / 1000 AS j, CAST(highlight AS DOUBLE) / 200 AS m, short_id % 7 AS n, CASE WHEN short_id % 3 = 0 THEN 2.2 ELSE 1.7 END AS aspect FROM short)
SELECT short_id, CASE WHEN req <> 'TRACKED_CROP' THEN req WHEN c >= 0.72 AND j <= 0.08 AND m <= 0.25 AND n >= 3 THEN 'TRACKED_CROP'
  WHEN aspect >= 2.1 THEN 'BLURRED_BACKGROUND' ELSE 'SMART_CROP' END AS crop, CASE WHEN req = 'TRACKED_CROP' THEN c ELSE 0 END AS crop_confidence FROM x""")
def _(t):
    rows = t.short.selectExpr(
        "short_id", "split_part('TRACKED_CROP|CENTER_CROP', '|', CAST(short_id % 2 AS INTEGER) + 1) AS requested_crop",
        "CAST(confidence AS DOUBLE) / 100 AS track_confidence", "CAST(quality AS DOUBLE) / 1000 AS jitter", "CAST(highlight AS DOUBLE) / 200 AS missing_ratio",
        "short_id % 7 AS points", "CASE WHEN short_id % 3 = 0 THEN 2.2D ELSE 1.7D END AS aspect")
    return tl.tracking_crop(rows).select("short_id", "crop", "crop_confidence")
