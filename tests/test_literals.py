"""Published expectations as literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from cliploom.functions import evidence, numeric, text, times
from cliploom.operators import dedup, events, health, intervals, learning, planning, timeline, transcript
from cliploom.sources import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_zero_is_not_missing(spark):
    rows = spark.createDataFrame([("0",), ("",), (None,), ("-1",), ("42",), ("1e400",)], "v string")
    got = rows.select(ingest.integer_value("v").alias("n"), ingest.integer_invalid("v").alias("bad")).collect()
    assert [(r.n, r.bad) for r in got] == [(0, False), (None, False), (None, False), (None, True), (42, False), (None, True)]


def test_parse_rejects_wrong_width(spark):
    head = '{"columnHeaders":[{"name":"day"},{"name":"views"}]'
    docs = [(1, head + ',"rows":[["2026-09-01",42]]}'), (2, head + "}"), (3, head + ',"rows":[["2026-09-01"]]}')]
    got = ingest.parse_result_table(spark.createDataFrame(docs, "id int, body string")).collect()
    assert sorted((r.id, r.bad_width) for r in got) == [(1, False), (3, True)]
    assert [r.fields for r in got if r.id == 1] == [{"day": "2026-09-01", "views": "42"}]


def test_hook_types(spark):
    hooks = ["Wait for this?", "3 kills", "wild 🔥", "almost there", "clean win", None]
    got = spark.createDataFrame([(h,) for h in hooks], "h string").select(text.hook_type("h").alias("t")).collect()
    assert [r.t for r in got] == ["QUESTION", "NUMBER", "REACTION", "CURIOSITY", "DIRECT", "ACTION_FIRST"]


def test_buckets(spark):
    assert one(spark, numeric.learning_bucket(F.lit(18.0))) == "14–22s"
    assert one(spark, numeric.learning_bucket(F.lit(40.0))) == "40s+"


def test_score_prefers_engagement(spark):
    def score(views, engaged, pct, shares, subs):
        parts = numeric.score_components(*[F.lit(float(v)) for v in (views, engaged, pct, shares, subs)], F.lit(24))
        return one(spark, numeric.outcome_score(parts))

    assert score(100, 90, 95, 4, 2) > score(1000, 100, 10, 0, 0)


def test_recommendation_and_prediction(spark):
    assert one(spark, numeric.recommendation_delta(F.lit(60.0))) == 0.15
    items = spark.createDataFrame([(1, 7, "CURIOSITY", 70.0)], "owner_id bigint, short_id bigint, hook_type string, base double")
    adj = spark.createDataFrame([(1, "hook_type", "CURIOSITY", 0.15)], "owner_id bigint, dimension string, segment string, adjustment double")
    row = learning.predict_performance(items, adj, "base", ["hook_type"]).first()
    assert (row.predicted_score, row.prediction_confidence) == (80.5, "MEDIUM")


def test_arm_is_stable(spark):
    assert one(spark, numeric.deterministic_arm(F.lit("e:s"), F.lit(0.0))) == "CONTROL"
    assert one(spark, numeric.deterministic_arm(F.lit("e1:s1"), F.lit(0.43))) == "VARIANT"


def evidence_rows(spark, times_ms, kind="ATTACK_BUILDUP", confidence=0.9):
    rows = [(1, i, t, "MOTION_PEAK", 1.0, kind, confidence) for i, t in enumerate(times_ms)]
    return spark.createDataFrame(
        rows, "source_id bigint, signal_id bigint, t_ms bigint, kind string, value double, event_type string, confidence double")


def test_clusters(spark):
    sources = spark.createDataFrame([(1, "EA Sports FC", 0.9)], "source_id bigint, game string, game_confidence double")
    got = events.event_clusters(evidence_rows(spark, [10000, 15000, 25000]), sources).orderBy("cluster_no").collect()
    assert [(r.start_ms, r.end_ms, r.policy_id) for r in got] == [
        (10000.0, 15000.0, "fc-attacking-sequence-v1"), (25000.0, 25000.0, "fc-attacking-sequence-v1")]


def test_clusters_agree_with_brute_force(spark):
    import random

    random.seed(3)
    kinds = ["SCENE_TRANSITION", "AUDIO_REACTION", "ACTIVITY_BURST"]
    rows = sorted((random.randrange(0, 60000), i, random.choice(kinds)) for i in range(60))
    df = spark.createDataFrame(
        [(1, i, t, "MOTION_PEAK", 1.0, k, 0.5) for t, i, k in rows],
        "source_id bigint, signal_id bigint, t_ms bigint, kind string, value double, event_type string, confidence double")
    sources = spark.createDataFrame([(1, "Other", 0.0)], "source_id bigint, game string, game_confidence double")
    expected = []
    for t, _, k in rows:
        last = expected[-1] if expected else None
        if last and (last[0] == k or "ACTIVITY" in last[0] or "ACTIVITY" in k) and t - last[2] <= 2500:
            last[2] = t
        else:
            expected.append([k, t, t])
    got = events.event_clusters(df, sources).orderBy("cluster_no").collect()
    assert [[r.event_type, int(r.start_ms), int(r.end_ms)] for r in got] == expected


def test_long_story_bounds(spark):
    row = spark.createDataFrame(
        [(1, 40000.0, 56000.0, 72000.0, ["AUDIO_PEAK"], 120000)],
        "source_id bigint, start_ms double, key_ms double, end_ms double, kinds array<string>, duration_ms bigint")
    got = events.content_bounds(row).first()
    assert got.clip_end_ms - got.clip_start_ms > 30000 and got.duration_class == "STORY"


def test_fallback_event(spark):
    sources = spark.createDataFrame([(1, "Other", 0.0, 20000)], "source_id bigint, game string, game_confidence double, duration_ms bigint")
    none = spark.createDataFrame([], "signal_id bigint, source_id bigint, kind string, t_ms bigint, dur_ms bigint, value double")
    got = events.gameplay_candidates(none, sources).collect()
    assert [(r.key_ms, r.signal_score) for r in got] == [(10000.0, 10)]


def test_sampling(spark):
    clips = spark.createDataFrame([(1, 9000, 10000, 11000), (2, 0, 20000, 40000)], "short_id bigint, start_ms bigint, event_ms bigint, end_ms bigint")
    got = {r.short_id: r.sample_ms for r in events.adaptive_samples(clips).collect()}
    burst = [b - a for a, b in zip(got[1], got[1][1:])]
    assert len(got[1]) >= 10 and max(burst) <= 200
    assert len(got[1]) < len(got[2]) <= 24


def test_duplicate_rule(spark):
    score, duplicate = dedup.evaluate_duplicate(
        F.lit(False), F.lit(1.0), F.lit(0.8), F.lit(0.9), F.lit(0.95), F.lit(0.8), F.lit(True))
    assert one(spark, duplicate) is True


def test_hash_sequences(spark):
    near = evidence.sequence_similarity(F.array(F.lit("0" * 16), F.lit("f" * 16)), F.array(F.lit("0" * 15 + "1"), F.lit("f" * 15 + "e")))
    assert one(spark, near) > 0.96
    assert one(spark, evidence.sequence_similarity(F.array().cast("array<string>"), F.array(F.lit("0" * 16)))) is None


def test_dead_air(spark):
    clips = spark.createDataFrame([(1, 1, 10000, 20000), (2, 1, 10000, 20000)], "clip_id bigint, source_id bigint, start_ms bigint, end_ms bigint")
    silence = spark.createDataFrame([(1, 13000, 2000), (1, 10000, 1500)], "source_id bigint, t_ms bigint, dur_ms bigint")
    got = intervals.interval_subtract(clips.filter("clip_id = 1"), silence).orderBy("source_start").collect()
    assert [(r.source_start, r.source_end, r.output_start) for r in got] == [(10000, 13000, 0), (15000, 20000, 3000)]


def test_interval_join_pairs_once(spark):
    left = spark.createDataFrame([(1, 1, 0, 300000)], "id bigint, k bigint, a bigint, b bigint")
    right = spark.createDataFrame([(1, 10, 250000), (1, 299999, 400000), (1, 300000, 400000)], "k bigint, c bigint, d bigint")
    got = intervals.interval_join(left, right, ["k"], ("a", "b"), ("c", "d")).collect()
    assert sorted(r.c for r in got) == [10, 299999]


def test_yield_caps_and_floor(spark):
    def ranked(scores):
        rows = [("s", i, i + 1, i * 10000, i * 10000 + 8000, i * 10000 + 4000, h, 80, 80, 80, 80, 80, None, 0.0) for i, h in enumerate(scores)]
        return spark.createDataFrame(
            rows, "source_hash string, short_id bigint, rank int, start_ms bigint, end_ms bigint, event_ms bigint, highlight int,"
            " editability int, clarity int, context int, confidence int, worthiness int, decision string, duplicate_score double")

    scores = [90, 88, 87, 86, 85, 84, 83, 82, 80, 79, 50, 40]
    assert dedup.qualified_yield(ranked(scores)).count() == 10
    assert dedup.qualified_yield(ranked(scores), limit=6).count() == 6
    assert dedup.qualified_yield(ranked([30] * 12)).count() == 0


def test_chunks(spark):
    got = transcript.chunk_plan(spark.createDataFrame([(1, 900000)], "source_id bigint, duration_ms bigint")).orderBy("chunk_index").collect()
    assert [(r.core_start, r.core_end, r.chunk_start, r.chunk_end) for r in got] == [(0, 480000, 0, 481000), (480000, 900000, 479000, 900000)]


def test_slot_instants(spark):
    cases = [
        ("2026-09-18", "12:00", "Africa/Accra", "2026-09-18 12:00:00"), ("2026-03-07", "12:00", "America/New_York", "2026-03-07 17:00:00"),
        ("2026-03-09", "12:00", "America/New_York", "2026-03-09 16:00:00"), ("2026-09-18", "12:00", "Asia/Kathmandu", "2026-09-18 06:15:00"),
        ("2026-03-08", "02:30", "America/New_York", None), ("2026-11-01", "01:30", "America/New_York", None),
    ]
    df = spark.createDataFrame(cases, "d string, t string, z string, want string")
    for r in df.select("want", F.date_format(times.slot_instant(F.col("d").cast("date"), F.col("t"), F.col("z")), "yyyy-MM-dd HH:mm:ss").alias("got")).collect():
        assert r.got == r.want


def test_shift_and_valid_date(spark):
    assert one(spark, F.date_add(F.lit("2026-01-01").cast("date"), -1)) == dt.date(2025, 12, 31)
    assert one(spark, times.valid_date(F.lit("2026-02-30"))) is False


def test_tracking_gate(spark):
    rows = spark.createDataFrame(
        [("TRACKED_CROP", 0.9, 0.01, 0.0, 5, 1.7), ("TRACKED_CROP", 0.5, 0.01, 0.0, 5, 2.2), ("STACKED", None, None, None, None, 1.7)],
        "requested_crop string, track_confidence double, jitter double, missing_ratio double, points int, aspect double")
    assert [r.crop for r in timeline.tracking_crop(rows).collect()] == ["TRACKED_CROP", "BLURRED_BACKGROUND", "STACKED"]


def test_tone_ties_keep_order(spark):
    df = spark.createDataFrame([(5, 5, 1)], "humor int, tension int, skill int")
    assert df.select(planning.tone_argmax(["humor", "tension", "skill"]).alias("t")).first().t == "humor"


def test_append_once_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/snapshots"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "report_key string, views bigint")
    ingest.append_once(rows, path, "report_key")
    ingest.append_once(rows.union(spark.createDataFrame([("c", 3)], rows.schema)), path, "report_key")
    assert sorted(r.report_key for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_bounds_and_verdicts_keep_nulls(spark):
    null = F.lit(None).cast("double")
    assert one(spark, numeric.bounded(null)) is None and one(spark, numeric.bounded(F.lit(120.0))) == 100.0
    assert one(spark, numeric.logprob_confidence(null)) is None
    assert one(spark, numeric.recommendation_delta(null)) is None
    parts = numeric.score_components(F.lit(10.0), null, null, null, null, F.lit(24))
    assert {k: one(spark, v) for k, v in parts.items()}["retention"] == 0.0
    assert one(spark, numeric.deterministic_arm(F.lit("e1:s1"), null)) == "CONTROL"
    score, duplicate = dedup.evaluate_duplicate(F.lit(None).cast("boolean"), null, null, null, null, null, F.lit(None).cast("boolean"))
    assert (one(spark, score), one(spark, duplicate)) == (0.0, False)
    assert one(spark, evidence.overlap_ms(F.lit(1), F.lit(None).cast("int"), F.lit(0), F.lit(9))) is None


def test_readable_event_raises_word_starts_and_keeps_length(spark):
    assert one(spark, text.readable_event(F.lit("FC_goal_(big)_o'neil"))) == "Goal (Big) O'Neil"
    assert len(one(spark, text.readable_event(F.lit("x" * 1500)))) == 1500


def test_left_interval_join_keeps_null_rows_once(spark):
    left = spark.createDataFrame([(1, 0, 10, None), (1, 20, 30, "n"), (1, 20, 30, "n"), (2, 0, 5, None)], "k int, a int, b int, note string")
    right = spark.createDataFrame([(1, 5, 8), (1, 9, 25)], "k int, c int, d int")
    got = sorted(intervals.interval_join(left, right, ["k"], ("a", "b"), ("c", "d"), how="left").collect(), key=str)
    want = [(1, 0, 10, None, 5, 8), (1, 0, 10, None, 9, 25), (1, 20, 30, "n", 9, 25), (1, 20, 30, "n", 9, 25), (2, 0, 5, None, None, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_evidence_objects_tell_json_types(spark):
    body = F.lit('{"objects": ["goal", 7, "7", null, {"a": 1}]}')
    assert one(spark, planning.evidence_objects(body)) == ["goal", "7"]
    assert one(spark, planning.evidence_objects(F.lit('{"note": 1}'))) is None


def test_batch_scores_take_a_user_function_or_the_heuristic(spark):
    items = spark.createDataFrame([(1, 50.0, ["AUDIO_PEAK"]), (2, 100.0, [])], "short_id bigint, signal_score double, kinds array<string>")
    own = health.batch_scores(items, lambda rows: rows[["short_id"]].assign(highlight=rows["signal_score"] / 2), "short_id long, highlight double")
    assert sorted((r.short_id, r.highlight) for r in own.collect()) == [(1, 25.0), (2, 50.0)]
    assert [(r.highlight, r.emotional) for r in health.batch_scores(items).orderBy("short_id").collect()] == [(54, 62), (90, 80)]
