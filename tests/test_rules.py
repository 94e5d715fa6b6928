"""Policies as rows against the compiled constants, and table functions against their operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from cliploom.functions import rules, table_functions
from cliploom.functions.text import identify_game
from cliploom.functions.times import slot_instant
from cliploom.operators import events
from cliploom.sources.tables import FILENAMES

GAMES = ["EA Sports FC", "FIFA 23", "Call of Duty: Warzone", "Grand Theft Auto V", "Fortnite", "Minecraft", "", None]
TYPES = ["SCENE_TRANSITION", "single kill", "GOAL sequence", "save", "chase", "clutch", "", None]


def test_published_rows_equal_the_constants(spark):
    sure = [0.0, 0.55, 0.6, 0.62, 0.65, 1.0, None]
    rows = spark.createDataFrame([(g, t, c) for g in GAMES for t in TYPES for c in sure], "game string, type string, sure double")
    by_table = rules.clustering_of(F.col("game"), F.col("type"), F.col("sure"), rules.clustering_rules(spark))
    both = rows.select("*", by_table.alias("a"), events.clustering_profile("game", "type", "sure").alias("b")).collect()
    assert len(both) == len(rows.collect()) and all(r["a"] == r["b"] for r in both)
    names = spark.createDataFrame([(n,) for n in [*FILENAMES, "", "CALL-OF_duty.mp4", None]], "name string")
    found = names.select("name", rules.game_of(F.col("name"), rules.game_rules(spark)).alias("a"), identify_game("name").alias("b"))
    for r in found.collect():
        assert (r["a"]["game"] if r["a"] else "Unknown gameplay", r["a"] and r["a"]["edition"]) == (r["b"]["game"], r["b"]["edition"])


def test_detector_rows_equal_the_constants(spark):
    kinds = [[], ["SCENE_CHANGE"], ["MOTION_PEAK"], ["AUDIO_PEAK", "MOTION_PEAK"], ["SCENE_CHANGE", "AUDIO_PEAK"], ["MOTION_PEAK", "SCENE_CHANGE"]]
    rows = spark.createDataFrame(
        [(g, c, k, "ACTIVITY_BURST", 1, 10) for g in GAMES for c in (0.5, 0.55, 0.9) for k in kinds],
        "game string, sure double, kinds array<string>, event_type string, signal_count long, weight_sum long",
    ).withColumn("profile", events.detector_profile("game", "sure"))
    table = rules.detected_type(F.col("game"), F.col("sure"), F.col("kinds"), rules.detector_rules(spark))
    for r in events.profile_classify(rows.withColumn("d", table)).collect():
        assert (r["d"]["event_type"] if r["d"] else "ACTIVITY_BURST") == r["event_type"]
        assert (r["d"]["profile"] if r["d"] else "generic-gameplay-v1") == r["profile"]


def test_a_row_changes_the_policy(spark):
    row = spark.createDataFrame([("Minecraft", "chase", 0.7)], "game string, type string, sure double")
    fit = lambda table: row.select(
        rules.clustering_of(F.col("game"), F.col("type"), F.col("sure"), table).alias("p")).first()["p"]
    table = rules.clustering_rules(spark)
    assert fit(table)["policy_id"] == "generic-v1"
    own = spark.createDataFrame([(2.5, "own", "minecraft", None, 900, 0.7)], rules.CLUSTERING)
    assert tuple(fit(table.union(own))) == ("own", 900)
    assert tuple(fit(own.union(table))) == ("own", 900)
    assert fit(table.limit(0)) is None
    with pytest.raises(ValueError):
        fit(spark.range(rules.MAX_RULES + 1).selectExpr("double(id) ordinal", "'x' policy_id", "'x' game_re", "'x' event_re", "1 gap_ms", "0D minimum"))


def test_rules_move_no_rows(spark):
    rows = spark.range(10).selectExpr("concat('f', id) name")
    plan = rows.select(rules.game_of(F.col("name"), rules.game_rules(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_table_functions_by_name(spark):
    table_functions.register(spark)
    clips = [(n, 1000 * n, 1000 * n + 700 * (n % 90), 1000 * n + 700 * (n % 90) + 300 * (n % 7)) for n in range(200)]
    frame = spark.createDataFrame(clips, "id long, start_ms long, event_ms long, end_ms long")
    for most in (1, 9, 18, 24, 99):
        named = spark.sql(f"SELECT id, sample_ms FROM adaptive_samples(TABLE(SELECT * FROM {{clips}}) PARTITION BY (id), {most})", clips=frame)
        direct = events.adaptive_samples(frame, most).select("id", "sample_ms")
        assert sorted(map(tuple, named.collect())) == sorted(map(tuple, direct.collect()))
    none = spark.createDataFrame([(1, None, 5, 9)], frame.schema)
    assert spark.sql("SELECT sample_ms FROM adaptive_samples(TABLE(SELECT * FROM {c}), 9)", c=none).first()[0] is None
    days = [datetime.date(2024, m, d) for m, d in ((3, 10), (3, 31), (11, 3), (6, 1))]
    zones = ["America/New_York", "Europe/London", "Asia/Kathmandu", "Australia/Lord_Howe", None]
    slots = spark.createDataFrame(
        [(d, t, z) for d in days for t in ("01:30", "02:15", "12:00", None) for z in zones], "local_date date, local_time string, zone string")
    named = spark.sql("SELECT * FROM slot_instants(TABLE(SELECT * FROM {slots}) PARTITION BY (local_date, zone))", slots=slots)
    direct = slots.select("*", slot_instant("local_date", F.col("local_time"), F.col("zone")))
    assert sorted(map(repr, map(tuple, named.collect()))) == sorted(map(repr, map(tuple, direct.collect())))
