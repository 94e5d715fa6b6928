"""Queries take whole tables and shared steps stay whole at size."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from cliploom.functions import times
from cliploom.operators import learning, similarity
from cliploom.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_expired_sessions_take_every_part(spark):
    parts = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_orderkey").alias("upload_id")).distinct()
    complete = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("upload_id")).filter("upload_id % 4 = 2")
    left = {r[0] for r in complete.join(parts, "upload_id").collect()}
    told = entry.queries()["expired_sessions"](spark, SF).filter("state = 'COMPLETE'")
    assert {r.upload_id for r in told.collect()} == left
    assert any(i % 5 == 0 for i in left)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_winsorizing_does_not_deal_records_by_group(spark):
    records = spark.range(3000).selectExpr(
        "id AS short_id", "id % 2 AS owner_id", "cast(id % 100 AS double) AS performance_score")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = learning.winsorize(records, ["owner_id"])
        assert "BroadcastHashJoin" in plan(held) and "hashpartitioning" not in plan(held)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {(r.owner_id, r.records, r.low, r.high) for r in held.collect()}
    assert got == {(0, 1500, 4.0, 94.0), (1, 1500, 5.0, 95.0)}


def test_slot_instants_around_clock_changes(spark):
    """Against every quarter hour mapped back, which the operator need not try."""
    zones = ["America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu", "Africa/Casablanca", "Pacific/Apia", "+05:30", "Europe/Dublin"]
    days = ["2011-12-29", "2011-12-30", "2011-12-31", "2024-03-10", "2024-03-31", "2024-04-07", "2024-10-06", "2024-10-27", "2024-11-03", "2024-04-14"]
    rows = spark.createDataFrame([(d, z) for d in days for z in zones], "day string, zone string").selectExpr(
        "cast(day AS date) AS day", "zone", "explode(sequence(0, 95)) AS q").selectExpr(
        "day", "zone", "printf('%02d:%02d', q div 4, q % 4 * 15) AS at")
    said = rows.select("*", times.slot_instant("day", F.col("at"), F.col("zone")).alias("said"))
    wanted = F.to_timestamp(F.concat(F.col("day").cast("string"), F.lit(" "), "at"), "yyyy-MM-dd HH:mm")
    tried = said.withColumn("wanted", wanted).withColumn("m", F.explode(F.sequence(F.lit(-12), F.lit(12)))).withColumn(
        "m", F.timestamp_micros(F.unix_micros(F.to_utc_timestamp("wanted", F.col("zone"))) + F.col("m").cast("bigint") * 900_000_000))
    hits = tried.groupBy("day", "zone", "at", "said").agg(
        F.collect_list(F.when(F.from_utc_timestamp("m", F.col("zone")) == F.col("wanted"), F.col("m"))).alias("hits"))
    want = F.when(F.size("hits") == 1, F.get("hits", F.lit(0)))
    assert hits.filter(~want.eqNullSafe(F.col("said"))).count() == 0
    assert hits.filter("said is null").count() > 0 and hits.count() == len(days) * len(zones) * 96
    assert "lambda" not in plan(said)


def test_bands_of_the_conflict_search_are_slim(spark):
    tables = Tables(spark, SF)
    ready = similarity.comparable(tables.pool, tables.vector)
    found = similarity.history_conflicts(ready.filter("short_id % 5 <> 0"), ready.filter("short_id % 5 = 0"))
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    exploded = [line for line in lines if "Generate explode" in line and "band" in line]
    assert exploded and not [line for line in exploded if any(w in line.split("], [band")[0] for w in ("concept_t", "norm", "reuse"))]
    wide = [line for line in lines if "band" in line and "concept_t" in line]
    assert not wide


def test_items_without_a_vector_spread(spark):
    items = spark.range(400).selectExpr(
        "id AS short_id", "CASE WHEN id % 2 = 0 THEN id % 10 END AS vec_id", "'a' AS h0", "'b' AS h1", "'t' AS hook", "'t' AS title",
        "'c' AS concept", "'e' AS event_type", "'x' AS transcript", "'o' AS objects")
    vectors = spark.range(10).selectExpr("id AS vec_id", "1 AS model", "array(1.0D) AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = similarity.comparable(items, vectors)
        sizes = [len(p) for p in joined.filter("vec_id is null").rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 200 and max(sizes) < 100
    assert joined.filter("v is not null").count() == 200
