"""Hot keys, copies and plan shape."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from cliploom.operators import scans, series, similarity
from cliploom.streaming import pipelines

SF = "/root/testdata/sf0.001"


def test_bucketed_scan_equals_plain_window(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), (F.col("id") * 37 % 5003).alias("t"), "id")
    df.createOrReplaceTempView("scan_rows")
    plain = spark.sql("""SELECT id, lag(t) OVER w AS p, lead(t) OVER w AS n, count(*) OVER (PARTITION BY k ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS c
        FROM scan_rows WINDOW w AS (PARTITION BY k ORDER BY t, id)""")
    near = scans.neighbours(df, ["k"], ["t", "id"], ["t"], 100)
    got = scans.running(near, ["k"], ["t", "id"], F.lit(1).cast("bigint"), "c", 100).select("id", F.col("prev_t").alias("p"), F.col("next_t").alias("n"), "c")
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_signal_cap_is_exact_for_a_hot_source(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") < 12000, 1).otherwise(F.col("id") % 50 + 2).alias("source_id"), F.col("id").alias("signal_id"), (F.col("id") * 7 % 90000).alias("t_ms"))
    got = series.signal_cap(df, 1000)
    counts = {r.source_id: r["count"] for r in got.groupBy("source_id").count().collect()}
    assert counts[1] == 1000 and max(counts.values()) == 1000


def pool(spark, copies):
    base = spark.range(copies).select(
        F.col("id").alias("short_id"), F.lit(1).cast("bigint").alias("owner_id"), F.array(F.lit("a" * 16), F.lit("b" * 16)).alias("frames"),
        F.array(F.lit(1).cast("bigint")).alias("concept_t"), F.lit(None).cast("bigint").alias("vec_id"),
        F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("int").alias("model"), F.lit(None).cast("double").alias("norm"))
    return base


def test_copies_are_linked_once_not_pairwise(spark):
    pairs = similarity.visual_pairs(pool(spark, 2000))
    assert pairs.count() == 1999


def test_near_visual_pairs_match_brute_force(spark):
    import random

    random.seed(5)
    def flip(h, n):
        v = int(h, 16)
        for bit in random.sample(range(64), n):
            v ^= 1 << bit
        return f"{v:016x}"

    rows = []
    for _ in range(40):
        frames = [f"{random.getrandbits(64):016x}" for _ in range(3)]
        rows.append(frames)
        rows.append([flip(f, random.choice([0, 1, 2, 3])) for f in frames])
    schema = "short_id bigint, owner_id bigint, frames array<string>, concept_t array<bigint>, vec_id bigint, v array<double>, model int, norm double"
    df = spark.createDataFrame([(i, 1, f, [1, i], None, [1.0], 0, 1.0) for i, f in enumerate(rows)], schema)
    def similar(a, b):
        return sum(1 - bin(int(x, 16) ^ int(y, 16)).count("1") / 64 for x, y in zip(a, b)) / 3

    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if similar(rows[i], rows[j]) >= 0.97}
    got = {(r.a_short_id, r.b_short_id) for r in similarity.visual_pairs(df).collect()}
    assert got == want and want


def test_frame_lists_of_any_length_match_brute_force(spark):
    rng = random.Random(9)

    def flip(h, bits):
        value = int(h, 16)
        for bit in rng.sample(range(64), bits):
            value ^= 1 << bit
        return f"{value:016x}"

    rows = []
    for _ in range(60):
        base = [f"{rng.getrandbits(64):016x}" for _ in range(4)]
        for n in rng.choices(range(5), k=5):
            frames = [flip(base[min(i, 1)] if rng.random() < 0.5 else base[i], rng.choice([0, 0, 1, 2, 3])) for i in range(n)]
            rows.append(frames)
            if rng.random() < 0.3:
                rows.append([*frames, frames[-1]] if frames else [])
    rows += rng.sample(rows, 40)
    rows = [(i, 1, f, [1], None, None, None, None, None, None, None) for i, f in enumerate(rows)]
    schema = ("short_id bigint, owner_id bigint, frames array<string>, concept_t array<bigint>, vec_id bigint, v array<double>, model int, "
              "norm double, reuse_kind string, reuse_of_id bigint, reuse_reason string")
    df = spark.createDataFrame(rows, schema)

    def near(x, y):
        return bool(x and y) and sum(
            bin(int(f, 16) ^ int(y[min(i, len(y) - 1)], 16)).count("1") for i, f in enumerate(x)) <= 0.03 * 64 * len(x) + 1e-9

    frames = [r[2] for r in rows]
    first = {}
    for i, f in enumerate(frames):
        first.setdefault(tuple(f), i)
    want = {(a, b) for a in first.values() for b in first.values() if a < b and near(frames[a], frames[b])}
    assert any(len(frames[a]) != len(frames[b]) for a, b in want)
    got = {(r.a_short_id, r.b_short_id) for r in similarity.visual_pairs(df).collect()}
    stars = {(first[tuple(f)], i) for i, f in enumerate(frames) if first[tuple(f)] != i}
    assert want | stars <= got
    assert all(a < b and near(frames[a], frames[b]) for a, b in got - stars)
    group = lambda i: first[tuple(frames[i])]
    every = {(group(a), group(b)) for a in range(len(rows)) for b in range(a + 1, len(rows)) if near(frames[a], frames[b])}
    assert {frozenset(p) for p in every if len(set(p)) == 2} == {frozenset(map(group, p)) for p in got - stars}

    pool, history = df.filter("short_id % 3 > 0"), df.filter("short_id % 3 = 0")
    wide = [F.lit(None).cast(kind).alias(name) for name, kind in (
        ("source_hash", "string"), ("start_ms", "bigint"), ("end_ms", "bigint"), ("event_ms", "bigint"), ("render_hash", "string"))]
    hit = {r.short_id for r in similarity.history_conflicts(pool.select("*", *wide), history.select("*", *wide)).collect()}
    assert hit == {a for a in range(len(rows)) if a % 3 and any(near(frames[a], frames[b]) for b in range(0, len(rows), 3))}


def test_no_cartesian_in_headline_plans(spark):
    for name in ["activity_totals", "revenue_attribution", "horizon_outcomes", "pairwise_similarity", "interval_overlap_join", "segment_lift"]:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "Python" not in plan, name


def test_scan_is_pruned(spark):
    plan = entry.queries()["hook_type"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_stream_over_many_files_equals_batch(spark, tmp_path):
    rows = spark.range(3000).select(
        (F.col("id") % 5).alias("owner_id"), (F.col("id") % 11).alias("video_id"), F.timestamp_seconds(1704067200 + F.col("id") * 60).alias("collected_at"),
        F.to_date(F.timestamp_seconds(1704067200 + F.col("id") * 60)).alias("report_date"), F.col("id").alias("observation_id"), (F.col("id") * 3).alias("views"))
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    keys = ["owner_id", "video_id", "report_date"]
    got = pipelines.latest_totals(stream, f"{tmp_path}/work", keys).select(*keys, "views")
    want = rows.groupBy(*keys).agg(F.max("views").alias("views"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def late_files(spark, folder):
    """Rows in six files, the last of which holds rows far older than the watermark, and a repeat of an early row."""
    rows = spark.range(1500).select(
        (F.col("id") % 3).alias("owner_id"), (F.col("id") % 7).alias("video_id"), (F.col("id") % 4).alias("source_id"),
        F.timestamp_seconds(1704067200 + F.col("id") * 3000).alias("ts"), F.col("id").alias("views"))
    for n in range(5):
        rows.filter(f"views div 300 = {n} and views % 100 <> 7").coalesce(1).write.parquet(f"{folder}/in/{n}")
    rows.filter("views % 100 = 7 or views = 3").coalesce(1).write.parquet(f"{folder}/in/5")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    return stream, spark.read.option("recursiveFileLookup", True).schema(rows.schema).parquet(f"{folder}/in")


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_streams_keep_late_rows_and_open_windows(spark, tmp_path):
    stream, rows = late_files(spark, tmp_path)
    got = pipelines.daily_activity(stream, f"{tmp_path}/days")
    want = rows.groupBy("owner_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("observations"), F.sum("views").alias("views"))
    assert same(got, want)
    stream, rows = late_files(spark, tmp_path / "b")
    sessions = pipelines.gap_sessions(stream, f"{tmp_path}/sessions", "2 hours")
    assert sessions.agg(F.sum("peaks")).first()[0] == rows.count()
    plain = rows.groupBy("source_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("peaks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    assert same(sessions, plain.select("source_id", "peaks", "first_ts", "last_ts"))
    stream, rows = late_files(spark, tmp_path / "c")
    dated = lambda df: df.withColumn("report_date", F.to_date("ts"))
    keys = pipelines.snapshot_ingest(dated(stream), f"{tmp_path}/snap").select("report_key")
    assert same(keys, pipelines.with_report_key(dated(rows)).select("report_key").distinct())


def test_clusters_of_a_hot_source_need_no_cap(spark):
    """More than 10 000 signals of one source: every one of them is in a cluster, and clusters equal the plain fold."""
    from cliploom.operators import events

    evidence = spark.range(12000).select(
        F.lit(1).cast("bigint").alias("source_id"), F.col("id").alias("signal_id"),
        (F.col("id") * 5000 + F.when(F.col("id") % 7 == 0, 4000).otherwise(0)).alias("t_ms"), F.lit("AUDIO_PEAK").alias("kind"),
        F.lit(50.0).alias("value"), F.lit("AUDIO_REACTION").alias("event_type"), F.lit(0.5).alias("confidence"))
    sources = spark.createDataFrame([(1, "none", 0.9)], "source_id bigint, game string, game_confidence double")
    got = events.event_clusters(evidence, sources).orderBy("cluster_no").collect()
    assert sum(r.signal_count for r in got) == 12000
    gap = evidence.select(events.clustering_profile(F.lit("none"), "event_type", F.lit(0.5)).alias("p")).first().p.gap_ms
    times, want = [r.t_ms for r in evidence.orderBy("t_ms").collect()], []
    for t in times:
        if want and t - want[-1][-1] <= gap:
            want[-1].append(t)
        else:
            want.append([t])
    assert [(r.start_ms, r.end_ms, r.signal_count) for r in got] == [(w[0], w[-1], len(w)) for w in want]
