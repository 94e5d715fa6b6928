"""Owner-wide duplicates, long stretches, bucketed state, part integrity and admission against plain versions."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from cliploom.operators import dedup, events, health
from cliploom.sources import ingest
from cliploom.sources.bucketed import BucketedTable
from cliploom.streaming import pipelines

ITEM = (
    "short_id bigint, owner_id bigint, source_hash string, start_ms bigint, end_ms bigint, event_key string, game string, "
    "frames array<string>, label_t array<string>, text_t array<string>, rank int"
)


def item(i, source, frames, labels, text, owner=1, rank=1, start=0, game="g", event=None):
    return (i, owner, source, start, start + 10_000, event, game, frames, labels, text, rank)


def test_stronger_match_of_another_source_clears_an_item(spark):
    a, far = "0" * 16, "f" * 16
    words = [f"w{k}" for k in range(10)]
    candidate = item(1, "s", [a], ["goal"], words)
    # same source: a clear overlap and equal frames are a duplicate, though its score is low
    twin = item(2, "s", [a], ["other"], ["x"], start=2000, game="h")
    rival = item(3, "t", [a], ["goal"], words)  # another source, far more alike, but never a duplicate
    make = lambda rows: spark.createDataFrame(rows, ITEM)
    alone = dedup.persistent_dedup(make([candidate]), make([twin]).drop("rank")).first()
    assert alone.duplicate and alone.matched_id == 2 and alone.score < 0.56
    both = dedup.persistent_dedup(make([candidate]), make([twin, rival, item(4, "t", [far], ["no"], [], owner=2)]).drop("rank")).first()
    assert not both.duplicate and both.matched_id == 3 and abs(both.score - 0.56) < 1e-9
    # of equals the least id, also across blocks
    tied = dedup.persistent_dedup(make([candidate]), make([rival, item(0, "u", [a], ["goal"], words)]).drop("rank")).first()
    assert tied.matched_id == 0


def test_strongest_elsewhere_equals_all_pairs(spark):
    rng = random.Random(4)
    frame = lambda: rng.choice(["%016x" % rng.getrandbits(64), "%016x" % (rng.getrandbits(2)), "bad"])
    some = lambda names, n: sorted(rng.sample(names, rng.randint(0, n)))
    rows = [item(
        i, rng.choice(["s", "t", "u", None]), [frame() for _ in range(rng.randint(0, 4))] if i % 9 else None, some(list("abcdef"), 4), some(list("klmnopq"), 6),
        owner=rng.choice([1, 2]), game=rng.choice(["x", "X", "y", None]), event=rng.choice(["e1", "e2", None, None]),
    ) for i in range(120)]
    df = spark.createDataFrame(rows, ITEM)
    mine, prior = df.filter("short_id % 3 = 0"), df.filter("short_id % 3 > 0")
    pairs = dedup._pair_verdicts(dedup._side(mine, "a").join(
        dedup._side(prior, "b"), F.expr("a_owner_id = b_owner_id and not coalesce(a_source_hash = b_source_hash, false)")))
    want = {}
    for r in pairs.collect():
        key = (-r.score, r.b_short_id)
        want[r.a_short_id] = min(want.get(r.a_short_id, key), key)
    for blocks in ((2048, 8192), (7, 5)):
        got = {r.a_short_id: r.b_short_id for r in dedup.strongest_elsewhere(mine, prior, blocks).collect()}
        assert got == {a: key[1] for a, key in want.items()}


def test_clusters_of_one_endless_stretch_equal_the_plain_fold(spark):
    """200 000 signals of one source without a silence, types and gaps mixed."""
    kinds = F.array(*[F.lit(k) for k in events.EVENT_TYPES])
    evidence = spark.range(200_000).select(
        F.lit(1).cast("bigint").alias("source_id"), F.col("id").alias("signal_id"), (F.col("id") * 700 + F.pmod(F.xxhash64("id"), F.lit(600))).alias("t_ms"),
        F.lit("AUDIO_PEAK").alias("kind"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90)) + 1).cast("double").alias("value"),
        F.get(kinds, F.pmod(F.xxhash64(F.floor(F.col("id") / 3), F.lit(2)), F.lit(2)).cast("int")).alias("event_type"),
        ((F.pmod(F.xxhash64("id", F.lit(3)), F.lit(90)) + 10) / 100).alias("confidence"))
    sources = spark.createDataFrame([(1, "shooter arena", 0.9)], "source_id bigint, game string, game_confidence double")
    got = events.event_clusters(evidence, sources).orderBy("cluster_no").select("cluster_no", "start_ms", "end_ms", "signal_count", "event_type").collect()
    rows = evidence.select("t_ms", "event_type", events.clustering_profile(
        F.lit("shooter arena"), "event_type", F.least(F.lit(0.9), "confidence")).alias("p")).orderBy("t_ms", "signal_id").collect()
    want = []
    for r in rows:
        gap = r.p.gap_ms
        last = want[-1] if want else None
        if last and (last[3] == r.event_type or "ACTIVITY" in last[3] or "ACTIVITY" in r.event_type) and r.t_ms - last[1] <= max(last[4], gap):
            last[1], last[2], last[4] = r.t_ms, last[2] + 1, max(last[4], gap)
        else:
            want.append([r.t_ms, r.t_ms, 1, r.event_type, gap])
    assert len(want) > 100
    assert [tuple(r) for r in got] == [(i + 1, w[0], w[1], w[2], w[3]) for i, w in enumerate(want)]


def written(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_bucketed_table_rewrites_touched_buckets_only(spark, tmp_path):
    path = tmp_path / "table"
    rows = spark.range(1000).selectExpr("id AS k", "id AS v", "0 AS at")
    table = ingest.upsert_table(rows, str(path), ["k"], "at")
    first = written(path / "data")
    ingest.upsert_table(spark.createDataFrame([(5, 50, 1), (5, 51, 2), (2000, 1, 0)], "k bigint, v bigint, at int"), str(path), ["k"], "at")
    again = written(path / "data")
    assert all(again[p] == t for p, t in first.items()) and len(again) - len(first) <= 2
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {**{k: k for k in range(1000)}, 5: 51, 2000: 1}
    for n in range(3):  # a repeated batch overwrites itself, and old versions go
        table.merge(spark.createDataFrame([(5, 60 + n, 9, 1)], "k bigint, v bigint, at int, __new int"), lambda r: r.groupBy("k").agg(
            F.max_by("v", F.struct("at", "v")).alias("v"), F.max("at").alias("at"), F.lit(0).alias("__new")), version=7)
    assert {r.k: r.v for r in table.read().collect()}[5] == 62 and table.read().count() == 1001
    assert len(list((path / "pointer").glob("version=*"))) <= 2


def test_append_once_leaves_other_files_alone(spark, tmp_path):
    path = tmp_path / "log"
    rows = spark.range(500).selectExpr("cast(id AS string) AS k", "id AS v")
    ingest.append_once(rows, str(path), "k")
    before = written(path)
    ingest.append_once(spark.createDataFrame([("5", 9), ("x", 2), ("x", 1)], "k string, v bigint"), str(path), "k")
    after = written(path)
    assert all(after[p] == t for p, t in before.items()) and len(after) - len(before) == 1
    assert {r.k: r.v for r in spark.read.parquet(str(path)).collect()} == {**{str(k): k for k in range(500)}, "x": 1}


def beats(spark, folder, batches):
    schema = "job_id bigint, source_id bigint, ts timestamp, gap int"
    for n, rows in batches:
        spark.createDataFrame(rows, "job_id bigint, s bigint, gap int").selectExpr(
            "job_id", "job_id AS source_id", "timestamp_seconds(1704067200 + s) AS ts", "gap").coalesce(1).write.parquet(f"{folder}/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_stream_sessions_and_stale_jobs_after_batches_and_a_restart(spark, tmp_path):
    now = F.timestamp_seconds(F.lit(1704067200 + 100_000))
    stream = beats(spark, tmp_path / "in", [(0, [(1, 0, 10), (1, 100, 10), (2, 0, 10)]), (1, [(1, 9000, 10), (2, 50, 10)])])
    seen = lambda df: {(r.job_id, r.beats, r.state) for r in df.collect()}
    got = pipelines.stale_jobs(stream, f"{tmp_path}/stale", "1 hour", now)
    assert seen(got) == {(1, 2, "RESOLVED"), (1, 1, "ACTIVE"), (2, 2, "ACTIVE")}
    # started again: a late beat bridges the silence of job 1, job 2 speaks again
    stream = beats(spark, tmp_path / "in", [(2, [(1, 3600, 10), (1, 6000, 10), (2, 90_000, 10)]), (3, [(3, 99_000, 10), (1, 100, 10)])])
    got = pipelines.stale_jobs(stream, f"{tmp_path}/stale", "1 hour", now)
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    assert seen(got) == {(1, 6, "ACTIVE"), (2, 2, "RESOLVED"), (2, 1, "ACTIVE")}
    resolved = got.filter("state = 'RESOLVED'").first()
    assert resolved.resolved_at.timestamp() - resolved.last_beat.timestamp() == 90_000 - 50
    sessions = pipelines.gap_sessions(stream, f"{tmp_path}/sessions", "1 hour")
    plain = rows.groupBy("source_id", F.session_window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("peaks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")
    assert sorted(map(tuple, sessions.collect())) == sorted(map(tuple, plain.collect()))


def test_sessions_with_a_gap_of_each_row(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(3), rng.randrange(400_000), rng.choice([5, 500, 20_000])) for _ in range(120)]
    stream = beats(spark, tmp_path / "in", [(n, rows[n::4]) for n in range(4)])
    got = pipelines.gap_sessions(stream, f"{tmp_path}/work", F.col("gap"))
    want, by = [], defaultdict(list)
    for job, s, gap in rows:
        by[job].append((s, s + gap))
    for job, spans in by.items():
        open_ = None
        for s, close in sorted(spans):
            if open_ and s < open_[2]:
                open_ = [open_[0], s, max(open_[2], close), open_[3] + 1]
                want[-1] = (job, open_[3], open_[0], open_[1])
            else:
                open_ = [s, s, close, 1]
                want.append((job, 1, s, s))
    base = 1704067200
    assert sorted((r.source_id, r.peaks, int(r.first_ts.timestamp()) - base, int(r.last_ts.timestamp()) - base) for r in got.collect()) == sorted(want)


def test_parts_in_files_are_checked_by_content(spark, tmp_path):
    import hashlib

    files, uploads, manifest = {}, [], []
    for u in range(6):
        body = bytes([u]) * 25
        uploads.append((u, 25, 10))
        for n in range(3):
            files[u, n] = body[n * 10 : n * 10 + 10]
            manifest.append((u, n, len(files[u, n]), hashlib.sha256(files[u, n]).hexdigest()))
    files[1, 1] = b"x" * 10  # other content
    files[2, 2] = files[2, 2] + b"x"  # longer
    del files[3, 0]  # not stored
    manifest = [m for m in manifest if m[:2] != (4, 2)] + [m for m in manifest if m[:2] == (4, 0)]  # 0, 0, 1
    manifest = [m for m in manifest if m[:2] != (5, 1)]
    for (u, n), content in files.items():
        (tmp_path / str(u)).mkdir(exist_ok=True)
        (tmp_path / str(u) / f"{n}.part").write_bytes(content)
    out = ingest.part_manifest_check(
        spark.createDataFrame(uploads + [(9, 0, 10)], "upload_id bigint, total_bytes bigint, chunk_bytes bigint"),
        spark.createDataFrame(manifest, "upload_id bigint, part_no bigint, part_bytes bigint, sha256 string"), ingest.stored_parts(spark, str(tmp_path)))
    got = {r.upload_id: (r.missing, r.repeated, r.corrupt, r.code, r.complete) for r in out.collect()}
    assert got == {
        0: (0, 0, 0, None, True), 1: (0, 0, 1, "CORRUPT_PART", False), 2: (0, 0, 1, "CORRUPT_PART", False), 3: (0, 0, 1, "CORRUPT_PART", False),
        4: (1, 1, 0, "MISSING_PARTS", False), 5: (1, 0, 0, "MISSING_PARTS", False), 9: (0, 0, 0, None, True),
    }


def test_refused_requests_spend_nothing(spark):
    ledger = spark.createDataFrame(
        [(1, 1, 12.0, None, "COMPLETED"), (1, 1, 3.0, None, "FAILED")], "source_id bigint, short_id bigint, estimate_usd double, actual_usd double, status string")
    asked = spark.createDataFrame([(1, s, n, c) for n, (s, c) in enumerate([(2, 4.0), (3, 4.0), (4, 1.0), (5, 0.5), (2, 0.0), (2, 0.0)])],
                                  "source_id bigint, short_id bigint, request_no int, estimate_usd double")
    got = health.budget_ledger(ledger, asked, 5.0, 17.0, 2).orderBy("request_no").collect()
    assert [r.admitted for r in got] == [True, False, True, False, True, False]
    assert got[-1].batch_spent == 17.0 and got[1].code == "OVER_BUDGET"
    many = spark.range(100_000).selectExpr("7L AS source_id", "id % 50000 AS short_id", "cast(id AS int) AS request_no", "0.01 AS estimate_usd")
    out = health.budget_ledger(ledger, many, 0.01, 400.0, 9)
    assert out.count() == 100_000 and out.filter("admitted").count() == 40_000
