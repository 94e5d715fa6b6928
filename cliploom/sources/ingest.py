"""Typed parsing, keys, idempotent writes and versioned tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom import config
from cliploom.functions.numeric import col
from cliploom.functions.text import report_key
from cliploom.operators.reporting import first_per_key
from cliploom.operators.scans import neighbours
from cliploom.sources.bucketed import BUCKETS, BucketedTable

RESULT_TABLE = (
    "kind string, columnHeaders array<struct<name:string,columnType:string,dataType:string>>, rows array<array<string>>"
)
SAFE_INTEGER = 9007199254740991
VERSION_BLOCK = 10_000


def parse_result_table(df: DataFrame, text: str = "body") -> DataFrame:
    """One row per report row with ``fields map<name, value>``; rows of the wrong width carry ``bad_width``."""
    doc = F.from_json(col(text), RESULT_TABLE)
    rows = df.withColumn("__doc", doc).withColumn(
        "__row", F.explode(F.coalesce(F.col("__doc.rows"), F.array().cast("array<array<string>>")))
    )
    names = F.transform(F.col("__doc.columnHeaders"), lambda h: h["name"])
    bad = F.size("__row") != F.size(names)
    return (
        rows.withColumn("bad_width", bad)
        .withColumn("fields", F.when(~bad, F.map_from_arrays(names, F.col("__row"))))
        .drop("__doc", "__row", text)
    )


def number_value(value) -> Column:
    """Missing or '' is null, an explicit 0 stays 0."""
    v = F.trim(col(value))
    return F.when(v != "", v.try_cast("double"))


def number_invalid(value) -> Column:
    """Present but not a finite number."""
    v = F.trim(col(value))
    parsed = v.try_cast("double")
    return F.coalesce(
        (v != "") & (parsed.isNull() | F.isnan(parsed) | (F.abs(parsed) == float("inf"))), F.lit(False)
    )


def integer_value(value) -> Column:
    parsed = number_value(value)
    return F.when(~integer_invalid(value), parsed.try_cast("bigint"))


def integer_invalid(value) -> Column:
    """Present but not a non-negative safe integer."""
    parsed = number_value(value)
    bad = number_invalid(value) | (parsed < 0) | (parsed > SAFE_INTEGER) | (parsed != F.floor(parsed))
    return F.coalesce(bad, F.lit(False))


def observation_records(parsed: DataFrame, publications: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Snapshot rows: scope from the video field, publication by video, and the stable report key."""
    f = lambda name: F.col("fields").getItem(name)
    video = f("video")
    counts = ["views", "likes"]
    rows = parsed.filter(~F.col("bad_width") & f("day").isNotNull()).select(
        report_key(run_id, F.lit("activity"), f("day"), F.coalesce(video, F.lit("channel"))).alias("report_key"),
        run_id, "owner_id", F.when(video.isNotNull(), "VIDEO").otherwise("CHANNEL").alias("scope"),
        f("day").alias("report_date"), video.cast("bigint").alias("video_id"),
        *[integer_value(f(name)).alias(name) for name in counts],
        number_value(f("minutes")).alias("watch_minutes"),
    )
    pubs = publications.filter(F.col("video_id").isNotNull()).select("owner_id", "video_id", "publication_id")
    return rows.join(pubs, ["owner_id", "video_id"], "left")


def idempotent_append(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is new, one per key: the least in column order."""
    whole = F.struct(*[F.col(c) for c in incoming.columns])
    fresh = incoming.join(existing.select(key), key, "left_anti").select(*incoming.columns)
    return fresh.groupBy(F.col(key).alias("__key")).agg(F.min(whole).alias("__row")).select("__row.*")


def append_once(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Append to a parquet table, partitioned by ``key_bucket``, the rows whose key it does not hold yet.

    Only the buckets of the incoming keys are read, and no file is rewritten. Rows that come together go by the least in
    column order."""
    rows = df.withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in rows.select("key_bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    try:
        existing = df.sparkSession.read.parquet(path).filter(F.col("key_bucket").isin(touched))
    except AnalysisException:  # the first append finds no table
        existing = rows.limit(0)
    idempotent_append(existing, rows, key).repartition("key_bucket").write.mode("append").partitionBy("key_bucket").parquet(path)


def upsert_table(
    incoming: DataFrame, path: str, keys: list[str], order: str, buckets: int = BUCKETS,
) -> BucketedTable:
    """Upsert into a bucketed table: incoming rows replace rows of their key, the newest by ``order`` wins among them.

    Only the buckets of the incoming keys are read and rewritten; the pointer moves when they are complete."""
    table = BucketedTable(incoming.sparkSession, path, incoming.withColumn("__new", F.lit(0)).schema, keys, buckets)

    def newest(rows: DataFrame) -> DataFrame:
        return first_per_key(rows, keys, [F.col("__new").desc(), F.col(order).desc()]).withColumn("__new", F.lit(0))

    table.merge(incoming.withColumn("__new", F.lit(1)), newest)
    return table


def sync_window_plan(
    connections: DataFrame, publications: DataFrame, runs: DataFrame, today: str, now: Column,
    lookback: int = 90, interval_minutes: int = 360,
) -> DataFrame:
    """Date range to fetch per connection; nothing while a run is active or the last one is fresh."""
    state = runs.groupBy("owner_id").agg(
        F.max(~F.col("state").isin("SUCCEEDED", "FAILED", "CANCELLED")).alias("active"),
        F.max(F.when(F.col("state") == "SUCCEEDED", F.col("finished_at"))).alias("latest"),
    )
    earliest = publications.filter(F.col("video_id").isNotNull()).groupBy("owner_id").agg(
        F.to_date(F.min("publish_at")).alias("earliest")
    )
    day = F.lit(today).cast("date")
    default = F.date_add(day, 1 - lookback)
    fresh_after = now - F.expr(f"INTERVAL {interval_minutes} MINUTES")
    return (
        connections.join(state, "owner_id", "left").join(earliest, "owner_id", "left")
        .filter(~F.coalesce("active", F.lit(False)) & (F.col("latest").isNull() | (F.col("latest") <= fresh_after)))
        .select(
            "owner_id",
            F.when(F.col("latest").isNotNull(), F.date_add(day, -27))
            .otherwise(F.least(default, F.coalesce("earliest", default))).alias("start_date"),
            day.alias("end_date"),
        )
    )


def availability_state(has_scope, denied, row_count) -> Column:
    return (
        F.when(~col(has_scope), "REAUTH_REQUIRED").when(col(denied), "UNAVAILABLE")
        .when(F.coalesce(col(row_count), F.lit(0)) == 0, "NO_DATA").otherwise("AVAILABLE")
    )


def stored_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(upload_id, part_no, content) of files ``<folder>/<upload_id>/<part_no>.part``, read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.part").load(folder)
    name = lambda k, kind: F.regexp_extract("path", r"([^/]+)/(\d+)\.part$", k).cast(kind)
    return files.select(name(1, "bigint").alias("upload_id"), name(2, "bigint").alias("part_no"), "content")


def part_manifest_check(uploads: DataFrame, parts: DataFrame, stored: DataFrame) -> DataFrame:
    """Integrity of every upload: numbers, sizes and content of its parts against what was declared.

    ``uploads`` has (upload_id, total_bytes, chunk_bytes), ``parts`` the manifest (upload_id, part_no, part_bytes, sha256),
    ``stored`` what lies in storage (upload_id, part_no, content). Content is hashed where it is read, and only sizes
    and digests move. A number that comes twice in the manifest is repeated and does not stand for another; a part
    is corrupt if its stored bytes are not there or differ from the manifest in size or digest. MISSING_PARTS goes before CORRUPT_PART."""
    expected = F.ceil(F.col("total_bytes") / F.col("chunk_bytes"))
    found = stored.select("upload_id", "part_no", F.length("content").cast("bigint").alias("found_bytes"), F.sha2("content", 256).alias("found_sha"))
    one = found.groupBy("upload_id", "part_no").agg(F.min(F.struct("found_bytes", "found_sha")).alias("found"))
    sized = parts.join(uploads.select("upload_id", "total_bytes", "chunk_bytes"), "upload_id").join(one, ["upload_id", "part_no"], "left")
    wanted = F.least(F.col("chunk_bytes"), F.col("total_bytes") - F.col("part_no") * F.col("chunk_bytes"))
    intact = (F.col("found.found_bytes") == F.col("part_bytes")) & (F.col("found.found_sha") == F.col("sha256"))
    judged = sized.select(
        "upload_id", "part_no", (~F.coalesce(F.col("part_bytes") == wanted, F.lit(False))).alias("wrong"), (~F.coalesce(intact, F.lit(False))).alias("corrupt"),
        F.coalesce((F.col("part_no") >= 0) & (F.col("part_no") < expected), F.lit(False)).alias("known"),
    )
    by_number = judged.groupBy("upload_id", "part_no").agg(
        F.count("*").alias("n"), F.count_if("wrong").alias("wrong"), F.count_if("corrupt").alias("corrupt"), F.max("known").alias("known")
    )
    seen = by_number.groupBy("upload_id").agg(
        F.sum("n").alias("parts"), F.count_if("known").alias("numbers"), (F.sum("n") - F.count("*")).alias("repeated"),
        F.sum("wrong").alias("wrong_size"), F.sum("corrupt").alias("corrupt"),
    )
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    told = uploads.join(seen, "upload_id", "left").select(
        "upload_id", expected.alias("expected_parts"), count("parts").alias("parts"), (expected - count("numbers")).alias("missing"),
        *[count(c).alias(c) for c in ("repeated", "wrong_size", "corrupt")],
    )
    missing = (F.col("missing") > 0) | (F.col("repeated") > 0) | (F.col("parts") != F.col("expected_parts"))
    code = F.when(missing, "MISSING_PARTS").when((F.col("corrupt") > 0) | (F.col("wrong_size") > 0), "CORRUPT_PART")
    return told.withColumn("code", code).withColumn("complete", code.isNull())


PROBE = (
    "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,"
    "duration:string,bit_rate:string>>, format struct<format_name:string,duration:string,bit_rate:string>"
)


def probe_validate(df: DataFrame, text: str = "probe", mime: str = "mime") -> DataFrame:
    """Typed media metadata with the code of the first broken rule (null when usable)."""
    p = F.col("__p")
    video = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    audio = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    names = F.split(p["format"]["format_name"], ",")
    container_ok = F.when(F.col(mime) == "video/webm", F.array_contains(names, "webm")).otherwise(
        F.array_contains(names, "mov")
    )
    seconds = F.coalesce(p["format"]["duration"], video["duration"]).try_cast("double")
    fraction = F.split(F.coalesce(video["avg_frame_rate"], F.lit("0/1")), "/")
    denominator = F.coalesce(F.get(fraction, F.lit(1)).try_cast("double"), F.lit(1.0))
    fps = F.get(fraction, F.lit(0)).try_cast("double") / F.when(denominator != 0, denominator)
    small = lambda v: v.isNull() | (v < 16) | (v > 8192)
    code = (
        F.when(p.isNull(), "INVALID_METADATA")
        .when(~container_ok, "FORMAT_MISMATCH")
        .when(small(video["width"]) | small(video["height"]), "INVALID_RESOLUTION")
        .when(~F.coalesce(video["codec_name"].isin(config.SUPPORTED_CODECS), F.lit(False)), "UNSUPPORTED_CODEC")
        .when(seconds.isNull() | (seconds <= 0) | (seconds > 86400), "INVALID_DURATION")
        .when(fps.isNull() | (fps <= 0) | (fps > 240), "INVALID_FRAME_RATE")
    )
    bits = F.coalesce(p["format"]["bit_rate"], video["bit_rate"]).try_cast("double")
    parsed = F.from_json(col(text), PROBE)
    usable = parsed["streams"].isNotNull() & parsed["format"]["format_name"].isNotNull()
    return df.withColumn("__p", F.when(usable, parsed)).select(
        *[c for c in df.columns if c != text],
        code.alias("code"), seconds.alias("duration_s"), video["width"].alias("width"), video["height"].alias("height"),
        video["codec_name"].alias("video_codec"), audio["codec_name"].alias("audio_codec"),
        audio.isNotNull().alias("has_audio"), F.when(p.isNotNull(), fps).alias("frame_rate"), F.when(bits != 0, bits).alias("bitrate"),
    )


def extension_matches(filename, mime) -> Column:
    ext = F.lower(F.regexp_extract(col(filename), r"([^.]*)$", 1))
    wanted = (
        F.when(col(mime) == "video/mp4", "mp4").when(col(mime) == "video/quicktime", "mov").when(col(mime) == "video/webm", "webm")
    )
    return F.coalesce(ext == wanted, F.lit(False))


def versioned_append(existing: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Next version per parent, or the latest version again while that one still runs."""
    latest = existing.groupBy(key).agg(
        F.max("version").alias("latest_version"), F.max_by("status", "version").alias("latest_status")
    )
    reuse = F.col("latest_status").isin("RUNNING", "RETRYING")
    return requests.join(latest, key, "left").select(
        *requests.columns,
        F.when(reuse, F.col("latest_version")).otherwise(F.coalesce("latest_version", F.lit(0)) + 1).alias("version"),
        F.when(reuse, "REUSED").otherwise("CREATED").alias("action"),
    )


def keyed_upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Current rows overlaid by incoming rows of the same key; the newest incoming row wins."""
    rows = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return first_per_key(rows, keys, [F.col("__new").desc(), F.col(order).desc()]).drop("__new")


def content_hash_key(**fields) -> Column:
    """sha256 of the canonical JSON of named evidence fields, in the given order."""
    return F.sha2(F.to_json(F.struct(*[col(c).alias(name) for name, c in fields.items()])), 256)


def supersede_active(versions: DataFrame, key: str = "owner_id") -> DataFrame:
    """Only the highest version of an owner stays ACTIVE; each row carries the config before it."""
    near = neighbours(versions, [key], ["version"], ["version", "config"], VERSION_BLOCK)
    return near.select(
        *versions.columns, F.col("prev_config").alias("previous_config"),
        F.when(F.col("next_version").isNull(), "ACTIVE").otherwise("SUPERSEDED").alias("state"),
    )


def backfill_columns(rows: DataFrame, parents: DataFrame, key: str, mapping: dict[str, str]) -> DataFrame:
    """Fill columns that are still null from the parent table."""
    source = parents.select(key, *[F.col(src).alias(f"__{dst}") for dst, src in mapping.items()])
    joined = rows.join(source, key, "left")
    for dst in mapping:
        joined = joined.withColumn(dst, F.coalesce(dst, f"__{dst}")).drop(f"__{dst}")
    return joined


def migrate_defaults(df: DataFrame, legacy: dict[str, int], new: dict[str, int]) -> DataFrame:
    """Replace values only on rows that still hold every legacy default."""
    untouched = F.lit(True)
    for name, value in legacy.items():
        untouched = untouched & (F.col(name) == value)
    flagged = df.withColumn("__legacy", untouched)
    for name, value in new.items():
        flagged = flagged.withColumn(name, F.when(F.col("__legacy"), value).otherwise(F.col(name)))
    return flagged.drop("__legacy")


def scan_union_reports(channel: DataFrame, videos: DataFrame) -> DataFrame:
    return channel.unionByName(videos, allowMissingColumns=True)


def write_report(df: DataFrame, path: str) -> None:
    """Report frame as JSON lines and CSV, written by the executors."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def read_report(spark, path: str, schema) -> DataFrame:
    """A written report: the JSON rows, after the CSV form has been found to hold the same ones."""
    rows = spark.read.schema(schema).json(f"{path}/json")
    table = spark.read.schema(schema).option("header", True).csv(f"{path}/csv")
    if not rows.exceptAll(table).isEmpty() or not table.exceptAll(rows).isEmpty():
        raise ValueError(f"the two forms of the report under {path} differ")
    return rows
