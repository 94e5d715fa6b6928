"""Edit timelines: cuts, captions, documents, validation and migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import config
from cliploom.functions.numeric import duration_class
from cliploom.operators.intervals import mapped, point_join

EPSILON_MS = 80
BUILT = "array<struct<start:double,end:double>>"


def remap_points(points: DataFrame, clips: DataFrame, cuts: DataFrame) -> DataFrame:
    """Points of a source that fall inside a kept piece of a clip, with their output time."""
    spans = cuts.join(clips.select("clip_id", "source_id"), "clip_id")
    return point_join(points, spans, ["source_id"], "t_ms", ("source_start", "source_end")).withColumn(
        "output_ms", mapped(F.col("t_ms"))
    )


def subtitle_groups(clips: DataFrame, words: DataFrame, cuts: DataFrame, reach: int = 4000) -> DataFrame:
    """Caption groups of the words within ``reach`` of each clip's event, on the output timeline.

    A group closes at five words, a pause over 0.45 s or a span over 1.6 s; the
    first six groups are kept. Eight seconds of words make a short list to fold.
    """
    spans = cuts.join(clips.select("clip_id", "source_id", "event_ms"), "clip_id")
    keyed = words.select(
        F.col("transcript_id").alias("source_id"), F.col("start_ms").alias("t_ms"), F.col("end_ms").alias("w_end"), "w", "pos"
    )
    near = point_join(keyed, spans, ["source_id"], "t_ms", ("source_start", "source_end")).filter(
        (F.col("w_end") <= F.col("source_end")) & F.col("t_ms").between(F.col("event_ms") - reach, F.col("event_ms") + reach)
    )
    item = F.struct(
        F.col("t_ms"), F.col("pos"), mapped(F.col("t_ms")).alias("start"), mapped(F.col("w_end")).alias("end"), F.trim("w").alias("w")
    )
    listed = near.filter(F.trim("w") != "").groupBy("clip_id").agg(F.array_sort(F.collect_list(item)).alias("words"))
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0.0).alias("first"), F.lit(0.0).alias("last"), F.lit(0).alias("size"),
        F.array().cast("array<int>").alias("ids"),
    )

    def step(acc: Column, w: Column) -> Column:
        opens = (
            (acc["size"] == 0) | (acc["size"] >= 5) | (w["start"] - acc["last"] > 450) | (w["end"] - acc["first"] > 1600)
        )
        n = acc["n"] + F.when(opens, 1).otherwise(0)
        return F.struct(
            n.alias("n"), F.when(opens, w["start"]).otherwise(acc["first"]).alias("first"), w["end"].alias("last"),
            F.when(opens, 1).otherwise(acc["size"] + 1).alias("size"), F.concat(acc["ids"], F.array(n)).alias("ids"),
        )

    numbered = listed.withColumn("ids", F.aggregate("words", start, step, lambda acc: acc["ids"]))
    each = numbered.select(
        "clip_id", F.explode(F.zip_with("words", "ids", lambda w, n: F.struct(w.alias("w"), n.alias("n")))).alias("z")
    ).select("clip_id", F.col("z.n").alias("group_no"), "z.w.*").filter(F.col("group_no") <= 6)
    grouped = each.groupBy("clip_id", "group_no").agg(
        F.array_sort(F.collect_list(F.struct("t_ms", "pos", "w", "end"))).alias("__w"), F.min("start").alias("start_ms"),
        F.max("end").alias("__end"),
    )
    return grouped.select(
        "clip_id", "group_no", F.substring(F.array_join(F.transform("__w", lambda x: x["w"]), " "), 1, 80).alias("caption"),
        "start_ms", F.greatest(F.col("__end"), F.col("start_ms") + 450).alias("end_ms"), F.size("__w").alias("tokens"),
    )


def tracking_crop(df: DataFrame) -> DataFrame:
    """Keep a tracked crop only past the confidence, jitter, missing and length gates."""
    p = config.TRACKING
    reliable = (
        (F.col("track_confidence") >= p["confidence"]) & (F.col("jitter") <= p["jitter"])
        & (F.col("missing_ratio") <= p["missing"]) & (F.col("points") >= 3)
    )
    tracked = F.col("requested_crop") == "TRACKED_CROP"
    fallback = F.when(F.col("aspect") >= 2.1, "BLURRED_BACKGROUND").otherwise("SMART_CROP")
    return df.withColumn(
        "crop", F.when(~tracked, F.col("requested_crop")).when(F.coalesce(reliable, F.lit(False)), "TRACKED_CROP").otherwise(fallback)
    ).withColumn("crop_confidence", F.when(tracked, F.coalesce("track_confidence", F.lit(0.0))).otherwise(0.0))


def edl_build(clips: DataFrame, cuts: DataFrame, captions: DataFrame) -> DataFrame:
    """Timeline document per clip from its kept pieces, effect preset, hook and captions.

    ``clips`` carries clip bounds, event times, ``source_ms``, ``effect`` and ``hook``.
    """
    pieces = cuts.groupBy("clip_id").agg(
        F.sum(F.col("source_end") - F.col("source_start")).cast("double").alias("base_ms"),
        F.array_sort(F.collect_list(F.struct("source_start", "source_end", "output_start"))).alias("cuts"),
    )
    spoken = captions.groupBy("clip_id").agg(
        F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "caption"))).alias("captions")
    )
    joined = clips.join(pieces, "clip_id").join(spoken, "clip_id", "left")
    start, end, event = (F.col(c).cast("double") for c in ("start_ms", "end_ms", "event_ms"))
    r_start, r_end = F.greatest(start, event - 800), F.least(end, event + 800)
    replayed = (F.col("effect") == "REPLAY") & (r_end - r_start >= 600)
    out = F.least(F.lit(60000.0), F.col("base_ms") + F.when(replayed, (r_end - r_start) / 0.65).otherwise(0.0))
    at = F.greatest(F.lit(400.0), F.least(F.col("output_ms") - 200, event - start))
    fx_start, fx_end = F.greatest(F.lit(0.0), F.col("event_output") - 300), F.least(F.col("output_ms"), F.col("event_output") + 500)
    rows = joined.withColumn("output_ms", out).withColumn("event_output", at).withColumn("fx_start", fx_start).withColumn("fx_end", fx_end)
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    none = F.array().cast(BUILT)
    punched = F.col("effect").isin("PUNCH_IN", "IMPACT")
    impact = F.col("effect") == "IMPACT"
    progress = span(F.lit(0.0), F.col("output_ms"))
    return rows.select(
        "clip_id", F.col("start_ms").alias("clip_start"), F.col("end_ms").alias("clip_end"), "output_ms", "cuts",
        duration_class((end - start) / 1000).alias("duration_class"),
        F.when(F.trim("hook") != "", span(F.lit(0.0), F.least(F.col("output_ms"), F.lit(1400.0)))).alias("hook"),
        F.when(F.col("effect") == "REPLAY", "PAYOFF_TEASE").when(impact, "ACTION_FIRST").otherwise("IMMEDIATE_CONTEXT").alias("hook_kind"),
        F.when(punched, F.array(span(F.col("fx_start"), F.col("fx_end")))).otherwise(none).alias("zooms"), none.alias("freeze_frames"),
        F.when(replayed, F.array(span(r_start, r_end))).otherwise(none).alias("replays"),
        F.when(impact, F.array(progress, span(F.col("fx_start"), F.col("fx_end")))).otherwise(F.array(progress)).alias("overlays"),
        F.when(impact, F.array(span(F.col("fx_start"), F.col("fx_end")))).otherwise(none).alias("sound_effects"),
        F.coalesce("captions", F.array().cast("array<struct<start_ms:double,end_ms:double,caption:string>>")).alias("captions"),
        F.when(F.col("effect") == "CLEAN", "LOW").otherwise("MEDIUM").alias("intensity"),
    )


def edl_validate(docs: DataFrame) -> DataFrame:
    """Issues of each document: order of bounds and anchors, timed items and cuts outside, hook and tracking rules.

    ``docs`` carries clip and output bounds, anchors, ``timed`` spans, ``cuts``, ``hook_start``, crop and tracking columns (ms).
    """
    late = F.col("output_ms") + EPSILON_MS
    bad_item = F.exists("timed", lambda i: (i["end"] <= i["start"]) | (i["end"] > late))
    bad_cut = F.exists(
        "cuts",
        lambda c: (c["source_end"] <= c["source_start"]) | (c["source_start"] < F.col("clip_start") - EPSILON_MS)
        | (c["source_end"] > F.col("clip_end") + EPSILON_MS)
        | (c["output_start"] + (c["source_end"] - c["source_start"]) / c["speed"] > late),
    )
    tracked = F.col("crop") == "TRACKED_CROP"
    rules = [
        ("clipEnd", F.col("clip_end") <= F.col("clip_start")),
        ("eventAnchors", (F.col("event_start") > F.col("key_moment")) | (F.col("key_moment") > F.col("payoff_end"))),
        ("timeline", bad_item), ("cuts", bad_cut), ("hook", F.coalesce(F.col("hook_start") > 150, F.lit(False))),
        ("trackingConfidence", tracked & ((F.col("track_confidence") < config.TRACKING["confidence"]) | (F.col("track_points") == 0))),
        ("trackedSubject", (F.col("track_points") > 0) & ~tracked),
    ]
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
    return docs.withColumn("issues", found)


def schema_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Names of the field rules (ranges, lengths, cardinalities, enums) a row breaks."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def edl_field_rules() -> dict[str, Column]:
    c = F.col
    return {
        "clipStart": c("clip_start") >= 0, "clipEnd": c("clip_end") > 0,
        "outputDuration": c("output_ms").between(100, 60000),
        "durationClass": c("duration_class").isin("MICRO", "QUICK", "STANDARD", "STORY", "EXTENDED"),
        "cropStrategy": c("crop").isin(
            "CENTER_CROP", "SMART_CROP", "TRACKED_CROP", "STACKED", "BLURRED_BACKGROUND", "GAMEPLAY_PLUS_FACE_CAM"),
        "cuts": F.size("cuts").between(1, 80), "zooms": F.size("zooms") <= 20, "title": F.length(F.trim("title")).between(1, 100),
        "hashtags": F.size("hashtags").between(1, 6) & F.forall("hashtags", lambda h: h.rlike("^#[A-Za-z0-9_]+$") & (F.length(h) <= 40)),
        "highlightScore": c("highlight").between(0, 100), "duplicateScore": c("duplicate_score").between(0.0, 1.0),
    }


def edl_migrate_v1(docs: DataFrame) -> DataFrame:
    """Version 1 documents as version 2: renamed crops, anchors, class, defaults; version 2 rows pass through."""
    old = F.col("schema_version") == 1
    crop = F.when(F.col("crop") == "CENTER", "CENTER_CROP").when(F.col("crop") == "BACKGROUND_BLUR", "BLURRED_BACKGROUND").otherwise(F.col("crop"))
    length = F.coalesce(F.col("output_s"), F.col("clip_end_s") - F.col("clip_start_s"))
    pick = lambda new, kept: F.when(old, new).otherwise(kept)
    return docs.withColumns({
        "crop": pick(crop, F.col("crop")), "event_start_s": pick(F.col("clip_start_s"), F.col("event_start_s")),
        "key_moment_s": pick(F.col("clip_start_s") + length / 2, F.col("key_moment_s")),
        "payoff_end_s": pick(F.col("clip_end_s"), F.col("payoff_end_s")),
        "duration_class": pick(duration_class(length), F.col("duration_class")),
        "track_confidence": pick(F.when(F.size("tracked") > 0, 1.0).otherwise(0.0), F.col("track_confidence")),
        "hook_kind": pick(F.when(F.col("hook").isNotNull(), "IMMEDIATE_CONTEXT"), F.col("hook_kind")),
        "analysis_method": pick(F.lit("HEURISTIC_FALLBACK"), F.col("analysis_method")),
        "schema_version": F.lit(2),
    })


def caption_every_other(captions: Column) -> Column:
    return F.filter(captions, lambda c, i: i % 2 == 0)


def effect_count(*arrays: str) -> Column:
    return sum((F.coalesce(F.size(F.col(a)), F.lit(0)) for a in arrays), F.lit(0))
