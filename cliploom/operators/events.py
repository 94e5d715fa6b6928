"""Events from signals: evidence, clusters, scores, bounds, candidates and frame sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom import config
from cliploom.functions.numeric import bounded, bucket, col, duration_class, half_up
from cliploom.operators import scans, series
from cliploom.operators.reporting import top_n


def clustering_profile(game, event_type, confidence) -> Column:
    """struct(policy_id, gap_ms) of the first profile whose patterns and confidence fit."""
    g, e, c = F.lower(col(game)), F.lower(col(event_type)), col(confidence)
    picked = None
    for name, game_re, event_re, gap, minimum in config.CLUSTERING_PROFILES:
        fits = (c >= minimum) & g.rlike(game_re) & e.rlike(event_re)
        value = F.struct(F.lit(name).alias("policy_id"), F.lit(gap).alias("gap_ms"))
        picked = F.when(fits, value) if picked is None else picked.when(fits, value)
    name, _, _, gap, _ = config.CLUSTERING_PROFILES[-1]
    return picked.otherwise(F.struct(F.lit(name).alias("policy_id"), F.lit(gap).alias("gap_ms")))


def weight_of(kind, weights: dict[str, float]) -> Column:
    pairs = [(F.when(col(kind) == name, F.lit(value))) for name, value in weights.items()]
    return F.coalesce(*pairs)


def event_evidence(signals: DataFrame) -> DataFrame:
    """Typed evidence from every signal that is not a silence."""
    kind = F.col("kind")
    return signals.filter(kind != "SILENCE").select(
        "source_id", "signal_id", "t_ms", "kind", "value",
        F.when(kind == "SCENE_CHANGE", "SCENE_TRANSITION").when(kind == "AUDIO_PEAK", "AUDIO_REACTION")
        .otherwise("ACTIVITY_BURST").alias("event_type"),
        bounded(F.abs("value") / 100, 0.2, 1.0).alias("confidence"),
    )


def fallback_events(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """A mid-source event for every source without evidence."""
    middle = F.col("duration_ms") / 2
    return sources.join(evidence.select("source_id").distinct(), "source_id", "left_anti").select(
        "source_id", F.lit(1).cast("bigint").alias("cluster_no"), F.lit("ACTIVITY_BURST").alias("event_type"),
        F.greatest(F.lit(0.0), middle - 1000).alias("start_ms"), middle.alias("key_ms"),
        F.least(F.col("duration_ms").cast("double"), middle + 1000).alias("end_ms"),
        F.lit(0.15).alias("confidence"), F.lit("generic-v1").alias("policy_id"),
        F.array().cast("array<string>").alias("kinds"), F.lit(0).cast("bigint").alias("signal_count"),
        F.lit(0).cast("bigint").alias("weight_sum"),
    )


#: Types of the events of ``event_evidence``, and the gaps a profile can allow: together the states an open cluster can be in.
EVENT_TYPES = ("SCENE_TRANSITION", "AUDIO_REACTION", "ACTIVITY_BURST")
_GAPS = tuple(sorted({gap for _, _, _, gap, _ in config.CLUSTERING_PROFILES}))
#: Events of a chunk, and time buckets of a span: no array is longer than the chunk, its bucket's chunks or a span.
CHUNK, SPAN = 64, 512
#: Most types that evidence of other origin may have.
MOST_TYPES = 64


def _types_of(evidence: DataFrame) -> tuple[str, ...]:
    """The event types that occur: labels of a vocabulary, so at most ``MOST_TYPES``."""
    found = [r[0] for r in evidence.select("event_type").distinct().limit(MOST_TYPES + 1).collect()]
    if len(found) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} event types")
    return tuple(sorted(v for v in found if v is not None))


def _open_state(kind: Column, gap: Column) -> Column:
    """Number of the state of a cluster of type number ``kind`` and gap number ``gap``; 0 is no open cluster."""
    return (kind * len(_GAPS) + gap + 1).cast("int")


def _advance(state: Column, e: Column, types: tuple[str, ...]) -> tuple[Column, Column]:
    """The state after event ``e``, and whether e joined the open cluster."""
    kind, gap = F.floor((state - 1) / len(_GAPS)).cast("int"), F.pmod(state - 1, F.lit(len(_GAPS)))
    active = [k for k, name in enumerate(types) if "ACTIVITY" in name]
    agree = (kind == e["kind_no"]) | kind.isin(active) | e["kind_no"].isin(active)
    wider = F.greatest(gap, e["gap_no"])
    allowed = F.element_at(F.array(*[F.lit(g) for g in _GAPS]), wider + 1)
    joins = F.coalesce((state > 0) & agree & (e["since"] <= allowed), F.lit(False))
    return F.when(joins, _open_state(kind, wider)).otherwise(_open_state(e["kind_no"], e["gap_no"])), joins


_MOVE = "struct<to:int,n:bigint>"


def _move(state: Column, opened: Column) -> Column:
    return F.struct(state.cast("int").alias("to"), opened.cast("bigint").alias("n"))


def _after(move: Column, summary: Column) -> Column:
    """Where ``summary`` (for each entering state the leaving one and the clusters opened) leads from ``move``."""
    then = F.element_at(summary, move["to"] + 1)
    return _move(then["to"], move["n"] + then["n"])


def _composed(df: DataFrame, by: list[str], order: str, types: tuple[str, ...]) -> DataFrame:
    """One summary for each group: its rows' summaries one after the other. Keeps the rows' own, in order, as ``inner``."""
    listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "summary"))).alias("inner"))
    same = F.transform(F.sequence(F.lit(0), F.lit(len(types) * len(_GAPS))), lambda k: _move(k, F.lit(0)))
    return listed.withColumn("summary", F.aggregate("inner", same, lambda acc, row: F.transform(acc, lambda m: _after(m, row["summary"]))))


def _entered(df: DataFrame, order: str, enter: Column) -> DataFrame:
    """Each inner row's order with the state and cluster count it is entered with."""
    start = F.struct(enter.alias("at"), F.array().cast(f"array<struct<{order}:bigint,enter:{_MOVE}>>").alias("out"))
    steps = F.aggregate("inner", start, lambda acc, row: F.struct(
        _after(acc["at"], row["summary"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct(row[order].cast("bigint").alias(order), acc["at"].alias("enter")))).alias("out"),
    ), lambda acc: acc["out"])
    return df.withColumn("step", F.explode(steps)).select(
        *[c for c in df.columns if c not in ("inner", "summary", "enter")], f"step.{order}", "step.enter"
    )


def event_clusters(evidence: DataFrame, sources: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Chain each source's events into clusters.

    An event joins the open cluster when the types agree (or either is an ACTIVITY type) and it follows within the larger of
    the cluster's and its own gap. Evidence is point-like, so what an event needs to know of the past is the open cluster's type
    and gap: one of a few states. A chunk of events is summed up by the state and the number of clusters it leaves for each
    state it may be entered with; summaries compose from chunks to time buckets, spans and the source, the entering states come
    back the same way, and each chunk numbers its own events. A source without any silence is spread like all others. ``types``
    are the event types to expect; without it they are read from the evidence.
    """
    types = _types_of(evidence) if types is None else types
    profiled = evidence.join(sources.select("source_id", "game", "game_confidence"), "source_id").withColumn(
        "__p", clustering_profile("game", "event_type", F.least("game_confidence", "confidence"))
    )
    near = scans.neighbours(profiled, ["source_id"], ["t_ms", "signal_id"], ["t_ms"], series.SERIES_BUCKET)
    strength = weight_of("kind", config.STRENGTH_WEIGHTS) * F.greatest(F.lit(1.0), F.abs("value"))
    known = F.array_position(F.array(*[F.lit(v) for v in types]).cast("array<string>"), F.col("event_type"))
    item = F.struct(
        "t_ms", "signal_id", "event_type", "confidence", "kind", strength.alias("strength"),
        weight_of("kind", config.SCORE_WEIGHTS).alias("weight"),
        F.col("__p.policy_id").alias("policy_id"), F.col("__p.gap_ms").alias("gap_ms"),
        F.when(known > 0, known.cast("int") - 1).otherwise(F.raise_error(F.concat(F.lit("unknown event type "), "event_type")).cast("int")).alias("kind_no"),
        (F.array_position(F.array(*[F.lit(g) for g in _GAPS]), F.col("__p.gap_ms")).cast("int") - 1).alias("gap_no"),
        (F.col("t_ms") - F.col("prev_t_ms")).alias("since"),
    )
    inside = Window.partitionBy("source_id", scans.BUCKET).orderBy("t_ms", "signal_id")
    rows = scans.with_bucket(near, "t_ms", series.SERIES_BUCKET).select(
        "source_id", F.col(scans.BUCKET).alias("bucket"), F.floor((F.row_number().over(inside) - 1) / CHUNK).alias("chunk"), item.alias("e")
    )
    place = ["source_id", "bucket", "chunk"]
    chunks = rows.groupBy(*place).agg(F.array_sort(F.collect_list("e")).alias("items"))

    def passed(acc: Column, e: Column) -> Column:
        state, joins = _advance(acc["to"], e, types)
        return _move(state, acc["n"] + F.when(joins, 0).otherwise(1))

    states = F.sequence(F.lit(0), F.lit(len(types) * len(_GAPS)))
    summed = chunks.withColumn("summary", F.transform(states, lambda k: F.aggregate("items", _move(k, F.lit(0)), passed)))
    buckets = _composed(summed, ["source_id", "bucket"], "chunk", types).withColumn("span", F.floor(F.col("bucket") / SPAN))
    spans = _composed(buckets.select("source_id", "span", "bucket", "summary"), ["source_id", "span"], "bucket", types)
    whole = _composed(spans.select("source_id", "span", "summary"), ["source_id"], "span", types)
    of_spans = _entered(whole, "span", _move(F.lit(0), F.lit(0)))
    of_buckets = _entered(spans.join(of_spans, ["source_id", "span"]), "bucket", F.col("enter"))
    of_chunks = _entered(buckets.join(of_buckets, ["source_id", "span", "bucket"]).drop("span"), "chunk", F.col("enter"))

    def numbered(acc: Column, e: Column) -> Column:
        state, joins = _advance(acc["to"], e, types)
        number = acc["n"] + F.when(joins, 0).otherwise(1)
        return F.struct(state.alias("to"), number.alias("n"), F.concat(acc["ids"], F.array(number)).alias("ids"))

    start = F.struct(F.col("enter.to").alias("to"), F.col("enter.n").alias("n"), F.array().cast("array<bigint>").alias("ids"))
    ids = F.aggregate("items", start, numbered, lambda acc: acc["ids"])
    flat = chunks.join(of_chunks, place).select(
        "source_id", F.explode(F.zip_with("items", ids, lambda e, n: F.struct(e.alias("e"), n.alias("n")))).alias("z")
    ).select("source_id", F.col("z.n").alias("cluster_no"), "z.e.*")
    place = F.struct("t_ms", "signal_id")
    early = F.struct((-F.col("t_ms")).alias("a"), (-F.col("signal_id")).alias("b"))
    return flat.groupBy("source_id", "cluster_no").agg(
        F.min_by("event_type", place).alias("event_type"),
        F.min("t_ms").cast("double").alias("start_ms"),
        F.max_by("t_ms", F.struct(F.col("strength"), early)).cast("double").alias("key_ms"),
        F.max("t_ms").cast("double").alias("end_ms"),
        F.max("confidence").alias("confidence"),
        F.max_by("policy_id", F.struct(F.col("gap_ms"), early)).alias("policy_id"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.count("*").alias("signal_count"), F.sum("weight").alias("weight_sum"),
    )


def detected_events(signals: DataFrame, sources: DataFrame) -> DataFrame:
    evidence = event_evidence(signals)
    return event_clusters(evidence, sources, EVENT_TYPES).unionByName(fallback_events(sources, evidence))


def event_score() -> Column:
    """Kind weights plus a bonus of 2 per signal up to 15, 0..100; 10 without signals."""
    n = F.col("signal_count")
    raw = F.when(n > 0, F.col("weight_sum") + F.least(F.lit(15).cast("bigint"), n * 2)).otherwise(10)
    return bounded(raw.cast("double"))


def _has_all(kinds: Column, wanted: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(kinds, k) for k in wanted])


def detector_profile(game, confidence) -> Column:
    g = F.lower(col(game))
    picked = F.when(col(confidence) < config.PROFILE_MIN_CONFIDENCE, "generic-gameplay-v1")
    for name, words, *_ in config.DETECTOR_PROFILES:
        picked = picked.when(reduce(lambda a, b: a | b, [g.contains(w) for w in words]), name)
    return picked.otherwise("generic-gameplay-v1")


def profile_classify(events: DataFrame) -> DataFrame:
    """Event type, boosted score and description by the source's detector profile."""
    kinds, profile = F.col("kinds"), F.col("profile")
    kind_type, boost = F.col("event_type"), F.lit(0.0)
    told = (
        F.when(F.col("event_type") == "SCENE_TRANSITION", "A scene transition aligned with elevated gameplay activity.")
        .when(F.col("event_type") == "AUDIO_REACTION", "A local audio peak may indicate a reaction or impactful moment.")
        .when(F.col("signal_count") > 0, "A local cluster of motion and audio activity.")
        .otherwise("Fallback window because no distinct activity peak was detected.")
    )
    for name, _, rules, fallback, boosted, high, low, description in config.DETECTOR_PROFILES:
        label = F.lit(fallback)
        for wanted, outcome in reversed(rules):
            label = F.when(_has_all(kinds, wanted), outcome).otherwise(label)
        kind_type = F.when(profile == name, label).otherwise(kind_type)
        boost = F.when(profile == name, F.when(_has_all(kinds, boosted), float(high)).otherwise(float(low))).otherwise(boost)
        told = F.when(profile == name, description).otherwise(told)
    return events.select(
        *[c for c in events.columns if c != "event_type"],
        kind_type.alias("event_type"), F.least(F.lit(100.0), event_score() + boost).cast("int").alias("signal_score"),
        told.alias("reason"),
    )


def content_bounds(events: DataFrame) -> DataFrame:
    """Clip start and end around an event: padded, at least 6 s, at most 60 s inside the source."""
    total = F.col("duration_ms").cast("double")
    low, high = float(config.MIN_CLIP_MS), float(config.MAX_CLIP_MS)
    before = F.when(F.array_contains("kinds", "SCENE_CHANGE"), 1000.0).otherwise(2000.0)
    after = F.when(F.array_contains("kinds", "AUDIO_PEAK"), 2500.0).otherwise(1500.0)
    a = events.withColumn("__s", F.greatest(F.lit(0.0), F.col("start_ms") - before)).withColumn(
        "__e", F.least(total, F.col("end_ms") + after)
    )
    missing = F.greatest(F.lit(0.0), F.lit(low) - (F.col("__e") - F.col("__s")))
    b = a.withColumn("__m", missing).withColumn("__s", F.greatest(F.lit(0.0), F.col("__s") - F.col("__m") / 2))
    grow = F.col("__e") + F.col("__m") - F.when(F.col("__s") == 0, F.col("__m") / 2).otherwise(0.0)
    c = b.withColumn("__e", F.when(F.col("__m") > 0, F.least(total, grow)).otherwise(F.col("__e")))
    long = F.col("__e") - F.col("__s") > high
    late = F.least(total, F.greatest(F.lit(0.0), F.col("key_ms") - high * 0.6) + high)
    d = c.withColumn("__l", long).withColumn("__e", F.when(long, late).otherwise(F.col("__e"))).withColumn(
        "__s", F.when(F.col("__l"), F.greatest(F.lit(0.0), F.col("__e") - high)).otherwise(F.col("__s"))
    )
    seconds = lambda name: F.format_string("%.2fs", F.col(name) / 1000)
    return d.select(
        *events.columns, F.col("__s").alias("clip_start_ms"), F.col("__e").alias("clip_end_ms"),
        duration_class((F.col("__e") - F.col("__s")) / 1000).alias("duration_class"),
        F.concat(
            F.lit("Preserves setup from "), seconds("start_ms"), F.lit(", key moment at "), seconds("key_ms"),
            F.lit(", and payoff through "), seconds("end_ms"), F.lit("."),
        ).alias("duration_reason"),
    )


def gameplay_candidates(signals: DataFrame, sources: DataFrame, limit: int = 24) -> DataFrame:
    """Detect, score, keep the best ``limit`` per source, then place the clip bounds."""
    profiled = sources.withColumn("profile", detector_profile("game", "game_confidence"))
    events = detected_events(signals, sources).join(
        profiled.select("source_id", "profile", "duration_ms"), "source_id"
    )
    scored = profile_classify(events)
    best = top_n(scored, ["source_id"], [F.col("signal_score").desc(), F.col("key_ms"), F.col("cluster_no")], limit)
    return content_bounds(best)


def gap_sessions(peaks: DataFrame, sources: DataFrame, gap_ms: int = 6000) -> DataFrame:
    """Audio peaks at most ``gap_ms`` apart as one conversational stretch, numbered in bucketed scans."""
    marked = scans.gap_groups(peaks, ["source_id"], ["t_ms", "signal_id"], gap_ms, "session_no", series.SERIES_BUCKET)
    grouped = marked.groupBy("source_id", "session_no").agg(
        F.count("*").alias("peaks"), F.sum("t_ms").alias("__sum"), F.min("t_ms").alias("__first"), F.max("t_ms").alias("__last")
    )
    total = F.col("duration_ms").cast("double")
    return grouped.join(sources.select("source_id", "duration_ms"), "source_id").select(
        "source_id", "session_no", "peaks", "duration_ms",
        F.least(total, F.col("__sum") / F.col("peaks")).alias("center_ms"),
        F.greatest(F.lit(0.0), F.col("__first") - F.lit(2000.0)).alias("start_ms"),
        F.least(total, F.col("__last") + F.lit(3000.0)).alias("end_ms"),
        F.least(F.lit(0.55), F.lit(0.2) + F.col("peaks") * 0.06).alias("confidence"),
    )


def podcast_candidates(signals: DataFrame, sources: DataFrame, limit: int = 24) -> DataFrame:
    peaks = signals.filter("kind = 'AUDIO_PEAK'")
    score = F.least(F.lit(55).cast("bigint"), F.lit(18) + F.col("peaks") * 8).cast("int")
    scored = gap_sessions(peaks, sources).withColumn("signal_score", score)
    best = top_n(scored, ["source_id"], [F.col("signal_score").desc(), F.col("center_ms"), F.col("session_no")], limit)
    total = F.col("duration_ms").cast("double")
    placed = best.withColumn(
        "clip_start_ms", F.greatest(F.lit(0.0), F.least(total - 6000.0, F.col("start_ms") - 5000.0))
    ).withColumn("clip_end_ms", F.least(total, F.greatest(F.col("clip_start_ms") + 6000.0, F.col("end_ms") + 5000.0)))
    return placed.withColumn(
        "duration_class", bucket(F.col("clip_end_ms") - F.col("clip_start_ms"), [(20000, "QUICK")], "STANDARD")
    )


def adaptive_samples(clips: DataFrame, maximum: int = config.SAMPLING["maximum"]) -> DataFrame:
    """Frame times of each clip: sparse, approaching, burst and payoff grids, at most ``maximum``."""
    p = config.SAMPLING
    limit = max(p["minimum"], min(p["maximum"], maximum))
    start, key, end = F.col("start_ms"), F.col("event_ms"), F.col("end_ms")
    big = lambda v: F.lit(v).cast("bigint")
    none = F.array().cast("array<bigint>")

    def grid(first: Column, last: Column, interval: int) -> Column:
        return F.when(first <= last, F.sequence(first, last, big(interval))).otherwise(none)

    radius = p["radius"]
    times = F.concat(
        F.array(start + 100, key, end - 100),
        grid(start, key - radius - 1, p["sparse"]),
        grid(F.greatest(start, key - 3000), key - radius - 1, p["approach"]),
        grid(F.greatest(start, key - radius), F.least(end, key + radius), p["burst"]),
        grid(key + radius, F.least(end, key + p["payoff_span"]), p["payoff"]),
        F.coalesce(F.col("activity_ms"), none) if "activity_ms" in clips.columns else none,
    )
    inside = F.array_sort(F.array_distinct(F.transform(times, lambda t: F.greatest(start, F.least(end, t)))))
    rows = clips.withColumn("__all", inside)
    kept = F.array_distinct(F.concat(
        F.array(F.element_at("__all", 1), key, F.element_at("__all", -1)),
        F.filter("__all", lambda t: F.abs(t - key) <= radius),
    ))
    rows = rows.withColumn("__kept", kept).withColumn(
        "__rest", F.filter("__all", lambda t: ~F.array_contains("__kept", t))
    )

    def choose(acc: Column, _: Column) -> Column:
        size, left = F.size(acc["kept"]), F.size(acc["rest"])
        at = F.greatest(F.lit(0), half_up((size + 1) / limit * (left - 1)).cast("int"))
        go = (size < limit) & (left > 0)
        return F.struct(
            F.when(go, F.concat(acc["kept"], F.array(F.get(acc["rest"], at)))).otherwise(acc["kept"]).alias("kept"),
            F.when(go, F.filter(acc["rest"], lambda t, i: i != at)).otherwise(acc["rest"]).alias("rest"),
        )

    filled = F.aggregate(
        F.sequence(F.lit(1), F.lit(limit)),
        F.struct(F.col("__kept").alias("kept"), F.col("__rest").alias("rest")), choose,
        lambda acc: F.slice(F.array_sort(acc["kept"]), 1, limit),
    )
    return rows.withColumn(
        "sample_ms", F.when(F.size("__all") <= limit, F.col("__all")).otherwise(filled)
    ).drop("__all", "__kept", "__rest")


def key_frame_index(samples: Column, event: Column) -> Column:
    """0-based index of the sample nearest the event, first on ties."""
    ranked = F.transform(samples, lambda t, i: F.struct(F.abs(t - event).alias("gap"), i.alias("i")))
    return F.array_min(ranked)["i"]
