"""Multi-evidence comparison of content items and the blocked joins that feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import config
from cliploom.functions import evidence as ev
from cliploom.functions.text import set_cosine, tokens_unicode

TIME_BLOCK_MS = 60_000
NEAR_MS = 2_000
NEAR_VISUAL = 0.97
NEAR_CONCEPT = 0.65

FIELDS = [
    "short_id", "owner_id", "source_hash", "start_ms", "end_ms", "event_ms", "game", "event_type", "duration_s",
    "template", "tone", "frames", "render_hash", "reuse_kind", "reuse_of_id", "reuse_reason",
    "hook_t", "title_t", "concept_t", "transcript_t", "objects_t", "v", "model", "norm",
]


def _hashed(text) -> Column:
    """Token set as 64-bit hashes: half the width of the words and fixed in size."""
    return F.transform(tokens_unicode(text), lambda t: F.xxhash64(t))


def comparable(pool: DataFrame, vectors: DataFrame) -> DataFrame:
    """Items with token sets, frame hashes and (where there is one) their vector and its norm."""
    tokens = pool.withColumn("frames", F.array("h0", "h1"))
    for name in ("hook", "title"):
        tokens = tokens.withColumn(f"{name}_t", _hashed(name))
    tokens = tokens.withColumn("concept_t", _hashed(F.concat_ws(" ", "concept", "event_type"))).withColumn(
        "transcript_t", _hashed("transcript")
    ).withColumn("objects_t", F.when(F.col("objects").isNotNull(), _hashed("objects")))
    normed = vectors.withColumn("norm", F.sqrt(ev.dot(F.col("v"), F.col("v")))).withColumnRenamed("vec_id", "__vec")
    # Items without a vector meet none; a key of their own keeps them from gathering in one task.
    key = F.coalesce(F.col("vec_id").cast("bigint"), -1 - F.col("short_id"))
    joined = tokens.join(normed, (key == F.col("__vec").cast("bigint")) & F.col("vec_id").isNotNull(), "left")
    return joined.drop("transcript", "hook", "title", "concept", "objects", "__vec")


def side(df: DataFrame, prefix: str, extra: list[str] | None = None) -> DataFrame:
    keep = FIELDS + (extra or [])
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in keep])


def _cols(prefix: str) -> dict[str, Column]:
    return {name: F.col(f"{prefix}_{name}") for name in FIELDS}


def _reuse(a: dict[str, Column], b: dict[str, Column]) -> Column:
    allowed = (
        (a["reuse_of_id"] == b["short_id"]) & a["reuse_kind"].isin(config.REUSE_KINDS)
        & (F.length(F.trim(a["reuse_reason"])) >= 12)
    )
    return F.coalesce(allowed, F.lit(False))


def same_moment(a: dict[str, Column], b: dict[str, Column]) -> Column:
    overlap = ev.overlap_of_shorter(a["start_ms"], a["end_ms"], b["start_ms"], b["end_ms"])
    close = F.abs(a["event_ms"] - b["event_ms"]) < NEAR_MS
    return (a["source_hash"] == b["source_hash"]) & ((overlap >= 0.5) | close)


def semantic(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Vector cosine where both have one of the same model and size, else token cosine of concept and event."""
    usable = (F.size(a["v"]) > 0) & (F.size(a["v"]) == F.size(b["v"])) & a["model"].eqNullSafe(b["model"])
    cosine = ev.dot(a["v"], b["v"]) / F.greatest(F.lit(1e-12), a["norm"] * b["norm"])
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine))).otherwise(
        set_cosine(a["concept_t"], b["concept_t"])
    )


def compared(pairs: DataFrame, left: str = "a", right: str = "b", name: str = "cmp") -> DataFrame:
    """Add ``name``: struct of components, score, duplicate, reason and exception for each pair of sides."""
    a, b = _cols(left), _cols(right)
    same_source = a["source_hash"] == b["source_hash"]
    flag = lambda c: c.cast("double")
    text = lambda key: set_cosine(a[key], b[key])
    components = {
        "source": flag(same_source),
        "timestamps": F.when(
            same_source, ev.overlap_of_shorter(a["start_ms"], a["end_ms"], b["start_ms"], b["end_ms"])
        ).otherwise(0.0),
        "game": flag(a["game"] == b["game"]),
        "event": flag(a["event_type"] == b["event_type"]),
        "objects": F.when(a["objects_t"].isNotNull() & b["objects_t"].isNotNull(), text("objects_t")),
        "transcript": F.when((F.size(a["transcript_t"]) > 0) & (F.size(b["transcript_t"]) > 0), text("transcript_t")),
        "semantic": semantic(a, b),
        "visual": ev.clamped_index_similarity(a["frames"], b["frames"]),
        "hook": text("hook_t"),
        "title": text("title_t"),
        "duration": F.least(a["duration_s"], b["duration_s"])
        / F.greatest(a["duration_s"], b["duration_s"], F.lit(0.01)),
        "template": flag(a["template"] == b["template"]),
        "tone": flag(a["tone"] == b["tone"]),
    }
    c = {key: F.col(f"__c.{key}") for key in components}
    weights = config.COMPARE_WEIGHTS
    total = sum((F.coalesce(c[k] * weights[k], F.lit(0.0)) for k in weights), F.lit(0.0))
    weight = sum((F.when(c[k].isNotNull(), weights[k]).otherwise(0.0) for k in weights), F.lit(0.0))
    boost = F.when(
        (c["event"] > 0) & (c["semantic"] >= 0.8) & (c["hook"] >= 0.85) & (c["title"] >= 0.85), 0.9
    ).otherwise(0.0)
    exact = F.coalesce(a["render_hash"] == b["render_hash"], F.lit(False))
    moment = same_moment(a, b)
    near = F.coalesce((c["visual"] >= NEAR_VISUAL) & (c["semantic"] >= NEAR_CONCEPT), F.lit(False))
    exception = _reuse(a, b) | _reuse(b, a)
    verdict = F.struct(
        F.least(F.lit(1.0), F.greatest(total / weight, boost)).alias("score"),
        (exact | ((moment | near) & ~exception)).alias("duplicate"),
        F.when(exact, "Identical render").when(moment, "Same source moment")
        .when(near, "Matching frame sequence and concept").otherwise("Content similarity").alias("reason"),
        exception.alias("exception"), F.col("__c").alias("components"),
    )
    packed = F.struct(*[value.alias(key) for key, value in components.items()])
    return pairs.withColumn("__c", packed).withColumn(name, verdict).drop("__c")


def with_time_blocks(df: DataFrame) -> DataFrame:
    """One row per minute of source time the item's clip (or its event ± 2 s) touches."""
    low = F.floor(F.least(F.col("start_ms"), F.col("event_ms") - NEAR_MS) / TIME_BLOCK_MS)
    high = F.floor(F.greatest(F.col("end_ms"), F.col("event_ms") + NEAR_MS) / TIME_BLOCK_MS)
    return df.withColumn("block0", low).withColumn("block", F.explode(F.sequence(low, high)))


def with_frame_bands(df: DataFrame, against: DataFrame | None = None) -> DataFrame:
    """One row per blocking key of the item's frame hashes, as the left side of a comparison.

    With ``against`` (the left side) as the right one of lists of another length: for each length there but its own, the keys
    of the frames that a left list of this length is compared with (the same index, the last one repeating).

    A mean of at least .97 over n frames leaves at most D = floor(1.92 n)
    differing bits. Some aligned frame then differs by at most one bit, so it agrees
    on three of its four 16-bit bands, and the frame after it by at most three, so it
    agrees on one of four parts: were every frame of at most one bit followed by one
    of four or more, the mean would be two bits a frame. The key joins both, so a frame
    shared by many items (an intro, a black screen) does not make a hot block on its own.
    """
    n = F.size("met")
    if against is None:
        met = df.withColumn("met", F.col("frames"))
    else:
        lengths = against.agg(F.collect_set(F.size("frames"))).scalar()
        clamped = F.transform(
            F.sequence(F.lit(0), F.col("met_n") - 1), lambda i: F.get(F.col("frames"), F.least(i, F.size("frames") - 1))
        )
        sized = df.filter(F.size("frames") > 0).withColumn("met_n", F.explode(lengths)).filter(
            (F.col("met_n") > 0) & (F.col("met_n") != F.size("frames"))
        )
        met = sized.withColumn("met", clamped).drop("met_n")
    parts = F.least(F.lit(4), F.floor((F.lit(1.0) - NEAR_VISUAL) * 64 * n + 1e-9).cast("int") + 1)
    digits = F.ceil(F.lit(16) / parts).cast("int")
    band = lambda h, i: F.substring(h, 1 + 4 * i, 4)
    whole = lambda h: [
        F.concat(F.lit(f"{skip}:"), *[band(h, i) for i in range(4) if i != skip]) for skip in range(4)
    ]

    def keys_of(h: Column, i: Column) -> Column:
        after = F.get(F.col("met"), (i + 1) % n)
        pieces = F.transform(
            F.sequence(F.lit(0), F.lit(15), digits),
            lambda at: F.concat(at.cast("string"), F.lit("."), F.substr(after, at + 1, digits)),
        )
        return F.flatten(F.transform(
            F.array(*whole(h)), lambda w: F.transform(pieces, lambda piece: F.xxhash64(n, i, w, piece))
        ))

    keys = F.flatten(F.transform("met", keys_of))
    return met.withColumn("band", F.explode(F.array_distinct(keys))).drop("met")


def visual_groups(df: DataFrame) -> DataFrame:
    """Each item with the first and last item (``rep_id``, ``last_id``) of identical frames and concept in its owner's pool.

    Copies behave alike in the visual comparison, so only representatives meet
    in the band join and every copy is linked once, to its representative.
    """
    signature = F.xxhash64("frames", "concept_t", F.coalesce("vec_id", F.lit(-1).cast("bigint")))
    marked = df.withColumn("signature", signature)
    reps = marked.groupBy("owner_id", "signature", "frames", "concept_t").agg(
        F.min("short_id").alias("rep_id"), F.max("short_id").alias("last_id")
    )
    return marked.join(
        reps, ["owner_id", "signature", "frames", "concept_t"]
    ).drop("signature")


def moment_pairs(df: DataFrame) -> DataFrame:
    """Id pairs of the same owner and source whose clips touch or events lie within 2 s, each once."""
    slim = with_time_blocks(df.select("short_id", "owner_id", "source_hash", "start_ms", "end_ms", "event_ms"))
    a = slim.select(*[F.col(c).alias(f"a_{c}") for c in slim.columns])
    b = slim.select(*[F.col(c).alias(f"b_{c}") for c in slim.columns])
    # A pair sharing several blocks is kept only in the first one they share.
    keys = (
        (F.col("a_owner_id") == F.col("b_owner_id")) & (F.col("a_source_hash") == F.col("b_source_hash"))
        & (F.col("a_block") == F.col("b_block")) & (F.col("a_short_id") < F.col("b_short_id"))
        & (F.col("a_block") == F.greatest("a_block0", "b_block0"))
    )
    touch = ev.overlap_ms("a_start_ms", "a_end_ms", "b_start_ms", "b_end_ms") > 0
    close = F.abs(F.col("a_event_ms") - F.col("b_event_ms")) < NEAR_MS
    return a.join(b, keys).filter(touch | close).select("a_short_id", "b_short_id")


def visual_pairs(df: DataFrame) -> DataFrame:
    """Id pairs of representatives alike in frames (.97) and concept (.65), and each copy with its representative.

    Lists of different length are compared by the left one's length, the item with the lower id. Where only the later
    representative on the left is alike, it pairs with the last copy of the other, if that one is later still.
    The concept is compared before a pair is written, so items that only share frames (a black screen) make no pairs."""
    told = ["concept_t", "v", "model", "norm"]
    grouped = visual_groups(df.select("short_id", "owner_id", "frames", "vec_id", *told))
    reps = grouped.filter("short_id = rep_id").select("short_id", "owner_id", "frames", "last_id")
    prefix = lambda rows, p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns])
    # Lists meet once, however many items and keys share them; a list that is not like itself (unreadable frames) meets none.
    lists = reps.select("owner_id", "frames").distinct()
    keyed = prefix(with_frame_bands(lists), "a")
    keys = (F.col("a_owner_id") == F.col("b_owner_id")) & (F.col("a_band") == F.col("b_band"))
    alike = ev.clamped_index_similarity("a_frames", "b_frames") >= NEAR_VISUAL
    told_apart = keyed.join(prefix(with_frame_bands(lists), "b"), keys & (F.col("a_frames") < F.col("b_frames")) & alike).select(
        "a_owner_id", "a_frames", "b_frames").distinct()
    itself = lists.select(F.col("owner_id").alias("a_owner_id"), F.col("frames").alias("a_frames"), F.col("frames").alias("b_frames")).filter(alike)
    equal = told_apart.unionByName(told_apart.select("a_owner_id", F.col("b_frames").alias("a_frames"), F.col("a_frames").alias("b_frames"))).unionByName(itself)
    other = keyed.join(prefix(with_frame_bands(lists, against=df), "b"), keys & alike).select("a_owner_id", "a_frames", "b_frames").distinct()
    met_lists = equal.withColumn("sized", F.lit(True)).unionByName(other.withColumn("sized", F.lit(False)))
    ordered = F.col("a_short_id") < F.col("b_short_id")
    later = (F.col("a_short_id") != F.col("b_short_id")) & (F.col("a_short_id") < F.col("b_last_id"))
    near = prefix(reps, "a").join(met_lists.withColumnRenamed("b_frames", "met"), ["a_owner_id", "a_frames"]).join(
        prefix(reps, "b"), (F.col("a_owner_id") == F.col("b_owner_id")) & (F.col("met") == F.col("b_frames"))
        & F.when(F.col("sized"), ordered).otherwise(later),
    )
    star = grouped.filter("short_id <> rep_id").select(
        F.col("rep_id").alias("a_short_id"), F.col("short_id").alias("b_short_id")
    )
    met = F.when(F.col("a_short_id") < F.col("b_short_id"), F.col("b_short_id")).otherwise(F.col("b_last_id"))
    ids = near.select("a_short_id", met.alias("b_short_id")).distinct()
    for prefix in ("a", "b"):
        ids = ids.join(df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ["short_id", *told]]), f"{prefix}_short_id")
    a, b = ({c: F.col(f"{p}_{c}") for c in told} for p in ("a", "b"))
    return ids.filter(semantic(a, b) >= NEAR_CONCEPT).select("a_short_id", "b_short_id").unionByName(star)


def render_pairs(df: DataFrame) -> DataFrame:
    """Each item with the first item of its owner that has the same render: a group of copies is a star."""
    known = df.filter(F.col("render_hash").isNotNull()).select("short_id", "owner_id", "render_hash")
    first = known.groupBy("owner_id", "render_hash").agg(F.min("short_id").alias("a_short_id"))
    return known.join(first, ["owner_id", "render_hash"]).filter("short_id <> a_short_id").select(
        "a_short_id", F.col("short_id").alias("b_short_id")
    )


def candidate_pairs(df: DataFrame) -> DataFrame:
    return moment_pairs(df).unionByName(visual_pairs(df)).unionByName(render_pairs(df)).distinct()


def pairwise_similarity(df: DataFrame) -> DataFrame:
    """Full comparison of every candidate pair; evidence is attached after the pairs are known."""
    pairs = candidate_pairs(df)
    joined = pairs.join(side(df, "a"), "a_short_id").join(side(df, "b"), "b_short_id")
    return compared(joined)


def history_conflicts(pool: DataFrame, history: DataFrame) -> DataFrame:
    """Ids of pool items that duplicate some history item of their owner.

    Each hard rule is an existence test on its own equi key, so a match stops
    the search and no group of matches is ever written out.
    """
    a, b = _cols("a"), _cols("b")
    slim = ["short_id", "owner_id", "source_hash", "start_ms", "end_ms", "event_ms", "reuse_kind", "reuse_of_id", "reuse_reason"]
    prefix = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    same_owner = F.col("a_owner_id") == F.col("b_owner_id")
    allowed = ~(_reuse(a, b) | _reuse(b, a))

    left = prefix(with_time_blocks(pool.select(*slim)), "a")
    right = prefix(with_time_blocks(history.select(*slim)), "b")
    moment = left.join(
        right,
        same_owner & (F.col("a_source_hash") == F.col("b_source_hash")) & (F.col("a_block") == F.col("b_block"))
        & same_moment(a, b) & allowed,
        "left_semi",
    )
    # Bands hold the distinct frame lists of an owner and nothing else; evidence meets where lists are alike.
    lists = lambda df: df.select("owner_id", "frames").distinct()
    keyed, seen = prefix(with_frame_bands(lists(pool)), "a"), lists(history)
    rights = [prefix(with_frame_bands(seen), "b"), prefix(with_frame_bands(seen, against=pool), "b")]  # of equal and of other length
    meets = same_owner & (F.col("a_band") == F.col("b_band")) & (
        ev.clamped_index_similarity("a_frames", "b_frames") >= NEAR_VISUAL)
    alike = [keyed.join(r, meets).select(F.col("a_owner_id").alias("owner_id"), F.col("a_frames").alias("frames"), "b_frames") for r in rights]
    near = alike[0].unionByName(alike[1]).distinct()
    visual_fields = ["short_id", "owner_id", "concept_t", "v", "model", "norm", "reuse_kind", "reuse_of_id", "reuse_reason"]
    left = pool.select("frames", *visual_fields).join(near.withColumnRenamed("b_frames", "met"), ["owner_id", "frames"]).select("met", *visual_fields)
    right = history.select(F.col("frames").alias("met"), *visual_fields)
    visual = prefix(left, "a").join(
        prefix(right, "b"), same_owner & (F.col("a_met") == F.col("b_met")) & (semantic(a, b) >= NEAR_CONCEPT) & allowed, "left_semi")
    exact = pool.filter(F.col("render_hash").isNotNull()).join(
        history.select("owner_id", "render_hash").distinct(), ["owner_id", "render_hash"], "left_semi"
    )
    same = pool.join(history.select("owner_id", "short_id"), ["owner_id", "short_id"], "left_semi")
    ids = [moment.select(F.col("a_short_id").alias("short_id")), visual.select(F.col("a_short_id").alias("short_id")),
           exact.select("short_id"), same.select("short_id")]
    out = ids[0]
    for other in ids[1:]:
        out = out.unionByName(other)
    return out.distinct()


def history_anti_join(pool: DataFrame, history: DataFrame) -> DataFrame:
    return pool.join(history_conflicts(pool, history), "short_id", "left_anti")
