"""Text features, token sets and fixed-pattern classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliploom import config
from cliploom.functions.numeric import col


def tokens_unicode(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def tokens_ascii(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit(r"[a-z0-9]+"), F.lit(0)))


def set_cosine(a: Column, b: Column) -> Column:
    """|A∩B| / sqrt(|A||B|) on token sets, 0 when either is empty."""
    sizes = F.size(a).cast("double") * F.size(b)
    return F.when(sizes > 0, F.size(F.array_intersect(a, b)) / F.sqrt(sizes)).otherwise(0.0)


def set_overlap_max(a: Column, b: Column) -> Column:
    """|A∩B| / max(|A|,|B|) on token sets, 0 when either is empty."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def hook_type(text) -> Column:
    t = col(text)
    return (
        F.when(t.isNull(), "ACTION_FIRST")
        .when(t.contains("?"), "QUESTION")
        .when(t.rlike(r"[0-9]"), "NUMBER")
        .when(t.rlike(config.PICTOGRAPH_PATTERN), "REACTION")
        .when(t.rlike(config.CURIOSITY_PATTERN), "CURIOSITY")
        .otherwise("DIRECT")
    )


def has_pictograph(text) -> Column:
    return col(text).rlike(config.PICTOGRAPH_PATTERN)


def identify_game(filename) -> Column:
    """struct(game, edition, confidence, method) by the first matching pattern."""
    text = F.regexp_replace(F.lower(col(filename)), r"[-_.]+", " ")
    picked = None
    for pattern, game, edition in config.GAME_PATTERNS:
        value = F.struct(
            F.lit(game).alias("game"), F.lit(edition).cast("string").alias("edition"),
            F.lit(config.GAME_CONFIDENCE).alias("confidence"), F.lit("FILENAME").alias("method"),
        )
        picked = F.when(text.rlike(pattern), value) if picked is None else picked.when(text.rlike(pattern), value)
    return picked.otherwise(
        F.struct(
            F.lit("Unknown gameplay").alias("game"), F.lit(None).cast("string").alias("edition"),
            F.lit(0.0).alias("confidence"), F.lit("GENERIC").alias("method"),
        )
    )


def content_type(selected, filename, confidence) -> Column:
    """struct(type, method, confidence): user choice, then game, then podcast words, then gameplay."""
    make = lambda t, m, c: F.struct(
        (t if isinstance(t, Column) else F.lit(t)).alias("type"), F.lit(m).alias("method"), c.alias("confidence")
    )
    score = col(confidence).cast("double")
    return (
        F.when(col(selected) != "AUTO", make(col(selected), "USER", F.lit(1.0)))
        .when(score >= config.PROFILE_MIN_CONFIDENCE, make("GAMEPLAY", "FILENAME", score))
        .when(F.lower(col(filename)).rlike(config.PODCAST_PATTERN), make("PODCAST", "FILENAME", F.lit(0.65)))
        .otherwise(make("GAMEPLAY", "DEFAULT", F.lit(0.0)))
    )


def readable_event(event_type) -> Column:
    bare = F.regexp_replace(col(event_type), r"(?i)^(COD|FC|GTA|FORTNITE)[_-]+", "")
    spaced = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[_-]+", " "), r"\s+", " "))
    # every ASCII word start is raised, also after a bracket or an apostrophe; the rest keeps its case
    pieces = F.regexp_extract_all(spaced, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    raised = F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(raised, "")


def truthful_label(event_type) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(col(event_type), r"[_-]+", " "), r"\s+", " "))
    return F.upper(F.substring(F.when(text == "", "GAMEPLAY MOMENT").otherwise(text), 1, 48))


def clean_tag(value) -> Column:
    return F.concat(F.lit("#"), F.regexp_replace(F.lower(col(value)), r"[^a-z0-9_]", ""))


def tag_list(game, preferred: Column, banned: Column, limit: int = 6) -> Column:
    """Game tag, the two standing tags and the preferred ones; banned and empty ones dropped."""
    tags = F.array_distinct(F.concat(F.array(clean_tag(game), F.lit("#gaming"), F.lit("#shorts")), preferred))
    kept = F.filter(F.array_except(tags, banned), lambda t: F.length(t) > 1)
    kept = F.slice(kept, 1, limit)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("#gaming"), F.lit("#shorts")))


def hashtag_set(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(tags, F.lower)))


def joined_hash(*parts) -> Column:
    """sha256 of the parts joined by single spaces; null parts count as empty."""
    return F.sha2(F.concat_ws(" ", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def report_key(*parts) -> Column:
    return F.sha2(F.concat_ws("\u0000", *[col(p).cast("string") for p in parts]), 256)


def finding_text(segment, lift, window) -> Column:
    w = col(window)
    return F.concat(
        col(segment), F.lit(" is associated with "), F.format_string("%.1f", F.abs(col(lift))), F.lit("% "),
        F.when(col(lift) >= 0, "above").otherwise("below"), F.lit("-baseline performance in the "),
        F.when(w == "lifetime", "captured lifetime").otherwise(F.concat(w, F.lit("-day"))), F.lit(" window."),
    )


def template_key(crop, has_replay, has_zoom) -> Column:
    return F.concat(
        col(crop), F.lit(":"),
        F.when(col(has_replay), "REPLAY").when(col(has_zoom), "ZOOM").otherwise("CLEAN"),
    )
