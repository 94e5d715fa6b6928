"""Policies as tables: ordered rules of patterns, needs and least confidences, so a user changes behaviour by adding rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom import config

#: Rules of one policy; a table beyond it is an error, for it would no longer compile into one projection.
MAX_RULES = 1000

CLUSTERING = "ordinal double, policy_id string, game_re string, event_re string, gap_ms int, minimum double"
GAMES = "ordinal double, filename_re string, game string, edition string"
DETECTORS = "ordinal double, profile string, game_re string, minimum double, needs array<string>, event_type string"


def clustering_rules(spark: SparkSession) -> DataFrame:
    """The published clustering policies; the last one fits everything."""
    *named, (name, _, _, gap, _) = config.CLUSTERING_PROFILES
    rows = [(float(n), i, game, event, ms, low) for n, (i, game, event, ms, low) in enumerate(named)]
    return spark.createDataFrame([*rows, (float(len(named)), name, None, None, gap, None)], CLUSTERING)


def game_rules(spark: SparkSession) -> DataFrame:
    """The published patterns of game names over file names whose separators are blanks."""
    return spark.createDataFrame([(float(n), *row) for n, row in enumerate(config.GAME_PATTERNS)], GAMES)


def detector_rules(spark: SparkSession) -> DataFrame:
    """Event types by game and kinds of signals; a profile's last rule needs no kind."""
    rows = []
    for name, words, types, fallback, *_ in config.DETECTOR_PROFILES:
        for needs, outcome in [*types, ([], fallback)]:
            rows.append((float(len(rows)), name, "|".join(words), config.PROFILE_MIN_CONFIDENCE, needs, outcome))
    return spark.createDataFrame(rows, DETECTORS)


def first_rule(
    rules: DataFrame, values: list[str], patterns: dict[str, Column] | None = None, minimum: Column | None = None,
    needs: Column | None = None,
) -> Column:
    """struct of ``values`` of the first rule by ``ordinal`` that fits, null if none does.

    ``patterns`` names the rules' pattern column for each text, compared in lower case; ``minimum`` is held against the rules'
    column of that name, ``needs`` is the array that must hold all of theirs. A null in a rule asks for nothing; a null in
    the data fits only such rules. Equal ordinals go by the order of the other columns. The rules are counted,
    gathered and compiled into one projection with constant patterns: rows neither move nor multiply."""
    found = rules.orderBy(*rules.columns).limit(MAX_RULES + 1).collect()
    if len(found) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = sorted(found, key=lambda r: r["ordinal"])
    types = {f.name: f.dataType for f in rules.schema}

    def fits(rule) -> Column:
        asked = [F.lower(text).rlike(rule[name]) for name, text in (patterns or {}).items() if rule[name] is not None]
        if minimum is not None and rule["minimum"] is not None:
            asked.append(minimum >= rule["minimum"])
        asked += [F.array_contains(needs, kind) for kind in (rule["needs"] or [])] if needs is not None else []
        return reduce(lambda a, b: a & b, asked, F.lit(True))

    none = F.lit(None).cast("struct<" + ",".join(f"{v}:{types[v].simpleString()}" for v in values) + ">")
    picked = [F.when(fits(r), F.struct(*[F.lit(r[v]).cast(types[v]).alias(v) for v in values])) for r in found]
    return F.coalesce(*picked, none)


def game_of(filename: Column, rules: DataFrame) -> Column:
    """struct(game, edition) of a file name by ``rules``."""
    return first_rule(rules, ["game", "edition"], {"filename_re": F.regexp_replace(filename, r"[-_.]+", " ")})


def clustering_of(game: Column, event_type: Column, confidence: Column, rules: DataFrame) -> Column:
    """struct(policy_id, gap_ms) of an event by ``rules``."""
    return first_rule(rules, ["policy_id", "gap_ms"], {"game_re": game, "event_re": event_type}, confidence)


def detected_type(game: Column, confidence: Column, kinds: Column, rules: DataFrame) -> Column:
    """struct(profile, event_type) of an event by ``rules``; null where no profile takes the game."""
    return first_rule(rules, ["profile", "event_type"], {"game_re": game}, confidence, kinds)
