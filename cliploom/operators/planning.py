"""Role scores, daily slates, calendars and publication gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import config
from cliploom.functions import times
from cliploom.functions.numeric import discovery_score, engagement_score, hero_score
from cliploom.operators import similarity as sim
from cliploom.operators.reporting import first_per_key
from cliploom.session import cut_lineage, small_or_keyed

SETTINGS = {"similarity_threshold": 0.6, "max_source_per_day": 3, "cooldown_ms": 0, "search_limit": 100}
ROLE_COLUMNS = ["hero", "discovery", "engagement"]


def with_role_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("hero", hero_score()).withColumn("discovery", discovery_score()).withColumn(
        "engagement", engagement_score()
    )


def tone_argmax(scores: list[str]) -> Column:
    """Name of the highest score; the earlier name wins ties, missing counts as 0."""
    ranked = F.array(*[
        F.struct(F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias("v"), F.lit(-i).alias("i"), F.lit(s).alias("name"))
        for i, s in enumerate(scores)
    ])
    return F.array_max(ranked)["name"]


def eligible_pool(items: DataFrame, renders: DataFrame) -> DataFrame:
    good = renders.filter("state = 'READY' AND preset = 'HIGH'").select("short_id")
    return items.filter(
        "state = 'READY' AND publishable AND analysis_method = 'AI' AND review_state <> 'REJECTED'"
    ).join(good, "short_id", "left_semi")


def autopilot_ready(quality_min: int, confidence_min: int, highlight_min: int, enabled) -> Column:
    """Approved, or pending under autopilot with all three minima met."""
    scores = (
        (F.col("quality") >= quality_min) & (F.col("confidence") >= confidence_min) & (F.col("highlight") >= highlight_min)
    )
    return (F.col("review_state") == "APPROVED") | ((F.col("review_state") == "PENDING") & enabled & scores)


def latest_render(renders: DataFrame) -> DataFrame:
    """Newest render of each item."""
    order = [F.col("created_at").desc(), F.col("render_rank").desc()]
    return first_per_key(renders, ["short_id"], order)


def preferred_render(renders: DataFrame) -> DataFrame:
    """The newest READY HIGH render, else the newest READY one."""
    ready = renders.filter("state = 'READY'")
    order = [(F.col("preset") == "HIGH").desc(), F.col("created_at").desc(), F.col("render_rank").desc()]
    return first_per_key(ready, ["short_id"], order)


def publication_preflight(slots: DataFrame, items: DataFrame, renders: DataFrame, rights: DataFrame, now: Column) -> DataFrame:
    """Failed preflight rules per reserved slot; an empty list means it may be scheduled."""
    newest = latest_render(renders).select(
        "short_id", F.col("state").alias("render_state"), F.col("preset").alias("render_preset"),
        F.col("qty").alias("render_bytes"), F.col("sha_no"), F.col("store_no"),
    )
    joined = (
        slots.filter(F.col("short_id").isNotNull()).join(items.drop("owner_id"), "short_id")
        .join(newest, "short_id", "left").join(rights, "source_id", "left")
    )
    rules = {
        "state": F.col("state") == "READY", "render": F.col("render_state") == "READY",
        "stored": F.col("store_no").isNotNull(), "hash": F.col("sha_no").isNotNull(), "bytes": F.col("render_bytes") > 0,
        "preset": F.col("render_preset") == "HIGH", "publishable": F.col("publishable"),
        "method": F.col("analysis_method") == "AI", "rights": F.col("rights_ok"),
        "approved": autopilot_ready(50, 40, 45, F.lit(True)),
        "lead": F.unix_micros("planned_at") >= F.unix_micros(now) + 600_000_000,
    }
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]))
    return joined.select("slot_id", "short_id", failed.alias("failed"))


def publication_gate(publications: DataFrame, paused: DataFrame) -> DataFrame:
    """Publications that may advance: not paused, or a cancellation."""
    joined = publications.join(paused, "owner_id", "left")
    return joined.filter(~F.coalesce("paused", F.lit(False)) | F.col("cancel_requested")).drop("paused")


def adjacent_slots(slots: DataFrame, day: str) -> DataFrame:
    """Last reserved item before the day and first one after it, per owner."""
    d = F.lit(day).cast("date")
    held = slots.filter(F.col("short_id").isNotNull())
    place = F.struct("planned_at", "slot_id")
    return held.groupBy("owner_id").agg(
        F.max_by("short_id", F.when(F.col("local_date") < d, place)).alias("previous_id"),
        F.min_by("short_id", F.when(F.col("local_date") > d, place)).alias("next_id"),
    )


def horizon_plan_dates(
    settings: DataFrame, slots: DataFrame, runs: DataFrame, now: Column, per_day: int = 3
) -> DataFrame:
    """Buffer days to plan: first slot still ahead, not fully reserved, no active run and none in the last hour."""
    today = times.local_date(now, F.col("timezone"))
    days = settings.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("buffer_days") - 1)).alias("__d"), today.alias("__today")
    ).withColumn("local_date", F.date_add("__today", F.col("__d")))
    ahead = days.withColumn("first_slot", times.slot_instant("local_date", F.col("first_time"), F.col("timezone"))).filter(
        F.col("first_slot") > now
    )
    full = slots.groupBy("owner_id", "local_date").agg(
        F.count_if(F.col("short_id").isNotNull()).alias("__held"), F.count("*").alias("__all")
    ).filter((F.col("__held") == F.col("__all")) & (F.col("__all") >= per_day))
    hour_ago = now - F.expr("INTERVAL 1 HOUR")
    busy = runs.filter(F.col("state").isin(config.ACTIVE_STATES) | (F.col("created_at") > hour_ago))
    keys = ["owner_id", "local_date"]
    return ahead.join(full.select(*keys), keys, "left_anti").join(busy.select(*keys), keys, "left_anti").select(
        *keys, "first_slot"
    )


def campaign_day_requests(campaigns: DataFrame, runs: DataFrame, days: int = 30) -> DataFrame:
    """Campaign days without a live or finished planning run."""
    spine = campaigns.select(
        "campaign_id", "owner_id",
        F.explode(F.sequence("start_date", F.date_add("start_date", days - 1))).alias("local_date"),
    )
    live = runs.filter(F.col("state").isin(*config.ACTIVE_STATES, "SUCCEEDED")).select("owner_id", "local_date")
    return spine.join(live, ["owner_id", "local_date"], "left_anti")


def reserved_unpublished(slots: DataFrame, publications: DataFrame) -> DataFrame:
    live = publications.filter("state <> 'CANCELLED'").select("short_id")
    return slots.filter(F.col("short_id").isNotNull()).join(live, "short_id", "left_anti")


def frozen_slot_invalidate(slots: DataFrame, publications: DataFrame, now: Column) -> DataFrame:
    """Future reserved slots without a live publication lose their item, score and reason."""
    frozen = publications.filter("state <> 'CANCELLED'").select("short_id").distinct().withColumn("__frozen", F.lit(True))
    joined = slots.join(frozen, "short_id", "left")
    reset = (F.col("planned_at") > now) & F.col("short_id").isNotNull() & F.col("__frozen").isNull()
    return joined.select(
        *[c for c in slots.columns if c != "short_id"],
        F.when(~reset, F.col("short_id")).alias("short_id"), reset.alias("invalidated"),
    )


def archive_on_reanalysis(items: DataFrame, slots: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of re-analysed sources are archived and leave their slots."""
    hit = items.join(sources.select("source_id"), "source_id", "left_semi").select("short_id", F.lit(True).alias("__hit"))
    archived = items.join(hit, "short_id", "left").withColumns({
        "state": F.when(F.col("__hit"), "ARCHIVED").otherwise(F.col("state")),
        "publishable": F.when(F.col("__hit"), False).otherwise(F.col("publishable")),
    }).drop("__hit")
    return archived, slots.join(hit.select("short_id"), "short_id", "left_anti")


def campaign_range_join(campaigns: DataFrame, publications: DataFrame) -> DataFrame:
    """Publications whose local date lies in a campaign of their owner."""
    pubs = publications.select("owner_id", "publication_id", "publish_at", "state")
    return campaigns.join(pubs, "owner_id").withColumn(
        "local_date", times.local_date("publish_at", F.col("timezone"))
    ).filter(F.col("local_date").between(F.col("start_date"), F.col("end_date")))


#: What the choice needs of an item besides the evidence for comparisons.
SLIM = ["owner_id", "short_id", "source_hash", "event_ms", *ROLE_COLUMNS]


def _verdict(pairs: DataFrame, keep: list[str], threshold: float) -> DataFrame:
    """Reduce each pair of sides to dup, ok (may stand side by side) and exc."""
    return sim.compared(pairs, name="v").select(
        *keep, F.col("v.duplicate").alias("dup"), F.col("v.exception").alias("exc"),
        (~F.col("v.duplicate") & (F.col("v.score") <= threshold)).alias("ok"),
    )


def _compare_ids(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Verdicts of (l, r) id pairs; only the evidence of items in a pair moves."""
    pairs = cut_lineage(pairs)
    asked = pairs.select(F.col("l").alias("short_id")).union(pairs.select("r")).distinct()
    told = cut_lineage(items.join(small_or_keyed(asked), "short_id", "left_semi"))
    joined = pairs.join(sim.side(told, "a"), F.col("l") == F.col("a_short_id")).join(
        sim.side(told, "b"), F.col("r") == F.col("b_short_id")
    )
    return _verdict(joined, pairs.columns, threshold)


def _beside(items: DataFrame, around: DataFrame, before: bool, threshold: float) -> DataFrame:
    """(short_id, ok): may each item stand after (``before``: the neighbour comes first) or ahead of its owner's one neighbour
    in ``around``? Neighbours are one row per owner and go to the items."""
    one = small_or_keyed(around.select(*sim.FIELDS))
    mine, other = ("b", "a") if before else ("a", "b")
    joined = sim.side(items, mine).join(sim.side(one, other), (F.col("a_owner_id") == F.col("b_owner_id")) & (F.col("a_short_id") != F.col("b_short_id")))
    return _verdict(joined, [f"{mine}_short_id"], threshold).select(F.col(f"{mine}_short_id").alias("short_id"), "ok")


def _blocked(dup: Column, exc: Column, same: Column, gap: Column, settings: dict) -> Column:
    """A duplicate, or the same source within the cooldown without a reuse exception."""
    return dup | (same & (gap < settings["cooldown_ms"]) & ~exc)


def daily_slate(
    pool: DataFrame, history: DataFrame, previous: DataFrame, following: DataFrame, settings: dict | None = None
) -> DataFrame:
    """One day's HERO, DISCOVERY and ENGAGEMENT choice per owner, all owners at once.

    ``pool`` carries the comparison fields and role scores; ``previous`` and
    ``following`` hold at most one neighbouring item per owner. The pair search
    is over the best ``search_limit`` of each role (100, the published search size), plus "none".
    Comparisons take two passes: every item where it lies with its owner's neighbours
    (linear in the pool), then the role lists with HERO and each other, paired on ids.
    The slim results of both passes are checkpointed: each is read several times,
    and neither the conflict search nor the comparisons should run again for that.
    """
    safe = cut_lineage(sim.history_anti_join(pool, history).select(*SLIM))
    return _chosen(pool, pool.select("owner_id").distinct(), safe, _usage(history), previous, following, settings)


def _usage(items: DataFrame) -> DataFrame:
    return items.groupBy("owner_id", "source_hash").agg(F.count("*").alias("used"))


def _fits_hero(rows: DataFrame, frame: DataFrame, verdicts: DataFrame, settings: dict) -> DataFrame:
    """Keep what fits HERO; ``tail_ok`` tells whether the item may come last before HERO or NEXT."""
    joined = rows.join(frame, "owner_id").join(verdicts, ["short_id", "h_id"], "left")
    has = F.col("h_id").isNotNull()
    same = F.coalesce(F.col("h_source") == F.col("source_hash"), F.lit(False))
    clash = (F.col("h_id") == F.col("short_id")) | _blocked(
        F.col("dup"), F.col("exc"), same, F.abs(F.col("h_event") - F.col("event_ms")), settings)
    full = same & F.lit(settings["max_source_per_day"] <= 1)
    return joined.filter(~has | ~(F.coalesce(clash, F.lit(False)) | full)).select(
        "owner_id", "short_id", "source_hash", "event_ms", *[c for c in ("place",) if c in rows.columns], "score", "used", "p_ok",
        F.when(has, F.col("ok")).otherwise(F.col("n_ok")).alias("tail_ok"), same.alias("hero_source"),
    )


#: Pairs that a round of the whole search adds for an owner: first, and at most later. More rounds, not larger ones, end a search.
ROUND_PAIRS = (10_000, 65_536)
#: Order of equal scores: the better DISCOVERY, then the better ENGAGEMENT, none last, of equals the least id.
_PLACE = ["score", "d_score", "d_order", "e_score", "e_order"]
_OPTION = ["owner_id", "d_id", "e_id", *_PLACE]


def _best_option(options: DataFrame) -> DataFrame:
    place = F.struct(*_PLACE)
    return cut_lineage(options.groupBy("owner_id").agg(*[F.max_by(c, place).alias(c) for c in _OPTION[1:]]))


def _best_of_all(pool: DataFrame, everyone: DataFrame, listed: DataFrame, hero: DataFrame, frame: DataFrame, settings: dict) -> DataFrame:
    """(owner_id, d_id, e_id, score): the best choice beside HERO among all ``listed`` items.

    Exact without all pairs: single items first, then pairs in rounds over the best items of each role, until no pair left can
    reach the best choice found (``_pairs_in_rounds``); pairs of different sources, then those of one source, whose use
    counts once."""
    one = small_or_keyed(pool.join(hero.select(F.col("h_id").alias("short_id")), "short_id", "left_semi").select(*sim.FIELDS))
    joined = sim.side(pool, "a").join(sim.side(one, "b"), (F.col("a_owner_id") == F.col("b_owner_id")) & (F.col("a_short_id") != F.col("b_short_id")))
    beside = cut_lineage(_verdict(joined, ["a_short_id", "b_short_id"], settings["similarity_threshold"]).select(
        F.col("a_short_id").alias("short_id"), F.col("b_short_id").alias("h_id"), "dup", "exc", "ok"))
    d, e = (_fits_hero(listed.withColumn("score", F.col(name)), frame, beside, settings) for name in ("discovery", "engagement"))
    d, e = cut_lineage(d.filter("p_ok")), cut_lineage(e.filter("tail_ok"))
    none, low = F.lit(None).cast("bigint"), F.lit(float("-inf"))
    after = F.lit(-(2**63)).cast("bigint")

    def option(rows: DataFrame, d_id: Column, e_id: Column, score: Column, d_score: Column, e_score: Column) -> DataFrame:
        order = lambda x: F.coalesce(-x, after)
        return rows.select("owner_id", d_id.alias("d_id"), e_id.alias("e_id"), score.alias("score"), d_score.alias("d_score"),
                           order(d_id).alias("d_order"), e_score.alias("e_score"), order(e_id).alias("e_order"))

    score, item = F.lit(1000.0) + F.col("score") - F.col("used") * 3, F.col("short_id")
    best = _best_option(
        option(d.filter("tail_ok"), item, none, score, F.col("score"), low)
        .unionByName(option(e.filter("p_ok"), none, item, score, low, F.col("score")))
        .unionByName(option(frame.filter(F.when(F.col("h_id").isNotNull(), F.col("ph_ok")).otherwise(F.col("pn_ok"))), none, none, F.lit(0.0), low, low))
    )
    left = d.select("owner_id", *[F.col(c).alias(f"d_{c}") for c in ("short_id", "source_hash", "event_ms", "score", "used")])
    right = e.select("owner_id", *[F.col(c).alias(f"e_{c}") for c in ("short_id", "source_hash", "event_ms", "score", "used", "hero_source")])
    left = left.withColumn("d_worth", F.lit(2000.0) + F.col("d_score") - F.col("d_used") * 3)
    same = F.col("d_source_hash") == F.col("e_source_hash")

    def judged(pairs: DataFrame) -> DataFrame:
        verdicts = _compare_ids(pairs.select(F.col("d_short_id").alias("l"), F.col("e_short_id").alias("r")).distinct(), everyone, settings["similarity_threshold"])
        seen = pairs.join(verdicts.withColumnsRenamed({"l": "d_short_id", "r": "e_short_id"}), ["d_short_id", "e_short_id"])
        apart = ~_blocked(F.col("dup"), F.col("exc"), same, F.abs(F.col("d_event_ms") - F.col("e_event_ms")), settings)
        usage = F.col("d_used") + F.when(same, 0).otherwise(F.col("e_used"))
        return option(seen.filter(apart & F.col("ok")), F.col("d_short_id"), F.col("e_short_id"),
                      F.lit(2000.0) + F.col("d_score") + F.col("e_score") - usage * 3, F.col("d_score"), F.col("e_score"))

    room = lambda taken: F.lit(taken) + F.col("e_hero_source").cast("int") < settings["max_source_per_day"]
    worth = F.col("e_score") - F.col("e_used") * 3
    best = _pairs_in_rounds(left, right.filter(room(0)).withColumn("e_worth", worth), ["owner_id"], ~same, judged, best)
    if settings["max_source_per_day"] > 1:
        here = left.withColumn("source_hash", F.col("d_source_hash")).filter("source_hash IS NOT NULL")
        there = right.filter(room(1)).withColumns({"e_worth": F.col("e_score"), "source_hash": F.col("e_source_hash")})
        best = _pairs_in_rounds(here, there, ["owner_id", "source_hash"], same, judged, best)
    return best.select("owner_id", "d_id", "e_id", "score")


def _pairs_in_rounds(left: DataFrame, right: DataFrame, by: list[str], meet: Column, judged, best: DataFrame) -> DataFrame:
    """The best options with those of all pairs of ``left`` and ``right`` within ``by`` that ``meet``, judged in rounds.

    A pair is worth ``d_worth + e_worth``. A round takes the pairs of a key's best items by worth on both sides that are new and
    may reach the owner's best option; the next takes more items, where a pair with one not taken yet may still reach it."""
    slack = 1e-6  # for sums in another order
    order = lambda w, i: [F.col(w).desc(), F.col(i)]
    tops = left.groupBy(*by).agg(F.max("d_worth").alias("d_top")).join(right.groupBy(*by).agg(F.max("e_worth").alias("e_top")), by)
    reach = lambda worth: F.col("b_score").isNull() | (worth + slack >= F.col("b_score"))
    scored = lambda: best.select("owner_id", F.col("score").alias("b_score"))
    tops = cut_lineage(tops)
    waiting, done, area = tops.select(*by), 0, 0
    while True:
        open_ = cut_lineage(tops.join(waiting, by, "left_semi").join(scored(), "owner_id", "left").filter(reach(F.col("d_top") + F.col("e_top"))))
        if open_.isEmpty():
            return best
        area += max(ROUND_PAIRS[0], min(ROUND_PAIRS[1], area))
        size = int(area**0.5)
        # of the rows that may reach the best option with the other side's best, the first ``size`` and the next
        some = lambda rows, mine, other, i, name: cut_lineage(first_per_key(
            rows.join(open_, by).filter(reach(F.col(mine) + F.col(other))).drop("d_top", "e_top"), by, order(mine, i), size + 1, rank=name))
        a, b = some(left, "d_worth", "e_top", "d_short_id", "d_rank"), some(right, "e_worth", "d_top", "e_short_id", "e_rank")
        pairs = a.filter(F.col("d_rank") <= size).join(b.filter(F.col("e_rank") <= size).drop("b_score"), by)
        fresh = pairs.filter(  # a better best option drops the last rows only, so ranks stay
            meet & (F.col("d_short_id") != F.col("e_short_id")) & (F.greatest("d_rank", "e_rank") > done) & reach(F.col("d_worth") + F.col("e_worth")))
        best = _best_option(best.unionByName(judged(fresh.drop("d_rank", "e_rank", "b_score"))))
        done = size
        waiting = cut_lineage(a.filter(F.col("d_rank") > size).select(*by).unionByName(b.filter(F.col("e_rank") > size).select(*by)).distinct())


def _chosen(
    pool: DataFrame, owners: DataFrame, safe: DataFrame, used: DataFrame, previous: DataFrame, following: DataFrame,
    settings: dict | None,
) -> DataFrame:
    """The choice of ``daily_slate`` for ``owners``, with the items known to be ``safe`` from their history and the number of
    items that the history ``used`` of each source. Where ``search_limit`` is None, all safe items are searched."""
    settings = {**SETTINGS, **(settings or {})}
    threshold = settings["similarity_threshold"]
    yes = F.lit(True)

    # Pass 1: neighbours. The item before the day is also held against the one after it.
    outside = previous.unionByName(following).dropDuplicates(["short_id"]).join(pool.select("short_id"), "short_id", "left_anti")
    everyone = pool.unionByName(outside)
    subjects = pool.unionByName(previous.join(pool.select("short_id"), "short_id", "left_anti"))
    p_ok, n_ok = _beside(subjects, previous, True, threshold), _beside(subjects, following, False, threshold)
    near = p_ok.select("short_id", F.col("ok").alias("p_ok"), F.lit(None).cast("boolean").alias("n_ok")).unionByName(
        n_ok.select("short_id", F.lit(None).cast("boolean").alias("p_ok"), F.col("ok").alias("n_ok"))
    ).groupBy("short_id").agg(F.min("p_ok").alias("p_ok"), F.min("n_ok").alias("n_ok"))
    near = cut_lineage(near)
    known = safe.join(near, "short_id", "left").withColumns(
        {"p_ok": F.coalesce("p_ok", yes), "n_ok": F.coalesce("n_ok", yes)}
    )
    gap_ok = previous.select("owner_id", "short_id").join(near, "short_id", "left").select(
        "owner_id", F.coalesce("n_ok", yes).alias("pn_ok")
    )

    hero = first_per_key(known.filter("n_ok"), ["owner_id"], [F.col("hero").desc(), F.col("short_id")]).select(
        "owner_id", F.col("short_id").alias("h_id"), F.col("source_hash").alias("h_source"),
        F.col("event_ms").alias("h_event"), F.col("p_ok").alias("ph_ok"),
    )
    frame = owners.select("owner_id").join(hero, "owner_id", "left").join(gap_ok, "owner_id", "left").withColumns(
        {"ph_ok": F.coalesce("ph_ok", yes), "pn_ok": F.coalesce("pn_ok", yes)}
    )

    listed = known.join(used, ["owner_id", "source_hash"], "left").withColumn("used", F.coalesce("used", F.lit(0).cast("bigint")))
    if settings["search_limit"] is None:
        return _outcome(frame, _best_of_all(pool, everyone, listed, hero, frame, settings))

    def role(score: str) -> DataFrame:
        return first_per_key(
            listed, ["owner_id"], [F.col(score).desc(), F.col("short_id")], settings["search_limit"], rank="place"
        ).withColumn("score", F.col(score))

    d, e = role("discovery"), role("engagement")

    # Pass 2: each listed item before HERO, and DISCOVERY before ENGAGEMENT.
    with_hero = d.select("owner_id", "short_id").unionByName(e.select("owner_id", "short_id")).distinct().join(
        hero.select("owner_id", "h_id"), "owner_id").select(F.col("short_id").alias("l"), F.col("h_id").alias("r"))
    together = d.select("owner_id", F.col("short_id").alias("l")).join(
        e.select("owner_id", F.col("short_id").alias("r")), "owner_id").select("l", "r")
    pairs = with_hero.unionByName(together).filter("l <> r").distinct()
    verdicts = cut_lineage(_compare_ids(pairs, everyone, threshold))

    with_hero = verdicts.select(F.col("l").alias("short_id"), F.col("r").alias("h_id"), "dup", "exc", "ok")
    d, e = (_fits_hero(rows, frame, with_hero, settings) for rows in (d, e))
    d = d.filter("p_ok")
    left = d.select("owner_id", *[F.col(c).alias(f"d_{c}") for c in d.columns if c != "owner_id"])
    right = e.select("owner_id", *[F.col(c).alias(f"e_{c}") for c in e.columns if c != "owner_id"])
    joint = left.join(right, "owner_id").join(
        verdicts.select(F.col("l").alias("d_short_id"), F.col("r").alias("e_short_id"), "dup", "exc", "ok"),
        ["d_short_id", "e_short_id"],
    )
    same = F.col("d_source_hash") == F.col("e_source_hash")
    apart = ~_blocked(F.col("dup"), F.col("exc"), same, F.abs(F.col("d_event_ms") - F.col("e_event_ms")), settings)
    filled = same.cast("int") + F.col("e_hero_source").cast("int")
    usage = F.col("d_used") + F.when(same, 0).otherwise(F.col("e_used"))
    nothing, none_place = F.lit(None).cast("bigint"), F.lit(settings["search_limit"] + 1)

    def outcome(rows: DataFrame, d_id: Column, e_id: Column, d_place: Column, e_place: Column, score: Column) -> DataFrame:
        return rows.select(
            "owner_id", d_id.alias("d_id"), e_id.alias("e_id"), d_place.alias("d_place"), e_place.alias("e_place"),
            score.alias("score"))

    options = outcome(
        joint.filter(apart & F.col("ok") & F.col("e_tail_ok") & (filled < settings["max_source_per_day"])),
        F.col("d_short_id"), F.col("e_short_id"), F.col("d_place"), F.col("e_place"),
        F.lit(2000.0) + F.col("d_score") + F.col("e_score") - usage * 3,
    ).unionByName(outcome(
        d.filter("tail_ok"), F.col("short_id"), nothing, F.col("place"), none_place,
        F.lit(1000.0) + F.col("score") - F.col("used") * 3,
    )).unionByName(outcome(
        e.filter("tail_ok AND p_ok"), nothing, F.col("short_id"), none_place, F.col("place"),
        F.lit(1000.0) + F.col("score") - F.col("used") * 3,
    )).unionByName(outcome(
        frame.filter(F.when(F.col("h_id").isNotNull(), F.col("ph_ok")).otherwise(F.col("pn_ok"))),
        nothing, nothing, none_place, none_place, F.lit(0.0),
    ))
    place = F.struct("score", -F.col("d_place"), -F.col("e_place"))
    return _outcome(frame, options.groupBy("owner_id").agg(
        F.max_by("d_id", place).alias("d_id"), F.max_by("e_id", place).alias("e_id"), F.max("score").alias("score")
    ))


def _outcome(frame: DataFrame, chosen: DataFrame) -> DataFrame:
    alone = F.col("d_id").isNull() & F.col("e_id").isNull() & ~F.col("ph_ok")
    return frame.join(chosen, "owner_id", "left").select(
        "owner_id", F.when(~alone, F.col("h_id")).alias("hero_id"), F.col("d_id").alias("discovery_id"),
        F.col("e_id").alias("engagement_id"), "score",
    )


def slate_rows(slates: DataFrame, scores: DataFrame, times_by_role: list[tuple[str, str]], day: str, zone: str) -> DataFrame:
    """Three role rows per owner with the planned instant, the role score and the reason."""
    told = {
        "HERO": "First choice by HeroScore; reserved before the other roles.",
        "DISCOVERY": "Immediate comprehension and fast payoff; passed duplicate, source distribution and adjacency checks.",
        "ENGAGEMENT": "Reaction and share potential; passed duplicate, source distribution and adjacency checks.",
    }
    missing = (
        "Missing: no eligible, distinct candidate meets this role and its neighboring slots. "
        "Add varied footage or review pending Shorts."
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.lit(at).alias("local_time"), F.col(f"{r.lower()}_id").alias("short_id"))
        for r, at in times_by_role
    ]))
    long = slates.select("owner_id", rows.alias("r")).select("owner_id", "r.*")
    joined = long.join(scores.select("short_id", *ROLE_COLUMNS), "short_id", "left")
    score, reason = F.lit(None).cast("double"), F.lit(missing)
    for name in told:
        here = (F.col("role") == name) & F.col("short_id").isNotNull()
        score = F.when(here, F.col(name.lower())).otherwise(score)
        reason = F.when(here, told[name]).otherwise(reason)
    return joined.select(
        "owner_id", "role", "local_time",
        times.slot_instant(F.lit(day).cast("date"), F.col("local_time"), zone).alias("planned_at"),
        "short_id", score.alias("score"), reason.alias("reason"),
    )


def plan_days(
    pool: DataFrame, history: DataFrame, days: list[str], previous: DataFrame | None = None, following: DataFrame | None = None,
    settings: dict | None = None, open_days: DataFrame | None = None,
) -> DataFrame:
    """Slates for consecutive days; each day's choices join the history of the next.

    ``open_days`` (owner_id, local_date), as from ``horizon_plan_dates``, tells which owners plan on which day; without it
    all do. The loop is over calendar days only, all owners at once. The whole history is searched once: what is safe from it
    stays so, and each day compares what is left with that day's choices alone, at most three per owner. ``previous`` of a day
    is the last choice made before it. Every safe item takes part in a day's search, unless ``settings`` name a ``search_limit``.
    """
    settings = {**SETTINGS, "search_limit": None, **(settings or {})}
    pool, nobody = cut_lineage(pool), pool.limit(0)
    previous = nobody if previous is None else previous
    following = nobody if following is None else following
    safe, used, out = cut_lineage(sim.history_anti_join(pool, history).select(*SLIM)), _usage(history), None
    for number, name in enumerate(days):
        owners = pool.select("owner_id").distinct()
        if open_days is not None:
            today = open_days.filter(F.col("local_date") == F.lit(name).cast("date"))
            owners = owners.join(today.select("owner_id"), "owner_id", "left_semi")
        able = safe.join(owners, "owner_id", "left_semi")
        slate = cut_lineage(_chosen(pool, owners, able, used, previous, following, settings).withColumn("local_date", F.lit(name).cast("date")))
        out = slate if out is None else out.unionByName(slate)
        if number == len(days) - 1:
            break
        taken = slate.select(F.explode(F.array_compact(F.array("hero_id", "discovery_id", "engagement_id"))).alias("short_id"))
        fresh = cut_lineage(pool.join(taken, "short_id", "left_semi"))
        left = pool.join(safe.select("short_id"), "short_id", "left_semi")
        safe = cut_lineage(safe.join(sim.history_conflicts(left, fresh), "short_id", "left_anti"))
        used = cut_lineage(used.unionByName(_usage(fresh)).groupBy("owner_id", "source_hash").agg(F.sum("used").alias("used")))
        last = slate.select(F.coalesce("hero_id", "engagement_id", "discovery_id").alias("short_id")).filter("short_id IS NOT NULL")
        latest = fresh.join(last, "short_id", "left_semi")
        previous = cut_lineage(previous.join(latest.select("owner_id"), "owner_id", "left_anti").unionByName(latest.select(*previous.columns)))
    return out


def evidence_objects(body: Column) -> Column:
    """Names in the ``objects`` list of a JSON document: its string elements, told by JSON type; null without the list."""
    listed = F.from_json(F.get_json_object(body, "$.objects"), "array<variant>")
    texts = F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(texts, lambda v: F.variant_get(v, "$", "string"))
