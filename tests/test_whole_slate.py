"""``plan_days`` searches the pairs of all safe items, in rounds that end as soon as no other pair can win."""

import random

import pytest

from cliploom.operators import planning
from cliploom.operators import similarity as sim

SCHEMA = (
    "short_id bigint, owner_id bigint, source_hash string, start_ms bigint, end_ms bigint, event_ms bigint, game string, event_type string, "
    "duration_s double, template string, tone string, frames array<string>, render_hash string, reuse_kind string, reuse_of_id bigint, "
    "reuse_reason string, hook_t array<bigint>, title_t array<bigint>, concept_t array<bigint>, transcript_t array<bigint>, "
    "objects_t array<bigint>, v array<double>, model string, norm double, hero double, discovery double, engagement double"
)


def clip(i, owner, source, at, hero, discovery, engagement, render=None, texts=()):
    t = list(texts)
    return (i, owner, source, at, at + 5000, at + 2000, f"g{i}", f"e{i % 7}", 10.0 + i, "T", "t", None, render, None, None, None,
            t, t, t, t, None, None, None, None, float(hero), float(discovery), float(engagement))


def test_the_best_pair_may_lie_beyond_the_first_hundred(spark):
    busy = [clip(i, 1, "busy", i * 100_000, 0, 90 - i / 100, 80 - i / 100) for i in range(130)]
    calm = [clip(200, 1, "calm", 0, 0, 50, 10), clip(201, 1, "quiet", 0, 0, 10, 50), clip(202, 1, "first", 0, 99, 0, 0)]
    past = [clip(1000 + i, 1, "busy", 50_000_000 + i * 100_000, 0, 0, 0) for i in range(60)]
    pool, history = spark.createDataFrame(busy + calm, SCHEMA), spark.createDataFrame(past, SCHEMA)
    assert pool.columns[:24] == sim.FIELDS
    row = planning.plan_days(pool, history, ["2024-02-01"]).first()
    assert (row.hero_id, row.discovery_id, row.engagement_id) == (202, 200, 201) and abs(row.score - 2100) < 1e-9
    short = planning.daily_slate(pool, history, pool.limit(0), pool.limit(0)).first()  # the published size of a single day
    assert (short.discovery_id, short.engagement_id) == (0, 1)


@pytest.mark.parametrize("most", [1, 2])
def test_rounds_find_what_all_pairs_hold(spark, monkeypatch, most):
    rng, rows, past = random.Random(40 + most), [], []
    for owner in (1, 2, 3):
        for k in range(24):
            i = owner * 100 + k
            rows.append(clip(
                i, owner, rng.choice(["a", "b", "c", "d", None]), rng.randint(0, 40) * 20_000, rng.randint(0, 9), rng.randint(0, 4), rng.randint(0, 4),
                f"r{rng.randint(0, 3)}" if owner < 3 else None, rng.sample(range(12), rng.randint(0, 6))))
        past += [clip(9000 + owner * 100 + k, owner, rng.choice("ab"), 90_000_000 + k * 90_000, 0, 0, 0) for k in range(9 * owner)]
    pool, history = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(past, SCHEMA)
    edge = history.filter("short_id % 100 = 0"), history.filter("short_id % 100 = 1")
    settings = {"max_source_per_day": most, "cooldown_ms": 100_000, "similarity_threshold": 0.45}
    monkeypatch.setattr(planning, "ROUND_PAIRS", (36, 150))
    whole = planning.plan_days(pool, history, ["2024-02-01"], *edge, settings)
    listed = planning.daily_slate(pool, history, *edge, settings | {"search_limit": 1000})
    columns = ["owner_id", "hero_id", "discovery_id", "engagement_id", "score"]
    got, want = (sorted(map(tuple, df.select(*columns).collect())) for df in (whole, listed))
    assert got == want and any(r[2] and r[3] for r in got)
