"""Rounding, bounds, buckets and scoring expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliploom import config


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def half_up(value, digits: int = 0) -> Column:
    """floor(x + 0.5) at ``digits`` decimals; negative ties go up."""
    scale = float(10**digits)
    return F.floor(col(value) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def bounded(value, low: float = 0.0, high: float = 100.0) -> Column:
    """The value kept inside the bounds; null stays null (``least`` and ``greatest`` alone skip nulls)."""
    v = col(value)
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def ratio(numerator, denominator) -> Column:
    """Null instead of an error when the denominator is 0 or null."""
    bottom = col(denominator)
    return col(numerator) / F.when(bottom != 0, bottom)


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def bucket(value, edges: list[tuple[float, str]], last: str, inclusive: bool = False) -> Column:
    """First label whose edge is above (or equal to) the value; null stays null."""
    v = col(value)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for edge, label in edges:
        out = out.when(v <= edge if inclusive else v < edge, label)
    return out.otherwise(last)


def learning_bucket(seconds) -> Column:
    return bucket(seconds, [(14, "Under 14s"), (23, "14–22s"), (40, "23–39s")], "40s+")


def attribution_bucket(seconds) -> Column:
    return F.coalesce(bucket(seconds, [(20, "Under 20s"), (40, "20–39s")], "40s+"), F.lit("Unknown duration"))


def duration_class(seconds) -> Column:
    return bucket(
        seconds, [(12, "MICRO"), (20, "QUICK"), (35, "STANDARD"), (50, "STORY")], "EXTENDED", inclusive=True
    )


def confidence_level(sample, lift, minimum: int = config.MIN_SAMPLE) -> Column:
    n, size = col(sample), F.abs(col(lift))
    return (
        F.when((n >= minimum * 4) & (size >= 15), "HIGH")
        .when((n >= minimum * 2) & (size >= 10), "MEDIUM")
        .otherwise("LOW")
    )


def recommendation_delta(lift, limit: float = config.MAX_ADJUSTMENT) -> Column:
    return half_up(bounded(col(lift) / 200, -limit, limit), 3)


def recommendation_direction(lift) -> Column:
    return F.when(col(lift) >= 0, "INCREASE").otherwise("DECREASE")


def score_components(views, engaged, avg_pct, shares, subs, age_hours) -> dict[str, Column]:
    v = col(views)
    per_view = lambda c, k: F.when(v != 0, F.coalesce(bounded(col(c) / v * k), F.lit(0.0))).otherwise(0.0)
    return {
        "retention": F.coalesce(bounded(avg_pct), F.lit(0.0)),
        "engaged_views": per_view(engaged, 125.0),
        "shares": per_view(shares, 10_000.0),
        "subscribers": per_view(subs, 20_000.0),
        "velocity": F.coalesce(bounded(v / F.greatest(F.lit(1), col(age_hours)) * 2), F.lit(0.0)),
    }


def outcome_score(components: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    weights = weights or config.SCORE_COMPONENT_WEIGHTS
    return half_up(total([components[key] * F.lit(weight) for key, weight in weights.items()]), 2)


def weights_valid(columns: list) -> Column:
    values = [col(c) for c in columns]
    inside = reduce(lambda a, b: a & b, [(v >= 0) & (v <= 1) for v in values])
    return F.coalesce(inside & (F.abs(total(values) - 1) < 0.001), F.lit(False))


def hero_score(c: dict | None = None) -> Column:
    g = lambda k: F.coalesce(col((c or {}).get(k, k)).cast("double"), F.lit(0.0))
    predicted = F.coalesce(col((c or {}).get("predicted", "predicted")).cast("double"), g("highlight"))
    return (
        g("highlight") * 0.2 + predicted * 0.1 + g("hook_potential") * 0.15 + g("retention") * 0.15
        + g("emotional") * 0.1 + g("novelty") * 0.1 + g("share") * 0.1 + g("quality") * 0.1
    )


def discovery_score(c: dict | None = None) -> Column:
    g = lambda k: F.coalesce(col((c or {}).get(k, k)).cast("double"), F.lit(0.0))
    return (
        g("context") * 0.35 + g("clarity") * 0.2 + g("surprise") * 0.2 + g("humor") * 0.15
        + F.greatest(F.lit(0.0), F.lit(100.0) - g("duration_s") * 2) * 0.1
    )


def engagement_score(c: dict | None = None) -> Column:
    g = lambda k: F.coalesce(col((c or {}).get(k, k)).cast("double"), F.lit(0.0))
    return g("share") * 0.35 + g("emotional") * 0.25 + g("humor") * 0.2 + g("tension") * 0.2


def token_cost(input_tokens, output_tokens, input_price: float, output_price: float) -> Column:
    if input_price <= 0 and output_price <= 0:
        return F.lit(None).cast("double")
    return (col(input_tokens) * input_price + col(output_tokens) * output_price) / 1_000_000


def logprob_confidence(avg_logprob) -> Column:
    return bounded(F.exp(col(avg_logprob)), 0.0, 1.0)


def deterministic_arm(seed, allocation) -> Column:
    """FNV-1a 32 bit of the seed's characters (one unit each), as a share of 2**32, below the allocation; null is 0."""
    digits = F.transform(F.split(col(seed), ""), lambda ch: F.ascii(ch).cast("bigint"))
    hashed = F.aggregate(
        digits,
        F.lit(2166136261).cast("bigint"),
        # 16777619 = 2**24 + 403: two partial products keep every step inside 64 bits.
        lambda h, ch: ((h.bitwiseXOR(ch)) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")),
    )
    share = hashed / F.lit(4294967296.0)
    return F.when(share < F.coalesce(bounded(allocation, 0.0, 0.5), F.lit(0.0)), "VARIANT").otherwise("CONTROL")
