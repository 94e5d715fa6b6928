"""Hash, vector and interval similarity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliploom.functions.numeric import col


def _half(hash_col: Column, start: int) -> Column:
    return F.conv(F.substring(hash_col, start, 8), 16, 10).cast("bigint")


def hamming_similarity(a, b) -> Column:
    """1 - differing bits / 64 of two 16-digit hex hashes; anything else scores 0."""
    x, y = col(a), col(b)
    bits = F.bit_count(_half(x, 1).bitwiseXOR(_half(y, 1))) + F.bit_count(_half(x, 9).bitwiseXOR(_half(y, 9)))
    fine = x.rlike("^[0-9a-fA-F]{16}$") & y.rlike("^[0-9a-fA-F]{16}$")
    return F.when(fine, F.lit(1.0) - bits / 64).otherwise(0.0)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def clamped_index_similarity(a, b) -> Column:
    """Mean over the left list against the same index on the right (last one repeats)."""
    x, y = col(a), col(b)
    pairs = F.transform(x, lambda h, i: hamming_similarity(h, F.get(y, F.least(i, F.size(y) - 1))))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), mean_of(pairs))


def sequence_similarity(a, b) -> Column:
    """Mean over the shorter list against the longer list resampled to its length."""
    x, y = col(a), col(b)
    swap = F.size(x) > F.size(y)
    short, long = F.when(swap, y).otherwise(x), F.when(swap, x).otherwise(y)
    spread = F.greatest(F.lit(1), F.size(short) - 1)
    pairs = F.transform(
        short,
        lambda h, i: hamming_similarity(
            h, F.get(long, F.floor(i / spread * (F.size(long) - 1) + F.lit(0.5)).cast("int"))
        ),
    )
    return F.when((F.size(x) > 0) & (F.size(y) > 0), mean_of(pairs))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a, b) -> Column:
    """Cosine clamped to 0..1; null when the dimensions differ or a vector is missing."""
    x, y = col(a), col(b)
    value = dot(x, y) / F.greatest(F.lit(1e-12), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
    usable = (F.size(x) > 0) & (F.size(x) == F.size(y))
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def overlap_ms(a_start, a_end, b_start, b_end) -> Column:
    """Shared length of two spans; null when a border is missing."""
    known = col(a_start).isNotNull() & col(a_end).isNotNull() & col(b_start).isNotNull() & col(b_end).isNotNull()
    return F.when(known, F.greatest(
        F.lit(0).cast("bigint"), F.least(col(a_end), col(b_end)) - F.greatest(col(a_start), col(b_start))
    ))


def overlap_of_shorter(a_start, a_end, b_start, b_end, floor_ms: int = 10) -> Column:
    shorter = F.least(col(a_end) - col(a_start), col(b_end) - col(b_start))
    return overlap_ms(a_start, a_end, b_start, b_end) / F.greatest(F.lit(floor_ms).cast("bigint"), shorter)


def interval_iou(a_start, a_end, b_start, b_end) -> Column:
    union = F.greatest(col(a_end), col(b_end)) - F.least(col(a_start), col(b_start))
    return overlap_ms(a_start, a_end, b_start, b_end) / F.greatest(F.lit(1).cast("bigint"), union)


def dhash_hex(pixels) -> Column:
    """64-bit difference hash of a row-major 9x8 grey frame, as 16 hex digits."""
    p = col(pixels)

    def row_nibbles(y: int, half: int) -> Column:
        bits = [
            F.when(F.get(p, F.lit(y * 9 + x)) > F.get(p, F.lit(y * 9 + x + 1)), 1 << (3 - (x - half * 4))).otherwise(0)
            for x in range(half * 4, half * 4 + 4)
        ]
        return F.lower(F.hex(bits[0] + bits[1] + bits[2] + bits[3]))

    return F.when(F.size(p) >= 72, F.concat(*[row_nibbles(y, half) for y in range(8) for half in (0, 1)]))


def frame_difference(current, previous, stride: int = 4) -> Column:
    """Mean absolute luma difference of every ``stride``-th pixel, scaled to 0..1."""
    gaps = F.zip_with(col(current), col(previous), lambda a, b: F.abs(a - b))
    picked = F.filter(gaps, lambda v, i: i % stride == 0)
    return F.aggregate(picked, F.lit(0.0), lambda s, v: s + v) / F.size(picked) / 255
