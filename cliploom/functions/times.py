"""Calendar, time zone and age expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliploom.functions.numeric import col


def instant(value) -> Column:
    return col(value).cast("timestamp")


def local_time(value, zone) -> Column:
    return F.from_utc_timestamp(instant(value), zone if isinstance(zone, Column) else F.lit(zone))


def local_date(value, zone) -> Column:
    return F.to_date(local_time(value, zone))


def utc_slot_label(value) -> Column:
    return F.concat(F.date_format(instant(value), "HH"), F.lit(":00 UTC"))


def age_minutes(value, now: Column) -> Column:
    micros = F.unix_micros(now) - F.unix_micros(instant(value))
    return F.greatest(F.lit(0).cast("bigint"), F.floor(micros / 60_000_000).cast("bigint"))


def valid_date(text) -> Column:
    """True when the text is exactly a real YYYY-MM-DD date."""
    parsed = F.try_to_date(col(text), "yyyy-MM-dd")
    return F.coalesce(
        col(text).rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(parsed, "yyyy-MM-dd") == col(text)), F.lit(False)
    )


def slot_instant(date, time, zone) -> Column:
    """UTC instant of a local wall time, null when that wall time is skipped or happens twice.

    The clock is read three hours before and after the nominal conversion (more than any change that repeats a wall time; no
    zone changes its clock twice so fast). The wall time is tried with the distance from UTC of either reading, and exactly one
    instant must lead back to it.
    """
    zone_col = zone if isinstance(zone, Column) else F.lit(zone)
    wanted = F.to_timestamp(
        F.concat(F.date_format(col(date), "yyyy-MM-dd"), F.lit(" "), col(time)), "yyyy-MM-dd HH:mm"
    )
    nominal = F.unix_micros(F.to_utc_timestamp(wanted, zone_col))

    def ahead(hours: int) -> Column:
        at = nominal + F.lit(hours * 3_600_000_000).cast("bigint")
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), zone_col)) - at

    before, after = ahead(-3), ahead(3)
    first, second = (F.timestamp_micros(F.unix_micros(wanted) - distance) for distance in (before, after))
    hit = lambda moment: F.from_utc_timestamp(moment, zone_col) == wanted
    return F.when(hit(first), F.when((first == second) | ~hit(second), first)).when(hit(second), second)
