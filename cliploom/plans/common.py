"""Small helpers shared by the query modules."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.sources.tables import NOW_US


def now() -> Column:
    return F.timestamp_micros(F.lit(NOW_US).cast("bigint"))


def day(value) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def stamp(value) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df
