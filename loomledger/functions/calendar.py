"""Calendar features and business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Market holidays (month, day) on which no rates are published.
HOLIDAYS = ((1, 1), (5, 1), (12, 25), (12, 26))


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def banking_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~(F.month(day) * 100 + F.dayofmonth(day)).isin(*(m * 100 + d for m, d in HOLIDAYS))


def features(df: DataFrame, day: str) -> DataFrame:
    d, dom, m = F.col(day), F.dayofmonth(day), F.month(day)
    return df.withColumns({"weekday": F.weekday(d), "month": m, "quarter_end": (m % 3 == 0) & (dom >= 16), "december_peak": (m == 12) & (dom <= 22), "january_dip": (m == 1) & (dom <= 12), "summer": m.isin(7, 8), "is_banking_day": banking_day(d)})


def week_pick(seed: str, day: Column) -> Column:
    """The ISO weekday (1 to 7) that a seed picks in the day's ISO week."""
    text = F.concat_ws(":", F.lit(seed), F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.weekofyear(day).cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int") % 7 + 1


def at_hour(day: str, hour: int) -> Column:
    """A date's timestamp at a full hour."""
    return F.col(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))
