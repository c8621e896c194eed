"""Metrics over two periods and along chains of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as doubles; NULL if b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def mix_shift(before: DataFrame, now: DataFrame, by: str, revenue: str, margin: str) -> DataFrame:
    """(by, mix_effect, rate_effect) of the change in margin rate between two periods: the change of a segment's share of revenue at its old rate, and the change of its rate at its new share. A segment without revenue in a period has share and rate 0 there."""

    def period(df: DataFrame, n: int) -> DataFrame:
        total = df.agg(F.sum(revenue).alias("total"))  # one row
        one = df.groupBy(by).agg(F.sum(revenue).alias("r"), F.sum(margin).alias("m")).crossJoin(F.broadcast(total))
        return one.select(by, ratio("r", "total").alias(f"share{n}"), ratio("m", "r").alias(f"rate{n}"))

    both = period(before, 0).join(period(now, 1), by, "full")
    s0, s1, r0, r1 = (F.coalesce(c, F.lit(0.0)) for c in ("share0", "share1", "rate0", "rate1"))
    return both.select(by, ((s1 - s0) * r0).alias("mix_effect"), (s1 * (r1 - r0)).alias("rate_effect"))
