"""Money: rounding to minor units, currencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_minor_unit(amount: Column, currency: Column) -> Column:
    """Half-up to the currency's decimals: JPY 0, others 2."""
    return F.when(currency == "JPY", F.round(amount, 0)).otherwise(F.round(amount, 2)).cast("decimal(18,2)")


def fx_daily(rates: DataFrame, first: str, last: str) -> DataFrame:
    """(currency, rate_date, rate) for every day: carried forward; before the first rate the first; USD is 1.

    A rate stands for the days up to the next one, so each row is laid out over its own days: the work is that of the result, and no list of currencies is held.
    """
    by = Window.partitionBy("currency").orderBy("rate_date")
    begin, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    ends = rates.select("currency", "rate_date", "rate", (F.row_number().over(by) == 1).alias("is_first"), F.lead("rate_date").over(by).alias("next"))
    since = F.when(F.col("is_first"), begin).otherwise(F.greatest("rate_date", begin))
    until = F.least(F.coalesce(F.date_sub("next", 1), end), end)
    days = ends.where(since <= until).select("currency", F.explode(F.sequence(since, until)).alias("rate_date"), "rate")
    usd = rates.sparkSession.range(1).select(F.lit("USD").alias("currency"), F.explode(F.sequence(begin, end)).alias("rate_date"), F.lit(1).cast("decimal(18,8)").alias("rate"))
    return days.where("currency != 'USD'").unionByName(usd)


def converted(amount: Column, rate_from: Column, rate_to: Column, to: Column) -> Column:
    """amount * rate_from / rate_to in decimals, rounded half up to the minor unit of `to`: the exact product is divided to twelve places and more, so that only a quotient within 1e-12 of half a unit could round otherwise than the exact one."""
    product = amount.cast("decimal(18,2)") * rate_from.cast("decimal(18,8)")
    quotient = product.cast("decimal(26,10)") / rate_to.cast("decimal(11,8)")
    return round_minor_unit(quotient, to)


def convert_currency(df: DataFrame, daily: DataFrame, amount: str, source: str, target: str, date: str, out: str) -> DataFrame:
    """amount * rate(source) / rate(target) on the day, rounded to the target's minor unit; unchanged for one currency, NULL without a rate.

    The daily rates are a few currencies times days; Spark broadcasts them by their size.
    """
    s = daily.select(F.col("currency").alias(source), F.col("rate_date").alias(date), F.col("rate").alias("rate_from"))
    t = daily.select(F.col("currency").alias(target), F.col("rate_date").alias(date), F.col("rate").alias("rate_to"))
    wide = df.join(s, [source, date], "left").join(t, [target, date], "left")
    value = converted(F.col(amount), F.col("rate_from"), F.col("rate_to"), F.col(target))
    return wide.withColumn(out, F.when(F.col(source) == F.col(target), F.col(amount)).otherwise(value)).drop("rate_from", "rate_to")
