"""As-of joins: the last row of a table at or before a fact's time, however the facts lie on keys and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Rows of (key, day) that are broadcast: some 40 bytes each.
FEW = 200_000


def asof_join(facts: DataFrame, table: DataFrame, on: str, at: str, since: str, *values: str) -> DataFrame:
    """`facts` with the `values` of the row of `table` that has their key and the latest `since` at or before their `at`, and `found`, whether there is one; every fact stays one row. A null key or time finds nothing; of rows of one key and time in `table`, the largest values count.

    Both are merged in ranges of (key, time), so that neither a hot key nor a hot day lands in one task; each range carries its last row of a key to the facts behind it, and the ranges' last rows are carried over their edges by a table of a few rows for each range.
    """
    own = [f"_{v}" for v in values]
    known = table.groupBy(F.col(on).alias("_on"), F.col(since).alias("_at")).agg(F.max(F.struct(*(F.col(v).alias(o) for v, o in zip(values, own, strict=True)))).alias("_value"))
    fact = F.struct(*facts.columns).alias("_fact")
    none = F.lit(None).cast(known.schema["_value"].dataType)
    # of one time the table's row comes first; facts of one key and time are parted by their hashes
    left = facts.select(F.col(on).alias("_on"), F.col(at).cast(known.schema["_at"].dataType).alias("_at"), F.lit(1).alias("_kind"), F.xxhash64(*facts.columns).alias("_tie"), none.alias("_value"), fact)
    right = known.select("_on", "_at", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"), "_value", F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact")).where("_on is not null and _at is not null")
    order = ("_at", "_kind", "_tie")
    both = staged(left.union(right).repartitionByRange("_on", *order).withColumn("_range", F.spark_partition_id()))
    carried = both.where("_kind = 0").groupBy("_on", "_range").agg(F.max_by("_value", "_at").alias("_last"))
    # the rows that a range takes over: for each key the last of an earlier range
    ranges = both.groupBy("_on", "_range").agg(F.lit(1).alias("_one")).join(carried, ["_on", "_range"], "left")
    over = F.last("_last", True).over(Window.partitionBy("_on").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(F.col("_on").alias("_key"), F.col("_range").alias("_of"), over.alias("_before"))
    here = F.last("_value", True).over(Window.partitionBy("_on", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_here", here).where("_kind = 1").join(ranges, (F.col("_on") == F.col("_key")) & (F.col("_range") == F.col("_of")), "left")
    value = F.when(F.col("_at").isNotNull(), F.coalesce("_here", "_before"))
    return found.select("_fact", value.alias("_value")).select("_fact.*", *(F.col(f"_value.{o}").alias(v) for v, o in zip(values, own, strict=True)), F.col("_value").isNotNull().alias("found"))


def missing(joined: DataFrame, *columns: str) -> DataFrame:
    """The facts that found nothing: violations, to be listed before what was found is used."""
    return joined.where("not found").select(*columns)


def pieces(ranges: DataFrame, on: str, code: str) -> DataFrame:
    """(on, since, code): the ranges (valid_from, valid_to, open if NULL) of a key cut where any of them begins or ends, each piece with its lowest code, or NULL where none is valid."""
    r = ranges.select(F.col(on).alias("_on"), "valid_from", "valid_to", F.col(code).alias("_code")).where("valid_to is null or valid_from < valid_to")
    cuts = r.select("_on", F.col("valid_from").alias("since")).union(r.where("valid_to is not null").select("_on", "valid_to")).distinct()
    own = r.withColumnRenamed("_on", "_key")
    valid = cuts.join(own, (F.col("_on") == F.col("_key")) & (F.col("since") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("since") < F.col("valid_to"))), "left")
    return valid.groupBy(F.col("_on").alias(on), "since").agg(F.min("_code").alias(code))


def valid_range_join(facts: DataFrame, ranges: DataFrame, on: str, at: str, code: str, few: int = FEW) -> DataFrame:
    """The lowest code valid at a fact's date (valid_from <= date < valid_to, open if NULL); NULL if none. Every fact stays one row.

    Ranges of which at most `few` rows of (key, day) come are laid out by day and broadcast: an equality join that moves no fact. More are an as-of join on the pieces that the ranges are cut to.
    """
    p = pieces(ranges, on, code)
    span = facts.agg(F.min(F.to_date(at)).alias("first"), F.max(F.to_date(at)).alias("last"))
    ends = p.withColumn("until", F.lead("since").over(Window.partitionBy(on).orderBy("since"))).crossJoin(F.broadcast(span))  # one row
    first, last = F.greatest(F.to_date("since"), "first"), F.least(F.date_sub(F.to_date("until"), 1), "last")
    days = ends.where(F.col(code).isNotNull() & (first <= last)).select(F.col(on).alias("_on"), F.col(code), first.alias("_first"), last.alias("_last"))
    days = staged(days)
    if (days.agg(F.sum(F.datediff("_last", "_first") + 1)).first()[0] or 0) <= few and facts.schema[at].dataType.typeName() == "date":
        each = days.select("_on", code, F.explode(F.sequence("_first", "_last")).alias("_day"))
        return facts.join(F.broadcast(each), (facts[on] == F.col("_on")) & (facts[at] == F.col("_day")), "left").select(*(facts[c] for c in facts.columns), code)
    return asof_join(facts, p, on, at, "since", code).select(*facts.columns, code)
