"""Mixes sources to target weights: tokens of each source, repetition rates, then every document floor(rate) times and once more by a seeded coin.

Sources in the order of their code points (null last) weigh 5, 2, 1, 5, 2, 1, ... and share `share` times all words. A source gets at most `most` times its own words; what is above is shared again by weight until no source is above. That ends at the level L with target = min(most * size, L * weight), which is found from sums alone: L only rises, and each step fixes the sources that it fills. Ranks and sums are taken in Spark, so the number of sources isn't bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, rows_fit

WEIGHTS = (5, 2, 1)


def size_of(text: str) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """With `rank`, the source's place by code point (null last) from 0: ranges are numbered apart, then shifted by the sizes of those before."""
    parts = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    parts = cut(parts)
    before = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return parts.withColumn("at", F.row_number().over(inside) - 1).join(before, "part").select("source", "source_size", (F.col("at") + F.col("before")).alias("rank"))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows (source, size). An empty table gives no rows; a source without words has target 0."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = cut(_numbered(sources).withColumn("weight", weight))
    cap = F.col("source_size") * most
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, filled = 0.0, -1
    while True:
        full = F.col("weight") * level >= cap
        r = weighted.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("size"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"), F.sum(full.cast("int")).alias("n")).first()
        if not r["weight"] or r["n"] == filled:
            break
        level, filled = (share * total - most * r["size"]) / r["weight"], r["n"]
    return weighted.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).cast("double").alias("target"))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with size, source_size, target and copies (how often the mix takes the row), and the names these columns have.

    The coin of a row is the first 52 bits of the MD5 of seed, id and source, so reruns agree and repeated rows get the same. A null text has size 0; null sources are one source; a null id has a coin of its own.
    """
    names = dict(zip(("size", "source_size", "target", "copies"), fresh(docs, "size", "source_size", "target", "copies"), strict=True))
    sized = docs.withColumn(names["size"], size_of(text))
    found = targets(sized.select(F.col(source).alias("source"), F.col(names["size"]).alias("size")), share, most, weights)
    (key,) = fresh(sized, "mix_source")
    found = found.toDF(key, names["source_size"], names["target"])
    found = F.broadcast(found) if rows_fit(found, 50_000) else found
    rate = F.col(names["target"]) / F.col(names["source_size"])
    coin = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"), F.col(source)).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    rate = F.when(F.col(names["source_size"]) > 0, rate).otherwise(F.lit(0.0))
    taken = (F.floor(rate) + (coin < rate - F.floor(rate)).cast("long")).cast("long")
    return sized.join(found, sized[source].eqNullSafe(F.col(key))).withColumn(names["copies"], taken).drop(key), names


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with the number of the copy in `copy_no`, from 1. Empty and null texts are rows like others: their source's rate and their coin decide. Of a source without words no row is taken; an empty table gives none."""
    counted, names = copies(docs, doc_id, text, source, seed, share, most, weights)
    (copy,) = fresh(counted, "copy_no")
    return counted.where(F.col(names["copies"]) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int")))).select(*docs.columns, copy)
