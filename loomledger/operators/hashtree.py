"""Hash trees of tables: two snapshots are compared branch by branch, and only rows of leaves that differ are read.

A row's leaf is told by the first bits of its key's hash, so a leaf holds one range of hashes in every snapshot. A leaf's digest adds up its rows' hashes, in any order; a node's digest is that of its sixteen children. No node needs a large row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Bits of a level: sixteen children.
STEP = 4


def _leaf(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def _hashes(columns: list[str]) -> list[Column]:
    """128 bits of a row; NULLs are told from nothing and from each other's places."""
    told = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*told).alias("_h"), F.xxhash64(F.lit(1), *told).alias("_g")]


def tree(df: DataFrame, id: str, bits: int = 8) -> DataFrame:
    """(level, node, n_rows, digest) of a table: leaves at level `bits` (a multiple of 4) up to the root at level 0. A table without rows has no nodes."""
    rows = df.select(_leaf(F.col(id), bits).alias("node"), *_hashes(df.columns))
    sums = F.concat_ws(":", F.count("*"), F.sum(F.col("_h").cast("decimal(38,0)")), F.bit_xor("_g"))
    nodes = staged(rows.groupBy("node").agg(F.count("*").alias("n_rows"), F.sha2(sums, 256).alias("digest")))
    levels = [nodes.select(F.lit(bits).alias("level"), "node", "n_rows", "digest")]
    for level in range(bits - STEP, -1, -STEP):
        of = F.shiftrightunsigned("node", STEP).alias("node")
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["digest"])), ",")
        up = levels[-1].groupBy(of).agg(F.sum("n_rows").alias("n_rows"), F.sha2(children, 256).alias("digest"))
        levels.append(up.select(F.lit(level).alias("level"), "node", "n_rows", "digest"))
    return reduce(DataFrame.union, levels)


def publish(df: DataFrame, id: str, path: str, bits: int = 8) -> None:
    """Writes a snapshot, a folder for each leaf, and its tree. Leaves are to fit a task: 4 more bits make them a sixteenth."""
    df.withColumn("_leaf", _leaf(F.col(id), bits)).repartition("_leaf").write.mode("overwrite").partitionBy("_leaf").parquet(f"{path}/rows")
    tree(df.sparkSession.read.parquet(f"{path}/rows").select(*df.columns), id, bits).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")


def differing(before: DataFrame, after: DataFrame, bits: int = 8) -> list[int]:
    """The leaves in which two trees differ, found from the root down: children of equal nodes aren't looked at. As many as the leaves at most."""
    nodes = None
    for level in range(0, bits + 1, STEP):
        old, new = (t.where(F.col("level") == level).select("node", F.col("digest").alias(c)) for t, c in ((before, "old"), (after, "new")))
        both = old.join(new, "node", "full").where(~F.col("old").eqNullSafe(F.col("new")))
        if nodes is not None:
            both = both.where(F.shiftrightunsigned("node", STEP).isin(nodes))
        nodes = sorted(r[0] for r in both.select("node").collect())
        if not nodes:
            break
    return nodes or []


def changes(spark: SparkSession, before: str, after: str, id: str, bits: int = 8) -> DataFrame:
    """(id, change): rows of a published snapshot that a later one deleted, changed or added; reads the leaves that differ."""
    leaves = differing(spark.read.parquet(f"{before}/tree"), spark.read.parquet(f"{after}/tree"), bits)
    read = lambda path: spark.read.parquet(f"{path}/rows").where(F.col("_leaf").isin(leaves) if leaves else F.lit(False)).drop("_leaf")
    sides = [df.select(id, F.struct(*(c for c in df.columns if c != id)).alias(name)) for df, name in ((read(before), "old"), (read(after), "new"))]
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return sides[0].join(sides[1], id, "full").select(id, change.alias("change")).where("change is not null")


def root_digest(df: DataFrame, id: str, bits: int = 8) -> DataFrame:
    """(digest), one row: that of a table's root, or of nothing."""
    return tree(df, id, bits).where("level = 0").agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))
