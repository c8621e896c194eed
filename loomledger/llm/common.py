"""What the operators of this subpackage share: tables, lineage cuts, column names, skew-proof joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts of mixing and near duplicates define them (RE2 and Java read it alike).
WORD = r"[^\x20\x09-\x0D]+"


#: Where `cut` wrote a DataFrame.
_written: WeakKeyDictionary = WeakKeyDictionary()
#: The tables of each `scratch` that is open.
_scratch: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder of spark.checkpoint.dir and go on from there.

    A lost executor then costs no recomputation of what came before, and plans over many steps stay small: a table read again has the size of its files, where a checkpoint() carries estimates that multiply from join to join. The table goes with `free`, or when the application ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = where
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut inside go at the end, but for those that the function it gives is called with. Those of an inner scratch that stay are the outer one's."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scratch.append(own)
    try:
        yield keep
    finally:
        _scratch.pop()
        free(*(x for x in own if not any(x is k for k in kept)))
        if _scratch:
            _scratch[-1].extend(kept)


def free(*dfs: DataFrame) -> None:
    """Delete tables of `cut` that nothing reads any more: what was made of them must have been written, too."""
    for df in dfs:
        if where := _written.pop(df, None):
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` doesn't have (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def rows_fit(df: DataFrame, most: int) -> bool:
    """Whether `df` has at most `most` rows; reads no more than it must to tell."""
    return df.limit(most + 1).count() <= most


def share_of(rows: Column, share: float) -> Column:
    """Whether a row is in a sample of about `share` of all, by its hash `rows` (64 bits): no row is sorted or moved."""
    return F.shiftrightunsigned(rows, 12).cast("double") < share * (1 << 52)


def semi(df: DataFrame, ids: DataFrame, key: str, most: int = 500_000, how: str = "left_semi") -> DataFrame:
    """Rows of `df` whose `key` is (left_anti: isn't) in the one column of `ids`; nulls match nulls.

    The ids are broadcast only if there are at most `most` (4 MB of longs); beyond that both sides are shuffled.
    """
    (other,) = fresh(df, "in_id")
    ids = ids.toDF(other).distinct()
    right = F.broadcast(ids) if rows_fit(ids, most) else ids
    return df.join(right, df[key].eqNullSafe(F.col(other)), how)


def join_hot(left: DataFrame, right: DataFrame, key: str, per_salt: int = 2000, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on `key` when one key may have a large part of the rows of `left` and few in `right`.

    A key with n rows in `left` is dealt over n / `per_salt` + 1 tasks: its rows of `right` are repeated as often. The salt is a hash of the row, so a task run again deals every row alike. Only hot keys are listed, and broadcast if there are few. counts: (key, number of rows of `left`), where they are known or cheaper to get.
    """
    deals, salt = fresh(left, "deals", "salt")
    counts = left.groupBy(key).agg(F.count("*")) if counts is None else counts
    hot = counts.toDF(key, deals).select(key, (F.col(deals) / per_salt).cast("int").alias(deals)).where(F.col(deals) > 0)
    many = hot.count()
    if not many:
        return left.join(right, key)
    # few keys are broadcast: they are ids and hashes, a few MB
    hot, n = cut(hot), F.coalesce(deals, F.lit(0))
    hot = F.broadcast(hot) if many <= 50_000 else hot
    dealt = left.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(*left.columns), n + 1).cast("int")).drop(deals)
    wide = right.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), n))).drop(deals)
    return dealt.join(wide, [key, salt]).drop(salt)
