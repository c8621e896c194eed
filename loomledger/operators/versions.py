"""Record versions: latest state, overlays, increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_version(df: DataFrame, id: str, version: str, *ties: str) -> DataFrame:
    """The newest version of each id, as one aggregate; ties by further columns. Filters on other columns apply after it."""
    newest = df.groupBy(id).agg(F.max_by(F.struct(*df.columns), F.struct(version, *ties)).alias("row"))
    return newest.select("row.*")


def version_rank(df: DataFrame, id: str, version: str, *ties: str, name: str = "version_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(id).orderBy(*(F.desc(c) for c in (version, *ties)))))


def overlay_deltas(base: DataFrame, deltas: DataFrame, id: str, version: str, *ties: str) -> DataFrame:
    """Base rows without a delta, and the newest delta of each id: only the deltas are ranked."""
    return base.join(deltas.select(id).distinct(), id, "left_anti").unionByName(latest_version(deltas, id, version, *ties), allowMissingColumns=True)


def alias_columns(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Each missing alias as a copy of its source; a column that exists wins, its NULLs too."""
    return df.withColumns({a: F.col(s) for a, s in aliases.items() if a not in df.columns and s in df.columns})


def after(version: str, id: str, mark: tuple) -> Column:
    """Strictly after a watermark pair (version, id)."""
    v, i = F.lit(mark[0]), F.lit(mark[1])
    return (F.col(version) > v) | ((F.col(version) == v) & (F.col(id) > i))


def incremental_extract(df: DataFrame, version: str, id: str, mark: tuple, n: int) -> DataFrame:
    """The next `n` rows after the watermark, in order; the last one is the next watermark."""
    return df.where(after(version, id, mark)).orderBy(version, id).limit(n)


def deleted_ids(df: DataFrame, id: str, version: str, flag: str, start=None, end=None) -> DataFrame:
    out = df.where(F.col(flag))
    if start is not None:
        out = out.where(F.col(version) >= F.lit(start))
    if end is not None:
        out = out.where(F.col(version) < F.lit(end))
    return out.select(id, version)


def id_diff(expected: DataFrame, actual: DataFrame, id: str) -> DataFrame:
    """Ids that are missing and unexpected."""
    e, a = expected.select(id).distinct(), actual.select(id).distinct()
    return e.join(a, id, "left_anti").withColumn("finding", F.lit("missing")).union(a.join(e, id, "left_anti").withColumn("finding", F.lit("unexpected")))
