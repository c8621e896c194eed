"""Least squares on several numbers and categories: Spark adds rows up into cells, takes the category with most levels out of the equations, and the driver solves what is left."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Most terms of a model beside the levels of its largest category, of which there may be any number; the driver solves equations of that many.
TERMS = 2000


def cells(df: DataFrame, y: str, numbers: list[str], categories: list[str]) -> DataFrame:
    """A row for each combination of levels c0, c1, ...: n, the means x0 (of y), x1, ... (of the numbers) and the sums s<i>_<j> of products of what differs from these means. Rows with a NULL are left out; without categories c0 is empty."""
    names = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate((y, *numbers))]
    used = df.select(*names, *(F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(categories)), *([] if categories else [F.lit("").alias("c0")])).na.drop()
    m, n = len(names), F.count("*")
    products = [(n * F.covar_pop(f"x{i}", f"x{j}")).alias(f"s{i}_{j}") for i in range(m) for j in range(i, m)]
    return used.groupBy(*(c for c in used.columns if c[0] == "c")).agg(n.alias("n"), *(F.avg(f"x{i}").alias(f"x{i}") for i in range(m)), *products)


def _equations(cell: DataFrame, own: str, categories: list[str], m: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(indicators, square, size): the sums of products of y (first), the numbers and the indicators of all categories but `own`, each less its mean in a level of `own`; and their sums of squares as they are."""
    x, others = range(m), [f"c{k}" for k in range(len(categories)) if f"c{k}" != own]
    if others:
        level = cell.groupBy(own).agg(F.sum("n").alias("of"), *((F.sum(F.col("n") * F.col(f"x{i}")) / F.sum("n")).alias(f"m{i}") for i in x))
        cell = cell.join(level, own)
    off = lambda i: F.col(f"x{i}") - F.col(f"m{i}") if others else F.lit(0.0)
    products = [F.sum(F.col(f"s{i}_{j}") + F.col("n") * off(i) * off(j)).alias(f"s{i}_{j}") for i in x for j in range(i, m)]
    row = cell.agg(*products, *(F.sum(F.col(f"s{i}_{i}") + F.col("n") * F.col(f"x{i}") * F.col(f"x{i}")).alias(f"x{i}") for i in x)).first()
    size = np.array([row[f"x{i}"] for i in x])
    if not others:
        return [], np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in x] for i in x]), size
    first = cell.agg(*(F.min(c).alias(f"first_{c}") for c in others))  # one row
    indicator = [F.when(F.col(c) != F.col(f"first_{c}"), F.concat(F.lit(f"{categories[int(c[1:])]}="), F.col(c))) for c in others]
    cell = cell.crossJoin(F.broadcast(first)).withColumn("t", F.filter(F.array(*indicator), lambda t: t.isNotNull()))
    each = cell.withColumn("a", F.explode("t"))
    names = [r["a"] for r in each.select("a").distinct().orderBy("a").limit(TERMS + 1).collect()]
    if m + len(names) > TERMS:
        raise ValueError(f"more than {TERMS} terms")
    at = {t: m + k for k, t in enumerate(names)}
    square = np.zeros((m + len(names), m + len(names)))
    square[:m, :m] = [[row[f"s{min(i, j)}_{max(i, j)}"] for j in x] for i in x]
    size = np.concatenate([size, np.zeros(len(names))])
    for r in each.groupBy("a").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * off(i)).alias(f"x{i}") for i in x)).collect():
        square[at[r["a"]], :m] = square[:m, at[r["a"]]] = [r[f"x{i}"] for i in x]
        size[at[r["a"]]] = r["n"]
    met = each.withColumn("b", F.explode("t")).where("a <= b").groupBy("a", "b").agg(F.sum("n").cast("double").alias("total"))
    share = each.groupBy(own, "of", "a").agg(F.sum("n").alias("k"))
    means = share.join(share.select(own, F.col("a").alias("b"), F.col("k").alias("l")), own).where("a <= b").groupBy("a", "b").agg((-F.sum(F.col("k") * F.col("l") / F.col("of"))).alias("total"))
    for r in met.union(means).groupBy("a", "b").agg(F.sum("total").alias("total")).collect():  # a number for each two terms
        square[at[r["a"]], at[r["b"]]] = square[at[r["b"]], at[r["a"]]] = r["total"]
    return names, square, size


def least_squares(df: DataFrame, y: str, numbers: list[str], categories: list[str]) -> DataFrame:
    """(term, coefficient) of the model. Terms: "1", the numbers, and `category=level` for each level but the first. Empty without rows.

    The category with most levels is swept out: slopes are those of what differs from its levels' means, and its coefficients, which stay rows of Spark, are what the slopes leave of the means. More than `TERMS` other terms are an error; of those that depend on others, the smallest solution.
    """
    spark, m = df.sparkSession, len(numbers) + 1
    cell = staged(cells(df, y, numbers, categories))
    if cell.isEmpty():
        return spark.createDataFrame([], "term string, coefficient double")
    if m > TERMS:
        raise ValueError(f"more than {TERMS} terms")
    levels = cell.agg(*(F.count_distinct(f"c{k}").alias(f"c{k}") for k in range(len(categories)))).first().asDict() if len(categories) > 1 else {"c0": 1}
    own = max(levels, key=levels.get)
    indicators, square, size = _equations(cell, own, categories, m)
    square, right = square[1:, 1:], square[1:, 0]
    # a term that the levels tell leaves nothing but what rounding makes of it
    told = np.diag(square) <= np.where(np.arange(1, len(size)) < m, 1e-24, 1e-12) * size[1:]
    square[told], square[:, told], right[told] = 0, 0, 0
    scale = 1 / np.sqrt(np.where(np.diag(square) > 0, np.diag(square), 1))
    solved = scale * np.linalg.lstsq(square * np.outer(scale, scale), right * scale, rcond=1e-12)[0] if len(right) else right
    slopes = spark.createDataFrame([(t, float(v)) for t, v in zip((*numbers, *indicators), solved, strict=True)], "term string, coefficient double")
    rest = F.col("x0")
    for i, v in enumerate(solved[: m - 1], 1):
        rest = rest - F.lit(float(v)) * F.col(f"x{i}")
    for k, c in enumerate(categories):
        if f"c{k}" != own:  # its levels are few
            at = [(t[len(c) + 1 :], float(v)) for t, v in zip(indicators, solved[m - 1 :], strict=True) if t.startswith(f"{c}=")]
            cell = cell.join(F.broadcast(spark.createDataFrame(at, f"c{k} string, b{k} double")), f"c{k}", "left")
            rest = rest - F.coalesce(f"b{k}", F.lit(0.0))
    level = staged(cell.groupBy(own).agg((F.sum(F.col("n") * rest) / F.sum("n")).alias("own")))
    base = level.agg(F.min_by("own", own).alias("base"), F.min(own).alias("first"))  # one row
    name = F.lit(f"{categories[int(own[1:])]}=") if categories else F.lit("")
    of_levels = level.crossJoin(F.broadcast(base)).select(F.when(F.col(own) == F.col("first"), "1").otherwise(F.concat(name, F.col(own))).alias("term"), F.when(F.col(own) == F.col("first"), F.col("base")).otherwise(F.col("own") - F.col("base")).alias("coefficient"))
    return slopes.union(of_levels)
