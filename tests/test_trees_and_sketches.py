"""Hash trees, mergeable sketches, exact quantiles and least squares against plain computations."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomledger.operators import hashtree, quality, regression, sketches


def snapshot(spark, n, changed=(), gone=(), new=()):
    rows = [(i, f"name {i % 7}" if i % 3 else None, None if i % 3 == 1 else i * 2) for i in range(n) if i not in gone]
    rows = [(i, "changed", v) if i in changed else (i, t, v) for i, t, v in rows] + [(i, "new", None) for i in new]
    return spark.createDataFrame(rows, "id long, name string, v long")


def test_changes_read_only_leaves_that_differ(spark, tmp_path):
    before, after, same = (f"{tmp_path}/{n}" for n in ("before", "after", "same"))
    hashtree.publish(snapshot(spark, 500), "id", before)
    hashtree.publish(snapshot(spark, 500, changed=(77,), gone=(5,), new=(900,)), "id", after)
    hashtree.publish(snapshot(spark, 500).repartition(7), "id", same)
    assert {tuple(r) for r in hashtree.changes(spark, before, after, "id").collect()} == {(77, "changed"), (5, "deleted"), (900, "added")}
    assert hashtree.changes(spark, before, same, "id").count() == 0
    tree = {n: spark.read.parquet(f"{p}/tree") for n, p in (("b", before), ("a", after), ("s", same))}
    assert len(hashtree.differing(tree["b"], tree["a"])) == 3 and hashtree.differing(tree["b"], tree["s"]) == []
    plan = hashtree.changes(spark, before, after, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [_leaf") == 2
    whole = {r["level"]: r["n"] for r in tree["b"].groupBy("level").agg(F.sum("n_rows").alias("n")).collect()}
    assert whole == {0: 500, 4: 500, 8: 500}


def test_digests_tell_nulls_and_places(spark):
    one = lambda *v: hashtree.root_digest(spark.createDataFrame([v], "id int, a string, b string"), "id").first()[0]
    assert len({one(1, None, "x"), one(1, "x", None), one(1, "x", "x"), one(1, None, None), one(2, None, None)}) == 5
    twice = spark.createDataFrame([(1, "x", "y")] * 2, "id int, a string, b string")
    assert hashtree.root_digest(twice, "id").first() != hashtree.root_digest(twice.limit(1), "id").first()
    empty = twice.limit(0)
    assert hashtree.root_digest(empty, "id").count() == 1 and hashtree.tree(empty, "id").count() == 0


def test_sketches_of_days_merge(spark):
    r = random.Random(3)
    rows = [(dt.date(2024, 1, 1 + r.randrange(9)), r.randrange(3000), None if r.random() < 0.1 else f"c{r.randrange(200)}", r.expovariate(1 / 40)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "day date, n long, c string, x double")
    kept = sketches.profiles(df.where("day < '2024-01-05'"), "day").union(sketches.profiles(df.where("day >= '2024-01-05'"), "day"))
    exact = {x["column_name"]: x for x in quality.profile_columns(df.drop("day"), exact=True).collect()}
    for x in sketches.merged_profile(kept).collect():
        e = exact[x["column_name"]]
        assert (x["nulls"], x["n_rows"]) == (e["nulls"], e["n_rows"]) and abs(x["distinct_values"] - e["distinct_values"]) <= 0.03 * e["distinct_values"]
    own = sketches.quantile_sketches(df, "day", "x")
    values = np.sort([x[3] for x in rows])
    for x in sketches.merged_quantiles(own, [0.01, 0.5, 0.9, 0.999]).collect():
        assert abs(np.searchsorted(values, x["value"]) / len(values) - x["p"]) < 0.01
    got = {x["p"]: x["value"] for x in sketches.exact_quantiles(df, "x", [0.0, 0.5, 0.9, 1.0]).collect()}
    assert all(abs(v - np.quantile(values, p)) < 1e-9 for p, v in got.items())
    assert [x["value"] for x in sketches.exact_quantiles(df.limit(0), "x", [0.5]).collect()] == [None]


def test_least_squares(spark):
    r = np.random.default_rng(5)
    n = 800
    a, b, c, s = r.normal(10, 3, n), r.normal(0, 1, n), r.integers(0, 4, n), r.integers(0, 3, n)
    y = 3 + 2 * a - 0.5 * b + np.array([0, 1, -2, 4])[c] + np.array([0, 7, 9])[s] + r.normal(0, 0.1, n)
    rows = [(float(v), float(p), float(q), f"c{i}", f"s{j}") for v, p, q, i, j in zip(y, a, b, c, s, strict=True)] + [(None, 1.0, 1.0, "c0", "s0"), (5.0, 1.0, 1.0, None, "s0")]
    df = spark.createDataFrame(rows, "y double, a double, b double, carrier string, service string")
    got = {x["term"]: x["coefficient"] for x in regression.least_squares(df, "y", ["a", "b"], ["carrier", "service"]).collect()}
    design = np.column_stack([np.ones(n), a, b, *(c == k for k in (1, 2, 3)), *(s == k for k in (1, 2))])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert [got[t] for t in ("1", "a", "b", "carrier=c1", "carrier=c2", "carrier=c3", "service=s1", "service=s2")] == pytest.approx(want, abs=1e-6)
    assert len(got) == 8 and regression.least_squares(df.limit(0), "y", ["a"], []).count() == 0


def test_least_squares_of_many_levels(spark):
    """A category may have more levels than the driver solves for; another may stand beside it, levels of which one alone has them are told by it."""
    r = np.random.default_rng(6)
    n, levels = 9000, regression.TERMS + 500
    c = np.concatenate([np.arange(levels), r.integers(0, levels, n - levels)])
    a, b, s = r.normal(1000, 3, n), r.normal(0, 1, n), r.integers(0, 3, n)
    y = 3 + 2 * a - 0.5 * b + c % 7 + np.array([0, 7, 9])[s]
    rows = [(float(v), float(p), float(q), int(i), f"s{j}", float(i % 5)) for v, p, q, i, j in zip(y, a, b, c, s, strict=True)]
    df = spark.createDataFrame(rows, "y double, a double, b double, carrier int, service string, told double")
    got = {x["term"]: x["coefficient"] for x in regression.least_squares(df, "y", ["a", "b"], ["service", "carrier"]).collect()}
    want = {"1": 3, "a": 2, "b": -0.5, "service=s1": 7, "service=s2": 9} | {f"carrier={k}": k % 7 for k in range(1, levels)}
    assert got == pytest.approx(want, abs=1e-6)
    one = {x["term"]: x["coefficient"] for x in regression.least_squares(df.where("service = 's0'"), "y", ["a", "told"], ["carrier"]).collect()}
    assert one["told"] == 0 and len(one) == 2 + len({i for i, j in zip(c, s, strict=True) if j == 0})
    none = {x["term"]: x["coefficient"] for x in regression.least_squares(df, "y", ["a"], []).collect()}
    assert none == pytest.approx(dict(zip(("a", "1"), np.polyfit(a, y, 1), strict=True)), abs=1e-6)
