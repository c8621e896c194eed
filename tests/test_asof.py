"""As-of and range joins, conversions, against brute force and exact fractions."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomledger.functions import money
from loomledger.operators import asof

DAY = dt.date(2024, 1, 1)


def rows(seed, n, keys):
    r = random.Random(seed)
    day = lambda: DAY + dt.timedelta(days=r.randrange(60))
    return [(i, r.choice(keys), day()) for i in range(n)], day, r


@pytest.mark.parametrize("parts", [1, 40])
def test_asof_join(spark, parts):
    facts, day, r = rows(parts, 300, ["hot"] * 9 + ["b", "none", None])
    facts += [(1000 + k, "hot", DAY + dt.timedelta(days=30)) for k in range(200)] + [(2000, "hot", None), (0, facts[0][1], facts[0][2])]
    table = [(r.choice(["hot", "b", "other", None]), day() if k else None, r.choice([None, 1, 2, 3]), "x") for k in range(60)]
    schema = "n long, k string, d date"
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        t = spark.createDataFrame(table, "k string, since date, v int, d string")
        got = asof.asof_join(spark.createDataFrame(facts, schema), t, "k", "d", "since", "v", "d").toDF("n", "k", "day", "v", "note", "found").collect()
        none = asof.asof_join(spark.createDataFrame(facts, schema), t.limit(0), "k", "d", "since", "v")
        assert asof.missing(none, "n").count() == len(facts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for n, k, d in facts:
        own = [(s, -1 if v is None else v, v) for key, s, v, _ in table if key == k and k is not None and s is not None and d is not None and s <= d]
        best = max(own, default=None)
        want.append((n, k, d, best and best[2], best and "x", best is not None))
    key = lambda x: (x[0], str(x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("few", [200_000, 0])
def test_valid_ranges(spark, few):
    facts, day, r = rows(few, 250, ["a", "a", "a", "b", "none", None])
    facts += facts[:3] + [(900, "a", None)]
    ranges = [(r.choice("ab"), f"c{k}", *sorted((day(), day()))) for k in range(25)] + [("a", "z", DAY + dt.timedelta(days=50), None), ("b", "y", DAY + dt.timedelta(days=9), DAY + dt.timedelta(days=9))]
    df = spark.createDataFrame(facts, "n long, k string, d date")
    got = asof.valid_range_join(df, spark.createDataFrame(ranges, "k string, code string, valid_from date, valid_to date"), "k", "d", "code", few)
    assert "Range" not in str(got._jdf.queryExecution().optimizedPlan()) or few == 0
    want = [(n, k, d, min((c for kk, c, f, t in ranges if kk == k and d is not None and f <= d and (t is None or d < t)), default=None)) for n, k, d in facts]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_conversion_is_exact(spark):
    r = random.Random(8)
    cases = [(Decimal(r.randrange(10**6, 10**13)) / 100, Decimal(r.randrange(1, 10**10)) / 10**8, Decimal(r.randrange(1, 10**9)) / 10**8, r.choice(("EUR", "JPY"))) for _ in range(400)]
    cases += [(Decimal("0.50"), Decimal("1"), Decimal("1"), "JPY"), (Decimal("-2.50"), Decimal("1"), Decimal("1"), "JPY"), (Decimal("1.00"), Decimal("0.00500000"), Decimal("1"), "EUR"), (Decimal("9007199254740993.00"), Decimal("1.00000001"), Decimal("1"), "EUR")]
    cases = [c for c in cases if Fraction(c[0]) * Fraction(c[1]) / Fraction(c[2]) < 10**15]
    df = spark.createDataFrame(cases, "a decimal(18,2), f decimal(18,8), t decimal(18,8), c string")
    for row in df.select("*", money.converted(F.col("a"), F.col("f"), F.col("t"), F.col("c")).alias("got")).collect():
        exact = Fraction(row["a"]) * Fraction(row["f"]) / Fraction(row["t"])
        unit = 1 if row["c"] == "JPY" else 100
        want = Decimal(int(abs(exact) * unit + Fraction(1, 2))) / unit * (1 if exact >= 0 else -1)
        assert row["got"] == want.quantize(Decimal("0.01"), ROUND_HALF_UP), row
