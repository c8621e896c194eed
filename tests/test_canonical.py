"""Canonical JSON against Python's own writer."""

import json
import random

from pyspark.sql import functions as F

from loomledger.functions.canonical import canonical_json
from loomledger.functions.keys import stable_event_id

NUMBERS = (0, 5, -3, 10**15, 123456789012345678, 1.0, 0.5, 1e7, 12345678.25, 1e16, 1.5e-7, 0.001, 0.00012, -2.5, 1e22, 123456.789, 1e-5, 9007199254740993.0, 3.14e100)
TEXTS = ("a", "é", "日本", "\U0001f600x", 'q"uote', "back\\slash", "tab\t\x0b\x1f", "", "#\x01 5", "a: 1, b", "\\u00e9", "1.5", "/", "\x7f")


def value(r, depth=0):
    kind = r.randrange(9 if depth < 3 else 6)
    if kind < 6:
        return r.choice(((None, True, False), NUMBERS, NUMBERS, TEXTS, TEXTS, TEXTS)[kind])
    if kind == 6:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(("b", "a", "Z", "é", "long key", "0", "a.b", "")) + str(r.randrange(3)): value(r, depth + 1) for _ in range(r.randrange(5))}


def shuffled(r, v):
    if isinstance(v, dict):
        names = list(v)
        r.shuffle(names)
        return {k: shuffled(r, v[k]) for k in names}
    return [shuffled(r, x) for x in v] if isinstance(v, list) else v


def test_canonical_json(spark):
    r, rows = random.Random(1), []
    for _ in range(600):
        v = value(r)
        rows.append((json.dumps(shuffled(r, v), ensure_ascii=r.random() < 0.5, indent=r.choice((None, 1, 3))), json.dumps(v, sort_keys=True, separators=(",", ":"))))
    rows += [(x, None) for x in ('{"a":01}', '{"a":1,"a":2}', "{a:1}", "", None, '{"a":1-2}', '{"a":1', '{"a":1.}', "[1 2]")]
    rows += [('{"a":1.50, "b":1E2, "c":-0.0, "d":-0}', '{"a":1.5,"b":100.0,"c":-0.0,"d":0}'), ('{"a":"\\u00E9\\/"}', '{"a":"\\u00e9/"}')]
    long = '{"a":"' + "x\\n" * 20_000 + '","b":[' + "1," * 20_000 + "2]}"
    rows.append((long, json.dumps(json.loads(long), sort_keys=True, separators=(",", ":"))))
    got = spark.createDataFrame(rows, "text string, want string").select("text", canonical_json(F.col("text")).alias("got"), "want")
    assert [x for x in got.collect() if x["got"] != x["want"]] == []


def test_one_id_for_all_spellings(spark):
    rows = [('{"a":1,"b":{"x":2,"y":null}}',), ('{"b":{"y":null,"x":2}, "a":1}',), ('{"a":1,"b":{"x":2}}',), ("none",)]
    one = lambda c: F.lit(c)
    got = [x[0] for x in spark.createDataFrame(rows, "p string").select(stable_event_id(one("2024-01-02"), one("crm"), one("open"), one(7), F.col("p"))).collect()]
    assert got[0] == got[1] != got[2] and got[3] is None


def test_values_are_computed_once(spark):
    """The expression stays small: no value stands in it once for each of its uses. Escapes, runs of letters and numbers in one text."""
    plan = spark.range(1).select(canonical_json(F.col("id").cast("string")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 10_000
    text = '{"éß日b": ["\\u00E9\\u001F\\\\u001F", 1.50, 15e-1, 1E3], "a": {"c": null, "b": 7}}'
    got = spark.createDataFrame([(text,)], "t string").select(canonical_json(F.col("t"))).first()[0]
    assert got == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
