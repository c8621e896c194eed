"""Streams, exports and published days against their SQL twins, on small tables and on empty ones."""

import datetime as dt

import duckdb
import pytest

from loomledger.plans import incremental  # noqa: F401
from loomledger.plans.registry import ORACLE, QUERIES
from loomledger.streaming import streams

NAMES = ("stream_deltas", "stream_dedup", "stream_current", "stream_usage", "stream_usage_minutes", "stream_sla", "stream_late", "export_parts", "export_window", "export_resume", "publish_delta", "partition_column_hidden", "deferred_full_copy")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    t = dt.datetime(2024, 1, 1)
    events = [(i, t + dt.timedelta(hours=3 * i, microseconds=i), i % 7, ("click", "purchase", "view")[i % 3], float(i), "") for i in range(120)]
    orders = [(3 * i, i % 9, "O", 1.0, t + dt.timedelta(days=20 * i), "HIGH" if i % 2 else "LOW, \"x\"\ny") for i in range(60)]
    where = {}
    for name, keep in (("full", True), ("empty", False)):
        d = str(tmp_path_factory.mktemp(name))
        for table, rows, schema in (
            ("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        ):
            spark.createDataFrame(rows if keep else [], schema).repartition(3).write.parquet(f"{d}/{table}.parquet")
        where[name] = d
    return where


def compared(spark, d, name):
    got = QUERIES[name](spark, d)
    con = duckdb.connect()
    for table in ("events", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet/*.parquet'")
    own = con.execute(ORACLE[name])
    names = [c[0] for c in own.description]
    assert sorted(names) == sorted(got.columns)
    return sorted(map(tuple, got.select(*names).collect()), key=str), sorted(own.fetchall(), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_twins(spark, tables, name):
    got, want = compared(spark, tables["full"], name)
    assert got == want and got


@pytest.mark.parametrize("name", [n for n in NAMES if n.startswith("stream") or n in ("publish_delta", "deferred_full_copy")])
def test_without_rows(spark, tables, name):
    got, want = compared(spark, tables["empty"], name)
    assert got == want == []


def test_current_state_of_many_batches(spark, tmp_path):
    """Late, repeated and replayed events change nothing; what is kept grows with ids, not with batches."""
    t = dt.datetime(2024, 1, 1)
    schema = "id long, at timestamp_ntz, n long, note string"
    rows = [(i % 5 if i % 11 else None, t + dt.timedelta(hours=(7 * i) % 50), i, None if i % 3 else f"x{i}") for i in range(70)]
    root, check = f"{tmp_path}/state", f"{tmp_path}/check"
    for k in range(7):
        own = rows[10 * k : 10 * k + 10] + rows[:5]  # the first ones come again
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part=*").select("id", "at", "n", "note")
        streams.run_out(streams.stream_current(stream, root, check, "id", "at", "n", keep=3))
        want = {}
        for r in rows[: 10 * k + 10]:
            want[r[0]] = max(want.get(r[0], r), r, key=lambda x: (x[1], x[2]))
        assert {r["id"]: tuple(r) for r in streams.read_current(spark, root, "id", "at", "n").collect()} == want
        assert len(list((tmp_path / "state").glob("*=*"))) <= 1 + 3
    # a batch that ran but wasn't noted runs again
    for name in ("6", ".6.crc"):
        (tmp_path / "check/commits" / name).unlink()
    streams.run_out(streams.stream_current(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part=*").select("id", "at", "n", "note"), root, check, "id", "at", "n", keep=3))
    assert {r["id"]: tuple(r) for r in streams.read_current(spark, root, "id", "at", "n").collect()} == want
