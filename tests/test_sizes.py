"""Steps whose tasks must not grow with their tables."""

import datetime as dt

import pytest

from loomledger.plans import incremental, records
from loomledger.plans.registry import QUERIES
from loomledger.sources import exports, staging


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d, t = str(tmp_path_factory.mktemp("small")), dt.datetime(2024, 1, 1)
    tables = {
        "events": ([(i, t + dt.timedelta(hours=i), i % 7, "click", float(i), "") for i in range(120)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        "orders": ([(i, 1, "OFP"[i % 3], 1.0, t, "LOW") for i in range(1, 60)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(i % 70 + 1, i % 4, 1, i, 2.0, 9.0, 0.1, 0.0, "N", "O", t) for i in range(280)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "part": ([(i, f"B{i % 2}", 3, 10.0 + i) for i in range(4)], "p_partkey long, p_brand string, p_size int, p_retailprice double"),
        "customer": ([(1, "c", "BUILDING", 1, 0.0)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int, c_acctbal double"),
        "nation": ([(1, "n", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(1, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def test_brands_of_orders(spark, small, monkeypatch):
    """Lines are dealt by order over as many tasks as they need; a line whose order isn't there is an opportunity all the same."""
    monkeypatch.setattr(records, "LINES", 20)
    assert records.opportunities(spark, small, "true").rdd.getNumPartitions() == 14
    got = {r["campaign"]: r for r in QUERIES["attribution_chain"](spark, small).collect()}
    pairs = {(f"B{i % 4 % 2}", i % 70 + 1) for i in range(280)}
    won = {(c, o) for c, o in pairs if o < 60 and o % 29 and o % 3 != 2}
    assert {c: (r["opportunities"], r["won"]) for c, r in got.items()} == {c: (sum(x == c for x, _ in pairs), sum(x == c for x, _ in won)) for c in ("B0", "B1")}


def test_files_of_a_batch(spark, small):
    """A batch of the stream isn't one file, which one task would read."""
    stream = incremental._twice(spark, small)
    assert stream.isStreaming and all(len(p) > 1 for p in _files(stream))
    assert staging.dealt(spark.range(100), "id", rows=10).rdd.getNumPartitions() == 10


def test_parts_of_an_export(spark, tmp_path):
    """The log has a file for each task and not for each part; folders of parts are listed by a few tasks, not by one each."""
    out, key = str(tmp_path / "out"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    rows, before, cores = spark.range(200).selectExpr("id", "'t' || id AS t"), spark.conf.get(key), spark.sparkContext.defaultParallelism
    exports.export_parts(rows.where("id < 101"), out, ["id"], 2)
    spark.sparkContext.setJobGroup("resumed", "resumed")
    try:
        manifest = exports.export_parts(rows, out, ["id"], 2, resume=True)
        got = exports.exported(spark, out)
        assert sorted((int(r["id"]), r["t"]) for r in got.collect()) == [(k, f"t{k}") for k in range(200)] and got.columns == ["id", "t"]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r["part"], r["records"]) for r in manifest.orderBy("part").collect()] == [(k, 2) for k in range(100)]
    assert len(list((tmp_path / "out").glob("kind=data/part=*/part-*"))) == 100 and len(list((tmp_path / "out").glob("kind=log/part=*/part-*"))) <= 2 * cores
    told = spark.sparkContext.statusTracker()
    tasks = [told.getStageInfo(s).numTasks for j in told.getJobIdsForGroup("resumed") for s in told.getJobInfo(j).stageIds if told.getStageInfo(s)]
    assert tasks and max(tasks) <= 4 * cores and spark.conf.get(key) == before


def _files(stream):
    import re
    from pathlib import Path

    at = re.search(r"(/\S+)/part=\*", stream._jdf.queryExecution().logical().toString()).group(1).removeprefix("file:")
    return [list(Path(at).glob(f"part={k}/part-*")) for k in range(3)]
