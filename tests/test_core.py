import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from loomledger.functions import keys, money
from loomledger.operators import lifecycle as lc
from loomledger.operators import object_query as oq
from loomledger.operators import quality as q
from loomledger.operators import versions as v
from loomledger.operators.events import apply_patches, hold_and_release, idempotent_apply, valid_range_join
from loomledger.operators.metrics import mix_shift
from loomledger.sources.exchange import ObjectSpec, csv_ingest, csv_lines, deferred_full_copy, InvalidLocator, export_page, export_parts, export_window, part_page, publish_delta, publish_deltas, scan_object, snapshot_fingerprint
from loomledger.streaming import streams


def accounts(spark):
    return spark.createDataFrame([("001", "Acme", False), ("002", "Deleted", True), ("003", "Beta", False)], "Id string, Name string, IsDeleted boolean")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_object_query(spark):
    a = accounts(spark)
    assert ids(oq.object_query(a, ["id"], deleted="isdeleted")) == ["001", "003"]
    assert len(ids(oq.object_query(a, ["Id"], deleted="IsDeleted", include_deleted=True))) == 3
    assert ids(oq.object_query(a, ["Id"], [("name", "LIKE", "a%")])) == ["001"]
    assert ids(oq.object_query(a, ["Id"], [("Name", "IN", ["ACME", "BETA"])])) == ["001", "003"]
    for call in (lambda: oq.object_query(a, offset=2001), lambda: oq.object_query(a, ["x"]), lambda: oq.object_query(a, where=[("Name", "<", None)]), lambda: oq.page(a, 199)):
        with pytest.raises(oq.QueryError):
            call()


def test_index_pages_and_rehydrate(spark):
    a = accounts(spark)
    index = oq.result_index(a, "Id", "Name", "Id")
    assert [(r[0], r[1]) for r in index.orderBy("sequence_number").collect()] == [(0, "001"), (1, "003"), (2, "002")]
    back = oq.rehydrate(spark.createDataFrame([(0, "003"), (1, "001"), (2, "gone")], "sequence_number long, Id string"), a, "Id", ["Name"]).collect()
    assert [r["Name"] for r in back] == ["Beta", "Acme"]


def test_versions(spark):
    base = spark.createDataFrame([("1", "a", 1), ("2", "b", 1)], "id string, name string, v int")
    delta = spark.createDataFrame([("1", "c", 2), ("3", "d", 2)], "id string, name string, v int")
    assert sorted((r["id"], r["name"]) for r in v.overlay_deltas(base, delta, "id", "v").collect()) == [("1", "c"), ("2", "b"), ("3", "d")]
    assert sorted((r["id"], r["name"]) for r in v.latest_version(base.union(delta), "id", "v").collect()) == [("1", "c"), ("2", "b"), ("3", "d")]
    assert v.alias_columns(base, {"owner": "name", "name": "id"}).first()["name"] == "a"


def test_scan(spark, tmp_path):
    accounts(spark).write.parquet(str(tmp_path / "a"))
    accounts(spark).withColumn("Extra", F.lit(1)).write.parquet(str(tmp_path / "b"))
    df = scan_object(spark, ObjectSpec("acc", (str(tmp_path / "a"), str(tmp_path / "b")), "Id string", aliases={"OwnerId": "Id"}))
    assert df.count() == 6 and {"Extra", "OwnerId"} <= set(df.columns)
    assert scan_object(spark, ObjectSpec("none", (), "Id string, N int")).dtypes == [("Id", "string"), ("N", "int")]
    assert snapshot_fingerprint(df.select("Id")).first()[0] if "_metadata" in df.columns else True


def test_money(spark):
    rates = spark.createDataFrame([("EUR", dt.date(2024, 1, 2), "1.25"), ("GBP", dt.date(2024, 1, 2), "1.10")], "currency string, rate_date date, r string").select("currency", "rate_date", F.col("r").cast("decimal(18,8)").alias("rate"))
    daily = money.fx_daily(rates, "2024-01-01", "2024-01-05")
    assert daily.where("currency = 'EUR'").count() == 5 and daily.where("rate is null").count() == 0
    row = spark.createDataFrame([(100.0, "GBP", "EUR", dt.date(2024, 1, 4)), (5.0, "XXX", "EUR", dt.date(2024, 1, 4))], "a double, s string, t string, d date").withColumn("a", F.col("a").cast("decimal(18,2)"))
    got = {r["s"]: r["o"] for r in money.convert_currency(row, daily, "a", "s", "t", "d", "o").collect()}
    assert float(got["GBP"]) == 88.0 and got["XXX"] is None


def test_keys(spark):
    row = spark.createDataFrame([("ACC 000123",), ("acc-123",), (" ACC-123 ",), ("none",)], "a string").select(keys.canonical_account(F.col("a")).alias("k"))
    assert [r["k"] for r in row.collect()] == ["ACC-000123"] * 3 + [None]


def test_history(spark):
    t = dt.datetime
    rows = [
        (1, "INVOICED", t(2024, 8, 1, 9), t(2024, 8, 2, 9), dt.date(2024, 8, 6), dt.date(2024, 8, 3), None),
        (2, "CANCELLED", t(2024, 8, 1), t(2024, 8, 2), dt.date(2024, 8, 6), None, None),
        (3, "INVOICED", t(2024, 8, 1, 9), None, dt.date(2024, 8, 6), dt.date(2024, 8, 1), None),
    ]
    orders = spark.createDataFrame(rows, "order_id long, status string, created_at timestamp_ntz, updated_at timestamp_ntz, requested_date date, ship_date date, invoiced_at timestamp_ntz")
    h = lc.infer_order_history(orders)
    got = [(r["entity_id"], r["previous_status"], r["new_status"]) for r in h.orderBy("entity_id", "step").collect()]
    assert got == [(1, None, "PENDING"), (1, "PENDING", "SHIPPED"), (1, "SHIPPED", "INVOICED"), (2, None, "PENDING"), (2, "PENDING", "CANCELLED"), (3, None, "PENDING"), (3, "PENDING", "SHIPPED")]
    assert h.where("entity_id = 1 and new_status = 'INVOICED'").first()["occurred_at"] == t(2024, 8, 3)
    assert h.where("entity_id = 3 and new_status = 'SHIPPED'").first()["occurred_at"] == t(2024, 8, 1)
    assert tuple(lc.infer_report(h).first()) == (3, 3, 7, 1)
    assert lc.transition_check(h.where("new_status is not null"), "order").count() == 0


def test_events(spark):
    e = spark.createDataFrame([("a",), ("a",), ("b",)], "event_id string")
    assert ids(idempotent_apply(e, spark.createDataFrame([("b",)], "event_id string"))) == ["a"]
    held = hold_and_release(spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)], "d date"), "d", ["2024-01-01"])
    assert {r["publish_on"] for r in held.collect()} == {dt.date(2024, 1, 2)}
    cur = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    pat = spark.createDataFrame([(1, "update", "z"), (2, "create", "q"), (9, "update", "r"), (3, "create", "n")], "id int, op string, name string")
    assert {r["id"]: (r["action"], r["name"]) for r in apply_patches(cur, pat, "id", ["name"]).collect()} == {1: ("update", "z"), 2: ("error", "q"), 9: ("error", "r"), 3: ("create", "n")}


def test_quality(spark):
    df = spark.createDataFrame([(1, None, dt.date(2024, 1, 1)), (2, None, dt.date(2024, 1, 2)), (3, "n", dt.date(2024, 1, 2))], "id int, note string, order_date date")
    p = q.profile_columns(df, exact=True)
    assert {r["column_name"]: r["nulls"] for r in p.collect()}["note"] == 2
    assert q.partition_advice(p, 2) == ("order_date", 2)
    assert q.check_constraints(df, "t", {"small": F.col("id") < 3, "note": F.col("note") == "n"}).where("violations > 0").count() == 1
    c = q.contract_columns(df, "t")
    known = q.schema_fingerprint(c).select("table_name", F.lit(1).alias("version"), "schema_fingerprint", F.lit(False).alias("retired"))
    assert q.contract_versions(known, q.schema_fingerprint(c)).count() == 1
    wider = q.contract_columns(df.withColumn("x", F.lit(1)), "t")
    assert q.contract_versions(known, q.schema_fingerprint(wider)).where("not retired").first()["version"] == 2
    assert [tuple(r) for r in q.schema_drift(c, wider).collect()] == [("t", "x", "added")]
    both = q.contract_versions(known, q.schema_fingerprint(wider).union(q.schema_fingerprint(q.contract_columns(df.drop("note"), "t"))))
    assert sorted((r["version"], r["retired"]) for r in both.collect()) == [(1, True), (2, True), (3, False)]
    assert [tuple(r) for r in q.describe_type(df.withColumn("x__c", F.lit(1.5)), "id").collect()] == [("id", "id", False, False), ("note", "string", True, False), ("order_date", "datetime", True, False), ("x__c", "double", True, True)]
    loaded = q.typed_load(df.select(F.col("id").cast("string")), {"id": "bigint", "note": "string"}, {"id", "note"}, {"note": F.concat(F.lit("n"), F.col("id").cast("string"))})
    assert [tuple(r) for r in loaded.orderBy("id").collect()] == [(1, "n1"), (2, "n2"), (3, "n3")]
    with pytest.raises(ValueError):
        q.typed_load(df, {"z": "int"}, {"z"}, {})


def test_ingest_and_export(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Id,Name,IsDeleted\n,New,false\n001,Duplicate,false\n,Invalid,not-a-bool\n009,Short\n")
    rows = csv_lines(spark, str(path), ["Id", "Name", "IsDeleted"])
    assert rows.where("surplus").count() == 0
    ok, bad = csv_ingest(rows, {"Id": "string", "Name": "string", "IsDeleted": "boolean"}, spark.createDataFrame([("001",)], "Id string"))
    assert sorted(r["Name"] for r in ok.collect()) == ["New", "Short"]
    assert {r["Name"]: r["error"] for r in bad.collect()} == {"Duplicate": "DUPLICATE_VALUE: Id already exists", "Invalid": "IsDeleted: invalid boolean"}
    manifest = export_parts(spark.range(25), str(tmp_path / "out"), ["id"], 10)
    assert manifest.agg(F.sum("records"), F.max("end_record")).first()[:] == (25, 25)
    window, after = export_window(spark, manifest, 8, 5)
    assert [(r["record"], r["id"]) for r in window.orderBy("record").collect()] == [(k, str(k)) for k in range(8, 13)] and after == 13
    assert export_window(spark, manifest, 20, 5)[1] is None
    with pytest.raises(ValueError):
        export_window(spark, manifest, 99, 1)
    day = spark.createDataFrame([(1,), (2,)], "event_id int")
    assert publish_delta(day, str(tmp_path / "d"), "2024-01-01") and not publish_delta(day, str(tmp_path / "d"), "2024-01-01")
    with pytest.raises(ValueError):
        publish_delta(day.limit(1), str(tmp_path / "d"), "2024-01-01")
    days = spark.createDataFrame([(k, dt.date(2024, 1, 1 + k % 3)) for k in range(1, 10)], "event_id int, business_date date")
    assert publish_deltas(days, str(tmp_path / "e")).where("published").count() == 3 and publish_deltas(days, str(tmp_path / "e")).where("published").count() == 0
    with pytest.raises(ValueError, match="2024-01-02"):  # nothing of the other dates is written, either
        publish_deltas(days.where("event_id != 4").union(spark.createDataFrame([(50, dt.date(2024, 2, 1))], days.schema)), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 9
    (tmp_path / "e/_claims/2024-03-01").write_text("1:2:3")  # another writer is at it
    with pytest.raises(ValueError, match="2024-03-01"):
        publish_deltas(spark.createDataFrame([(60, dt.date(2024, 3, 1))], days.schema), str(tmp_path / "e"))


def test_export_counts_and_resume(spark, tmp_path):
    """Line ends inside values are no records; a rerun keeps what is committed and drops what isn't."""
    out = str(tmp_path / "out")
    text = spark.range(7).select("id", F.when(F.col("id") == 3, "").when(F.col("id") != 5, F.concat(F.lit(' a "quoted"\nline '), F.col("id").cast("string"), F.lit(" "))).alias("t"))
    first = export_parts(text.where("id < 4"), out, ["id"], 2).orderBy("part").collect()
    assert [(r["part"], r["start_record"], r["end_record"], r["records"]) for r in first] == [(0, 0, 2, 2), (1, 2, 4, 2)]
    for r in first:
        whole = (tmp_path / "out" / r["path"].partition("/out/")[2]).read_bytes()
        assert (len(whole), hashlib.sha256(whole).hexdigest()) == (r["bytes"], r["sha256"])
    (tmp_path / "out/kind=data/part=2").mkdir()
    (tmp_path / "out/kind=data/part=2/part-00000-x.txt").write_text("id,t\n99,lost\n")  # without a log
    cut = tmp_path / "out" / first[1]["path"].partition("/out/")[2]
    cut.write_bytes(cut.read_bytes()[:-3])  # shorter than its log says
    again = export_parts(text, out, ["id"], 2, resume=True).orderBy("part").collect()
    assert [r["records"] for r in again] == [2, 2, 2, 1] and again[0]["path"] == first[0]["path"] and again[1]["sha256"] == first[1]["sha256"]
    manifest = export_parts(text, out, ["id"], 2, resume=True)
    assert [r["path"] for r in manifest.orderBy("part").collect()] == [r["path"] for r in again]
    window, after = export_page(spark, manifest, "r:1", 5)
    assert [(r["record"], r["t"]) for r in window.orderBy("record").collect()] == [(k, "" if k == 3 else None if k == 5 else f' a "quoted"\nline {k} ') for k in range(1, 6)] and after == "r:6"
    assert export_page(spark, manifest, after, 9)[1] is None and part_page(manifest, "3")[1:] == (1, None) and part_page(manifest, None)[2] == "1"
    for bad in ("r:7", "r:-1", "r:x", "6", "r:"):
        with pytest.raises(InvalidLocator):
            export_page(spark, manifest, bad, 1)
    for call in (lambda: export_page(spark, manifest, None, 0), lambda: part_page(manifest, "4"), lambda: part_page(manifest, "x")):
        with pytest.raises(InvalidLocator):
            call()
    assert export_parts(text.limit(0), out, ["id"], 2).count() == 0


def test_export_goes_on_after_a_failure(spark, tmp_path):
    """What tasks had committed when a job failed stays; the next run writes the rest."""
    out = str(tmp_path / "out")
    good = spark.range(100).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    export_parts(good.where("id < 50"), out, ["id"], 10)
    kept = {p.name for p in (tmp_path / "out").glob("kind=data/part=*/part-*")}
    broken = good.withColumn("t", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        export_parts(broken, out, ["id"], 10, resume=True)
    manifest = export_parts(good, out, ["id"], 10, resume=True)
    assert manifest.agg(F.count("*"), F.sum("records"), F.max("records")).first()[:] == (10, 100, 10)
    assert kept <= {p.name for p in (tmp_path / "out").glob("kind=data/part=*/part-*")}


def test_export_log_of_parts_written_again(spark, tmp_path):
    """Of a part that is written again the log tells of its new file alone, though it be as long as the old one."""
    out = str(tmp_path / "out")
    rows = spark.range(40).select("id", F.concat(F.lit("a"), F.col("id").cast("string")).alias("t"))
    first = {r["part"]: r for r in export_parts(rows, out, ["id"], 2).collect()}
    for part, r in first.items():
        if part % 4:
            cut = tmp_path / "out" / r["path"].partition("/out/")[2]
            cut.write_bytes(cut.read_bytes()[:-3])
    changed = rows.withColumn("t", F.translate("t", "a", "b"))
    for _ in range(2):  # the second time all are kept
        manifest = {r["part"]: r for r in export_parts(changed, out, ["id"], 2, resume=True).collect()}
        assert len(manifest) == 20
        for part, r in manifest.items():
            whole = (tmp_path / "out" / r["path"].partition("/out/")[2]).read_bytes()
            assert (len(whole), hashlib.sha256(whole).hexdigest(), 2) == (r["bytes"], r["sha256"], r["records"])
            assert (r["bytes"] == first[part]["bytes"]) and (r["path"] == first[part]["path"]) == (part % 4 == 0) and (b",b" in whole) == (part % 4 > 0)


def test_scan_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,Id\ny,2\n")
    (tmp_path / "b.csv").write_text("Id,Name\n1,x\n")
    spec = ObjectSpec("acc", (str(tmp_path / "*.csv"),), "Id string, Name string", format="csv")
    assert sorted(tuple(r) for r in scan_object(spark, spec).collect()) == [("1", "x"), ("2", "y")]
    none = scan_object(spark, ObjectSpec("none", (str(tmp_path / "*.parquet"),), "Id string, N int"))
    assert none.dtypes == [("Id", "string"), ("N", "int")] and none.count() == 0
    accounts(spark).withColumn("business_date", F.lit("2024-01-01")).write.partitionBy("business_date").parquet(str(tmp_path / "p"))
    assert "business_date" not in scan_object(spark, ObjectSpec("acc", (str(tmp_path / "p"),), "Id string")).columns
    copy = deferred_full_copy(spark, spec, str(tmp_path / "copy"))
    (tmp_path / "b.csv").write_text("Id,Name\n1,changed\n")
    assert sorted(r["Name"] for r in deferred_full_copy(spark, spec, str(tmp_path / "copy")).collect()) == ["x", "y"] == sorted(r["Name"] for r in copy.collect())
    (tmp_path / "b.csv").write_text("Id,Name\n2,again\n")
    with pytest.raises(ValueError):
        deferred_full_copy(spark, spec, str(tmp_path / "other"))


def test_like_and_types(spark):
    df = spark.createDataFrame([("a\\%b",), ("a%b",), ("axb",)], "t string")
    assert ids(oq.object_query(df, where=[("t", "LIKE", "A\\%B")])) == ["a\\%b"]
    assert len(ids(oq.object_query(df, where=[("t", "LIKE", "A%B")]))) == 3
    with pytest.raises(oq.QueryError):
        oq.object_query(df, where=[("t", "=", 5)])


def test_valid_ranges_keep_equal_facts(spark):
    d = dt.date
    facts = spark.createDataFrame([("k", d(2024, 1, 5))] * 2 + [("k", d(2025, 1, 1)), ("k", d(2020, 1, 1)), ("z", d(2024, 1, 5))], "k string, at date")
    ranges = spark.createDataFrame([("k", "b", d(2023, 1, 1), None), ("k", "a", d(2024, 1, 1), d(2024, 2, 1))], "k string, code string, valid_from date, valid_to date")
    got = sorted((r["k"], r["at"], r["code"] or "") for r in valid_range_join(facts, ranges, "k", "at", "code").collect())
    assert got == [("k", d(2020, 1, 1), ""), ("k", d(2024, 1, 5), "a"), ("k", d(2024, 1, 5), "a"), ("k", d(2025, 1, 1), "b"), ("z", d(2024, 1, 5), "")]


def run_out(query):
    query.awaitTermination(90)
    assert query.exception() is None


def test_streams_over_two_batches(spark, tmp_path):
    t = lambda h, m=0, day=1: dt.datetime(2024, 1, day, h, m)
    src, schema = str(tmp_path / "src"), "event_id long, user_id long, stage string, ts timestamp_ntz, available_on date, business_date date"
    batches = (
        [(1, 7, "a", t(1), dt.date(2024, 1, 1), dt.date(2024, 1, 1)), (2, 8, "a", t(2), dt.date(2024, 1, 2), dt.date(2024, 1, 1))],
        [(1, 7, "a", t(1), dt.date(2024, 1, 1), dt.date(2024, 1, 1)), (3, 7, "b", t(3), dt.date(2024, 1, 3), dt.date(2024, 1, 1)), (4, 9, "z", t(5, day=9), dt.date(2024, 1, 9), dt.date(2024, 1, 9)), (5, 10, "b", t(6, day=9), dt.date(2024, 1, 9), dt.date(2024, 1, 9))],
    )
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = lambda: streams.stream_deltas(spark, src, spark.createDataFrame([], schema).schema)
        sink = lambda name, df, mode="append": run_out(df.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start())
        sink("dedup", streams.stream_dedup(stream(), "ts", "1 day", "event_id"))
        run_out(streams.stream_current(stream(), str(tmp_path / "state"), str(tmp_path / "ck-state"), "user_id", "ts"))
        run_out(streams.stream_late(stream(), str(tmp_path / "ck-late"), str(tmp_path / "late")))
        sink("usage", streams.stream_usage(stream(), "ts", "1 hour", "2 hours", "1 hour"))
        sink("sla", streams.stream_sla(stream().where("stage <> 'b'"), stream().where("stage = 'b'"), "user_id", "ts", "ts", 1))
        now = {r["user_id"]: r["stage"] for r in streams.read_current(spark, str(tmp_path / "state"), "user_id", "ts").collect()}
        assert now == ({7: "a", 8: "a"}, {7: "b", 8: "a", 9: "z", 10: "b"})[n]
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "dedup")).collect()) == [1, 2, 3, 4, 5]
    late = spark.read.parquet(str(tmp_path / "late"))
    assert sorted((r["batch"], r["late"]) for r in late.collect()) == [(0, 1), (1, 1)]
    usage = {r["start"].hour: r["n"] for r in spark.read.parquet(str(tmp_path / "usage")).collect() if r["start"].day == 1}
    assert usage[1] >= 2 and usage[3] == 1  # overlapping windows
    sla = {(r["user_id"], r["breached"]) for r in spark.read.parquet(str(tmp_path / "sla")).collect()}
    assert (7, False) in sla and (8, True) in sla


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(1, 7, "a", dt.datetime(2024, 1, 1, 0, 0, 5)), (1, 7, "a", dt.datetime(2024, 1, 1, 0, 0, 5)), (2, 7, "b", dt.datetime(2024, 1, 1, 0, 1, 5))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, stage string, ts timestamp_ntz")
    df.coalesce(1).write.parquet(src)
    stream = streams.stream_deltas(spark, src, df.schema)
    q1 = streams.stream_dedup(stream, "ts", "1 day", "event_id").writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q1.awaitTermination(60)
    assert spark.table("dedup").count() == 2
    q2 = streams.stream_current(stream, str(tmp_path / "state"), str(tmp_path / "ck"), "user_id", "ts")
    q2.awaitTermination(60)
    assert streams.read_current(spark, str(tmp_path / "state"), "user_id", "ts").first()["stage"] == "b"
    q3 = streams.stream_usage(stream, "ts", "1 minute", "60 seconds").writeStream.outputMode("complete").format("memory").queryName("usage").trigger(availableNow=True).start()
    q3.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("usage").collect()) == [1, 2]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_folds_and_published_history(spark):
    t = lambda day: dt.datetime(2024, 1, day)
    e = spark.createDataFrame([(1, "order", t(1)), (1, "invoice", t(3)), (2, "order", t(1)), (2, "order", t(2)), (2, "shipment", t(4)), (3, "shipment", t(1))], "id long, kind string, at timestamp_ntz")
    f = lc.fold_status(e, "id", [("order", "PENDING"), ("shipment", "SHIPPED"), ("invoice", "INVOICED")])
    assert {r["id"]: (r["status"], r["updated_at"]) for r in f.collect()} == {1: ("PENDING", t(1)), 2: ("SHIPPED", t(4)), 3: (None, None)}
    v = spark.createDataFrame([(1, 7, "a", t(1)), (2, 7, "a", t(2)), (3, 7, "b", t(3)), (4, 8, None, t(1))], "e long, id long, stage string, at timestamp_ntz")
    h = lc.stage_history(v, "id", "stage", "at")
    assert {(r["e"], r["previous"]) for r in h.collect()} == {(1, None), (3, "a"), (4, None)}
    found = lambda actual: {r[0]: r[1] for r in lc.stage_history_check(h, actual, "e", "id", "stage", "at", "2024-01-01", "2024-01-02").collect() if r[1]}
    assert found(h) == {"outside_partition": 1}
    assert found(h.where("e < 3").union(h.where("e = 1"))) == {"duplicate_id": 1, "missing_id": 2}


def test_ledger_changes_and_mix_shift(spark):
    old = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id long, x long")
    new = spark.createDataFrame([(1, 6), (2, None), (4, 1)], "id long, x long")
    assert {tuple(r) for r in q.ledger_changes(old, new, "id").collect()} == {(1, "changed"), (3, "deleted")}
    p = lambda *rows: spark.createDataFrame(rows, "s string, r double, m double")
    got = {r[0]: r[1:] for r in mix_shift(p(("a", 50.0, 25.0), ("b", 50.0, 10.0)), p(("a", 75.0, 37.5), ("c", 25.0, 5.0)), "s", "r", "m").collect()}
    assert got["a"] == (0.125, 0.0) and got["b"] == pytest.approx((-0.1, 0.0)) and got["c"] == pytest.approx((0.0, 0.05))
