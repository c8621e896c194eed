"""Queries of streams, exports and published days: each writes below the shared folder and gives what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bindings as b
from ..sources import exchange as x
from ..sources import staging
from ..sources.exports import matched
from ..streaming import streams
from .registry import query


def _stream(spark: SparkSession, d: str) -> DataFrame:
    # a pattern: a path without one must be a folder, and the table may be one file
    return streams.stream_deltas(spark, f"{d}/event[s].parquet", b.table(spark, d, "events").schema)


def _appended(spark: SparkSession, out: DataFrame) -> DataFrame:
    """What a stream gives until its input ends, written as Parquet and read again."""
    at = staging.folder(spark)
    streams.run_out(out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start())
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query("SELECT event_id, user_id, event_type, ts FROM events", views=False)
def stream_deltas(spark, d):
    return _appended(spark, _stream(spark, d).select("event_id", "user_id", "event_type", "ts"))


def _twice(spark: SparkSession, d: str, n: int = 1) -> DataFrame:
    """The events as a stream in three batches: all but the last `n` tenths, all, and all again. A batch has as many files as its rows need."""
    at, events = staging.folder(spark), b.table(spark, d, "events")
    for k, rows in enumerate((events.where(F.col("event_id") % 10 >= n), events, events)):
        staging.dealt(rows, "event_id").write.parquet(f"{at}/part={k}")
    files = max(len(matched(spark, f"{at}/part={k}/part-*")) for k in range(3))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/part=*").select(*events.columns)


@query("SELECT event_id, count(*) AS n FROM events GROUP BY event_id", views=False)
def stream_dedup(spark, d):
    """Every event comes in several batches; the watermark reaches back further than the events do, so none is late."""
    return _appended(spark, streams.stream_dedup(_twice(spark, d), "ts", "3650 days", "event_id").select("event_id")).groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", views=False)
def stream_current(spark, d):
    """In batches, of which later ones bring events again; folded after every second."""
    at = staging.folder(spark)
    streams.run_out(streams.stream_current(_twice(spark, d, 3), f"{at}/state", f"{at}/checkpoint", "user_id", "ts", "event_id", keep=2))
    return streams.read_current(spark, f"{at}/state", "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


# The watermark closes a window once an event comes later than its end and the delay; the last windows stay open.
@query("WITH w AS (SELECT date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS start_at FROM events, range(24) AS r(k)), c AS (SELECT start_at, start_at + INTERVAL 24 HOUR AS end_at, count(*) AS n FROM w GROUP BY start_at) SELECT * FROM c WHERE end_at <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)", views=False)
def stream_usage(spark, d):
    out = _appended(spark, streams.stream_usage(_stream(spark, d), "ts", "1 hour", "24 hours", "1 hour"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start_at"), F.col("end").cast("timestamp_ntz").alias("end_at"), "n")


@query("WITH c AS (SELECT time_bucket(INTERVAL 60 SECOND, ts) AS start_at, count(*) AS n FROM events GROUP BY 1) SELECT start_at, start_at + INTERVAL 60 SECOND AS end_at, n FROM c WHERE start_at + INTERVAL 60 SECOND <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)", views=False)
def stream_usage_minutes(spark, d):
    out = _appended(spark, streams.stream_usage(_stream(spark, d), "ts", "1 hour", "60 seconds"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start_at"), F.col("end").cast("timestamp_ntz").alias("end_at"), "n")


# Purchases within two days of a click, and clicks without one, as far back as the watermark of both sides tells.
@query("""WITH c AS (SELECT DISTINCT user_id, ts AS up_at FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts AS down_at FROM events WHERE event_type = 'purchase')
SELECT c.user_id, up_at, count(down_at) AS purchases, count(down_at) = 0 AS breached FROM c LEFT JOIN p ON p.user_id = c.user_id AND down_at BETWEEN up_at AND up_at + INTERVAL 2 DAY
WHERE up_at < least((SELECT max(up_at) FROM c), (SELECT max(down_at) FROM p)) - INTERVAL 4 DAY GROUP BY c.user_id, up_at""", views=False)
def stream_sla(spark, d):
    of = lambda kind: _stream(spark, d).where(F.col("event_type") == kind)
    out = _appended(spark, streams.stream_sla(of("click"), of("purchase"), "user_id", "ts", "ts", 2))
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    told = b.table(spark, d, "events").agg((F.least(last("click"), last("purchase")) - F.expr("interval 4 days")).alias("told"))  # one row
    rows = out.select("user_id", F.col("up_at").cast("timestamp_ntz").alias("up_at"), "down_at").join(F.broadcast(told), F.col("up_at") < F.col("told"))
    n = F.count("down_at")
    return rows.groupBy("user_id", "up_at").agg(n.alias("purchases"), (n == 0).alias("breached"))


@query("SELECT CAST(ts AS DATE) AS business_date, count(*) AS late FROM events WHERE event_id % 5 = 0 GROUP BY 1", views=False)
def stream_late(spark, d):
    at = staging.folder(spark)
    day = F.to_date("ts")
    events = _stream(spark, d).select("event_id", day.alias("business_date"), F.when(F.col("event_id") % 5 == 0, F.date_add(day, 1)).otherwise(day).alias("available_on"))
    streams.run_out(streams.stream_late(events, f"{at}/checkpoint", f"{at}/late"))
    return spark.read.parquet(f"{at}/late").groupBy("business_date").agg(F.sum("late").alias("late"))


# Notes with blanks around, quotes, line breaks, empty and NULL.
_NOTE = "CASE o_orderkey % 5 WHEN 0 THEN ' ' || o_orderpriority || ' ' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'a \"quoted\"' || chr(10) || ', line' ELSE o_orderpriority END"
_EXPORT = f"SELECT o_orderkey AS id, {_NOTE} AS note"


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("o_orderkey"), F.col("o_orderpriority")
    note = F.when(k % 5 == 0, F.concat(F.lit(" "), text, F.lit(" "))).when(k % 5 == 1, "").when(k % 5 == 2, None).when(k % 5 == 3, 'a "quoted"\n, line').otherwise(text)
    return b.table(spark, d, "orders").select(k.alias("id"), note.alias("note"))


# Parts have 4000 records each, and what is left.
@query(f"SELECT part, part * 4000 AS start_record, part * 4000 + count(*) AS end_record, count(*) AS records, sum(strlen(line) + 1) + 8 AS bytes FROM (SELECT CAST((row_number() OVER (ORDER BY id) - 1) // 4000 AS BIGINT) AS part, CAST(id AS VARCHAR) || ',' || CASE WHEN note IS NULL THEN '' WHEN note = '' THEN '\"\"' WHEN regexp_matches(note, '[,\"\\n]') THEN '\"' || replace(note, '\"', '\"\"') || '\"' ELSE note END AS line FROM ({_EXPORT} FROM orders)) GROUP BY part", views=False)
def export_parts(spark, d):
    m = x.export_parts(_ordered(spark, d), staging.folder(spark), ["id"], 4000)
    return m.select("part", "start_record", "end_record", "records", "bytes")


@query(f"SELECT id, note, record FROM (SELECT id, note, row_number() OVER (ORDER BY id) - 1 AS record FROM ({_EXPORT} FROM orders)) WHERE record BETWEEN 7 AND 8006", views=False)
def export_window(spark, d):
    m = x.export_parts(_ordered(spark, d), staging.folder(spark), ["id"], 3000)
    rows, _ = x.export_page(spark, m, "r:7", 8000)
    return rows.select(F.col("id").cast("long").alias("id"), "note", F.col("record").cast("long").alias("record"))


# An export of the first half, then one of all that goes on after it: no record is written twice, whole parts stay as they are.
@query(f"{_EXPORT}, CAST(1 AS BIGINT) AS times FROM orders", views=False)
def export_resume(spark, d):
    at, rows = staging.folder(spark), _ordered(spark, d)
    middle = rows.agg(F.percentile_approx("id", 0.5)).first()[0] or 0
    x.export_parts(rows.where(F.col("id") <= middle), at, ["id"], 2000)
    x.export_parts(rows, at, ["id"], 2000, resume=True)
    return x.exported(spark, at).groupBy(F.col("id").cast("long").alias("id"), "note").agg(F.count("*").alias("times"))


# Orders published by year, each year twice: the second time is a no-op.
@query("SELECT make_date(year(o_orderdate), 12, 31) AS business_date, count(*) AS records, CAST(1 AS BIGINT) AS published FROM orders GROUP BY 1", views=False)
def publish_delta(spark, d):
    root, orders = staging.folder(spark), b.table(spark, d, "orders").withColumn("business_date", F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)))
    told = [x.publish_deltas(orders, root, event_id="o_orderkey") for _ in range(2)]
    done = told[0].union(told[1]).groupBy(F.col("business_date").cast("date").alias("business_date")).agg(F.count_if("published").alias("published"))
    schema = "o_orderkey long, business_date date"
    counts = spark.read.schema(schema).parquet(root).groupBy("business_date").agg(F.count("*").alias("records")) if x.matched(spark, f"{root}/business_date=*") else spark.createDataFrame([], "business_date date, records long")
    return counts.join(F.broadcast(done), "business_date")  # a row for each date


def _orders_spec(*paths: str) -> x.ObjectSpec:
    return x.ObjectSpec("orders", paths, "o_orderkey bigint, o_orderpriority string", id="o_orderkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders", views=False)
def partition_column_hidden(spark, d):
    root = staging.folder(spark)
    b.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("business_date")).withColumn("business_date", F.trunc("business_date", "year")).write.partitionBy("business_date").parquet(root)
    return x.scan_object(spark, _orders_spec(root))


# The copy is made at first use; what the second call names isn't read.
@query("SELECT o_orderkey, o_orderpriority FROM orders", views=False)
def deferred_full_copy(spark, d):
    at = staging.folder(spark)
    x.deferred_full_copy(spark, _orders_spec(f"{d}/orders.parquet"), at)
    return x.deferred_full_copy(spark, _orders_spec(), at).select("o_orderkey", "o_orderpriority")
