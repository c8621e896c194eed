"""Queries of objects, versions, keys and calendars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import keys
from ..operators import object_query as oq
from ..operators import versions as v
from ..sources import bindings as b
from .registry import query


@query("SELECT id, version, event_id, stage, value, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, event_id DESC) AS r FROM ver) WHERE r = 1 AND NOT is_deleted")
def latest_version(spark, d):
    return v.latest_version(b.versions(spark, d), "id", "version", "event_id").where("not is_deleted")


@query("SELECT id, event_id, row_number() OVER (PARTITION BY id ORDER BY version DESC, event_id DESC) AS version_rank FROM ver")
def version_rank(spark, d):
    return v.version_rank(b.versions(spark, d), "id", "version", "event_id").select("id", "event_id", F.col("version_rank").cast("long").alias("version_rank"))


@query("""WITH m AS (SELECT max(version) - INTERVAL 30 DAY AS c FROM ver), base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, event_id DESC) AS r FROM ver, m WHERE version < c) WHERE r = 1),
delta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, event_id DESC) AS r FROM ver, m WHERE version >= c) WHERE r = 1)
SELECT id, event_id, stage FROM delta UNION ALL SELECT id, event_id, stage FROM base WHERE id NOT IN (SELECT id FROM delta)""")
def overlay_deltas(spark, d):
    ver = b.versions(spark, d)
    at = ver.agg((F.max("version") - F.make_dt_interval(F.lit(30))).alias("c"))
    split = ver.crossJoin(F.broadcast(at))  # one row
    base = v.latest_version(split.where("version < c").drop("c"), "id", "version", "event_id")
    return v.overlay_deltas(base, split.where("version >= c").drop("c"), "id", "version", "event_id").select("id", "event_id", "stage")


@query("SELECT event_id, user_id, user_id AS owner_id, event_type, event_type AS kind FROM events", views=False)
def alias_columns(spark, d):
    return v.alias_columns(b.table(spark, d, "events").select("event_id", "user_id", "event_type"), {"owner_id": "user_id", "kind": "event_type", "user_id": "event_id"})


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events", views=False)
def scan_object(spark, d):
    from ..sources.exchange import ObjectSpec
    from ..sources.exchange import scan_object as scan

    return scan(spark, ObjectSpec("events", (f"{d}/events.parquet",), "event_id long"))


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '1995-01-01 00:00:00' OR (ts = TIMESTAMP '1995-01-01 00:00:00' AND event_id > 10) ORDER BY ts, event_id LIMIT 2000", views=False)
def incremental_extract(spark, d):
    e = b.table(spark, d, "events").select("event_id", "ts")
    return v.incremental_extract(e, "ts", "event_id", (dt.datetime(1995, 1, 1), 10), 2000)


@query("SELECT id, version FROM ver WHERE is_deleted")
def deleted_ids(spark, d):
    return v.deleted_ids(b.versions(spark, d), "id", "version", "is_deleted")


@query("SELECT 'missing' AS finding, order_id FROM (SELECT order_id FROM ord EXCEPT SELECT order_id FROM line) UNION ALL SELECT 'unexpected', order_id FROM (SELECT order_id FROM line EXCEPT SELECT order_id FROM ord)")
def id_diff(spark, d):
    return v.id_diff(b.orders(spark, d), b.lines(spark, d), "order_id").select("finding", "order_id")


@query("SELECT event_id, event_type, value, NULL AS note FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, value, event_type FROM events WHERE event_id % 2 = 1", views=False)
def union_by_name(spark, d):
    e = b.table(spark, d, "events").select("event_id", "event_type", "value")
    return e.where("event_id % 2 = 0").unionByName(e.where("event_id % 2 = 1").withColumn("note", F.col("event_type")), allowMissingColumns=True)


@query("SELECT c_custkey, c_name FROM customer", views=False)
def oq_project(spark, d):
    return oq.object_query(b.table(spark, d, "customer"), ["C_CUSTKEY", "c_Name"])


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'", views=False)
def oq_eq_text(spark, d):
    return oq.object_query(b.table(spark, d, "customer"), ["c_custkey"], [("c_mktsegment", "=", "Building")])


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderpriority < '3'", views=False)
def oq_range(spark, d):
    return oq.object_query(b.table(spark, d, "orders"), ["o_orderkey"], [("o_totalprice", ">=", 100000), ("o_orderpriority", "<", "3")])


@query("SELECT p_partkey FROM part WHERE p_type ILIKE '%o_o%' OR p_type ILIKE 'zz%'", views=False)
def oq_like(spark, d):
    return oq.object_query(b.table(spark, d, "part"), ["p_partkey"], [("p_type", "LIKE", "%O_O%")])


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) IN ('p', 'f')", views=False)
def oq_in(spark, d):
    return oq.object_query(b.table(spark, d, "orders"), ["o_orderkey"], [("o_orderstatus", "in", ["p", "F"])])


@query("SELECT order_id, ship_date FROM ord LEFT JOIN ship USING (order_id) WHERE ship_date IS NULL")
def oq_null(spark, d):
    both = b.orders(spark, d).join(b.shipments(spark, d), "order_id", "left")
    return oq.object_query(both, ["order_id", "ship_date"], [("ship_date", "=", None)])


@query("SELECT event_id FROM events WHERE lower(event_type) <> 'click' AND value > 50", views=False)
def oq_and(spark, d):
    return oq.object_query(b.table(spark, d, "events"), ["event_id"], [("event_type", "!=", "CLICK"), ("value", ">", 50)])


@query("SELECT event_id, is_deleted FROM ver WHERE NOT is_deleted")
def oq_soft_delete(spark, d):
    return oq.object_query(b.versions(spark, d), ["event_id", "is_deleted"], deleted="IS_DELETED")


@query("SELECT order_id FROM ord WHERE order_date >= DATE '1996-01-01' AND customer_id < 100")
def oq_literals(spark, d):
    return oq.object_query(b.orders(spark, d), ["order_id"], [("order_date", ">=", "1996-01-01"), ("customer_id", "<", 100)])


@query("SELECT count(*) AS total_size FROM (SELECT * FROM orders LIMIT 500)", views=False)
def oq_total(spark, d):
    return oq.total_size(oq.object_query(b.table(spark, d, "orders"), limit=500))


@query("SELECT 'Customer' AS type, '/services/data/sobjects/Customer/' || CAST(c_custkey AS VARCHAR) AS url, c_name FROM customer", views=False)
def oq_record_envelope(spark, d):
    return oq.record_envelope(b.table(spark, d, "customer"), "Customer", "c_custkey").select("attributes.type", "attributes.url", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST LIMIT 2000", views=False)
def oq_order(spark, d):
    return oq.object_query(b.table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], order_by=("o_totalprice", "DESC"), limit=2000)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50", views=False)
def oq_limit_offset(spark, d):
    return oq.object_query(b.table(spark, d, "orders"), ["o_orderkey"], order_by=("o_orderkey", "ASC"), limit=100, offset=50)


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS sequence_number, o_orderkey FROM orders", views=False)
def result_index(spark, d):
    return oq.result_index(b.table(spark, d, "orders"), "o_orderkey", "o_totalprice", "o_orderkey")


@query("SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS sequence_number, event_id FROM events", views=False)
def sequence_numbering(spark, d):
    return oq.result_index(b.table(spark, d, "events"), "event_id", "event_id")


@query("SELECT sequence_number, o_orderkey FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS sequence_number, o_orderkey FROM orders) WHERE sequence_number BETWEEN 1000 AND 1499", views=False)
def page(spark, d):
    return oq.page(oq.result_index(b.table(spark, d, "orders"), "o_orderkey", "o_orderkey"), 500, 1000)


@query("SELECT sequence_number, o_orderkey, o_orderstatus FROM (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS sequence_number, * FROM orders) WHERE o_orderstatus <> 'F'", views=False)
def rehydrate(spark, d):
    o = b.table(spark, d, "orders")
    return oq.rehydrate(oq.result_index(o, "o_orderkey", "o_totalprice", "o_orderkey"), o.where("o_orderstatus <> 'F'"), "o_orderkey", ["o_orderstatus"])


@query("SELECT c_custkey FROM customer ORDER BY sha256(CAST(c_custkey AS VARCHAR) || ':s1') LIMIT 100", views=False)
def stable_sample(spark, d):
    return oq.stable_sample(b.table(spark, d, "customer").select("c_custkey"), "c_custkey", "s1", 100)


@query("SELECT max(TRY_CAST(substr(account_text, 5) AS BIGINT)) + 1 AS next_sequence FROM customers")
def next_sequence(spark, d):
    return b.customers(spark, d).agg((F.max(F.expr("try_cast(substr(account_text, 5) as bigint)")) + 1).alias("next_sequence"))


@query("SELECT segment, min(customer_id) AS customer_id FROM customers GROUP BY segment")
def pick_first(spark, d):
    return b.customers(spark, d).groupBy("segment").agg(F.min("customer_id").alias("customer_id"))


@query("SELECT customer_id, 'ACC-' || lpad(regexp_extract(account_text, '([0-9]+)', 1), 6, '0') AS account_number FROM customers")
def account_match(spark, d):
    c = b.customers(spark, d).select("customer_id", keys.canonical_account(F.col("account_text")).alias("account_number"))
    crm = b.table(spark, d, "customer").select(F.concat(F.lit("ACC-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("account_number"))
    return c.join(crm, "account_number").select("customer_id", "account_number")


@query("SELECT o_orderkey AS order_id, '001' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS account_id, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0", views=False)
def id_embedded_join(spark, d):
    account = F.when(F.col("o_orderkey") % 7 == 0, F.lit("bad-id")).otherwise(F.concat(F.lit("001"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")))
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), account.alias("account_id")).where(F.col("account_id").rlike("^001[0-9]{12}$"))
    return o.withColumn("c_custkey", F.substring("account_id", 4, 12).cast("long")).join(b.table(spark, d, "customer"), "c_custkey").select("order_id", "account_id", "c_name")


# Payloads in three spellings: keys in another order, blanks, escapes.
@query("""SELECT event_id, sha256(strftime(ts, '%Y-%m-%d') || '|crm|' || event_type || '|' || CAST(user_id AS VARCHAR) || '|{"k":' || (props->>'k') || ',"user":{"id":' || CAST(user_id AS VARCHAR) || ',"kind":"' || event_type || '","note":null,"tags":["b","\\u00e9",1.5]}}') AS stable_id FROM events""", views=False)
def stable_event_id(spark, d):
    # dealt out first: the work is in the texts, and a table of few row groups would have few tasks
    e = b.table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "props").repartition("event_id")
    k, user, kind = F.get_json_object("props", "$.k"), F.col("user_id").cast("string"), F.col("event_type")
    spellings = (
        ('{"k":', k, ',"user":{"id":', user, ',"kind":"', kind, '","note":null,"tags":["b","é",1.5]}}'),
        ('{ "user": {"tags": [ "b", "\\u00E9", 1.50 ], "note": null,\n "kind": "', kind, '", "id": ', user, '}, "k": ', k, " }"),
        ('{"user" :{"note":null,"id":', user, ',"tags":["\\u0062","\\u00e9",15e-1],"kind":"', kind, '"},\t"k":', k, "}"),
    )
    one, two, three = (F.concat(*(F.lit(x) if isinstance(x, str) else x for x in s)) for s in spellings)
    payload = F.when(F.col("event_id") % 3 == 0, one).when(F.col("event_id") % 3 == 1, two).otherwise(three)
    return e.select("event_id", keys.stable_event_id(F.to_date("ts"), F.lit("crm"), kind, F.col("user_id"), payload).alias("stable_id"))


@query("SELECT o_orderkey, sha256('inferred_baseline:order:' || CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus) AS event_key FROM orders", views=False)
def inferred_event_id(spark, d):
    return b.table(spark, d, "orders").select("o_orderkey", keys.inferred_event_id("order", F.col("o_orderkey"), F.col("o_orderstatus")).alias("event_key"))


@query("SELECT event_id, '001' || substr(sha1('job1:' || CAST(event_id AS VARCHAR)), 1, 15) AS record_id FROM events", views=False)
def generated_record_id(spark, d):
    return b.table(spark, d, "events").select("event_id", keys.generated_record_id("job1", F.col("event_id")).alias("record_id"))


@query("SELECT o_orderkey, CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2)) AS INTEGER) % 5 + 1 AS bucket FROM orders", views=False)
def stable_bucket(spark, d):
    return b.table(spark, d, "orders").select("o_orderkey", keys.stable_bucket(F.col("o_orderkey"), 5, 1).alias("bucket"))


@query("SELECT o_orderkey, CAST(('0x' || substr(sha256('seed:' || strftime(o_orderdate, '%G') || ':' || CAST(week(o_orderdate) AS VARCHAR)), 1, 2)) AS INTEGER) % 7 + 1 AS picked FROM orders", views=False)
def week_pick(spark, d):
    return b.table(spark, d, "orders").select("o_orderkey", cal.week_pick("seed", F.to_date("o_orderdate")).alias("picked"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) || chr(31) || CAST(l_partkey AS VARCHAR) AS line_key FROM lineitem", views=False)
def composite_key(spark, d):
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", keys.composite_key("l_orderkey", "l_partkey").alias("line_key"))


@query("SELECT order_id, strftime(order_date, '%Y-%m') AS fiscal_period FROM ord")
def fiscal_period(spark, d):
    return b.orders(spark, d).select("order_id", F.date_format("order_date", "yyyy-MM").alias("fiscal_period"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN false WHEN event_id % 4 = 2 THEN true END AS flag FROM events", views=False)
def strict_boolean(spark, d):
    text = F.element_at(F.array(F.lit("TRUE"), F.lit("0"), F.lit("1"), F.lit("yes")), (F.col("event_id") % 4 + 1).cast("int"))
    return b.table(spark, d, "events").select("event_id", keys.strict_boolean(text).alias("flag"))


@query("SELECT DISTINCT order_date, isodow(order_date) < 6 AND NOT (month(order_date) * 100 + day(order_date)) IN (101, 501, 1225, 1226) AS is_banking_day FROM ord")
def banking_day(spark, d):
    return b.orders(spark, d).select("order_date", cal.banking_day(F.col("order_date")).alias("is_banking_day")).distinct()


@query("""SELECT order_date, count(*) AS n, CAST(isodow(order_date) - 1 AS INTEGER) AS weekday, CAST(month(order_date) AS INTEGER) AS month, month(order_date) % 3 = 0 AND day(order_date) >= 16 AS quarter_end,
month(order_date) = 12 AND day(order_date) <= 22 AS december_peak, month(order_date) = 1 AND day(order_date) <= 12 AS january_dip, month(order_date) IN (7, 8) AS summer FROM ord GROUP BY order_date""")
def calendar_features(spark, d):
    return cal.features(b.orders(spark, d).groupBy("order_date").agg(F.count("*").alias("n")), "order_date").drop("is_banking_day")


@query("SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 1024", views=False)
def distinct_owners(spark, d):
    return b.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).union(b.table(spark, d, "supplier").select("s_suppkey")).where("s_suppkey is not null").distinct().orderBy("s_suppkey").limit(1024)


@query("SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_state FROM events", views=False)
def previous_state(spark, d):
    from ..operators.events import previous_state as f

    return f(b.table(spark, d, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", "previous_state")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS events_24h FROM events", views=False)
def rolling_usage(spark, d):
    e = b.table(spark, d, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0)).alias("events_24h"))


@query("SELECT user_id, event_type AS stage, ts AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", views=False)
def checkpoint_latest(spark, d):
    return b.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("at"))


@query("SELECT event_type, count(*) AS n, max(CAST(ts AS DATE)) AS last_date FROM events GROUP BY event_type", views=False)
def event_stats(spark, d):
    return b.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.to_date("ts")).alias("last_date"))


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-10' AND event_type = 'purchase'", views=False)
def events_through(spark, d):
    return b.table(spark, d, "events").where((F.to_date("ts") <= F.lit("2024-01-10").cast("date")) & (F.col("event_type") == "purchase")).select("event_id", "event_type").orderBy("event_id")
