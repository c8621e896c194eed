"""Queries of file intake, contracts, loads, progress and event ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import at_hour
from ..functions.keys import generated_record_id
from ..operators import events as ev
from ..operators import lifecycle as lc
from ..operators import quality as q
from ..sources import bindings as b
from ..sources import exchange as x
from ..sources.staging import folder
from .records import _FACTS, facts
from .registry import query


# Orders as CSV files, one for each month: a header and a record for each order. Some ids hold a line break and quotes, blank lines stand between, and files of even months end their lines with CR and LF.
_LINES = """ln AS (SELECT strftime(o_orderdate, '%Y-%m') AS file, o_orderkey AS n, strftime(o_orderdate, '%Y-%m') || ':' || CAST(row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS VARCHAR) AS row_number,
CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'A' || CAST(CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey // 150 * 150 ELSE o_orderkey END AS VARCHAR) || CASE WHEN o_orderkey % 17 = 0 AND o_orderkey % 50 > 0 THEN chr(10) || '"x", y' ELSE '' END END AS id,
CASE WHEN o_orderkey % 37 = 0 THEN 'abc' WHEN o_orderkey % 31 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS amount,
CASE WHEN o_orderkey % 41 = 0 THEN 'maybe' WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE '' END AS flag,
strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 43 = 0 THEN 'x' ELSE '' END AS day, o_orderdate AS t FROM orders),
fl AS (SELECT file, count(*) AS "rows", CASE WHEN right(file, 2) = '03' THEN 'unknown column' WHEN right(file, 2) = '05' THEN 'empty column name' WHEN max(CASE WHEN n % 3001 = 7 AND n % 47 > 0 THEN 1 ELSE 0 END) = 1 THEN 'too many values' END AS error FROM ln GROUP BY file),
okl AS (SELECT * FROM ln WHERE file IN (SELECT file FROM fl WHERE error IS NULL))"""
_COLUMNS = ["Id", "Amount", "IsDeleted", "Day", "At"]
_KINDS = {"Id": "string", "Amount": "bigint", "IsDeleted": "boolean", "Day": "date", "At": "timestamp"}


def lines(spark, d, delimiter: str = ","):
    """Files of March have an unknown column and those of May an empty name; some rows are short, and a few have a value too many. Times have offsets."""
    n = F.col("o_orderkey")
    ident = F.concat(F.lit("A"), F.when(n % 50 == 0, F.floor(n / 150) * 150).otherwise(n).cast("string"))
    ident = F.when(n % 23 == 0, "").when((n % 17 == 0) & (n % 50 > 0), F.concat(F.lit('"'), ident, F.lit('\n""x"", y"'))).otherwise(ident)
    amount = F.when(n % 37 == 0, "abc").when(n % 31 == 0, "").otherwise(n.cast("string"))
    flag = F.when(n % 41 == 0, "maybe").when(n % 2 == 0, "TRUE").otherwise("")
    day = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(n % 43 == 0, "x").otherwise(""))
    hours = (n % 25 - 12).cast("int")
    offset = F.concat(F.when(hours < 0, "-").otherwise("+"), F.lpad(F.abs(hours).cast("string"), 2, "0"), F.lit(":30"))
    local = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hours, F.when(hours < 0, -30).otherwise(30))
    at = F.when(n % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), offset))
    file, sep = F.date_format("o_orderdate", "yyyy-MM"), F.lit(delimiter)
    short = F.concat(ident, sep, amount)
    full = F.concat(short, sep, flag, sep, day, sep, at, F.when(n % 3001 == 7, F.concat(sep, F.lit("more"))).otherwise(""))
    body = b.table(spark, d, "orders").select(file.alias("file"), (n + 1).alias("line_no"), F.concat(F.when(n % 47 == 0, short).otherwise(full), F.when(n % 13 == 0, "\n").otherwise("")).alias("line"))
    names = F.when(F.col("file").endswith("-03"), delimiter.join(["Id", "Amount", "IsDeleted", "Other"])).when(F.col("file").endswith("-05"), delimiter.join(["Id", "Amount", "", "Day"])).otherwise(delimiter.join(_COLUMNS))
    both = body.union(body.select("file").distinct().select("file", F.lit(0).cast("long"), names))
    return both.withColumn("line", F.when(F.substring("file", 7, 1).cast("int") % 2 == 0, F.concat("line", F.lit("\r"))).otherwise(F.col("line")))


def parsed(spark, d, delimiter: str = ","):
    """The files are written, one for each month, and read as any upload is."""
    at = folder(spark)
    lines(spark, d, delimiter).repartition("file").sortWithinPartitions("file", "line_no").select("line", "file").write.partitionBy("file").text(at)
    rows, files = x.read_uploads(spark, f"{at}/file=*", _COLUMNS, delimiter)
    month = F.regexp_extract("file", "file=([0-9-]+)", 1)
    return rows.withColumns({"file": month, "row_number": F.concat(month, F.lit(":"), F.col("row_number").cast("string"))}), files.withColumn("file", month)


def loaded(spark, d, rows=None):
    existing = b.table(spark, d, "orders").where("o_orderkey % 1000 < 4").select(F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("Id"))
    return x.csv_ingest(parsed(spark, d)[0] if rows is None else rows, _KINDS, existing)


@query(f"WITH {_LINES} SELECT file, \"rows\", error FROM fl WHERE error IS NULL OR error <> 'too many values'")
def ingest_header(spark, d):
    return parsed(spark, d)[1].where("error is null or error <> 'too many values'")


@query(f"WITH {_LINES} SELECT file, \"rows\" FROM fl WHERE error = 'too many values'")
def ingest_width(spark, d):
    return parsed(spark, d)[1].where("error = 'too many values'").select("file", "rows")


@query(f"WITH {_LINES} SELECT row_number, id AS Id, amount AS Amount, CASE WHEN n % 47 > 0 THEN flag END AS IsDeleted, CASE WHEN n % 47 > 0 THEN day END AS Day FROM okl")
def ingest_short_row(spark, d):
    return parsed(spark, d)[0].select("row_number", "Id", "Amount", "IsDeleted", "Day")


@query(f"WITH {_LINES} SELECT row_number, file, id AS Id, amount AS Amount FROM okl")
def ingest_delimiter(spark, d):
    return parsed(spark, d, "|")[0].select("row_number", "file", "Id", "Amount")


_COERCED = "co AS (SELECT n, row_number, id, CASE WHEN n % 31 > 0 AND n % 37 > 0 THEN n END AS amount, n % 2 = 0 AND n % 47 > 0 AS flag, CASE WHEN n % 47 > 0 AND n % 43 > 0 THEN CAST(day AS DATE) END AS day, CASE WHEN n % 47 > 0 THEN t END AS t, CASE WHEN n % 37 = 0 THEN 'Amount: invalid bigint' WHEN n % 41 = 0 AND n % 47 > 0 THEN 'IsDeleted: invalid boolean' WHEN n % 43 = 0 AND n % 47 > 0 THEN 'Day: invalid date' END AS error FROM okl)"


@query(f"WITH {_LINES}, {_COERCED} SELECT row_number, amount AS Amount, flag AS IsDeleted, day AS Day, CAST(t AS TIMESTAMP) AS At FROM co WHERE error IS NULL AND id = ''")
def ingest_coerce(spark, d):
    """Of the rows without an id, which no other can repeat."""
    rows = parsed(spark, d)[0].where("Id = ''")
    return x.csv_ingest(rows, _KINDS, None)[0].select("row_number", "Amount", "IsDeleted", "Day", "At")


@query(f"WITH {_LINES}, {_COERCED} SELECT row_number, '001' || substr(sha1('job:' || row_number), 1, 15) AS Id FROM co WHERE error IS NULL AND id = ''")
def ingest_ids(spark, d):
    return loaded(spark, d)[0].where(F.col("Id") == generated_record_id("job", F.col("row_number"))).select("row_number", "Id")


@query(f"WITH {_LINES}, {_COERCED}, g AS (SELECT row_number, count(*) OVER (PARTITION BY id) > 1 AS again, id IN (SELECT 'A' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 1000 < 4) AS there FROM co WHERE error IS NULL AND id <> '') SELECT row_number FROM g WHERE again OR there")
def ingest_duplicates(spark, d):
    return loaded(spark, d)[1].where("error like 'DUPLICATE%'").select("row_number")


@query(f"WITH {_LINES}, {_COERCED}, g AS (SELECT left(row_number, 4) AS job, error IS NULL AND (id = '' OR count(*) OVER (PARTITION BY id, error IS NULL) = 1 AND id NOT IN (SELECT 'A' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 1000 < 4)) AS good FROM co) SELECT job, CASE WHEN good THEN 'success' ELSE 'failed' END AS outcome, count(*) AS n FROM g GROUP BY ALL")
def ingest_outcome_counts(spark, d):
    """By year: the job of a row."""
    good, bad = loaded(spark, d)
    both = good.select("row_number", F.lit("success").alias("outcome")).union(bad.select("row_number", F.lit("failed")))
    return both.groupBy(F.left("row_number", F.lit(4)).alias("job"), "outcome").agg(F.count("*").alias("n"))


@query("SELECT 'events' AS object, count(*) AS n, max(event_id) AS last FROM events UNION ALL SELECT 'none', 0, NULL", views=False)
def empty_object(spark, d):
    """An object with files, and one whose glob names none."""
    own = x.scan_object(spark, x.ObjectSpec("events", (f"{d}/events.parq*",), "event_id long"))
    none = x.scan_object(spark, x.ObjectSpec("none", (f"{d}/no-such-*.parquet",), "event_id long"))
    count = lambda df, name: df.agg(F.lit(name).alias("object"), F.count("*").alias("n"), F.max("event_id").alias("last"))
    return count(own, "events").union(count(none, "none"))


@query("SELECT o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(16,2)) AS amount, CAST(o_orderdate AS DATE) AS order_date, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 2 HOUR END AS created_at, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + CASE WHEN o_orderstatus = 'F' THEN INTERVAL 17 HOUR ELSE INTERVAL 8 HOUR END AS updated_at FROM orders", views=False)
def typed_load(spark, d):
    """Orders as text, a creation time on every third of them; the rest of the audit columns by rules."""
    n = F.col("o_orderkey")
    text = b.table(spark, d, "orders").select(n.cast("string").alias("order_id"), F.col("o_totalprice").cast("decimal(16,2)").cast("string").alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), F.col("o_orderstatus").alias("status"), F.when(n % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("created_at"))
    types = {"order_id": "bigint", "amount": "decimal(16,2)", "order_date": "date", "status": "string", "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz"}
    rules = {"created_at": at_hour("order_date", 2), "updated_at": F.when(F.col("status") == "F", at_hour("order_date", 17)).otherwise(at_hour("order_date", 8))}
    return q.typed_load(text, types, {"order_id", "created_at", "updated_at"}, rules).drop("status")


@query("SELECT order_id, CAST(order_date AS TIMESTAMP) + INTERVAL 2 HOUR AS order_created, CAST(ship_date AS TIMESTAMP) + INTERVAL 8 HOUR AS shipment_created, CASE WHEN delivered_date <= DATE '2000-12-31' THEN CAST(delivered_date AS TIMESTAMP) + INTERVAL 17 HOUR ELSE CAST(ship_date AS TIMESTAMP) + INTERVAL 8 HOUR END AS shipment_updated, CAST(order_date AS TIMESTAMP) + to_hours(CAST(coalesce(CASE WHEN order_id % 4 > 0 THEN packages END, 0) AS INTEGER)) AS case_updated FROM ord JOIN ship USING (order_id)")
def audit_defaults(spark, d):
    both = b.bare_orders(spark, d).join(b.shipments(spark, d), "order_id")
    delivered = F.when(F.col("delivered_date") <= F.lit("2000-12-31").cast("date"), at_hour("delivered_date", 17))
    hours = F.coalesce(F.when(F.col("order_id") % 4 > 0, F.col("packages")), F.lit(0)).cast("int")
    return both.select("order_id", at_hour("order_date", 2).alias("order_created"), at_hour("ship_date", 8).alias("shipment_created"), F.coalesce(delivered, at_hour("ship_date", 8)).alias("shipment_updated"), (F.col("order_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours)).alias("case_updated"))


@query("SELECT order_id, CASE WHEN delivered_date > promised_date THEN 'BREACHED' ELSE 'ON_TIME' END AS sla_status FROM ship")
def sla_status(spark, d):
    return b.shipments(spark, d).select("order_id", lc.sla_status(F.col("delivered_date"), F.col("promised_date")).alias("sla_status"))


@query("WITH t AS (SELECT order_id, CAST(ship_date - 3 AS TIMESTAMP) + INTERVAL 9 HOUR AS planned, created_at + INTERVAL 12 HOUR AS least FROM ord JOIN ship USING (order_id)) SELECT order_id, greatest(planned, t.least) AS exact, CASE WHEN CAST(planned AS DATE) < CAST(t.least AS DATE) THEN t.least ELSE planned END AS by_date FROM t")
def clamp_not_before(spark, d):
    both = b.bare_orders(spark, d).join(b.shipments(spark, d), "order_id")
    at = F.date_sub("ship_date", 3).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(9))
    floor = F.col("created_at").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(12))
    return both.select("order_id", lc.clamp_not_before(at, floor).alias("exact"), lc.clamp_not_before(at, floor, by_date=True).alias("by_date"))


# Contracts told by the data: a nation is a table and the segments of some of its customers are its columns, typed by their balances.
_CONTRACTS = """c AS (SELECT c_custkey % 3 AS p, 'nation_' || CAST(c_nationkey AS VARCHAR) AS table_name, c_mktsegment AS column_name, CASE WHEN max(c_acctbal) > 9800 THEN 'decimal' ELSE 'string' END AS data_type FROM customer WHERE c_acctbal > 7000 GROUP BY ALL),
cc AS (SELECT *, CAST(row_number() OVER (PARTITION BY p, table_name ORDER BY column_name) AS INTEGER) AS ordinal_position FROM c),
fp AS (SELECT p, table_name, sha256(string_agg('{"column_name":"' || column_name || '","data_type":"' || data_type || '","is_nullable":true,"ordinal_position":' || CAST(ordinal_position AS VARCHAR) || '}', ',' ORDER BY ordinal_position)) AS schema_fingerprint FROM cc GROUP BY p, table_name),
known AS (SELECT table_name, 1 AS version, schema_fingerprint FROM fp WHERE p = 0),
unseen AS (SELECT DISTINCT table_name, schema_fingerprint FROM fp WHERE p > 0 AND (table_name, schema_fingerprint) NOT IN (SELECT table_name, schema_fingerprint FROM known)),
added AS (SELECT table_name, CAST((CASE WHEN table_name IN (SELECT table_name FROM known) THEN 1 ELSE 0 END) + row_number() OVER w AS INTEGER) AS version, schema_fingerprint, lead(schema_fingerprint) OVER w IS NOT NULL AS retired FROM unseen WINDOW w AS (PARTITION BY table_name ORDER BY schema_fingerprint)),
vs AS (SELECT table_name, CAST(version AS INTEGER) AS version, schema_fingerprint, table_name IN (SELECT table_name FROM added) AS retired FROM known UNION ALL SELECT * FROM added)"""


def contracts(spark, d, part: int):
    own = b.table(spark, d, "customer").where((F.col("c_acctbal") > 7000) & (F.col("c_custkey") % 3 == part))
    columns = own.groupBy(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("table_name"), F.col("c_mktsegment").alias("column_name")).agg(F.when(F.max("c_acctbal") > 9800, "decimal").otherwise("string").alias("data_type"))
    at = F.row_number().over(q.Window.partitionBy("table_name").orderBy("column_name"))
    return columns.select("table_name", at.alias("ordinal_position"), "column_name", "data_type", F.lit(True).alias("is_nullable"))


def versions(spark, d):
    first, second, third = (q.schema_fingerprint(contracts(spark, d, k)) for k in range(3))
    known = first.select("table_name", F.lit(1).alias("version"), "schema_fingerprint", F.lit(False).alias("retired"))
    return q.contract_versions(known, second.union(third))


@query(f"WITH {_CONTRACTS} SELECT table_name, schema_fingerprint FROM fp WHERE p = 0")
def schema_fingerprint(spark, d):
    return q.schema_fingerprint(contracts(spark, d, 0))


@query(f"WITH {_CONTRACTS} SELECT * FROM vs")
def contract_versions(spark, d):
    return versions(spark, d)


@query(f"WITH {_CONTRACTS} SELECT DISTINCT vs.table_name, version, column_name, data_type FROM vs JOIN fp USING (table_name, schema_fingerprint) JOIN cc ON cc.table_name = vs.table_name AND cc.p = fp.p WHERE NOT retired")
def current_contract(spark, d):
    parts = [contracts(spark, d, k) for k in range(3)]
    named = [p.join(q.schema_fingerprint(p), "table_name") for p in parts]
    return q.current_contract(versions(spark, d), named[0].union(named[1]).union(named[2])).select("table_name", "version", "column_name", "data_type").distinct()


@query(f"WITH {_CONTRACTS}, o AS (SELECT * FROM cc WHERE p = 0), n AS (SELECT * FROM cc WHERE p = 1), j AS (SELECT table_name, column_name, CASE WHEN o.data_type IS NULL THEN 'added' WHEN n.data_type IS NULL THEN 'removed' WHEN o.data_type <> n.data_type THEN 'retyped' END AS change FROM o FULL JOIN n USING (table_name, column_name)) SELECT * FROM j WHERE change IS NOT NULL")
def schema_drift(spark, d):
    return q.schema_drift(contracts(spark, d, 0), contracts(spark, d, 1))


_DESCRIBED = "SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS data_type FROM (DESCRIBE orders)"
_NULLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS n_rows FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


_FACETS = "CASE column_name WHEN 'o_orderstatus' THEN 1 WHEN 'o_orderpriority' THEN 15 END AS length, CASE WHEN column_name = 'o_totalprice' THEN 16 WHEN data_type = 'bigint' THEN 19 WHEN data_type = 'int' THEN 10 END AS \"precision\", CASE WHEN column_name = 'o_totalprice' THEN 2 WHEN data_type IN ('bigint', 'int') THEN 0 END AS scale"


@query(f"SELECT 'orders' AS table_name, column_name, CASE WHEN column_name = 'o_totalprice' THEN 'decimal(16,2)' ELSE data_type END AS data_type, nulls, n_rows, {_FACETS} FROM ({_DESCRIBED}) JOIN ({_NULLS}) USING (column_name)", views=False)
def contract_columns(spark, d):
    """With the NULLs that the table really has; prices are decimals, two texts have lengths."""
    o = b.table(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(16,2)"))
    for c, n in (("o_orderstatus", 1), ("o_orderpriority", 15)):
        o = o.withMetadata(c, {"__CHAR_VARCHAR_TYPE_STRING": f"varchar({n})"})  # as tables note them
    return q.contract_columns(o, "orders").join(q.profile_columns(o), "column_name").select("table_name", "column_name", "data_type", "nulls", "n_rows", "length", "precision", "scale")


@query(f"SELECT column_name AS field, CASE WHEN column_name = 'o_orderkey' THEN 'id' WHEN data_type IN ('bigint', 'int') THEN 'int' WHEN data_type = 'timestamp_ntz' THEN 'datetime' ELSE data_type END AS type, column_name <> 'o_orderkey' AS nillable, false AS custom, n_rows FROM ({_DESCRIBED}) JOIN ({_NULLS}) USING (column_name)", views=False)
def describe_type(spark, d):
    o = b.table(spark, d, "orders")
    return q.describe_type(o, "o_orderkey").crossJoin(F.broadcast(o.agg(F.count("*").alias("n_rows"))))  # one row


@query("WITH n AS (SELECT 'orders' AS table_name, count(*) AS n, CASE WHEN count(DISTINCT o_orderdate) > 1 THEN 'o_orderdate' END AS d FROM orders UNION ALL SELECT 'lineitem', count(*), CASE WHEN count(DISTINCT l_shipdate) > 1 THEN 'l_shipdate' END FROM lineitem UNION ALL SELECT 'customer', count(*), NULL FROM customer) SELECT table_name, CASE WHEN n > 20000 THEN d END AS partition_column, CAST(greatest(1, ceil(n / 20000.0)) AS BIGINT) AS partitions FROM n", views=False)
def partition_advice(spark, d):
    rows = []
    for t in ("orders", "lineitem", "customer"):
        column, parts = q.partition_advice(q.profile_columns(b.table(spark, d, t)), 20_000)  # a row for each column
        rows.append((t, column, parts))
    return spark.createDataFrame(rows, "table_name string, partition_column string, partitions long")


@query("""WITH e AS (SELECT 'order' AS entity_type, o_orderkey AS entity_id FROM orders UNION ALL SELECT 'shipment', l_orderkey FROM lineitem GROUP BY l_orderkey),
h AS (SELECT 'order' AS entity_type, o_orderkey AS entity_id, CASE WHEN o_orderkey % 3 = 0 THEN 'inferred_baseline' END AS origin, o_orderdate AS occurred_at, o_orderdate + to_days(CAST(o_orderkey % 5 - 1 AS INTEGER)) AS recorded_at FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT 'shipment', l_orderkey, 'inferred_baseline', l_shipdate, l_shipdate FROM lineitem WHERE l_orderkey % 2 = 0),
g AS (SELECT entity_type, entity_id, bool_or(origin IS NOT DISTINCT FROM 'inferred_baseline') AS i, bool_or(origin IS DISTINCT FROM 'inferred_baseline') AS r, min(occurred_at) > max(recorded_at) AS bad FROM h GROUP BY ALL)
SELECT entity_type, count(*) AS eligible, count(*) FILTER (i) AS inferred, count(*) FILTER (r) AS recorded, count(*) FILTER (bad) AS invalid FROM e LEFT JOIN g USING (entity_type, entity_id) GROUP BY entity_type""", views=False)
def history_coverage(spark, d):
    o, li = b.table(spark, d, "orders"), b.table(spark, d, "lineitem")
    n = F.col("o_orderkey")
    entities = o.select(F.lit("order").alias("entity_type"), n.alias("entity_id")).union(li.select(F.lit("shipment"), "l_orderkey"))
    told = o.where(n % 4 > 0).select(F.lit("order").alias("entity_type"), n.alias("entity_id"), F.when(n % 3 == 0, "inferred_baseline").alias("origin"), F.col("o_orderdate").alias("occurred_at"), (F.col("o_orderdate") + F.make_dt_interval((n % 5 - 1).cast("int"))).alias("recorded_at"))
    return q.history_coverage(entities, told.union(li.where("l_orderkey % 2 = 0").select(F.lit("shipment"), "l_orderkey", F.lit("inferred_baseline"), "l_shipdate", "l_shipdate")))


_RUNS = "r AS (SELECT CAST(ts AS DATE) AS business_date, CASE WHEN count(*) FILTER (event_type = 'error') * 10 < count(*) THEN 'COMPLETED' WHEN max(event_id) % 2 = 0 THEN 'FAILED' ELSE 'RUNNING' END AS state FROM events GROUP BY 1)"


@query(f"WITH {_RUNS} SELECT state, count(*) AS runs, (SELECT min(business_date) FROM r WHERE state <> 'COMPLETED') AS first_incomplete FROM r GROUP BY state")
def run_state_counts(spark, d):
    """A day's run is complete when less than a tenth of its events are errors."""
    days = b.table(spark, d, "events").groupBy(F.to_date("ts").alias("business_date")).agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count("*").alias("n"), F.max("event_id").alias("last"))
    state = F.when(F.col("bad") * 10 < F.col("n"), "COMPLETED").when(F.col("last") % 2 == 0, "FAILED").otherwise("RUNNING")
    return q.run_state_counts(days.select("business_date", state.alias("state")))


@query("SELECT event_type AS target, event_id AS scanned, user_id AS updated, event_id % 2 = 0 AS done FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", views=False)
def backfill_status(spark, d):
    e = b.table(spark, d, "events")
    return q.backfill_status(e.select(F.col("event_type").alias("target"), F.col("ts").alias("at"), F.col("event_id").alias("scanned"), F.col("user_id").alias("updated"), (F.col("event_id") % 2 == 0).alias("done")))


@query("SELECT file, n AS records, s - n AS start_record, s AS end_record FROM (SELECT file, n, CAST(sum(n) OVER (ORDER BY file) AS BIGINT) AS s FROM (SELECT strftime(o_orderdate, '%Y-%m') AS file, count(*) AS n FROM orders GROUP BY 1))", views=False)
def running_record_offsets(spark, d):
    months = b.table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("file")).agg(F.count("*").alias("records"))
    return x.record_offsets(months, "file")


@query("SELECT DISTINCT event_id, event_type FROM events WHERE event_id % 7 > 0", views=False)
def idempotent_apply(spark, d):
    e = b.table(spark, d, "events").select("event_id", "event_type")
    return ev.idempotent_apply(e.union(e.where("event_id % 5 = 0")), e.where("event_id % 7 = 0"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'applied' ELSE event_type END AS event_type FROM events", views=False)
def event_ledger_append(spark, d):
    e = b.table(spark, d, "events").select("event_id", "event_type")
    return ev.event_ledger_append(e.where("event_id % 7 = 0").withColumn("event_type", F.lit("applied")), e.union(e.where("event_id % 5 = 0")))


@query(f"WITH {_FACTS}, o AS (SELECT order_id, kind, row_number() OVER (PARTITION BY order_id ORDER BY CAST(happened AS DATE), CASE kind WHEN 'order' THEN 0 WHEN 'shipment' THEN 1 WHEN 'delivery' THEN 2 ELSE 3 END) AS step FROM facts) SELECT order_id, kind, step FROM o")
def event_ordering(spark, d):
    own = q.Window.partitionBy("order_id").orderBy(F.to_date("at"), ev.event_order(F.col("kind")))
    return facts(spark, d).select("order_id", "kind", F.row_number().over(own).cast("long").alias("step"))
