"""Domain views over the order, customer and event tables: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Region -> booking entity and functional currency; first day, last day, and base and step of each rate.
ENTITIES = (("AMERICA", "US01", "USD"), ("EUROPE", "DE01", "EUR"), ("ASIA", "JP01", "JPY"), ("AFRICA", "GB01", "GBP"), ("MIDDLE EAST", "CA01", "CAD"))
FX_FIRST, FX_LAST = "1995-01-01", "2001-12-31"
FX = (("EUR", "1.085", "0.0004"), ("GBP", "1.268", "0.0005"), ("CAD", "0.734", "0.0003"), ("JPY", "0.00642", "0.000002"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ENTITIES), "region string, company_code string, company_currency string")


def customers(spark: SparkSession, d: str) -> DataFrame:
    key, text = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    spelled = F.when(key % 5 == 0, F.concat(F.lit("ACC-"), text)).when(key % 5 == 1, F.concat(F.lit("ACC "), text)).when(key % 5 == 2, F.concat(F.lit("acc-"), text)).when(key % 5 == 3, F.concat(F.lit("ACC-"), key.cast("string"))).otherwise(F.concat(F.lit(" ACC-"), text, F.lit(" ")))
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(F.broadcast(entities(spark)), F.col("r_name") == F.col("region")).select(key.alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"), "region", "company_code", "company_currency", spelled.alias("account_text"))


def bare_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as their own table has them: no join."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("created_at"), F.to_date("o_orderdate").alias("order_date"), _status().alias("status"), F.col("o_orderpriority").alias("channel"))


def _status() -> Column:
    return F.when(F.col("o_orderkey") % 29 == 0, "CANCELLED").when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "F", "SHIPPED").otherwise("INVOICED")


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customers' region, entity, currency and segment."""
    o = table(spark, d, "orders").join(customers(spark, d), F.col("o_custkey") == F.col("customer_id"))
    status = _status()
    currency = F.when(F.col("o_orderkey") % 6 == 0, "USD").otherwise(F.col("company_currency"))
    return o.select(F.col("o_orderkey").alias("order_id"), "customer_id", F.col("o_orderdate").alias("created_at"), F.to_date("o_orderdate").alias("order_date"), status.alias("status"), currency.alias("currency_code"), "region", "segment", "company_code", "company_currency", F.col("o_orderpriority").alias("channel"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    qty, price, disc = F.col("l_quantity").cast("int"), F.col("p_retailprice").cast("decimal(16,2)"), F.col("l_discount").cast("decimal(5,2)")
    amount = F.round(qty * price * (F.lit(1).cast("decimal(5,2)") - disc), 2).cast("decimal(18,2)")
    parts = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_brand")
    return table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("line_number"), F.col("l_suppkey").alias("rep_id"), qty.alias("quantity"), price.alias("unit_price"), disc.alias("discount"), amount.alias("line_amount"), F.col("p_brand").alias("brand"), F.to_date("l_shipdate").alias("ship_date"))


def shipments(spark: SparkSession, d: str) -> DataFrame:
    """One shipment per order that has lines: first and last line's ship date."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.min(F.to_date("l_shipdate")).alias("ship_date"), F.max(F.to_date("l_shipdate")).alias("delivered_date"), F.count("*").alias("packages"))
    return s.withColumn("promised_date", F.date_add("ship_date", (F.lit(5) + F.col("order_id") % 40).cast("int")))


def fx_rates(spark: SparkSession) -> DataFrame:
    """Weekday spot rates to USD."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(FX_FIRST).cast("date"), F.lit(FX_LAST).cast("date"))).alias("rate_date")).where(F.weekday("rate_date") < 5)
    n = F.pmod(F.datediff("rate_date", F.lit(FX_FIRST).cast("date")), F.lit(97))
    pairs = spark.createDataFrame(list(FX), "currency string, base string, step string")
    return days.crossJoin(F.broadcast(pairs)).select("currency", "rate_date", (F.col("base").cast("decimal(18,8)") + n * F.col("step").cast("decimal(18,8)")).cast("decimal(18,8)").alias("rate"))


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Record versions: a user's record changes with each of their events; an error deletes it."""
    return table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("version"), F.col("event_id"), F.col("event_type").alias("stage"), "value", (F.col("event_type") == "error").alias("is_deleted"))


# The same views for DuckDB.
SQL_VIEWS = f"""
ent(region, company_code, company_currency) AS (VALUES {", ".join(map(str, ENTITIES))}),
customers AS (SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, region, company_code, company_currency,
  CASE c_custkey % 5 WHEN 0 THEN 'ACC-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN 1 THEN 'ACC ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN 2 THEN 'acc-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')
  WHEN 3 THEN 'ACC-' || CAST(c_custkey AS VARCHAR) ELSE ' ACC-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' ' END AS account_text
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN ent ON r_name = ent.region),
ord AS (SELECT o_orderkey AS order_id, customer_id, o_orderdate AS created_at, CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN o_orderkey % 29 = 0 THEN 'CANCELLED' WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderstatus = 'F' THEN 'SHIPPED' ELSE 'INVOICED' END AS status,
  CASE WHEN o_orderkey % 6 = 0 THEN 'USD' ELSE company_currency END AS currency_code, region, segment, company_code, company_currency, o_orderpriority AS channel
  FROM orders JOIN customers ON o_custkey = customer_id),
line AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_number, l_suppkey AS rep_id, CAST(l_quantity AS INTEGER) AS quantity, CAST(p_retailprice AS DECIMAL(16,2)) AS unit_price, CAST(l_discount AS DECIMAL(5,2)) AS discount,
  CAST(round(CAST(l_quantity AS INTEGER) * CAST(p_retailprice AS DECIMAL(16,2)) * (CAST(1 AS DECIMAL(5,2)) - CAST(l_discount AS DECIMAL(5,2))), 2) AS DECIMAL(18,2)) AS line_amount, p_brand AS brand, CAST(l_shipdate AS DATE) AS ship_date
  FROM lineitem JOIN part ON l_partkey = p_partkey),
ship AS (SELECT l_orderkey AS order_id, min(CAST(l_shipdate AS DATE)) AS ship_date, max(CAST(l_shipdate AS DATE)) AS delivered_date, count(*) AS packages, CAST(min(CAST(l_shipdate AS DATE)) + CAST(5 + l_orderkey % 40 AS INTEGER) AS DATE) AS promised_date FROM lineitem GROUP BY l_orderkey),
fxp(currency, base, step) AS (VALUES {", ".join(f"('{c}', CAST('{b}' AS DECIMAL(18,8)), CAST('{s}' AS DECIMAL(18,8)))" for c, b, s in FX)}),
days AS (SELECT CAST(x AS DATE) AS rate_date FROM (SELECT unnest(generate_series(TIMESTAMP '{FX_FIRST}', TIMESTAMP '{FX_LAST}', INTERVAL 1 DAY)) AS x)),
fx AS (SELECT currency, rate_date, CAST(base + (datediff('day', DATE '{FX_FIRST}', rate_date) % 97) * step AS DECIMAL(18,8)) AS rate FROM days, fxp WHERE isodow(rate_date) < 6),
ver AS (SELECT user_id AS id, ts AS version, event_id, event_type AS stage, value, event_type = 'error' AS is_deleted FROM events)
"""
