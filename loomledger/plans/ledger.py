"""Queries of joins, money, ledger, lifecycle, quality and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money
from ..operators import asof
from ..operators import events as ev
from ..operators import lifecycle as lc
from ..operators import quality as q
from ..operators import sketches
from ..sources import bindings as b
from ..sources.staging import numbered
from .registry import query

_DAILY = """WITH cal AS (SELECT rate_date, currency FROM days, fxp), j AS (SELECT cal.currency, cal.rate_date, rate FROM cal LEFT JOIN fx ON cal.currency = fx.currency AND cal.rate_date = fx.rate_date),
daily AS (SELECT currency, rate_date, coalesce(last_value(rate IGNORE NULLS) OVER (PARTITION BY currency ORDER BY rate_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(rate IGNORE NULLS) OVER (PARTITION BY currency ORDER BY rate_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM j UNION ALL SELECT 'USD', rate_date, CAST(1 AS DECIMAL(18,8)) FROM days)"""


def daily(spark):
    return money.fx_daily(b.fx_rates(spark), b.FX_FIRST, b.FX_LAST)


def totals(spark, d):
    o = b.orders(spark, d)
    return o.join(b.lines(spark, d).groupBy("order_id").agg(F.sum("line_amount").cast("decimal(18,2)").alias("amount")), "order_id", "left").withColumn("amount", F.coalesce("amount", F.lit(0).cast("decimal(18,2)")))


_TOTALS = "tot AS (SELECT ord.*, coalesce(a.amount, 0) AS amount FROM ord LEFT JOIN (SELECT order_id, CAST(sum(line_amount) AS DECIMAL(18,2)) AS amount FROM line GROUP BY order_id) a USING (order_id))"


def money_sum(c: str, name: str):
    return F.sum(c).cast("decimal(18,2)").alias(name)


@query(f"WITH {_TOTALS} SELECT order_id, CAST(amount AS DECIMAL(18,2)) AS amount FROM tot")
def order_totals(spark, d):
    return totals(spark, d).select("order_id", "amount")


@query("SELECT order_id, product_id, line_number, line_amount FROM line")
def line_amount(spark, d):
    return b.lines(spark, d).select("order_id", "product_id", "line_number", "line_amount")


@query("SELECT strftime(order_date, '%Y-%m') AS period, region, currency_code, CAST(sum(line_amount) AS DECIMAL(18,2)) AS bookings FROM ord JOIN line USING (order_id) WHERE status <> 'CANCELLED' GROUP BY ALL")
def m_bookings(spark, d):
    both = b.orders(spark, d).where("status <> 'CANCELLED'").join(b.lines(spark, d), "order_id")
    return both.groupBy(F.date_format("order_date", "yyyy-MM").alias("period"), "region", "currency_code").agg(money_sum("line_amount", "bookings"))


# Spot rates as the given tables have them: of the days on which a region sold something to a customer whose number 7 divides, told by the day's orders; none before the first.
_SPOT = "spot AS (SELECT company_currency AS currency, order_date AS rate_date, CAST(1 + (max(order_id) % 9973) / CAST(10000 AS DECIMAL(18,8)) AS DECIMAL(18,8)) AS rate FROM ord WHERE customer_id % 7 = 0 AND order_id % 5 > 0 AND order_date >= DATE '1992-02-01' GROUP BY ALL)"
_SPOTTED = f"{_SPOT}, told AS (SELECT o.order_id, currency_code, order_date, CASE WHEN currency_code = 'USD' THEN 1 ELSE r.rate END AS rate FROM ord o ASOF LEFT JOIN spot r ON r.currency = o.currency_code AND o.order_date >= r.rate_date)"


def spot(spark, d):
    o = b.orders(spark, d).where("customer_id % 7 = 0 and order_id % 5 > 0 and order_date >= date '1992-02-01'")
    rate = (F.lit(1) + (F.max("order_id") % 9973) / F.lit(10000).cast("decimal(18,8)")).cast("decimal(18,8)")
    return o.groupBy(F.col("company_currency").alias("currency_code"), F.col("order_date").alias("rate_date")).agg(rate.alias("rate"))


def spotted(spark, d):
    o = b.orders(spark, d).select("order_id", "currency_code", "order_date")
    one = F.col("currency_code") == "USD"
    told = asof.asof_join(o, spot(spark, d), "currency_code", "order_date", "rate_date", "rate")
    return told.withColumns({"rate": F.when(one, F.lit(1).cast("decimal(18,8)")).otherwise(F.col("rate")), "found": one | F.col("found")})


_SPOT_DAILY = """cal AS (SELECT currency, rate_date FROM days, (SELECT DISTINCT currency FROM spot WHERE currency <> 'USD')), told AS (SELECT currency, rate_date, rate FROM cal LEFT JOIN spot USING (currency, rate_date))"""


@query(f"WITH {_SPOT}, {_SPOT_DAILY} SELECT currency, rate_date, coalesce(last_value(rate IGNORE NULLS) OVER (PARTITION BY currency ORDER BY rate_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(rate IGNORE NULLS) OVER (PARTITION BY currency ORDER BY rate_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM told UNION ALL SELECT 'USD', rate_date, CAST(1 AS DECIMAL(18,8)) FROM days")
def fx_daily(spark, d):
    rates = spot(spark, d).where(f"rate_date between date '{b.FX_FIRST}' and date '{b.FX_LAST}'")
    return money.fx_daily(rates.withColumnRenamed("currency_code", "currency"), b.FX_FIRST, b.FX_LAST)


@query(f"WITH {_SPOTTED} SELECT order_id, currency_code, CAST(rate AS DECIMAL(18,8)) AS rate FROM told")
def asof_fx(spark, d):
    return spotted(spark, d).select("order_id", "currency_code", "rate")


@query(f"WITH {_SPOTTED} SELECT order_id, currency_code, order_date FROM told WHERE rate IS NULL")
def asof_fx_missing(spark, d):
    """Orders without a rate on or before their day."""
    return asof.missing(spotted(spark, d), "order_id", "currency_code", "order_date")


@query("SELECT order_id, product_id, line_number, CAST(CASE WHEN currency_code = 'JPY' THEN round(line_amount, 0) ELSE round(line_amount, 2) END AS DECIMAL(18,2)) AS amount FROM ord JOIN line USING (order_id)")
def round_minor_unit(spark, d):
    both = b.orders(spark, d).join(b.lines(spark, d), "order_id")
    return both.select("order_id", "product_id", "line_number", money.round_minor_unit(F.col("line_amount"), F.col("currency_code")).alias("amount"))


# In whole numbers: cents times 1e8, divided by a rate times 1e8, half up to the minor unit.
_UNITS = "CAST(amount * 100 AS HUGEINT) * CAST(f.rate * 100000000 AS HUGEINT)"
_CONVERTED = f"""{_DAILY}, {_TOTALS}, conv AS (SELECT tot.*, CASE WHEN currency_code = company_currency THEN amount
WHEN company_currency = 'JPY' THEN CAST((2 * {_UNITS} + 100 * CAST(t.rate * 100000000 AS HUGEINT)) // (200 * CAST(t.rate * 100000000 AS HUGEINT)) AS DECIMAL(18,2))
ELSE CAST(CAST((2 * {_UNITS} + CAST(t.rate * 100000000 AS HUGEINT)) // (2 * CAST(t.rate * 100000000 AS HUGEINT)) AS DECIMAL(20,2)) / 100 AS DECIMAL(18,2)) END AS amount_company
FROM tot LEFT JOIN daily f ON f.currency = currency_code AND f.rate_date = order_date LEFT JOIN daily t ON t.currency = company_currency AND t.rate_date = order_date)"""


@query(f"{_CONVERTED} SELECT order_id, CAST(amount_company AS DECIMAL(18,2)) AS amount_company FROM conv")
def convert_currency(spark, d):
    out = money.convert_currency(totals(spark, d), daily(spark), "amount", "currency_code", "company_currency", "order_date", "amount_company")
    return out.select("order_id", F.col("amount_company").cast("decimal(18,2)").alias("amount_company"))


def centers(spark):
    rows = [(c, f"{c}-{n}", f, t) for _, c, _ in b.ENTITIES for n, f, t in (("050", "1996-01-01", "1997-01-01"), ("100", "1990-01-01", "1995-07-01"), ("200", "1995-01-01", None))]
    return spark.createDataFrame(rows, "company_code string, cost_center_code string, f string, t string").select("company_code", "cost_center_code", F.col("f").cast("date").alias("valid_from"), F.col("t").cast("date").alias("valid_to"), (~F.col("cost_center_code").endswith("050")).alias("is_active"))


_CENTERS = "cc AS (SELECT company_code, company_code || '-' || n AS cost_center_code, f AS valid_from, t AS valid_to, n <> '050' AS is_active FROM ent, (VALUES ('050', DATE '1996-01-01', DATE '1997-01-01'), ('100', DATE '1990-01-01', DATE '1995-07-01'), ('200', DATE '1995-01-01', NULL)) v(n, f, t))"


@query(f"WITH {_CENTERS} SELECT order_id, min(cost_center_code) AS cost_center_code FROM ord LEFT JOIN cc ON ord.company_code = cc.company_code AND order_date >= valid_from AND (valid_to IS NULL OR order_date < valid_to) GROUP BY order_id")
def valid_range_join(spark, d):
    return ev.valid_range_join(b.orders(spark, d).select("order_id", "company_code", "order_date"), centers(spark), "company_code", "order_date", "cost_center_code").select("order_id", "cost_center_code")


def postings(spark, d):
    inv = totals(spark, d).where("status = 'INVOICED' and amount > 0").select("order_id", F.col("order_date").alias("invoice_date"), "company_code", "currency_code", "company_currency", "amount")
    return ev.post_revenue(inv, daily(spark), centers(spark))


_POSTED = f"{_CONVERTED}, {_CENTERS}, posted AS (SELECT order_id AS posting_id, 'INV-' || lpad(CAST(order_id AS VARCHAR), 12, '0') AS document_number, 'INV' AS document_type, conv.company_code, (SELECT min(cost_center_code) FROM cc WHERE is_active AND cc.company_code = conv.company_code AND order_date >= valid_from AND (valid_to IS NULL OR order_date < valid_to)) AS cost_center_code, order_date AS posting_date, strftime(order_date, '%Y-%m') AS fiscal_period, currency_code, CAST(amount AS DECIMAL(18,2)) AS amount_doc, company_currency, CAST(amount_company AS DECIMAL(18,2)) AS amount_company FROM conv WHERE status = 'INVOICED' AND amount > 0)"


@query(f"{_POSTED} SELECT * FROM posted")
def post_revenue(spark, d):
    return postings(spark, d)


_REVERSED = f"""{_POSTED}, crn AS (SELECT posting_id + 1000000000 AS posting_id, regexp_replace(document_number, '^INV', 'CRN') AS document_number, 'CRN' AS document_type, company_code, cost_center_code, CAST(posting_date + 20 AS DATE) AS posting_date,
strftime(CAST(posting_date + 20 AS DATE), '%Y-%m') AS fiscal_period, currency_code, CAST(-amount_doc AS DECIMAL(18,2)) AS amount_doc, company_currency, CAST(-amount_company AS DECIMAL(18,2)) AS amount_company, posting_id AS reverses_posting_id FROM posted WHERE posting_id % 17 = 0)"""


@query(f"{_REVERSED} SELECT * FROM crn")
def reverse_postings(spark, d):
    return ev.reverse_postings(postings(spark, d), F.col("posting_id") % 17 == 0, 20, 1_000_000_000)


def ledger(spark, d):
    p = postings(spark, d)
    return p.withColumn("reverses_posting_id", F.lit(None).cast("long")).unionByName(ev.reverse_postings(p, F.col("posting_id") % 17 == 0, 20, 1_000_000_000))


@query(f"{_REVERSED} SELECT *, NULL AS reverses_posting_id FROM posted UNION ALL SELECT * FROM crn")
def ledger_union(spark, d):
    return ledger(spark, d)


@query(f"{_REVERSED} SELECT crn.posting_id AS credit_note, posted.document_number AS reverses, posted.amount_doc + crn.amount_doc AS net FROM crn LEFT JOIN posted ON posted.posting_id = crn.reverses_posting_id")
def credit_note_pairing(spark, d):
    led = ledger(spark, d)
    inv = led.where("document_type = 'INV'").select(F.col("posting_id").alias("reverses_posting_id"), F.col("document_number").alias("reverses"), F.col("amount_doc").alias("inv_amount"))
    return led.where("document_type = 'CRN'").join(inv, "reverses_posting_id", "left").select(F.col("posting_id").alias("credit_note"), "reverses", (F.col("inv_amount") + F.col("amount_doc")).alias("net"))


@query(f"{_REVERSED}, l AS (SELECT posting_date, currency_code, amount_doc FROM posted UNION ALL SELECT posting_date, currency_code, amount_doc FROM crn) SELECT posting_date, currency_code, CAST(sum(amount_doc) AS DECIMAL(18,2)) AS billed FROM l GROUP BY ALL")
def m_billed_revenue(spark, d):
    return ledger(spark, d).groupBy("posting_date", "currency_code").agg(money_sum("amount_doc", "billed"))


@query(f"""{_REVERSED}, bk AS (SELECT strftime(order_date, '%Y-%m') AS period, currency_code, sum(amount) AS bookings FROM tot WHERE status <> 'CANCELLED' GROUP BY ALL),
bl AS (SELECT fiscal_period AS period, currency_code, sum(amount_doc) AS billed FROM (SELECT fiscal_period, currency_code, amount_doc FROM posted UNION ALL SELECT fiscal_period, currency_code, amount_doc FROM crn) GROUP BY ALL)
SELECT period, currency_code, CAST(coalesce(bookings, 0) - coalesce(billed, 0) AS DECIMAL(18,2)) AS gap FROM bk FULL JOIN bl USING (period, currency_code)""")
def m_bookings_vs_billed(spark, d):
    """Billed is net: credit notes count in the period that they are posted in."""
    bk = totals(spark, d).where("status <> 'CANCELLED'").groupBy(F.date_format("order_date", "yyyy-MM").alias("period"), "currency_code").agg(F.sum("amount").alias("bookings"))
    bl = ledger(spark, d).groupBy(F.col("fiscal_period").alias("period"), "currency_code").agg(F.sum("amount_doc").alias("billed"))
    gap = F.coalesce("bookings", F.lit(0)) - F.coalesce("billed", F.lit(0))
    return bk.join(bl, ["period", "currency_code"], "full").select("period", "currency_code", gap.cast("decimal(18,2)").alias("gap"))


@query("SELECT o.order_id, status, ship_date, delivered_date FROM ord o LEFT JOIN ship USING (order_id)")
def order_evidence(spark, d):
    return b.bare_orders(spark, d).join(b.shipments(spark, d), "order_id", "left").select("order_id", "status", "ship_date", "delivered_date")


@query("SELECT order_id FROM ord WHERE NOT EXISTS (SELECT 1 FROM ship WHERE ship.order_id = ord.order_id)")
def uncovered_entities(spark, d):
    return b.bare_orders(spark, d).select("order_id").join(b.shipments(spark, d), "order_id", "left_anti")


@query("SELECT order_id FROM ord WHERE order_id IN (SELECT order_id FROM ship)")
def already_done(spark, d):
    return b.bare_orders(spark, d).select("order_id").join(b.shipments(spark, d), "order_id", "left_semi")


@query(f"WITH {_TOTALS} SELECT order_id, customer_name, CAST(amount AS DECIMAL(18,2)) AS amount FROM tot JOIN customers USING (customer_id) WHERE status = 'INVOICED'")
def invoice_handoff(spark, d):
    return totals(spark, d).where("status = 'INVOICED'").join(b.customers(spark, d).select("customer_id", "customer_name"), "customer_id").select("order_id", "customer_name", "amount")


@query("SELECT line.order_id, product_id, line_number, created_at FROM line LEFT JOIN ord USING (order_id)")
def update_from(spark, d):
    return b.lines(spark, d).join(b.orders(spark, d).select("order_id", "created_at"), "order_id", "left").select("order_id", "product_id", "line_number", "created_at")


@query("""SELECT 'lines.order' AS relation, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'lines.part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""", views=False)
def orphan_refs(spark, d):
    t = lambda n: b.table(spark, d, n)
    return q.orphan_refs(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "lines.order").union(q.orphan_refs(t("lineitem"), "l_partkey", t("part"), "p_partkey", "lines.part")).union(q.orphan_refs(t("orders"), "o_custkey", t("customer"), "c_custkey", "orders.customer"))


@query("""SELECT region, segment, brand, CAST(sum(line_amount) AS DECIMAL(18,2)) AS revenue, CAST(grouping_id(region, segment, brand) AS BIGINT) AS level FROM ord JOIN line USING (order_id) GROUP BY ROLLUP (region, segment, brand)""")
def revenue_rollup(spark, d):
    return b.orders(spark, d).join(b.lines(spark, d), "order_id").rollup("region", "segment", "brand").agg(money_sum("line_amount", "revenue"), F.grouping_id().alias("level"))


@query("SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey, l_partkey", views=False)
def grain_dedup(spark, d):
    li = b.table(spark, d, "lineitem")
    return q.grain_dedup(li, ["l_orderkey", "l_partkey"], ["l_linenumber", "l_suppkey", "l_quantity", "l_shipdate"]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE status IN ('PENDING', 'SHIPPED')) AS open_rows FROM ord")
def population_counts(spark, d):
    return b.orders(spark, d).agg(F.count("*").alias("n_rows"), F.count_if(F.col("status").isin("PENDING", "SHIPPED")).alias("open_rows"))


@query("SELECT 'o_orderkey' AS column_name, count(*) - count(o_orderkey) AS nulls, count(DISTINCT o_orderkey) AS distinct_values, count(*) AS n_rows FROM orders UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), count(*) FROM orders", views=False)
def profile_columns(spark, d):
    return q.profile_columns(b.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), exact=True)


# Profiles kept by order year and merged; distinct counts within 3 %.
@query("SELECT 'o_orderkey' AS column_name, count(*) - count(o_orderkey) AS nulls, count(*) AS n_rows, true AS near FROM orders UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey), count(*), true FROM orders UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority), count(*), true FROM orders", views=False)
def profile_merged(spark, d):
    o = b.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", "o_custkey", "o_orderpriority")
    told = sketches.merged_profile(sketches.profiles(o, "year"))
    exact = q.profile_columns(o.drop("year"), exact=True).select("column_name", F.col("distinct_values").alias("exact"))
    return told.join(exact, "column_name").select("column_name", "nulls", "n_rows", (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near"))


@query("""SELECT 'lineitem' AS table_name, 'quantity_positive' AS rule, count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, true)) AS violations FROM lineitem UNION ALL SELECT 'lineitem', 'discount_range', count(*) FILTER (WHERE NOT coalesce(l_discount BETWEEN 0 AND 1, true)) FROM lineitem
UNION ALL SELECT 'lineitem', 'price_floor', count(*) FILTER (WHERE NOT coalesce(l_extendedprice >= 2000, true)) FROM lineitem""", views=False)
def check_constraints(spark, d):
    return q.check_constraints(b.table(spark, d, "lineitem"), "lineitem", {"quantity_positive": F.col("l_quantity") > 0, "discount_range": F.col("l_discount").between(0, 1), "price_floor": F.col("l_extendedprice") >= 2000})


@query("SELECT 'orders' AS check_name, count(*) AS violations FROM ord JOIN ship USING (order_id) WHERE ship_date < order_date")
def audit_order_check(spark, d):
    both = b.orders(spark, d).join(b.shipments(spark, d), "order_id")
    return both.where("ship_date < order_date").agg(F.count("*").alias("violations")).select(F.lit("orders").alias("check_name"), "violations")


def history_input(spark, d):
    o = b.orders(spark, d).join(b.shipments(spark, d).select("order_id", "ship_date", "delivered_date"), "order_id", "left")
    return o.select("order_id", "status", "created_at", F.col("delivered_date").cast("timestamp_ntz").alias("updated_at"), F.date_add("order_date", 5).alias("requested_date"), "ship_date", F.lit(None).cast("timestamp_ntz").alias("invoiced_at"))


_HISTORY = """WITH h0 AS (SELECT order_id, status, created_at, CAST(delivered_date AS TIMESTAMP) AS updated_at, CAST(order_date + 5 AS DATE) AS requested_date, ship_date, CASE WHEN ship_date >= CAST(created_at AS DATE) THEN CAST(ship_date AS TIMESTAMP) ELSE created_at END AS shipped_at FROM ord LEFT JOIN ship USING (order_id)),
hist AS (SELECT order_id AS entity_id, CAST(NULL AS VARCHAR) AS previous_status, 'PENDING' AS new_status, created_at AS occurred_at, CAST(requested_date AS TIMESTAMP) AS due FROM h0
UNION ALL SELECT order_id, 'PENDING', 'SHIPPED', shipped_at, NULL FROM h0 WHERE status IN ('SHIPPED', 'INVOICED') OR (status = 'CANCELLED' AND ship_date IS NOT NULL)
UNION ALL SELECT order_id, 'SHIPPED', 'INVOICED', greatest(updated_at, shipped_at, created_at), CAST(CAST(shipped_at AS DATE) + 3 AS TIMESTAMP) FROM h0 WHERE status = 'INVOICED' AND updated_at IS NOT NULL
UNION ALL SELECT order_id, CASE WHEN ship_date IS NOT NULL THEN 'SHIPPED' ELSE 'PENDING' END, 'CANCELLED', CASE WHEN ship_date IS NOT NULL THEN greatest(updated_at, shipped_at, created_at) ELSE greatest(updated_at, created_at) END, NULL FROM h0 WHERE status = 'CANCELLED' AND updated_at IS NOT NULL)"""


@query(f"{_HISTORY} SELECT entity_id, previous_status, new_status, occurred_at, CASE WHEN CAST(occurred_at AS DATE) > CAST(due AS DATE) THEN 'BREACHED' ELSE 'ON_TIME' END AS sla_status FROM hist")
def infer_order_history(spark, d):
    return lc.infer_order_history(history_input(spark, d)).where("new_status is not null").select("entity_id", "previous_status", "new_status", "occurred_at", "sla_status")


@query("SELECT order_id AS entity_id, NULL AS previous_status, 'SHIPPED' AS new_status, CAST(ship_date AS TIMESTAMP) AS occurred_at, CASE WHEN ship_date > promised_date THEN 'BREACHED' ELSE 'ON_TIME' END AS sla_status FROM ship UNION ALL SELECT order_id, 'SHIPPED', 'DELIVERED', CAST(delivered_date AS TIMESTAMP), CASE WHEN delivered_date > promised_date THEN 'BREACHED' ELSE 'ON_TIME' END FROM ship WHERE delivered_date >= ship_date")
def infer_shipment_history(spark, d):
    return lc.infer_shipment_history(b.shipments(spark, d)).select("entity_id", "previous_status", "new_status", "occurred_at", "sla_status")


@query(f"{_HISTORY} SELECT (SELECT count(*) FROM ord) AS scanned, count(DISTINCT entity_id) AS eligible, count(*) AS inferred, (SELECT count(*) FROM h0 WHERE status IN ('INVOICED', 'CANCELLED') AND updated_at IS NULL) AS skipped_invalid FROM hist")
def infer_report(spark, d):
    return lc.infer_report(lc.infer_order_history(history_input(spark, d)))


@query(f"{_HISTORY}, odd AS (SELECT CASE WHEN entity_id % 70 = 0 AND previous_status IS NOT NULL THEN new_status ELSE previous_status END AS previous_status, CASE WHEN entity_id % 90 = 0 AND new_status = 'SHIPPED' THEN 'INVOICED' ELSE new_status END AS new_status FROM hist) SELECT previous_status, new_status, count(*) AS n FROM odd WHERE (previous_status || '>' || new_status) NOT IN ('PENDING>SHIPPED', 'SHIPPED>INVOICED', 'PENDING>CANCELLED', 'SHIPPED>CANCELLED') AND previous_status IS NOT NULL GROUP BY ALL")
def transition_check(spark, d):
    """Some transitions are made wrong first."""
    h, n = lc.infer_order_history(history_input(spark, d)), F.col("entity_id")
    odd = h.select(F.when((n % 70 == 0) & F.col("previous_status").isNotNull(), F.col("new_status")).otherwise(F.col("previous_status")).alias("previous_status"), F.when((n % 90 == 0) & (F.col("new_status") == "SHIPPED"), "INVOICED").otherwise(F.col("new_status")).alias("new_status"))
    return lc.transition_check(odd, "order")


@query(f"{_HISTORY} SELECT new_status, sla_status, count(*) AS n FROM (SELECT new_status, CASE WHEN CAST(occurred_at AS DATE) > CAST(due AS DATE) THEN 'BREACHED' ELSE 'ON_TIME' END AS sla_status FROM hist) GROUP BY ALL")
def m_sla_breach(spark, d):
    return lc.infer_order_history(history_input(spark, d)).where("new_status is not null").groupBy("new_status", "sla_status").agg(F.count("*").alias("n"))


@query(f"{_HISTORY} SELECT entity_id, status FROM (SELECT entity_id, arg_max(new_status, CASE new_status WHEN 'PENDING' THEN 0 WHEN 'SHIPPED' THEN 1 ELSE 2 END) AS status FROM hist GROUP BY entity_id) WHERE status IN ('PENDING', 'SHIPPED')")
def history_to_current(spark, d):
    h = lc.infer_order_history(history_input(spark, d)).where("new_status is not null")
    return lc.history_to_current(h, "entity_id", "step").where("status in ('PENDING', 'SHIPPED')")


@query("WITH h AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_id % 40 = 7 THEN 'lost' WHEN event_id % 40 = 9 THEN NULL ELSE lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS previous FROM events) SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS expected FROM h) WHERE previous IS DISTINCT FROM expected", views=False)
def chain_continuity(spark, d):
    """Some chains are broken first."""
    e, n = b.table(spark, d, "events"), F.col("event_id")
    told = F.when(n % 40 == 7, "lost").when(n % 40 == 9, F.lit(None)).otherwise(F.col("previous_state"))
    h = ev.previous_state(e, "user_id", "event_type", "ts", "event_id").select("user_id", "event_id", "ts", told.alias("previous_status"), F.col("event_type").alias("new_status"))
    return lc.chain_breaks(h, "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("new_status").alias("event_type"))


@query("SELECT order_id, datediff('day', order_date, ship_date) AS lag_days, NOT datediff('day', order_date, ship_date) BETWEEN 1 AND 5 AS breached FROM ord JOIN ship USING (order_id)")
def handoff_lag(spark, d):
    return ev.handoff_lag(b.bare_orders(spark, d).join(b.shipments(spark, d), "order_id"), "order_date", "ship_date", "order_shipment").select("order_id", F.col("lag_days").cast("long").alias("lag_days"), "breached")


@query("SELECT order_id FROM ord WHERE order_date + 5 <= DATE '1997-01-01' AND order_id NOT IN (SELECT order_id FROM ship)")
def handoff_due(spark, d):
    return ev.handoff_due(b.bare_orders(spark, d), b.shipments(spark, d), "order_id", "order_date", 5, "1997-01-01").select("order_id")


@query("SELECT order_id, CASE WHEN promised_date IN (DATE '1996-01-01', DATE '1996-12-25') THEN CAST(promised_date + 1 AS DATE) ELSE promised_date END AS publish_on FROM ship")
def hold_and_release(spark, d):
    return ev.hold_and_release(b.shipments(spark, d), "promised_date", ["1996-01-01", "1996-12-25"]).select("order_id", "publish_on")


@query("SELECT event_type, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type", views=False)
def anomaly_rate(spark, d):
    e = b.table(spark, d, "events")
    total = F.broadcast(e.agg(F.count("*").alias("t")))
    return e.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(total).select("event_type", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY ALL) WHERE k > 1", views=False)
def collision_check(spark, d):
    li = b.table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), "l_partkey")
    return ev.collision_check(li, "id", "l_partkey").select("id.l_orderkey", "id.l_linenumber")


@query("WITH p AS (SELECT DISTINCT CAST(ts AS DATE) AS business_date, event_type FROM events), n AS (SELECT business_date, count(*) AS n FROM p GROUP BY 1), f AS (SELECT business_date, min(CASE WHEN n < 3 THEN 0 ELSE 1 END) OVER (ORDER BY business_date) AS ok, datediff('day', min(business_date) OVER (), business_date) - row_number() OVER (ORDER BY business_date) + 1 AS gap FROM n) SELECT business_date FROM f WHERE ok = 1 AND gap = 0", views=False)
def watermark_gate(spark, d):
    return ev.watermark_gate(b.table(spark, d, "events").select(F.to_date("ts").alias("business_date"), F.col("event_type").alias("source_system")), 3)


@query("WITH planned AS (SELECT o_orderkey AS order_id FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1996-03-15'), told AS (SELECT order_id FROM ship WHERE order_id % 3 > 0) SELECT 'shipments' AS check_name, order_id AS missing_id FROM planned WHERE order_id NOT IN (SELECT order_id FROM told) UNION ALL SELECT 'deliveries', order_id FROM planned WHERE order_id NOT IN (SELECT order_id FROM ship WHERE delivered_date <= DATE '2000-06-30') UNION ALL SELECT 'lines', order_id FROM planned WHERE order_id NOT IN (SELECT l_orderkey FROM lineitem)")
def reconcile_day(spark, d):
    """The orders of one day: shipped (a third of the shipments wasn't told), delivered by a date, with lines."""
    planned = b.table(spark, d, "orders").where(F.to_date("o_orderdate") == F.lit("1996-03-15").cast("date")).select(F.col("o_orderkey").alias("order_id"))
    s = b.shipments(spark, d)
    lines = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id")).distinct()
    return q.reconcile(planned, {"shipments": (s.where("order_id % 3 > 0"), "order_id"), "deliveries": (s.where(F.col("delivered_date") <= F.lit("2000-06-30").cast("date")), "order_id"), "lines": (lines, "order_id")}, "order_id")


@query("SELECT region, CAST(round(sum(line_amount) / sum(quantity), 4) AS DOUBLE) AS asp FROM ord JOIN line USING (order_id) GROUP BY region")
def m_asp(spark, d):
    both = b.orders(spark, d).join(b.lines(spark, d), "order_id")
    return both.groupBy("region").agg(F.round(F.sum("line_amount").cast("double") / F.sum("quantity"), 4).alias("asp"))


@query("SELECT brand, CAST(round(1 - CAST(sum(line_amount) AS DOUBLE) / CAST(sum(quantity * unit_price) AS DOUBLE), 6) AS DOUBLE) AS realised_discount FROM line GROUP BY brand")
def m_realised_discount(spark, d):
    return b.lines(spark, d).groupBy("brand").agg(F.round(1 - F.sum("line_amount").cast("double") / F.sum(F.col("quantity") * F.col("unit_price")).cast("double"), 6).alias("realised_discount"))


@query("SELECT brand, CAST(sum(line_amount - CAST(round(quantity * unit_price * CAST(0.6 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS gross_margin FROM line GROUP BY brand")
def m_gross_margin(spark, d):
    cost = F.round(F.col("quantity") * F.col("unit_price") * F.lit("0.60").cast("decimal(3,2)"), 2).cast("decimal(18,2)")
    return b.lines(spark, d).groupBy("brand").agg(F.sum(F.col("line_amount") - cost).cast("decimal(18,2)").alias("gross_margin"))


@query("SELECT region, round(count(*) FILTER (WHERE status = 'INVOICED') * 1.0 / count(*) FILTER (WHERE status IN ('INVOICED', 'CANCELLED')), 6) AS win_rate FROM ord GROUP BY region")
def m_win_rate(spark, d):
    return b.orders(spark, d).groupBy("region").agg(F.round(F.count_if(F.col("status") == "INVOICED") / F.count_if(F.col("status").isin("INVOICED", "CANCELLED")), 6).alias("win_rate"))


@query("SELECT region, round(avg(datediff('day', order_date, delivered_date)), 6) AS days FROM ord JOIN ship USING (order_id) WHERE status IN ('INVOICED', 'CANCELLED') GROUP BY region")
def m_sales_cycle(spark, d):
    both = b.orders(spark, d).where("status in ('INVOICED', 'CANCELLED')").join(b.shipments(spark, d), "order_id")
    return both.groupBy("region").agg(F.round(F.avg(F.datediff("delivered_date", "order_date")), 6).alias("days"))


@query("SELECT rep_id, round(CAST(sum(line_amount) AS DOUBLE) / (1000000.0 * 90 / 365), 6) AS attainment FROM line JOIN ord USING (order_id) WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-30' GROUP BY rep_id")
def m_quota_attainment(spark, d):
    o = b.orders(spark, d).where("order_date between date'1996-01-01' and date'1996-03-30'")
    return b.lines(spark, d).join(o, "order_id").groupBy("rep_id").agg(F.round(F.sum("line_amount").cast("double") / F.lit(1000000.0 * 90 / 365), 6).alias("attainment"))


@query("SELECT region, round(count(*) FILTER (WHERE delivered_date <= promised_date) * 1.0 / count(delivered_date), 6) AS otd FROM ord JOIN ship USING (order_id) GROUP BY region")
def m_otd(spark, d):
    both = b.orders(spark, d).join(b.shipments(spark, d), "order_id")
    return both.groupBy("region").agg(F.round(F.count_if(F.col("delivered_date") <= F.col("promised_date")) / F.count("delivered_date"), 6).alias("otd"))


@query("SELECT customer_id FROM ord GROUP BY customer_id HAVING max(CASE WHEN order_date < DATE '1997-01-01' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN order_date >= DATE '1997-01-01' THEN 1 ELSE 0 END) = 0")
def m_logo_churn(spark, d):
    before = F.col("order_date") < F.lit("1997-01-01").cast("date")
    return b.orders(spark, d).groupBy("customer_id").agg(F.bool_or(before).alias("had"), F.bool_or(~before).alias("has")).where("had and not has").select("customer_id")


@query("SELECT customer_id, max(order_date) AS last_order, count(*) FILTER (WHERE order_date >= DATE '1997-01-01') AS trailing_orders FROM ord GROUP BY customer_id")
def trailing_activity(spark, d):
    return b.orders(spark, d).groupBy("customer_id").agg(F.max("order_date").alias("last_order"), F.count_if(F.col("order_date") >= F.lit("1997-01-01").cast("date")).alias("trailing_orders"))


@query("WITH c AS (SELECT customer_id, year(min(order_date)) AS cohort FROM ord GROUP BY 1), s AS (SELECT cohort, year(order_date) AS period, count(*) AS orders_n FROM ord JOIN c USING (customer_id) GROUP BY 1, 2) SELECT cohort, period, orders_n, round(orders_n * 1.0 / lag(orders_n) OVER (PARTITION BY cohort ORDER BY period), 6) AS retention FROM s")
def cohort_retention(spark, d):
    o = b.orders(spark, d)
    c = o.groupBy("customer_id").agg(F.year(F.min("order_date")).cast("long").alias("cohort"))
    s = o.join(c, "customer_id").groupBy("cohort", F.year("order_date").cast("long").alias("period")).agg(F.count("*").alias("orders_n"))
    return s.withColumn("retention", F.round(F.col("orders_n") / F.lag("orders_n").over(Window.partitionBy("cohort").orderBy("period")), 6))


@query(f"WITH {_TOTALS}, c AS (SELECT customer_id, year(min(order_date)) AS cohort FROM ord GROUP BY 1), s AS (SELECT cohort, year(order_date) AS period, sum(amount) AS revenue FROM tot JOIN c USING (customer_id) GROUP BY 1, 2) SELECT cohort, period, round(CAST(revenue AS DOUBLE) / CAST(lag(revenue) OVER (PARTITION BY cohort ORDER BY period) AS DOUBLE), 6) AS nrr FROM s")
def m_nrr(spark, d):
    o = totals(spark, d)
    c = o.groupBy("customer_id").agg(F.year(F.min("order_date")).cast("long").alias("cohort"))
    s = o.join(c, "customer_id").groupBy("cohort", F.year("order_date").cast("long").alias("period")).agg(F.sum("amount").cast("double").alias("r"))
    return s.select("cohort", "period", F.round(F.col("r") / F.lag("r").over(Window.partitionBy("cohort").orderBy("period")), 6).alias("nrr"))


_CASES = "WITH k AS (SELECT event_id AS case_id, user_id, event_type, ts AS opened_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS closed_at FROM events), cases AS (SELECT case_id, opened_at, closed_at, round((epoch(closed_at) - epoch(opened_at)) / 3600, 4) AS hours FROM k WHERE event_type = 'error')"


def cases(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = b.table(spark, d, "events").withColumn("closed_at", F.lead("ts").over(w)).where("event_type = 'error'")
    s = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return e.select(F.col("event_id").alias("case_id"), F.col("ts").alias("opened_at"), "closed_at", F.round((s("closed_at") - s("ts")) / 3600, 4).alias("hours"))


@query(f"{_CASES} SELECT case_id, hours FROM cases", views=False)
def resolution_hours(spark, d):
    return cases(spark, d).select("case_id", "hours")


@query(f"{_CASES} SELECT round(quantile_cont(hours, 0.5), 4) AS median_hours, round(quantile_cont(hours, 0.9), 4) AS p90_hours FROM cases", views=False)
def m_time_to_resolution(spark, d):
    one = sketches.exact_quantiles(cases(spark, d), "hours", [0.5, 0.9])
    of = lambda p: F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 4)
    return one.agg(of(0.5).alias("median_hours"), of(0.9).alias("p90_hours"))


# Sketches by case id's last digit, merged: their quantiles have ranks within 2 % of those asked for.
@query("SELECT p, true AS near FROM (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) AS v(p)", views=False)
def time_to_resolution_sketches(spark, d):
    c = cases(spark, d).withColumn("slot", F.pmod("case_id", F.lit(10)))
    told = sketches.merged_quantiles(sketches.quantile_sketches(c, "slot", "hours"), [0.5, 0.9, 0.99])
    h = c.select("hours").join(F.broadcast(told)).groupBy("p").agg(F.avg((F.col("hours") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("hours") <= F.col("value")).cast("int")).alias("upto"))  # three rows
    return h.select("p", ((F.col("below") <= F.col("p") + 0.02) & (F.col("upto") >= F.col("p") - 0.02)).alias("near"))


@query("SELECT status, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM ord GROUP BY status")
def d_funnel(spark, d):
    n = b.orders(spark, d).groupBy("status").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT rep_id, CAST(bookings AS DECIMAL(18,2)) AS bookings, rank() OVER (ORDER BY bookings DESC) AS place FROM (SELECT rep_id, sum(line_amount) AS bookings FROM line GROUP BY rep_id)")
def d_rep_leaderboard(spark, d):
    """Places are counted by ranges of the amounts; equal amounts share the first."""
    r = b.lines(spark, d).groupBy("rep_id").agg(money_sum("line_amount", "bookings"))
    placed = numbered(r.withColumn("_down", -F.col("bookings")), "_down", "rep_id")
    first = placed.groupBy("bookings").agg((F.min("sequence_number") + 1).alias("place"))
    return placed.join(first, "bookings").select("rep_id", "bookings", "place")


@query("""WITH s AS (SELECT region, year(order_date) * 12 + month(order_date) AS m, count(*) AS n FROM ord GROUP BY ALL) SELECT region, m, n, n - lag(n) OVER (PARTITION BY region ORDER BY m) AS change,
round((n - avg(n) OVER (PARTITION BY region)) / stddev_samp(n) OVER (PARTITION BY region), 6) AS z FROM s""")
def d_period_change(spark, d):
    s = b.orders(spark, d).groupBy("region", (F.year("order_date") * 12 + F.month("order_date")).cast("long").alias("m")).agg(F.count("*").alias("n"))
    w, by = Window.partitionBy("region"), Window.partitionBy("region").orderBy("m")
    return s.select("region", "m", "n", (F.col("n") - F.lag("n").over(by)).alias("change"), F.round((F.col("n") - F.avg("n").over(w)) / F.stddev_samp("n").over(w), 6).alias("z"))


@query("SELECT order_date, region, n, lag(n) OVER (PARTITION BY region ORDER BY order_date) AS before, CAST(isodow(order_date) - 1 AS INTEGER) AS weekday FROM (SELECT order_date, region, count(*) AS n FROM ord GROUP BY ALL)")
def f_order_volume(spark, d):
    s = b.orders(spark, d).groupBy("order_date", "region").agg(F.count("*").alias("n"))
    return s.select("order_date", "region", "n", F.lag("n").over(Window.partitionBy("region").orderBy("order_date")).alias("before"), F.weekday("order_date").alias("weekday"))


@query("SELECT order_id, CAST(ship_date + CAST(CASE order_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 9 END + (order_id * 37 % 4000) // 900 AS INTEGER) AS DATE) AS promised_date FROM ship")
def promised_date(spark, d):
    """Ground, express and sea shipments over invented distances."""
    n = F.col("order_id")
    service = F.when(n % 3 == 0, "GROUND").when(n % 3 == 1, "EXPRESS").otherwise("SEA")
    return b.shipments(spark, d).select("order_id", lc.promised_date(F.col("ship_date"), service, n * 37 % 4000).alias("promised_date"))


@query("SELECT order_id, CASE status WHEN 'INVOICED' THEN 100 WHEN 'CANCELLED' THEN 0 WHEN 'SHIPPED' THEN 75 WHEN 'PENDING' THEN 50 ELSE 10 END AS probability FROM ord")
def stage_probability(spark, d):
    s = F.col("status")
    p = F.when(s == "INVOICED", 100).when(s == "CANCELLED", 0).when(s == "SHIPPED", 75).when(s == "PENDING", 50).otherwise(10)
    return b.bare_orders(spark, d).select("order_id", p.alias("probability"))
