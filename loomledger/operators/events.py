"""Business events: idempotent application, folds to current state, hand-off timing, ledger postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import valid_range_join

# Days allowed between an upstream event and the next one.
HANDOFF_DAYS = {"won_order": (1, 3), "order_shipment": (1, 5), "shipment_delivery": (1, 5), "shipment_invoice": (0, 3), "invoice_posting": (1, 2)}
PRIORITY = ("order", "shipment", "delivery", "invoice", "case_open", "case_resolve", "case_close")


def idempotent_apply(events: DataFrame, ledger: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Events that the ledger doesn't have, each once."""
    return events.join(ledger.select(event_id), event_id, "left_anti").dropDuplicates([event_id])


def event_ledger_append(ledger: DataFrame, events: DataFrame, event_id: str = "event_id") -> DataFrame:
    """The ledger with the events that it doesn't have, each once; what is there stays as it is."""
    return ledger.unionByName(idempotent_apply(events, ledger, event_id).select(*ledger.columns))


def handoff_lag(pairs: DataFrame, upstream: str, downstream: str, kind: str) -> DataFrame:
    """With lag_days and breached: whether the lag is outside the window of its kind."""
    low, high = HANDOFF_DAYS[kind]
    lag = F.datediff(F.col(downstream), F.col(upstream))
    return pairs.withColumn("lag_days", lag).withColumn("breached", ~lag.between(low, high))


def handoff_due(upstream: DataFrame, done: DataFrame, key: str, at: str, days: int, as_of: str) -> DataFrame:
    """Items due by a date and not yet downstream."""
    return upstream.where(F.date_add(F.col(at), days) <= F.lit(as_of).cast("date")).join(done.select(key), key, "left_anti")


def hold_and_release(df: DataFrame, due: str, holds: list[str]) -> DataFrame:
    """publish_on: items due on a hold date wait a day; others publish when due."""
    held = F.col(due).isin(*(F.lit(h).cast("date") for h in holds)) if holds else F.lit(False)
    return df.withColumn("publish_on", F.when(held, F.date_add(F.col(due), 1)).otherwise(F.col(due)))


def event_order(kind: Column) -> Column:
    """The number of an event type in the order of application."""
    return reduce(lambda acc, p: acc.when(kind == p[1], p[0]), enumerate(PRIORITY), F.when(F.lit(False), -1)).otherwise(len(PRIORITY))


def previous_state(df: DataFrame, entity: str, state: str, *order: str) -> DataFrame:
    return df.withColumn("previous_state", F.lag(state).over(Window.partitionBy(entity).orderBy(*order)))


def apply_patches(current: DataFrame, patches: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """Current rows overlaid with the fields that a patch has; action: create, update, keep, or error when an existing id is created or an unknown one updated. patches: id, op, columns."""
    c = current.select(F.col(id), *(F.col(x).alias(f"old_{x}") for x in columns), F.lit(True).alias("known"))
    both = c.join(patches.select(id, "op", *columns), id, "full")
    action = F.when(F.col("op").isNull(), "keep").when((F.col("op") == "create") & F.col("known"), "error").when((F.col("op") == "update") & F.col("known").isNull(), "error").otherwise(F.col("op"))
    return both.select(id, action.alias("action"), *(F.coalesce(x, f"old_{x}").alias(x) for x in columns))


def collision_check(df: DataFrame, id: str, key: str) -> DataFrame:
    """Ids with more than one business key."""
    return df.groupBy(id).agg(F.count_distinct(key).alias("keys")).where("keys > 1")


def post_revenue(invoices: DataFrame, daily: DataFrame, centers: DataFrame) -> DataFrame:
    """INV postings of invoices (order_id, invoice_date, company_code, currency_code, company_currency, amount): both currencies, period, the lowest valid cost centre that is active."""
    from ..functions.money import convert_currency

    centers = centers.where("is_active") if "is_active" in centers.columns else centers
    placed = valid_range_join(invoices, centers, "company_code", "invoice_date", "cost_center_code")
    both = convert_currency(placed, daily, "amount", "currency_code", "company_currency", "invoice_date", "amount_company")
    return both.select(F.col("order_id").alias("posting_id"), F.concat(F.lit("INV-"), F.lpad(F.col("order_id").cast("string"), 12, "0")).alias("document_number"), F.lit("INV").alias("document_type"), "company_code", "cost_center_code", F.col("invoice_date").alias("posting_date"), F.date_format("invoice_date", "yyyy-MM").alias("fiscal_period"), "currency_code", F.col("amount").alias("amount_doc"), "company_currency", "amount_company")


def reverse_postings(postings: DataFrame, which: Column, days: int, shift: int) -> DataFrame:
    """CRN rows that negate the chosen postings `days` later and name what they reverse."""
    later = F.date_add("posting_date", days)
    return postings.where(which).select((F.col("posting_id") + shift).alias("posting_id"), F.regexp_replace("document_number", "^INV", "CRN").alias("document_number"), F.lit("CRN").alias("document_type"), "company_code", "cost_center_code", later.alias("posting_date"), F.date_format(later, "yyyy-MM").alias("fiscal_period"), "currency_code", (-F.col("amount_doc")).cast("decimal(18,2)").alias("amount_doc"), "company_currency", (-F.col("amount_company")).cast("decimal(18,2)").alias("amount_company"), F.col("posting_id").alias("reverses_posting_id"))


def watermark_gate(runs: DataFrame, systems: int) -> DataFrame:
    """Business dates that are complete in all systems and without a gap before them. runs: (business_date, source_system)."""
    days = runs.groupBy("business_date").agg(F.count_distinct("source_system").alias("n"))
    before = F.min(F.when(F.col("n") < systems, 0).otherwise(1)).over(Window.orderBy("business_date"))  # one row per day: small
    start = F.min("business_date").over(Window.orderBy(F.lit(1)))
    step = F.datediff("business_date", start) - F.row_number().over(Window.orderBy("business_date")) + 1
    return days.select("business_date", before.alias("full"), step.alias("gap")).where("full = 1 and gap = 0").select("business_date")


def case_due(deliveries: DataFrame, cases: DataFrame, as_of: str, open_days: int = 1, resolve_days: int = 2, close_days: int = 1) -> DataFrame:
    """(id, stage): cases to open after a delivery (id, delivered_on), to resolve and to close (cases: id, opened_on, resolved_on, closed_on) by a date."""
    opened, resolved, closed = (cases.where(f"{c} is not null") for c in ("opened_on", "resolved_on", "closed_on"))
    steps = ((deliveries, opened, "delivered_on", open_days, "open"), (opened, resolved, "opened_on", resolve_days, "resolve"), (resolved, closed, "resolved_on", close_days, "close"))
    return reduce(DataFrame.union, (handoff_due(up, done, "id", at, days, as_of).select("id", F.lit(stage).alias("stage")) for up, done, at, days, stage in steps))
