"""Status histories: inferred from current rows, checked, folded back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Allowed transitions of each entity type; None is the creation.
TRANSITIONS = {
    "order": ((None, "PENDING"), ("PENDING", "SHIPPED"), ("SHIPPED", "INVOICED"), ("PENDING", "CANCELLED"), ("SHIPPED", "CANCELLED")),
    "shipment": ((None, "SHIPPED"), ("SHIPPED", "DELIVERED")),
    "invoice": ((None, "ISSUED"), ("ISSUED", "VOID")),
    "case": ((None, "Open"), ("Open", "Resolved"), ("Resolved", "Closed")),
}


def _event(when: Column, previous: str | Column | None, new: str, at: Column, due: Column | None = None) -> Column:
    previous = previous if isinstance(previous, Column) else F.lit(previous).cast("string")
    due = F.lit(None).cast("timestamp_ntz") if due is None else due.cast("timestamp_ntz")
    return F.when(when, F.struct(previous.alias("previous_status"), F.lit(new).alias("new_status"), at.cast("timestamp_ntz").alias("occurred_at"), due.alias("sla_due_at")))


def _exploded(df: DataFrame, id: str, events: list[Column], invalid: Column) -> DataFrame:
    rows = df.select(F.col(id).alias("entity_id"), F.coalesce(invalid, F.lit(False)).alias("invalid"), F.array_compact(F.array(*events)).alias("events"))
    out = rows.select("entity_id", "invalid", F.posexplode_outer("events").alias("step", "e"))
    return out.select("entity_id", "invalid", "step", "e.previous_status", "e.new_status", "e.occurred_at", "e.sla_due_at", sla_status(F.col("e.occurred_at"), F.col("e.sla_due_at")).alias("sla_status"))


def sla_status(at: Column, due: Column) -> Column:
    """BREACHED if it happened on a later business date than it was due, else ON_TIME (also without a due time)."""
    return F.when(F.to_date(at) > F.to_date(due), "BREACHED").otherwise("ON_TIME")


def clamp_not_before(at: Column, *floors: Column, by_date: bool = False) -> Column:
    """`at` raised to each floor that isn't NULL. by_date: `at` or the floor is a date, so that a floor later on the same day doesn't raise it."""
    for f in floors:
        f = f.cast("timestamp_ntz")
        below = F.to_date(at) < F.to_date(f) if by_date else at < f
        at = F.when(f.isNotNull() & below, f).otherwise(at)
    return at


# Days of each service level, and how many kilometres take a further day.
SERVICE_DAYS = {"GROUND": 5, "EXPRESS": 2, "SEA": 9}
KM_PER_DAY = 900


def promised_date(ship: Column, service: Column, km: Column) -> Column:
    """The ship date and the days of the service level, and one for each whole 900 km."""
    days = F.create_map(*(F.lit(x) for pair in SERVICE_DAYS.items() for x in pair))[service]
    return F.date_add(ship, (days + F.floor(km / KM_PER_DAY)).cast("int"))


def infer_order_history(orders: DataFrame, id: str = "order_id") -> DataFrame:
    """Transitions that an order's current row implies, from columns created_at, updated_at, requested_date, ship_date (DATE), invoiced_at, status.

    A ship date is compared with the creation by date and stands at midnight. What can't be told makes the row invalid; its valid first events stay. Rows without events have one row of NULLs.
    """
    created, updated, ship = F.col("created_at"), F.col("updated_at"), F.col("ship_date")
    status = F.col("status")
    shipped_at = F.when(ship >= F.to_date(created), ship.cast("timestamp_ntz")).otherwise(created.cast("timestamp_ntz"))
    has = created.isNotNull()
    shipped = has & (status.isin("SHIPPED", "INVOICED") | ((status == "CANCELLED") & ship.isNotNull()))
    invoice = F.when(F.col("invoiced_at").isNotNull() & (F.col("invoiced_at") >= shipped_at), F.col("invoiced_at")).otherwise(updated).cast("timestamp_ntz")
    invoiced = shipped & (status == "INVOICED") & invoice.isNotNull()
    cancelled = has & (status == "CANCELLED") & updated.isNotNull()
    events = [
        _event(has, None, "PENDING", created, F.col("requested_date")),
        _event(shipped, "PENDING", "SHIPPED", shipped_at),
        _event(invoiced, "SHIPPED", "INVOICED", clamp_not_before(invoice, shipped_at, created), F.date_add(F.to_date(shipped_at), 3)),
        _event(cancelled, F.when(ship.isNotNull(), "SHIPPED").otherwise("PENDING"), "CANCELLED", clamp_not_before(updated.cast("timestamp_ntz"), F.when(ship.isNotNull(), shipped_at), created)),
    ]
    invalid = created.isNull() | ((status == "INVOICED") & invoice.isNull()) | ((status == "CANCELLED") & updated.isNull())
    return _exploded(orders, id, events, invalid)


def infer_shipment_history(shipments: DataFrame, id: str = "order_id") -> DataFrame:
    ship, delivered = F.col("ship_date"), F.col("delivered_date")
    due = F.col("promised_date")
    return _exploded(shipments, id, [_event(ship.isNotNull(), None, "SHIPPED", ship, due), _event(delivered >= ship, "SHIPPED", "DELIVERED", delivered, due)], ship.isNull() | (delivered < ship))


def infer_invoice_history(invoices: DataFrame, id: str = "invoice_id") -> DataFrame:
    created, updated = F.col("created_at"), F.col("updated_at")
    void = F.col("status") == "VOID"
    return _exploded(invoices, id, [_event(created.isNotNull(), None, "ISSUED", created), _event(void & (updated >= created), "ISSUED", "VOID", updated)], created.isNull() | (void & ~F.coalesce(updated >= created, F.lit(False))))


def infer_case_history(cases: DataFrame, id: str = "case_id", days: int = 3) -> DataFrame:
    opened, updated, hours = F.col("opened_at"), F.col("updated_at"), F.col("resolution_hours")
    resolved_at = opened.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.floor(hours).cast("int"), F.floor((hours - F.floor(hours)) * 60).cast("int"))
    done = F.col("status").isin("Resolved", "Closed")
    fine = done & hours.isNotNull() & (hours >= 0) & (updated >= resolved_at)
    due = F.date_add(F.to_date(opened), days)
    return _exploded(cases, id, [_event(opened.isNotNull(), None, "Open", opened, due), _event(fine, "Open", "Resolved", resolved_at, due), _event(fine & (F.col("status") == "Closed"), "Resolved", "Closed", updated)], opened.isNull() | (done & ~F.coalesce(fine, F.lit(False))))


def infer_report(history: DataFrame) -> DataFrame:
    """Scanned rows, rows with events, events, and invalid rows."""
    return history.agg(F.count_distinct("entity_id").alias("scanned"), F.count_distinct(F.when(F.col("new_status").isNotNull(), F.col("entity_id"))).alias("eligible"), F.count("new_status").alias("inferred"), F.count_distinct(F.when(F.col("invalid"), F.col("entity_id"))).alias("skipped_invalid"))


def transition_check(history: DataFrame, entity: str) -> DataFrame:
    """(previous_status, new_status, n) of transitions that aren't allowed."""
    allowed = [F.col("previous_status").eqNullSafe(F.lit(a).cast("string")) & (F.col("new_status") == b) for a, b in TRANSITIONS[entity]]
    ok = allowed[0]
    for a in allowed[1:]:
        ok = ok | a
    return history.where(F.col("new_status").isNotNull() & ~ok).groupBy("previous_status", "new_status").agg(F.count("*").alias("n"))


def chain_breaks(history: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """Rows whose previous status isn't the new one of the row before."""
    before = F.lag("new_status").over(Window.partitionBy(entity).orderBy(*order))
    return history.withColumn("expected", before).where(~F.col("previous_status").eqNullSafe(F.col("expected")))


def history_to_current(history: DataFrame, entity: str, *order: str) -> DataFrame:
    return history.groupBy(entity).agg(F.max_by("new_status", F.struct(*order)).alias("status"))


def append_history(existing: DataFrame, new: DataFrame, event_id: str, entity: str) -> DataFrame:
    """Existing rows and new ones of entities without any history, whose event ids are new."""
    fresh = new.join(existing.select(entity).distinct(), entity, "left_anti").join(existing.select(event_id), event_id, "left_anti").dropDuplicates([event_id])
    return existing.unionByName(fresh)


def fold_status(events: DataFrame, entity: str, stages: list[tuple[str, str]]) -> DataFrame:
    """(entity, status, updated_at, one column per stage with its first time) from events (entity, kind, at); stages: (kind, status) in order. The status is that of the last stage reached without a gap; entities whose first stage is missing have none."""
    wide = events.groupBy(entity).agg(*(F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"{k}_at") for k, _ in stages))
    status, updated, reached = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz"), F.lit(True)
    for k, s in stages:
        reached = reached & F.col(f"{k}_at").isNotNull()
        status, updated = F.when(reached, s).otherwise(status), F.when(reached, F.col(f"{k}_at")).otherwise(updated)
    return wide.select(entity, status.alias("status"), updated.alias("updated_at"), *(f"{k}_at" for k, _ in stages))


def stage_history(versions: DataFrame, entity: str, state: str, *order: str) -> DataFrame:
    """Versions that create an entity or change its state, with the state before."""
    before = F.lag(state).over(Window.partitionBy(entity).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(entity).orderBy(*order)) == 1
    return versions.withColumn("previous", before).withColumn("_first", first).where(F.col("_first") | ~F.col(state).eqNullSafe(F.col("previous"))).drop("_first")


def stage_history_check(expected: DataFrame, actual: DataFrame, id: str, entity: str, state: str, at: str, first: str, last: str) -> DataFrame:
    """(rule, violations) of a published history against the expected rows: one outer join by id. Both have id, entity, previous, state and at."""
    names = [entity, "previous", state, at]
    both = expected.select(id, F.lit(True).alias("_expected"), *(F.col(c).alias(f"e_{c}") for c in names)).join(actual.groupBy(id).agg(F.count("*").alias("_n"), *(F.min(c).alias(f"a_{c}") for c in names)), id, "full")
    e, a = F.col("_expected").isNotNull(), F.col("_n").isNotNull()
    rules = {
        "duplicate_id": F.col("_n") > 1,
        "missing_id": e & ~a,
        "unexpected_id": a & ~e,
        "wrong_entity": e & a & ~F.col(f"e_{entity}").eqNullSafe(F.col(f"a_{entity}")),
        "wrong_state": e & a & ~F.col(f"e_{state}").eqNullSafe(F.col(f"a_{state}")),
        "wrong_time": e & a & ~F.col(f"e_{at}").eqNullSafe(F.col(f"a_{at}")),
        "wrong_previous": e & a & ~F.col("e_previous").eqNullSafe(F.col("a_previous")),
        "no_change": a & (F.col("a_previous") == F.col(f"a_{state}")),
        "outside_partition": a & ~F.to_date(f"a_{at}").between(F.lit(first).cast("date"), F.lit(last).cast("date")),
    }
    one = both.agg(*(F.count_if(r).alias(k) for k, r in rules.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules))))
