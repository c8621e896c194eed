"""Data quality: constraints, profiles, contracts, reconciliation."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_constraints(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """(table_name, rule, violations), one scan for all rules; a rule that is NULL holds."""
    names = list(rules)
    one = df.agg(*(F.count_if(~F.coalesce(r, F.lit(True))).alias(f"r{i}") for i, r in enumerate(rules.values())))
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(names)))
    return one.select(F.lit(table).alias("table_name"), F.inline(pairs))


def unique_violations(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def orphan_refs(child: DataFrame, column: str, parent: DataFrame, key: str, relation: str) -> DataFrame:
    """(relation, orphans): rows whose reference isn't there; NULL refers to nothing."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(relation).alias("relation"), "orphans")


def profile_columns(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column_name, nulls, distinct_values, n_rows) in one pass; distinct counts are approximate unless `exact`."""
    count = F.count_distinct if exact else F.approx_count_distinct
    wide = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)), *(count(F.col(c)).alias(f"d{i}") for i, c in enumerate(df.columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct_values"), F.col("n").alias("n_rows")) for i, c in enumerate(df.columns)))
    return wide.select(F.inline(rows))


def partition_advice(profile: DataFrame, target: int) -> tuple[str | None, int]:
    """The first date-like column with several values to partition by, if the table exceeds the target, and how many partitions; from a profile's few rows."""
    rows = profile.collect()
    n = rows[0]["n_rows"] if rows else 0
    date = next((r["column_name"] for r in rows if r["column_name"].lower().endswith(("_date", "_at", "date")) and r["distinct_values"] > 1), None)
    return (date if n > target else None), max(1, math.ceil(n / target))


def contract_columns(df: DataFrame, table: str) -> DataFrame:
    """(table_name, ordinal_position, column_name, data_type, is_nullable, length, precision, scale) of a table's columns: the length of char and varchar; the digits of decimals (scale: behind the point) and whole numbers (scale 0); NULL for all else."""
    whole = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}

    def one(k: int, f: T.StructField) -> tuple:
        kind = f.dataType
        length = kind.length if isinstance(kind, (T.CharType, T.VarcharType)) else None
        if stated := re.fullmatch(r"(?:var)?char\(([0-9]+)\)", f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")):
            length = int(stated[1])  # tables have them as text with a note
        digits = (kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else (whole.get(kind.simpleString()), 0 if kind.simpleString() in whole else None)
        return (table, k + 1, f.name, kind.simpleString(), f.nullable, length, *digits)

    rows = [one(k, f) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table_name string, ordinal_position int, column_name string, data_type string, is_nullable boolean, length int, precision int, scale int")


def schema_fingerprint(contract: DataFrame) -> DataFrame:
    """(table_name, schema_fingerprint): SHA-256 of the columns in order as compact JSON."""
    facets = [c for c in ("length", "precision", "scale") if c in contract.columns]
    one = F.to_json(F.struct("column_name", "data_type", "is_nullable", "ordinal_position", *facets))
    return contract.groupBy("table_name").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal_position", one.alias("j")))), lambda x: x["j"]), ","), 256).alias("schema_fingerprint"))


def contract_versions(known: DataFrame, seen: DataFrame) -> DataFrame:
    """`known` (table_name, version, schema_fingerprint, retired) with new versions for unseen fingerprints, numbered on; the one before retires. A fingerprint that returns adds nothing."""
    new = seen.select("table_name", "schema_fingerprint").distinct().join(known.select("table_name", "schema_fingerprint"), ["table_name", "schema_fingerprint"], "left_anti")
    last = known.groupBy("table_name").agg(F.max("version").alias("last"))
    own = Window.partitionBy("table_name").orderBy("schema_fingerprint")  # several unseen ones of a table follow each other, the last one holds
    number, next_ = F.coalesce("last", F.lit(0)) + F.row_number().over(own), F.lead("schema_fingerprint").over(own)
    added = new.join(last, "table_name", "left").select("table_name", number.cast("int").alias("version"), "schema_fingerprint", next_.isNotNull().alias("retired"))
    old = known.join(added.select("table_name", F.lit(True).alias("replaced")).distinct(), "table_name", "left").select("table_name", F.col("version").cast("int").alias("version"), "schema_fingerprint", (F.col("retired") | F.coalesce("replaced", F.lit(False))).alias("retired"))
    return old.unionByName(added)


def current_contract(versions: DataFrame, columns: DataFrame) -> DataFrame:
    """The columns (table_name, schema_fingerprint, column_name, ...) of each table's version that isn't retired."""
    return versions.where("not retired").select("table_name", "version", "schema_fingerprint").join(columns, ["table_name", "schema_fingerprint"])


def describe_type(df: DataFrame, id: str) -> DataFrame:
    """(field, type, nillable, custom) of an object's fields, in order. Its id and names that end in Id are of type id; decimals count as text; only the id must have a value."""
    kinds = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "double", "double": "double", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime"}
    kind = lambda f: "id" if f.name == id or f.name.endswith("Id") else kinds.get(f.dataType.simpleString(), "string")
    rows = [(f.name, kind(f), f.name != id, f.name.endswith("__c")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "field string, type string, nillable boolean, custom boolean")


def history_coverage(entities: DataFrame, history: DataFrame) -> DataFrame:
    """(entity_type, eligible, inferred, recorded, invalid) from entities (entity_type, entity_id) and history (entity_type, entity_id, origin, occurred_at, recorded_at): how many there are, how many have inferred and recorded histories, and whose first event is later than all their records."""
    inferred = F.col("origin").eqNullSafe(F.lit("inferred_baseline"))
    each = history.groupBy("entity_type", "entity_id").agg(F.max(inferred).alias("inferred"), F.max(~inferred).alias("recorded"), (F.min("occurred_at") > F.max("recorded_at")).alias("invalid"))
    both = entities.distinct().join(each, ["entity_type", "entity_id"], "left")
    return both.groupBy("entity_type").agg(F.count("*").alias("eligible"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(c) for c in ("inferred", "recorded", "invalid")))


def run_state_counts(runs: DataFrame) -> DataFrame:
    """(state, runs, first_incomplete): runs (business_date, state) by state, and the first date that isn't completed."""
    first = runs.agg(F.min(F.when(F.col("state") != "COMPLETED", F.col("business_date"))).alias("first_incomplete"))
    return runs.groupBy("state").agg(F.count("*").alias("runs")).crossJoin(F.broadcast(first))  # one row


def backfill_status(progress: DataFrame) -> DataFrame:
    """The last checkpoint of each target: (target, scanned, updated, done) from rows (target, at, scanned, updated, done)."""
    return progress.groupBy("target").agg(F.max_by(F.struct("scanned", "updated", "done"), F.struct("at", "scanned")).alias("x")).select("target", "x.*")


def typed_load(df: DataFrame, types: dict[str, str], required: set[str], rules: dict[str, Column]) -> DataFrame:
    """`df` with the columns and types of a contract. What is missing or NULL comes from its rule; supplied values stay; a required column without values or a rule is an error. Rules see the typed columns."""
    if lacking := sorted(c for c in required if c not in df.columns and c not in rules):
        raise ValueError(f"required columns without values or rules: {', '.join(lacking)}")
    typed = df.select(*((F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in types.items()))
    return typed.select(*((F.coalesce(F.col(c), rules[c].cast(t)) if c in rules else F.col(c)).alias(c) for c, t in types.items()))


def schema_drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """(table_name, column_name, change): added, removed or retyped columns."""
    side = lambda df, name: df.select("table_name", "column_name", F.col("data_type").alias(name))
    both = side(before, "old").join(side(now, "new"), ["table_name", "column_name"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "retyped")
    return both.withColumn("change", change).where("change is not null").select("table_name", "column_name", "change")


def audit_backfill(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Missing audit columns filled by their rules, never overwritten."""
    return df.withColumns({c: F.coalesce(F.col(c), r) if c in df.columns else r for c, r in rules.items()})


def readiness(tables: dict[str, DataFrame], may_be_empty: set[str] = frozenset()) -> DataFrame:
    """(table_name, ready): whether each required table has a row; reads one row of each."""
    one = [df.limit(1).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), ((F.col("n") > 0) | F.lit(n in may_be_empty)).alias("ready")) for n, df in tables.items()]
    return reduce(DataFrame.union, one)


def reconcile(planned: DataFrame, applied: dict[str, tuple[DataFrame, str]], id: str) -> DataFrame:
    """(check_name, missing_id): planned ids that a system's table doesn't have."""
    return reduce(DataFrame.union, (planned.join(df.select(F.col(key).alias(id)), id, "left_anti").select(F.lit(n).alias("check_name"), F.col(id).alias("missing_id")) for n, (df, key) in applied.items()))


def grain_dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in df.columns if c not in keys)), F.struct(*order)).alias("row")).select(*keys, "row.*")


def ledger_changes(before: DataFrame, after: DataFrame, id: str) -> DataFrame:
    """(id, change) of rows of an append-only ledger that a later snapshot deleted or changed; new rows are fine."""
    columns = [c for c in before.columns if c != id]
    old = before.select(id, F.struct(*columns).alias("old"))
    both = old.join(after.select(id, F.struct(*columns).alias("new"), F.lit(True).alias("there")), id, "left")
    change = F.when(F.col("there").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(id, change.alias("change")).where("change is not null")


def table_status(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, bytes) of file tables; reads footers and file metadata only."""
    one = []
    for name, df in tables.items():
        files = df.groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("n"))
        one.append(files.agg(F.sum("n").alias("n_rows"), F.sum("file_size").alias("bytes")).select(F.lit(name).alias("table_name"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("bytes", F.lit(0)).alias("bytes")))
    return reduce(DataFrame.union, one)
