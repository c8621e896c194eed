"""Identifiers and keys derived by hashing and canonical spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import canonical_json


def canonical_account(text: Column) -> Column:
    """`ACC-000123` from spellings with a space for the dash, small letters, no padding, or blanks around."""
    digits = F.regexp_extract(text, "([0-9]+)", 1)
    return F.when(digits != "", F.concat(F.lit("ACC-"), F.lpad(digits, 6, "0")))


def stable_event_id(day: Column, system: Column, kind: Column, entity: Column, payload: Column) -> Column:
    """The digest of an event's date, system, type, entity and payload, a JSON text in any spelling; NULL if the payload isn't JSON."""
    return F.sha2(F.concat(day.cast("string"), F.lit("|"), system, F.lit("|"), kind, F.lit("|"), entity.cast("string"), F.lit("|"), canonical_json(payload)), 256)


def inferred_event_id(history: str, entity: Column, transition: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit("inferred_baseline"), F.lit(history), entity.cast("string"), transition), 256)


def generated_record_id(job: str, row: Column) -> Column:
    return F.concat(F.lit("001"), F.substring(F.sha1(F.concat_ws(":", F.lit(job), row.cast("string"))), 1, 15))


def stable_bucket(key: Column, span: int, offset: int = 0) -> Column:
    """A number from `offset` on, below offset + span, from the first byte of a digest."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int") % span) + offset


def composite_key(*columns: str) -> Column:
    return F.concat_ws(chr(31), *(F.col(c).cast("string") for c in columns))


def strict_boolean(text: Column) -> Column:
    """true/1 and false/0 in any case; NULL for all else."""
    return F.when(F.lower(text).isin("true", "1"), True).when(F.lower(text).isin("false", "0"), False)
