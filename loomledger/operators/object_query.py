"""Queries on one object with structured arguments: projection, predicates, soft delete, order, limit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import numbered

MAX_OFFSET, PAGE_MIN, PAGE_MAX = 2000, 200, 2000


class QueryError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def resolve(df: DataFrame, name: str) -> str:
    """The object's own spelling of a field."""
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    raise QueryError("INVALID_FIELD", name)


def predicate(df: DataFrame, field: str, op: str, value) -> Column:
    """Text is compared without case by =, !=, LIKE and IN, with case by ranges; NULL only by = and !=."""
    name = resolve(df, field)
    c, text = F.col(name), isinstance(df.schema[name].dataType, T.StringType)
    op = op.upper()
    if value is None:
        if op not in ("=", "!="):
            raise QueryError("MALFORMED_QUERY", f"{op} null")
        return c.isNull() if op == "=" else c.isNotNull()
    if op == "IN":
        items = list(value)
        fold = text and all(isinstance(v, str) for v in items)
        return F.lower(c).isin([v.lower() for v in items]) if fold else c.isin(items)
    if op == "LIKE":
        pattern = value.replace("\\", "\\\\")  # a backslash is a letter like others here
        return c.ilike(pattern) if text else c.cast("string").like(pattern)
    if text and not isinstance(value, str):
        raise QueryError("INVALID_QUERY_FILTER_OPERATOR", f"{name} is text, {value!r} isn't")
    if op in ("=", "!="):
        left, right = (F.lower(c), F.lit(value.lower())) if text and isinstance(value, str) else (c, F.lit(value).cast(df.schema[name].dataType))
        return left == right if op == "=" else left != right
    right = F.lit(value).cast(df.schema[name].dataType)
    return {"<": c < right, "<=": c <= right, ">": c > right, ">=": c >= right}[op]


def object_query(df: DataFrame, fields: Sequence[str] | str = "*", where: Sequence[tuple] = (), order_by: tuple[str, str] | None = None, limit: int | None = None, offset: int = 0, deleted: str | None = None, include_deleted: bool = False) -> DataFrame:
    """Rows of an object. `where`: (field, operator, value) triples, all of which must hold; `deleted`: the soft-delete flag."""
    if offset > MAX_OFFSET:
        raise QueryError("NUMBER_OUTSIDE_VALID_RANGE", str(offset))
    out = df if include_deleted or deleted is None else df.where(~F.col(resolve(df, deleted)))
    if where:
        out = out.where(reduce(lambda a, b: a & b, (predicate(df, *w) for w in where)))
    if order_by:
        name, way = resolve(df, order_by[0]), order_by[1].upper()
        out = out.orderBy(F.asc_nulls_last(name) if way == "ASC" else F.desc_nulls_last(name))
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out if fields == "*" else out.select(*(resolve(df, f) for f in fields))


def total_size(result: DataFrame) -> DataFrame:
    return result.agg(F.count("*").alias("total_size"))


def record_envelope(df: DataFrame, kind: str, id: str, base: str = "/services/data/sobjects") -> DataFrame:
    """`df` with attributes {type, url} in front."""
    return df.select(F.struct(F.lit(kind).alias("type"), F.concat(F.lit(f"{base}/{kind}/"), F.col(id).cast("string")).alias("url")).alias("attributes"), *df.columns)


def result_index(df: DataFrame, id: str, *order: str) -> DataFrame:
    """(sequence_number, id) of the ordered rows, from 0, numbered by ranges: no task holds them all."""
    return numbered(df.select(id, *(c for c in order if c != id)), *order).select("sequence_number", id)


def page(index: DataFrame, size: int = PAGE_MAX, offset: int = 0) -> DataFrame:
    """A page of a result index, by position."""
    if not PAGE_MIN <= size <= PAGE_MAX:
        raise QueryError("INVALID_BATCH_SIZE", str(size))
    return index.where(F.col("sequence_number").between(offset, offset + size - 1))


def rehydrate(positions: DataFrame, df: DataFrame, id: str, fields: Sequence[str]) -> DataFrame:
    """The fields of indexed ids in their order; ids that no longer match are skipped."""
    return positions.join(df.select(*dict.fromkeys((id, *fields))), id).orderBy("sequence_number").select("sequence_number", *dict.fromkeys((id, *fields)))


def stable_sample(df: DataFrame, id: str, seed: str, n: int) -> DataFrame:
    """n rows by the order of a hash of id and seed."""
    return df.withColumn("_h", F.sha2(F.concat_ws(":", F.col(id).cast("string"), F.lit(seed)), 256)).orderBy("_h").limit(n).drop("_h")
