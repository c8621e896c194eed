"""Scans of catalogued objects, validated CSV ingest, CSV export in parts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import generated_record_id, strict_boolean
from .csvfiles import csv_records, fields
from .exports import InvalidLocator, export_page, export_parts, export_window, exported, matched, part_page  # noqa: F401
from .staging import staged


@dataclass(frozen=True)
class ObjectSpec:
    """A catalogued object: where its files are, its id, flag, version and aliases."""

    name: str
    paths: tuple[str, ...]
    schema: str
    id: str = "Id"
    deleted: str | None = None
    version: str | None = None
    deltas: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    format: str = "parquet"


def scan_object(spark: SparkSession, spec: ObjectSpec) -> DataFrame:
    """All files of an object, columns by name; declared and empty without files; newest versions if it has deltas. The storage partition isn't a field."""
    from ..operators.versions import alias_columns, latest_version

    schema = spark.createDataFrame([], spec.schema).schema
    paths = [f for p in (*spec.paths, *spec.deltas) for f in matched(spark, p)]
    if not paths:
        df = spark.createDataFrame([], schema)
    elif spec.format == "csv":  # each file has a header of its own: columns go by name
        files = [spark.read.option("header", True).option("enforceSchema", False).csv(p) for p in paths]
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), files)
        df = whole.select(*((F.col(f.name).cast(f.dataType) if f.name in whole.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema), *(c for c in whole.columns if c not in schema.names and c != "business_date"))
    else:
        df = spark.read.option("mergeSchema", True).parquet(*paths)
    df = alias_columns(df.drop("business_date"), spec.aliases)
    return latest_version(df, spec.id, spec.version) if spec.deltas and spec.version else df


def snapshot_fingerprint(df: DataFrame) -> DataFrame:
    """(snapshot), one row: the root of a hash tree over the files (path, size, time) that a scan reads, with its schema. Reads footers only; no row holds all names."""
    from ..operators.hashtree import root_digest

    files = df.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("t")).distinct()
    return root_digest(files, "file_path").select(F.sha2(F.concat_ws("\n", "digest", F.lit(df.schema.simpleString())), 256).alias("snapshot"))


def csv_lines(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",") -> DataFrame:
    """A CSV file with all values as text, row_number from 1 in file order, and surplus: whether a row has more values than the header (short rows are padded)."""
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(schema).option("header", True).option("sep", delimiter).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    # Spark won't read the corrupt text alone: the first column goes along
    line = F.concat("_corrupt", F.coalesce(F.substring(columns[0], 1, 0), F.lit("")))
    tokens = F.size(F.split(line, f'\\Q{delimiter}\\E(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
    raw = raw.withColumn("surplus", F.coalesce(tokens > len(columns), F.lit(False))).drop("_corrupt").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    before = raw.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = F.shiftleft(F.col("_part").cast("long"), 33)
    return raw.join(F.broadcast(before), "_part").withColumn("row_number", F.col("_at") - base + F.col("_shift") + 1).drop("_at", "_part", "_n", "_shift")


# Forms of values, as fixed texts: whole numbers, numbers, dates, times with an optional offset.
_WHOLE = r"^\s*[+-]?[0-9]++(?:_[0-9]++)*+\s*$"
_NUMBER = r"(?i)^\s*[+-]?(?:(?:[0-9]++(?:_[0-9]++)*+\.?(?:[0-9]++(?:_[0-9]++)*+)?|\.[0-9]++(?:_[0-9]++)*+)(?:e[+-]?[0-9]++)?|inf(?:inity)?|nan)\s*$"
_DATE = r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})$"
_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:.([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?)?(?:Z|([+-])([0-9]{2}):?([0-9]{2})(?::?([0-9]{2}))?)?)?$"


def _of_groups(text: Column, pattern: str, n: int, value) -> Column:  # noqa: ANN001
    """`value` of the array of groups of a pattern, taken once; NULL where it doesn't match."""
    groups = F.array(*(F.regexp_extract(text, pattern, k) for k in range(1, n + 1)))
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(groups), value), F.lit(0)))


def _date(text: Column) -> Column:
    whole = (F.length(text) == 8) | text.rlike("^.{4}-.{2}-")
    return F.when(whole, _of_groups(text, _DATE, 3, lambda g: F.array_join(g, "-").try_cast("date")))


def _timestamp(text: Column) -> Column:
    def value(g: Column) -> Column:
        part = lambda k: F.get(g, F.lit(k - 1))
        number = lambda k: F.coalesce(part(k).try_cast("int"), F.lit(0))
        local = F.concat(part(1), F.lit(" "), *(x for k, end in ((2, ":"), (3, ":"), (4, ".")) for x in (F.lpad(part(k), 2, "0"), F.lit(end))), F.rpad(F.left(part(5), F.lit(6)), 6, F.lit("0"))).try_cast("timestamp_ntz")
        ahead = F.make_dt_interval(F.lit(0), number(7), number(8), number(9).cast("decimal(18,6)"))
        good = (number(2) < 24) & (number(7) < 24) & (number(8) < 60) & (number(9) < 60)
        return F.when(good, F.when(part(6) == "-", local + ahead).otherwise(local - ahead))

    return _of_groups(text, _TIME, 9, value)


def coerce(text: Column, kind: str) -> Column:
    """A text as a value: boolean, bigint, double, date, timestamp or string; NULL if empty or malformed.

    Numbers may have blanks around and single underscores between digits. Dates are whole: 2024-01-05 or 20240105. Times are a date, alone or with hours, minutes, seconds and a fraction (digits beyond six are cut), and with Z or an offset, which is taken off: the value is in UTC.
    """
    text = F.when(text != "", text)
    if kind == "boolean":
        return strict_boolean(text)
    if kind == "date":
        return _date(text)
    if kind == "timestamp":
        return _timestamp(text)
    if kind in ("bigint", "int", "double", "float"):
        return F.when(text.rlike(_WHOLE if kind in ("bigint", "int") else _NUMBER), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast(kind))
    return text if kind == "string" else text.try_cast(kind)


def csv_ingest(rows: DataFrame, kinds: dict[str, str], existing: DataFrame | None, id: str = "Id", job: str = "job", row: str = "row_number", deleted: str = "IsDeleted", first_wins: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of rows of text values. An empty value is NULL, an empty flag of deletion false, a missing id generated; the first field that can't be read, and ids that repeat or exist, reject the row alone."""
    values = rows.select(row, *kinds, *(coerce(F.col(c), k).alias(f"_{c}") for c, k in kinds.items()))
    bad = F.coalesce(*(F.when((F.col(c) != "") & F.col(f"_{c}").isNull(), F.lit(f"{c}: invalid {k}")) for c, k in kinds.items()), F.lit(None).cast("string"))
    typed = values.select(row, bad.alias("error"), *(F.coalesce(f"_{c}", F.lit(False)).alias(c) if c == deleted else F.col(f"_{c}").alias(c) for c in kinds))
    typed = typed.withColumn(id, F.coalesce(F.col(id), generated_record_id(job, F.col(row))))
    again = F.row_number().over(Window.partitionBy(id).orderBy(row)) > 1 if first_wins else F.count("*").over(Window.partitionBy(id)) > 1
    good = typed.where("error is null").withColumn("again", again)
    if existing is not None:
        good = good.join(existing.select(F.col(id), F.lit(True).alias("there")).distinct(), id, "left").withColumn("again", F.col("again") | F.coalesce("there", F.lit(False))).drop("there")
    accepted = good.where("not again").select(row, *kinds)
    failed = typed.where("error is not null").select(row, "error").union(good.where("again").select(row, F.lit("DUPLICATE_VALUE: Id already exists").alias("error")))
    return accepted, rows.join(failed, row).select(row, "error", *kinds)


def record_offsets(parts: DataFrame, order: str, records: str = "records") -> DataFrame:
    """Parts with start_record and end_record, by their sizes and order."""
    end = F.sum(records).over(Window.orderBy(order))  # a row per part
    return parts.withColumn("start_record", end - F.col(records)).withColumn("end_record", end)


def _claim(spark: SparkSession, path: str, mark: str) -> str:
    """The mark of who came first to a file: one writer creates it, the others read it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).getLen():
        try:
            out = fs.create(where, fs.exists(where))  # an empty one was left by a writer that died
            out.writeBytes(mark)
            out.close()
        except Exception as error:  # another writer was faster
            if not fs.exists(where):
                raise error
    return spark.read.text(path).first()[0]


def publish_deltas(df: DataFrame, root: str, date: str = "business_date", event_id: str = "event_id") -> DataFrame:
    """(date, published): writes the partitions of all dates of `df` in one job, each once. Dates that have the same events already are a no-op (false); others for a published or claimed date are an error, before anything is written.

    A date is claimed by a file with the mark of its events before it is written, so of two writers with different events one fails; a partition appears whole.
    """
    spark = df.sparkSession
    # ids are counted and their hashes added up in parts: no row holds them all
    own = df.select(F.col(date).cast("string").alias("d"), F.col(event_id).cast("string").alias("e")).distinct().groupBy("d")
    marks = {r["d"]: f"{r['n']}:{r['h']}:{r['c']}" for r in own.agg(F.count("*").alias("n"), F.sum(F.xxhash64("e").cast("decimal(38,0)")).alias("h"), F.sum(F.crc32("e")).alias("c")).collect()}  # a row for each date
    if None in marks:
        raise ValueError(f"events without a {date}")
    there = {d for d in marks if matched(spark, f"{root}/{date}={d}")}
    if other := sorted(d for d, mark in marks.items() if _claim(spark, f"{root}/_claims/{d}", mark) != mark):
        raise ValueError(f"published with other events: {', '.join(other)}")
    new = sorted(set(marks) - there)
    if new:
        rows = df.where(F.col(date).cast("string").isin(new)).withColumn(date, F.col(date).cast("string"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(root)
    return spark.createDataFrame([(d, d in new) for d in sorted(marks)], f"{date} string, published boolean")


def publish_delta(df: DataFrame, root: str, business_date: str, event_id: str = "event_id") -> bool:
    """`publish_deltas` of one date; whether it was new."""
    told = publish_deltas(df.withColumn("business_date", F.lit(business_date)), root, event_id=event_id).first()
    return bool(told and told["published"])


def deferred_full_copy(spark: SparkSession, spec: ObjectSpec, path: str) -> DataFrame:
    """The mutable table of an object: a copy of its seed made once, at first use; an id that repeats is an error."""
    if not matched(spark, f"{path}/_SUCCESS"):
        seed = scan_object(spark, spec)
        if not seed.groupBy(spec.id).count().where("count > 1").isEmpty():
            raise ValueError(f"{spec.name} has repeated ids")
        seed.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def parse_lines(lines: DataFrame, columns: list[str], delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, files) of records as texts (file, line_no, line), line 0 being a file's header; quoted values may hold line breaks.

    A file whose header has an empty or unknown name, or one of whose rows has more values than it, is rejected whole; short rows are padded with NULL; blank records are none. Of a name that a header repeats, the last column counts. rows: file, row_number and the columns as text, of accepted files; files: file, rows, error (NULL if accepted).
    """
    return _checked(_cut(lines, delimiter), columns)


def _cut(lines: DataFrame, delimiter: str) -> DataFrame:
    return lines.where("line != '' or line_no = 0").select("file", "line_no", fields(F.col("line"), delimiter).alias("values"))


def _checked(cut: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    heads = cut.where("line_no = 0").select("file", F.col("values").alias("names"))
    body = cut.where("line_no > 0").join(heads, "file")
    files = body.groupBy("file", "names").agg(F.count("*").alias("rows"), F.max(F.size("values") > F.size("names")).alias("wide")).join(heads, ["file", "names"], "right")
    error = F.when(F.array_contains("names", ""), "empty column name").when(F.size(F.array_except("names", F.array(*map(F.lit, columns)))) > 0, "unknown column").when(F.col("wide"), "too many values")
    files = files.select("file", F.coalesce("rows", F.lit(0)).alias("rows"), error.alias("error"))
    good = body.join(files.where("error is null").select("file"), "file", "left_semi")
    place = lambda c: F.size("names") - F.array_position(F.reverse("names"), F.lit(c))
    value = lambda c: F.get(F.col("values"), place(c).cast("int"))
    return good.select("file", F.col("line_no").alias("row_number"), *(F.when(F.array_contains("names", c), value(c)).alias(c) for c in columns)), files


def read_uploads(spark: SparkSession, paths: str | list[str], columns: list[str], delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """`parse_lines` of CSV files of any length, which are split; file is a file's path, and files without a header or with a record beyond all bounds are rejected, too."""
    records, found = csv_records(spark, paths, delimiter)
    bad = found.where("error is not null")
    rows, files = _checked(staged(_cut(records.join(bad.select("file"), "file", "left_anti"), delimiter)), columns)
    return rows, files.unionByName(bad.select("file", F.lit(0).cast("long").alias("rows"), "error"))
