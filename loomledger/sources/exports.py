"""CSV exports in parts of a fixed number of records, each written, digested and logged by one task.

A record's part is its place in the whole order divided by the part's size, so all parts but the last have as many records, whatever tasks wrote them. A task writes its parts and one file of the log, which has a line for each of them: number, records, bytes and SHA-256, taken while the lines passed. Tasks publish what they have written when they end (not when the job ends): after a crash the parts that are logged, and as long as their log says, stay, and a resumed export writes the others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import dealt, numbered, remove

#: Values are written as they are; NULL is nothing between delimiters, an empty text two quotes.
_WRITE = {"escape": '"', "nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_READ = {"header": "true", "escape": '"', "multiLine": "true", "nullValue": "\u0001", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_LOGGED = "part long, records long, bytes long, sha256 string"


class InvalidLocator(ValueError):
    """A place in an export that isn't there."""


def matched(spark: SparkSession, pattern: str) -> list[str]:
    """The files and folders that a glob names, in any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [str(s.getPath()) for s in found or []]


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Scans made in it list folders by a few tasks for each core. By default every folder, and there is one for each part, has a task of its own."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _part(c: str):  # noqa: ANN202
    return F.regexp_extract(c, "part=([0-9]+)", 1).cast("long")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files of all parts; their contents aren't read."""
    with _listing(spark):
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/kind=data").select("path", "length")


def _committed(spark: SparkSession, path: str) -> DataFrame:
    """(part, path, records, bytes, sha256) of the parts that are whole: logged, and one file as long as the log says."""
    if not all(matched(spark, f"{path}/kind={k}") for k in ("data", "log")):
        return spark.createDataFrame([], f"path string, {_LOGGED}").select("part", "path", "records", "bytes", "sha256")
    files = _files(spark, path).groupBy(_part("path").alias("part")).agg(F.count("*").alias("files"), F.min("path").alias("path"), F.min("length").alias("length"))
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{path}/kind=log")  # a file for each task
    logged = lines.select(F.from_json("value", _LOGGED).alias("x")).groupBy("x.part").agg(F.max("x").alias("x"))
    return files.join(logged, "part").where("files = 1 and length = x.bytes").select("part", "path", "x.records", "x.bytes", "x.sha256")


def _written(batches: Iterator[pa.RecordBatch], header: str, run: int) -> Iterator[pa.RecordBatch]:
    """The lines of a part after its header, one text for those that a batch has, and its line for the log of the run; parts come one after the other."""
    part, records, size, digest = None, 0, 0, hashlib.sha256()

    def logged() -> tuple[str, int, int, str]:
        return "log", run, part, json.dumps({"part": part, "records": records, "bytes": size, "sha256": digest.hexdigest()})

    for batch in batches:
        out, parts = [], batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)] if len(parts) else []
        for a, b in pairwise(edges):
            if parts[a] != part:
                if part is not None:
                    out.append(logged())
                first = f"{header}\n".encode()
                part, records, size, digest = int(parts[a]), 0, len(first), hashlib.sha256(first)
                out.append(("data", part, -1, header))
            text = "\n".join(batch.column("line").slice(a, b - a).to_pylist())
            raw = f"{text}\n".encode()
            digest.update(raw)
            records, size = records + b - a, size + len(raw)
            out.append(("data", part, batch.column("at")[a].as_py(), text))
        yield _rows(out)
    if part is not None:
        yield _rows([logged()])


def _rows(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["kind", "part", "at", "line"])


def export_parts(df: DataFrame, path: str, order: list[str], rows_per_part: int = 100_000, resume: bool = False) -> DataFrame:
    """Writes ordered CSV parts of exactly `rows_per_part` records (the last has what is left), with headers, and gives the manifest: part, path, start_record, end_record (exclusive), records, bytes, sha256.

    `order` must be total. A rerun replaces what is there; with `resume` it keeps the parts that are committed and have the records that they should, and writes the others. Of one column alone, NULL and an empty text are both written as two quotes. An empty table has no parts.
    """
    spark = df.sparkSession
    if not resume:
        remove(spark, path)
    placed = numbered(df, *order, name="_place").withColumn("part", F.floor(F.col("_place") / rows_per_part).cast("long"))
    run = 0
    if resume:
        logs = matched(spark, f"{path}/kind=log/part=*")
        run = 1 + max((int(n) for n in (p.rpartition("part=")[2] for p in logs) if n.isdigit()), default=-1)
        want = placed.groupBy("part").agg(F.count("*").alias("want"))
        done = _committed(spark, path).join(want, "part").where("records = want")
        # the log goes on with the lines of these parts alone: an older line of a part must not tell of its next file
        now = f"{path}/kind=log/part={run}"
        done.select(F.to_json(F.struct("part", "records", "bytes", "sha256")).alias("value"), "part").repartition("part").select("value").write.text(now)
        told = spark.read.text(now).select(F.from_json("value", _LOGGED)["part"].alias("part"))
        kept = {r["part"] for r in told.collect()}  # a number for each part
        # what an interrupted run left
        lost = [p for p in matched(spark, f"{path}/kind=data/part=*") if not (n := p.rpartition("part=")[2]).isdigit() or int(n) not in kept]
        for p in (*lost, *logs, *matched(spark, f"{path}/_temporary")):
            remove(spark, p)
        placed = placed.join(F.broadcast(told), "part", "left_anti")
    names = [f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ',"\n\r') else c for c in df.columns]
    line = F.to_csv(F.struct(*df.columns), _WRITE)
    if len(df.columns) == 1:
        line = F.when(line == "", '""').otherwise(line)
    lines = dealt(placed.select("part", F.col("_place").alias("at"), line.alias("line")), "part").sortWithinPartitions("part", "at")
    out = lines.mapInArrow(lambda batches: _written(batches, ",".join(names), run), "kind string, part long, at long, line string").sortWithinPartitions("kind", "part", "at")
    out.select("line", "kind", "part").write.mode("append").partitionBy("kind", "part").option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("lineSep", "\n").text(path)
    start = F.col("part") * rows_per_part
    return _committed(spark, path).select("part", "path", start.alias("start_record"), (start + F.col("records")).alias("end_record"), "records", "bytes", "sha256")


def exported(spark: SparkSession, path: str) -> DataFrame:
    """All records of an export, as text; an empty text isn't NULL."""
    one = _files(spark, path).first()
    if one is None:
        raise FileNotFoundError(f"{path} has no parts")
    names = spark.read.options(**_READ).csv(one["path"]).schema  # all parts have the same header
    with _listing(spark):
        return spark.read.schema(names).options(**_READ, recursiveFileLookup="true").csv(f"{path}/kind=data")


def export_window(spark: SparkSession, manifest: DataFrame, offset: int, n: int) -> tuple[DataFrame, int | None]:
    """Records [offset, offset + n) of an export with their record numbers, and the offset of the next window (None at the end). An offset that no record has, or a size below 1, is an error. Only the parts that hold them are read, in one scan."""
    total = manifest.agg(F.max("end_record")).first()[0] or 0
    if n <= 0:
        raise InvalidLocator(f"a window of {n} records")
    if not 0 <= offset < total:
        raise InvalidLocator(f"{offset} isn't one of {total} records")
    parts = manifest.where((F.col("end_record") > offset) & (F.col("start_record") < offset + n)).select("part", "path", "start_record").collect()  # as many as the window has
    starts = spark.createDataFrame([(p["part"], p["start_record"]) for p in parts], "_part long, _start long")
    rows = spark.read.options(**_READ).csv([p["path"] for p in parts])
    names = rows.columns
    # a file with quoted line ends isn't split: its rows are numbered in order
    rows = rows.withColumns({"_part": _part("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    out = rows.withColumn("_place", place).join(F.broadcast(starts), "_part").select(*names, (F.col("_place") + F.col("_start")).alias("record"))
    return out.where(F.col("record").between(offset, offset + n - 1)), (offset + n if offset + n < total else None)


def export_page(spark: SparkSession, manifest: DataFrame, locator: str | None, n: int) -> tuple[DataFrame, str | None]:
    """`export_window` by locators, `r:<offset>`; None is the beginning, and what the last page gives."""
    if locator is not None and not (locator.startswith("r:") and locator[2:].isdecimal()):
        raise InvalidLocator(locator)
    rows, after = export_window(spark, manifest, int(locator[2:]) if locator else 0, n)
    return rows, None if after is None else f"r:{after}"


def part_page(manifest: DataFrame, locator: str | None) -> tuple[str, int, str | None]:
    """(path, records, next locator) of a whole part, by its number."""
    if locator is not None and not locator.isdecimal():
        raise InvalidLocator(locator)
    part = int(locator or 0)
    rows = {r["part"]: r for r in manifest.where(F.col("part").between(part, part + 1)).collect()}
    if part not in rows:
        raise InvalidLocator(locator)
    return rows[part]["path"], rows[part]["records"], str(part + 1) if part + 1 in rows else None
