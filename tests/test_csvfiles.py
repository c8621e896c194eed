"""CSV files split anywhere against Python's reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from loomledger.sources import csvfiles


def read_by_python(path, delimiter):
    with open(path, encoding="utf-8", newline="") as f:
        return [r for r in csv.reader(f, delimiter=delimiter) if r]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def some(r, delimiter, quoted):
    parts = ["a", "é", "bb ", delimiter, delimiter, "\n", "\r\n", "\n\n", "\r"]
    parts += ['"', '"', '""', f'"x{delimiter}\ny"', f'{delimiter}"q\r\nr""s"{delimiter}', '"open'] if quoted else []
    body = "".join(r.choice(parts) for _ in range(r.randint(0, 120)))
    return f"h1{delimiter}h2\n" + body


@pytest.mark.parametrize("bytes_,delimiter,n", [(15, ",", 3), (100, "|", 6), (1 << 20, ",", 40)])
def test_records_of_any_split(spark, tmp_path, bytes_, delimiter, n):
    r = random.Random(bytes_)
    want = {}
    for k in range(n):
        path = tmp_path / f"in/f{k}.csv"
        write(path, some(r, delimiter, k % 4))
        want[f"f{k}.csv"] = read_by_python(path, delimiter)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        records, files = csvfiles.csv_records(spark, f"{tmp_path}/in", delimiter)
        got: dict = {}
        for x in records.select(F.regexp_extract("file", "[^/]+$", 0).alias("f"), "line_no", csvfiles.fields(F.col("line"), delimiter).alias("v")).orderBy("f", "line_no").collect():
            assert x["line_no"] == len(got.setdefault(x["f"], []))
            got[x["f"]].append(x["v"])
        assert files.where("error is null").count() == n
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert got == want


def test_files_without_header_and_long_records(spark, tmp_path):
    for name, text in (("empty", ""), ("blank", "\nId\n1\n"), ("cr", "\r\nId\n1\n"), ("good", "Id\r\n1\r\n"), ("open", 'Id\n"' + "x\n" * 200), ("bom", "Id")):
        write(tmp_path / f"in/{name}.csv", text)
    records, files = csvfiles.csv_records(spark, f"{tmp_path}/in", longest=100)
    errors = {x["f"]: x["error"] for x in files.select(F.regexp_extract("file", "([a-z]+).csv$", 1).alias("f"), "error").collect()}
    assert errors == {"empty": "no header", "blank": "no header", "cr": "no header", "good": None, "open": "record too long", "bom": None}
    assert sorted(x["line"] for x in records.where("file like '%good%' or file like '%bom%'").collect()) == ["1", "Id", "Id"]


def test_values(spark):
    from datetime import UTC, date, datetime

    from loomledger.sources.exchange import coerce

    def by(read, text):
        try:
            return read(text)
        except ValueError:
            return None

    def moment(text):
        x = datetime.fromisoformat(text.replace("Z", "+00:00"))
        return x.astimezone(UTC).replace(tzinfo=None) if x.tzinfo else x

    times = ["2024", "2024-01", "2024-01-05", "2024-01-05T10:00:00", "2024-01-05T10:00:00Z", "2024-01-05 10:00:00+05:00", "2024-01-05T10:00:00-0530", "2024-01-05T10", "2024-01-05T10:30", "2024-01-05T10:30:15.1234567", "2024-01-05T24:00:00", "2024-02-30", "2024-01-05T10:00:00+05:00:30", "2024-01-05T10:00:00+24:00", "x", "2024-1-5", "2024-01-05T10:61"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").select("t", coerce(F.col("t"), "timestamp").alias("at"), coerce(F.col("t"), "date").alias("day")).collect()
    assert [(r["at"], r["day"]) for r in rows] == [(by(moment, t), by(date.fromisoformat, t)) for t in times]
    numbers = ["1", " 12 ", "+5", "-7", "1_000", "1__0", "12.5", "1e5", "1d", "0x10", "inf", "-Infinity", ".5", "5.", "1_0.5_1", "e5", "1e400", "\t3\n"]
    rows = spark.createDataFrame([(t,) for t in numbers], "t string").select("t", coerce(F.col("t"), "bigint").alias("n"), coerce(F.col("t"), "double").alias("x")).collect()
    assert [(r["n"], r["x"]) for r in rows] == [(by(int, t), by(float, t)) for t in numbers]


def test_uploads(spark, tmp_path):
    from loomledger.sources.exchange import read_uploads

    for name, text in (("a", 'Id,Name,Id\n1,"x\ny",2\n\n3,\n'), ("b", "Id,Nope\n1,2\n"), ("c", "Id\n1,2\n"), ("d", "\nId\n1\n"), ("e", "Id,\n1,2\n"), ("f", "Id,Name\n")):
        write(tmp_path / f"in/{name}.csv", text)
    rows, files = read_uploads(spark, f"{tmp_path}/in", ["Id", "Name"])
    name = F.regexp_extract("file", "([a-z]).csv$", 1)
    assert [tuple(r) for r in rows.select(name, "row_number", "Id", "Name").orderBy("row_number").collect()] == [("a", 1, "2", "x\ny"), ("a", 2, None, "")]
    assert {r[0]: (r[1], r[2]) for r in files.select(name, "rows", "error").collect()} == {"a": (2, None), "b": (1, "unknown column"), "c": (1, "too many values"), "d": (0, "no header"), "e": (1, "empty column name"), "f": (0, None)}


def test_lines_are_scanned_once(spark, tmp_path, monkeypatch):
    """Lines are sorted into their ranges of bytes and written once; places come from what that scan left."""
    from loomledger.sources import csvfiles

    calls = []
    monkeypatch.setattr(csvfiles, "staged", lambda df, own=csvfiles.staged: calls.append(1) or own(df))
    (tmp_path / "a.csv").write_bytes(b'Id,At\n1,"x\ny"\n\n2,z\r\n')
    records, _ = csvfiles.csv_records(spark, f"{tmp_path}/*.csv")
    assert sorted((r["line_no"], r["line"]) for r in records.collect()) == [(0, "Id,At"), (1, '1,"x\ny"'), (2, "2,z")] and len(calls) == 1
