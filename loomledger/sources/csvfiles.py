"""CSV files of any length as records: quoted line breaks, doubled and stray quotes, CR, LF and CRLF, blank lines, read by ranges of bytes.

A line break ends a record unless a quoted value is open. Whether one is open at the start of a line depends on all lines before it, so each line is a function of two states (outside, inside a quoted value); most are the identity, a line with quotes may swap the states or lead to one of them. Their compositions are taken by a prefix scan: in each range of bytes by windows, then over the ranges of a file, a row each. No file is held, and a large one is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import staged

#: Characters of a record beyond which its file is an error: an open quote that nothing closes takes the rest of a file.
LONGEST = 1 << 24

_START, _BARE, _QUOTED, _CLOSED = 0, 1, 2, 3


def _after_quote(state: Column) -> Column:
    """The state after a quote: it opens a value at its start, closes a quoted one, doubled stands for itself, and is plain elsewhere."""
    return F.when(state == _START, _QUOTED).when(state == _QUOTED, _CLOSED).when(state == _CLOSED, _QUOTED).otherwise(_BARE)


def _after_text(state: Column, text: Column, delimiter: str) -> Column:
    """The state after text without quotes."""
    return F.when((state == _QUOTED) | (text == ""), state).when(text.endswith(delimiter), _START).otherwise(_BARE)


def _leaves_open(line: Column, state: int, delimiter: str) -> Column:
    """Whether a quoted value is open at the end of a line with quotes, begun in `state`."""
    pieces = F.split(line, '"', -1)
    last = F.size(pieces)
    walked = F.aggregate(F.slice(pieces, F.lit(1), last - 1), F.lit(state), lambda s, p: _after_quote(_after_text(s, p, delimiter)).cast("int"))
    return _after_text(walked, F.element_at(pieces, -1), delimiter) == _QUOTED


def fields(record: Column, delimiter: str = ",") -> Column:
    """The values of a record, unquoted. Without quotes it is split; with some it is walked from quote to quote."""
    cut = delimiter if delimiter.isalnum() or delimiter in ",;:\t " else f"\\{delimiter}" if len(delimiter) == 1 else f"\\Q{delimiter}\\E"  # one character needs no regular expression
    plain = F.split(record, F.lit(cut), -1)

    def text(acc: Column, p: Column) -> Column:
        parts = F.split(p, F.lit(f"\\Q{delimiter}\\E"), -1)
        n, own = F.size(parts), acc["own"]
        many = F.concat(acc["done"], F.array(F.concat(own, F.get(parts, F.lit(0)))), F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))))
        inside = (acc["state"] == _QUOTED) | (n == 1)
        return F.struct(
            _after_text(acc["state"], p, delimiter).cast("int").alias("state"),
            F.when(inside, F.concat(own, p)).otherwise(F.element_at(parts, -1)).alias("own"),
            F.when(inside, acc["done"]).otherwise(many).alias("done"),
        )

    def step(acc: Column, p: Column) -> Column:
        s = text(acc, p)
        mark = F.when(((acc["state"] == _CLOSED) & (p == "")) | (s["state"] == _BARE), F.concat(s["own"], F.lit('"'))).otherwise(s["own"])
        return F.struct(_after_quote(s["state"]).cast("int").alias("state"), mark.alias("own"), s["done"].alias("done"))

    pieces = F.split(record, '"', -1)
    zero = F.struct(F.lit(_START).alias("state"), F.lit("").alias("own"), F.array().cast("array<string>").alias("done"))
    walked = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), zero, step, lambda acc: acc)
    ended = text(walked, F.element_at(pieces, -1))
    return F.when(record.contains('"'), F.concat(ended["done"], F.array(ended["own"]))).otherwise(plain)


def _bare(text: Column) -> Column:
    """A line without the CR before its LF."""
    return F.when(text.endswith("\r"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def csv_records(spark: SparkSession, paths: str | list[str], delimiter: str = ",", longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(records, files) of CSV files. records: file, line_no from 0 (the header) in file order, line (the record's text, without its line end); blank lines aren't records. files: file, error (NULL, "no header" for one without or with a blank first line, "record too long").

    file is the file's path. A quote that nothing closes is closed by the end of the file.
    """
    raw = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # a CR that no LF follows ends a line, too
    parts = F.when(F.instr("value", "\r").between(F.lit(1), F.length("value") - 1), F.split("value", r"(?<=\r)(?!\z)", -1)).otherwise(F.array("value"))
    lines = raw.select("file", "block", "at", F.posexplode(parts).alias("part", "text"))
    quotes = F.col("text").contains('"')
    bare = _bare(F.col("text"))
    lines = lines.withColumns({"from_out": F.when(quotes, _leaves_open(bare, _START, delimiter)).otherwise(False), "from_in": F.when(quotes, _leaves_open(bare, _QUOTED, delimiter)).otherwise(True)})
    order = ("at", "part")
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out"))
    swap = (F.col("from_out") & ~F.col("from_in")).cast("int")
    by = Window.partitionBy("file", "block").orderBy(*order)
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    scanned = lines.withColumns({"fixed": fixed, "swap": swap, "blank": F.col("text").isin("", "\r")}).withColumn("swaps", F.sum("swap").over(upto))
    own = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "swaps"))
    scanned = scanned.withColumns({"known": F.last(own, True).over(before), "passed": F.col("swaps") - F.col("swap"), "first": F.first("blank").over(upto), "ends": F.lead("at").over(by).isNull()})

    def entered(known: Column, passed: Column, start: Column) -> Column:
        """The state at a place: that of the last line which leads to one state, or else `start`, after the swaps since."""
        odd = lambda n: n % 2 == 1
        return F.when(known.isNull(), start != odd(passed)).otherwise(known["fixed"] != odd(passed - known["swaps"]))

    # how many records begin up to a line, for either state at the start of its range
    begun = lambda start: F.sum((~entered(F.col("known"), F.col("passed"), F.lit(start)) & ~F.col("blank")).cast("long")).over(upto)
    scanned = staged(scanned.withColumns({"n_out": begun(False), "n_in": begun(True)}).drop("swap"))
    # a row for each range of bytes, its last line: what the range does to a state, and how many records begin in it
    blocks = scanned.where("ends")
    end = F.coalesce(own, "known")
    out = lambda start: entered(end, F.col("swaps"), F.lit(start))
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b_fixed, b_swap = F.when(F.col("o") == F.col("i"), F.col("o")), (F.col("o") & ~F.col("i")).cast("int")
    blocks = blocks.select("file", "block", "n_out", "n_in", "first", out(False).alias("o"), out(True).alias("i"))
    blocks = blocks.withColumns({"fixed": b_fixed, "swaps": F.sum(b_swap).over(whole.rowsBetween(Window.unboundedPreceding, 0)), "swap": b_swap})
    state = entered(F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "swaps")), True).over(whole), F.col("swaps") - F.col("swap"), F.lit(False))
    blocks = blocks.withColumn("inside", state)
    blocks = blocks.withColumn("shift", F.coalesce(F.sum(F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))).over(whole), F.lit(0)))
    heads = blocks.groupBy("file").agg(F.min_by("first", "block").alias("first"))

    placed = scanned.join(blocks.select("file", "block", "inside", "shift"), ["file", "block"])
    placed = placed.withColumn("open", entered(F.col("known"), F.col("passed"), F.col("inside")))
    placed = placed.withColumn("goes_on", F.when(F.col("open"), F.col("from_in")).otherwise(F.col("from_out")))
    placed = placed.withColumn("line_no", F.col("shift") + F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")) - 1).where("open or not blank")
    single = placed.where("not open and not goes_on").select("file", "line_no", _bare(F.col("text")).alias("line"))
    several = placed.where("open or goes_on")
    size = several.groupBy("file", "line_no").agg(F.sum(F.length("text") + 1).alias("n"))
    long = size.where(F.col("n") > longest).select("file").distinct()
    # a line keeps its CR; the LF between two lines went, unless a CR alone parted them
    piece = F.struct("block", *order, "text")
    glued = F.aggregate(F.array_sort(F.collect_list(piece)), F.struct(F.lit(-1).cast("long").alias("at"), F.lit("").alias("line")), lambda acc, x: F.struct(x["at"].alias("at"), F.concat(acc["line"], F.when((acc["at"] >= 0) & (acc["at"] != x["at"]), "\n").otherwise(""), x["text"]).alias("line")), lambda acc: acc["line"])
    joined = several.join(long, "file", "left_anti").groupBy("file", "line_no").agg(glued.alias("line")).withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    names = spark.read.format("binaryFile").load(paths).inputFiles()  # those of empty files, too, which no task reads; the driver has listed them all
    known = spark.createDataFrame([(n,) for n in names], "file_ string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = known.join(heads, plain("file_") == plain("file"), "left").join(long.withColumn("long", F.lit(True)), "file", "left")
    error = F.when(F.coalesce("first", F.lit(True)), "no header").when(F.col("long"), "record too long")
    return single.union(joined), files.select(F.coalesce("file", "file_").alias("file"), error.alias("error"))
