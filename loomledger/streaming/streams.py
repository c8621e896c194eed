"""Incremental forms: file streams of deltas, de-duplication, current state, usage windows, SLA joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.exports import matched
from ..sources.staging import remove


def run_out(query) -> None:
    """Waits until a query over what is there now ends; its failure is raised."""
    query.awaitTermination()


def stream_deltas(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New files under a path; partition columns that the schema lacks aren't fields."""
    out = spark.readStream.schema(schema).parquet(path)
    return out.select(*schema.names)


def stream_dedup(events: DataFrame, ts: str, delay: str, *keys: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_usage(events: DataFrame, ts: str, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Events per window of time.

    Sliding windows (whose width is a multiple of the slide) are sums of panes as long as the slide: an event is counted once, in its pane, and only counts of panes go to the windows that they lie in.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    pane = timed.groupBy(F.window(ts, slide or width).alias("w")).agg(F.count("*").alias("n"))
    if slide:
        pane = pane.groupBy(F.window(F.window_time("w"), width, slide).alias("w")).agg(F.sum("n").alias("n"))
    return pane.select("w.start", "w.end", "n")


def stream_sla(up: DataFrame, down: DataFrame, key: str, up_ts: str, down_ts: str, days: int, delay: str = "1 day") -> DataFrame:
    """Upstream events with the downstream event inside the SLA, or NULL when it didn't come: a breach."""
    u = up.select(F.col(key), F.col(up_ts).cast("timestamp").alias("up_at")).withWatermark("up_at", delay)
    d = down.select(F.col(key).alias("down_key"), F.col(down_ts).cast("timestamp").alias("down_at")).withWatermark("down_at", delay)
    return u.join(d, F.expr(f"{key} = down_key and down_at >= up_at and down_at <= up_at + interval {days} days"), "leftOuter").select(key, "up_at", "down_at", F.col("down_at").isNull().alias("breached"))


def _latest(df: DataFrame, id: str, *order: str) -> DataFrame:
    return df.groupBy(id).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("row.*")


def stream_current(events: DataFrame, root: str, checkpoint: str, id: str, *order: str, keep: int = 16):
    """Keeps the latest row of each id, in Spark's state store: one row an id, whose clock is `order`, so late and replayed events change nothing.

    A batch writes the rows of the ids that it met, under its number; a batch that runs again writes the same again. Every `keep` batches they are folded into one base and removed: what lies below `root` grows with the ids and `keep`, not with the batches. `read_current` has the state.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/changes={number}")
        if (number + 1) % keep == 0:
            base, paths, old = _written(spark, root, number)
            if base < number:
                _latest(spark.read.parquet(*paths), id, *order).write.mode("overwrite").parquet(f"{root}/base={number}")
            for path in (*old, *(p for p in paths if not p.endswith(f"/base={number}"))):
                remove(spark, path)

    return _latest(events, id, *order).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, root: str, last: int | None = None) -> tuple[int, list[str], list[str]]:
    """The number of the newest base (-1: none), it and what changed since, and what a base has taken in."""
    number = lambda p: int(p.rpartition("=")[2])
    bases = {number(p.rpartition("/")[0]): p.rpartition("/")[0] for p in matched(spark, f"{root}/base=*/_SUCCESS")}
    base = max(bases, default=-1)
    changes = {number(p): p for p in matched(spark, f"{root}/changes=*") if last is None or number(p) <= last}
    old = [p for n, p in bases.items() if n < base] + [p for n, p in changes.items() if n <= base]
    return base, [*([bases[base]] if bases else []), *(p for n, p in changes.items() if n > base)], old


def read_current(spark: SparkSession, root: str, id: str, *order: str) -> DataFrame:
    """The state that `stream_current` keeps: its base and at most as many batches as it keeps."""
    return _latest(spark.read.parquet(*_written(spark, root)[1]), id, *order)


def stream_late(events: DataFrame, checkpoint: str, sink: str):
    """Counts rows that became available after their business date, by batch."""

    def count(batch: DataFrame, number: int) -> None:
        batch.where("available_on > business_date").groupBy("business_date").agg(F.count("*").alias("late")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return events.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
