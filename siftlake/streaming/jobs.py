"""Streams of files, scans and events.

The transformations take and return streaming DataFrames; `run` and `run_each` start them with a
checkpoint folder of their own. Event times are instants (TIMESTAMP); use `as_instant` for log times
without a zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from siftlake.operators import classify, match, severity
from siftlake.operators.exceptions import PENDING_DAYS
from siftlake.operators.rules import Rule
from siftlake.session import let_go

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds between looks for a batch that has ended.
LOOK = 5
MONDAY = "4 days"  # the epoch was a Thursday


def as_instant(ts: Column) -> Column:
    """A zone-free time taken as UTC, whatever the session's zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def utc_text(ts: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), fmt)


def table_stream(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, per_trigger: int = 1000, per_bytes: int | None = None, used_up: bool = False
) -> DataFrame:
    """Stream of one parquet table of a folder (`name` is a file-name glob). A batch takes so many files, or bytes, one file at
    least: with bytes, what a batch exchanges doesn't grow with the table. Files that are used up are deleted once their batch is committed."""
    limit = ("maxBytesPerTrigger", per_bytes) if per_bytes else ("maxFilesPerTrigger", per_trigger)
    return spark.readStream.schema(schema).options(pathGlobFilter=name, cleanSource="delete" if used_up else "off").option(*limit).parquet(folder)


def log_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Stream of a JSON-lines log; rows of broken lines have only `corrupt_line`."""
    full = T.StructType(schema.fields + [T.StructField("corrupt_line", T.StringType())])
    parsed = spark.readStream.text(folder).select(
        F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_line"}).alias("r")
    )
    return parsed.select("r.*")


def scan_stream(files: DataFrame, rules: list[Rule], **kw) -> DataFrame:
    """Findings of a stream of changed files: stateless, the rule table is the static side."""
    return severity.apply_context(match.scan_files(classify.classify_files(files), rules, **kw))


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "1 hour", start: str | None = None) -> DataFrame:
    """Counts per event-time window; weeks begin on Monday with start=MONDAY."""
    w = F.window("ts", width, width, start) if start else F.window("ts", width)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical")
    )
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "critical")


def sliding(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Counts of two weeks, moving by one week; neighbours two steps apart do not overlap."""
    w = F.window("ts", "14 days", "7 days", MONDAY)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("total"))
    return g.select(F.col("w.start").alias("start"), "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per user, closed after `gap` without an event."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "git_user").agg(
        F.count(F.lit(1)).alias("events")
    )
    return g.select("git_user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def dedupe(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Drop re-deliveries of the same keys that arrive within the delay; state is evicted after it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available, append to a parquet table and read that back. What a batch has exchanged is deleted soon after it."""
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("compression", "zstd")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    ended = None
    while not q.awaitTermination(LOOK):
        batch = q.lastProgress and q.lastProgress["batchId"]
        if batch != ended:
            let_go(stream.sparkSession)
        ended = batch
    let_go(stream.sparkSession)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_each(stream: DataFrame, handle, checkpoint: str) -> None:
    """Process everything available, giving each micro-batch (DataFrame, batch id) to `handle`."""
    q = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def late_router(root: str, limit: str):
    """Handler that keeps rows apart which are older than `limit` before the newest row of all earlier batches.

    The newest time is the query's own progress: each batch leaves it as a row beside its output, under the batch's number.
    A batch is read once, for rows and newest time alike, and is overwritten if it is repeated, so it counts once. See `routed`.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = newest_before(spark, root, batch_id)
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        late = F.lit(False) if before is None else F.coalesce(F.timestamp_micros(micros) < F.timestamp_micros(F.lit(before)) - F.expr(f"INTERVAL {limit}"), F.lit(False))
        seen = Observation()
        marked = batch.withColumn("late", late).observe(seen, F.max(micros).alias("newest"))
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{root}/rows/batch={batch_id}")
        newest = max((t for t in (before, seen.get["newest"]) if t is not None), default=None)
        spark.createDataFrame([(newest,)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{root}/progress/batch={batch_id}")

    return handle


def newest_before(spark: SparkSession, root: str, batch_id: int) -> int | None:
    """Newest event time, in microseconds, of the batches before this one."""
    if batch_id == 0:
        return None
    return spark.read.schema("newest long").parquet(f"{root}/progress/batch={batch_id - 1}").first()[0]


def routed(spark: SparkSession, root: str) -> DataFrame:
    """All rows that a late router has kept, with `late` and `batch`."""
    rows = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    return rows.withColumn("late", F.col("late").cast("boolean"))


def expiries(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """events(id, status, ts) -> (id, expired_ms) of exceptions left pending for 14 days.

    An outer join of two streams: a pending event waits, at most for the period, for any decision of its exception; it is given
    out once both watermarks say that none can come. A decision at or after the deadline is no decision in time.
    """
    period = F.expr(f"INTERVAL {24 * PENDING_DAYS} HOURS")

    def of_kind(wanted: Column) -> DataFrame:
        # the test names the event time, so that it stays above the watermark and every event moves both watermarks on
        return events.withWatermark("ts", delay).where(F.coalesce(F.when(F.col("ts").isNotNull(), wanted), F.lit(False)))

    pending = of_kind(F.col("status") == "pending").select("id", "ts")
    decided = of_kind(F.col("status") != "pending").select(F.col("id").alias("decided_id"), F.col("ts").alias("decided_at"))
    in_time = (F.col("id") == F.col("decided_id")) & (F.col("decided_at") >= F.col("ts")) & (F.col("decided_at") < F.col("ts") + period)
    left = pending.join(decided, in_time, "left_outer").where(F.col("decided_id").isNull())
    return left.select("id", F.unix_millis(F.col("ts") + period).alias("expired_ms"))
