"""Delivery queue: staleness, batches, outcome of deliveries, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.functions.exprs import map_literal

# Fixed values.
STALE_ATTEMPTS, STALE_DAYS, GRACE_DAYS = 10, 30, 7
STATUS_RANK = {"rejected": 6, "auth_failed": 5, "license_invalid": 4, "error": 3, "unreachable": 2, "sent": 1, "empty": 0}
BATCH_ROWS = 500


def _age_over(ts: Column, as_of: str, days: int) -> Column:
    return ts < F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")


def stale_reason(attempts: Column, ts: Column, as_of: str) -> Column:
    many, old = attempts >= STALE_ATTEMPTS, _age_over(ts, as_of, STALE_DAYS)
    return F.when(many & old, "both").when(many, "attempts").when(old, "age")


def with_staleness(queue: DataFrame, as_of: str) -> DataFrame:
    """Add `reason` (null when fresh), `stale` and `auth_blocked`."""
    reason = stale_reason(F.col("attempts"), F.col("ts"), as_of)
    return queue.withColumns(
        {"reason": reason, "stale": reason.isNotNull(), "auth_blocked": F.coalesce(F.col("last_error") == "auth", F.lit(False))}
    )


def batches(queue: DataFrame, as_of: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Fresh entries per repository, cut into parts of about `rows` entries: (repo_id, part, n, entries)."""
    fresh = with_staleness(queue, as_of).where(~F.col("stale") & F.col("repo_id").isNotNull())
    sizes = fresh.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_parts"))
    parts = fresh.join(sizes, "repo_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    return parts.groupBy("repo_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("seq", "id", "payload"))).alias("entries")
    )


def unattributed(queue: DataFrame, as_of: str) -> DataFrame:
    """Number of fresh entries without a repository; they are dropped."""
    return with_staleness(queue, as_of).where(~F.col("stale")).agg(F.count_if(F.col("repo_id").isNull()).alias("dropped"))


def response_status(code: Column, license_invalid: Column) -> Column:
    """Delivery status of an HTTP code; a null code is a network failure."""
    return (
        F.when(code.isNull(), "unreachable").when(code.between(200, 299), "sent")
        .when(code == 503, F.when(license_invalid, "license_invalid").otherwise("unreachable"))
        .when(code.isin(401, 403), "auth_failed").when(code.isin(400, 413, 422), "rejected").otherwise("error")
    )


def dispose(queue: DataFrame, responses: DataFrame, as_of: str) -> DataFrame:
    """The queue after one delivery round. responses(repo_id, code, license_invalid).

    Stale entries stay as they are. Delivered, permanently rejected and unattributed ones leave; a
    refused token is noted; an error counts as an attempt; anything transient stays untouched.
    """
    q = with_staleness(queue, as_of)
    status = response_status(F.col("code"), F.coalesce("license_invalid", F.lit(False)))
    known = responses.select("repo_id", "code", "license_invalid", F.lit(True).alias("_answered"))
    j = q.join(known, "repo_id", "left").withColumn("_s", F.when(F.col("_answered"), status))
    fresh = ~F.col("stale")
    gone = fresh & (F.col("repo_id").isNull() | F.coalesce(F.col("_s").isin("sent", "rejected"), F.lit(False)))
    bump = fresh & F.coalesce(F.col("_s") == "error", F.lit(False))
    auth = fresh & F.coalesce(F.col("_s") == "auth_failed", F.lit(False))
    return j.where(~gone).withColumns(
        {
            "attempts": F.col("attempts") + F.when(bump, 1).otherwise(0),
            "last_error": F.when(auth, "auth").when(bump, F.lit(None)).otherwise(F.col("last_error")),
        }
    ).select(*queue.columns)


def worst_status(responses: DataFrame) -> DataFrame:
    s = response_status(F.col("code"), F.coalesce("license_invalid", F.lit(False)))
    rows = responses.select(s.alias("status")).withColumn("r", map_literal(STATUS_RANK, F.col("status"), 0))
    return rows.agg(F.coalesce(F.max_by("status", "r"), F.lit("empty")).alias("status"))


def health(queue: DataFrame, as_of: str) -> DataFrame:
    """(pending, stale, past_grace): past grace when every entry below the attempt limit is over 7 days old."""
    q = with_staleness(queue, as_of)
    live = F.col("attempts") < STALE_ATTEMPTS
    return q.agg(
        F.count_if(~F.col("stale")).alias("pending"), F.count_if("stale").alias("stale"),
        F.coalesce(_age_over(F.min(F.when(live, F.col("ts"))), as_of, GRACE_DAYS), F.lit(False)).alias("past_grace"),
    )


def purge(queue: DataFrame, as_of: str) -> DataFrame:
    return with_staleness(queue, as_of).where(~F.col("stale")).select(*queue.columns)


def reset(queue: DataFrame) -> DataFrame:
    """Attempts and errors cleared; the time of an entry is kept, so age still counts."""
    return queue.withColumns({"attempts": F.lit(0).cast("bigint"), "last_error": F.lit(None).cast("string")})


def reset_report(queue: DataFrame, as_of: str) -> DataFrame:
    before = with_staleness(queue, as_of)
    return before.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("stale").alias("were_stale"),
        F.count_if(F.col("reason").isin("age", "both")).alias("age_stale_remaining"),
    )
