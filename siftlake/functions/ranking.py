"""Row numbers and tails without putting a whole group, or the whole table, into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siftlake.session import written


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add `name`: 1-based position within `keys` (all rows if there are none) by order.

    Rows are dealt out by ranges of (keys, order), so a hot key lies in as many tasks as it needs; each task
    numbers its rows, and the sizes of a key's earlier tasks are added. The dealt rows are written in between, because both
    the numbers and the sizes must be those of one and the same deal. Only the sizes, one row for each key and task,
    are accumulated.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    at = F.monotonically_increasing_id()
    dealt = written(dealt.withColumn("_at", at).withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1)
    mine = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_part") == F.col("_p")]
    starts = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_start")
    out = dealt.join(starts, mine)
    return out.select(*df.columns, (F.col("_at") + F.col("_start")).cast("bigint").alias(name))


def tail(events: DataFrame, n: int) -> DataFrame:
    """The last n records in append order; each task keeps at most n rows."""
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(n)
