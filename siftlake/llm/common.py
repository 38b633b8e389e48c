"""Spark helpers of this subpackage: written tables, whole numbering, key filters, connected groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from siftlake.session import checkpoint_dir

#: 64-bit words of a key filter: 8 MB, whatever the input.
FILTER_WORDS = 1 << 20
#: Stands for a null id in arrays and sorts after all others.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows as a table in the shared folder: a lost executor doesn't cost the steps before. Options are the writer's."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/siftlake-llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def numbered(df: DataFrame, order: list[str], name: str, out: str = "rank") -> DataFrame:
    """Rows with their place (0, 1, ...) in the order of all rows. Rows are dealt out by range, numbered in
    their partition and shifted by the sizes of the partitions before; one row per partition is added up."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    local = written(local.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}), name)
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    shifts = sizes.select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return local.join(F.broadcast(shifts), "_part").withColumn(out, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def key_filter(keys: DataFrame, words: int = FILTER_WORDS) -> np.ndarray:
    """A bit for each key's low bits, as an array of fixed size. It lets through every key and some others, so
    an exact join must follow; with very many keys it only lets more through."""
    (key,) = keys.columns
    bits = int(words).bit_length() - 1
    word = F.shiftrightunsigned(key, 6).bitwiseAND((1 << bits) - 1)
    got = keys.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(63).cast("int"))).alias("b")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = keys.view(np.uint64)
    word = bits[((keys >> np.uint64(6)) & np.uint64(len(bits) - 1)).astype(np.int64)]
    return (word >> (keys & np.uint64(63))) & np.uint64(1) == 1


def connected(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(id, root): root names the connected group of each id in edges (a, b). Every id moves to the neighbour
    of least hash, the graph shrinks to those, and so on; random order halves even long chains."""
    less = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = written(edges.where("a <> b").select("a", "b").distinct(), name)
    roots = None
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("id")).agg(F.min(less("b")).alias("m"))
        up = written(up.select("id", F.least("m", less("id")).alias("m")).select("id", F.col("m.v").alias("up")), name)
        if roots is None:
            roots = up.select("id", F.col("up").alias("root"))
        else:
            known = up.select(F.col("id").alias("root"), "up")
            roots = written(roots.join(known, "root", "left").select("id", F.coalesce("up", "root").alias("root")), name)
        a, b = up.select(F.col("id").alias("a"), F.col("up").alias("x")), up.select(F.col("id").alias("b"), F.col("up").alias("y"))
        edges = written(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
    else:
        raise RuntimeError(f"not connected after {most_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")) if roots is None else roots


def per_batch(fn: Callable, schema):
    """A mapInArrow function that applies fn to each batch; fn gives a RecordBatch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run
