"""Sharding by a k-d tree over document metadata.

Each metadata dimension (bytes, id, source, language) gives every document a coordinate: its place in the order of
that dimension, ties by id, so dimensions of any type compare and no two coordinates are equal. A node is split at the
byte-weighted median along the dimension in which its coordinates spread widest, until it is near the target.
Only metadata moves. The median is found by histograms of fixed size, narrowed until one document is left.

Null texts count as empty, null values sort first. Rows that are equal in all dimensions are told apart by a number, so
repeats spread like other rows. Columns that docs lacks are left out; an empty table gives no row. A document
larger than the target is a leaf of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftlake.llm import common

DIMENSIONS = ("size", "doc_id", "source", "lang")
BINS = 4096
#: A node of fewer bytes than this many targets is a leaf: halves would be further from the target than the whole.
SLACK = 1.5


def metadata(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """doc_id, size, text_crc32 and the coordinates c0, c1, ... of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [d for d in dimensions if d not in ("size", "doc_id") and d in docs.columns]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[F.col(c).cast("string").alias(f"m_{c}") for c in own])
    rows = common.written(rows.withColumn("rid", F.monotonically_increasing_id()), "kd-rows")
    for i, d in enumerate(["size", "doc_id", *(f"m_{c}" for c in own)]):
        rows = common.numbered(rows, list(dict.fromkeys([d, "doc_id", "text_crc32", "rid"])), f"kd-order{i}", f"c{i}")
    return rows.drop(*[f"m_{c}" for c in own])


def _node_side(nodes: DataFrame, level: int) -> DataFrame:
    """A level has at most 2 ** level nodes; they are broadcast while that is few."""
    return F.broadcast(nodes) if level <= 16 else nodes


def _at(coordinates: list[str], dim: Column) -> Column:
    return F.element_at(F.array(*coordinates), dim + 1)


def split_level(rows: DataFrame, level: int, target: int, documents: int, coordinates: list[str]) -> DataFrame:
    """Rows with the nodes of the next level; leaves keep theirs."""
    spread = [F.struct((F.max(c) - F.min(c)).alias("w"), F.lit(-i).alias("d")) for i, c in enumerate(coordinates)]
    nodes = rows.groupBy("node").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.greatest(*spread).alias("s") if len(spread) > 1 else spread[0].alias("s"), *[F.min(c).alias(f"lo{i}") for i, c in enumerate(coordinates)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(coordinates)])
    dim = -F.col("s.d")
    cut = nodes.where((F.col("bytes") >= SLACK * target) & (F.col("n") > 1)).select(
        "node", "bytes", dim.alias("dim"), _at([f"lo{i}" for i in range(len(coordinates))], dim).alias("lo"),
        (_at([f"hi{i}" for i in range(len(coordinates))], dim) + 1).alias("hi"), F.lit(0).cast("long").alias("below"))
    for _ in range(passes(documents)):
        x = _at(coordinates, F.col("dim"))
        step = F.ceil((F.col("hi") - F.col("lo")) / BINS)
        within = rows.join(_node_side(cut, level), "node").where((x >= F.col("lo")) & (x < F.col("hi")))
        bins = within.groupBy("node", F.floor((x - F.col("lo")) / step).alias("bin")).agg(F.sum("size").alias("w"), *[F.first(c).alias(c) for c in ("bytes", "dim", "lo", "hi", "below")])
        up_to = F.sum("w").over(W.partitionBy("node").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        half = bins.withColumn("up_to", F.col("below") + up_to).where(F.col("up_to") * 2 >= F.col("bytes"))
        half = half.groupBy("node").agg(F.min_by(F.struct("bin", "w", "bytes", "dim", "lo", "hi", "below", "up_to"), "bin").alias("b")).select("node", "b.*")
        lo = F.col("lo") + F.col("bin") * step
        cut = half.select("node", "bytes", "dim", lo.alias("lo"), F.least("hi", lo + step).alias("hi"), (F.col("up_to") - F.col("w")).alias("below"), "up_to")
        cut = cut.withColumn("last", F.col("up_to")).drop("up_to") if _ == passes(documents) - 1 else cut.drop("up_to")
    before, upto, whole = F.col("below"), F.col("last"), F.col("bytes")
    closer = (F.abs(2 * upto - whole) <= F.abs(2 * before - whole)) & (upto < whole)
    cut = cut.select("node", "dim", (F.col("lo") + F.when((before == 0) | closer, 1).otherwise(0)).alias("first_right"))
    joined = rows.join(_node_side(cut, level), "node", "left")
    right = (_at(coordinates, F.col("dim")) >= F.col("first_right")).cast("long")
    child = F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right)
    return joined.withColumn("node", child).drop("dim", "first_right")


def passes(documents: int) -> int:
    """Narrowings until a bin holds one coordinate."""
    n, width = 1, BINS
    while width < documents:
        n, width = n + 1, width * BINS
    return n


def shards(docs: DataFrame, target_bytes: int | None = None, max_depth: int = 40, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... in the shard, by doc_id). With `parts`, a power of two,
    the target is that share of all bytes and shards are numbered below it, in the order of the tree."""
    rows = metadata(docs)
    coordinates = sorted(c for c in rows.columns if c[0] == "c" and c[1:].isdigit())
    documents, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if parts:
        max_depth, target_bytes = parts.bit_length() - 1, max(1, total // parts)
    rows = common.written(rows.withColumn("node", F.lit(1).cast("long")), "kd-level")
    depth = 0
    while depth < max_depth:
        if rows.groupBy("node").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") >= SLACK * target_bytes) & (F.col("n") > 1)).isEmpty():
            break
        rows = common.written(split_level(rows, depth, target_bytes, documents, coordinates), "kd-level")
        depth += 1
    level = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
    wide = max_depth if parts else depth
    aligned = F.call_function("shiftleft", F.col("node"), F.lit(wide) - level) - (1 << wide)
    rows = common.numbered(rows.withColumn("shard", aligned), ["shard", "doc_id", "text_crc32", "rid"], "kd-slots", "slot")
    starts = rows.groupBy("shard").agg(F.min("slot").alias("start"))
    return rows.join(_node_side(starts, wide), "shard").select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("slot") - F.col("start")).alias("slot"))


def write(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Writes docs with their shard as one folder per shard. doc_id must name a document."""
    side = assigned.select("doc_id", "shard", "slot")
    docs.join(side, "doc_id").repartition("shard", F.floor(F.col("slot") / 10000)).write.partitionBy("shard").parquet(path)
