"""Hard negatives by Four-Russians scoring.

Components are integers in two's complement. Of every vector, the bits of one weight (a bit plane) are packed, eight
dimensions to a byte. Of every anchor, each group of eight dimensions has a table of its 256 subset sums. The score is
then, plane by plane from the sign down, twice what there is plus one table entry for each byte: look-ups, shifts
and additions that give the whole, exact inner product with every row.

Two passes over blocks of rows ordered by label: anchors against blocks of their own label give the positives; anchors,
now with the score interval of each positive, against blocks of other labels give the negatives. Blocks and anchors meet
by key, a group holds one block of each, both of bounded size, so a frequent label is many groups. Each group hands on
at most the first few rows of an anchor and positive.

Rows with a null label, a null vector or any null or non-finite component take no part; shorter vectors end in zeros.
Equal scores are ordered by id, null ids last. Other rows of an anchor's id count as other rows. An anchor without
positives, or a positive without negatives, gives no row. Scores must fit in 64 bits. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftlake.llm import common, vectors as vec

SCALE = 256
GROUP = 8
#: Anchors of a block, anchors whose tables are in use at once, and rows looked up at once.
ANCHORS, TABLES, ROWS = 16_384, 64, 2048
#: Row blocks of a table within the bounds of a block's rows.
PARTS, LEAST, MOST = 16, 4096, 262_144
FOUND = "an long, slot int, vec_id long, score long"
#: bit j of byte b, the first dimension of a group at the highest bit as numpy packs them.
_BITS = (np.arange(256)[:, None] >> np.arange(GROUP - 1, -1, -1)) & 1


def bit_planes(v: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes; plane p holds the bits of weight 2 ** p."""
    n, d = v.shape
    groups = -(-d // GROUP)
    bits = np.zeros((n, planes, groups * GROUP), np.uint8)
    for p in range(planes):
        bits[:, p, :d] = (v >> p) & 1
    return np.packbits(bits.reshape(n, planes, groups, GROUP), axis=-1).reshape(n, planes, groups)


def subset_sums(anchors: np.ndarray, kind) -> np.ndarray:
    """(groups, 256, anchors): for every byte the sum of the anchor's components where a bit is set."""
    a, d = anchors.shape
    padded = np.zeros((a, -(-d // GROUP) * GROUP), np.int64)
    padded[:, :d] = anchors
    return np.ascontiguousarray(np.einsum("bj,agj->gba", _BITS, padded.reshape(a, -1, GROUP)).astype(kind))


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products of packed rows with the anchors of the tables."""
    n, high = len(planes), planes.shape[1] - 1
    out = np.zeros((n, tables.shape[2]), tables.dtype)
    entry = np.empty_like(out)
    for p in range(high, -1, -1):
        if p < high:
            out <<= 1
        for g, table in enumerate(tables):
            np.take(table, planes[:, p, g], axis=0, out=entry, mode="clip")
            if p == high:
                out -= entry
            else:
                out += entry
    return out


class _First:
    """The first k rows of each (anchor, slot) by score, then id; rows must be offered by ascending id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.cell, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, got: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        slots = self.low.shape[1]
        cells, found, at = [self.cell], [self.score], [self.id]
        for j in range(slots):
            r, a = np.nonzero(allowed & (got >= self.low[:, j]) & (got <= self.high[:, j]))
            cells.append(a * slots + j)
            found.append(got[r, a].astype(np.int64))
            at.append(ids[r])
        cell, score, ids = np.concatenate(cells), np.concatenate(found), np.concatenate(at)
        if len(cell) == len(self.cell):
            return
        order = np.lexsort((ids, -score, cell))
        cell, score, ids = cell[order], score[order], ids[order]
        place = np.arange(len(cell)) - np.searchsorted(cell, cell)
        full = place == self.k - 1
        self.low.ravel()[cell[full]] = score[full] + 1  # a later row of the same score has a greater id
        keep = place < self.k
        self.cell, self.score, self.id = cell[keep], score[keep], ids[keep]


def _chunks(n: int):
    """Ranges that grow from a few rows, so that thresholds are up before the bulk."""
    at, size = 0, 64
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, min(ROWS, 4 * size)


def _mine(f: vec.Figures, planes: int, k: int, same_label: bool):
    """The cogroup function: a block of anchors against a block of packed rows."""
    groups = -(-f.dims // GROUP)
    kind = np.int32 if f.dims * float(f.largest + 1) * 2.0**planes < 2**31 else np.int64

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, parts = ["an", "slot", "vec_id", "score"], []
        if left.num_rows and right.num_rows:
            order = np.argsort(vec.ids_of(right["vec_id"]), kind="stable")
            numbers, labels, ids = right["rn"].to_numpy()[order], right["label"].to_numpy()[order], vec.ids_of(right["vec_id"])[order]
            flat = right["planes"].combine_chunks()
            packed = np.frombuffer(b"".join(flat.to_pylist()), np.uint8).reshape(len(flat), planes, groups)[order]
            an, label = left["an"].to_numpy(), left["label"].to_numpy()
            low, high = (np.array(left[x].to_pylist(), np.int64).reshape(len(an), -1) for x in ("low", "high"))
            v = vec.matrix(left["v"], f.dims)
            for a in range(0, len(an), TABLES):
                part = slice(a, a + TABLES)
                tables, first = subset_sums(v[part], kind), _First(low[part], high[part], k)
                for b, e in _chunks(len(ids)):
                    same = labels[b:e, None] == label[part]
                    allowed = same & (numbers[b:e, None] != an[part]) if same_label else ~same
                    if allowed.any():
                        first.offer(scores(tables, packed[b:e]), allowed, ids[b:e])
                slots = low.shape[1]
                parts.append((an[part][first.cell // slots], (first.cell % slots).astype(np.int32), first.id, first.score))
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int32 if i == 1 else np.int64) for i in range(4)]
        return pa.table([pa.array(columns[0]), pa.array(columns[1]), vec.id_column(columns[2]), pa.array(columns[3])], names=names)

    return run


def _packed(rows: DataFrame, f: vec.Figures, planes: int) -> DataFrame:
    def run(batches):
        for b in batches:
            got = bit_planes(vec.matrix(b.column(3), f.dims), planes).reshape(b.num_rows, -1)
            packed = pa.array([r.tobytes() for r in got], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), packed], names=["rn", "vec_id", "label", "planes"])

    return rows.select("rn", "vec_id", "label", "v").mapInArrow(run, "rn long, vec_id long, label long, planes binary")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("an", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label): for each
    anchor and each of its best rows of the same label, the best rows of other labels with a score from low to high
    percent of the positive's."""
    spark = vectors.sparkSession
    keep = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks")]
    rows = common.written(vec.quantised(vectors.where(F.col("label").isNotNull()), scale, *keep), "negatives-rows")
    f = vec.figures(rows)
    planes = max(1, int(f.largest).bit_length() + 1)
    ordered = vec.narrow(rows, f).drop("norm").withColumn("_no_id", F.col("vec_id").isNull())
    numbered = common.written(vec.ranked_rows(ordered, ["label", "_no_id", "vec_id"], "negatives-ranked", "rn").drop("_no_id"), "negatives-order")
    size = max(LEAST, min(f.rows // PARTS, MOST))
    packed = common.written(_packed(numbered, f, planes).withColumn("block", F.floor(F.col("rn") / size)), "negatives-planes")
    blocks = packed.groupBy("block").agg(F.min("label").alias("from_label"), F.max("label").alias("to_label"))
    last = packed.agg(F.max("block")).first()[0] or 0
    asking = numbered.where("asks").select(F.col("rn").alias("an"), F.col("vec_id").alias("anchor_id"), "label", "v")
    anchor_blocks = max(1, -(-asking.count() // ANCHORS))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))

    def meet(anchors: DataFrame, wanted: Column, k: int, same_label: bool) -> DataFrame:
        sent = anchors.withColumns({"ab": F.pmod(F.xxhash64("an"), F.lit(anchor_blocks)), "block": every_block}).join(blocks, "block").where(wanted)
        sent = sent.select("block", "ab", "an", "label", "v", "low", "high")
        met = packed.withColumn("ab", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(anchor_blocks - 1).cast("long"))))
        return sent.groupBy("block", "ab").cogroup(met.groupBy("block", "ab")).applyInArrow(_mine(f, planes, k, same_label), FOUND)

    anywhere = asking.withColumns({"low": F.array(F.lit(-(1 << 63))), "high": F.array(F.lit((1 << 63) - 1))})
    own = meet(anywhere, F.col("label").between(F.col("from_label"), F.col("to_label")), positives, True)
    best = common.written(_first(own, positives).select("an", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    spans = best.groupBy("an").agg(F.map_from_entries(F.collect_list(F.struct("rank", "positive_score"))).alias("_s"))
    at = lambda c: F.transform(F.sequence(F.lit(1), F.lit(positives)), c)
    least = at(lambda i: F.coalesce(F.ceil(F.try_element_at("_s", i).cast("decimal(38,0)") * low / F.lit(100)).cast("long"), F.lit(1).cast("long")))
    most = at(lambda i: F.coalesce(F.floor(F.try_element_at("_s", i).cast("decimal(38,0)") * high / F.lit(100)).cast("long"), F.lit(0).cast("long")))
    spanned = asking.join(spans, "an").withColumns({"low": least, "high": most})
    others = meet(spanned, (F.col("from_label") != F.col("label")) | (F.col("to_label") != F.col("label")), negatives, False)
    found = _first(others, negatives).select("an", (F.col("slot") + 1).alias("_pos"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (
        found.join(best.withColumnRenamed("rank", "_pos"), ["an", "_pos"]).join(asking.select("an", "anchor_id"), "an")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
