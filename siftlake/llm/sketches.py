"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k least of the distinct 40-bit shingle hashes of a text. Sketches of parts merge into that of
the whole; from two of them follow resemblance and containment, from one the number of distinct shingles.

Null and empty texts, and texts without words, have the empty sketch; two empty sketches resemble each other
fully, an empty and another one not at all. Other columns are kept by `fingerprints`.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftlake.llm import textarrays as ta

K = 128
NONE = np.uint64(2**64 - 1)
TOP = 1 << 40


def sketches(column: pa.Array, k: int = K) -> np.ndarray:
    """A row of k hashes for each text, ascending; unused places hold NONE."""
    out = np.full((len(column), k), NONE)
    data, offsets = ta.raw(column)
    row = 0
    for lo, hi in ta.ranges(offsets):
        s = ta.shingles(ta.words(data, offsets, lo, hi))
        h = s.hashes >> np.uint64(24)
        for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True):
            if b > a:
                least = _least(h[a:b], k)
                out[row, : len(least)] = least
            row += 1
    return out


def _least(h: np.ndarray, k: int) -> np.ndarray:
    """The k least distinct values, ascending."""
    take = 4 * k
    while len(h) > take:  # distinct values may hide behind repeats
        got = np.unique(np.partition(h, take)[:take])
        if len(got) > k:
            return got[:k]
        take *= 4
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketches of the unions, row by row."""
    return _merged(a, b)[0]


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketch of each union, and how many of its hashes are in both."""
    k = a.shape[1]
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NONE)
    place = np.cumsum(~again, axis=1)
    shared = (again & (place <= k)).sum(axis=1)
    both[again] = NONE
    return np.sort(both, axis=1)[:, :k], shared


def resemblance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets, row by row; exact up to k distinct shingles in all."""
    union, shared = _merged(a, b)
    size = (union != NONE).sum(axis=1)
    return np.where(size == 0, 1.0, shared / np.maximum(size, 1))


def distinct(a: np.ndarray) -> np.ndarray:
    """Estimated number of distinct shingles; exact below k."""
    size, k = (a != NONE).sum(axis=1), a.shape[1]
    return np.where(size < k, size, (k - 1) * TOP / np.maximum(a[:, -1].astype(float), 1))


def containment(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of a's shingles that b has, row by row; an empty a is contained in all."""
    n = distinct(a)
    common = resemblance(a, b) * distinct(merge(a, b))
    return np.where(n == 0, 1.0, np.minimum(1.0, common / np.maximum(n, 1)))


def encoded(sketch: np.ndarray) -> list[str]:
    """A text for each sketch: base64 of its hashes, five bytes each."""
    used = (sketch != NONE).sum(axis=1).tolist()
    five = np.ascontiguousarray(sketch.astype("<u8")).view(np.uint8).reshape(*sketch.shape, 8)[:, :, :5]
    return [base64.b64encode(five[i, :n].tobytes()).decode() for i, n in enumerate(used)]


def decoded(texts: list[str], k: int = K) -> np.ndarray:
    out = np.zeros((len(texts), k, 8), np.uint8)
    used = []
    for i, t in enumerate(texts):
        five = np.frombuffer(base64.b64decode(t), np.uint8).reshape(-1, 5)
        out[i, : len(five), :5] = five
        used.append(len(five))
    out = out.view("<u8")[:, :, 0].astype(np.uint64)
    out[np.arange(k)[None, :] >= np.array(used, dtype=int).reshape(-1, 1)] = NONE
    return out


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All rows and columns of docs and a fingerprint; an input column named `out` is replaced."""
    own = [c for c in docs.columns if c != out]
    kept = docs.select(*[F.col(f"`{c}`") for c in own], F.lit("").alias(out))

    def add(batches):
        for b in batches:
            prints = pa.array(encoded(sketches(b.column(own.index(text)))), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], prints], names=b.schema.names)

    return kept.mapInArrow(add, kept.schema)


def bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the value (null: none), found in two steps."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    up_to = lambda xs: F.coalesce(F.size(F.filter(xs, lambda x: x <= value)), F.lit(0))
    coarse = up_to(F.array(*[F.lit(g[0]) for g in groups]))
    inner = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * width + up_to(F.element_at(inner, coarse)))


def edits(docs: DataFrame, rows_per_block: int = 4096, most_blocks: int = 16384) -> DataFrame:
    """Fingerprints of every text, of its edited form and their likenesses to it and to the next text.

    Edited: the last quarter of the code points replaced by the first as many of the next document in the order of
    doc_id (nulls first, ties by text); after the last comes the first, a single document follows itself. The order is
    cut at existing ids into blocks; each block's stream also gets the head of the next one, so texts move once and
    a task holds no more than two batches. Blocks number a few thousands at most; their streams have no size limit.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total, lowest, nulls = d.agg(F.count("*"), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    blocks = max(1, min(most_blocks, -(-total // rows_per_block)))
    cuts = [] if blocks == 1 or lowest is None else d.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0]
    bounds = sorted(set(cuts) - {lowest} if not nulls else set(cuts))
    own = bucket(F.col("doc_id"), bounds)
    is_head = F.array_contains(F.array(*[F.lit(b) for b in bounds]), F.col("doc_id")) if bounds else F.lit(False)
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(lowest)
    role = lambda block, kind: F.struct(block.cast("int").alias("block"), F.lit(kind).alias("role"))
    places = F.array_compact(F.array(
        role(own, 0), F.when(is_head, role(own - 1, 1)), F.when(is_first, role(F.lit(len(bounds)), 2))))
    dealt = d.withColumn("place", F.explode(places)).select("place.block", "place.role", "doc_id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.withColumn("tie", F.xxhash64("text")).repartition(n, "block").sortWithinPartitions("block", "role", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.mapInArrow(_stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _stream(batches):
    carry = None
    for b in batches:
        carry = b if carry is None else pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0] if carry.num_rows else b
        if carry.num_rows > 1:
            yield from _rows(carry)
            carry = carry.slice(carry.num_rows - 1)


def _rows(b: pa.RecordBatch, part: int = 1024):
    """The documents of a run of rows; the last row is only looked at as the next of the one before."""
    for lo in range(0, b.num_rows - 1, part):
        piece = b.slice(lo, min(part, b.num_rows - 1 - lo) + 1)
        block, role = piece.column(0).to_pylist(), piece.column(1).to_pylist()
        keep = [i for i in range(len(block) - 1) if role[i] == 0]
        if not keep:
            continue
        texts = piece.column(3).to_pylist()
        edited, sums = [], []
        for i in keep:
            if block[i] != block[i + 1]:
                raise RuntimeError("a block lacks its next document")
            t, q = texts[i], len(texts[i]) // 4
            e = t[: len(t) - q] + texts[i + 1][:q]
            edited.append(e)
            sums.append(hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest())
        own, changed = sketches(piece.column(3)), sketches(pa.array(edited, pa.large_string()))
        at = np.array(keep)
        yield pa.RecordBatch.from_arrays([
            piece.column(2).take(pa.array(at)), pa.array([len(texts[i]) for i in keep], pa.int64()), pa.array(sums), pa.array(encoded(own[at])), pa.array(encoded(changed)),
            pa.array(resemblance(own[at], changed)), pa.array(resemblance(own[at], own[at + 1])),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
