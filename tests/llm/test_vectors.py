"""Exact search and hard negatives against plain Python."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlake.llm import negatives, topk, vectors


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def order(s):
    return (-s[1], s[0] is None, s[0] or 0)


def plain_top_k(rows, every, k, scale):
    sound = [(i, q) for i, v in rows if (q := whole(v, scale)) is not None]
    out = []
    for n, (i, q) in enumerate(sound):
        if i is not None and i % every == 0:
            best = sorted(((j, dot(q, w)) for m, (j, w) in enumerate(sound) if m != n), key=order)[:k]
            out += [(i, r, j, s) for r, (j, s) in enumerate(best, 1)]
    return out


def plain_negatives(rows, every, scale):
    sound = [(i, q, lab) for i, v, lab in rows if lab is not None and (q := whole(v, scale)) is not None]
    out = []
    for n, (i, a, lab) in enumerate(sound):
        if i is None or i % every:
            continue
        scored = [(j, dot(a, w), b) for m, (j, w, b) in enumerate(sound) if m != n]
        for p, ps, _ in sorted((s for s in scored if s[2] == lab), key=order)[:5]:
            hard = sorted((s for s in scored if s[2] != lab and 50 * ps <= 100 * s[1] <= 95 * ps), key=order)[:3]
            out += [(i, p, r, j, ps, s) for r, (j, s, _) in enumerate(hard, 1)]
    return out


def same(got, expected):
    assert collections.Counter(map(tuple, got)) == collections.Counter(expected)


def table(spark, rows):
    """(vec_id, embedding, label) with further columns whose names the operators use inside."""
    rows = [(i, v, lab, "v", 1.0, None, 7) for i, v, lab in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string, norm double, cb string, rank int").repartition(3)


def odd():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).round(3).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    rows += [(i, rows[10][1], i % 3) for i in range(150, 220)]  # many ties
    rows += [(10, rows[10][1], 1), (10, rows[10][1], 1), (20, rows[3][1], 2)]  # repeated rows, repeated ids
    rows += [(None, rows[20][1], 0), (None, None, 1), (300, None, 1), (301, [1.0, None], 1), (302, [1.0, float("nan")], 1), (303, [float("inf")], 1), (304, rows[2][1], None)]
    return [*rows, (305, [], 1), (310, [0.5], 0), (320, [0.0] * 12, 2), (330, [2.0] * 12, 2), (340, [-3.5] * 12, 1)]


def test_top_k_on_odd_rows(spark):
    rows = odd()
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    same(got.collect(), plain_top_k([r[:2] for r in rows], 10, 10, 1024))
    few = rows[:4]
    same(topk.top_k(table(spark, few), F.col("vec_id") % 2 == 0).collect(), plain_top_k([r[:2] for r in few], 2, 10, 1024))
    assert topk.top_k(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.top_k(table(spark, rows), F.lit(None).cast("boolean")).count() == 0


def test_top_k_over_many_blocks_and_rounds(spark, monkeypatch):
    """Lengths that differ much, so that whole blocks are passed over; large components, so that sums leave the doubles."""
    monkeypatch.setattr(vectors, "LEAST_BYTES", 8 * 6 * 64)
    monkeypatch.setattr(vectors, "MOST_BYTES", 8 * 6 * 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    monkeypatch.setattr(topk, "COLUMNS", 16)
    rng = np.random.default_rng(6)
    for size in (1.0, 40_000.0):
        m = rng.normal(size=(900, 6)) * rng.exponential(size=(900, 1)) * size
        rows = [(i, v.tolist(), 0) for i, v in enumerate(m)]
        same(topk.top_k(table(spark, rows), F.col("vec_id") % 25 == 0, k=4).collect(), plain_top_k([r[:2] for r in rows], 25, 4, 1024))


def test_partial_sums_drop_only_what_is_below():
    rng = np.random.default_rng(7)
    c, q = rng.integers(-400, 400, (500, 16)), rng.integers(-400, 400, (20, 16))
    c[:, 2:] //= 20
    basis = np.linalg.svd(c.T.astype(float) @ c)[0]
    steps = [2, 4, 8]
    turned, asked = topk._Turned(c, basis, steps), topk._Turned(q, basis, steps)
    scores = q @ c.T
    low = np.sort(scores, axis=1)[:, -5]
    rows, cols = topk._pairs(asked, turned, np.arange(20), np.arange(500), steps, low)
    assert set(np.flatnonzero((scores >= low[:, None]).any(axis=0))) <= set(cols.tolist()) and len(rows) == 20 and len(cols) < 250


def test_hard_negatives_on_odd_rows(spark, monkeypatch):
    rows = odd()
    expected = plain_negatives(rows, 10, 256)
    got = negatives.mined(table(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert expected
    same(got.collect(), expected)
    for name, value in (("LEAST", 16), ("MOST", 16), ("ANCHORS", 4), ("TABLES", 3), ("ROWS", 8)):
        monkeypatch.setattr(negatives, name, value)
    same(negatives.mined(table(spark, rows), F.col("vec_id") % 10 == 0).collect(), expected)
    assert negatives.mined(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mined(table(spark, [(i, [], 1) for i in range(9)]), F.col("vec_id") % 2 == 0).count() == 0
    same(negatives.mined(table(spark, [(i, [], i % 2) for i in range(9)]), F.col("vec_id") % 5 == 0).collect(), plain_negatives([(i, [], i % 2) for i in range(9)], 5, 256))


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_lookups_give_whole_inner_products(size):
    rng = np.random.default_rng(size)
    rows, anchors = rng.integers(-size, size, (50, 13)), rng.integers(-size, size, (7, 13))
    packed = negatives.bit_planes(rows, int(size).bit_length() + 1)
    assert (negatives.scores(negatives.subset_sums(anchors, np.int64), packed) == rows @ anchors.T).all()


def test_matrix_of_sliced_and_ragged_lists():
    column = pa.array([[9], [1, 2, 3], [4, 5], []]).slice(1)
    assert vectors.matrix(column, 3).tolist() == [[1, 2, 3], [4, 5, 0], [0, 0, 0]]
