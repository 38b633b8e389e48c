"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are shares and lengths of the whole text, its words, lines and shingles. They are kept as a small table, so
that texts are read once for training and scores. Trees are fitted on at most MOST_ROWS labelled rows, those with the
least hashes of doc_id: the statistics are cut into bins, each level of a tree is grown from sums of gradients by bin, and
the trees become arrays that numpy walks for all rows at once.

Null and empty texts have zero statistics and get a score like any other. Rows without a label, or with a null one, train
nothing; a document with several labels trains with each. Without labels every score is 0.5; with one class only,
scores tend to it. Equal texts get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlake.llm import common, textarrays as ta

MOST_ROWS = 40_000
THRESHOLD = 0.7
BINS, TREES, DEPTH, RATE, LEAST_CHILD, RIDGE = 32, 60, 4, 0.2, 20.0, 1.0


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


CLASSES = {
    "upper": _class(bytes(range(65, 91))), "lower": _class(bytes(range(97, 123))), "digit": _class(bytes(range(48, 58))), "stop": _class(b".,;:?"),
    "shout": _class(b"!"), "bar": _class(b"|"), "symbol": _class(b"#$%&*+=<>@\\^_`~{}[]/"), "line": _class(b"\n"), "wide": _class(bytes(range(128, 256))),
}
NAMES = (
    "log_bytes", "log_words", *CLASSES, "word_bytes", "short_words", "long_words", "marked_words", "distinct_words", "same_as_before",
    "commonest_word", "line_bytes", "repeated_lines", "repeated_shingles",
)


def _share(flags: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)


def _repeats(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of values that are distinct, and of the commonest one, in each text."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    x, d = h[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(x)))
    most = np.zeros(len(n))
    np.maximum.at(most, d[begin], run)
    return np.bincount(d[begin], minlength=len(n)) / np.maximum(n, 1), most / np.maximum(n, 1)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text, in the order of NAMES."""
    data, offsets = ta.raw(column)
    out = [_statistics(data, offsets, lo, hi) for lo, hi in ta.ranges(offsets)]
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)), np.float32)


def _statistics(data, offsets, lo, hi) -> np.ndarray:
    buf, at = ta.laid_out(data, offsets, lo, hi)
    size = (offsets[lo + 1 : hi + 1] - offsets[lo:hi]).astype(float)
    b, e = ta.word_bounds(buf)
    first = np.searchsorted(b, at)
    n = np.diff(first)
    length = e - b
    h = ta.span_hashes(ta.prefix_sums(buf), b, e)
    shingles = ta.shingles(ta.Words(h, first))
    marked = np.concatenate([[0], np.cumsum(CLASSES["symbol"][buf] | CLASSES["shout"][buf] | CLASSES["bar"][buf], dtype=np.int64)])
    before = np.zeros(len(h), bool)
    before[1:] = h[1:] == h[:-1]
    before[first[:-1][n > 0]] = False
    distinct, commonest = _repeats(h, first)
    ends = np.flatnonzero(buf == 10)
    edges = np.unique(np.concatenate([at - 1, ends]))  # a text begins after a blank, lines after their ends
    line_b, line_e = edges[:-1] + 1, edges[1:]
    some = line_e > line_b
    line_b, line_e = line_b[some], line_e[some]
    line_first = np.searchsorted(line_b, at)
    lines = np.diff(line_first)
    line_distinct, _ = _repeats(ta.span_hashes(ta.prefix_sums(buf), line_b, line_e), line_first)
    shingle_distinct, _ = _repeats(shingles.hashes, shingles.first)
    any_ = lambda share, count: np.where(count > 0, 1 - share, 0)
    columns = [
        np.log1p(size), np.log1p(n), *[_share(c[buf], at, size) for c in CLASSES.values()], _share(length, first, n), _share(length <= 2, first, n), _share(length >= 16, first, n),
        _share(marked[e] > marked[b], first, n), distinct, _share(before, first, n), commonest, size / np.maximum(lines, 1), any_(line_distinct, lines), any_(shingle_distinct, np.diff(shingles.first)),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


class Trees:
    """Boosted trees of one depth as arrays: feature and cut of each inner node, value of each leaf."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fitted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for log-loss. Rows are few (bounded), sums by bin are all that a level needs."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    total = np.full(len(y), base)
    out = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = node - first
            best_gain = np.full(width, 1e-6)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * BINS + binned[:, f]
                gl = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hl = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                nl = np.bincount(key, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain = np.where((nl >= LEAST_CHILD) & (nt - nl >= LEAST_CHILD), gain, 0)[:, : len(c)]
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                better = value > best_gain
                best_gain[better] = value[better]
                feature[first : first + width][better] = f
                cut[first : first + width][better] = c[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += value[leaf]
        out.append((feature, cut, value))
    return Trees(base, *(np.stack(x) for x in zip(*out, strict=True)))


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of every document."""

    def run(batches):
        for b in batches:
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), ta.arrays(list(x), pa.float32())], names=["doc_id", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, x array<float>")


def train(table: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Trees:
    """Trees from the labelled rows of the table whose crc32 remainder by 4 isn't 2."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    rows = table.join(known, "doc_id").where(common.crc_remainder(F.col("doc_id"), 4) != 2)
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x", "y").limit(most_rows).select("x", "y").toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(NAMES))
    return fitted(x, got["y"].to_numpy().astype(float))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    table = common.written(statistics_table(docs), "statistics")
    trees = train(table, labels)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.scores(x))], names=["doc_id", "score"])

    got = table.mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", (common.crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the documents whose score is below the threshold."""
    trees = train(common.written(statistics_table(docs), "statistics"), labels)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(trees.scores(statistics(b.column(at)).astype(np.float64)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
