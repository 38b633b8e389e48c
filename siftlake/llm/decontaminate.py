"""Benchmark decontamination by SimHash over windows of an item's size.

Words are runs of letters and digits (ASCII ones and all bytes beyond ASCII), A-Z lower-cased. A text's features are its
five-word shingles; a shingle weighs 1 / (number of different benchmark texts that have it). Compared with an item, one that
the item doesn't have weighs at most the mean of the item's shingles, so that neither repeated items nor templates lower a
near copy's similarity. For each item length, windows of as many words get a 64-bit SimHash, in which shingles that no item
has weigh that mean, rounded down to a power of STEP. The hash is read as eight blocks of eight bits: two hashes
within RADIUS differ in at most RADIUS // 8 bits of some block, so looking up all near values of each block finds every
item within the radius. For those the weighted Jaccard similarity of window and item decides.
A window without any of an item's shingles can't be similar to it, so only windows around such shingles are hashed.

Items of fewer than five words are not searched: by chance they stand anywhere. Null and empty texts match nothing. A
document shorter than an item is one window. Repeated rows and items each give their result; of equal similarity the
first place counts. The benchmark is read in slices of bounded size. An empty benchmark matches nothing.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlake.llm import textarrays as ta

LEAST = 0.8
RADIUS = 23
#: Items whose mean weights round down to the same power share the hashes of windows.
STEP = 0.8
#: Bytes of benchmark text that a task holds at once; a larger benchmark takes more passes.
SLICE_BYTES = 8 << 20
BLOCKS = 8


def _shingles_of(column: pa.Array):
    """Words and shingle hashes of each text."""
    data, offsets = ta.raw(column)
    for lo, hi in ta.ranges(offsets):
        w = ta.words(data, offsets, lo, hi, ta.ALNUM)
        s = ta.shingles(w)
        for i in range(hi - lo):
            yield int(w.first[i + 1] - w.first[i]), s.hashes[s.first[i] : s.first[i + 1]]


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each hash."""
    bits = np.unpackbits(np.ascontiguousarray(ta.mix(hashes)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float64) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """The SimHash of each row of 64 sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint64)[:, 0]


class Index:
    """Items of one slice: their shingles with weights, SimHashes and the table of blocks."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], weights: dict[int, float]):
        self.ids = [i for i, _, _ in items]
        self.words = np.array([n for _, n, _ in items], np.int64)
        self.weights = weights
        self.bags = [Counter(h.tolist()) for _, _, h in items]
        self.totals = np.array([sum(weights[x] * n for x, n in bag.items()) for bag in self.bags])
        self.means = self.totals / np.maximum(1, [len(h) for _, _, h in items])
        self.levels = np.floor(np.log(np.maximum(self.means, 1e-9)) / np.log(STEP) * -1 - 1e-9).astype(np.int64)
        self.known = np.sort(np.array(list(weights), np.uint64))
        self.known_weights = np.array([weights[x] for x in self.known.tolist()])
        self.sizes_of: dict[int, set[tuple[int, int]]] = {}
        for n, level, bag in zip(self.words.tolist(), self.levels.tolist(), self.bags, strict=True):
            for x in bag:
                self.sizes_of.setdefault(x, set()).add((n, level))
        prints = [packed((signs(h) * self.weigh(h)[:, None]).sum(axis=0)[None, :])[0] for _, _, h in items]
        self.prints = np.array(prints, np.uint64)
        rows = -(-max(1, len(items)) // 64)
        self.table = np.zeros((BLOCKS, 256, rows), np.uint64)
        near = [sum(1 << b for b in at) for k in range(RADIUS // BLOCKS + 1) for at in combinations(range(8), k)]
        for i, p in enumerate(np.array(prints, np.uint64).view(np.uint8).reshape(-1, 8)):
            for k in range(BLOCKS):
                self.table[k, p[k] ^ np.array(near), i // 64] |= np.uint64(1 << (i % 64))

    def weigh(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(h))
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.known_weights[at], 1.0)

    def has(self, h: np.ndarray) -> np.ndarray:
        return self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h if len(self.known) else np.zeros(len(h), bool)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) whose hashes are within the radius."""
        blocks = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, BLOCKS)
        hit = self.table[0][blocks[:, 0]]
        for k in range(1, BLOCKS):
            hit = hit | self.table[k][blocks[:, k]]
        bits = np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")[:, : len(self.ids)]
        window, item = np.nonzero(bits)
        ok = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return window[ok], item[ok]

    def search(self, n: int, h: np.ndarray, hits: np.ndarray, least: float) -> dict[int, tuple[float, int, int, int]]:
        """Of a document of n words and shingles h: item -> (similarity, -first word, words, distance) of its best window."""
        best: dict[int, tuple[float, int, int, int]] = {}
        known, weights = self.has(h), self.weigh(h)
        wanted: dict[tuple[int, int], list[int]] = {}
        for at in hits.tolist():
            for size in self.sizes_of[int(h[at])]:
                wanted.setdefault(size, []).append(at)
        for (size, level), places in wanted.items():
            width = max(1, min(size, n) - ta.SHINGLE + 1)  # shingles in a window
            reach = np.zeros(len(h) - width + 2, np.int64)
            np.add.at(reach, np.maximum(np.array(places) - width + 1, 0), 1)
            np.add.at(reach, np.minimum(np.array(places), len(h) - width) + 1, -1)
            start = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
            for s in range(0, len(start), 4096):
                self._windows(start[s : s + 4096], width, min(size, n), h, np.where(known, weights, STEP**level), weights, level, least, best)
        return best

    def _windows(self, start, width, words, h, hashed, weights, level, least, best) -> None:
        lo, hi = int(start[0]), int(start[-1]) + width
        own = h[lo:hi]
        sums = np.zeros((len(own) + 1, 64))
        np.cumsum(signs(own) * hashed[lo:hi, None], axis=0, out=sums[1:])
        total = np.concatenate([[0], np.cumsum(weights[lo:hi])])
        a = start - lo
        prints = packed(np.round(sums[a + width] - sums[a], 9))
        whole = total[a + width] - total[a]
        for w, i in zip(*self.within(prints), strict=True):
            if self.levels[i] != level or whole[w] < (least - 1e-9) * self.totals[i]:
                continue
            bag, item = Counter(h[start[w] : start[w] + width].tolist()), self.bags[i]
            both = sum(self.weights[x] * min(n, bag[x]) for x, n in item.items() if x in bag)
            window = sum(n * (self.weights[x] if x in item else min(self.weights.get(x, 1.0), self.means[i])) for x, n in bag.items())
            share = both / (window + self.totals[i] - both)
            if share >= least - 1e-9:
                found = (round(float(share), 6), -int(start[w]), words, int(np.bitwise_count(prints[w] ^ self.prints[i])))
                best[int(i)] = max(best.get(int(i), found), found)


def indexes(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES):
    """An index of each slice of the benchmark."""

    def run(batches):
        for b in batches:
            got = [(i, n, h) for i, (n, h) in enumerate(_shingles_of(b.column(1))) if n >= ta.SHINGLE]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _, _ in got], pa.int64())), pa.array([n for _, n, _ in got], pa.int64()), ta.arrays([h.view(np.int64) for _, _, h in got], pa.int64())], names=["item_id", "n", "h"])

    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    items = texts.mapInArrow(run, "item_id long, n long, h array<long>").withColumn("slice", F.pmod(F.xxhash64("h", "item_id"), F.lit(slices)))
    counts = items.select("h").distinct().select(F.explode(F.array_distinct("h")).alias("x")).groupBy("x").agg(F.count("*").alias("items"))
    for k in range(slices):
        own = items.where(F.col("slice") == k)
        got = own.orderBy("item_id", "n").toArrow()
        rows = [(i, n, np.array(h, np.int64).view(np.uint64)) for i, n, h in zip(got["item_id"].to_pylist(), got["n"].to_pylist(), got["h"].to_pylist(), strict=True)]
        used = counts.join(own.select(F.explode("h").alias("x")).distinct(), "x", "left_semi").toArrow()
        weights = dict(zip(used["x"].to_numpy().astype(np.int64).view(np.uint64).tolist(), (1 / used["items"].to_numpy()).tolist(), strict=True)) if used.num_rows else {}
        if rows:
            yield Index(rows, weights)


def _found(index: Index, column: pa.Array, least: float):
    """Of each text with a match: its row and what search gives."""
    for row, (n, h) in enumerate(_shingles_of(column)):
        if n < ta.SHINGLE:
            continue
        hits = np.flatnonzero(index.has(h))
        if len(hits):
            best = index.search(n, h, hits, least)
            if best:
                yield row, best


MATCHES = "doc_id long, item_id long, similarity double, first_word long, n_words long, distance int"


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The best window of each document and item that are similar."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in indexes(benchmark):

        def run(batches, index=index):
            for b in batches:
                got = [(row, index.ids[i], *x) for row, best in _found(index, b.column(1), least) for i, x in sorted(best.items())]
                col = lambda k, t: pa.array([g[k] for g in got], t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column(0).take(col(0, pa.int64())), col(1, pa.int64()), col(2, pa.float64()), pa.array([-g[3] for g in got], pa.int64()), col(4, pa.int64()), col(5, pa.int32())], names=["doc_id", "item_id", "similarity", "first_word", "n_words", "distance"])

        part = texts.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], MATCHES) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """docs, all columns, without the documents that hold an item."""
    at = docs.columns.index("text")
    for index in indexes(benchmark):

        def run(batches, index=index):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[row for row, _ in _found(index, b.column(at), least)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
