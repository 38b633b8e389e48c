"""N-gram Jaccard join by signature trees: connected groups of documents whose shingle sets are alike.

Two texts link when pct percent of the union of their shingle sets is common (sets of 64-bit hashes of five words).
Equal sets are one class, named by a hash of the set. Every set has a bitmap, four bits or more for each shingle. A tree
over a block of sets holds, in each node, the OR of the bitmaps below and the range of set sizes; traversing two trees
together drops a pair of nodes if the greatest overlap that bitmaps and sizes allow is too small for a link.

Blocks come from two rules. (1) Band keys of min-hashes bring together most groups of near copies; links found there are
verified on the sets, and members that are linked already are not compared again. This step only saves work.
(2) Two linked sets share one of the first n - needed + 1 shingles in any fixed order (here: by hash, with the most
frequent ones last), so blocks by those shingles hold every link. Only blocks with members of different groups are
looked at, each distinct membership once; what the trees leave is verified on the sets. Large blocks are cut into tiles
and pairs of tiles, so no task holds a whole block. All links between different groups are found, none is capped.

Texts without words and null texts have the empty set and link with nothing. Repeated rows are in one group. An
empty table gives no row. The hash of a set has 64 bits: some billions of different texts can be told apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlake.llm import common, textarrays as ta

PCT = 80
BANDS = 3
TILE = 512
FANOUT = 8
#: Pairs of one block that are kept for each two groups in the first traversal.
MOST = 32
#: Shingles in at least HOT_FROM documents, HOT_MOST of them at most, come last in the order (it stays one order for all).
HOT_FROM, HOT_MOST = 64, 100_000
_ODD = np.uint64(0xA24BAED4963EE407)


def needed(n: int, pct: int = PCT) -> int:
    """Least overlap with any linked set."""
    return -(-pct * n // 100)


def name_of(x: np.ndarray) -> int:
    """A hash of a set, as a signed long."""
    h = int((ta.mix(x * _ODD).sum(dtype=np.uint64)) ^ np.uint64(len(x)))
    return h - (1 << 64) if h >= 1 << 63 else h


def bands_of(x: np.ndarray, bands: int = BANDS) -> list[int]:
    """Each band hashes two min-hashes, the least shingles of two of 2 * bands slices of a permuted hash range."""
    y = np.sort(ta.mix(x * _ODD))
    slots = 2 * bands
    at = np.searchsorted(y, np.arange(slots, dtype=np.uint64) * np.uint64(2**64 // slots))
    low = y[np.minimum(at, len(y) - 1)]
    with np.errstate(over="ignore"):
        key = ta.mix(low[0::2] * ta.STEP + low[1::2] + np.arange(bands, dtype=np.uint64))
    return key.view(np.int64).tolist()


def bitmap_words(n: int) -> int:
    return max(1, 1 << max(0, (4 * n - 1).bit_length() - 6))


def bitmap(x: np.ndarray, words: int) -> np.ndarray:
    bit = (x >> np.uint64(20)) & np.uint64(64 * words - 1)
    out = np.zeros(64 * words, np.uint8)
    out[bit.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def linked(a: np.ndarray, b: np.ndarray, pct: int = PCT) -> bool:
    n = len(a) + len(b)
    return min(len(a), len(b)) * 100 >= pct * max(len(a), len(b)) and overlap(a, b) * (100 + pct) >= pct * n


# --- trees ---------------------------------------------------------------------------------------------------


class Tree:
    """Levels of nodes over sets sorted as given: bits, least and greatest size, greatest number of shingles that share
    a bit with another one of their set."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        spare = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, spare)]
        while len(self.levels[-1][0]) > FANOUT:
            bits, lo, hi, spare = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(spare, at)))


def _possible(a, b, i: np.ndarray, j: np.ndarray, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Which node pairs can hold a link, and the greatest overlap of each."""
    (bits_a, lo_a, hi_a, spare_a), (bits_b, lo_b, hi_b, spare_b) = a, b
    keep = np.flatnonzero((hi_a[i] * 100 >= pct * lo_b[j]) & (hi_b[j] * 100 >= pct * lo_a[i]))
    step = max(1, (1 << 18) // bits_a.shape[1])
    out, bound = [keep[:0]], [keep[:0]]
    for s in range(0, len(keep), step):
        k = keep[s : s + step]
        x, y = i[k], j[k]
        common_bits = np.bitwise_count(bits_a[x] & bits_b[y]).sum(axis=1).astype(np.int64)
        most = np.minimum(np.minimum(spare_a[x], spare_b[y]) + common_bits, np.minimum(hi_a[x], hi_b[y]))
        ok = most * (100 + pct) >= pct * (lo_a[x] + lo_b[y])
        out.append(k[ok])
        bound.append(most[ok])
    return np.concatenate(out), np.concatenate(bound)


def traverse(a: Tree, b: Tree, pct: int = PCT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) that can be linked, and the greatest overlap of each; of a tree with itself only i < j."""
    depth = min(len(a.levels), len(b.levels)) - 1
    top_a, top_b = a.levels[depth], b.levels[depth]
    i, j = (x.ravel() for x in np.indices((len(top_a[0]), len(top_b[0]))))
    for level in range(depth, -1, -1):
        if a is b:
            ok = i <= j if level else i < j
            i, j = i[ok], j[ok]
        keep, bound = _possible(a.levels[level], b.levels[level], i, j, pct)
        i, j = i[keep], j[keep]
        if level:
            n_a, n_b = len(a.levels[level - 1][0]), len(b.levels[level - 1][0])
            fan = np.arange(FANOUT)
            i = (i[:, None, None] * FANOUT + fan[None, :, None] + 0 * fan[None, None, :]).ravel()
            j = (j[:, None, None] * FANOUT + 0 * fan[None, :, None] + fan[None, None, :]).ravel()
            ok = (i < n_a) & (j < n_b)
            i, j = i[ok], j[ok]
    return i, j, bound


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def candidates(bits: list[np.ndarray], sizes: np.ndarray, pct: int = PCT, left: int | None = None):
    """Pairs of positions that can be linked and how large the common part may be, by the trees of sets with equally wide bitmaps and of those with bitmaps
    twice as wide. With `left`, only pairs of one position below it and one from it on."""
    words = np.array([len(b) for b in bits])
    parts = np.zeros(len(bits), bool) if left is None else np.arange(len(bits)) >= left
    groups = {}
    for w in np.unique(words).tolist():
        for p in (False, True):
            at = np.flatnonzero((words == w) & (parts == p))
            if len(at):
                groups[w, p] = at, np.stack([bits[k] for k in at])
    for (w, p), (at, m) in groups.items():
        for (v, q), (to, n) in groups.items():
            if v not in (w, 2 * w) or (left is not None and p == q) or (v == w and p > q):
                continue
            one = Tree(m, sizes[at])
            two = one if at is to else Tree(folded(n, w), sizes[to])
            i, j, bound = traverse(one, two, pct)
            if len(i):
                yield at[i], to[j], bound / np.maximum(sizes[at[i]], sizes[to[j]])


def spanning_links(sets: list[np.ndarray], pct: int = PCT) -> list[tuple[int, int]]:
    """Verified links that connect what links connect among the sets, no more than one fewer than sets."""
    sizes = np.array([len(s) for s in sets])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j, _ in candidates([bitmap(s, bitmap_words(len(s))) for s in sets], sizes, pct):
        near = np.argsort(np.abs(i - j), kind="stable")
        for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
            a, b = find(x), find(y)
            if a != b and linked(sets[x], sets[y], pct):
                root[b] = a
                out.append((x, y))
    return out


# --- passes over the texts -----------------------------------------------------------------------------------


def _hot(docs: DataFrame, hot_from: int, hot_most: int) -> np.ndarray:
    """Hashes of very frequent shingles. Counts are of shingles found twice in the same run of rows, so of all those that
    are frequent; the choice only changes the order of shingles, not what is found."""

    def count(batches):
        for b in batches:
            sets, n = [], 0
            for s in ta.shingle_sets(b.column(0)):
                sets.append(s)
                n += len(s)
                if n > 1 << 21:
                    yield repeated(sets)
                    sets, n = [], 0
            if sets:
                yield repeated(sets)

    def repeated(sets):
        every = np.sort(np.concatenate(sets))
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(every)))
        more = n >= 2
        return pa.RecordBatch.from_arrays([pa.array(every[first[more]].view(np.int64)), pa.array(n[more], pa.int64())], names=["h", "n"])

    got = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_from).orderBy(F.desc("n"), "h").limit(hot_most)
    return np.sort(got.toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))


def _within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _summaries(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, cls, bands and bitmap of every document."""

    def run(batches):
        for b in batches:
            n, cls, bands, bits = [], [], [], []
            for s in ta.shingle_sets(b.column(1)):
                n.append(len(s))
                cls.append(name_of(s))
                bands.append(bands_of(s) if len(s) else [])
                bits.append(bitmap(s, bitmap_words(len(s))).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "cls", "bands", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cls long, bands array<long>, bits binary")


def _once(docs: DataFrame, rows_of, schema: str) -> DataFrame:
    """rows_of(set, cls) of every text; a text met again in the same task gives nothing."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            out, size = [], 0
            for s in ta.shingle_sets(b.column(0)):
                if not len(s):
                    continue
                cls = name_of(s)
                if cls in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(cls)
                got = rows_of(s, cls)
                if got is not None:
                    out.append(got)
                    size += sum(getattr(c, "nbytes", 0) or len(c) for c in got)
                if size > 1 << 22:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    def batch(out):
        cols = [pa.array(np.concatenate([r[k] for r in out]) if t != pa.binary() else [x for r in out for x in r[k]], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("text").mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, form) -> DataFrame:
    """(cls, n, items) of each wanted class, once; items: the bytes of form(set)."""
    bits = common.key_filter(wanted.select("cls"))

    def rows_of(s, cls):
        c = np.array([cls], np.int64)
        return (c, np.array([len(s)]), [form(s).tobytes()]) if common.passes(bits, c)[0] else None

    got = _once(docs, rows_of, "cls long, n long, items binary")
    return got.join(wanted.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])


def _band_links(docs: DataFrame, summaries: DataFrame, pct: int) -> DataFrame:
    """Verified links (a, b) of classes that share a band key."""
    keys = summaries.where("n_shingles > 0").select("cls", "bands").dropDuplicates(["cls"]).select("cls", F.explode("bands").alias("key"))
    counts = common.written(keys.groupBy("key").count().where("count > 1"), "band-keys")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    bits = common.key_filter(counts.select("key"))
    large = max(8 * TILE, total // 10_000)  # so there are 10,000 at most
    hot = {r["key"]: -(-r["count"] // (4 * TILE)) for r in counts.where(F.col("count") > large).collect()}

    def rows_of(s, cls):
        key = np.array(bands_of(s), np.int64)
        key = key[common.passes(bits, key)]
        if not len(key):
            return None
        salt = np.array([int(ta.mix(np.array([cls ^ k], np.int64).view(np.uint64))[0] % np.uint64(hot[k])) if k in hot else 0 for k in key.tolist()], np.int64)
        return key, salt, np.full(len(key), cls), np.full(len(key), len(s)), [s.tobytes()] * len(key)

    rows = _once(docs, rows_of, "key long, salt long, cls long, n long, items binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "n", "cls")

    def link(batches):
        block, cls, sets, held = None, [], [], 0
        for b in batches:
            for key, salt, c, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4), strict=True):
                if (key, salt) != block or len(cls) == TILE or held > 1 << 24:
                    carry = []
                    if len(cls) > 1:
                        links = spanning_links(sets, pct)
                        if links:
                            yield edges([cls[i] for i, _ in links], [cls[j] for _, j in links])
                        if (key, salt) == block:  # one member of each group found goes on to the next tile
                            later = {j for _, j in links}
                            carry = [i for i in range(len(cls)) if i not in later][-TILE // 8 :]
                    cls, sets = [cls[i] for i in carry], [sets[i] for i in carry]
                    block, held = (key, salt), sum(s.nbytes for s in sets)
                if cls and cls[-1] == c:
                    continue
                cls.append(c)
                sets.append(np.frombuffer(items.as_py(), np.uint64))
                held += sets[-1].nbytes
        if len(cls) > 1:
            links = spanning_links(sets, pct)
            if links:
                yield edges([cls[i] for i, _ in links], [cls[j] for _, j in links])

    def edges(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(link, "a long, b long")


def _postings(docs: DataFrame, hot: np.ndarray, pct: int) -> DataFrame:
    """(token, cls) for the first shingles, in the order, of every text."""

    def rows_of(s, cls):
        p = len(s) - needed(len(s), pct) + 1
        late = _within(hot, s)
        first = s[~late][:p]
        if len(first) < p:
            first = np.concatenate([first, s[late][: p - len(first)]])
        return first.view(np.int64), np.full(len(first), cls)

    return _once(docs, rows_of, "token long, cls long")


def _passing(posted: DataFrame, bits: np.ndarray) -> DataFrame:
    """The postings whose token passes the filter."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(common.passes(bits, b.column(0).to_numpy())))

    return posted.mapInArrow(run, posted.schema)


def most_likely(x: np.ndarray, y: np.ndarray, bound: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the `most` pairs of greatest bound for each two roots (x, y), and whether those roots have more."""
    order = np.lexsort((-bound, y, x))
    start = np.flatnonzero(np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])]))
    count = np.diff(np.append(start, len(order)))
    keep = np.arange(len(order)) - np.repeat(start, count) < most
    return order[keep], np.repeat(count > most, count)[keep]


def _pairs(blocks: DataFrame, bits: DataFrame, pct: int, most: int | None) -> DataFrame:
    """Pairs (a, b) of classes of different roots (x, y) in one block that the trees leave; with `most`, no more than that
    for each two roots of a block, and `more` tells whether they have others. blocks: token, n, cls, root, members
    (rows of the block). Blocks of up to TILE members are read in one stream; larger ones are cut into tiles of
    the order by size, and each pair of tiles whose sizes fit is a block of its own."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = blocks.where(F.col("members") <= TILE).select("token", F.lit(0).alias("side"), "n", "cls", "root")
    large = common.written(blocks.where(F.col("members") > TILE), "large-blocks")
    streams = [small]
    if not large.isEmpty():
        at = common.numbered(large, ["token", "n", "cls"], "large-order")
        at = common.written(at.withColumn("tile", F.floor(F.col("rank") / (TILE // 2))), "large-tiles")
        nodes = at.groupBy("token", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        two = nodes.select("token", *[F.col(c).alias(f"{c}_") for c in ("tile", "lo", "hi", "r0", "r1")])
        fit = nodes.join(two, "token").where((F.col("tile") <= F.col("tile_")) & (F.col("hi") * 100 >= F.col("lo_") * pct) & ~((F.col("r0") == F.col("r1")) & (F.col("r0_") == F.col("r1_")) & (F.col("r0") == F.col("r0_"))))
        fit = fit.select("token", F.xxhash64("token", "tile", "tile_").alias("pair"), F.explode(F.array_distinct(F.array(F.struct("tile", F.lit(0).alias("side")), F.struct(F.col("tile_").alias("tile"), (F.col("tile") != F.col("tile_")).cast("int").alias("side"))))).alias("x"))
        streams.append(fit.select("token", "pair", "x.tile", "x.side").join(at, ["token", "tile"]).select(F.col("pair").alias("token"), "side", "n", "cls", "root"))
    rows = streams[0] if len(streams) == 1 else streams[0].unionByName(streams[1])
    # bitmaps are many times as wide as the rest, so they join last and no written table of blocks holds them
    rows = rows.join(bits.select("cls", "bits"), "cls").select("token", "side", "n", "cls", "root", "bits")
    rows = rows.repartition(parts, "token").sortWithinPartitions("token", "side", "n", "cls")

    def run(batches):
        block, held = None, []
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(6)]
            for row in zip(*cols, strict=True):
                if row[0] != block:
                    if len(held) > 1:
                        yield from found(held)
                    block, held = row[0], []
                held.append(row)
        if len(held) > 1:
            yield from found(held)

    def found(held):
        sizes = np.array([r[2] for r in held])
        root = np.array([r[4] for r in held])
        cls = np.array([r[3] for r in held])
        left = sum(r[1] == 0 for r in held)
        for i, j, bound in candidates([np.frombuffer(r[5], np.uint64) for r in held], sizes, pct, left if left < len(held) else None):
            ok = np.flatnonzero(root[i] != root[j])
            if not len(ok):
                continue
            a, b, x, y = cls[i[ok]], cls[j[ok]], root[i[ok]], root[j[ok]]
            cols = [np.minimum(a, b), np.maximum(a, b), np.minimum(x, y), np.maximum(x, y), bound[ok]]
            at, more = most_likely(*cols[2:], most or len(ok))
            yield pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in cols], pa.array(more)], names=["a", "b", "x", "y", "bound", "more"])

    found_pairs = rows.mapInArrow(run, "a long, b long, x long, y long, bound double, more boolean")
    once = [F.min("x").alias("x"), F.min("y").alias("y"), F.max("bound").alias("bound"), F.max("more").alias("more")]
    return found_pairs.groupBy("a", "b").agg(*once)


def _mixed(posted: DataFrame, roots: DataFrame, bits: DataFrame) -> DataFrame:
    """The blocks whose members have different roots, each membership once, with sizes."""
    rooted = roots.select(F.col("id").alias("cls"), "root")
    posted = posted.join(rooted, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    blocks = posted.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("cls")).alias("same")).where("r0 <> r1")
    blocks = blocks.groupBy("members", "same").agg(F.min("token").alias("token")).select("token", "members")
    return posted.join(blocks, "token").join(bits.select("cls", "n"), "cls")


def wide_bitmap(x: np.ndarray) -> np.ndarray:
    """A bitmap of 16 bits or more for each shingle."""
    return bitmap(x, 4 * bitmap_words(len(x)))


def may_link(a: np.ndarray, b: np.ndarray, n: int, m: int, pct: int = PCT) -> bool:
    """Whether sets of n and m shingles with these bitmaps can be linked."""
    words = min(len(a), len(b))
    x, y = folded(a[None, :], words)[0], folded(b[None, :], words)[0]
    common_bits = int(np.bitwise_count(x & y).sum())
    most = min(n - int(np.bitwise_count(x).sum()), m - int(np.bitwise_count(y).sum())) + common_bits
    return min(most, n, m) * (100 + pct) >= pct * (n + m)


def _filtered(docs: DataFrame, pairs: DataFrame, form, test, name: str) -> DataFrame:
    """The pairs whose sets, in that form, pass the test."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = common.written(_sets(docs, wanted, form), name)
    one, two = (sets.select(F.col("cls").alias(c), F.col("n").alias(n), F.col("items").alias(x)) for c, n, x in (("a", "na", "x"), ("b", "nb", "y")))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")

    def run(batches):
        for b in batches:
            rows = zip(b.column(2), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)
            ok = [test(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), n, m) for x, y, n, m in rows]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "x", "y", "na", "nb").mapInArrow(run, "a long, b long")


def _near(docs: DataFrame, pairs: DataFrame, pct: int) -> DataFrame:
    """The pairs that pass wide bitmaps, a quarter of the sets' size; few of them are not linked."""
    return common.written(_filtered(docs, pairs, wide_bitmap, lambda x, y, n, m: may_link(x, y, n, m, pct), "pair-bitmaps"), "near-pairs")


def _verified(docs: DataFrame, near: DataFrame, pct: int) -> DataFrame:
    """The pairs that are linked."""
    return common.written(_filtered(docs, near, lambda s: s, lambda x, y, n, m: linked(x, y, pct), "pair-sets"), "more-links")


def _apart(pairs: DataFrame, roots: DataFrame, one: str, two: str) -> DataFrame:
    """The pairs of ids that have different roots by now."""
    known = lambda c, r: roots.select(F.col("id").alias(c), F.col("root").alias(r))
    rooted = pairs.join(known(one, "_r1"), one, "left").join(known(two, "_r2"), two, "left")
    return rooted.where(F.coalesce("_r1", one) != F.coalesce("_r2", two)).drop("_r1", "_r2")


def _all_links(docs: DataFrame, posted: DataFrame, links: DataFrame, bits: DataFrame, pct: int, most: int) -> DataFrame:
    """Roots of the classes by all links. The blocks are traversed once, which leaves some pairs for each two groups. Of
    those that pass wide bitmaps the likeliest of each two groups is verified first, as most groups meet through it, then
    all whose groups still are apart. Groups that are, and had more pairs, are traversed again in full."""
    before = common.connected(links, "band-groups")
    pairs = common.written(_pairs(common.written(_mixed(posted, before, bits), "blocks"), bits, pct, most), "pairs")
    if pairs.isEmpty():
        return before
    near = common.written(_near(docs, pairs, pct).join(pairs, ["a", "b"]), "near-rooted")
    first = common.written(near.groupBy("x", "y").agg(F.max(F.struct("bound", "a", "b")).alias("p")).select("p.a", "p.b"), "likeliest")
    links = links.unionByName(_verified(docs, first, pct))
    roots = common.connected(links, "groups")
    rest = common.written(_apart(near.select("a", "b").join(first, ["a", "b"], "left_anti"), roots, "a", "b"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_verified(docs, rest, pct))
        roots = common.connected(links, "groups")
    cut = common.written(_apart(pairs.where("more").select("x", "y").distinct(), roots, "x", "y"), "cut")
    if not cut.isEmpty():
        groups_left = cut.select(F.explode(F.array("x", "y")).alias("_root")).distinct()
        old = before.select(F.col("id").alias("cls"), "root")
        left = posted.join(old, "cls", "left").withColumn("_root", F.coalesce("root", "cls")).join(groups_left, "_root", "left_semi").select("token", "cls")
        more = _pairs(common.written(_mixed(common.written(left, "postings-left"), roots, bits), "blocks"), bits, pct, None)
        more = common.written(more.select("a", "b").join(pairs, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            links = links.unionByName(_verified(docs, _near(docs, more, pct), pct))
            roots = common.connected(links, "groups")
    return roots


def groups(docs: DataFrame, pct: int = PCT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id of the group) of every row, and cls."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.select("text")
    summaries = common.written(_summaries(docs), "set-summaries")
    links = common.written(_band_links(docs, summaries, pct), "band-links")
    hot = _hot(texts, HOT_FROM, HOT_MOST)
    every = common.written(_postings(docs, hot, pct), "first-shingles")
    shared = every.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("token")
    shared = common.written(shared, "shared-tokens")
    posted = _passing(every, common.key_filter(shared)).distinct().join(shared, "token", "left_semi")
    posted = common.written(posted, "postings")
    bits = common.written(summaries.where("n_shingles > 0").select("cls", F.col("n_shingles").alias("n"), "bits").dropDuplicates(["cls"]), "bitmaps")
    roots = _all_links(docs, posted, links, bits, pct, MOST)
    least = summaries.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    least = least.join(roots.select(F.col("id").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = common.written(least, "class-roots")
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(of_root, "root").select("cls", "component_id")
    out = summaries.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "cls")


def representatives(docs: DataFrame, pct: int = PCT) -> DataFrame:
    """docs, all columns, with one document of each group: that of the least doc_id. Rows repeated with one id and text are
    one document; rows of one id and different texts stay or go together. Documents without words all stay. Most rows
    pass by a filter of fixed size and are not moved; an exact join decides on the others."""
    found = common.written(groups(docs, pct).select("doc_id", "component_id", "n_shingles"), "group-rows")
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0))
    ids = found.groupBy("doc_id").agg(stays.alias("stays"), F.count_if(F.col("n_shingles") > 0).alias("rows"))
    doubtful = common.written(ids.where(~F.col("stays") | (F.col("rows") > 1)), "doubtful-ids")
    bits = common.key_filter(doubtful.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id")))
    at = docs.columns.index("doc_id")

    def part(wanted: bool):
        def run(batches):
            for b in batches:
                key = b.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield b.filter(pa.array(common.passes(bits, key) == wanted))

        return docs.mapInArrow(run, docs.schema)

    own = F.col("doc_id").cast("long")
    gone = doubtful.where(~F.col("stays")).select(F.col("doc_id").alias("_st_gone"))
    more = doubtful.where(F.col("stays")).select(F.col("doc_id").alias("_st_more"))
    looked_at = part(True).join(gone, own.eqNullSafe(F.col("_st_gone")), "left_anti")
    single = looked_at.join(more, own.eqNullSafe(F.col("_st_more")), "left_anti")
    repeated = looked_at.join(more, own.eqNullSafe(F.col("_st_more")), "left_semi").dropDuplicates(["doc_id", "text"])
    return part(False).unionByName(single).unionByName(repeated)
