"""Suffix-array deduplication: bytes covered by strings of n bytes that stand elsewhere too.

Every string of n bytes has an anchor: its k-gram of least hash, the leftmost of equals. Equal strings have equal anchors
at equal distances, so strings need to be compared only within an anchor's hash. Neighbouring strings with one anchor are
a window. Windows whose anchor occurs once are dropped; windows of equal content are handled as one, by count;
the different windows of one anchor are sorted as suffixes, where a string that occurs before has its earlier match as
neighbour (longest previous factor of n bytes or more). Anchors with very many different windows are not sorted in one
task: each string is hashed, and equal hashes are counted, which gives the same strings.

keep="none" removes every byte of such strings, keep="first" all but the first place (by doc_id, then position).
Strings never cross documents and are judged on the input. Null texts are empty and keep nothing to remove. Rows with
equal doc_id and text are treated alike (with keep="first" both stay if they are the first). Long texts are read in
overlapping parts. An empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from siftlake.llm import common, textarrays as ta

N = 400
#: Different windows of one anchor that are sorted in one task.
SORTED = 512
PLACE = (1 << 24) - 1


def gram(n: int) -> int:
    return max(1, n // 4)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every i."""
    size = -(-len(x) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - w + 1], ahead[w - 1 : len(x)])


def windows(data: np.ndarray, ends: np.ndarray, n: int):
    """Of texts that lie one after another and end at `ends`: anchor hash, content hash, anchor, first and last start of
    each window, as arrays."""
    k = gram(n)
    if len(data) < n:
        return None
    begins = np.concatenate([[0], ends[:-1]])
    fits = ends - begins >= n
    if not fits.any():
        return None
    sums = ta.prefix_sums(data)
    at = np.arange(len(data) - k + 1)
    hashes = ta.span_hashes(sums, at, at + k)
    low = sliding_min((hashes & ~np.uint64(PLACE)) | at.astype(np.uint64), n - k + 1)
    anchor = (low & np.uint64(PLACE)).astype(np.int64)
    mark = np.zeros(len(anchor) + 1, np.int8)
    mark[begins[fits]] += 1
    np.add.at(mark, ends[fits] - n + 1, -1)
    start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    a = anchor[start]
    cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(start) != 1)) + 1
    first, last = start[np.concatenate([[0], cut])], start[np.concatenate([cut - 1, [len(start) - 1]])]
    a = a[np.concatenate([[0], cut])]
    content = ta.mix(ta.span_hashes(sums, first, last + n) + (a - first).astype(np.uint64) * ta.STEP)
    return hashes[a], content, a, first, last


def _parts(column: pa.Array, n: int):
    """(rows, data, ends, places in their texts): whole texts together, a very long one in overlapping parts."""
    data, offsets = ta.raw(column)
    for lo, hi in ta.ranges(offsets):
        b, e = int(offsets[lo]), int(offsets[hi])
        if e - b <= 2 * ta.LIMIT:
            yield np.arange(lo, hi), data[b:e], offsets[lo + 1 : hi + 1] - b, np.concatenate([[0], offsets[lo + 1 : hi] - b]), 0
        else:
            for s in range(b, e - n + 1, ta.LIMIT):
                part = data[s : min(e, s + ta.LIMIT + n - 1)]
                yield np.arange(lo, hi), part, np.array([len(part)]), np.array([0]), s - b


def _anchors(texts: DataFrame, n: int) -> DataFrame:
    """(h, c) of every window."""

    def run(batches):
        for b in batches:
            for _, data, ends, _, _ in _parts(b.column(0), n):
                got = windows(data, ends, n)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[0].view(np.int64)), pa.array(got[1].view(np.int64))], names=["h", "c"])

    return texts.mapInArrow(run, "h long, c long")


def _occurrences(docs: DataFrame, n: int, again: np.ndarray, mixed: np.ndarray) -> DataFrame:
    """Windows whose anchor passes `again`: doc_id, doc_key, h, c, place of the anchor, its distance from the last and
    first start, and once a task the bytes of each content whose anchor passes `mixed`."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for rows, data, ends, begins, shift in _parts(b.column(2), n):
                got = windows(data, ends, n)
                if got is None:
                    continue
                keep = common.passes(again, got[0])
                h, c, a, first, last = (x[keep] for x in got)
                if not len(h):
                    continue
                doc = np.searchsorted(ends, first, side="right")
                sent = common.passes(mixed, h)
                content = []
                for hash_, s, e, send in zip(c.tolist(), first.tolist(), (last + n).tolist(), sent.tolist(), strict=True):
                    new = send and hash_ not in seen
                    if new:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(hash_)
                    content.append(data[s:e].tobytes() if new else None)
                row = pa.array(rows[doc])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(row), b.column(1).take(row), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(a - begins[doc] + shift),
                    pa.array((a - last).astype(np.int32)), pa.array((a - first).astype(np.int32)), pa.array(content, pa.binary()),
                ], names=["doc_id", "doc_key", "h", "c", "p", "d0", "d1", "bytes"])

    return docs.mapInArrow(run, "doc_id long, doc_key long, h long, c long, p long, d0 int, d1 int, bytes binary")


def suffix_ranks(text: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the strings of n bytes at the starts in the order of suffixes, equal ones alike; by doubling."""
    padded = np.concatenate([text, np.zeros(n + 8, np.uint8)])
    _, rank = np.unique(padded, return_inverse=True)
    rank, width = rank.astype(np.int64), 1
    while 2 * width <= n:
        most = int(rank.max()) + 1
        _, doubled = np.unique(rank[: len(rank) - width] * most + rank[width:], return_inverse=True)
        rank, width = doubled.astype(np.int64), 2 * width
    _, out = np.unique(rank[starts] * (int(rank.max()) + 1) + rank[starts + n - width], return_inverse=True)
    return out


def matched(ranks: np.ndarray, place: np.ndarray, keep: str) -> np.ndarray:
    """Which strings occur elsewhere; with keep="first", which have an earlier match. In the order of suffixes, equal
    strings by place, the previous smaller place with n equal bytes is the neighbour before."""
    order = np.lexsort((place, ranks))
    same = ranks[order][1:] == ranks[order][:-1]
    out = np.zeros(len(ranks), bool)
    out[order[1:]] = same
    if keep == "none":
        out[order[:-1]] |= same
    return out


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


_OWN = "h long, c long, own array<struct<lo:int,hi:int>>"


def _sorted_windows(groups: DataFrame, n: int, keep: str) -> DataFrame:
    """The repeated starts of each content, as distances from the anchor. groups: h, c, doc_id, p, d0, d1, bytes."""

    def run(batches):
        held, size, h = [], 0, None
        for b in batches:
            for row in zip(*[b.column(k).to_pylist() for k in range(7)], strict=True):
                if row[0] != h and size > 1 << 19:
                    yield found(held)
                    held, size = [], 0
                h = row[0]
                held.append(row)
                size += len(row[6])
        if held:
            yield found(held)

    def found(held):
        text = np.frombuffer(b"".join(r[6] for r in held), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(r[6]) for r in held])[:-1]])
        count = np.array([r[5] - r[4] + 1 for r in held])
        of = np.repeat(np.arange(len(held)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        by = sorted(range(len(held)), key=lambda i: (held[i][2] is not None, held[i][2] or 0, held[i][3] - held[i][5]))
        place = np.empty(len(held), np.int64)
        place[by] = np.arange(len(held))
        flags = matched(suffix_ranks(text, begin[of] + step, n), place[of], keep)
        out, at = [], 0
        for r, m in zip(held, count.tolist(), strict=True):
            out.append([{"lo": r[5] - hi, "hi": r[5] - lo} for lo, hi in intervals(flags[at : at + m])])
            at += m
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.int64()), pa.array(out, kind)], names=["h", "c", "own"])

    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = groups.select("h", "c", "doc_id", "p", "d0", "d1", "bytes").repartition(parts, "h").sortWithinPartitions("h")
    return rows.mapInArrow(run, _OWN)


def _counted_strings(groups: DataFrame, n: int, keep: str) -> DataFrame:
    """The same by counting the hash of each string, for anchors with very many different windows."""

    def run(batches):
        for b in batches:
            for h, c, doc_id, p, d0, d1, data in zip(*[b.column(k).to_pylist() for k in range(7)], strict=True):
                m = d1 - d0 + 1
                at = np.arange(m)
                g = ta.span_hashes(ta.prefix_sums(np.frombuffer(data, np.uint8)), at, at + n).view(np.int64)
                full = lambda v, t: pa.array([v] * m, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([full(h, pa.int64()), full(c, pa.int64()), full(doc_id, pa.int64()), pa.array(p - d1 + at), pa.array((d1 - at).astype(np.int32)), pa.array(g)], names=["h", "c", "doc_id", "s", "d", "g"])

    each = groups.select("h", "c", "doc_id", "p", "d0", "d1", "bytes").mapInArrow(run, "h long, c long, doc_id long, s long, d int, g long")
    same = each.groupBy("h", "d", "g").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "s", "c")).alias("first")).where("n > 1")
    hit = each.join(same, ["h", "d", "g"])
    if keep == "first":
        hit = hit.where(F.col("c") != F.col("first.c"))
    # d less its number is the same along a run; a content has no more than n starts
    run = (F.col("d") - F.row_number().over(W.partitionBy("h", "c").orderBy("d"))).alias("run")
    runs = hit.select("h", "c", "d", run).groupBy("h", "c", "run").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return runs.groupBy("h", "c").agg(F.collect_list(F.struct("lo", "hi")).alias("own"))


def spans(docs: DataFrame, n: int = N, keep: str = "none") -> DataFrame:
    """(doc_id, doc_key, spans) of documents from which bytes go; spans: first byte and the one after the last, in any
    order, some overlapping. docs: doc_id, doc_key, text."""
    anchors = _anchors(docs.select("text"), n).groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    anchors = common.written(anchors.select("h", (F.col("c0") != F.col("c1")).alias("mixed")), "anchors")
    again, mixed = common.key_filter(anchors.select("h")), common.key_filter(anchors.where("mixed").select("h"))
    found = common.written(_occurrences(docs, n, again, mixed), "windows")

    contents = found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "doc_key", "p", "d0", "d1")).alias("first"))
    per_anchor = contents.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("variants")).where("total > 1")
    contents = common.written(contents.join(per_anchor, "h"), "contents")
    data = found.where("bytes is not null").select("h", "c", "bytes").dropDuplicates(["h", "c"])
    groups = common.written(contents.where("variants > 1").select("h", "c", "variants", "first.*").join(data, ["h", "c"]), "different")
    own = _sorted_windows(groups.where(F.col("variants") <= SORTED), n, keep)
    large = groups.where(F.col("variants") > SORTED)
    if not large.isEmpty():
        own = own.unionByName(_counted_strings(large, n, keep))
    rules = contents.join(common.written(own, "repeated"), ["h", "c"], "left").select("h", "c", F.col("n").alias("times"), F.struct("first.doc_id", "first.doc_key", "first.p").alias("first"), "own")
    rules = common.written(rules, "rules")  # read anew, so that Spark can split a content that very many places have

    hits = found.drop("bytes").join(rules, ["h", "c"])
    whole = F.array(F.struct(F.col("d0").alias("lo"), F.col("d1").alias("hi")))
    if keep == "first":
        mine = F.struct("doc_id", "doc_key", "p").eqNullSafe(F.col("first"))
        ranges = F.when(~mine, whole).otherwise(F.col("own"))
    else:
        ranges = F.when(F.col("times") > 1, whole).otherwise(F.col("own"))
    hits = hits.select("doc_id", "doc_key", "p", ranges.alias("r")).where(F.size("r") > 0)
    cut = F.transform("r", lambda x: F.struct((F.col("p") - x["hi"]).alias("b"), (F.col("p") - x["lo"] + n).alias("e")))
    return hits.groupBy("doc_id", "doc_key").agg(F.flatten(F.collect_list(cut)).alias("spans"))


def merged(pairs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed runs, ascending."""
    out: list[tuple[int, int]] = []
    for x in sorted(pairs or [], key=lambda x: x["b"]):
        if out and x["b"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["e"]))
        else:
            out.append((x["b"], x["e"]))
    return out


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for b, e in runs:
        out.append(data[at:b])
        at = e
    return b"".join([*out, data[at:]])


def _with_spans(docs: DataFrame, n: int, keep: str) -> DataFrame:
    """docs with the columns _sx_spans and _sx_text (the text, null as empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"_sx_id": F.col("doc_id").cast("long"), "_sx_text": text, "_sx_key": F.xxhash64(F.col("doc_id").cast("long"), text)})
    cut = spans(keyed.select(F.col("_sx_id").alias("doc_id"), F.col("_sx_key").alias("doc_key"), F.col("_sx_text").alias("text")), n, keep)
    cut = common.written(cut.select(F.col("doc_id").alias("_sx_doc"), F.col("doc_key").alias("_sx_dkey"), F.col("spans").alias("_sx_spans")), "spans")
    return keyed.join(cut, F.col("_sx_id").eqNullSafe(F.col("_sx_doc")) & (F.col("_sx_key") == F.col("_sx_dkey")), "left")


def digests(docs: DataFrame, n: int = N, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = _with_spans(docs.select("doc_id", "text"), n, keep).select("_sx_id", "_sx_text", "_sx_spans")

    def run(batches):
        for b in batches:
            size, gone, count, sums = [], [], [], []
            for text, pairs in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                data, runs = text.as_buffer().to_pybytes(), merged(pairs)
                size.append(len(data))
                gone.append(sum(e - s for s, e in runs))
                count.append(len(runs))
                sums.append(hashlib.sha256(without(data, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, n: int = N, keep: str = "first") -> DataFrame:
    """docs, all columns, with the repeated bytes cut out of text; a character that is cut in part goes as a whole."""
    names = docs.columns
    rows = _with_spans(docs, n, keep).select(*[F.col(f"`{c}`") for c in names], "_sx_spans")
    at = names.index("text")

    def run(batches):
        for b in batches:
            out = []
            for text, pairs in zip(b.column(at), b.column(len(names)).to_pylist(), strict=True):
                if pairs:
                    out.append(without(text.as_buffer().to_pybytes(), merged(pairs)).decode("utf-8", "ignore"))
                else:
                    out.append(text.as_py())
            cols = [pa.array(out, b.column(at).type) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, docs.schema)
