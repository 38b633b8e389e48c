"""Phrase collocations by SETM: sorted occurrence relations, merge-joined with themselves level by level.

R1, a written table, holds the occurrences of all words, sorted by place. Its rows are runs of pieces of one language
(some half a megabyte of text): the distinct words of the run, and for each occurrence its word and whether the next one
has the next position of the same piece. As packed columns, a run is one short row to Spark.

For each further length, R(k) is joined with itself on adjacent places, which is a merge of two sorted columns of one
row and moves nothing. The joined occurrences are counted by the phrase's hash; R(k + 1), written again, keeps those of a
hash that is frequent (a bitmap of fixed size, so the semi-join moves nothing either) and what stands under none is
gone from the next level. A hash only chooses: the figures are counts of the phrases themselves, taken from R(k + 1).

Texts are lower-cased (A-Z), split into pieces at .,;:!? and \\x0A-\\x0D, pieces into words at space and tab. Null and
empty texts hold no word; a null language is `und`. Repeated rows count each time. A piece of any length is whole. Without
frequent phrases the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftlake.llm import common, textarrays as ta

FREQUENT, LONGEST, COVER, TOP = 10, 3, 50, 2000
UNKNOWN = "und"
#: Occurrences that a task counts together before they are handed on.
COUNTED = 1 << 20
#: Rows of a batch that a task hands on.
BATCH = 1 << 16
#: Parts of a language in which the first phrases are chosen before they meet.
PARTS = 64
RUNS = "lang string, words string, codes binary, follows binary"
#: Row groups of a written relation.
GROUP_BYTES = 16 << 20

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_WORD = ~_ENDS
_WORD[[9, 32]] = False


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a string column."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[_bytes_of(starts, offsets)]))


def _bytes_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Indices of all bytes of spans that are to lie one after another from `offsets` on."""
    return np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], np.diff(offsets))


def _distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each distinct word's first occurrence, the number of each occurrence's word)."""
    hashes = ta.span_hashes(ta.prefix_sums(buf), starts, ends)
    _, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[codes]
    if (ends - starts == ends[like] - starts[like]).all():
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        if (buf[_bytes_of(starts, offsets)] == buf[_bytes_of(starts[like], offsets)]).all():
            return first, codes
    known: dict[bytes, int] = {}  # two words of one hash
    spans = [buf[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    codes = np.array([known.setdefault(w, len(known)) for w in spans])
    return np.unique(codes, return_index=True)[1], codes


def _buffers(column: pa.Array) -> Iterator[np.ndarray]:
    """Lower-cased texts with a line end before, between and after them; a very long text is cut between pieces."""
    data, offsets = ta.raw(column)
    for lo, hi in ta.ranges(offsets):
        b, e = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or e - b <= ta.LIMIT:
            buf, at = ta.laid_out(data, offsets, lo, hi)
            buf[at - 1] = 10
            yield ta._LOWER[buf]
            continue
        while b < e:
            end = min(e, b + ta.LIMIT)
            while end < e and not _ENDS[data[end]]:
                step = np.flatnonzero(_ENDS[data[end : min(e, end + ta.LIMIT)]])
                end = min(e, end + (int(step[0]) if len(step) else ta.LIMIT))
            yield np.concatenate([[10], ta._LOWER[data[b:end]], [10]]).astype(np.uint8)
            b = end


def _row(lang: str, words: bytes, n_words: int, codes: np.ndarray, follows: np.ndarray) -> pa.RecordBatch:
    """A run as one row: words with a blank between them, the number of each occurrence's word, a bit for each but the last."""
    codes = codes.astype("<u2" if n_words <= 1 << 16 else "<u4")
    return pa.RecordBatch.from_arrays([
        pa.array([lang]), pa.array([words], pa.binary()).cast(pa.string()), pa.array([codes.tobytes()], pa.binary()), pa.array([np.packbits(follows).tobytes()], pa.binary()),
    ], names=["lang", "words", "codes", "follows"])


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The spans with a blank between them."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    out = data[np.minimum(_bytes_of(starts, offsets), len(data) - 1)]
    out[offsets[1:] - 1] = 32
    return out[:-1].tobytes()


def _runs(docs: DataFrame) -> DataFrame:
    """R1: for each run the language, its distinct words, and of each occurrence the word and what follows."""

    def run(batches):
        for batch in batches:
            lang = batch.column(0)
            for name in pc.unique(lang).to_pylist():
                for buf in _buffers(batch.column(1).filter(pc.equal(lang, name))):
                    starts, ends = ta.word_bounds(buf, _WORD)
                    if not len(starts):
                        continue
                    first, codes = _distinct(buf, starts, ends)
                    cuts = np.cumsum(_ENDS[buf])[starts]
                    yield _row(name, _spaced(buf, starts[first], ends[first]), len(first), codes, np.diff(cuts) == 0)

    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where("text is not null")
    return texts.mapInArrow(run, RUNS)


class _Run:
    """One row of a relation. Places of one piece follow each other, between others one is left out: "same piece, next
    position" is "next place"."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.lang = batch.column(0)[i].as_py()
        self.data = np.frombuffer(b" " + batch.column(1)[i].as_buffer().to_pybytes() + b" ", np.uint8)
        blanks = np.flatnonzero(self.data == 32)
        self.starts, self.ends = blanks[:-1] + 1, blanks[1:]
        codes = batch.column(2)[i].as_buffer()
        self.codes = np.frombuffer(codes, "<u2" if len(self.starts) <= 1 << 16 else "<u4").astype(np.int64)
        follows = np.unpackbits(np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8), count=len(self.codes) - 1)
        self.places = np.concatenate([[0], np.cumsum(2 - follows.astype(np.int64))])
        self._hashes = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            name = np.frombuffer(self.lang.encode(), np.uint8)
            start = ta.span_hashes(ta.prefix_sums(name), np.array([0]), np.array([len(name)]))
            self._hashes = ta.mix(ta.span_hashes(ta.prefix_sums(self.data), self.starts, self.ends) + start * ta.STEP)
        return self._hashes

    def strings(self) -> pa.Array:
        return _strings(self.data, self.starts, self.ends)

    def phrases(self, starts: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k words from each start on."""
        h = self.hashes[self.codes[starts]]
        for j in range(1, k):
            h = ta.mix(h * ta.STEP + self.hashes[self.codes[starts + j]])
        return h.view(np.int64)


def _rows(batches) -> Iterator[_Run]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Run(batch, i)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, BATCH):
        yield batch.slice(at, BATCH)


def _summed(parts: list[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys as one, their `f` added up."""
    total = pa.Table.from_batches(parts).group_by(list(keys), use_threads=False).aggregate([("f", "sum")])
    yield from total.select([*keys, "f_sum"]).rename_columns([*keys, "f"]).to_batches(BATCH)


def _phrase_rows(relation: DataFrame, of_run) -> DataFrame:
    """(lang, phrase, f) rows that of_run gives for each run (phrases, counts), summed within a task first."""

    def run(batches):
        held, size = [], 0
        for r in _rows(batches):
            phrase, n = of_run(r)
            if not len(n):
                continue
            lang = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([r.lang])).dictionary_decode()
            held.append(pa.RecordBatch.from_arrays([lang, phrase, pa.array(n.astype(np.int64))], names=["lang", "phrase", "f"]))
            size += len(n)
            if size >= COUNTED:
                yield from _summed(held, "lang", "phrase")
                held, size = [], 0
        if held:
            yield from _summed(held, "lang", "phrase")

    return relation.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _frequent_starts(r: _Run, k: int, bits: np.ndarray) -> np.ndarray:
    """Where the k-word phrases of R(k) begin: in a run written for k or k - 1 words, those of a frequent hash."""
    starts = _in_piece(r.places, k)
    return starts[common.passes(bits, r.phrases(starts, k))]


def _in_piece(places: np.ndarray, k: int) -> np.ndarray:
    """Indices from which k places follow each other."""
    n = len(places) - k + 1
    return np.flatnonzero(places[k - 1 :] - places[:n] == k - 1) if n > 0 else np.zeros(0, np.int64)


def _joined(starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Merge-join of sorted phrase occurrences with themselves: the starts whose next place is a start too."""
    nxt = starts[:-1] + 1 == starts[1:]
    return starts[:-1][nxt & (places[starts[1:]] == places[starts[:-1]] + 1)] if len(starts) > 1 else starts[:0]


def _counted(relation: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """(h, n) of the phrases of k + 1 words that R(k), chosen by `bits`, gives; summed within a task first."""

    def give(parts):
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        yield from _slices(pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"]))

    def run(batches):
        held, size = [], 0
        for r in _rows(batches):
            held.append(r.phrases(_joined(_frequent_starts(r, k, bits), r.places), k + 1))
            size += len(held[-1])
            if size >= COUNTED:
                yield from give(held)
                held, size = [], 0
        if size:
            yield from give(held)

    # summed in the tasks already: the exchange comes first, so that rows are not aggregated twice
    return relation.mapInArrow(run, "h long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("n"))


def _extended(relation: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """R(k): the occurrences that stand in a k-word phrase of a frequent hash."""

    def run(batches):
        for r in _rows(batches):
            starts = _frequent_starts(r, k, bits)
            if not len(starts):
                continue
            stays = np.zeros(len(r.codes), bool)
            for j in range(k):
                stays[starts + j] = True
            used, codes = np.unique(r.codes[stays], return_inverse=True)
            yield _row(r.lang, _spaced(r.data, r.starts[used], r.ends[used]), len(used), codes, np.diff(r.places[stays]) == 1)

    return relation.mapInArrow(run, RUNS)


def _word_counts(relation: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words."""
    return _phrase_rows(relation, lambda r: (r.strings(), np.bincount(r.codes)))


def _phrase_counts(relation: DataFrame, k: int, bits: np.ndarray, least: int) -> DataFrame:
    """(lang, phrase, f) of the k-word phrases that stand `least` times or more in R(k), by the phrases themselves."""

    def of_run(r: _Run):
        starts = _frequent_starts(r, k, bits)
        if not len(starts):
            return None, starts
        which = np.stack([r.codes[starts + j] for j in range(k)], axis=1)
        which = which[np.lexsort(which.T[::-1])]
        new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]).any(axis=1)]))
        words = r.strings()
        phrase = pc.binary_join_element_wise(*(words.take(pa.array(which[new, j])) for j in range(k)), " ")
        return phrase, np.diff(np.concatenate([new, [len(which)]]))

    return _phrase_rows(relation, of_run).where(F.col("f") >= least)


def _hashes(phrases: DataFrame) -> DataFrame:
    """Hashes of one-word phrases as the relations' rows have them."""

    def run(batches):
        for batch in batches:
            lang = batch.column(0)
            for name in pc.unique(lang).to_pylist():
                words = " ".join(batch.column(1).filter(pc.equal(lang, name)).to_pylist()).encode()
                n = words.count(b" ") + 1
                r = _Run(_row(name, words, n, np.arange(n), np.zeros(n - 1, bool)), 0)
                yield pa.RecordBatch.from_arrays([pa.array(r.phrases(np.arange(n), 1))], names=["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")


def occurrences(docs: DataFrame, least: int = FREQUENT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all phrases of up to `longest` words that stand `least` times or more, (lang, n) words)."""
    keep = {"parquet.block.size": GROUP_BYTES}
    relation = common.written(_runs(docs), "phrases-1", **keep)
    words = common.written(_word_counts(relation), "phrases-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    out = frequent.withColumn("k", F.lit(1))
    bits = common.key_filter(_hashes(frequent))
    for k in range(2, longest + 1):
        counts = _counted(relation, k - 1, bits)
        bits = common.key_filter(counts.where(F.col("n") >= least).select("h"))
        relation = common.written(_extended(relation, k, bits), f"phrases-{k}", **keep)
        found = common.written(_phrase_counts(relation, k, bits, least), f"phrases-count-{k}")
        out = out.unionByName(found.withColumn("k", F.lit(k)))
    return out, totals


def _part(words: Column, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, least: int = FREQUENT, longest: int = LONGEST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first `top` phrases of each language.

    score = floor(1000000 * a * a / (l * r)) at the cut that gives least. A phrase goes if a longer one that contains it
    stands at least `cover` percent as often.
    """
    every, totals = occurrences(docs, least, longest)
    lookup = every.select("lang", F.col("phrase").alias("_p"), F.col("f").cast("decimal(19,0)").alias("_f"))
    phrases = every.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("_w"))

    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("k") - s + 1), lambda i: _part(F.col("_w"), i, s))))
    inside = phrases.where("k > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "a")
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer").cast("decimal(19,0)") < cover * F.col("a").cast("decimal(19,0)")))

    cut = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("c"), _part(F.col("_w"), F.lit(1), c).alias("head"), _part(F.col("_w"), c + 1, F.col("k") - c).alias("tail")))
    cuts = kept.select("lang", "phrase", "a", F.inline(cut))
    head = lookup.select("lang", F.col("_p").alias("head"), F.col("_f").alias("_l"))
    tail = lookup.select("lang", F.col("_p").alias("tail"), F.col("_f").alias("_r"))
    scored = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    exact = F.expr("(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * cast(1000000 as decimal(7,0))) div (_l * _r)")
    least_cut = F.min(F.struct(exact.alias("score"), "c", F.col("_l").cast("long").alias("l"), F.col("_r").cast("long").alias("r")))
    rows = scored.groupBy("lang", "phrase", "a").agg(least_cut.alias("_s")).select("lang", "phrase", "a", "_s.l", "_s.r", "_s.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
