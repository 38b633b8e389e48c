"""Language identification: script ranges narrow the candidates, Viterbi labels the words.

From training texts come, for each language, how often each three-letter sequence occurs inside words (hashed to a table of
fixed size) and how its letters spread over scripts. A word's candidates are the languages that use its script; its
score for each is the log-probability of its sequences. The best path over a text's words, where each change of language
costs SWITCH, labels spans of mixed-language text. The document's language is that of most letters.

Words are runs of letters, lower-cased letter by letter. Null texts and texts without a letter are `und` with score 0. Rows
with null lang train nothing; without any training row every text is `und`. Ties go to the alphabetically first language.
The score is the share of letters in spans of the predicted language. Equal texts get equal results.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlake.llm import common, textarrays as ta

TABLE = 1 << 16
SWITCH = 8.0
#: Bytes of text whose paths are found together: each word of the longest is a step for all.
TOGETHER = 2 << 20
LEAST_SHARE = 0.001
FAR = -1e4

# Code point ranges of scripts, first and last.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "gurmukhi": [(0xA00, 0xA7F)], "gujarati": [(0xA80, 0xAFF)], "tamil": [(0xB80, 0xBFF)], "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)], "malayalam": [(0xD00, 0xD7F)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)], "ethiopic": [(0x1200, 0x137F)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
SLOTS = TABLE + len(SCRIPTS) + 1


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether a letter, its lower case, its script (0: none of those listed)."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter).tolist():
        x = chr(c).lower()
        if len(x) == 1:
            lower[c] = ord(x)
    script = np.zeros(0x110000, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, lower, script


def _grams(data, offsets, lo, hi):
    """Of the letters of rows lo to hi: sequence slot, script, and where each word begins; first word of each row."""
    buf, at = ta.laid_out(data, offsets, lo, hi)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[at]
    letter, lower, script = _letters()
    inside = letter[points]
    x = np.where(inside, lower[points], 0).astype(np.uint64)
    spots = np.flatnonzero(inside)
    key = (x[spots - 1] * np.uint64(0x1F123BB5) + x[spots]) * np.uint64(0x9E3779B97F4A7C15) + x[spots + 1]
    slot = (ta.mix(key) & np.uint64(TABLE - 1)).astype(np.int64)
    begin = np.flatnonzero(~inside[spots - 1])
    return slot, script[points[spots]], begin, np.searchsorted(spots[begin], place)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: a row for each language, the sequences' slots, then the scripts."""
        self.languages = languages
        seen = max(1, int((counts[:, :TABLE].sum(axis=0) > 0).sum()))
        grams = counts[:, :TABLE].T
        self.logs = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * seen)).astype(np.float32)
        share = counts[:, TABLE:].T / np.maximum(counts[:, TABLE:].sum(axis=1), 1)
        uses = share >= LEAST_SHARE
        self.bar = np.where(uses | ~uses.any(axis=1, keepdims=True), 0, FAR).astype(np.float32)

    def label(self, column: pa.Array):
        """Of each text: language number of each word, letters of each word."""
        data, offsets = ta.raw(column)
        for lo, hi in ta.ranges(offsets, TOGETHER):
            slot, script, begin, first = _grams(data, offsets, lo, hi)
            length = np.diff(np.append(begin, len(slot)))
            if not len(begin):
                yield from [(np.zeros(0, np.int64), length)] * (hi - lo)
                continue
            scores = np.add.reduceat(self.logs[slot], begin, axis=0) + self.bar[script[begin]]
            path = self.paths(scores, first)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                yield path[a:b], length[a:b]

    def paths(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label of each word. All texts go forward together, word by word; longer texts come first."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        begin, n = first[:-1][order], n[order]
        steps = int(n[0]) if len(n) else 0
        active = np.searchsorted(-n, -np.arange(steps), side="left")  # texts with more than t words
        stay = np.ones(scores.shape, bool)
        before = np.zeros(len(scores), np.int64)
        now = np.zeros((len(n), scores.shape[1]), np.float32)
        now[: active[0] if steps else 0] = scores[begin[: active[0]]] if steps else 0
        for t in range(1, steps):
            k = active[t]
            at, d = begin[:k] + t, now[:k]
            best = d.argmax(axis=1)
            other = d[np.arange(k), best][:, None] - np.float32(SWITCH)
            same = d >= other
            stay[at], before[at] = same, best
            now[:k] = np.where(same, d, other) + scores[at]
        path = np.zeros(len(scores), np.int64)
        state = now.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            at = begin[:k] + t
            path[at] = state[:k]
            if t:
                state[:k] = np.where(stay[at, state[:k]], state[:k], before[at])
        return path


def train(docs: DataFrame) -> Model:
    """A model of all rows of docs (text, lang). Counts have a fixed number of slots for each language."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            data, offsets = ta.raw(b.column(0))
            langs = b.column(1).to_pylist()
            for lo, hi in ta.ranges(offsets):
                slot, script, begin, first = _grams(data, offsets, lo, hi)
                row = np.repeat(np.arange(hi - lo), np.diff(np.append(begin, len(slot))[first]))
                names, of = np.unique(np.array(langs[lo:hi], object).astype(str), return_inverse=True)
                for i, name in enumerate(names.tolist()):
                    own = of[row] == i
                    c = counts.setdefault(name, np.zeros(SLOTS, np.int64))
                    c[:TABLE] += np.bincount(slot[own], minlength=TABLE)
                    c[TABLE:] += np.bincount(script[own], minlength=SLOTS - TABLE)
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "slot", "n"])

    got = docs.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(languages), SLOTS))
    if languages:
        number = {name: i for i, name in enumerate(languages)}
        counts[[number[x] for x in got["lang"].to_pylist()], got["slot"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts)


def identified(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row and, if asked for, spans (first word, words, language)."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for b in batches:
            names, scores, spans = [], [], []
            labels = model.label(b.column(1)) if model.languages else iter([(np.zeros(0, np.int64), np.zeros(0, np.int64))] * b.num_rows)
            for path, letters in labels:
                share = np.bincount(path, letters[: len(path)], max(1, len(model.languages)))
                whole = share.sum()
                names.append(model.languages[int(share.argmax())] if whole else "und")
                scores.append(float(share.max() / whole) if whole else 0.0)
                if with_spans:
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]]) if len(path) else np.zeros(1, int)
                    spans.append([{"first": a, "words": e - a, "lang": model.languages[path[a]]} for a, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
            cols = [b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())] + ([pa.array(spans, kind)] if with_spans else [])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double" + (", spans array<struct<first:int,words:int,lang:string>>" if with_spans else ""))


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learnt from the rows whose crc32 remainder by 4 isn't 2."""
    held_out = common.crc_remainder(F.col("doc_id"), 4) == 2
    got = identified(docs, train(docs.where(~held_out)))
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
