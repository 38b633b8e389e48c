"""Best-fit packing: documents as token sequences of a fixed length, by bin completion.

A document's tokens are the ids of its text and one end id. Only documents longer than a sequence are cut, into
pieces of full length and one last shorter piece. Pieces are dealt out by a hash of their place into groups of
bounded size; each group is packed on its own, so a group wastes at most a part of one more sequence. Null and empty
texts are documents of the end id alone; repeated rows are packed once each; an empty table gives no piece.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import threading
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlake.llm import common, textarrays as ta

CAPACITY = 2048
END_ID = 0
GROUP = 16384
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
_CUT = np.ones(256, bool)
_CUT[[9, 10, 13, 32]] = False


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True


def _splits_words(parts: list[dict]) -> bool:
    """Whether a tokenizer's first step takes runs of letters and runs of marks apart, and drops blanks."""
    first = parts[0] if parts else {}
    pattern = (first.get("pattern") or {}).get("Regex", "").split("|")
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(pattern)


def _steps(node: dict | None, name: str) -> list[dict]:
    return [] if not node else node[name] if node.get("type") == "Sequence" else [node]


class Encoder:
    """Ids of whole texts through the ids of their chunks, which no token spans: what lies between blanks and line ends and,
    where the tokenizer takes them apart itself, ASCII words and the marks beside them. Known chunks are looked up by
    hash in a table of bounded size; new ones are encoded together."""

    #: Bytes of the table.
    most = 24 << 20

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        step = lambda part: json.loads(part.__getstate__()) if part is not None else None
        self.apart = _splits_words(_steps(step(self.tokenizer.pre_tokenizer), "pretokenizers"))
        self.marks = _MARK.copy()
        special = {c for t in self.tokenizer.get_added_tokens_decoder().values() for c in t.content.encode()}
        self.marks[sorted(special)] = False  # special tokens stay whole
        lowers = any(n["type"] == "Lowercase" for n in _steps(step(self.tokenizer.normalizer), "normalizers"))
        self.same = ta._LOWER if lowers else np.arange(256, dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.keys, self.starts, self.lengths, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.array([len(x) for x in ids], np.int64)
        starts = len(self.pool) + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.lengths = np.insert(self.keys, at, keys), np.insert(self.starts, at, starts), np.insert(self.lengths, at, lengths)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _chunks(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each chunk and the one after its last."""
        inside = _CUT[buf]
        begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        if self.apart:
            letter, mark = _LETTER[buf], self.marks[buf]
            border = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
            begins, ends = begins | border, ends | border
        return np.flatnonzero(begins) + 1, np.flatnonzero(ends) + 1

    def encode(self, column: pa.Array):
        """The ids of each text."""
        data, offsets = ta.raw(column)
        for lo, hi in ta.ranges(offsets):
            buf, first = ta.laid_out(data, offsets, lo, hi)
            buf = self.same[buf]
            begin, end = self._chunks(buf)
            keys, any_of, back = np.unique(ta.span_hashes(ta.prefix_sums(buf), begin, end), return_index=True, return_inverse=True)
            if 24 * len(self.keys) + self.pool.nbytes > self.most:
                self.forget()
            at, known = self._places(keys)
            if not known.all():
                new = np.flatnonzero(~known)
                text = buf.tobytes()
                spans = zip(begin[any_of[new]].tolist(), end[any_of[new]].tolist(), strict=True)
                self.learn(keys[new], [text[b:e].decode() for b, e in spans])
                at, _ = self._places(keys)
            at = at[back]
            lengths = self.lengths[at]
            stop = np.cumsum(lengths)
            ids = self.pool[np.repeat(self.starts[at] - (stop - lengths), lengths) + np.arange(stop[-1] if len(stop) else 0)]
            word = np.searchsorted(begin, first)
            token = np.concatenate([[0], stop])[word]
            for a, b in zip(token[:-1].tolist(), token[1:].tolist(), strict=True):
                yield ids[a:b]


class _Held:
    """The encoder of this worker process: its table serves one task after the other and goes when none has used it for a while."""

    idle_seconds = 5.0

    def __init__(self):
        self.lock, self.path, self.encoder, self.timer = threading.Lock(), None, None, None

    def take(self, path: str) -> Encoder:
        with self.lock:
            if self.timer is not None:
                self.timer.cancel()
            if self.path != path:
                self.path, self.encoder = path, Encoder(path)
            return self.encoder

    def give_back(self) -> None:
        with self.lock:
            if self.timer is not None:
                self.timer.cancel()
            self.timer = threading.Timer(self.idle_seconds, self._drop)
            self.timer.daemon = True
            self.timer.start()

    def _drop(self) -> None:
        with self.lock:
            if self.timer is threading.current_thread():
                self.path = self.encoder = self.timer = None
                gc.collect()


_held = _Held()


def _take(path: str) -> Encoder:
    return _held.take(path)


def _give_back() -> None:
    _held.give_back()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches):
        enc = _take(path)
        try:
            for b in batches:
                yield cut(enc, b)
        finally:
            _give_back()

    def cut(enc, b):
        rows, ids_out = {"doc": [], "piece": [], "start": [], "length": [], "crc": []}, []
        for row, ids in enumerate(enc.encode(b.column(1))):
            ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
            for k, s in enumerate(range(0, len(ids), capacity)):
                part = ids[s : s + capacity]
                for name, v in zip(rows, (row, k, s, len(part), zlib.crc32(part.tobytes())), strict=True):
                    rows[name].append(v)
                if with_ids:
                    ids_out.append(part)
        doc = b.column(0).take(pa.array(rows["doc"], pa.int64()))
        cols = [doc, pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int32()), pa.array(rows["crc"], pa.int64())]
        if with_ids:
            cols.append(ta.arrays(ids_out, pa.int64()))
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each piece with sequence_id and its offset in that sequence."""
    cut = common.written(pieces(docs, path, capacity, with_ids), "pieces")
    groups = max(1, -(-cut.count() // GROUP))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    dealt = cut.withColumns({"sequence_id": place, "offset": F.lit(0).cast("long"), "length": F.col("length").cast("long")})

    def fill(key, rows: pd.DataFrame) -> pd.DataFrame:
        which, offset = assign(rows["length"].to_numpy(), capacity)
        rows["sequence_id"], rows["offset"] = (key[0] << 32) + which, offset
        return rows

    return dealt.groupBy("sequence_id").applyInPandas(fill, dealt.schema)


def assign(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    bins = complete_bins(counts, capacity)
    order = np.argsort(lengths, kind="stable")
    next_of = np.concatenate([[0], np.cumsum(counts)])[:-1]
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, sizes in enumerate(bins):
        at = 0
        for size in sizes:
            item = order[next_of[size]]
            next_of[size] += 1
            which[item], offset[item] = number, at
            at += size
    return which, offset


def best_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece into the fullest sequence that has room."""
    bins, by_room = [], [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, bool)
    for size in range(capacity, 0, -1):
        for _ in range(int(counts[size])):
            room = size + int(np.argmax(open_rooms[size:]))
            if open_rooms[room]:
                b = by_room[room].pop()
                open_rooms[room] = bool(by_room[room])
                bins[b].append(size)
                room -= size
            else:
                b, room = len(bins), capacity - size
                bins.append([size])
            by_room[room].append(b)
            open_rooms[room] = room > 0
    return bins


def fillings(counts: np.ndarray, room: int, width: int) -> list[tuple[int, ...]]:
    """Up to `width` undominated sets of at most three sizes for the room, least waste first. One size that fits
    exactly dominates all others; a set is dominated if its sizes go into those of another set."""
    if room <= 0:
        return [()]
    have = counts[: room + 1] > 0
    have[0] = False
    if have[room]:
        return [(room,)]
    sizes = np.flatnonzero(have)[::-1]
    if not len(sizes):
        return [()]
    below = np.maximum.accumulate(np.where(have, np.arange(room + 1), 0))
    found = {(int(sizes[0]),)}
    b = below[room - sizes]
    b = np.where((b == sizes) & (counts[sizes] < 2), below[np.maximum(b - 1, 0)], b)
    total = sizes + b
    ok = (b > 0) & (b <= sizes)
    pick = np.flatnonzero(ok)
    pick = pick[np.argsort(-total[pick], kind="stable")][:width]
    found |= {(int(sizes[i]), int(b[i])) for i in pick}
    if not len(pick) or total[pick[0]] < room:
        for first in sizes[:: max(1, len(sizes) // 24)].tolist():
            left = room - first
            if left < 2:
                continue
            second = sizes[sizes <= min(first, left - 1)]
            if not len(second):
                continue
            third = below[left - second]
            third = np.minimum(third, second)
            need = 1 + (second == first) + (third == second) + ((third == first) & (second != first))
            good = (third > 0) & have[third] & (counts[third] >= 1 + (third == second) + (third == first)) & (counts[second] >= 1 + (second == first)) & (need <= 3)
            if good.any():
                j = int(np.argmax(np.where(good, second + third, -1)))
                found.add((first, int(second[j]), int(third[j])))
    return undominated(found, width)


def undominated(found: set[tuple[int, ...]], width: int) -> list[tuple[int, ...]]:
    ordered = sorted(found, key=lambda s: (-sum(s), len(s), [-x for x in s]))
    kept: list[tuple[int, ...]] = []
    for s in ordered:
        if len(kept) == width:
            break
        if not any(len(s) <= len(k) and all(x <= y for x, y in zip(s, k, strict=False)) for k in kept):
            kept.append(s)
    return kept


def complete_bins(counts: np.ndarray, capacity: int, width: int = 4, extra_nodes: int = 2000) -> list[list[int]]:
    """Sizes of each sequence. Best fit gives the first solution; the search fills one sequence after another
    around the largest piece left, with undominated fillings only, and turns back when the waste so far leaves no
    better solution. It ends at the lower bound, or `extra_nodes` nodes after as many as a solution has sequences."""
    counts = counts.copy()
    full = [[capacity]] * int(counts[capacity])
    counts[capacity] = counts[0] = 0
    total = int((counts * np.arange(len(counts))).sum())
    best = best_fit(counts, capacity)
    least = -(-total // capacity)
    if len(best) > least:
        found = _search(counts, capacity, total, len(best), width, 2 * len(best) + extra_nodes)
        best = found or best
    return full + best


def _search(counts: np.ndarray, capacity: int, total: int, most: int, width: int, nodes: int) -> list[list[int]] | None:
    """A solution of fewer than `most` sequences, or None."""
    counts = counts.copy()
    least = -(-total // capacity)
    best, path, waste, left = None, [], 0, total
    allowed = (most - 1) * capacity - total
    largest = capacity

    def options():
        nonlocal largest
        while largest and not counts[largest]:
            largest -= 1
        counts[largest] -= 1
        got = [(largest, *f) for f in fillings(counts, capacity - largest, width)]
        counts[largest] += 1
        return got[::-1]

    stack = [options()] if total else []
    while stack and nodes > 0:
        nodes -= 1
        if len(path) == len(stack):  # back from below: undo
            bin_, largest_was = path.pop()
            for s in bin_:
                counts[s] += 1
            used = sum(bin_)
            left, waste, largest = left + used, waste - (capacity - used), largest_was
        if not stack[-1]:
            stack.pop()
            continue
        bin_ = stack[-1].pop()
        used = sum(bin_)
        last = used == left
        if not last and waste + capacity - used > allowed:
            continue
        path.append((bin_, largest))
        for s in bin_:
            counts[s] -= 1
        left, waste = left - used, waste + capacity - used
        if last:
            if len(path) < most:
                best, most = [list(b) for b, _ in path], len(path)
                allowed = (most - 1) * capacity - total
                if most <= least:
                    return best
            stack.append([])
        else:
            stack.append(options())
    return best
