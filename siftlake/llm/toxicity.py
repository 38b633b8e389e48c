"""Toxicity by compression distance: how much shorter windows get with a zstandard dictionary of toxic text than with one of
ordinary text.

Dictionaries are trained on words of labelled documents: the toxic one on words at least LIFT times as frequent (by
documents) in toxic ones and found in LEAST_SHARE of them, without any on rarer such words in at least three documents, and
without those on all words more frequent in toxic ones; the other one on the words of ordinary documents, frequent ones apart. The
toxic dictionary is followed by the ordinary one, so that ordinary text compresses alike with both. Each window of WINDOW
words, half of it overlapping the next, is compressed with both; how many windows reach each gain, the greatest gain and
the number of windows are calibrated on the labels by logistic regression.

Training uses at most MOST_DOCS labelled documents of each class, those with the least hashes of doc_id, and of them
texts up to MOST_CHARS. Scoring reads every window of every text. Null and empty texts have no window and get the
score of that. Null labels train nothing. If a class lacks labels or no word is more frequent in toxic documents, every score is the share of toxic
labels (0.5 without any). Equal texts get equal scores.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlake.llm import common

MOST_DOCS, MOST_CHARS = 3000, 100_000
WINDOW = 6
LIFT, LEAST_SHARE = 10, 0.02
TELLING_BYTES, COMMON_BYTES = 1200, 8192
GAINS = (2, 3, 4, 5, 6, 7, 9)
THRESHOLD = 0.5


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def windows(text: str | None) -> list[bytes]:
    """Each window as bytes with a blank around; a text of fewer words is one window."""
    ws = words(text)
    if not ws:
        return []
    data = " ".join(["", *ws, ""]).encode()
    at = np.concatenate([[0], np.cumsum([len(w.encode()) + 1 for w in ws])]).tolist()
    step = WINDOW // 2
    return [data[at[i] : at[min(i + WINDOW, len(ws))] + 1] for i in range(0, max(1, len(ws) - step), step)]


def _trained(counts: dict[str, int], size: int, segment: int) -> bytes:
    """A dictionary of the words, each as a sample as often as counted; of too few samples, the samples themselves."""
    import zstandard

    samples = [f" {w} ".encode() for w, n in sorted(counts.items()) for _ in range(n)]
    samples = [samples[i] for i in np.random.default_rng(1).permutation(len(samples))]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8 if segment < 32 else 6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class Dictionaries:
    def __init__(self, toxic: list[str | None], ordinary: list[str | None]):
        bad, good = Counter(), Counter()
        for texts, counts in ((toxic, bad), (ordinary, good)):
            for t in dict.fromkeys(texts):
                counts.update(set(words(t)))
        n_bad, n_good = max(1, len(set(toxic))), max(1, len(set(ordinary)))
        for least, lift in ((max(3, LEAST_SHARE * n_bad), LIFT), (3, LIFT), (1, 1)):
            telling = {w: n for w, n in bad.items() if n >= least and good[w] / n_good * lift <= n / n_bad and good[w] / n_good < n / n_bad}
            if telling:
                break
        self.telling = len(telling)
        by_count = [w for w, _ in sorted(good.items(), key=lambda x: (-x[1], x[0]))]
        plain = {w: good[w] for w in by_count[200:4000]}
        base = _trained({w: min(20, good[w]) for w in by_count[:20000]}, COMMON_BYTES, 32)
        ordinary_part = _trained(plain, TELLING_BYTES, 24) + base
        self.contents = [ordinary_part, _trained(telling, TELLING_BYTES, 24) + ordinary_part] if telling else []

    def compressors(self):
        import zstandard

        params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        out = []
        for c in self.contents:
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        return out


def _features(gains: np.ndarray) -> list[float]:
    if not len(gains):
        return [0.0] * (len(GAINS) + 3)
    return [*np.log1p((gains[:, None] >= np.array(GAINS)).sum(axis=0)).tolist(), float(np.log1p(len(gains))), float(gains.max()), float(gains.min())]


def _measured(texts, compressors) -> np.ndarray:
    """Features of each text; a text met again in the batch is not compressed again."""
    plain, toxic = (c.compress for c in compressors)
    known: dict[str, list[float]] = {}
    out = []
    for t in texts:
        t = t or ""
        if t not in known:
            known[t] = _features(np.array([len(plain(w)) - len(toxic(w)) for w in windows(t)]))
        out.append(known[t])
    return np.array(out).reshape(-1, len(GAINS) + 3)


class Calibration:
    """Logistic regression with a small ridge on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._rows(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            self.w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(self.w)), z.T @ (p - y) + self.w)

    def _rows(self, x):
        return np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._rows(x) @ self.w, -30, 30)))


class Model:
    def __init__(self, share: float, dictionaries: Dictionaries | None = None, calibration: Calibration | None = None):
        self.share, self.dictionaries, self.calibration = share, dictionaries, calibration


def train(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS) -> Model:
    """A model from labelled rows whose crc32 remainder by 5 isn't 0."""
    known = labels.where(F.col("toxic").isNotNull() & (common.crc_remainder(F.col("doc_id"), 5) != 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    shares = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("k")).first()
    share = shares["k"] / shares["n"] if shares["n"] else 0.5
    chosen = [known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs) for v in (1, 0)]
    chosen = common.written(chosen[0].unionByName(chosen[1]), "toxic-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= MOST_CHARS)
    sample = common.written(texts.join(F.broadcast(chosen), "doc_id").select("text", "y"), "toxic-texts")  # 2 * most_docs rows at most
    rows = sample.orderBy("y", "text").toArrow()
    got = list(zip(rows["text"].to_pylist(), rows["y"].to_pylist(), strict=True))
    dictionaries = Dictionaries([t for t, y in got if y == 1], [t for t, y in got if y == 0])
    if not dictionaries.contents or len({y for _, y in got}) < 2:
        return Model(share)

    def run(batches):
        compressors = dictionaries.compressors()
        for b in batches:
            x = _measured(b.column(0).to_pylist(), compressors)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    spread = sample.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    measured = spread.mapInArrow(run, "x array<double>, y int").orderBy("y", "x").toArrow()
    return Model(share, dictionaries, Calibration(np.array(measured["x"].to_pylist()), measured["y"].to_numpy().astype(float)))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = train(docs, labels)

    def run(batches):
        compressors = model.dictionaries.compressors() if model.calibration else None
        for b in batches:
            s = model.calibration.scores(_measured(b.column(1).to_pylist(), compressors)) if model.calibration else np.full(b.num_rows, model.share)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", (common.crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
