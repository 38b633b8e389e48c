"""The stages of the pipeline, each against plain Python on what the one before kept, and the whole run."""

import zlib

import brute
import numpy as np

import corpus_pipeline as cp
from siftlake.llm import catalog, common, quality


def stage_outputs(spark, docs, sf):
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(common.written(stage(spark, out[-1], sf), f"test-{name}"))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def expected_stages(spark, docs, sf):
    """Rows that each stage but the last should leave, from the rows that the one before should leave."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {(r.doc_id, r.held_out): r.predicted for r in quality.scored(docs, labels).collect()}
    good = [r for r in rows(docs) if scores[r[0], brute.crc_remainder(r[0], 4) == 2]]
    yield good
    groups = brute.components([(r[0], r[1]) for r in good])
    single = list(dict.fromkeys(r for r, (n, least) in zip(good, groups, strict=True) if n == 0 or least == r[0]))
    yield single
    runs = brute.repeated_bytes([(r[1] or "").encode() for r in single], cp.PASSAGE_BYTES, "first")
    cut = []
    for r, spans in zip(single, runs, strict=True):
        data, kept, at = (r[1] or "").encode(), b"", 0
        for b, e in spans:
            kept, at = kept + data[at:b], e
        text = (kept + data[at:]).decode("utf-8", "ignore") if r[1] is not None else None
        cut.append((r[0], text, r[2], r[3], None if text is None else len(text)))
    yield cut
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute.leaks([(r[0], r[1]) for r in cut], items)}
    yield [r for r in cut if r[0] not in leaked]


def check_packing(packed, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(catalog.tokenizer_path())
    expected = []
    for r in docs:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(r[0], k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(expected)
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = stage_outputs(spark, docs, sf)
    for (name, _), got, expected in zip(cp.STAGES, out[1:], expected_stages(spark, docs, sf), strict=False):
        assert got.columns == docs.columns, name
        assert rows(got) == expected, name
        assert got.count() < docs.count()
    check_packing(out[-1].collect(), rows(out[-2]))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(cp.run(spark, sf).select(columns).collect()) == sorted(out[-1].select(columns).collect())


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert [df.count() for df in stage_outputs(spark, docs, sf)] == [0] * 6
