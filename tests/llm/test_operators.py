"""Every operator against plain Python, on the smallest tables and on odd rows."""

import collections
import hashlib
import zlib

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siftlake.llm import catalog, decontaminate, kdtree, language, licenses, packing, quality, signature_tree, sketches, suffixes, textarrays, toxicity


def texts(sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


def same_rows(got, expected):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, expected))


@pytest.fixture(scope="module")
def inputs(spark, sf, frame, odd_rows):
    return [(spark.read.parquet(f"{sf}/documents.parquet"), texts(sf)), (frame(odd_rows), odd_rows), (frame([]), [])]


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{i % 501}" for i in range(5000))
    whole = next(textarrays.shingle_sets(pa.array([text])))
    monkeypatch.setattr(textarrays, "LIMIT", 997)
    assert (next(textarrays.shingle_sets(pa.array([text]))) == whole).all()


def test_op1(spark, inputs, sf):
    b = pq.read_table(f"{sf}/benchmark.parquet").to_pydict()
    items = list(zip(b["item_id"], b["text"], strict=True)) + [(900, None), (901, ""), (902, "one two"), (903, items_text := b["text"][0]), (904, "The quick brown fox jumps over the lazy dog and then some more words")]
    assert items_text
    bench = spark.createDataFrame(items, "item_id long, text string")
    for docs, rows in inputs:
        named = [(d, t) for d, t in rows if d is not None]
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(docs.where("doc_id is not null"), bench).collect()}
        assert got == pytest.approx(brute.leaks(named, items))
        gone = {d for d, _ in got}
        kept = decontaminate.clean(docs.where("doc_id is not null"), bench)
        assert kept.columns == docs.columns
        same_rows(kept.select("doc_id").collect(), [(d,) for d, _ in named if d not in gone])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(inputs[0][0], empty).count() == 0 and decontaminate.clean(inputs[0][0], empty).count() == inputs[0][0].count()


@pytest.mark.parametrize("times", [1, 2, 10])
def test_op1_near_copies_of_repeated_items(spark, frame, times):
    rng = np.random.default_rng(21)
    words = [str(w) for w in rng.permutation([f"t{i}" for i in range(900)])]
    item, near = words[:100], words[:100]
    near[30], near[70] = "changed", "too"
    template = [words[100:160] + words[200 + 40 * k : 240 + 40 * k] for k in range(times)]
    like = list(template[0])
    like[30], like[97] = "changed", "too"
    rows = [(1, " ".join(words[600:700] + near + words[700:800])), (2, " ".join(words[800:850] + like + words[850:900])), (3, " ".join(words[600:900]))]
    items = [(i, " ".join(item).upper() if i % 2 else " ".join(item)) for i in range(times)] + [(100 + k, " ".join(t)) for k, t in enumerate(template)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(frame(rows), bench).collect()}
    assert {i: s for (d, i), s in got.items() if d == 1} == pytest.approx({i: 86 / 106 for i in range(times)}, abs=1e-6)
    assert (2, 100) in got and not [d for d, _ in got if d == 3]
    assert [r.doc_id for r in decontaminate.clean(frame(rows), bench).collect()] == [3]


def test_op1_slices(spark, inputs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert len(list(decontaminate.indexes(bench, slice_bytes=1000))) > 1
    whole = next(iter(decontaminate.indexes(bench)))
    assert sum(len(x.ids) for x in decontaminate.indexes(bench, slice_bytes=1000)) == len(whole.ids)


def test_op1_blocks_find_all_within_radius():
    rng = np.random.default_rng(3)
    items = [(i, 9, rng.integers(0, 2**63, 5).astype(np.uint64)) for i in range(70)]
    index = decontaminate.Index(items, {int(x): 1.0 for _, _, h in items for x in h})
    prints = index.prints[rng.integers(0, 70, 500)]
    for _ in range(23):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    got = set(zip(*(x.tolist() for x in index.within(prints)), strict=True))
    near = np.bitwise_count(prints[:, None] ^ index.prints[None, :]) <= decontaminate.RADIUS
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_op2(inputs):
    for docs, rows in inputs:
        got = signature_tree.groups(docs).select("doc_id", "n_shingles", "component_id").collect()
        expected = brute.components(rows)
        same_rows(got, [(d, n, c if n else d) for (d, _), (n, c) in zip(rows, expected, strict=True)])


def near_copies(n, words=60, seed=5):
    """Families of near copies, some of which link only through others."""
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, words))] = f"x{rng.integers(0, 40)}"
        out.append((i, " ".join(w)))
    return out


def test_op2_near_copies_and_large_blocks(frame, monkeypatch):
    monkeypatch.setattr(signature_tree, "TILE", 8)
    rows = near_copies(150) + [(1000 + d, t.replace("b", "c")) for d, t in near_copies(60, seed=6)]
    got = signature_tree.groups(frame(rows)).select("doc_id", "n_shingles", "component_id").collect()
    same_rows(got, [(d, n, c) for (d, _), (n, c) in zip(rows, brute.components(rows), strict=True)])
    assert len({r.component_id for r in got}) > 2


def test_op2_without_bands(frame, monkeypatch):
    monkeypatch.setattr(signature_tree, "_band_links", lambda docs, summaries, pct: docs.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(signature_tree, "TILE", 16)
    rows = near_copies(120)
    got = signature_tree.groups(frame(rows)).select("doc_id", "n_shingles", "component_id").collect()
    same_rows(got, [(d, n, c) for (d, _), (n, c) in zip(rows, brute.components(rows), strict=True)])


@pytest.mark.parametrize("most", [1, 3])
def test_op2_pairs_left_out_of_the_first_traversal_are_looked_at(frame, monkeypatch, most):
    bands, calls, mixed = signature_tree._band_links, [], signature_tree._mixed
    monkeypatch.setattr(signature_tree, "_band_links", lambda *a: bands(*a).where("pmod(a, 3) = 0"))  # groups that are not whole
    monkeypatch.setattr(signature_tree, "_mixed", lambda *a: calls.append(1) or mixed(*a))
    monkeypatch.setattr(signature_tree, "MOST", most)
    rows = near_copies(150)
    got = signature_tree.groups(frame(rows)).select("doc_id", "n_shingles", "component_id").collect()
    same_rows(got, [(d, n, c) for (d, _), (n, c) in zip(rows, brute.components(rows), strict=True)])
    assert 1 <= len(calls) <= 2


def test_op2_blocks_are_traversed_once(frame, monkeypatch):
    calls, mixed = [], signature_tree._mixed
    monkeypatch.setattr(signature_tree, "_mixed", lambda *a: calls.append(1) or mixed(*a))
    monkeypatch.setattr(signature_tree, "_band_links", lambda docs, summaries, pct: docs.sparkSession.createDataFrame([], "a long, b long"))
    signature_tree.groups(frame(near_copies(60))).count()
    assert len(calls) == 1


def test_op2_written_blocks_hold_no_bitmaps(frame, monkeypatch):
    tables, written = {}, signature_tree.common.written
    monkeypatch.setattr(signature_tree.common, "written", lambda df, name, **kw: tables.setdefault(name, df.columns) and written(df, name, **kw))
    monkeypatch.setattr(signature_tree, "TILE", 16)
    signature_tree.groups(frame(near_copies(60))).count()
    assert "blocks" in tables and not any("bits" in c for name, c in tables.items() if "block" in name or "large" in name)


def test_op2_roots_with_more_pairs_are_marked():
    x, y = np.array([1, 1, 2, 1, 2]), np.array([5, 5, 6, 5, 7])
    at, more = signature_tree.most_likely(x, y, np.array([0.8, 0.9, 0.9, 0.85, 0.8]), 2)
    assert at.tolist() == [1, 3, 2, 4] and more.tolist() == [True, True, False, False]


def test_op2_tree_keeps_all_links():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(300):
        base = rng.integers(0, 2**63, int(rng.integers(1, 400)), dtype=np.int64).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base, rng.integers(0, 2**63, max(1, len(base) // 6), dtype=np.int64).astype(np.uint64)]))]
    sizes = np.array([len(s) for s in sets])
    found = {(min(a, b), max(a, b)) for i, j, _ in signature_tree.candidates([signature_tree.bitmap(s, signature_tree.bitmap_words(len(s))) for s in sets], sizes) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    every = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if signature_tree.linked(sets[a], sets[b])}
    assert every <= found and len(found) < 3 * len(every) + 50


def test_op2_representatives(frame, odd_rows):
    kept = signature_tree.representatives(frame(odd_rows))
    ids = [r.doc_id for r in kept.collect()]
    assert collections.Counter(ids) == collections.Counter([1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16])


def test_op3(inputs):
    for docs, rows in inputs:
        got = kdtree.shards(docs, parts=8).collect()
        same_rows([(r.doc_id, r.size, r.text_crc32) for r in got], [(d, len((t or "").encode()) + 1, brute.crc(t)) for d, t in rows])
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))


def test_op3_sizes_are_near_equal(spark, sf):
    size = collections.Counter()
    for r in kdtree.shards(spark.read.parquet(f"{sf}/documents.parquet"), parts=8).collect():
        size[r.shard] += r.size
    largest = max(len(t.encode()) + 1 for _, t in texts(sf))
    assert max(size.values()) - min(size.values()) <= 2 * largest


def test_op3_target(spark, sf, frame):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = kdtree.shards(docs, target_bytes=40_000).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b < kdtree.SLACK * 40_000 or r.n == 1 for r in got)
    same = frame([(1, "same")] * 64)
    assert [r.n for r in kdtree.shards(same, parts=8).groupBy("shard").agg(F.count("*").alias("n")).collect()] == [8] * 8


def held_out_accuracy(rows, truth, right):
    pairs = [(r, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(right(r, y) for r, y in pairs) / len(pairs)


def test_op4(spark, inputs):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.scored(spark.read.parquet(f"{d}/documents.parquet"), labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (brute.crc_remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert held_out_accuracy(rows, truth, lambda r, y: r.predicted == y) > 0.95
    odd, given = inputs[1]
    assert quality.scored(odd, labels).count() == len(given) and quality.scored(inputs[2][0], labels).count() == 0
    assert {r.score for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.kept(odd, labels).columns == odd.columns


def test_op5(spark, inputs, sf):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = language.predicted(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert held_out_accuracy(rows, truth, lambda r, y: r.lang_pred == y) > 0.98
    odd, given = inputs[1]
    got = language.predicted(odd).collect()
    assert len(got) == len(given) and {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 15)} == {"und"}
    assert language.predicted(inputs[2][0]).count() == 0
    mixed = spark.createDataFrame([(1, truth_text(docs, "en") + " " + truth_text(docs, "de"))], "doc_id long, text string")
    spans = language.identified(mixed, language.train(docs), with_spans=True).first().spans
    assert [s.lang for s in spans] == ["en", "de"]


def truth_text(docs, lang):
    return max((r.text for r in docs.where(F.col("lang") == lang).where(F.length("text").between(500, 800)).collect()), key=lambda t: sum(c.isalpha() for c in t))


def test_op5_paths_are_best():
    rng = np.random.default_rng(2)
    model = language.Model(["a", "b", "c"], np.ones((3, language.SLOTS)))
    lengths = [0, 1, 2, 5, 6, 0, 4]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = (rng.normal(size=(first[-1], 3)) * 12).astype(np.float32)
    path = model.paths(scores, first)

    def value(e, p):
        return sum(e[i, x] for i, x in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False))

    import itertools

    for a, b in zip(first[:-1], first[1:], strict=True):
        best = max((value(scores[a:b], p) for p in itertools.product(range(3), repeat=int(b - a))), default=0)
        assert value(scores[a:b], path[a:b].tolist()) == pytest.approx(best, abs=1e-3)


def test_op6(spark, inputs):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.scored(spark.read.parquet(f"{d}/documents.parquet"), labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (brute.crc_remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    hits = [r.predicted for r in rows if r.held_out and truth.get(r.doc_id) == 1]
    false = [r.predicted for r in rows if r.held_out and truth.get(r.doc_id) == 0]
    assert np.mean(hits) > 0.65 and np.mean(false) < 0.02
    odd, given = inputs[1]
    assert toxicity.scored(odd, labels.limit(0)).count() == len(given) and toxicity.scored(inputs[2][0], labels).count() == 0


def test_op6_learns_from_rare_words(spark, frame):
    rng = np.random.default_rng(6)
    prose, bad = [f"plain{i}" for i in range(300)], ["zq" + "".join(rng.choice(list("bcdfghjk"), 6)) for _ in range(80)]
    rows = [(i, " ".join([*rng.choice(prose, 20), *([bad[i // 2 % 80]] if i % 2 else []), *rng.choice(prose, 20)])) for i in range(800)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(800)], "doc_id long, quality int, toxic int")
    d = toxicity.Dictionaries([t for i, t in rows if i % 2], [t for i, t in rows if not i % 2])
    assert d.contents and d.telling > 0
    got = [r for r in toxicity.scored(frame(rows), labels).collect() if r.held_out]
    assert np.mean([r.score for r in got if r.doc_id % 2]) > np.mean([r.score for r in got if not r.doc_id % 2]) + 0.1


def test_op6_windows_cover_every_word():
    t = " ".join(f"w{i}" for i in range(23))
    seen = {w for x in toxicity.windows(t) for w in x.decode().split()}
    assert seen == set(t.split()) and toxicity.windows(None) == [] and toxicity.windows("Ä b") == [" ä b ".encode()]


def expected_digests(rows, n):
    data = [(t or "").encode() for _, t in rows]
    return [(d, *brute.digest(t, r)) for (d, _), t, r in zip(rows, data, brute.repeated_bytes(data, n), strict=True)]


def test_op7(inputs, sf):
    for docs, rows in inputs:
        rows = [r for r in rows if r[1] is None or len(r[1]) < 100_000]
        docs = docs.where("text is null or length(text) < 100000")
        for n in (400, 60):
            same_rows(suffixes.digests(docs, n).collect(), expected_digests(rows, n))


@pytest.mark.parametrize("most", [512, 2])
def test_op7_keep_first_and_counted_anchors(frame, monkeypatch, most):
    monkeypatch.setattr(suffixes, "SORTED", most)
    rng = np.random.default_rng(4)
    words = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 40))
    rows = [(i, " ".join([*rng.choice(words, int(rng.integers(0, 30))), passage, *rng.choice(words, int(rng.integers(0, 30))), *([passage] if i % 5 == 0 else [])])) for i in range(25)]
    rows += [(30, "ab" * 200), (31, "xy" + "ab" * 150)]
    docs = frame(rows)
    for keep in ("none", "first"):
        data = [t.encode() for _, t in rows]
        runs = brute.repeated_bytes(data, 80, keep)
        same_rows(suffixes.digests(docs, 80, keep).collect(), [(d, *brute.digest(t, r)) for (d, _), t, r in zip(rows, data, runs, strict=True)])
    cut = suffixes.deduplicated(docs, 80)
    assert cut.columns == docs.columns and cut.schema == docs.schema


def test_op7_spans_do_not_grow_with_near_copies(spark, frame, monkeypatch):
    """Anchors with very many different windows give runs, not single starts: the more copies, the same spans a document."""
    monkeypatch.setattr(suffixes, "SORTED", 16)
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(900)]
    base = rng.choice(words, 150).tolist()
    most = []
    for copies in (40, 160):
        rows = []
        for i in range(copies):
            text = list(base)
            text[int(rng.integers(0, 150))] = f"own{i}"
            rows.append((i, " ".join(text)))
        docs = frame(rows).select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text")
        got = suffixes.spans(docs, 80)
        assert "explode" not in got._jdf.queryExecution().executedPlan().toString()
        most.append(got.agg(F.max(F.size("spans"))).first()[0])
        runs = brute.repeated_bytes([t.encode() for _, t in rows], 80, "none")
        assert {r.doc_id: suffixes.merged([s.asDict() for s in r.spans]) for r in got.collect()} == {d: [tuple(x) for x in r] for (d, _), r in zip(rows, runs, strict=True) if r}
    assert most[1] <= most[0] + 4


def test_op7_long_texts_in_parts(frame, monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{i * 7919 % 3001}" for i in range(6000))
    whole = list(suffixes._parts(pa.array([text]), 80))
    monkeypatch.setattr(textarrays, "LIMIT", 4096)
    parts = list(suffixes._parts(pa.array([text]), 80))
    starts = lambda ps: sorted(x + p[4] for p in ps for f, e in zip(*suffixes.windows(p[1], p[2], 80)[3:], strict=True) for x in range(f, e + 1))
    assert len(parts) > 2 and starts(parts) == starts(whole)


def test_op8(inputs):
    for docs, rows in inputs:
        got = licenses.scan(docs).collect()
        same_rows([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], [(d, *brute.base_places(t, licenses.PHRASES)) for d, t in rows])


def test_op8_join_is_exact(frame):
    sets = licenses.notice_words(licenses.NOTICES)
    rng = np.random.default_rng(8)
    lines = []
    for ws in sets.values():
        for keep in (1.0, 0.85, 0.7):
            part = [w for w in ws if rng.random() < keep]
            lines.append(" ".join(rng.permutation([*part, *rng.choice(["the", "of", "x", "is"], 3)])))
    rows = [(i, "no notice here\n" + line + "\nend") for i, line in enumerate(lines)]
    for r in licenses.scan(frame(rows), phrases=licenses.PHRASES).collect():
        best = collections.defaultdict(set)
        for line in rows[r.doc_id][1].split("\n"):
            have = set(brute.ALNUM.findall(brute.lower(line)))
            shares = {label: len(have & set(ws)) / len(ws) for label, ws in sets.items() if len(have & set(ws)) >= licenses.needed(len(ws), licenses.THRESHOLD)}
            if shares:
                best[max(shares.values())] |= {k for k, v in shares.items() if v == max(shares.values())}
        own = set().union(*best.values()) if best else set()
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == own | base
        assert r.score == pytest.approx(1.0 if base else max(best, default=0.0))


WRAPPED = {
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "isc": "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above\n# copyright notice and this permission notice appear in all copies.",
}


def test_op8_wrapped_notices(frame):
    rows = [(len(WRAPPED) * n + i, "v " * n + "\n" + text + "\n" + "z " * 70) for n in (0, 7, 19, 40) for i, text in enumerate(WRAPPED.values())]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame(rows)).collect()}
    for n in (0, 7, 19, 40):
        for i, label in enumerate(WRAPPED):
            assert got[len(WRAPPED) * n + i] == (label, 1.0)
    apart = licenses.scan(frame([(1, "Licensed under the Apache License, Version 2.0\n" + "u " * 8 + "mit " + "u " * 8)])).first()
    assert apart.labels == "apache-2.0"  # a word of a short notice further off isn't part of it
    each = [(i, text.replace(" ", "\n")) for i, text in enumerate(licenses.NOTICES.values())]
    for r in licenses.scan(frame(each)).collect():
        assert list(licenses.NOTICES)[r.doc_id] in r.labels.split(",") and r.score == 1.0


def test_op8_notices_beside_each_other(frame):
    apache, bsd, lgpl, agpl = (licenses.NOTICES[k] for k in ("apache-2.0", "bsd-3-clause", "lgpl-3.0", "agpl-3.0"))
    bsd, lgpl = bsd.replace("modification, ", ""), lgpl.replace("Lesser ", "")
    cases = [
        (f"{apache}. {bsd}.", "apache-2.0,bsd-3-clause"), (f"{apache}\n{bsd}", "apache-2.0,bsd-3-clause"), (agpl, "agpl-3.0,gpl"),
        (f"{agpl}. {apache}.", "agpl-3.0,apache-2.0,gpl"), (f"{agpl}. {agpl}.", "agpl-3.0,gpl"), (f"{agpl}. {lgpl}.", "agpl-3.0,gpl,lgpl-3.0"),
    ]
    rows = [(100 * n + i, "q " * n + text + " q" * 60) for n in (0, 5, 11, 14, 18, 22, 30) for i, (text, _) in enumerate(cases)]
    for r in licenses.scan(frame(rows)).collect():
        assert (r.labels, r.score) == (cases[r.doc_id % 100][1], 1.0), r.doc_id


def test_op9(inputs):
    from tokenizers import Tokenizer

    path = catalog.tokenizer_path()
    whole = Tokenizer.from_file(path)
    for docs, rows in inputs:
        got = packing.packed(docs, path, with_ids=True).collect()
        expected = collections.Counter()
        for d, t in rows:
            ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            for k, s in enumerate(range(0, len(ids), 2048)):
                expected[d, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), tuple(ids[s : s + 2048].tolist())] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == expected
        at = collections.defaultdict(list)
        for r in got:
            at[r.sequence_id].append((r.offset, r.length))
        for pieces in at.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= 2048
        if got:
            assert len(at) <= -(-sum(r.length for r in got) // 2048) + 1


def test_op9_chunks_give_the_ids_of_whole_texts(monkeypatch):
    """Words and marks taken apart, special tokens whole, a table that is emptied often."""
    from tokenizers import Tokenizer
    import pyarrow as pa

    path = catalog.tokenizer_path()
    whole, rng = Tokenizer.from_file(path), np.random.default_rng(12)
    parts = ["Don't", "it's", "we'll", "x-y", "a.b", "(c)", "...", "?!", "é,", ",é", "1,2", "a1", "_a", "日本,", "<|", "|>", "<|endoftext|>", "A\u0301b", "end.", '"q"', " ", "\n", "\t", "'s", "s'", "I'd", "a'b,c", "~a~"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 40)))) for _ in range(400)]
    monkeypatch.setattr(packing.Encoder, "most", 3000)
    encoder = packing.Encoder(path)
    assert encoder.apart
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_op9_encoder_serves_several_tasks_and_goes_when_idle():
    import time

    held = packing._Held()
    held.idle_seconds = 0.3
    path = catalog.tokenizer_path()
    one = held.take(path)
    held.give_back()
    assert held.take(path) is one  # the timer of the task before is off
    time.sleep(0.6)
    assert held.encoder is one
    held.give_back()
    time.sleep(0.6)
    assert held.encoder is None and held.take(path) is not one


def test_op9_special_strings(frame):
    path = catalog.tokenizer_path()
    from tokenizers import Tokenizer

    text = "plain <|endoftext|> words<|endoftext|>more <|startoftext|> <| x"
    got = packing.pieces(frame([(1, text)]), path, with_ids=True).first()
    assert got.ids == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("seed", range(6))
def test_op9_search_is_no_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 60) if seed % 2 else rng.integers(26, 70, 40)
    counts = np.bincount(lengths, minlength=101)
    bins = packing.complete_bins(counts, 100)
    assert collections.Counter(x for b in bins for x in b) == collections.Counter(lengths.tolist())
    assert all(sum(b) <= 100 for b in bins) and len(bins) <= len(packing.best_fit(counts, 100))


def test_op9_finds_a_perfect_packing():
    counts = np.bincount([60, 60, 60, 30, 30, 30, 10, 10, 10], minlength=101)
    assert len(packing.complete_bins(counts, 100)) == 3


def test_op10(inputs):
    for docs, rows in inputs:
        got = {(r.doc_id, r.edited_sha256): r for r in sketches.edits(docs).collect()}
        order = sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0))
        named = [r for _, r in order]
        assert sum(1 for _ in sketches.edits(docs).collect()) == len(rows)
        if len({d for d, _ in rows}) < len(rows):
            continue
        for k, (d, t) in enumerate(named):
            following = named[(k + 1) % len(named)][1]
            q = len(t) // 4
            edited = t[: len(t) - q] + following[:q]
            r = got[d, hashlib.sha256(edited.encode()).hexdigest()]
            a, b, c = (set(brute.shingles(brute.WORDS.findall(brute.lower(x)))) for x in (t, edited, following))
            like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
            assert abs(r.near_edited - like(a, b)) < 0.25 and abs(r.near_next - like(a, c)) < 0.25 and r.n_chars == len(t)


def test_op10_order_and_blocks(frame):
    rows = [(i * 3, f"text {i} " + " ".join(f"w{i}_{k}" for k in range(i % 7))) for i in range(40)]
    got = {r.doc_id: r.edited_sha256 for r in sketches.edits(frame(rows), rows_per_block=3).collect()}
    for k, (d, t) in enumerate(rows):
        q = len(t) // 4
        assert got[d] == hashlib.sha256((t[: len(t) - q] + rows[(k + 1) % 40][1][:q]).encode()).hexdigest()


def test_op10_sketches_merge():
    import pyarrow as pa

    a, b = " ".join(f"a{i}" for i in range(900)), " ".join(f"a{i}" for i in range(450, 1350))
    sa, sb = sketches.sketches(pa.array([a])), sketches.sketches(pa.array([b]))
    assert sketches.resemblance(sa, sb)[0] == pytest.approx(446 / 1346, abs=0.12)
    assert sketches.containment(sa, sb)[0] == pytest.approx(446 / 896, abs=0.17)
    assert sketches.distinct(sketches.merge(sa, sb))[0] == pytest.approx(1346, rel=0.3)
    assert (sketches.decoded(sketches.encoded(sa)) == sa).all()


def test_fingerprints_keep_columns(frame, odd_rows):
    docs = frame(odd_rows)
    got = sketches.fingerprints(docs)
    assert got.columns == [*docs.columns, "fingerprint"] and got.count() == len(odd_rows)
    prints = {r.doc_id: r.fingerprint for r in got.collect()}
    assert prints[1] == prints[2] != prints[3] and prints[4] == prints[5] == ""
