"""Phrase mining against plain Python."""

import collections
import re

import brute
import numpy as np

from siftlake.llm import collocations, textarrays


def plain(rows, least, longest, cover, top):
    """rows of (lang, text)."""
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.lower(text)):
            ws = tuple(re.findall("[^\x20\x09]+", piece))
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f["und" if lang is None else lang][ws[i : i + k]] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for w, v in c.items() if len(w) == 1)
        some = {w: a for w, a in c.items() if len(w) > 1 and a >= least}
        rows = []
        for w, a in some.items():
            if any(100 * b >= cover * a for v, b in some.items() if len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))):
                continue
            cuts = [(1000000 * a * a // (c[w[:k]] * c[w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(w).encode(), c[w[:k]], c[w[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return out


def table(spark, rows):
    rows = [(i, t, lang, "s", 3, "h") for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, words string, k int, h string").repartition(4)


def rows_of(seed, n, vocabulary, lang):
    rng = np.random.default_rng(seed)
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!", "?", ";", ":", "\x0b"]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(int(rng.integers(0, 60))))
        out.append((lang, text))
    return out


def check(spark, rows, least=10, longest=3, cover=50, top=2000):
    got = collocations.collocations(table(spark, rows), least, longest, cover, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = plain(rows, least, longest, cover, top)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(expected)
    return expected


def test_phrases_on_odd_rows(spark, odd_rows):
    rows = rows_of(1, 120, ["the", "The", "of", "é", "日本", "don't", "\x00x", "a-b"], "en") + rows_of(2, 60, ["la", "le", "the"], None)
    rows += [("en", None), ("en", ""), ("fr", " \t "), ("und", "la le " * 30), ("", "x y. x y! x y? " * 12), ("en", "same words here " * 40)]
    rows += [(None if i % 2 else "de", t) for i, (_, t) in enumerate(odd_rows) if t and len(t) < 5000]
    rows += [rows[0]] * 5
    assert check(spark, rows)
    check(spark, rows, least=2, longest=4, cover=80, top=7)


def test_no_frequent_phrase_and_empty_table(spark):
    assert check(spark, [("en", "one two three"), ("fr", "un deux")]) == []
    assert check(spark, []) == []


def test_runs_of_any_size(spark, monkeypatch):
    """Small runs, texts of many runs, one piece longer than a run, counts handed on often."""
    rows = rows_of(3, 80, ["p", "q", "r s", "t"], "en") + [("en", "long piece without any end " * 60), ("en", "p q. " * 300), ("en", "w" * 700)]
    monkeypatch.setattr(textarrays, "LIMIT", 211)
    monkeypatch.setattr(collocations, "COUNTED", 50)
    check(spark, rows)


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(textarrays, "span_hashes", lambda sums, starts, ends: np.zeros(len(starts), np.uint64))
    buf = np.frombuffer(b"\nab cd ab ef\n", np.uint8)
    starts, ends = textarrays.word_bounds(buf, collocations._WORD)
    first, codes = collocations._distinct(buf, starts, ends)
    assert codes.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]


def test_places_leave_a_gap_between_pieces(spark):
    row = collocations._runs(table(spark, [("en", "a b, c\nd a")])).toArrow().combine_chunks().to_batches()[0]
    run = collocations._Run(row, 0)
    words = run.strings().to_pylist()
    assert [words[c] for c in run.codes] == ["a", "b", "c", "d", "a"] and run.places.tolist() == [0, 1, 3, 5, 6]


def test_runs_of_very_many_words():
    words = " ".join(f"w{i}" for i in range(70_000)).encode()
    codes = np.arange(70_000)[::-1]
    run = collocations._Run(collocations._row("en", words, 70_000, codes, codes[1:] % 3 == 0), 0)
    assert (run.codes == codes).all() and run.strings()[69_999].as_py() == "w69999" and (np.diff(run.places) == np.where(codes[1:] % 3 == 0, 1, 2)).all()


def test_merge_join_of_sorted_occurrences():
    places = np.array([0, 1, 2, 4, 5, 9])
    assert collocations._joined(np.array([0, 1, 2, 3, 4, 5]), places).tolist() == [0, 1, 3]
    assert collocations._in_piece(places, 3).tolist() == [0]
