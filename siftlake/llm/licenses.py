"""License scan: an exact set-similarity join of text blocks with license notices.

Blocks are the lines, of any length, and for each notice the runs of a quarter more words than it has, over the words of the
whole text: line ends are gaps like any other. Runs are looked for in windows of twice as many words as the longest run
has, each half over the next, so every run is within a window.
A block meets a notice if it has at least the threshold's share of the notice's distinct words. Words are ordered by
the number of documents that have them, rarest first, counted over all documents. Then a block of b words can meet
a notice of t words, a of them needed, only if b >= a (length), if the first b - a + 1 words of the one and the
first t - a + 1 of the other share a word (prefix), and if enough words follow the shared one (position).
Every notice that is met gives its label, unless a better one explains it: one of greater share that has at least the
threshold's share of the words met, in a line the same words, in a run those at the same places.
Blocks without any notice's prefix word are dropped while the text is read; what is left is joined by word.

Null texts count as empty. Repeated rows give repeated results; ties of frequency are broken by the word. An empty
table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.llm import common

THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices in common use, one line each.
NOTICES = {
    "agpl-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is granted",
    "lgpl-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "mit": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def notice_words(notices: dict[str, str]) -> dict[str, list[str]]:
    import re

    return {label: sorted(set(re.findall(r"[a-z0-9]+", text.lower()))) for label, text in notices.items()}


def spans(notices: dict[str, str]) -> dict[str, int]:
    """The words of a run in which a notice may stand."""
    import re

    return {label: math.ceil(1.25 * len(re.findall(r"[a-z0-9]+", text.lower()))) for label, text in notices.items()}


def needed(words: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * words - 1e-9))


def _texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _lines(text: Column) -> Column:
    """The words of each line. lower() also changes letters beyond A-Z, none of which becomes or stops being part of
    a word, or turns into a letter of a phrase."""
    return F.transform(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "\n", -1), lambda line: F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))


def frequency_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The words of all notices, rarest first by the documents that have them; as many rows as the notices have words."""
    found = F.array_intersect(F.flatten(_lines(F.col("text"))), _texts(vocabulary))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").count().limit(len(vocabulary)).collect()
    have = {r["word"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (have.get(w, 0), w))


def base_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    same = lambda i: [F.get(words, i + k) == p for k, p in enumerate(parts)]
    every = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))

    def starts(i):
        first, *rest = same(i)
        for x in rest:
            first = first & x
        return first

    return F.filter(every, starts)


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    sets = notice_words(notices)
    order = frequency_order(docs, sorted({w for ws in sets.values() for w in ws}))
    rank = {w: i for i, w in enumerate(order)}
    ranked = {label: sorted(rank[w] for w in ws) for label, ws in sets.items()}
    prefix = sorted({order[r] for rs in ranked.values() for r in rs[: len(rs) - needed(len(rs), threshold) + 1]})
    least = min(needed(len(rs), threshold) for rs in ranked.values())

    gate = "|".join(GAP.join(p.split()) for p in phrases)
    once = F.explode(F.array(_lines(F.col("text"))))  # a generated column is computed once, however often it is used
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).rlike(gate).alias("maybe"), once.alias("lines"))
    read = read.select("doc_id", "lines", "maybe", F.explode(F.array(F.flatten("lines"))).alias("whole"))
    read = read.select("doc_id", "lines", "whole", F.when(F.col("maybe"), F.col("whole")).alias("words"))
    wide = spans(notices)
    step = max(wide.values())
    starts = lambda words: F.sequence(F.lit(0), F.greatest(F.size(words) - step, F.lit(0)), F.lit(step))
    windows = lambda words: F.transform(starts(words), lambda k: F.struct(k.alias("at"), F.slice(words, k + 1, F.lit(2 * step)).alias("all")))
    known = lambda words: F.transform(words, lambda w: F.when(F.array_contains(_texts(order), w), w))

    def blocks(name):
        return F.transform(
            F.filter(name, lambda b: (F.size(b["all"]) >= least) & F.arrays_overlap(b["all"], _texts(prefix))),
            lambda b: F.struct(F.size(F.array_distinct(b["all"])).alias("size"), F.array_intersect(b["all"], _texts(order)).alias("words"), b["at"].alias("at"), F.when(b["at"].isNotNull(), known(b["all"])).alias("run")))

    places = [(label, base_places(F.col("words"), p)) for p, label in phrases.items()]
    cut = F.when(F.arrays_overlap("whole", _texts(prefix)), F.concat(F.transform("lines", lambda line: F.struct(F.lit(None).cast("int").alias("at"), line.alias("all"))), windows(F.col("whole"))))
    read = read.select("doc_id", "words", F.size("whole").cast("long").alias("n_words"), F.explode(F.array(cut)).alias("every"))
    kept = read.select(
        "doc_id", "n_words", F.coalesce(blocks("every"), F.array().cast("array<struct<size int, words array<string>, at int, run array<string>>>")).alias("blocks"),
        *[F.coalesce(p, F.array().cast("array<int>")).alias(f"at{i}") for i, (_, p) in enumerate(places)])
    kept = common.written(kept.withColumn("rid", F.monotonically_increasing_id()), "license-blocks")

    met = joined(kept.select("rid", F.posexplode("blocks").alias("block", "b")), order, ranked, wide, threshold)
    met = unexplained(met, step, threshold)
    met = met.groupBy("rid").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    every = F.concat(*[F.col(f"at{i}") for i in range(len(places))])
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(places)]))))
    out = kept.join(met, "rid", "left").withColumns({"every": every, "base": base})
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", F.size("every").cast("long").alias("n_base"), F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("every") > 0, 1.0).otherwise(0.0)).alias("score"))


def joined(blocks: DataFrame, order: list[str], ranked: dict[str, list[int]], wide: dict[str, int], threshold: float) -> DataFrame:
    """Each (rid, block, label) that meets the threshold, with share, the share of the notice's words in the block, and found:
    these words' ranks or, of a window, their places in the text. Of a window there is a row for each run that meets it.
    blocks: rid, block and b with the block's size, its words that any notice has and, of a window, its place and words in
    order. The index has a row for each prefix word of each notice, whatever the input."""
    spark = blocks.sparkSession
    index = " union all ".join(
        f"select '{order[r]}' word, '{label}' label, {i} i, {len(rs)} t, {needed(len(rs), threshold)} a, {wide[label]} wide, array({', '.join(map(str, rs))}) wanted, array({', '.join(repr(order[r]) for r in rs)}) own"
        for label, rs in ranked.items() for i, r in enumerate(rs[: len(rs) - needed(len(rs), threshold) + 1]))
    index = spark.sql(index)
    ranks = F.create_map(*[F.lit(x) for i, w in enumerate(order) for x in (w, i)])
    known = blocks.select("rid", "block", F.col("b.size").alias("n"), "b.at", "b.run", F.array_sort(F.transform("b.words", lambda w: F.element_at(ranks, w))).alias("known"))
    words = known.select("rid", "block", "n", "at", "run", "known", F.posexplode("known").alias("j", "r"))
    word = F.element_at(_texts(order), F.col("r") + 1)
    near = words.withColumn("word", word).join(F.broadcast(index), "word").where(
        (F.col("n") >= F.col("a")) & (F.col("j") <= F.col("n") - F.col("a")) & (F.least(F.col("t") - F.col("i"), F.size("known") - F.col("j")) >= F.col("a")))
    met = near.where(F.size(F.array_intersect("known", "wanted")) >= F.col("a")).dropDuplicates(["rid", "block", "label"])
    step = max(wide.values())
    # A run begins at a word of the notice that it doesn't have again. One from the window's second half is the next window's.
    begins = lambda k: (F.size("run") < 2 * step) | (k < step)
    starts = F.filter(F.sequence(F.lit(0), F.size("run") - 1), lambda k: begins(k) & F.array_contains(F.col("own"), F.get("run", k)) & ~F.coalesce(F.array_contains(F.slice("run", k + 2, F.col("wide") - 1), F.get("run", k)), F.lit(False)))
    runs = F.transform(starts, lambda k: F.struct(k.alias("k"), F.slice("run", k + 1, F.col("wide")).alias("run")))
    runs = F.transform(runs, lambda x: F.struct(x["k"].alias("k"), x["run"].alias("run"), F.array_intersect(x["run"], F.col("own")).alias("found")))
    places = lambda x: F.array_sort(F.transform(x["found"], lambda w: (F.col("at") + x["k"] + F.array_position(x["run"], w) - 1).cast("int")))
    runs = F.transform(F.filter(runs, lambda x: F.size(x["found"]) >= F.col("a")), places)
    whole = F.array(F.array_intersect("known", "wanted"))
    met = met.select("rid", "block", "label", "t", F.col("run").isNull().alias("line"), F.explode(F.when(F.col("run").isNull(), whole).otherwise(runs)).alias("found"))
    return met.select("rid", "block", "line", "label", (F.size("found") / F.col("t")).alias("share"), "found")


def unexplained(met: DataFrame, step: int, threshold: float) -> DataFrame:
    """(rid, label, share) of joined's rows without those that a better one explains. Runs are compared by stretches of `step`
    words of the text; one that lies in two is compared in both."""
    stretch = lambda place: F.floor(place / step).cast("int")
    places = F.when(F.col("line"), F.array("block")).otherwise(F.sequence(stretch(F.array_min("found")), stretch(F.array_max("found"))))
    rows = met.select("rid", "line", F.explode(places).alias("place"), F.struct("label", "share", "found").alias("x"))
    group = rows.groupBy("rid", "line", "place").agg(F.collect_set("x").alias("all"))
    better = lambda x, y: (y["share"] > x["share"]) & (F.size(F.array_intersect(x["found"], y["found"])) >= threshold * F.size(x["found"]) - 1e-9)
    judged = F.transform("all", lambda x: F.struct(x.alias("x"), F.exists("all", lambda y: better(x, y)).alias("explained")))
    judged = group.select("rid", "line", F.when(F.col("line"), F.col("place")).alias("block"), F.explode(judged).alias("j")).select("rid", "line", "block", "j.*")
    return judged.groupBy("rid", "line", "block", "x").agg(F.max("explained").alias("explained")).where(~F.col("explained")).select("rid", "x.label", "x.share")
