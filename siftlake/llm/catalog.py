"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.llm import collocations, decontaminate, kdtree, language, licenses, negatives, packing, quality, signature_tree, sketches, suffixes, topk, toxicity
from siftlake.llm.common import table

QUERIES, ORACLE = {}, {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_benchmark_decontamination(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return signature_tree.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_kd_tree_shards(spark, sf_dir):
    got = kdtree.shards(table(spark, sf_dir, "documents"), parts=8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality_classifier(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark, sf_dir):
    return language.predicted(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_array_dedup(spark, sf_dir):
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_document_fingerprints(spark, sf_dir):
    return sketches.edits(table(spark, sf_dir, "documents"))


def op11_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_phrase_collocations(spark, sf_dir):
    got = collocations.collocations(table(spark, sf_dir, "documents"))
    return got.withColumn("rank", F.col("rank").cast("long"))


def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES["op1_benchmark_decontamination"] = op1_benchmark_decontamination
QUERIES["op2_ngram_jaccard_join"] = op2_ngram_jaccard_join
QUERIES["op3_kd_tree_shards"] = op3_kd_tree_shards
QUERIES["op4_quality_classifier"] = op4_quality_classifier
QUERIES["op5_language_id"] = op5_language_id
QUERIES["op6_toxicity"] = op6_toxicity
QUERIES["op7_suffix_array_dedup"] = op7_suffix_array_dedup
QUERIES["op8_license_scan"] = op8_license_scan
QUERIES["op9_best_fit_packing"] = op9_best_fit_packing
QUERIES["op10_document_fingerprints"] = op10_document_fingerprints
QUERIES["op11_exact_top_k"] = op11_exact_top_k
QUERIES["op12_phrase_collocations"] = op12_phrase_collocations
QUERIES["op13_hard_negatives"] = op13_hard_negatives

# --- SQL counterparts. An operator with hashes, models or tokens of its own has none; tests compare it with plain Python.

ORACLE["op2_ngram_jaccard_join"] = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(sh) AS n_shingles, component_id FROM s JOIN c ON doc_id = a"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _phrase_places(phrase: str) -> str:
    same = " AND ".join(f"ws[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))
    return f"list_filter(range(0, len(ws)), lambda i: coalesce({same}, false))"


_AT = ", ".join(f"{_phrase_places(p)} AS at{i}" for i, p in enumerate(licenses.PHRASES))
_EVERY = " || ".join(f"at{i}" for i in range(len(licenses.PHRASES)))
_BASE = "list_filter([" + ", ".join(f"CASE WHEN len(at{i}) > 0 THEN '{label}' END" for i, label in enumerate(licenses.PHRASES.values())) + "], lambda v: v IS NOT NULL)"
_NOTICES = ", ".join(f"('{label}', [{', '.join(repr(w) for w in ws)}])" for label, ws in licenses.notice_words(licenses.NOTICES).items())
ORACLE["op8_license_scan"] = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, {_WORDS}) AS ws FROM d), p AS (SELECT *, {_AT} FROM w), e AS (SELECT *, {_EVERY} AS every, list_sort({_BASE}) AS base FROM p),
l AS (SELECT rid, row_number() OVER () AS line, list_distinct(regexp_extract_all(one, {_WORDS})) AS lw FROM (SELECT rid, unnest(string_split(t, chr(10))) AS one FROM d)),
notice(label, nw) AS (VALUES {_NOTICES}),
met AS (SELECT rid, line, label, len(list_intersect(lw, nw)) / len(nw) AS share FROM l, notice WHERE len(list_intersect(lw, nw)) >= ceil({licenses.THRESHOLD} * len(nw) - 1e-9)),
best AS (SELECT rid, list(DISTINCT label) AS own, max(share) AS share FROM (SELECT *, max(share) OVER (PARTITION BY line) AS top FROM met) WHERE share = top GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, len(every) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word, array_to_string(base, ',') AS base_labels,
array_to_string(list_sort(list_distinct(base || coalesce(own, []))), ',') AS labels, greatest(coalesce(share, 0.0), CASE WHEN len(every) > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM e LEFT JOIN best USING (rid)"""

_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DOT = "list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i]))"


def _whole(scale: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v"


ORACLE["op11_exact_top_k"] = f"""WITH e AS (SELECT row_number() OVER () AS rid, vec_id, {_whole(topk.SCALE)} FROM embeddings WHERE {_SOUND}),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(coalesce({_DOT}, 0) AS BIGINT) AS score FROM e a JOIN e b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

ORACLE["op13_hard_negatives"] = f"""WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_whole(negatives.SCALE)}
FROM embeddings WHERE label IS NOT NULL AND {_SOUND}),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(coalesce({_DOT}, 0) AS BIGINT) AS score FROM e a JOIN e b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
p AS (SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS pos FROM s WHERE same QUALIFY pos <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.rid, pos ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.rid = s.rid AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

ORACLE["op12_phrase_collocations"] = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS w FROM p, (VALUES (1), (2), (3)) AS s(k)),
f AS (SELECT lang, k, w, array_to_string(w, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, k, w),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, w, phrase, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.k, c.phrase, c.w, a, cut, unnest([array_to_string(c.w[1:cut], ' ')]) AS h, array_to_string(c.w[cut + 1:c.k], ' ') AS t FROM c, (VALUES (1), (2)) AS s(cut) WHERE cut < c.k),
s AS (SELECT x.lang, x.k, x.phrase, x.w, a, cut, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.h JOIN f r ON r.lang = x.lang AND r.phrase = x.t),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (1), (2)) AS q(i) WHERE k = 3 GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON k = 2 AND o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000"""
