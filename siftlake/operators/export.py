"""Verdicts of a deeper review: joining them to findings, precision statistics, self-contained export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.functions.exprs import map_literal
from siftlake.functions.paths import extension
from siftlake.operators.classify import LANGUAGE_BY_EXT
from siftlake.operators.reports import with_context

HIGH_FP_RATE, HIGH_FP_SAMPLE = 0.5, 3


def join_verdicts(findings: DataFrame, verdicts: DataFrame, key=("repo_id", "path", "line", "rule_id")) -> DataFrame:
    """Left join of the first usable verdict of the same repository, rule and line.

    Paths fit when equal or when one is a tail of the other at a directory boundary. verdicts(repo_id,
    path, rule_id, line, ord, confirmed, confidence, error). The equi-key holds the base name as well, so
    a rule that fires on the same line number of very many files does not pair those files up.
    """
    key = list(key)
    name = lambda c: F.substring_index(c, "/", -1)
    v = verdicts.where(F.col("error").isNull()).select(
        "repo_id", "rule_id", "line", F.col("path").alias("_vpath"), name("path").alias("_name"),
        F.struct("confirmed", "confidence").alias("verdict"), F.col("ord").alias("_ord"),
    )
    f = findings.select(*key, name("path").alias("_name")).distinct()
    tail_of = lambda a, b: F.endswith(a, F.concat(F.lit("/"), b))
    a, b = F.col("path"), F.col("_vpath")
    fits = (a == b) | tail_of(a, b) | tail_of(b, a)
    hits = f.join(v, ["repo_id", "rule_id", "line", "_name"]).where(fits)
    first = hits.groupBy(*key).agg(F.min_by("verdict", "_ord").alias("verdict"))
    return findings.join(first, key, "left")


def confidence_label(number: Column) -> Column:
    return F.when(number >= 0.8, "HIGH").when(number >= 0.5, "MEDIUM").otherwise("LOW")


def merge_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with `confirmed` and a textual `review_confidence` of their verdict."""
    j = join_verdicts(findings, verdicts)
    c = F.col("verdict.confidence")
    number = c.try_cast("double")
    label = F.when(number.isNotNull(), confidence_label(number)).otherwise(F.coalesce(c, F.lit("LOW")))
    return j.withColumns(
        {
            "confirmed": F.col("verdict.confirmed"),
            "review_confidence": F.when(F.col("verdict").isNotNull(), label),
        }
    )


def rule_stats(paired: DataFrame) -> DataFrame:
    """Per rule: triggered, confirmed, false_positives, no_verdict, sample, fp_rate (two decimals)."""
    v, ok = F.col("verdict").isNotNull(), F.coalesce(F.col("verdict.confirmed"), F.lit(False))
    g = paired.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("triggered"), F.count_if(v & ok).alias("confirmed"),
        F.count_if(v & ~ok).alias("false_positives"), F.count_if(~v).alias("no_verdict"),
    )
    sample = F.col("confirmed") + F.col("false_positives")
    rate = F.when(sample > 0, F.col("false_positives") / sample).otherwise(F.lit(0.0))
    return g.withColumns({"sample": sample, "rate": rate, "fp_rate": F.floor(rate * 100 + 0.5) / 100})


def high_fp(stats: DataFrame) -> DataFrame:
    return stats.where((F.col("rate") >= HIGH_FP_RATE) & (F.col("sample") >= HIGH_FP_SAMPLE)).orderBy(
        F.desc("rate"), "rule_id"
    )


def languages(findings: DataFrame) -> DataFrame:
    """(repo_id, languages array): distinct languages of all findings, sorted."""
    lang = map_literal(LANGUAGE_BY_EXT, extension(F.col("path")))
    return findings.groupBy("repo_id").agg(F.array_sort(F.collect_set(lang)).alias("languages"))


def export_findings(
    findings: DataFrame, verdicts: DataFrame, files: DataFrame, *, severity: str | None = None,
    rule: str | None = None, deep_only: bool = False,
) -> DataFrame:
    """Self-contained finding records: rule, place, source context and verdict."""
    f = findings
    if severity:
        f = f.where(F.col("severity") == severity.upper())
    if rule:
        f = f.where(F.col("rule_id") == rule)
    paired = join_verdicts(f, verdicts)
    if deep_only:
        paired = paired.where(F.col("verdict").isNotNull())
    ctx = with_context(paired, files)
    kind = F.when(
        F.col("verdict").isNotNull(),
        F.when(F.coalesce(F.col("verdict.confirmed"), F.lit(False)), "confirmed").otherwise("false_positive"),
    )
    out = paired.join(ctx, ["repo_id", "path", "line"], "left")
    return out.withColumns(
        {"verdict_kind": kind, "context": F.coalesce("context", F.array("snippet"))}
    )
