"""Scope: files and rules taken out of a scan on purpose, with who, when and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.functions.paths import slashed
from siftlake.operators.path_index import SCOPE_KINDS, covers_whole, met, scope_index
from siftlake.session import written

REQUIRED = ["reason", "added_by", "added_at"]


def load_scope(global_: DataFrame, repo: DataFrame, server: DataFrame | None = None, once: DataFrame | None = None) -> DataFrame:
    """All entries in order global, repo, server, one-off, tagged with their origin; none are merged.

    Leave `server` out when no central service is configured.
    """
    out = global_.withColumn("origin", F.lit("global")).unionByName(repo.withColumn("origin", F.lit("repo")))
    for part, name in ((server, "server"), (once, "once")):
        if part is not None:
            out = out.unionByName(part.withColumn("origin", F.lit(name)))
    return out


def match_scope(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Add `excluded_by`: the first pattern that covers the path, or null; patterns of every repository come first.

    Paths and patterns meet by the keys of the pattern index, on paths alone; texts are read for the join back.
    """
    out = files.join(covered_by(files, entries), _same_file(files, "_repo", "_path"), "left")
    return out.select(*files.columns, "excluded_by")


def covered_by(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(_repo, _path, excluded_by) of the files that a pattern covers."""
    entries = entries.select("repo_id", "pattern", F.struct(F.col("repo_id").isNotNull().alias("own"), F.monotonically_increasing_id().alias("at")).alias("_order"))
    first = pattern_hits(files, entries).groupBy("repo_id", "path").agg(F.min_by("pattern", "_order").alias("excluded_by"))
    return first.select(F.col("repo_id").alias("_repo"), F.col("path").alias("_path"), "excluded_by")


def pattern_hits(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(repo_id, path, further columns of the entry) for every pattern that covers a path.

    The index is written; its size is then known, and up to the session's limit it is sent to the paths, whose keys stay where they are.
    """
    index = written(scope_index(entries.where(F.coalesce("pattern", F.lit("")) != "")), "scope")
    paths = files.select("repo_id", "path").where(F.col("path").isNotNull())
    path = slashed(F.col("path"))
    return met(paths, index, "repo_id", SCOPE_KINDS, path).where(covers_whole(path)).drop("_key", "_tokens", "_literal")


def _same_file(files: DataFrame, repo: str, path: str) -> Column:
    return files["repo_id"].eqNullSafe(F.col(repo)) & (files["path"] == F.col(path))


def exclude_files(files: DataFrame, entries: DataFrame) -> DataFrame:
    return files.join(covered_by(files, entries), _same_file(files, "_repo", "_path"), "left_anti")


def excluded_counts(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(pattern, files_excluded) by first matching pattern."""
    return (
        match_scope(files.select("repo_id", "path"), entries)
        .where(F.col("excluded_by").isNotNull())
        .groupBy(F.col("excluded_by").alias("pattern"))
        .agg(F.count(F.lit(1)).alias("files_excluded"))
    )


def flag_rule_excludes(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Add boolean `scope_excluded`; entries(rule_id, globs array or null = every file).

    Distinct (rule, path) pairs meet the globs of their rule by the keys of the pattern index; paths of rules without globs
    get no keys. The entries are written; their size is then known, and up to the session's limit they are sent to the findings.
    """
    named = written(entries.where(F.col("rule_id").isNotNull()).select("rule_id", "globs"), "scope-rules")
    listed = F.coalesce(F.size("globs"), F.lit(0)) > 0
    every = named.where(~listed).select("rule_id").distinct().withColumn("_every", F.lit(True))
    index = scope_index(named.where(listed).select("rule_id", F.explode("globs").alias("pattern")).where("pattern <> ''").distinct())
    pairs = findings.select("rule_id", "path").join(index.select("rule_id").distinct(), "rule_id", "left_semi").distinct()
    path = slashed(F.col("path"))
    hit = met(pairs, index, "rule_id", SCOPE_KINDS, path).where(covers_whole(path)).select("rule_id", "path", F.lit(True).alias("_hit")).distinct()
    out = findings.join(every, "rule_id", "left").join(hit, ["rule_id", "path"], "left")
    flag = F.coalesce(F.col("_every"), F.col("_hit"), F.lit(False))
    return out.withColumn("scope_excluded", flag).select(*findings.columns, "scope_excluded")


def exclude_rules(findings: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining findings, counts(rule_id, findings_excluded)); applied after de-duplication."""
    flagged = flag_rule_excludes(findings, entries)
    counts = flagged.where("scope_excluded").groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings_excluded"))
    return flagged.where(~F.col("scope_excluded")).drop("scope_excluded"), counts


def validate_scope(entries: DataFrame, label: str) -> DataFrame:
    """Entries without reason, author or date: (identifier, missing array). `label` is the name column."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    missing = F.array_compact(F.array(*[F.when(blank(c), c) for c in REQUIRED]))
    return entries.select(F.coalesce(label, F.lit("(unknown)")).alias("identifier"), missing.alias("missing")).where(
        F.size("missing") > 0
    )


def exclusion_summary(
    file_entries: DataFrame, file_counts: DataFrame, rule_entries: DataFrame, rule_counts: DataFrame
) -> DataFrame:
    """One row per scope entry with what it removed, for the log and the scan snapshot."""
    files = file_entries.join(file_counts, "pattern", "left").select(
        F.lit("file").alias("kind"), F.col("pattern").alias("target"),
        F.coalesce("files_excluded", F.lit(0)).alias("removed"), "origin", *REQUIRED,
    )
    rules = rule_entries.join(rule_counts, "rule_id", "left").select(
        F.lit("rule").alias("kind"), F.col("rule_id").alias("target"),
        F.coalesce("findings_excluded", F.lit(0)).alias("removed"), "origin", *REQUIRED,
    )
    return files.unionByName(rules)


def publishable(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("origin") != "server")
