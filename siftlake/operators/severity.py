"""Context severity, routing, de-duplication and policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftlake.functions import severity as sev
from siftlake.functions.exprs import map_literal

# --- Fixed values: additive modifiers. ---
TYPE_MODIFIERS = {"fixture": -2, "vendor": -3, "generated": -2, "test": -1, "docs": -1, "config": 0, "source": 0}
SEGMENT_MODIFIERS = {
    "/test/": -1, "/tests/": -1, "/spec/": -1, "/specs/": -1, "/__tests__/": -1, "/fixtures/": -1,
    "/fixture/": -1, "/__fixtures__/": -1, "/mocks/": -1, "/__mocks__/": -1, "/vendor/": -2,
    "/node_modules/": -2,
}
FRAMEWORK_MODIFIERS = {"jest": -1, "vitest": -1, "mocha": -1, "pytest": -1, "phpunit": -1, "rspec": -1}
LOCKED_RULES = ["SECRET-001", "SECRET-002", "SECRET-003", "SECRET-006", "SECRET-007", "JWT-001"]
POLICY_DEFAULTS = {
    "trust_level": "balanced", "block_on_critical": "true", "block_on_high": "true", "scan_mode": "full",
    "deep_delay_ms": "0",
}
SUPPRESS_REASON = "Effective score below threshold after context modifiers"
# --- end of fixed values ---


MODIFIERS = "array<struct<signal:string,modifier:int>>"


def _folders(path: Column) -> Column:
    """The folder names of a path, in lower case."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def context_modifiers(path: Column, file_type: Column, framework: Column) -> Column:
    """array<struct<signal, modifier>> of everything that applies to a file.

    Every segment is one whole folder name, so the path is cut once; lambdas see only the few names that are met, because
    what a lambda reads is not compiled.
    """

    def entry(signal: Column, amount: Column) -> Column:
        return F.struct(signal.alias("signal"), amount.cast("int").alias("modifier"))

    none = F.array().cast(MODIFIERS)
    one = lambda prefix, value, amount: F.when(amount != 0, F.array(entry(F.concat(F.lit(prefix), value), amount))).otherwise(none)
    amounts = {seg.strip("/"): amount for seg, amount in SEGMENT_MODIFIERS.items()}
    met = F.array_intersect(F.lit(list(amounts)), _folders(path))
    segments = F.transform(met, lambda n: entry(F.concat(F.lit("path: /"), n, F.lit("/")), map_literal(amounts, n)))
    return F.concat(
        one("fileType: ", file_type, map_literal(TYPE_MODIFIERS, file_type, 0)), F.coalesce(segments, none),
        one("framework: ", framework, map_literal(FRAMEWORK_MODIFIERS, framework, 0)),
    )


def modifier_total(path: Column, file_type: Column, framework: Column) -> Column:
    """Sum of all modifiers as plain arithmetic: no arrays and no lambdas, so it stays in generated code
    even when a filter on it is pushed down to the scan."""
    def by_value(col: Column, table: dict) -> Column:
        groups: dict[int, list[str]] = {}
        for name, amount in table.items():
            groups.setdefault(amount, []).append(name)
        chain = F.when(F.lit(False), 0)
        for amount, names in groups.items():
            chain = chain.when(col.isin(names), amount)
        return chain.otherwise(0)

    # Every segment is one whole folder name, so folders are intersected with the names once per
    # distinct amount instead of searching the path for each segment.
    folders = _folders(path)
    total = by_value(file_type, TYPE_MODIFIERS) + by_value(framework, FRAMEWORK_MODIFIERS)
    for step in sorted(set(SEGMENT_MODIFIERS.values()), reverse=True):
        names = [seg.strip("/") for seg, amount in SEGMENT_MODIFIERS.items() if amount == step]
        total = total + F.size(F.array_intersect(folders, F.lit(names))) * step
    return total


def modifier_sum(modifiers: Column) -> Column:
    return F.aggregate(modifiers, F.lit(0), lambda acc, m: acc + m["modifier"])


def apply_context(findings: DataFrame, low_score: int = 0, trace: bool = False) -> DataFrame:
    """Add context_modifiers, severity (effective), suppressed, suppress_reason; optionally trace."""
    out = findings.withColumn(
        "context_modifiers", context_modifiers(F.col("path"), F.col("file_type"), F.col("framework"))
    )
    base = F.when(F.col("base_severity") == "LOW", F.lit(low_score)).otherwise(
        sev.score(F.col("base_severity"))
    )
    total = modifier_total(F.col("path"), F.col("file_type"), F.col("framework"))
    out = out.withColumn("score", base + total)
    out = out.withColumns(
        {
            "severity": sev.from_score(F.col("score")),
            "suppressed": F.col("score") <= 0,
            "suppress_reason": F.when(F.col("score") <= 0, SUPPRESS_REASON),
        }
    )
    if trace:
        out = out.withColumn("trace", context_trace())
    return out


def context_trace() -> Column:
    """Explain struct of one routed finding."""
    mods = F.col("context_modifiers")
    return F.struct(
        F.col("scan_context").alias("manifest_context"), F.col("file_type"),
        F.col("framework").alias("test_framework"), F.col("line_type").alias("comment_line_type"),
        F.col("base_severity"), (F.col("score") - modifier_sum(mods)).alias("base_score"),
        mods.alias("modifiers"), modifier_sum(mods).alias("total_modifier"),
        F.col("score").alias("effective_score"), F.col("severity").alias("final_severity"),
        F.col("suppressed"),
    )


def route(routed: DataFrame) -> DataFrame:
    """Add `route`, active or suppressed, in one pass."""
    return routed.withColumn("route", F.when(F.col("suppressed"), "suppressed").otherwise("active"))


def split_routes(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, suppressed); nothing is lost."""
    return routed.where(~F.col("suppressed")), routed.where(F.col("suppressed"))


EMISSION = ["rule_rank", "off"]


def _first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark keeps one row of a key in each task before the exchange, so a key of any size is no burden."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def dedup_active(active: DataFrame, emission=EMISSION) -> DataFrame:
    """One finding per (rule, line), then only the severest of a line (equal ranks all stay).

    Order: tainted first, then severity, then emission. A row of a lower rank is dropped when a more
    severe one was already kept on its line; since the order inside taint groups is by rank, comparing
    with the least rank of all earlier rows is exact (dropped rows never lower that minimum). Rows are
    exchanged once, by line, for both steps; what a line of a file has of one rule is bounded by that line.
    """
    keyed = active.withColumns(
        {
            "_t": F.when(F.col("taint_source").isNotNull(), 0).otherwise(1),
            "_r": sev.rank(F.col("severity")),
        }
    )
    order = [F.col("_t"), F.col("_r"), *[F.col(c) for c in emission]]
    per_line = ["repo_id", "path", "line"]
    unique = _first_of(keyed.repartition(*per_line), [*per_line, "rule_id"], order)
    earlier = W.partitionBy(*per_line).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    kept = unique.withColumn("_best", F.coalesce(F.min("_r").over(earlier), F.lit(99))).where("_r <= _best")
    return kept.drop("_t", "_r", "_best")


def dedup_suppressed(suppressed: DataFrame, emission=EMISSION) -> DataFrame:
    """First emitted finding per (rule, path, line)."""
    return _first_of(suppressed, ["repo_id", "path", "line", "rule_id"], [F.col(c) for c in emission])


def rule_action(
    findings: DataFrame, policy: DataFrame | None = None, overrides: DataFrame | None = None,
    locked=LOCKED_RULES,
) -> DataFrame:
    """Add `action` from the base severity.

    policy(repo_id, block_on_critical, block_on_high, locked_rules array) and overrides(repo_id,
    rule_id, action) are small per-repository tables and joined without a hint, left to AQE.
    """
    base, extra = F.col("base_severity"), F.array().cast("array<string>")
    on_crit, on_high = F.lit(True), F.lit(True)
    out = findings
    if policy is not None:
        out = out.join(
            policy.select("repo_id", "block_on_critical", "block_on_high", F.col("locked_rules").alias("_locked")),
            "repo_id", "left",
        )
        on_crit, on_high = F.coalesce("block_on_critical", on_crit), F.coalesce("block_on_high", on_high)
        extra = F.coalesce("_locked", extra)
    override = F.lit(None).cast("string")
    if overrides is not None:
        out = out.join(
            overrides.select("repo_id", "rule_id", F.col("action").alias("_override")),
            ["repo_id", "rule_id"], "left",
        )
        override = F.col("_override")
    action = (
        F.when(F.col("rule_id").isin(list(locked)) | F.array_contains(extra, F.col("rule_id")), "block")
        .when(override.isNotNull(), override)
        .when((base == "CRITICAL") & on_crit, "block")
        .when((base == "HIGH") & on_high, "block")
        .otherwise("warn")
    )
    return out.withColumn("action", action).drop("block_on_critical", "block_on_high", "_locked", "_override")


def rule_action_noconfig(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", "block").when(severity == "EXPOSURE", "educate").otherwise("warn")


def effective_policy(repos: DataFrame, global_conf: DataFrame, repo_conf: DataFrame) -> DataFrame:
    """policy(repo_id, key, value, origin): code defaults < global < repository.

    global_conf(key, value); repo_conf(repo_id, key, value). One row per repository and key.
    """
    spark = repos.sparkSession
    defaults = spark.createDataFrame(list(POLICY_DEFAULTS.items()), "key string, default_value string")
    glob = global_conf.select("key", F.col("value").alias("global_value"))
    base = F.broadcast(defaults.join(glob, "key", "left"))  # one row per known key
    own = repo_conf.select("repo_id", "key", F.col("value").alias("repo_value"))
    keys = F.explode(F.lit(list(POLICY_DEFAULTS))).alias("key")
    grid = repos.select("repo_id").distinct().select("repo_id", keys).join(base, "key").join(own, ["repo_id", "key"], "left")
    return grid.select(
        "repo_id", "key",
        F.coalesce("repo_value", "global_value", "default_value").alias("value"),
        F.when(F.col("repo_value").isNotNull(), "repo")
        .when(F.col("global_value").isNotNull(), "global")
        .otherwise("default").alias("origin"),
    )


def locked_rules(repos: DataFrame, repo_locked: DataFrame) -> DataFrame:
    """locked(repo_id, locked_rules): built-in list united with the repository's own."""
    own = repo_locked.groupBy("repo_id").agg(F.collect_set("rule_id").alias("_own"))
    builtin = F.array(*[F.lit(r) for r in LOCKED_RULES])
    return repos.select("repo_id").distinct().join(own, "repo_id", "left").select(
        "repo_id",
        F.array_sort(F.array_union(builtin, F.coalesce("_own", F.array().cast("array<string>")))).alias(
            "locked_rules"
        ),
    )


def scan_blocked(findings: DataFrame) -> DataFrame:
    """blocked per repository: any blocking finding that is not excepted."""
    return findings.groupBy("repo_id").agg(
        F.max((F.col("action") == "block") & ~F.col("excepted")).alias("blocked")
    )


def filter_findings(findings: DataFrame, severity: str | None = None, rule: str | None = None) -> DataFrame:
    out = findings
    if severity:
        out = out.where(F.col("severity") == severity.upper())
    if rule:
        out = out.where(F.upper("rule_id") == rule.upper())
    return out


def top_k(findings: DataFrame, n: int) -> DataFrame:
    """The n most severe findings; LOW ranks with INFO (4)."""
    order = F.when(F.col("severity") == "LOW", 4).otherwise(sev.rank(F.col("severity")))
    return (
        findings.withColumn("_r", order)
        .orderBy("_r", "repo_id", "path", "line", "rule_id", "finding_id")
        .limit(n)
        .drop("_r")
    )
