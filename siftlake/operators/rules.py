"""Rule packs: loading, validation, applicability and registry.

The rule table is small and bounded by the packs, so it is brought to the driver once and turned into
column expressions; the data it is applied to never leaves the executors.
"""

from __future__ import annotations

import json
import pathlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftlake.functions.regexes import java_pattern

PACK_DIR = pathlib.Path(__file__).resolve().parents[1] / "rulepacks"

# Anti-patterns that several packs share: words of sample and test material; an address that is compared or tested rather
# than used; names reserved for documentation; values taken from the environment.
PRESETS = {
    "DEV_CONTEXT": r"\b(?:demo|dev|development|dummy|example|fake|fixtures?|mock(?:ed|s)?|sandbox|sample|stub|tests?|testing)\b",
    "ADDR_AS_DATA": r"[!=]==?\s*[\"'`]|\b(?:ip_?network|ip_?address|subnet|cidr|inet_aton|loopback|starts_?with)\b",
    "LINK_EXAMPLE": r"\bexample\.(?:com|edu|net|org)\b|\.(?:example|invalid|localhost|test)\b|\b(?:my|your)[-_.]\w+",
    "ENV_VAR_REF": r"\b(?:env|environ|getenv|ENV)\b\s*[.(\[]|\$\{\w+\}|%\w+%",
}
# Allowed values.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "EXPOSURE", "INFO", "LOW"]
CONFIDENCE = ["HIGH", "MEDIUM", "LOW"]

# Which packs serve which extension, in emission order.
PACKS_BY_EXT = {
    **{e: ["js"] for e in ("js", "mjs", "cjs", "jsx")},
    **{e: ["js", "ts"] for e in ("ts", "tsx")},
    "py": ["python"], "php": ["php"], "cs": ["aspnet-cs"],
    **{e: ["aspnet"] for e in ("aspx", "ascx", "master", "config")},
    **{
        e: ["sensitive"]
        for e in (
            "txt", "log", "env", "sql", "yml", "yaml", "json", "xml", "properties", "ini", "cfg", "conf",
            "sh", "bash", "ps1", "bat", "cmd", "csv", "html", "htm",
        )
    },
}
EXPOSURE_EXTS = ["js", "ts", "mjs", "jsx", "tsx", "html", "php", "py"]
EXPOSURE_PACKS = ["js", "python", "php"]
JSON_EXTRA_RULES = ["TS-SUPPRESS-002"]
REGISTRY_LANGUAGES = {
    "js": ["js", "ts", "mjs", "cjs", "jsx", "tsx"], "ts": ["ts", "tsx"], "python": ["py"], "php": ["php"],
    "aspnet": ["aspx", "ascx", "cs"], "aspnet-cs": ["cs"], "infra": ["all"], "secrets": ["all"],
}
EXPOSURE_JS_LANGUAGES = ["js", "ts", "mjs", "cjs", "jsx", "tsx", "html", "php", "py"]
PACK_ORDER = ["js", "ts", "python", "php", "aspnet", "aspnet-cs", "sensitive", "infra", "secrets"]

_CONDITION = T.StructType(
    [
        T.StructField("if_file_context", T.ArrayType(T.StringType())),
        T.StructField("if_path_contains", T.ArrayType(T.StringType())),
        T.StructField("if_line_contains", T.ArrayType(T.StringType())),
        T.StructField("if_value_matches", T.StringType()),
        T.StructField("if_value_not_matches", T.StringType()),
        T.StructField("if_value_shorter_than", T.IntegerType()),
        T.StructField("then", T.StringType()),
        T.StructField("default", T.StringType()),
    ]
)
_S, _AS = T.StringType(), T.ArrayType(T.StringType())
RULE_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("id", _S), ("variant", _S), ("name", _S), ("severity", _S), ("category", _S), ("pattern", _S),
        ("flags", _S), ("antipattern", _S), ("antipatterns", _AS), ("antipattern_preset", _S),
        ("antipattern_flags", _S), ("lookahead", T.IntegerType()), ("lookbehind", T.IntegerType()),
        ("file_types", _AS), ("exclude_file_types", _AS), ("extensions", _AS), ("skip_for_file_types", _AS),
        ("match_mode", _S), ("taint_aware", T.BooleanType()), ("taint_extract", _S),
        ("scan_comments", T.BooleanType()), ("confidence", _S), ("confidence_rules", T.ArrayType(_CONDITION)),
        ("why", _S), ("scenario", _S), ("fix", _S), ("checklist", _AS), ("service", _S),
        ("resolve_hint", _S), ("hit", _S), ("miss", _S),
    ]]
)
PACK_SCHEMA = T.StructType(
    [T.StructField(n, _S) for n in ("pack_id", "pack_name", "pack_version", "author")]
    + [T.StructField("schema_version", T.IntegerType()), T.StructField("rules", T.ArrayType(RULE_SCHEMA))]
)


def with_defaults(rules: DataFrame) -> DataFrame:
    """Apply rule defaults and merge the anti-pattern forms into one pattern."""
    preset = F.create_map(*[x for k, v in PRESETS.items() for x in (F.lit(k), F.lit(v))])
    parts = F.array_compact(
        F.concat(
            F.array("antipattern"), F.coalesce("antipatterns", F.array().cast("array<string>")),
            F.array(F.try_element_at(preset, F.col("antipattern_preset"))),
        )
    )
    return rules.withColumns(
        {
            "name": F.coalesce("name", "id"),
            "severity": F.coalesce("severity", F.lit("HIGH")),
            "category": F.coalesce("category", F.lit("Uncategorised")),
            "flags": F.coalesce("flags", F.lit("gi")),
            "antipattern": F.nullif(F.array_join(parts, "|"), F.lit("")),
            "antipattern_flags": F.coalesce("antipattern_flags", F.lit("i")),
            "lookahead": F.coalesce("lookahead", F.lit(300)),
            "lookbehind": F.coalesce("lookbehind", F.lit(120)),
            "match_mode": F.coalesce("match_mode", F.lit("content")),
            "taint_aware": F.coalesce("taint_aware", F.lit(False)),
            "taint_extract": F.coalesce("taint_extract", F.lit("concat")),
            "scan_comments": F.coalesce("scan_comments", F.lit(False)),
        }
    )


def read_packs(spark: SparkSession, paths=None) -> DataFrame:
    """One row per rule record of the given pack files, defaults applied, with pack and order columns."""
    paths = paths or [str(p) for p in sorted(PACK_DIR.glob("*.json"))]
    packs = spark.read.schema(PACK_SCHEMA).option("multiLine", True).json(paths)
    rules = packs.select(
        F.col("pack_id").alias("source"), F.posexplode("rules").alias("rule_ord", "r")
    ).select("source", "rule_ord", "r.*")
    return with_defaults(rules).drop("antipatterns", "antipattern_preset")


def rule_problems(rules: DataFrame) -> DataFrame:
    """Rows (source, id, problem) of rules a scan must not run."""
    conditions = F.coalesce("confidence_rules", F.array().cast(T.ArrayType(_CONDITION)))
    no_verdict = F.exists(conditions, lambda c: c["then"].isNull() & c["default"].isNull())
    problem = F.array_compact(
        F.array(
            F.when(F.col("id").isNull(), "missing id"),
            F.when(F.col("pattern").isNull(), "missing pattern"),
            F.when(~F.col("severity").isin(SEVERITIES), "unknown severity"),
            F.when(no_verdict, "confidence condition without then/default"),
            F.when(F.rlike(F.lit(""), F.coalesce("pattern", F.lit("x"))), "pattern matches empty text"),
        )
    )
    return rules.select("source", "id", F.explode(problem).alias("problem"))


@dataclass(frozen=True)
class Rule:
    """One rule on the driver, ready to become column expressions."""

    id: str
    source: str
    ord: int
    pattern: str
    name: str = ""
    severity: str = "HIGH"
    category: str = "Uncategorised"
    flags: str = "gi"
    antipattern: str | None = None
    antipattern_flags: str = "i"
    lookahead: int = 300
    lookbehind: int = 120
    file_types: tuple = ()
    exclude_file_types: tuple = ()
    extensions: tuple = ()
    skip_for_file_types: tuple = ()
    match_mode: str = "content"
    taint_aware: bool = False
    taint_extract: str = "concat"
    scan_comments: bool = False
    confidence: str | None = None
    confidence_rules: tuple = ()
    why: str | None = None
    scenario: str | None = None
    fix: str | None = None
    checklist: tuple = ()
    service: str | None = None
    resolve_hint: str | None = None
    meta: dict = field(default_factory=dict, compare=False)

    @property
    def java(self) -> str:
        return java_pattern(self.pattern, self.flags)

    @property
    def java_anti(self) -> str | None:
        return java_pattern(self.antipattern, self.antipattern_flags) if self.antipattern else None


def _as_tuple(v):
    return tuple(v) if isinstance(v, (list, tuple)) else (() if v is None else (v,))


def to_rule(raw: dict, source: str, ord_: int) -> Rule:
    """Build a Rule from a raw pack record (dict), with the same defaults as `with_defaults`."""
    if not raw.get("id"):
        raise ValueError(f"rule {ord_} of pack {source} has no id")
    if not raw.get("pattern"):
        raise ValueError(f"rule {raw['id']} has no pattern")
    if raw.get("severity", "HIGH") not in SEVERITIES:
        raise ValueError(f"rule {raw['id']}: unknown severity {raw['severity']}")
    conditions = raw.get("confidence_rules") or []
    for c in conditions:
        if c.get("then", c.get("default")) not in CONFIDENCE:
            raise ValueError(f"rule {raw['id']}: confidence condition needs then/default in {CONFIDENCE}")
    anti = [raw["antipattern"]] if raw.get("antipattern") else []
    anti += list(raw.get("antipatterns") or [])
    if raw.get("antipattern_preset"):
        anti.append(PRESETS[raw["antipattern_preset"]])
    known = set(Rule.__dataclass_fields__) - {"source", "ord", "antipattern", "meta"}
    kept = {k: v for k, v in raw.items() if k in known and v is not None}
    for k in ("file_types", "exclude_file_types", "extensions", "skip_for_file_types", "checklist"):
        if k in kept:
            kept[k] = _as_tuple(kept[k])
    if conditions:
        kept["confidence_rules"] = tuple(dict(c) for c in conditions)
        kept.pop("confidence", None)
    kept.setdefault("name", raw["id"])
    rule = Rule(source=source, ord=ord_, antipattern="|".join(anti) or None, **kept)
    if re.match(rule.pattern, "", re.I):
        raise ValueError(f"rule {rule.id}: the pattern matches empty text")
    return rule


def load_packs(paths=None) -> list[Rule]:
    """Rules of the given pack files (default: the built-in packs), in pack order."""
    packs = [json.loads(pathlib.Path(p).read_text()) for p in paths or sorted(PACK_DIR.glob("*.json"))]
    order = {p: i for i, p in enumerate(PACK_ORDER)}
    packs.sort(key=lambda p: order.get(p["pack_id"], len(order)))
    return [to_rule(raw, p["pack_id"], i) for p in packs for i, raw in enumerate(p["rules"])]


def passes(rules: list[Rule]) -> list[tuple[int, Rule, list[str] | None]]:
    """(emission rank, rule, extensions or None for any) in the order in which findings are emitted.

    Passes: secrets, file names, the extension's rule set, exposure rules, infrastructure rules,
    then rules of any further pack on their own `file_types`.
    """
    out: list[tuple[Rule, list[str] | None, str]] = []
    secrets = [r for r in rules if r.source == "secrets"]
    names = [r for r in rules if r.match_mode == "filename"]
    content = [r for r in rules if r.match_mode != "filename"]
    out += [(r, None, "secrets") for r in secrets if r.match_mode != "filename"]
    out += [(r, None, "filename") for r in names]
    for r in content:
        exts = [e for e, packs in PACKS_BY_EXT.items() if r.source in packs]
        if r.source == "sensitive":
            exts = [e for e in exts if e in r.file_types]
        elif r.source == "js" and r.severity == "EXPOSURE":
            exts = []
        elif r.file_types and exts:
            exts = [e for e in exts if e in r.file_types]
        if r.id in JSON_EXTRA_RULES:
            exts = exts + ["json"]
        exts = [e for e in exts if e not in r.exclude_file_types]
        if exts:
            out.append((r, exts, "set"))
    exposure = [r for r in content if r.severity == "EXPOSURE" and r.source in EXPOSURE_PACKS]
    for r in exposure:
        out.append((r, [e for e in EXPOSURE_EXTS if e not in r.exclude_file_types], "exposure"))
    out += [(r, list(r.extensions) or None, "infra") for r in content if r.source == "infra"]
    for r in content:
        if r.source not in PACK_ORDER:
            out.append((r, list(r.file_types) or None, "extra"))
    return [(i, r, e, kind) for i, (r, e, kind) in enumerate(out)]


def rules_by_ext(spark: SparkSession, rules: list[Rule], exts: list[str]) -> DataFrame:
    """(ext, rule_id, source, rule_pass, rule_rank) matrix for the given extensions."""
    rows = []
    for rank, r, on, kind in passes(rules):
        for ext in exts if on is None else [e for e in on if e in exts]:
            if ext not in r.exclude_file_types:
                rows.append((ext, r.id, r.source, kind, rank))
    return spark.createDataFrame(
        rows, "ext string, rule_id string, source string, rule_pass string, rule_rank int"
    )


def registry(rules: DataFrame, languages: DataFrame) -> DataFrame:
    """One row per rule id out of rules(rule_id, source, source_ord, rule_ord, name, severity, category,
    file_types, match_mode, ...) with its languages; the first record of an id wins.

    languages(source, exposure, languages): the language list of a source, or null for the rule's own
    file types.
    """
    first = F.struct("source_ord", "rule_ord")
    cols = ["source", "name", "severity", "category", "file_types", "match_mode", "why", "fix"]
    one = rules.groupBy("rule_id").agg(F.min_by(F.struct(*cols), first).alias("r")).select("rule_id", "r.*")
    exposure = F.coalesce(F.col("severity") == "EXPOSURE", F.lit(False))
    j = one.withColumn("exposure", exposure).join(languages, ["source", "exposure"], "left")
    own = F.when(F.size("file_types") > 0, F.col("file_types"))
    return j.withColumn("languages", F.coalesce("languages", own, F.array(F.lit("all")))).drop("exposure", "file_types")


def natural_order(rule_id) -> list:
    """Sort keys: severity (LOW 4, unknown last), id without its number, number."""
    rank = F.coalesce(
        F.try_element_at(
            F.create_map(*[x for k, v in {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "EXPOSURE": 3, "LOW": 4}.items() for x in (F.lit(k), F.lit(v))]),
            F.col("severity"),
        ),
        F.lit(9),
    )
    c = F.col(rule_id)
    return [rank, F.regexp_replace(c, r"[0-9]+\z", ""), F.regexp_extract(c, r"([0-9]+)\z", 1).try_cast("int"), c]


def query_registry(reg: DataFrame, *, rule_id=None, lang=None, severity=None, search=None) -> DataFrame:
    if rule_id:
        return reg.where(F.lower("rule_id") == rule_id.lower())
    out = reg
    if lang:
        wanted = [x.strip().lower() for x in lang.split(",")]
        out = out.where(F.exists("languages", lambda l: F.lower(l).isin(wanted + ["all"])))
    if severity:
        out = out.where(F.col("severity") == severity.upper())
    if search:
        text = F.lower(F.concat_ws("\u0001", "rule_id", "name", "category", "why", "fix"))
        out = out.where(text.contains(search.lower()))
    return out


def registry_stats(reg: DataFrame) -> DataFrame:
    """(kind, value, count) by severity, language and category."""
    flat = reg.select(F.col("severity"), F.col("category"))
    sc = flat.groupingSets([["severity"], ["category"]], "severity", "category").agg(
        F.count(F.lit(1)).alias("count"), F.grouping("severity").alias("_g")
    ).select(
        F.when(F.col("_g") == 1, "category").otherwise("severity").alias("kind"),
        F.coalesce(F.when(F.col("_g") == 1, F.col("category")), F.col("severity")).alias("value"), "count",
    )
    lang = reg.select(F.explode("languages").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return sc.unionByName(lang.select(F.lit("language").alias("kind"), "value", "count"))
