"""The scan core: rules x file text -> raw findings, in one narrow stage.

Shape of the plan, per file row and without any shuffle:

1. candidates: literals that a match cannot do without are taken from each rule's syntax tree; one automaton over the text
   tells which of them stand in it, so which rules can hit at all.
2. gate: of those that the file's extension and kind admit, one `rlike` each. Only the numbers of the rules that
   hit survive (one int array per file).
3. matches: one `regexp_replace` with the rule's own constant pattern puts marks around all matches; the text between the
   marks gives offsets and line numbers. Rules are taken one after another, so one marked copy exists at a time.
4. anti-pattern windows, comment lines and taint are looked up in arrays of the same row.

Only the resulting findings (short rows) leave the row and are later shuffled for de-duplication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlake.functions import identity
from siftlake.functions.exprs import any_contains, constant, count_newlines, let, running_before, sql_text
from siftlake.functions.literals import admitted, has_group, required
from siftlake.functions.paths import basename, extension
from siftlake.functions.regexes import java_pattern
from siftlake.operators.classify import infra_eligible, rule_context
from siftlake.operators.comments import kind_name, line_kinds
from siftlake.operators.rules import Rule, passes
from siftlake.operators.taint import ENTRY, resolve_source, sink_variable, tainted_vars

BLOCK = 4096


def split_regex(pattern: Column | str) -> Column:
    """Regex whose matches are `prefix + match`, the prefix in group 1, the rule's own group 1 in group 2."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.concat(F.lit(r"\G(?s:(.*?))(?:"), p, F.lit(")"))


def matches_of(content: Column, pattern: Column, wants_value: Column | bool = True) -> Column:
    """array<struct<off, line, text, value>> of all matches of a pattern that differs from row to row.

    off is 0-based, line 1-based, value is the rule's group 1 (the whole match when it has none). The
    dead alternative `(?!)()` gives group 2 a place in patterns without a group.
    """
    rx = split_regex(pattern)
    grouped = split_regex(F.concat(F.lit("(?:"), pattern, F.lit(")|(?!)()")))

    def body(pieces: Column) -> Column:
        def describe(z: Column) -> Column:
            text = F.substr(z["piece"], F.length(z["prefix"]) + 1)
            grp = z["grp"]
            return F.struct(
                (z["start"] + F.length(z["prefix"])).alias("off"),
                (z["start_line"] + count_newlines(z["prefix"]) + 1).alias("line"),
                text.alias("text"),
                F.when(grp != "", grp).otherwise(text).alias("value"),
            )

        groups = F.when(F.lit(wants_value) if isinstance(wants_value, bool) else wants_value,
                        F.regexp_extract_all(content, grouped, F.lit(2)))
        return F.transform(
            F.arrays_zip(
                pieces.alias("piece"),
                F.regexp_extract_all(content, rx, F.lit(1)).alias("prefix"),
                running_before(F.transform(pieces, lambda s: F.length(s).cast("bigint"))).alias("start"),
                running_before(F.transform(pieces, count_newlines)).alias("start_line"),
                F.coalesce(groups, F.array().cast("array<string>")).alias("grp"),
            ),
            describe,
        )

    return let(F.regexp_extract_all(content, rx, F.lit(0)), body)


#: Marks before a match, between match and value, after the value: code points that stand for no character.
MARKS = ("\ufdd0", "\ufdd1", "\ufdd2")


def _with_marks(r: Rule, wants_value: bool) -> Column:
    """The column `content` with marks around each match of one rule, the rule's group 1 repeated behind it."""
    before, between, after = MARKS
    if not wants_value:
        pattern, put = r.java, f"{before}$0{between}{after}"
    else:
        pattern = r.java if has_group(r.pattern) else f"(?:{r.java})|(?!)()"
        put = f"{before}$0{between}$1{after}"
    return F.expr(f"regexp_replace(content, {sql_text(pattern)}, {sql_text(put)})")


def _marked_matches(marked: Column) -> Column:
    """array<struct<off, line, text, value>> of a text with marks."""
    before, between, after = MARKS

    def body(parts: Column) -> Column:
        head = F.element_at(parts, 1)

        def piece(p: Column) -> Column:
            text, rest = F.substring_index(p, between, 1), F.substring_index(p, after, -1)
            value = F.substring_index(F.substring_index(p, after, 1), between, -1)
            return F.struct(
                text.alias("text"), F.when(value != "", value).otherwise(text).alias("value"),
                (F.length(text) + F.length(rest)).cast("bigint").alias("n"), (count_newlines(text) + count_newlines(rest)).alias("lines"),
            )

        def placed(pieces: Column) -> Column:
            zipped = F.arrays_zip(
                pieces.alias("p"), running_before(F.transform(pieces, lambda p: p["n"])).alias("start"),
                running_before(F.transform(pieces, lambda p: p["lines"])).alias("start_line"),
            )
            return F.transform(zipped, lambda z: F.struct(
                (z["start"] + F.length(head)).alias("off"), (z["start_line"] + count_newlines(head) + 1).alias("line"),
                z["p"]["text"].alias("text"), z["p"]["value"].alias("value"),
            ))

        return let(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), placed)

    return let(F.split(marked, before, -1), body)


def _all_matches(content: Column, rank: Column, rule: Column, numbered: list[tuple[int, Rule]], wants_value=lambda r: True) -> Column:
    """Matches of the rule of a rank; each rule has its own constant expression, of which one is evaluated."""
    marked = F.when(F.lit(False), content)
    for k, r in numbered:
        marked = marked.when(rank == k, _with_marks(r, wants_value(r)))
    odd = any_contains(content, MARKS)  # a text that holds the marks themselves
    return F.when(odd, matches_of(content, rule["pattern"])).otherwise(_marked_matches(marked))


def _candidates(numbered: list[tuple[int, Rule]]) -> Column:
    """array<int> of the ranks of content rules whose literals stand in the text."""
    return admitted(F.lower("content"), {k: required(r.pattern) for k, r in numbered if r.match_mode != "filename"})


def _hit_test(rank: int, r: Rule) -> str:
    """SQL text: whether a content rule hits the text, its literals first."""
    test = f"rlike(content, {sql_text(r.java)})"
    return f"array_contains(_candidates, {rank}) AND {test}" if required(r.pattern) else test


def _ranks_of(tests: list[tuple[int, str]]) -> Column:
    """array<int> of the ranks whose test holds. One SQL text: rules are many, and columns slow to put together."""
    if not tests:
        return F.array().cast("array<int>")
    return F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {test} THEN {rank} END" for rank, test in tests) + "))")


def _one_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(sql_text(v) for v in values)})" if values else "false"


def _blocks(content: Column) -> Column:
    """The text cut into fixed blocks, so that a window never rescans the text from its beginning."""
    return F.regexp_extract_all(content, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def _window(blocks: Column, off: Column, behind: Column, ahead: Column) -> Column:
    """Characters [off - behind, off + ahead) out of the blocks."""
    first = F.floor(F.greatest(off - behind, F.lit(0)) / BLOCK).cast("int")
    last = F.floor((off + ahead) / BLOCK).cast("int")
    text = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    start = F.greatest(off - behind, F.lit(0)) - first.cast("bigint") * BLOCK
    return F.substr(text, (start + 1).cast("int"), (off + ahead - F.greatest(off - behind, F.lit(0))).cast("int"))


def _gate(rules: list[Rule], mode: str, taint_max_kb: int | None) -> Column:
    """array<int> of the emission ranks of rules that hit this file at least once."""
    tests = []
    for rank, r, exts, kind in passes(rules):
        if r.taint_aware and mode == "fast":
            continue
        cond = [] if exts is None else [_one_of("ext", exts)]
        if r.exclude_file_types:
            cond.append(f"NOT ({_one_of('ext', r.exclude_file_types)})")
        if kind == "infra":
            cond.append("_infra")
            if r.skip_for_file_types:
                cond.append(f"NOT ({_one_of('file_type', r.skip_for_file_types)})")
        if kind != "secrets":
            cond.append("scan_context = 'source'")
        if r.taint_aware and taint_max_kb:
            cond.append(f"floor(length(content) / 1024 + 0.5) <= {int(taint_max_kb)}")
        cond.append(f"rlike(base_raw, {sql_text(r.java)})" if r.match_mode == "filename" else _hit_test(rank, r))
        tests.append((rank, " AND ".join(cond)))
    return _ranks_of(tests)


def is_large(length: Column) -> Column:
    return F.floor(length / 1024 + 0.5) > 512


RULE_TABLE = (
    "array<struct<rule_id:string,name:string,base_severity:string,category:string,source:string,pattern:string,antipattern:string,lookahead:int,lookbehind:int,"
    "by_name:boolean,taint_aware:boolean,taint_extract:string,scan_comments:boolean>>"
)


def _rule_of(rank: Column, rules: list[Rule]) -> Column:
    """The figures of a rule by its rank, out of one constant array."""
    rows = [
        dict(
            rule_id=r.id, name=r.name, base_severity=r.severity, category=r.category, source=r.source, pattern=r.java, antipattern=r.java_anti, lookahead=r.lookahead,
            lookbehind=r.lookbehind, by_name=r.match_mode == "filename", taint_aware=r.taint_aware, taint_extract=r.taint_extract, scan_comments=r.scan_comments,
        )
        for _, r, _, _ in passes(rules)
    ]
    return F.element_at(constant(rows, RULE_TABLE), rank + 1)


def rule_texts(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Explanatory text per rule id (first record wins), joined to findings only where it is shown."""
    rows = {}
    for _, r, _, _ in passes(rules):
        rows.setdefault(
            r.id, (r.id, r.why, r.scenario, r.fix, r.service, r.resolve_hint, list(r.checklist))
        )
    return spark.createDataFrame(
        list(rows.values()),
        "rule_id string, why string, scenario string, fix string, service string, resolve_hint string,"
        " checklist array<string>",
    )


def confidence_of(conditions, ctx: Column, raw: Column, path: Column, value: Column) -> Column:
    """One rule's ordered conditions as a `when` chain; several tests in one condition are alternatives."""
    low_line, low_path = F.lower(F.coalesce(raw, F.lit(""))), F.lower(path)
    chain = F.when(F.lit(False), F.lit("HIGH"))
    for c in conditions:
        if c.get("default") is not None:
            return chain.otherwise(c["default"])
        wanted = c.get("if_file_context") or []
        cond = ctx.isin([wanted] if isinstance(wanted, str) else list(wanted)) if wanted else F.lit(False)
        cond = cond | any_contains(low_path, [t.lower() for t in c.get("if_path_contains") or []])
        cond = cond | any_contains(low_line, [t.lower() for t in c.get("if_line_contains") or []])
        if c.get("if_value_matches"):
            cond = cond | value.rlike(java_pattern(c["if_value_matches"]))
        if c.get("if_value_not_matches"):
            cond = cond | ~value.rlike(java_pattern(c["if_value_not_matches"]))
        if c.get("if_value_shorter_than") is not None:
            cond = cond | (F.length(value) < c["if_value_shorter_than"])
        chain = chain.when(cond, c["then"])
    return chain.otherwise("HIGH")


def confidence_column(rules: list[Rule]) -> Column:
    """Confidence of a finding row: static, or the first matching condition of its rule, else HIGH."""
    ctx = rule_context(F.col("path"))
    chain = F.when(F.lit(False), F.lit("HIGH"))
    for rank, r, _, _ in passes(rules):
        if r.confidence_rules:
            val = confidence_of(r.confidence_rules, ctx, F.col("raw"), F.col("path"), F.col("value"))
        elif r.confidence and r.confidence != "HIGH":
            val = F.lit(r.confidence)
        else:
            continue
        chain = chain.when(F.col("rule_rank") == rank, val)
    return chain.otherwise("HIGH")


def _found(rules: list[Rule]) -> Column:
    """Surviving matches of a file: array<struct<rule_rank, off, line, raw, value, kind, taint>>."""
    content = F.col("content")
    numbered = [(rank, r) for rank, r, _, _ in passes(rules)]
    anti_ranks = [rank for rank, r in numbered if r.java_anti and r.match_mode != "filename"]
    taint_type = "struct<variable:string,line:bigint,source:string>"

    def of_text(rank: Column, rule: Column, lines: Column, kinds: Column, blocks: Column) -> Column:
        def describe(m: Column) -> Column:
            at = (m["line"] - 1).cast("int")
            raw = F.coalesce(F.get(lines, at), F.lit(""))
            taint = F.when(rule["taint_aware"], let(sink_variable(raw, rule["taint_extract"]), lambda v: resolve_source(F.col("_taint"), v)))
            return F.struct(
                rank.alias("rule_rank"), m["off"].alias("off"), m["line"].alias("line"), raw.alias("raw"), m["value"].alias("value"),
                F.coalesce(F.get(kinds, at), F.lit(".")).alias("kind"), taint.alias("taint"),
            )

        def clean(m: Column) -> Column:
            window = _window(blocks, m["off"], rule["lookbehind"], rule["lookahead"])
            return rule["antipattern"].isNull() | ~F.rlike(window, rule["antipattern"])

        def keep(f: Column) -> Column:
            code = (f["kind"] != "c") | rule["scan_comments"]
            return code & (~rule["taint_aware"] | f["taint"].isNotNull())

        matches = _all_matches(content, rank, rule, [(k, r) for k, r in numbered if r.match_mode != "filename"], lambda r: bool(r.confidence_rules))
        return F.filter(F.transform(F.filter(matches, clean), describe), keep)

    def of_name(rank: Column) -> Column:
        return F.array(F.struct(
            rank.alias("rule_rank"), F.lit(0).cast("bigint").alias("off"), F.lit(0).cast("bigint").alias("line"), F.col("base_raw").alias("raw"),
            F.col("base_raw").alias("value"), F.lit(".").alias("kind"), F.lit(None).cast(taint_type).alias("taint"),
        ))

    def of_file(lines: Column) -> Column:
        def with_kinds(kinds: Column) -> Column:
            def with_blocks(blocks: Column) -> Column:
                def of_rule(rank: Column) -> Column:
                    return let(_rule_of(rank, rules), lambda rule: F.when(rule["by_name"], of_name(rank)).otherwise(of_text(rank, rule, lines, kinds, blocks)))

                return F.flatten(F.transform("_hits", of_rule))

            return let(F.when(F.arrays_overlap("_hits", F.lit(anti_ranks or [-1])), _blocks(content)), with_blocks)

        return let(F.split(F.coalesce(F.col("_kinds"), F.lit("")), ""), with_kinds)

    return F.when(F.size("_hits") > 0, let(F.split(content, "\n"), of_file))


def scan_files(
    classified: DataFrame, rules: list[Rule], *, mode: str = "full", inline_comments: bool = False,
    taint_max_kb: int | None = None,
) -> DataFrame:
    """Raw findings of classified files(repo_id, path, content, ext, file_type, framework, ...).

    No shuffle, no join and no row that carries a text besides the file's own: everything comes from that row and from
    constants. The result has one row per match that passed the anti-pattern, comment and
    taint checks, in base severity, before context modifiers and de-duplication.
    """
    taint_ranks = [rank for rank, r, _, _ in passes(rules) if r.taint_aware]
    files = classified.withColumns(
        {
            "base_raw": basename(F.col("path")),
            "_infra": infra_eligible(F.col("path"), F.col("content")),
            "_candidates": _candidates([(rank, r) for rank, r, _, _ in passes(rules)]),
        }
    ).withColumn("_hits", _gate(rules, mode, taint_max_kb))
    files = files.withColumns(
        {
            "_kinds": F.when(
                F.size("_hits") > 0, line_kinds(F.col("content"), F.col("ext"), inline_comments)
            ),
            "_taint": F.when(
                F.arrays_overlap("_hits", F.lit(taint_ranks or [-1])),
                tainted_vars(F.col("content"), F.col("ext")),
            ).otherwise(F.array().cast(ENTRY)),
        }
    )
    keep = ["repo_id", "path", "ext", "file_type", "framework", "language", "scan_context"]
    found = files.select(*keep, F.inline_outer(_found(rules))).where(F.col("off").isNotNull())
    rule = _rule_of(F.col("rule_rank"), rules)
    found = found.withColumn("_rule", rule).select("*", *[F.col(f"_rule.{c}") for c in ("rule_id", "name", "category", "base_severity", "source")]).drop("_rule")
    return build_findings(found, rules)


def build_findings(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """Identity, snippet and confidence of raw matches."""
    trimmed = F.regexp_replace("raw", r"^\s+|\s+\z", "")
    return found.withColumns(
        {
            "confidence": confidence_column(rules),
            "snippet": identity.strip_control(trimmed),
            "code_hash": identity.code_hash(F.col("raw")),
            "finding_id": identity.finding_id(F.col("rule_id"), F.col("path"), F.col("raw")),
            "line_type": kind_name(F.col("kind")),
            "taint_source": F.col("taint"),
        }
    ).drop("raw", "value", "kind", "taint")


def match_table(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every match of every rule whose `file_types` holds the file's extension (or is empty).

    Columns repo_id, path, rule_id, rule_rank, off, line, raw, text, value; no filters applied.
    """
    numbered = [(rank, r) for rank, r, _, _ in passes(rules)]
    content = F.col("content")
    tests = [(rank, f"{_one_of('ext', r.file_types)} AND {_hit_test(rank, r)}" if r.file_types else _hit_test(rank, r)) for rank, r in numbered]
    hits = files.withColumns({"ext": extension(F.col("path")), "_candidates": _candidates(numbered)}).withColumn("_hits", _ranks_of(tests))

    def with_raw(lines: Column) -> Column:
        def of_rule(rank: Column) -> Column:
            return F.transform(_all_matches(content, rank, _rule_of(rank, rules), numbered), lambda m: F.struct(
                rank.alias("rule_rank"), m["off"].alias("off"), m["line"].alias("line"),
                F.get(lines, (m["line"] - 1).cast("int")).alias("raw"), m["text"].alias("text"), m["value"].alias("value"),
            ))

        return F.flatten(F.transform("_hits", of_rule))

    found = F.when(F.size("_hits") > 0, let(F.split(content, "\n"), with_raw))
    rows = hits.select("repo_id", "path", F.inline_outer(found)).where(F.col("off").isNotNull())
    return rows.select("repo_id", "path", _rule_of(F.col("rule_rank"), rules)["rule_id"].alias("rule_id"), "rule_rank", "off", "line", "raw", "text", "value")


def antipattern_present(content: Column, off: Column, anti: str, behind: int = 120, ahead: int = 300) -> Column:
    """Whether the anti-pattern occurs in the window around one match of a row that carries the text."""
    window = F.substr(
        content, (F.greatest(off - behind, F.lit(0)) + 1).cast("int"),
        (F.least(off, F.lit(behind)) + ahead).cast("int"),
    )
    return window.rlike(java_pattern(anti, "i"))


def comment_suppress(found: DataFrame, lines: DataFrame, exempt=()) -> DataFrame:
    """Join form of the comment filter: drop findings on COMMENT lines unless their rule is exempt."""
    comments = lines.where("line_type = 'COMMENT'").select("repo_id", "path", "line", F.lit(True).alias("_c"))
    return (
        found.join(comments, ["repo_id", "path", "line"], "left")
        .where(F.col("_c").isNull() | F.col("rule_id").isin(list(exempt)))
        .drop("_c")
    )


def coverage(classified: DataFrame, domain: str = "all") -> DataFrame:
    """Files whose rules ran: the source context, with the rule domain."""
    return (
        classified.where(F.col("scan_context") == "source")
        .select("repo_id", "path", F.lit(domain).alias("rule_domain"))
        .distinct()
    )
