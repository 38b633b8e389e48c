"""Scans from SQL: a function over text and path that gives the matches of a set of rules.

    register_scan(spark, rules)
    SELECT path, m.* FROM (SELECT path, scan_text(content, path) AS matches FROM files) LATERAL VIEW inline(matches) m

The function is an SQL expression with the rules' patterns as constants, so a query with it is planned like any other: no
worker outside the JVM, no join, no exchange.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from siftlake.functions.exprs import sql_text
from siftlake.functions.literals import automaton, has_group, owners, required
from siftlake.operators.match import MARKS
from siftlake.operators.rules import Rule, passes

MATCH = "STRUCT<rule_id: STRING, severity: STRING, off: BIGINT, line: BIGINT, raw: STRING, text: STRING, value: STRING>"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _count(text: str) -> str:
    return f"(length({text}) - length(replace({text}, '\\n', '')))"


def _running(values: str, field: str) -> str:
    """Sums of a field before each element; pieces are cut into runs, so that long arrays stay cheap to add up."""
    step = f"(a, v) -> struct(a.t + v.{field} AS t, concat(a.o, array(a.t)) AS o)"
    run = f"transform(sequence(0, greatest(0, CAST(ceil(size({values}) / 512.0) AS INT) - 1)), c -> slice({values}, c * 512 + 1, 512))"
    fold = lambda xs, start: f"aggregate({xs}, struct({start} AS t, CAST(array() AS ARRAY<BIGINT>) AS o), {step}, a -> a.o)"
    total = f"aggregate(r, 0L, (a, v) -> a + v.{field})"
    sums = f"aggregate(transform(rs, r -> {total}), struct(0L AS t, CAST(array() AS ARRAY<BIGINT>) AS o), (a, v) -> struct(a.t + v AS t, concat(a.o, array(a.t)) AS o), a -> a.o)"
    return _let(run, "rs", _let(sums, "ss", f"flatten(zip_with(rs, ss, (r, s) -> {fold('r', 's')}))"))


def scan_expression(rules: list[Rule]) -> str:
    """SQL text of array<MATCH> over the names `content` and `path`."""
    numbered = [(k, r, exts) for k, r, exts, _ in passes(rules) if r.match_mode != "filename"]
    before, between, after = (sql_text(m) for m in MARKS)
    needs = {k: required(r.pattern) for k, r, _ in numbered}
    table = owners({k: v for k, v in needs.items() if v and all(len(w) > 1 for w in v)})
    found = f"array_distinct(regexp_extract_all(lower(content), {sql_text(automaton(table))}, 1))" if table else "CAST(array() AS ARRAY<STRING>)"

    def test(k: int, r: Rule, exts) -> str:
        conds = [f"lower(substring_index(path, '.', -1)) IN ({', '.join(sql_text(e) for e in exts)})"] if exts is not None else []
        mine = [w for w, ks in table.items() if k in ks]
        if mine:
            conds.append(f"arrays_overlap(lits, array({', '.join(sql_text(w) for w in mine)}))")
        return " AND ".join([*conds, f"rlike(content, {sql_text(r.java)})"])

    def marked(r: Rule) -> str:
        pattern = r.java if has_group(r.pattern) else f"(?:{r.java})|(?!)()"
        return f"regexp_replace(plain, {sql_text(pattern)}, {sql_text(f'{MARKS[0]}$0{MARKS[1]}$1{MARKS[2]}')})"

    hits = "array_compact(array(" + ", ".join(f"CASE WHEN {test(k, r, exts)} THEN {k} END" for k, r, exts in numbered) + "))"
    one = "CASE k " + " ".join(f"WHEN {k} THEN {marked(r)}" for k, r, _ in numbered) + " END"
    rule_id = "CASE k " + " ".join(f"WHEN {k} THEN {sql_text(r.id)}" for k, r, _ in numbered) + " END"
    severity = "CASE k " + " ".join(f"WHEN {k} THEN {sql_text(r.severity)}" for k, r, _ in numbered) + " END"
    piece = (
        f"struct(substring_index(p, {between}, 1) AS m, substring_index(substring_index(p, {after}, 1), {between}, -1) AS g, substring_index(p, {after}, -1) AS rest)"
    )
    sized = f"transform(transform(slice(parts, 2, size(parts)), p -> {piece}), q -> struct(q.m AS m, q.g AS g, CAST(length(q.m) + length(q.rest) AS BIGINT) AS n, CAST({_count('q.m')} + {_count('q.rest')} AS BIGINT) AS l))"
    # a text that holds the marks themselves is matched with others in their place and then cut anew
    own = "CASE WHEN odd THEN substr(content, CAST(o.off AS INT) + 1, length(o.m)) ELSE o.m END"
    placed = (
        f"transform(zip_with(zip_with(ps, {_running('ps', 'n')}, (p, s) -> struct(p.m AS m, p.g AS g, s + length(parts[0]) AS off)), {_running('ps', 'l')}, "
        f"(p, s) -> struct(p.m AS m, p.g AS g, p.off AS off, s + {_count('parts[0]')} + 1 AS line)), "
        f"o -> named_struct('rule_id', {rule_id}, 'severity', {severity}, 'off', o.off, 'line', o.line, 'raw', lines[CAST(o.line AS INT) - 1], 'text', {own}, 'value', CASE WHEN o.g <> '' THEN o.g ELSE {own} END))"
    )
    of_rule = _let(f"split({one}, {before}, -1)", "parts", _let(sized, "ps", placed))
    every = f"flatten(transform(hits, k -> {of_rule}))"
    odd = " OR ".join(f"contains(content, {m})" for m in (before, between, after))
    plain = f"CASE WHEN odd THEN translate(content, {sql_text(''.join(MARKS))}, '\\ufffd\\ufffd\\ufffd') ELSE content END"
    body = _let(odd, "odd", _let(plain, "plain", _let("split(content, '\\n', -1)", "lines", every)))
    return _let(found, "lits", _let(hits, "hits", f"CASE WHEN size(hits) > 0 THEN {body} END"))


def register_scan(spark: SparkSession, rules: list[Rule], name: str = "scan_text") -> None:
    """Creates the temporary function `name(content, path)` of this session; it gives an array of MATCH, null for none."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(content STRING, path STRING) RETURNS ARRAY<{MATCH}> RETURN {scan_expression(rules)}")
