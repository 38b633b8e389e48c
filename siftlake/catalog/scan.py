"""Matching, comments, taint, identity, severity, de-duplication and scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.catalog import fixtures as fx
from siftlake.catalog.files import ALL_SQL, CLASSIFY, EXT, both, q
from siftlake.catalog.fixtures import sql
from siftlake.functions import identity as idn, severity as sv
from siftlake.functions.paths import extension
from siftlake.operators import classify as cl, comments as cm, match as mt, rules as rl, scope as sc
from siftlake.operators import severity as sev, taint as tt
from siftlake.plans.sql import register_scan
from siftlake.sources import files as src

QUERIES, ORACLE = {}, {}


def register(key, fn, text=None):
    QUERIES[key] = fn
    if text:
        ORACLE[key] = text


# Rules of the registered scans; own wording, expressible in every regex dialect in use here.
CORPUS_RAW = [
    dict(id="SEC-TOKEN", severity="CRITICAL", pattern='token\\s*=\\s*"([0-9a-f]{32,})"', category="Sensitive Data Exposure (A02)",
         flags="g", antipattern="placeholder|dummy",
         confidence_rules=[{"if_value_shorter_than": 36, "then": "LOW"}, {"if_value_not_matches": "[a-f]", "then": "MEDIUM"},
                           {"if_file_context": ["test"], "if_path_contains": ["vendor/"], "then": "LOW"}, {"default": "HIGH"}]),
    dict(id="PII-EMAIL", severity="MEDIUM", pattern="[A-Za-z0-9._]+@[A-Za-z0-9.]+", category="Sensitive Data Exposure / GDPR",
         flags="g", antipattern="noreply|[0-9]{4}"),
    dict(id="NET-IPV4", severity="EXPOSURE", pattern="[0-9]{1,3}(\\.[0-9]{1,3}){3}", category="Infrastructure Leakage",
         flags="g", confidence="MEDIUM"),
    dict(id="PII-CARD", severity="HIGH", pattern="[0-9]{16}", category="Sensitive Data Exposure / GDPR", flags="g"),
    dict(id="LIC-LINE", severity="LOW", pattern="MIT License", category="Licence", flags="g"),
    dict(id="WEB-INLINE", severity="HIGH", pattern="<script>", category="Injection (A03)", file_types=["html"],
         flags="g"),
    dict(id="LONG-WORD", severity="MEDIUM", pattern="token", category="Licence", flags="gi"),
]
CORPUS = [rl.to_rule(r, "corpus", i) for i, r in enumerate(CORPUS_RAW)]


def _rule_hits_sql(rules, source: str, name: str) -> str:
    """CTE text: all matches of the rules over `source` with offset, line, raw, text and value."""
    parts = []
    for rank, r, exts, _ in rl.passes(rules):
        rx = ("(?i)" if "i" in r.flags else "") + r.pattern
        full = q("(?s:(.*?))(?:" + rx + ")")
        has_group = "(" in r.pattern.replace("(?:", "").replace("\\(", "")
        val = f"unnest(regexp_extract_all(content, {full}, 2))" if has_group else "''"
        on = "" if exts is None else " AND " + EXT + " IN (" + ", ".join(f"'{e}'" for e in exts) + ")"
        parts.append(
            f"SELECT repo_id, path, content, '{r.id}' AS rule_id, {rank} AS rule_rank, unnest(regexp_extract_all(content, {full}, 0)) AS piece,"
            f" unnest(regexp_extract_all(content, {full}, 1)) AS prefix, {val} AS grp,"
            f" generate_subscripts(regexp_extract_all(content, {full}, 0), 1) AS i FROM {source}"
            f" WHERE regexp_matches(content, {q(rx)}){on}"
        )
    return (
        f"{name}_pieces AS ({' UNION ALL '.join(parts)}),\n"
        f"{name} AS (SELECT *, string_split(content, chr(10))[line] AS raw FROM (SELECT *,"
        " 1 + length(substr(content, 1, off)) - length(replace(substr(content, 1, off), chr(10), '')) AS line FROM ("
        " SELECT repo_id, path, content, rule_id, rule_rank, substr(piece, length(prefix) + 1) AS text,"
        " CASE WHEN grp <> '' THEN grp ELSE substr(piece, length(prefix) + 1) END AS value,"
        " CAST(sum(length(piece)) OVER (PARTITION BY repo_id, path, rule_id, rule_rank ORDER BY i) - length(piece) + length(prefix) AS BIGINT) AS off"
        f" FROM {name}_pieces)))"
    )


HITS = _rule_hits_sql(CORPUS, "files", "hits")
register(
    "match_all",
    lambda s, d: mt.match_table(src.balanced(fx.document_files(s, d)), CORPUS).select("repo_id", "path", "rule_id", "off", "text", "value"),
    sql("files", "SELECT repo_id, path, rule_id, off, text, value FROM hits", HITS),
)
register(
    "match_line",
    lambda s, d: mt.match_table(src.balanced(fx.document_files(s, d)), CORPUS).select("repo_id", "path", "rule_id", "off", "line", F.sha2("raw", 256).alias("raw_hash")),
    sql("files", "SELECT repo_id, path, rule_id, off, line, sha256(raw) AS raw_hash FROM hits", HITS),
)
register(
    "snippet_sanitise",
    lambda s, d: mt.match_table(src.balanced(fx.document_files(s, d)), CORPUS).select(
        "repo_id", "path", "rule_id", "off", F.sha2(idn.strip_control(F.concat(F.lit("\x1b[1m"), "raw", F.lit("\x00\t\u0085"))), 256).alias("snippet_hash")),
    sql("files", "SELECT repo_id, path, rule_id, off, sha256(regexp_replace('[1m' || raw || chr(9), '[\\x00-\\x08\\x0a-\\x1f\\x7f-\\x{9f}]', '', 'g')) AS snippet_hash FROM hits", HITS),
)


def _sql_scan(s, d):
    """The scan asked for in SQL."""
    register_scan(s, CORPUS, "siftlake_scan")
    src.balanced(fx.document_files(s, d)).createOrReplaceTempView("siftlake_files")
    return s.sql("""SELECT repo_id, path, m.rule_id, m.severity, m.off, m.line, sha2(m.raw, 256) AS raw_hash, m.text, m.value
        FROM (SELECT repo_id, path, siftlake_scan(content, path) AS matches FROM siftlake_files) LATERAL VIEW inline(matches) m""")


SEVERITY_SQL = "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN '{r.severity}'" for r in CORPUS) + " END"
register("sql_scan", _sql_scan, sql("files", f"SELECT repo_id, path, rule_id, {SEVERITY_SQL} AS severity, off, line, sha256(raw) AS raw_hash, text, value FROM hits", HITS))


def _anti(s, d):
    m = mt.match_table(fx.document_files(s, d), [r for r in CORPUS if r.id == "PII-EMAIL"])
    joined = m.join(fx.document_files(s, d), ["repo_id", "path"])
    return joined.select("repo_id", "path", "off", mt.antipattern_present(F.col("content"), F.col("off"), "noreply|[0-9]{4}").alias("suppressed"))


register(
    "antipattern_window", _anti,
    sql("files", """SELECT repo_id, path, off, regexp_matches(substr(content, greatest(off - 120, 0) + 1, least(off, 120) + 300), '(?i)noreply|[0-9]{4}') AS suppressed
    FROM hits WHERE rule_id = 'PII-EMAIL'""", HITS),
)


# ------------------------------------------------------------------ comments
def _qlist(xs):
    return fx._sql_list(list(xs)) if xs else "[]::VARCHAR[]"


FAM_SQL = "fam(ext, prefixes, opener, closer, magic) AS (VALUES " + ", ".join(
    f"('{e}', {_qlist(f.line)}, {q(f.block[0]) if f.block else 'NULL'}, {q(f.block[1]) if f.block else 'NULL'}, {_qlist(f.magic)})"
    for f in cm.FAMILIES for e in f.exts
) + ")"
_Q = "|".join(c + "(?:[^" + c + "\\\\]|\\\\+[^\\\\])*" + c for c in "\"'`")


def _mixed_rx(markers) -> str:
    if not markers:
        return "\\z."
    if list(markers) == ["//", "#"]:
        return "^(?:/?(?:[^\"'`/#]|" + _Q + "))*(?:/?#|//)"
    m = markers[0]
    if len(m) == 2:
        return "^(?:" + m[0] + "?(?:[^\"'`" + m[0] + "]|" + _Q + "))*" + m
    return "^(?:[^\"'`" + "".join(markers) + "]|" + _Q + ")*[" + "".join(markers) + "]"


MIX_SQL = "mix AS (" + " UNION ALL ".join(
    f"SELECT *, regexp_matches(raw, {q(_mixed_rx(f.inline))}) AS inline_marker FROM typed WHERE ext IN (" + ", ".join(f"'{e}'" for e in f.exts) + ")"
    for f in cm.FAMILIES) + ")"
COMMENT_SQL = (
    """lines AS (SELECT repo_id, path, ext, unnest(string_split(content, chr(10))) AS raw,
  generate_subscripts(string_split(content, chr(10)), 1) AS line FROM code_files)""",
    FAM_SQL,
    """letters AS (SELECT l.*, prefixes, opener, closer, magic, regexp_replace(raw, '^\\s+', '') AS t,
  coalesce(contains(raw, opener) AND NOT contains(substr(raw, instr(raw, opener) + length(opener)), closer), false) AS op,
  coalesce(contains(raw, closer), false) AS cl FROM lines l LEFT JOIN fam USING (ext))""",
    """cum AS (SELECT *, CASE WHEN op AND NOT cl THEN 1 WHEN cl AND NOT op THEN 0 END AS sr,
  sum(CASE WHEN op AND cl THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS xs FROM letters)""",
    """states AS (SELECT *, last_value(sr IGNORE NULLS) OVER w AS last_sr,
  last_value(CASE WHEN sr IS NOT NULL THEN coalesce(xs, 0) END IGNORE NULLS) OVER w AS xs_at FROM cum
  WINDOW w AS (PARTITION BY repo_id, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    """py AS (SELECT repo_id, path, list_reduce(list_prepend('_', string_split(content, chr(10))), lambda acc, x: acc ||
  CASE right(acc, 1) WHEN 'd' THEN 'c' || CASE WHEN contains(x, '\"\"\"') THEN '_' ELSE 'd' END
    WHEN 's' THEN 'c' || CASE WHEN contains(x, '''''''') THEN '_' ELSE 's' END
    ELSE CASE WHEN regexp_matches(x, '^\\s*\"\"\"') THEN 'c' || CASE WHEN contains(substr(regexp_replace(x, '^\\s+', ''), 4), '\"\"\"') THEN '_' ELSE 'd' END
      WHEN regexp_matches(x, '^\\s*''''''') THEN 'c' || CASE WHEN contains(substr(regexp_replace(x, '^\\s+', ''), 4), '''''''') THEN '_' ELSE 's' END
      ELSE '._' END END) AS path_states FROM code_files WHERE ext = 'py')""",
    """typed AS (SELECT s.*, (coalesce(last_sr, 0) + coalesce(xs, 0) - coalesce(xs_at, 0)) % 2 = 1 AS inside,
  coalesce(substr(path_states, CAST(2 * line AS BIGINT), 1) = 'c', false) AS doc,
  coalesce(instr(raw, opener), 0) AS opos,
  len(list_filter(coalesce(prefixes, []), lambda p: starts_with(CASE WHEN ext IN ('bat', 'cmd') THEN lower(t) ELSE t END, p))) > 0
    AND len(list_filter(coalesce(magic, []), lambda p: starts_with(t, p))) = 0 AS pre
  FROM states s LEFT JOIN py USING (repo_id, path))""",
    """kinds AS (SELECT *, CASE WHEN inside OR doc THEN 'COMMENT' WHEN opos > 0 AND trim(substr(raw, 1, opos - 1)) = '' THEN 'COMMENT'
  WHEN opos > 0 THEN 'OPENS' WHEN pre THEN 'COMMENT' ELSE 'CODE' END AS kind FROM typed)""",
)
register(
    "comment_lines",
    lambda s, d: cm.comment_lines(fx.code_files(s, d)),
    sql("code_files", "SELECT repo_id, path, line, raw, CASE WHEN kind = 'COMMENT' THEN 'COMMENT' ELSE 'CODE' END AS line_type FROM kinds", *COMMENT_SQL),
)
INLINE_KINDS = MIX_SQL.replace("FROM typed", "FROM kinds")
INLINE_TYPE = "CASE WHEN kind = 'COMMENT' THEN 'COMMENT' WHEN kind = 'OPENS' OR inline_marker THEN 'MIXED' ELSE 'CODE' END"
register(
    "comment_inline",
    lambda s, d: cm.comment_lines(fx.code_files(s, d), inline=True),
    sql("code_files", f"SELECT repo_id, path, line, raw, {INLINE_TYPE} AS line_type FROM mix", *COMMENT_SQL, INLINE_KINDS),
)
register(
    "comment_stats",
    lambda s, d: cm.comment_stats(fx.code_files(s, d), inline=True),
    sql("code_files", f"""SELECT repo_id, path, count(*) FILTER ({INLINE_TYPE} = 'COMMENT') AS comment_lines,
    count(*) FILTER ({INLINE_TYPE} = 'MIXED') AS mixed_lines FROM mix GROUP BY ALL""", *COMMENT_SQL, INLINE_KINDS),
)
WORD_RULES = [
    rl.to_rule(dict(id="W-NOTE", pattern="note|remark", severity="HIGH", flags="g"), "corpus", 0),
    rl.to_rule(dict(id="W-CALL", pattern="call\\(|run\\(", severity="HIGH", flags="g", scan_comments=True), "corpus", 1),
    rl.to_rule(dict(id="W-OPEN", pattern="open", severity="MEDIUM", flags="gi"), "corpus", 2),
]
WORD_HITS = _rule_hits_sql(WORD_RULES, "code_files", "hits")


def _suppress(s, d):
    files = fx.code_files(s, d)
    found = mt.match_table(files, WORD_RULES)
    return mt.comment_suppress(found, cm.comment_lines(files), ["W-CALL"]).select("repo_id", "path", "rule_id", "off", "line")


SUPPRESSED_SQL = """SELECT h.repo_id, h.path, rule_id, off, h.line FROM hits h JOIN kinds k ON h.repo_id = k.repo_id AND h.path = k.path AND h.line = k.line
  WHERE kind <> 'COMMENT' OR rule_id = 'W-CALL'"""
register("comment_suppress", _suppress, sql("code_files", SUPPRESSED_SQL, *COMMENT_SQL, WORD_HITS))

# ------------------------------------------------------------------ taint
SKIP = "regexp_matches(raw, '^\\s*(?://|#|\\*|/\\*)')"


def _taint_sql(lang: str) -> str:
    rxs = tt.SOURCES[lang]
    var = "CASE " + " ".join(f"WHEN regexp_matches(raw, {q(r)}) THEN regexp_extract(raw, {q(r)}, 1)" for r in rxs) + " END"
    srcx = "CASE " + " ".join(f"WHEN regexp_matches(raw, {q(r)}) THEN regexp_extract(raw, {q(r)}, 2)" for r in rxs) + " END"
    exts = ", ".join(f"'{e}'" for e, n in tt.TAINT_LANGUAGE.items() if n == lang)
    return f"SELECT repo_id, path, line, {var} AS var, {srcx} AS source FROM tlines WHERE ext IN ({exts}) AND NOT {SKIP}"


TAINT_SQL = (
    """tlines AS (SELECT repo_id, path, ext, unnest(string_split(content, chr(10))) AS raw,
  generate_subscripts(string_split(content, chr(10)), 1) AS line FROM code_files)""",
    "direct AS (SELECT * FROM (" + " UNION ALL ".join(_taint_sql(n) for n in tt.SOURCES) + ") WHERE var IS NOT NULL)",
    f"wild AS (SELECT repo_id, path, line, '*' AS var, 'extract()' AS source FROM tlines WHERE ext = 'php' AND NOT {SKIP} AND regexp_matches(raw, {q(tt.WILDCARD)}))",
    f"""destr AS (SELECT repo_id, path, line, trim(split_part(part, ':', 1)) AS var, source FROM (SELECT repo_id, path, line,
  unnest(string_split(regexp_extract(raw, {q(tt.DESTRUCTURE)}, 1), ',')) AS part, regexp_extract(raw, {q(tt.DESTRUCTURE)}, 2) AS source
  FROM tlines WHERE ext IN ('js', 'ts') AND NOT {SKIP} AND regexp_matches(raw, {q(tt.DESTRUCTURE)})) WHERE regexp_matches(trim(split_part(part, ':', 1)), '^\\w+$'))""",
    """register AS (SELECT repo_id, path, var, min(line) AS line, min_by(source, line) AS source
  FROM (SELECT * FROM direct UNION ALL SELECT * FROM wild UNION ALL SELECT * FROM destr) GROUP BY ALL)""",
)
REG_COLS = ["repo_id", "path", "var", "line", "source"]
register(
    "taint_register", lambda s, d: tt.taint_register(fx.code_files(s, d)).select(*REG_COLS),
    sql("code_files", "SELECT repo_id, path, var, line, source FROM register", *TAINT_SQL),
)
register(
    "taint_wildcard", lambda s, d: tt.taint_register(fx.code_files(s, d)).where("var = '*'").select(*REG_COLS),
    sql("code_files", "SELECT repo_id, path, '*' AS var, min(line) AS line, 'extract()' AS source FROM wild GROUP BY ALL", *TAINT_SQL),
)


def _destructure(s, d):
    lines = cm.comment_lines(fx.code_files(s, d)).where(extension(F.col("path")).isin("js", "ts") & F.col("raw").rlike(tt.DESTRUCTURE))
    skip = F.col("raw").rlike(r"^\s*(?://|#|\*|/\*)")
    return lines.where(~skip).select("repo_id", "path", F.inline(tt._destructured(F.col("raw"), F.col("line"))))


register("taint_destructure", _destructure, sql("code_files", "SELECT repo_id, path, var, line, source FROM destr", *TAINT_SQL))
STRATEGY = {"py": "func_concat", "php": "concat", "js": "concat", "ts": "func_concat"}
SINK_WORDS = "run\\(|mysql_query|echo|exec\\(|out\\("


def _sinks(s, d):
    ext = extension(F.col("path"))
    strategy = (
        F.when(ext == "py", "func_concat").when((ext == "php") & F.col("raw").contains("echo"), "interpolation")
        .when((ext == "php") & F.col("raw").contains("exec"), "func_concat").when(ext == "php", "concat")
        .when(ext == "js", "concat").otherwise("func_concat")
    )
    lines = cm.comment_lines(fx.code_files(s, d)).where(ext.isin("py", "php", "js", "ts") & F.col("raw").rlike(SINK_WORDS))
    return lines.select("repo_id", "path", "line", "raw", tt.sink_variable(F.col("raw"), strategy).alias("variable"))


def _first_ok(rx: str, text: str = "raw") -> str:
    bad = "^(?:" + "|".join(tt.NOT_TAINTABLE) + ")"
    return f"list_filter(regexp_extract_all({text}, {q(rx)}, 1), lambda n: NOT regexp_matches(n, '{bad}'))[1]"


_ex = lambda rx: f"nullif(regexp_extract(raw, {q(rx)}, 1), '')"
_kw = "(" + ", ".join(f"'{k}'" for k in tt.JS_KEYWORDS) + ")"
_nokw = lambda e: f"(SELECT CASE WHEN c NOT IN {_kw} THEN c END FROM (SELECT {e} AS c))"
_op = tt.OPERANDS
SINK_SQL = (
    f"""sinks0 AS (SELECT *, CASE WHEN ext = 'py' THEN 'func_concat' WHEN ext = 'php' AND contains(raw, 'echo') THEN 'interpolation'
  WHEN ext = 'php' AND contains(raw, 'exec') THEN 'func_concat' WHEN ext = 'php' THEN 'concat' WHEN ext = 'js' THEN 'concat' ELSE 'func_concat' END AS strategy
  FROM tlines WHERE ext IN ('py', 'php', 'js', 'ts') AND regexp_matches(raw, {q(SINK_WORDS)}))""",
    f"""cands AS (SELECT *, {_ex(_op['quoted'])} AS instr_, coalesce({_first_ok(_op['php_passed'])}, {_first_ok(_op['php_joined'])}) AS php_call,
  coalesce({_ex(_op['template'])}, {_ex(_op['added'])}, {_ex(_op['passed'])}) AS js_call, {_first_ok(_op['php_joined'])} AS php_concat,
  coalesce({_ex(_op['template'])}, {_ex(_op['added'])}) AS js_concat FROM sinks0)""",
    f"""sinks AS (SELECT repo_id, path, line, raw, CASE strategy WHEN 'interpolation' THEN
    CASE WHEN instr_ IS NOT NULL THEN {_first_ok(_op['php_any'], 'instr_')} ELSE {_first_ok(_op['php_any'])} END
  WHEN 'func_concat' THEN coalesce(php_call, CASE WHEN js_call NOT IN {_kw} THEN js_call END)
  ELSE coalesce(php_concat, CASE WHEN js_concat NOT IN {_kw} THEN js_concat END) END AS variable FROM cands)""",
)
register(
    "taint_var_extract", lambda s, d: _sinks(s, d),
    sql("code_files", "SELECT repo_id, path, line, raw, variable FROM sinks", *TAINT_SQL, *SINK_SQL),
)
register(
    "taint_join",
    lambda s, d: tt.taint_join(_sinks(s, d), tt.taint_register(fx.code_files(s, d))).select("repo_id", "path", "line", "variable", "taint_line", "taint_source"),
    sql("code_files", """SELECT s.repo_id, s.path, s.line, variable, coalesce(r.line, w.line) AS taint_line,
    CASE WHEN r.line IS NOT NULL THEN r.source ELSE 'extract()' END AS taint_source FROM sinks s
    LEFT JOIN register r ON s.repo_id = r.repo_id AND s.path = r.path AND s.variable = r.var
    LEFT JOIN register w ON s.repo_id = w.repo_id AND s.path = w.path AND w.var = '*'
    WHERE variable IS NOT NULL AND coalesce(r.line, w.line) IS NOT NULL""", *TAINT_SQL, *SINK_SQL),
)

# ------------------------------------------------------------------ rules and findings
CODE_RAW = [
    dict(id="T-PHP-SQL", pattern="mysql_query\\s*\\(", taint_aware=True, taint_extract="concat", severity="CRITICAL", file_types=["php"], flags="g"),
    dict(id="T-PHP-ECHO", pattern="echo\\s", taint_aware=True, taint_extract="interpolation", severity="HIGH", file_types=["php"], flags="g"),
    dict(id="T-PHP-EXEC", pattern="exec\\s*\\(", taint_aware=True, taint_extract="func_concat", severity="CRITICAL", file_types=["php"], flags="g"),
    dict(id="T-JS-RUN", pattern="run\\s*\\(", taint_aware=True, severity="CRITICAL", file_types=["js"], flags="g"),
    dict(id="T-JS-OUT", pattern="out\\s*\\(", taint_aware=True, severity="MEDIUM", file_types=["js"], flags="g"),
    dict(id="T-TS-RUN", pattern="run\\s*\\(", taint_aware=True, taint_extract="func_concat", severity="CRITICAL", file_types=["ts"], flags="g"),
    dict(id="T-PY-RUN", pattern="run\\s*\\(", taint_aware=True, taint_extract="func_concat", severity="CRITICAL", file_types=["py"], flags="g"),
    dict(id="C-CALL", pattern="call\\s*\\(", severity="HIGH", flags="g", antipattern="y = 2", lookahead=60, lookbehind=10),
    dict(id="C-NOTE", pattern="remark", severity="MEDIUM", flags="gi"),
]
CODE_RULES = [rl.to_rule(r, "corpus", i) for i, r in enumerate(CODE_RAW)]


def scan_stage(s, d, files, rules, **kw):
    return mt.scan_files(cl.classify_files(src.balanced(files)), rules, **kw)


FOUND = ["repo_id", "path", "rule_id", "line", "off", "base_severity", "confidence", "finding_id", "code_hash"]


def _ctx_sql(path="path") -> str:
    segs = " + ".join(f"CASE WHEN contains('/' || lower({path}), '{k}') THEN {v} ELSE 0 END" for k, v in sev.SEGMENT_MODIFIERS.items())
    types = "CASE file_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sev.TYPE_MODIFIERS.items()) + " ELSE 0 END"
    fws = "CASE framework " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sev.FRAMEWORK_MODIFIERS.items()) + " ELSE 0 END"
    return f"({types} + {segs} + {fws})"


SCORE = "CASE base_severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'EXPOSURE' THEN 1 ELSE 0 END"
EFFECTIVE = "(['INFO', 'EXPOSURE', 'MEDIUM', 'HIGH', 'CRITICAL'])[CAST(greatest(0, least(4, score)) AS INT) + 1]"
RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'EXPOSURE' THEN 3 WHEN 'INFO' THEN 4 ELSE 9 END"
FOUND_DOC_SQL = (
    "spread AS (SELECT repo_id, path, content FROM files)", *CLASSIFY[1:], HITS,
    "rulemeta(rule_id, base_severity, category) AS (VALUES " + ", ".join(f"('{r.id}', '{r.severity}', '{r.category}')" for r in CORPUS) + ")",
    f"""found AS (SELECT h.*, base_severity, category, file_type, framework, scan_context,
  'f-' || substring(sha256(h.rule_id || '|' || h.path || '|' || coalesce(raw, '')), 1, 10) AS finding_id,
  CASE WHEN raw <> '' THEN substring(sha256(raw), 1, 32) END AS code_hash, NULL AS taint_source,
  CASE h.rule_id WHEN 'SEC-TOKEN' THEN CASE WHEN length(value) < 36 THEN 'LOW' WHEN NOT regexp_matches(value, '[a-f]') THEN 'MEDIUM'
    WHEN regexp_matches(lower(h.path), {q(cl.RULE_TEST_PATH)}) OR contains(lower(h.path), 'vendor/') THEN 'LOW' ELSE 'HIGH' END
    WHEN 'NET-IPV4' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence
  FROM hits h JOIN rulemeta USING (rule_id) JOIN classified c ON h.repo_id = c.repo_id AND h.path = c.path
  WHERE scan_context = 'source'
  AND NOT (h.rule_id = 'SEC-TOKEN' AND regexp_matches(substr(h.content, greatest(off - 120, 0) + 1, least(off, 120) + 300), '(?i)placeholder|dummy'))
  AND NOT (h.rule_id = 'PII-EMAIL' AND regexp_matches(substr(h.content, greatest(off - 120, 0) + 1, least(off, 120) + 300), '(?i)noreply|[0-9]{{4}}'))
  AND NOT EXISTS (FROM dkinds k WHERE k.repo_id = h.repo_id AND k.path = h.path AND k.line = h.line AND k.kind = 'COMMENT'))""",
)
DOC_COMMENTS = tuple(
    c.replace("FROM code_files", f"FROM (SELECT *, {EXT} AS ext FROM files)").replace("kinds AS", "dkinds AS") for c in COMMENT_SQL
)
FOUND_ALL = DOC_COMMENTS + FOUND_DOC_SQL
register(
    "finding_build",
    lambda s, d: scan_stage(s, d, fx.document_files(s, d), CORPUS).select(*FOUND),
    sql("files", "SELECT " + ", ".join(FOUND) + " FROM found", *FOUND_ALL),
)
register(
    "confidence_rules",
    lambda s, d: scan_stage(s, d, fx.document_files(s, d), CORPUS).where("rule_id = 'SEC-TOKEN'").select("repo_id", "path", "off", "confidence"),
    sql("files", "SELECT repo_id, path, off, confidence FROM found WHERE rule_id = 'SEC-TOKEN'", *FOUND_ALL),
)
register(
    "confidence_static",
    lambda s, d: scan_stage(s, d, fx.document_files(s, d), CORPUS).where("rule_id <> 'SEC-TOKEN'").groupBy("rule_id", "confidence").agg(F.count(F.lit(1)).alias("n")),
    sql("files", "SELECT rule_id, confidence, count(*) AS n FROM found WHERE rule_id <> 'SEC-TOKEN' GROUP BY ALL", *FOUND_ALL),
)
DEDUP_SQL = (
    f"scored AS (SELECT *, {SCORE} + {_ctx_sql()} AS score FROM found)",
    f"routed AS (SELECT *, score <= 0 AS suppressed, {EFFECTIVE} AS severity FROM scored)",
    f"""uniq AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, line, rule_id ORDER BY taint_source IS NULL, {RANK}, rule_rank, off) AS n
  FROM routed WHERE NOT suppressed)""",
    f"""kept AS (SELECT * FROM (SELECT *, min({RANK}) OVER (PARTITION BY repo_id, path, line ORDER BY taint_source IS NULL, {RANK}, rule_rank, off
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM uniq WHERE n = 1) WHERE {RANK} <= coalesce(best, 99))""",
)
ACTIVE = ["repo_id", "path", "line", "rule_id", "category", "base_severity", "severity", "confidence", "finding_id", "code_hash"]


def scan_findings(s, d):
    routed = sev.apply_context(scan_stage(s, d, fx.document_files(s, d), CORPUS))
    return sev.dedup_active(sev.split_routes(routed)[0]).select(*ACTIVE)


register("scan_findings", scan_findings, sql("files", "SELECT " + ", ".join(ACTIVE) + " FROM kept", *FOUND_ALL, *DEDUP_SQL))

CODE_HITS = _rule_hits_sql(CODE_RULES, "code_files", "hits")
SINKS_ALL = tuple(x.replace(f" AND regexp_matches(raw, {q(SINK_WORDS)})", "") for x in SINK_SQL)
STRAT = "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN '{r.taint_extract}'" for r in CODE_RULES if r.taint_aware) + " END"
CODE_FOUND = (
    "spread AS (SELECT repo_id, path, content FROM code_files)", *CLASSIFY[1:2],
    *[x.replace("kinds", "pkinds") for x in CLASSIFY[2:]], *COMMENT_SQL, *TAINT_SQL, CODE_HITS,
    f"sinks0 AS (SELECT h.repo_id, h.path, h.line, h.raw, h.rule_id, h.rule_rank, h.off, {STRAT} AS strategy FROM hits h)",
    SINK_SQL[1],
    SINK_SQL[2].replace("SELECT repo_id, path, line, raw,", "SELECT repo_id, path, line, raw, rule_id, rule_rank, off, strategy,"),
    "crulemeta(rule_id, base_severity, taint_aware) AS (VALUES " + ", ".join(f"('{r.id}', '{r.severity}', {str(r.taint_aware).lower()})" for r in CODE_RULES) + ")",
    """cfound AS (SELECT s.*, base_severity, taint_aware, file_type, framework, coalesce(r.line, w.line) AS tline,
  CASE WHEN taint_aware THEN CASE WHEN r.line IS NOT NULL THEN r.source ELSE 'extract()' END END AS tsource
  FROM sinks s JOIN crulemeta USING (rule_id) JOIN classified c ON s.repo_id = c.repo_id AND s.path = c.path
  JOIN kinds k ON s.repo_id = k.repo_id AND s.path = k.path AND s.line = k.line
  JOIN code_files f ON s.repo_id = f.repo_id AND s.path = f.path
  LEFT JOIN register r ON s.repo_id = r.repo_id AND s.path = r.path AND s.variable = r.var
  LEFT JOIN register w ON s.repo_id = w.repo_id AND s.path = w.path AND w.var = '*'
  WHERE scan_context = 'source' AND k.kind <> 'COMMENT' AND (NOT taint_aware OR (variable IS NOT NULL AND coalesce(r.line, w.line) IS NOT NULL))
  AND NOT (rule_id = 'C-CALL' AND regexp_matches(substr(f.content, greatest(off - 10, 0) + 1, least(off, 10) + 60), '(?i)y = 2')))""",
)
CODE_COLS = ["repo_id", "path", "rule_id", "line", "off", "base_severity"]


def _code_scan(s, d):
    out = scan_stage(s, d, fx.code_files(s, d), CODE_RULES)
    return out.select(*CODE_COLS, F.col("taint_source.variable").alias("tvar"), F.col("taint_source.line").alias("tline"), F.col("taint_source.source").alias("tsource"))


register(
    "scan_code", _code_scan,
    sql("code_files", "SELECT " + ", ".join(CODE_COLS) + ", CASE WHEN taint_aware THEN variable END AS tvar, CASE WHEN taint_aware THEN tline END AS tline, tsource FROM cfound", *CODE_FOUND),
)
register(
    "scan_mode_fast",
    lambda s, d: scan_stage(s, d, fx.code_files(s, d), CODE_RULES, mode="fast").select(*CODE_COLS),
    sql("code_files", "SELECT " + ", ".join(CODE_COLS) + " FROM cfound WHERE NOT taint_aware", *CODE_FOUND),
)


def _large(s, d):
    big = fx.document_files(s, d).withColumn("content", F.when(F.length("content") > 20000, F.repeat("content", 30)).otherwise(F.col("content")))
    routes = big.select("repo_id", "path", mt.is_large(F.length("content")).alias("is_large"))
    found = scan_stage(s, d, big, CORPUS).groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("findings"))
    return routes.join(found, ["repo_id", "path"], "left").where("is_large").select("repo_id", "path", F.coalesce("findings", F.lit(0)).alias("findings"))


register("scan_large_files", _large)
register(
    "coverage",
    lambda s, d: mt.coverage(cl.classify_files(both(s, d))),
    sql("files code_files", "SELECT DISTINCT repo_id, path, 'all' AS rule_domain FROM classified WHERE scan_context = 'source'",
        "spread AS (SELECT repo_id, path, content FROM files UNION ALL SELECT repo_id, path, content FROM code_files)", *CLASSIFY[1:]),
)

# ------------------------------------------------------------------ identity
register(
    "finding_id",
    lambda s, d: fx.line_findings(s, d).select("repo_id", "path", "rule_id", "off", idn.finding_id(F.col("rule_id"), F.col("path"), F.col("raw")).alias("finding_id")),
    sql("line_findings", "SELECT repo_id, path, rule_id, off, 'f-' || substring(sha256(rule_id || '|' || path || '|' || raw), 1, 10) AS finding_id FROM line_findings"),
)
register(
    "code_hash",
    lambda s, d: fx.document_files(s, d).select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("line", "l")).select("repo_id", "path", "line", idn.code_hash(F.col("l")).alias("code_hash")),
    sql("files", "SELECT repo_id, path, line, CASE WHEN l <> '' THEN substring(sha256(l), 1, 32) END AS code_hash FROM (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line FROM files)"),
)
register(
    "legacy_line_hash",
    lambda s, d: fx.code_files(s, d).select("repo_id", "path", idn.legacy_line_hash(F.col("content")).alias("line_hash")),
    sql("code_files", """SELECT repo_id, path, 'sha256:' || substring(sha256(replace(regexp_replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '"', '''')), 1, 16) AS line_hash FROM code_files"""),
)
REMOTES = "CASE s_suppkey % 8 WHEN 0 THEN 'git@Host.COM:' || n WHEN 1 THEN 'https://user@Host.com:8443/' || n || '.git' WHEN 2 THEN 'ssh://git@HOST.com/' || n || '/' WHEN 3 THEN '/srv/git/' || n WHEN 4 THEN 'https://host.com/' || n || '.GIT' WHEN 5 THEN 'host.com:' || n || '.git' WHEN 6 THEN '  https://host.com/' || n || '  ' ELSE n END"


def remotes(s, d):
    base = fx.table(s, d, "supplier").withColumn("n", F.concat(F.lit("Own"), (F.col("s_suppkey") % 9).cast("string"), F.lit("/"), F.translate("s_name", "#", "-")))
    return base.select("s_suppkey", F.expr(REMOTES).alias("remote"))


REMOTES_SQL = f"remotes AS (SELECT s_suppkey, {REMOTES} AS remote FROM (SELECT *, 'Own' || (s_suppkey % 9) || '/' || replace(s_name, '#', '-') AS n FROM supplier))"
CANON_SQL = (
    "raws AS (SELECT *, trim(remote) AS raw FROM remotes)",
    r"""canon AS (SELECT *, CASE WHEN regexp_matches(raw, '(?i)^[a-z][a-z0-9+.-]*://(?:[^@/]+@)?([^/:]+)(?::[0-9]+)?/(.+)$')
  THEN lower(regexp_extract(raw, '(?i)^[a-z][a-z0-9+.-]*://(?:[^@/]+@)?([^/:]+)', 1)) || '/' || regexp_replace(regexp_replace(regexp_extract(raw, '(?i)^[a-z][a-z0-9+.-]*://[^/]+/(.+)$', 1), '/+$', ''), '(?i)\.git$', '')
  WHEN NOT regexp_matches(raw, '(?i)^[a-z][a-z0-9+.-]*://') AND regexp_matches(raw, '^(?:[^@/]+@)?([^/:]+):(.+)$')
  THEN lower(regexp_extract(raw, '^(?:[^@/]+@)?([^/:]+):', 1)) || '/' || regexp_replace(regexp_replace(regexp_extract(raw, ':(.+)$', 1), '/+$', ''), '(?i)\.git$', '')
  ELSE raw END AS canonical FROM raws)""",
)
register(
    "repo_id",
    lambda s, d: remotes(s, d).select("s_suppkey", idn.canonical_remote(F.col("remote")).alias("canonical"), idn.repo_id(F.col("remote")).alias("repo_id")),
    sql("", f"WITH {REMOTES_SQL}, " + ", ".join(CANON_SQL) + " SELECT s_suppkey, canonical, substring(sha256(canonical), 1, 16) AS repo_id FROM canon"),
)

# ------------------------------------------------------------------ severity, policy
CTX = lambda s, d: sev.apply_context(fx.line_findings(s, d))
LSCORED = (f"scored AS (SELECT *, {SCORE} + {_ctx_sql()} AS score FROM line_findings)", *DEDUP_SQL[1:])
LKEY = ["repo_id", "path", "line", "rule_id", "off"]
register(
    "ctx_modifiers",
    lambda s, d: fx.line_findings(s, d).withColumn("modifiers", sev.context_modifiers(F.col("path"), F.col("file_type"), F.col("framework"))).select(
        *LKEY, sev.modifier_sum(F.col("modifiers")).cast("bigint").alias("total"), F.size("modifiers").cast("bigint").alias("n")),
    sql("line_findings", f"SELECT repo_id, path, line, rule_id, off, {_ctx_sql()} AS total, " +
        "CAST(file_type IN ('fixture', 'vendor', 'generated', 'test', 'docs') AS INT) + " + " + ".join(f"CAST(contains('/' || path, '{k}') AS INT)" for k in sev.SEGMENT_MODIFIERS) + " + CASE WHEN framework IS NOT NULL THEN 1 ELSE 0 END AS n FROM line_findings"),
)
register(
    "ctx_effective", lambda s, d: CTX(s, d).select(*LKEY, F.col("score").cast("bigint").alias("score"), "severity", "suppressed"),
    sql("line_findings", "SELECT repo_id, path, line, rule_id, off, score, severity, suppressed FROM routed", *LSCORED[:2]),
)


def _route(s, d):
    return sev.route(CTX(s, d)).select(*LKEY, "route", "suppress_reason")


register(
    "ctx_route", _route,
    sql("line_findings", f"SELECT repo_id, path, line, rule_id, off, CASE WHEN suppressed THEN 'suppressed' ELSE 'active' END AS route, CASE WHEN suppressed THEN '{sev.SUPPRESS_REASON}' END AS suppress_reason FROM routed", *LSCORED[:2]),
)
register(
    "ctx_trace",
    lambda s, d: sev.apply_context(fx.line_findings(s, d).withColumns({"scan_context": cl.scan_context(F.col("file_type")), "line_type": F.lit("CODE")}), trace=True).select(
        *LKEY, F.col("trace.manifest_context").alias("manifest_context"), F.col("trace.base_score").cast("bigint").alias("base_score"),
        F.col("trace.total_modifier").cast("bigint").alias("total_modifier"), F.col("trace.final_severity").alias("final_severity")),
    sql("line_findings", f"""SELECT repo_id, path, line, rule_id, off, CASE WHEN file_type IN ('vendor', 'generated') THEN 'excluded' WHEN file_type IN ('test', 'fixture') THEN 'test' ELSE 'source' END AS manifest_context,
    {SCORE} AS base_score, {_ctx_sql()} AS total_modifier, severity AS final_severity FROM routed""", *LSCORED[:2]),
)
SECRET_RULES = [rl.to_rule({**CORPUS_RAW[0], "id": "SECRET-001", "scan_comments": True, "antipattern": None, "confidence_rules": None}, "secrets", 0)]


def _secrets(s, d):
    routed = sev.apply_context(scan_stage(s, d, fx.document_files(s, d), SECRET_RULES))
    return routed.select("repo_id", "path", "line", "off", "scan_context", "severity", "suppressed")


register(
    "secrets_route", _secrets,
    sql("files", f"SELECT repo_id, path, line, off, scan_context, severity, suppressed FROM (SELECT *, score <= 0 AS suppressed, {EFFECTIVE} AS severity FROM (SELECT h.repo_id, h.path, h.line, h.off, scan_context, 4 + {_ctx_sql('h.path')} AS score FROM hits h JOIN classified c ON h.repo_id = c.repo_id AND h.path = c.path WHERE rule_id = 'SEC-TOKEN'))",
        "spread AS (SELECT repo_id, path, content FROM files)", *CLASSIFY[1:], HITS),
)
DCOLS = ["repo_id", "path", "line", "rule_id", "off", "severity", "taint_source"]
register(
    "dedup_active", lambda s, d: sev.dedup_active(sev.split_routes(CTX(s, d))[0]).select(*DCOLS),
    sql("line_findings", "SELECT " + ", ".join(DCOLS) + " FROM kept", *LSCORED),
)
register(
    "dedup_suppressed", lambda s, d: sev.dedup_suppressed(sev.split_routes(CTX(s, d))[1]).select(*DCOLS),
    sql("line_findings", "SELECT " + ", ".join(DCOLS) + " FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, line, rule_id ORDER BY rule_rank, off) AS n FROM routed WHERE suppressed) WHERE n = 1", *LSCORED[:2]),
)


def policy_rows(s, d):
    n = F.col("n_nationkey")
    return fx.table(s, d, "nation").select(
        F.concat(F.lit("r"), n.cast("string")).alias("repo_id"), (n % 3 != 0).alias("block_on_critical"), (n % 2 == 0).alias("block_on_high"),
        F.array(F.concat(F.lit("R"), (n % 12).cast("string"))).alias("locked_rules"))


def override_rows(s, d):
    k = F.col("p_partkey")
    return fx.table(s, d, "part").where(k % 7 == 0).select(
        F.concat(F.lit("r"), (k % 20).cast("string")).alias("repo_id"), F.concat(F.lit("R"), (k % 12).cast("string")).alias("rule_id"),
    ).distinct().withColumn("action", F.lit("educate"))


POLICY_SQL = (
    "pol AS (SELECT 'r' || n_nationkey AS repo_id, n_nationkey % 3 <> 0 AS bc, n_nationkey % 2 = 0 AS bh, 'R' || (n_nationkey % 12) AS locked FROM nation)",
    "ovr AS (SELECT DISTINCT 'r' || (p_partkey % 20) AS repo_id, 'R' || (p_partkey % 12) AS rule_id, 'educate' AS action FROM part WHERE p_partkey % 7 = 0)",
    """acts AS (SELECT f.*, CASE WHEN rule_id = locked THEN 'block' WHEN o.action IS NOT NULL THEN o.action
  WHEN base_severity = 'CRITICAL' AND coalesce(bc, true) THEN 'block' WHEN base_severity = 'HIGH' AND coalesce(bh, true) THEN 'block' ELSE 'warn' END AS action
  FROM line_findings f LEFT JOIN pol USING (repo_id) LEFT JOIN ovr o USING (repo_id, rule_id))""",
)
ACTIONED = lambda s, d: sev.rule_action(fx.line_findings(s, d), policy_rows(s, d), override_rows(s, d))
register("rule_action", lambda s, d: ACTIONED(s, d).select(*LKEY, "action"), sql("line_findings", "SELECT repo_id, path, line, rule_id, off, action FROM acts", *POLICY_SQL))
register(
    "rule_action_noconfig", lambda s, d: fx.line_findings(s, d).select(*LKEY, sev.rule_action_noconfig(F.col("base_severity")).alias("action")),
    sql("line_findings", "SELECT repo_id, path, line, rule_id, off, CASE base_severity WHEN 'CRITICAL' THEN 'block' WHEN 'EXPOSURE' THEN 'educate' ELSE 'warn' END AS action FROM line_findings"),
)


def _policy(s, d):
    n = F.col("n_nationkey")
    repos = fx.table(s, d, "nation").select(F.concat(F.lit("r"), n.cast("string")).alias("repo_id"), n)
    glob = s.createDataFrame([("scan_mode", "fast"), ("deep_delay_ms", "50")], "key string, value string")
    own = repos.where(n % 4 == 0).select("repo_id", F.lit("block_on_high").alias("key"), F.lit("false").alias("value")).unionByName(
        repos.where(n % 5 == 0).select("repo_id", F.lit("scan_mode").alias("key"), F.lit("full").alias("value")))
    locked = sev.locked_rules(repos, repos.where(n % 2 == 0).select("repo_id", F.concat(F.lit("A-"), n.cast("string")).alias("rule_id")))
    pol = sev.effective_policy(repos, glob, own)
    return pol.unionByName(locked.select("repo_id", F.lit("locked_rules").alias("key"), F.array_join("locked_rules", ",").alias("value"), F.lit("union").alias("origin")))


register(
    "policy_config", _policy,
    """WITH g(key, value) AS (VALUES ('scan_mode', 'fast'), ('deep_delay_ms', '50')),
    dflt(key, dv) AS (VALUES ('trust_level', 'balanced'), ('block_on_critical', 'true'), ('block_on_high', 'true'), ('scan_mode', 'full'), ('deep_delay_ms', '0')),
    own AS (SELECT 'r' || n_nationkey AS repo_id, 'block_on_high' AS key, 'false' AS value FROM nation WHERE n_nationkey % 4 = 0
      UNION ALL SELECT 'r' || n_nationkey, 'scan_mode', 'full' FROM nation WHERE n_nationkey % 5 = 0)
    SELECT r.repo_id, dflt.key, coalesce(own.value, g.value, dv) AS value,
      CASE WHEN own.value IS NOT NULL THEN 'repo' WHEN g.value IS NOT NULL THEN 'global' ELSE 'default' END AS origin
    FROM (SELECT 'r' || n_nationkey AS repo_id FROM nation) r CROSS JOIN dflt LEFT JOIN g ON g.key = dflt.key LEFT JOIN own ON own.key = dflt.key AND own.repo_id = r.repo_id
    UNION ALL SELECT 'r' || n_nationkey, 'locked_rules', CASE WHEN n_nationkey % 2 = 0 THEN 'A-' || n_nationkey || ',' ELSE '' END || 'JWT-001,SECRET-001,SECRET-002,SECRET-003,SECRET-006,SECRET-007', 'union' FROM nation""",
)
register(
    "sev_dim",
    lambda s, d: fx.line_findings(s, d).groupBy("base_severity").agg(F.count(F.lit(1)).alias("n")).select("base_severity", "n", sv.rank(F.col("base_severity")).cast("bigint").alias("rank"), sv.weight(F.col("base_severity")).cast("bigint").alias("weight")),
    sql("line_findings", """SELECT base_severity, count(*) AS n, CASE base_severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'EXPOSURE' THEN 3 WHEN 'INFO' THEN 4 ELSE 9 END AS rank,
    CASE base_severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 2 WHEN 'EXPOSURE' THEN 1 ELSE 0 END AS weight FROM line_findings GROUP BY 1"""),
)
register(
    "scan_blocked", lambda s, d: sev.scan_blocked(ACTIONED(s, d).withColumn("excepted", F.col("off") % 3 != 0)),
    sql("line_findings", "SELECT repo_id, bool_or(action = 'block' AND off % 3 = 0) AS blocked FROM acts GROUP BY 1", *POLICY_SQL),
)
register(
    "find_filter", lambda s, d: sev.filter_findings(CTX(s, d), severity="high", rule="r5").select(*LKEY, "severity"),
    sql("line_findings", "SELECT repo_id, path, line, rule_id, off, severity FROM routed WHERE severity = 'HIGH' AND rule_id = 'R5'", *LSCORED[:2]),
)
register(
    "find_top_k",
    lambda s, d: sev.top_k(fx.line_findings(s, d).select("repo_id", "path", "line", "rule_id", F.col("base_severity").alias("severity"), F.col("off").alias("finding_id")), 50),
    sql("line_findings", "SELECT repo_id, path, line, rule_id, base_severity AS severity, off AS finding_id FROM line_findings ORDER BY CASE base_severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'EXPOSURE' THEN 3 ELSE 4 END, repo_id, path, line, rule_id, finding_id LIMIT 50"),
)

# ------------------------------------------------------------------ rule applicability
APP_RULES = [
    rl.to_rule(dict(id=i, pattern="x", severity=sv_, **kw), pack, n)
    for n, (i, pack, sv_, kw) in enumerate([
        ("JS-A", "js", "HIGH", {}), ("JS-EXP", "js", "EXPOSURE", {}), ("TS-A", "ts", "HIGH", {}), ("TS-SUPPRESS-002", "ts", "MEDIUM", {}),
        ("PY-A", "python", "HIGH", {}), ("PY-EXP", "python", "EXPOSURE", {}), ("PHP-A", "php", "HIGH", {"exclude_file_types": ["php"]}),
        ("PHP-EXP", "php", "EXPOSURE", {"exclude_file_types": ["ts"]}), ("S-JSON", "sensitive", "HIGH", {"file_types": ["json", "log"]}),
        ("S-NAME", "sensitive", "HIGH", {"match_mode": "filename"}), ("I-ANY", "infra", "EXPOSURE", {}), ("I-JS", "infra", "EXPOSURE", {"extensions": ["js", "env"]}),
    ])
]
APP_EXTS = ["js", "ts", "py", "php", "json", "log", "env", "html", "cs", "sql", "sh", "xml", "ps1", "bat", "ini", "rb"]
APP_SQL = """app(ext, rule_id, rule_pass) AS (SELECT ext, rule_id, rule_pass FROM (VALUES ('js', ['JS-A']), ('ts', ['JS-A', 'TS-A', 'TS-SUPPRESS-002']), ('py', ['PY-A', 'PY-EXP']),
  ('php', ['PHP-EXP']), ('json', ['TS-SUPPRESS-002', 'S-JSON']), ('log', ['S-JSON'])) t(ext, rs), unnest(rs) u(rule_id), (SELECT 'set' AS rule_pass)
  UNION ALL SELECT ext, rule_id, 'exposure' FROM unnest(['js', 'ts', 'html', 'php', 'py']) e(ext), unnest(['JS-EXP', 'PY-EXP', 'PHP-EXP']) r(rule_id) WHERE NOT (ext = 'ts' AND rule_id = 'PHP-EXP')
  UNION ALL SELECT ext, 'I-ANY', 'infra' FROM unnest(['js', 'ts', 'py', 'php', 'json', 'log', 'env', 'html', 'cs', 'sql', 'sh', 'xml', 'ps1', 'bat', 'ini', 'rb']) e(ext)
  UNION ALL SELECT ext, 'I-JS', 'infra' FROM unnest(['js', 'env']) e(ext)
  UNION ALL SELECT ext, 'S-NAME', 'filename' FROM unnest(['js', 'ts', 'py', 'php', 'json', 'log', 'env', 'html', 'cs', 'sql', 'sh', 'xml', 'ps1', 'bat', 'ini', 'rb']) e(ext))"""


def _applicability(s, d):
    counts = both(s, d).groupBy(extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("files"))
    return counts.join(F.broadcast(rl.rules_by_ext(s, APP_RULES, APP_EXTS)), "ext").select("ext", "rule_id", "rule_pass", "files")


EXT_COUNTS = f"exts AS (SELECT {EXT} AS ext, count(*) AS files FROM all_files GROUP BY 1)"
register("rule_applicability", _applicability, sql("files code_files", "SELECT ext, rule_id, rule_pass, files FROM app JOIN exts USING (ext)", ALL_SQL, EXT_COUNTS, APP_SQL))
register("rule_exposure_pass", lambda s, d: _applicability(s, d).where("rule_pass = 'exposure'"),
         sql("files code_files", "SELECT ext, rule_id, rule_pass, files FROM app JOIN exts USING (ext) WHERE rule_pass = 'exposure'", ALL_SQL, EXT_COUNTS, APP_SQL))
NAME_RULES = [
    rl.to_rule(dict(id="N-LOG", pattern="\\.log$", match_mode="filename", severity="HIGH"), "sensitive", 0),
    rl.to_rule(dict(id="N-ENV", pattern="^f[0-9]*0\\.ENV$", match_mode="filename", severity="CRITICAL"), "sensitive", 1),
]
register(
    "rule_filename",
    lambda s, d: scan_stage(s, d, both(s, d), NAME_RULES).select("repo_id", "path", "rule_id", "line", "snippet", "base_severity"),
    sql("files code_files", """SELECT repo_id, path, rule_id, 0::BIGINT AS line, regexp_extract(path, '[^/]*$') AS snippet, base_severity FROM classified
    JOIN (VALUES ('N-LOG', '(?i)\\.log$', 'HIGH'), ('N-ENV', '(?i)^f[0-9]*0\\.ENV$', 'CRITICAL')) r(rule_id, rx, base_severity)
    ON regexp_matches(regexp_extract(path, '[^/]*$'), rx) WHERE scan_context = 'source'""",
        "spread AS (SELECT repo_id, path, content FROM files UNION ALL SELECT repo_id, path, content FROM code_files)", *CLASSIFY[1:]),
)

# ------------------------------------------------------------------ scope
SCOPE_ROWS = [
    ("g1", "docs/", "global", "noise", "ann", "2024-01-01"), ("g2", "**/*3.json", "global", "", "ann", None),
    ("r1", "src/f1?.js", "repo", "old", None, "2024-02-01"), ("r2", "lib/*2.py", "repo", "x", "bo", "2024-02-01"),
    ("s1", "config/f7.log", "server", "central", "root", "2024-03-01"), ("s2", "vendor", "server", None, None, None),
    ("o1", "fixtures/**", "once", "run", "me", "2024-04-01"), ("o2", "tests/f(1", "once", "bad", "me", "2024-04-01"),
]
SCOPE_SCHEMA = "entry string, pattern string, origin string, reason string, added_by string, added_at string"


def scope_entries(s):
    e = s.createDataFrame(SCOPE_ROWS, SCOPE_SCHEMA).withColumn("repo_id", F.lit(None).cast("string"))
    part = lambda o: e.where(F.col("origin") == o).drop("origin")
    return sc.load_scope(part("global"), part("repo"), part("server"), part("once"))


SCOPE_VALUES = "scope(entry, pattern, origin, reason, added_by, added_at) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else q(v) for v in r) + ")" for r in SCOPE_ROWS) + ")"
SCOPE_RX = ["^docs(?:$|/)", "^.*/[^/]*3\\.json$", "^src/f1[^/]\\.js$", "^lib/[^/]*2\\.py$", "^config/f7\\.log(?:$|/)", "^vendor(?:$|/)", "^fixtures/.*$", "^tests/f\\(1(?:$|/)"]
SCOPE_RX_SQL = "rx(o, pattern, regex) AS (VALUES " + ", ".join(f"({i}, {q(r[1])}, {q(x)})" for i, (r, x) in enumerate(zip(SCOPE_ROWS, SCOPE_RX))) + ")"
FIRST_RX = "firsts AS (SELECT repo_id, path, min_by(pattern, o) AS excluded_by FROM all_files JOIN rx ON regexp_matches(path, regex) GROUP BY ALL)"
register(
    "scope_load", lambda s, d: scope_entries(s).crossJoin(both(s, d).agg(F.count(F.lit(1)).alias("files"))).select("entry", "pattern", "origin", "files"),
    sql("files code_files", "SELECT entry, pattern, origin, (SELECT count(*) FROM all_files) AS files FROM scope", ALL_SQL, SCOPE_VALUES),
)


def _scope_glob(s, d):
    files = both(s, d).select("repo_id", "path")
    names = [r[0] for r in SCOPE_ROWS]
    hits = sc.pattern_hits(files, scope_entries(s)).groupBy("repo_id").pivot("entry", names).agg(F.count(F.lit(1)))
    return files.select("repo_id").distinct().join(hits, "repo_id", "left").na.fill(0, names)


register(
    "scope_glob", _scope_glob,
    sql("files code_files", "SELECT repo_id, " + ", ".join(f"count(*) FILTER (regexp_matches(path, {q(x)})) AS {r[0]}" for r, x in zip(SCOPE_ROWS, SCOPE_RX)) + " FROM all_files GROUP BY 1", ALL_SQL),
)
register(
    "scope_files", lambda s, d: sc.match_scope(both(s, d), scope_entries(s)).select("repo_id", "path", "excluded_by"),
    sql("files code_files", "SELECT repo_id, path, excluded_by FROM all_files LEFT JOIN firsts USING (repo_id, path)", ALL_SQL, SCOPE_RX_SQL, FIRST_RX),
)
RULE_SCOPE = [("R1", None, "repo", "a", "b", "2024"), ("R2", ["docs/", "src/o1*"], "server", None, "b", "2024"), ("R2", ["lib/**"], "repo", "z", "b", "2024"), ("R99", ["x"], "global", "z", "b", "2024")]
RULE_SCOPE_SCHEMA = "rule_id string, globs array<string>, origin string, reason string, added_by string, added_at string"
RULE_OUT = "(rule_id = 'R1' OR (rule_id = 'R2' AND (regexp_matches(path, '^docs(?:$|/)') OR regexp_matches(path, '^src/o1[^/]*$') OR regexp_matches(path, '^lib/.*$'))))"


def _scope_rules(s, d):
    rest, counts = sc.exclude_rules(fx.line_findings(s, d), s.createDataFrame(RULE_SCOPE, RULE_SCOPE_SCHEMA))
    return rest.groupBy("rule_id").agg(F.count(F.lit(1)).alias("kept")).join(counts, "rule_id", "full_outer").select("rule_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("findings_excluded", F.lit(0)).alias("excluded"))


register("scope_rules", _scope_rules, sql("line_findings", f"SELECT rule_id, count(*) FILTER (NOT {RULE_OUT}) AS kept, count(*) FILTER ({RULE_OUT}) AS excluded FROM line_findings GROUP BY 1"))


def _validate(s, d):
    used = sc.excluded_counts(both(s, d), scope_entries(s))
    bad = sc.validate_scope(scope_entries(s), "pattern").select("identifier", F.array_join("missing", ",").alias("missing"))
    return bad.join(used, bad["identifier"] == used["pattern"], "left").select("identifier", "missing", F.coalesce("files_excluded", F.lit(0)).alias("files_excluded"))


register(
    "scope_validate", _validate,
    sql("files code_files", """SELECT pattern AS identifier, array_to_string(list_filter([CASE WHEN coalesce(reason, '') = '' THEN 'reason' END, CASE WHEN coalesce(added_by, '') = '' THEN 'added_by' END,
    CASE WHEN coalesce(added_at, '') = '' THEN 'added_at' END], lambda x: x IS NOT NULL), ',') AS missing, coalesce(n, 0) AS files_excluded FROM scope LEFT JOIN (SELECT excluded_by, count(*) AS n FROM firsts GROUP BY 1) ON excluded_by = pattern
    WHERE coalesce(reason, '') = '' OR coalesce(added_by, '') = '' OR coalesce(added_at, '') = ''""", ALL_SQL, SCOPE_VALUES, SCOPE_RX_SQL, FIRST_RX),
)


def _summary(s, d):
    rules = s.createDataFrame(RULE_SCOPE, RULE_SCOPE_SCHEMA)
    return sc.exclusion_summary(scope_entries(s), sc.excluded_counts(both(s, d), scope_entries(s)), rules, sc.exclude_rules(fx.line_findings(s, d), rules)[1])


RULE_SCOPE_SQL = "rscope(rule_id, origin, reason, added_by, added_at) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else q(v) for v in (r[0], *r[2:])) + ")" for r in RULE_SCOPE) + ")"
register(
    "scope_exclusion_summary", _summary,
    sql("files code_files line_findings", f"""SELECT 'file' AS kind, pattern AS target, coalesce(n, 0) AS removed, origin, reason, added_by, added_at FROM scope LEFT JOIN (SELECT excluded_by, count(*) AS n FROM firsts GROUP BY 1) ON excluded_by = pattern
    UNION ALL SELECT 'rule', rule_id, coalesce(n, 0), origin, reason, added_by, added_at FROM rscope LEFT JOIN (SELECT rule_id, count(*) AS n FROM line_findings WHERE {RULE_OUT} GROUP BY 1) USING (rule_id)""",
        ALL_SQL, SCOPE_VALUES, SCOPE_RX_SQL, FIRST_RX, RULE_SCOPE_SQL),
)
register(
    "scope_publishable", lambda s, d: sc.publishable(_summary(s, d)).select("kind", "target", "removed"),
    sql("files code_files line_findings", f"""SELECT 'file' AS kind, pattern AS target, coalesce(n, 0) AS removed FROM scope LEFT JOIN (SELECT excluded_by, count(*) AS n FROM firsts GROUP BY 1) ON excluded_by = pattern WHERE origin <> 'server'
    UNION ALL SELECT 'rule', rule_id, coalesce(n, 0) FROM rscope LEFT JOIN (SELECT rule_id, count(*) AS n FROM line_findings WHERE {RULE_OUT} GROUP BY 1) USING (rule_id) WHERE origin <> 'server'""",
        ALL_SQL, SCOPE_VALUES, SCOPE_RX_SQL, FIRST_RX, RULE_SCOPE_SQL),
)
