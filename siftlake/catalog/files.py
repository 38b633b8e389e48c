"""Sources, file selection and classification."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftlake.catalog import fixtures as fx
from siftlake.catalog.fixtures import sql
from siftlake.functions.paths import extension, norm_path
from siftlake.operators import classify as cl
from siftlake.session import checkpoint_dir
from siftlake.sources import digests as dg, files as src

QUERIES, ORACLE = {}, {}


def register(key, fn, text=None):
    QUERIES[key] = fn
    if text:
        ORACLE[key] = text


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PATHS = ["repo_id", "path"]
EXT = "lower(regexp_extract(path, '[^.]*$'))"
both = lambda s, d: fx.document_files(s, d).unionByName(fx.code_files(s, d))
ALL_SQL = "all_files AS (SELECT repo_id, path, content FROM files UNION ALL SELECT repo_id, path, content FROM code_files)"

register(
    "src_ext_filter",
    lambda s, d: src.keep_supported(both(s, d), extra=False).select(*PATHS),
    sql("files code_files", f"SELECT repo_id, path FROM all_files WHERE {EXT} IN {_in(src.SUPPORTED_EXTENSIONS)}", ALL_SQL),
)
register(
    "src_lang_filter",
    lambda s, d: src.keep_language(both(s, d), "secrets").unionByName(src.keep_language(both(s, d), "aspnet")).select(*PATHS),
    sql("files code_files", f"SELECT repo_id, path FROM all_files WHERE {EXT} IN ('env','pem','key','pfx','p12','sqlite','sqlite3','db','bak','aspx','ascx','master','config','cs')", ALL_SQL),
)
register(
    "src_ignored_dirs",
    lambda s, d: src.drop_ignored_dirs(fx.document_files(s, d)).select(*PATHS),
    sql("files", f"""SELECT repo_id, path FROM files WHERE NOT list_has_any(string_split(path, '/'), {fx._sql_list(src.IGNORED_DIRS)})
    AND NOT regexp_matches(path, '(^|/)\\.(?:[^/]*)(/|$)') """),
)
for mode in ("exclude", "only", "include"):
    cond = {"exclude": "WHERE NOT regexp_matches(path, %s)", "only": "WHERE regexp_matches(path, %s)", "include": ""}[mode]
    register(
        "src_vendor_filter" if mode == "exclude" else f"src_vendor_filter_{mode}",
        lambda s, d, mode=mode: src.vendor_filter(both(s, d), mode).select(*PATHS),
        sql("files code_files", "SELECT repo_id, path FROM all_files " + (cond % q(src.VENDOR_PATH) if cond else ""), ALL_SQL),
    )


def _size_guard(s, d):
    kept, skipped = src.size_guard(fx.document_files(s, d), max_kb=8)
    a = kept.select(*PATHS, F.lit("kept").alias("outcome"), "size_kb", F.lit(None).cast("bigint").alias("limit_kb"))
    return a.unionByName(skipped.withColumnRenamed("reason", "outcome"))


register(
    "src_size_guard", _size_guard,
    sql("files", """SELECT repo_id, path, CASE WHEN length(content) > 8192 THEN 'too_large' ELSE 'kept' END AS outcome,
    CAST(floor(length(content) / 1024 + 0.5) AS BIGINT) AS size_kb,
    CASE WHEN length(content) > 8192 THEN 8::BIGINT END AS limit_kb FROM files"""),
)
register(
    "src_glob",
    lambda s, d: src.glob_target(fx.document_files(s, d), "src/f1*.J?").unionByName(
        src.glob_target(fx.document_files(s, d), "web/page_**7.html")).select(*PATHS),
    sql("files", """SELECT repo_id, path FROM files WHERE regexp_matches(path, '(?i)^src/f1[^/]*\\.j[^/]$')
    OR (starts_with(path, 'web/') AND regexp_matches(path, '(?i)/page_.+7\\.html$'))"""),
)


def _multi(s, d):
    f = fx.document_files(s, d)
    tag = lambda t, v: t.withColumn("content", F.concat(F.lit(v), F.col("content")))
    a = tag(f.where(F.col("path").startswith("src/")), "a:")
    b = tag(f.where(F.col("path").endswith(".js")), "b:")
    return src.union_targets([a, b]).select(*PATHS, F.substring("content", 1, 2).alias("taken"))


register(
    "src_multi_target", _multi,
    sql("files", """SELECT repo_id, path, CASE WHEN starts_with(path, 'src/') THEN 'a:' ELSE 'b:' END AS taken
    FROM files WHERE starts_with(path, 'src/') OR ends_with(path, '.js')"""),
)


def _changed(s, d):
    cur = fx.document_files(s, d)
    n = F.length("content")
    base = cur.where(n % 5 != 0).withColumn("content", F.when(n % 3 == 0, F.lit("old")).otherwise(F.col("content")))
    return src.changed_files(base, cur).select(*PATHS)


register(
    "src_changed_files", _changed,
    sql("files", """SELECT repo_id, path FROM files f WHERE NOT contains(path, 'dist/')
    AND (length(content) % 5 = 0 OR (length(content) % 3 = 0 AND content <> 'old'))"""),
)


def _tree_changes(s, d):
    """Two stored states of the same files, compared by their digest trees."""
    base = f"{checkpoint_dir(s)}/siftlake-trees-{uuid.uuid4().hex}"
    n = F.length("content")
    new = fx.document_files(s, d)
    old = new.where(n % 50 != 7).withColumn("content", F.when(n % 60 == 3, F.lit("old")).otherwise(F.col("content")))
    dg.write_digests(old, f"{base}/old")
    dg.write_digests(new.where(n % 70 != 5), f"{base}/new")
    return dg.changed_paths(s, f"{base}/old", f"{base}/new")


register(
    "src_tree_changes", _tree_changes,
    sql("files", """SELECT repo_id, path, CASE WHEN length(content) % 50 = 7 THEN 'new' WHEN length(content) % 70 = 5 THEN 'gone' ELSE 'changed' END AS change FROM files
    WHERE (length(content) % 50 = 7) <> (length(content) % 70 = 5) OR (length(content) % 60 = 3 AND content <> 'old' AND length(content) % 50 <> 7 AND length(content) % 70 <> 5)"""),
)
IGNORE_LINES = [
    ("", 0, 0, "# comment"), ("", 0, 1, "*.log"), ("", 0, 2, "/vendor/"), ("", 0, 3, "!f8?.log"),
    ("docs", 1, 0, "f1*"), ("docs", 1, 1, "!f1?4.js"), ("", 0, 4, "**/page_1*.html"), ("", 0, 5, "dist/**/f2*.py"),
]


def _gitignore(s, d):
    f = fx.document_files(s, d)
    lines = s.createDataFrame(IGNORE_LINES, "dir string, dir_order int, rule_order int, line string")
    rules = f.select("repo_id").distinct().crossJoin(F.broadcast(lines))
    return src.apply_ignore(f, src.parse_ignore_lines(rules)).select(*PATHS)


register(
    "src_gitignore", _gitignore,
    sql("files", """SELECT repo_id, path FROM files LEFT JOIN hits USING (repo_id, path) WHERE coalesce(negated, true)""",
        """rules(o, dir, rx, negated) AS (VALUES (1, '', '(?:^|/)[^/]*\\.log(?:/|$)', false),
    (2, '', '^vendor(?:/|$)', false), (3, '', '(?:^|/)f8[^/]\\.log(?:/|$)', true), (4, '', '(?:^|/).*/page_1[^/]*\\.html(?:/|$)', false),
    (5, '', '(?:^|/)dist/.*/f2[^/]*\\.py(?:/|$)', false),
    (10, 'docs', '(?:^|/)f1[^/]*(?:/|$)', false), (11, 'docs', '(?:^|/)f1[^/]4\\.js(?:/|$)', true))""",
        """hits AS (SELECT repo_id, path, max_by(negated, o) AS negated FROM files JOIN rules
    ON (dir = '' OR starts_with(path, dir || '/'))
    AND regexp_matches(CASE WHEN dir = '' THEN path ELSE substring(path, length(dir) + 2) END, rx) GROUP BY ALL)"""),
)

# ---------------------------------------------------------------- classification
register(
    "file_norm_path",
    lambda s, d: both(s, d).select(*PATHS, norm_path(F.translate(F.upper("path"), "/", "\\")).alias("norm_path")),
    sql("files code_files", "SELECT repo_id, path, '/' || lower(path) AS norm_path FROM all_files", ALL_SQL),
)
register(
    "file_language",
    lambda s, d: cl.path_columns(both(s, d)).select(*PATHS, "language"),
    sql("files code_files", f"""SELECT repo_id, path, lang AS language FROM all_files LEFT JOIN langs ON langs.ext = {EXT}""", ALL_SQL,
        "langs(ext, lang) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in cl.LANGUAGE_BY_EXT.items()) + ")"),
)


def _has(segments) -> str:
    return "(" + " OR ".join(f"contains(p, '{x}')" for x in segments) + ")"


def _m(col, rx) -> str:
    return f"regexp_matches({col}, {q(rx)})"


SPREAD_DIRS = [
    "src", "tests/e2e", "fixtures", "vendor/a", "dist", "docs/api", "lib/mocks", "spec", "packages", "wiki", "cfg",
    "test",
]
SPREAD_NAMES = ["a.test.js", "test_a.py", "a_test.php", "x.js", ".env", "webpack.config.js", "a.min.js", "data.json",
                "ModelTest.php", "x.d.ts", "notes.md", "conf.yml", "plain.py"]


def spread_files(s, d):
    """Customers as files over many folders and names, some with test-framework text, some without text."""
    ck = F.col("c_custkey")
    text = (
        F.when(ck % 7 == 0, F.concat(F.lit("import pytest\n"), F.col("c_name")))
        .when(ck % 7 == 1, F.concat(F.lit("describe('x', () => {\n jest.fn()\n"), F.col("c_name")))
        .when(ck % 7 == 2, F.lit(""))
        .when(ck % 7 == 3, F.concat(F.lit("expect(x)\n"), F.col("c_name")))
        .when(ck % 7 == 4, F.concat(F.repeat(F.lit("line\n"), 55), F.lit("import pytest")))
        .when(ck % 7 == 5, F.concat(F.repeat(F.lit("line\n"), 49), F.lit("import unittest\n"), F.col("c_name")))
        .otherwise(F.col("c_name"))
    )
    return fx.table(s, d, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repo_id"),
        F.concat(fx._pick(SPREAD_DIRS, ck % len(SPREAD_DIRS)), F.lit("/"), ck.cast("string"), F.lit("/"),
                 fx._pick(SPREAD_NAMES, F.floor(ck / len(SPREAD_DIRS)) % len(SPREAD_NAMES))).alias("path"),
        text.alias("content"),
    )


SPREAD_SQL = f"""spread AS (SELECT 'n' || c_nationkey AS repo_id, ({fx._sql_list(SPREAD_DIRS)})[c_custkey % {len(SPREAD_DIRS)} + 1]
  || '/' || c_custkey || '/' || ({fx._sql_list(SPREAD_NAMES)})[(c_custkey // {len(SPREAD_DIRS)}) % {len(SPREAD_NAMES)} + 1] AS path,
  CASE c_custkey % 7 WHEN 0 THEN 'import pytest' || chr(10) || c_name
    WHEN 1 THEN 'describe(''x'', () => {{' || chr(10) || ' jest.fn()' || chr(10) || c_name WHEN 2 THEN ''
    WHEN 3 THEN 'expect(x)' || chr(10) || c_name
    WHEN 4 THEN repeat('line' || chr(10), 55) || 'import pytest'
    WHEN 5 THEN repeat('line' || chr(10), 49) || 'import unittest' || chr(10) || c_name ELSE c_name END AS content FROM customer
  UNION ALL SELECT repo_id, path, content FROM files UNION ALL SELECT repo_id, path, content FROM code_files)"""
BASIC_SQL = f"""basic AS (SELECT *, '/' || lower(path) AS p, lower(regexp_extract(path, '[^/]*$')) AS b, {EXT} AS ext FROM spread)"""
KIND_SQL = f"""kinds AS (SELECT *, CASE WHEN {_has(cl.VENDOR_SEGMENTS)} THEN 'vendor'
  WHEN {_has(cl.GENERATED_SEGMENTS)} OR {_m('b', cl.GENERATED_NAME)} THEN 'generated'
  WHEN {_has(cl.FIXTURE_SEGMENTS)} THEN 'fixture?path'
  WHEN {_m('b', cl.STRONG_TEST_NAME)} AND {_has(cl.TEST_SEGMENTS)} THEN 'test'
  WHEN {_m('b', cl.TEST_NAME)} THEN 'test?name' WHEN {_has(cl.TEST_SEGMENTS)} THEN 'test?path'
  WHEN {_m('b', cl.CONFIG_NAME)} THEN 'config' WHEN {_has(cl.DOCS_SEGMENTS)} THEN 'docs?path' END AS kind FROM basic)"""
TYPES_SQL = f"""ptypes AS (SELECT *, kind LIKE '%?%' AND ext IN {_in(cl.DATA_EXTENSIONS)} AS committed,
  CASE WHEN kind NOT LIKE '%?%' OR ext IN {_in(cl.DATA_EXTENSIONS)} THEN split_part(kind, '?', 1) END AS definitive,
  CASE WHEN kind LIKE '%?%' AND ext NOT IN {_in(cl.DATA_EXTENSIONS)} THEN split_part(kind, '?', 1) END AS tentative,
  coalesce(kind LIKE '%?path', false) AS tentative_is_path FROM kinds)"""
SIGNALS_SQL = f"""sig AS (SELECT *, CASE {' '.join(f"WHEN {_m('head', rx)} THEN '{name}'" for name, rx, _ in cl.FRAMEWORK_SIGNALS)} END AS named,
  {_m('head', cl.GENERIC_SIGNAL)} AS generic FROM (SELECT *, content AS head FROM ptypes))"""
FINAL_SQL = """classified AS (SELECT *, CASE WHEN file_type IN ('vendor', 'generated') THEN 'excluded'
  WHEN file_type IN ('test', 'fixture') THEN 'test' ELSE 'source' END AS scan_context FROM (SELECT *,
  CASE WHEN definitive IS NOT NULL THEN definitive
    WHEN content <> '' AND (named IS NOT NULL OR generic) THEN coalesce(tentative, 'test')
    WHEN content = '' AND tentative_is_path AND tentative IS NOT NULL THEN tentative ELSE 'source' END AS file_type,
  CASE WHEN content <> '' AND (definitive IS NULL OR definitive = 'test') THEN named END AS framework FROM sig))"""
CLASSIFY = (SPREAD_SQL, BASIC_SQL, KIND_SQL, TYPES_SQL, SIGNALS_SQL, FINAL_SQL)


def spread(s, d):
    return src.balanced(spread_files(s, d).unionByName(both(s, d)))


register(
    "file_type_path",
    lambda s, d: cl.path_type_columns(cl.path_columns(spread(s, d))).select(*PATHS, "definitive", "tentative", "tentative_is_path"),
    sql("files code_files", "SELECT repo_id, path, definitive, tentative, tentative_is_path FROM ptypes", *CLASSIFY[:4]),
)
register(
    "file_type_data_ext",
    lambda s, d: cl.path_type_columns(cl.path_columns(spread(s, d))).where("data_commit").select(*PATHS, "definitive"),
    sql("files code_files", "SELECT repo_id, path, definitive FROM ptypes WHERE committed", *CLASSIFY[:4]),
)
register(
    "file_framework",
    lambda s, d: cl.signal_columns(spread(s, d)).select(*PATHS, F.col("named_signal").alias("framework"), "any_signal"),
    sql("files code_files", "SELECT repo_id, path, named AS framework, coalesce(named IS NOT NULL OR generic, false) AS any_signal FROM sig", *CLASSIFY[:5]),
)
register(
    "file_type_final",
    lambda s, d: cl.classify_files(spread(s, d)).select(*PATHS, "file_type", "framework"),
    sql("files code_files", "SELECT repo_id, path, file_type, framework FROM classified", *CLASSIFY),
)
register(
    "file_signals",
    lambda s, d: cl.classify_files(spread(s, d)).select(*PATHS, F.array_join("signals", "; ").alias("signals")),
    sql("files code_files", """SELECT repo_id, path, array_to_string(list_filter([
    CASE WHEN definitive IS NOT NULL THEN 'path: ' || definitive END,
    CASE WHEN committed THEN 'data extension: committed without content' END,
    CASE WHEN framework IS NOT NULL THEN 'content: framework=' || framework END,
    CASE WHEN definitive IS NULL AND content <> '' AND (named IS NOT NULL OR generic) THEN coalesce('confirmed: ' || tentative, 'content: test signal') END,
    CASE WHEN definitive IS NULL AND tentative IS NOT NULL AND content <> '' AND named IS NULL AND NOT generic THEN 'not confirmed: ' || tentative END,
    CASE WHEN definitive IS NULL AND tentative IS NOT NULL AND content = '' AND tentative_is_path THEN 'no content: ' || tentative END],
    lambda x: x IS NOT NULL), '; ') AS signals FROM classified""", *CLASSIFY),
)
register(
    "file_manifest",
    lambda s, d: cl.classify_files(spread(s, d)).select(*PATHS, "scan_context"),
    sql("files code_files", "SELECT repo_id, path, scan_context FROM classified", *CLASSIFY),
)
register(
    "file_manifest_summary",
    lambda s, d: cl.manifest_summary(cl.classify_files(spread(s, d))),
    sql("files code_files", """SELECT repo_id, count(*) AS total, count(*) FILTER (scan_context = 'source') AS source,
    count(*) FILTER (scan_context = 'test') AS test, count(*) FILTER (scan_context = 'excluded') AS excluded FROM classified GROUP BY 1""", *CLASSIFY),
)
register(
    "file_rule_context",
    lambda s, d: spread(s, d).select(*PATHS, cl.rule_context(F.col("path")).alias("rule_context")),
    sql("files code_files", f"""SELECT repo_id, path, CASE WHEN {_m('lower(path)', cl.RULE_TEST_PATH)} THEN 'test'
    WHEN ext IN {_in(cl.FRONTEND_EXTS)} THEN 'frontend' WHEN ext IN {_in(cl.DOC_EXTS)} THEN 'doc'
    WHEN ext IN {_in(cl.CONFIG_EXTS)} THEN 'config' ELSE 'backend' END AS rule_context FROM basic""", *CLASSIFY[:2]),
)
MINIFIED = "(length(content) > 500 AND length(content) / len(string_split(content, chr(10))) > 500)"
register(
    "file_minified",
    lambda s, d: spread(s, d).select(*PATHS, cl.is_minified(F.col("content")).alias("minified")),
    sql("files code_files", f"SELECT repo_id, path, {MINIFIED} AS minified FROM spread", SPREAD_SQL),
)
register(
    "file_infra_eligible",
    lambda s, d: spread(s, d).select(*PATHS, cl.infra_eligible(F.col("path"), F.col("content")).alias("eligible")),
    sql("files code_files", f"""SELECT repo_id, path, ext NOT IN {_in(cl.INFRA_SKIP_EXTS)} AND NOT {_m('path', cl.INFRA_TEST_NAME)}
    AND NOT {_m('path', cl.INFRA_VENDOR)} AS eligible FROM basic""", *CLASSIFY[:2]),
)
