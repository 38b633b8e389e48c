"""File classification: narrow projections over the files table, one row in, one row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.functions.exprs import any_contains, map_literal
from siftlake.functions.paths import basename, extension, norm_path, slashed
from siftlake.functions.regexes import java_pattern, literal_alternation

# --- Fixed values: path segments, name patterns, data extensions, languages, frameworks. ---
FIXTURE_SEGMENTS = [
    "/fixtures/", "/fixture/", "/mocks/", "/mock/", "/stubs/", "/stub/", "/__fixtures__/", "/__mocks__/",
]
TEST_SEGMENTS = [
    "/test/", "/tests/", "/spec/", "/specs/", "/__tests__/", "/__specs__/", "/e2e/",
    "/integration-tests/", "/unit/",
]
VENDOR_SEGMENTS = [
    "/vendor/", "/node_modules/", "/bower_components/", "/site-packages/", "/lib/python", "/packages/",
    "/.venv/", "/venv/",
]
GENERATED_SEGMENTS = [
    "/dist/", "/build/", "/out/", "/.next/", "/.nuxt/", "/generated/", "/gen/", "/auto-generated/",
    "/coverage/", "/.nyc_output/", "/__pycache__/",
]
DOCS_SEGMENTS = ["/docs/", "/doc/", "/documentation/", "/wiki/"]

STRONG_TEST_NAME = r"(?:\.(?:test|spec)\.[a-z]+\z|_test\.[a-z]+\z|^test_[^/]+\.[a-z]+\z)"
TEST_NAME = (
    r"(?:\.(?:test|spec)\.[a-z]+\z|_test\.[a-z]+\z|^test_.*\.[a-z]+\z|test\.[a-z]+\z|\.test\z|\.spec\z)"
)
GENERATED_NAME = (
    r"(?:\.min\.(?:js|css)\z|package-lock\.json\z|yarn\.lock\z|composer\.lock\z|pipfile\.lock\z"
    r"|\.lock\z|\.d\.ts\z)"
)
CONFIG_NAME = (
    r"(?:\.(?:env|config|conf|ini|cfg|properties|yml|yaml|toml|json)\z|^\.env(?:\.[a-z]+)?\z"
    r"|webpack\.config\.|vite\.config\.|babel\.config\.|jest\.config\.|karma\.conf\.|rollup\.config\."
    r"|tsconfig\.|\.eslintrc|\.prettierrc|\.stylelintrc)"
)
DATA_EXTENSIONS = [
    "json", "yaml", "yml", "xml", "txt", "log", "sql", "sqlite", "sqlite3", "db", "pem", "key", "pfx",
    "p12", "csv", "tsv", "toml", "ini", "cfg", "conf", "properties",
]
LANGUAGE_BY_EXT = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "py": "python", "php": "php", "cs": "csharp",
    "aspx": "aspnet", "ascx": "aspnet", "master": "aspnet", "rb": "ruby", "go": "go", "java": "java",
    "kt": "kotlin", "rs": "rust", "sh": "shell", "bash": "shell", "ps1": "powershell", "bat": "batch",
    "cmd": "batch", "yml": "yaml", "yaml": "yaml", "json": "json", "xml": "xml", "sql": "sql",
    "env": "env", "ini": "ini", "cfg": "ini", "conf": "ini", "properties": "ini", "txt": "text",
    "log": "text", "md": "markdown", "pem": "pem", "key": "pem", "pfx": "pem", "p12": "pem",
}
FRAMEWORK_SIGNALS = [  # framework, pattern, literals one of which every match contains
    ("jest", r"\bjest\.(?:mock|fn|spyOn|setTimeout|useFakeTimers)\b", ["jest."]),
    ("jest", r"from\s+['\"](?:@jest/globals|jest-each)['\"]", ["jest"]),
    ("vitest", r"from\s+['\"]vitest['\"]", ["vitest"]),
    ("vitest", r"\bvi\.(?:mock|fn|spyOn)\b", ["vi."]),
    ("playwright", r"from\s+['\"]@playwright/test['\"]", ["@playwright/test"]),
    ("playwright", r"\btest\.(?:describe|beforeAll|afterAll|beforeEach|afterEach)\b", ["test."]),
    ("mocha", r"\b(?:before|after|beforeEach|afterEach)\s*\(", ["before", "after"]),
    ("mocha", r"\bassert\.[a-z]+\s*\(", ["assert."]),
    ("pytest", r"\bimport\s+pytest\b", ["pytest"]),
    ("pytest", r"\bdef\s+test_[a-z_]+\s*\(", ["def"]),
    ("pytest", r"@pytest\.fixture\b", ["@pytest"]),
    ("unittest", r"\bimport\s+unittest\b", ["unittest"]),
    ("unittest", r"\bfrom\s+unittest\b", ["unittest"]),
    ("unittest", r"\bclass\s+\w+\s*\(\s*unittest\.TestCase\s*\)", ["unittest"]),
    ("phpunit", r"\bextends\s+(?:TestCase|PHPUnit\\Framework\\TestCase)\b", ["extends"]),
    ("phpunit", r"public\s+function\s+test[A-Z]", ["function"]),
    ("phpunit", r"\buse\s+PHPUnit\\", ["PHPUnit"]),
    ("phpunit", r"\bnamespace\s+\S+\\Tests?\\", ["namespace"]),
    ("pest", r"\buses\s*\(\s*\w+::class\s*\)", ["::class"]),
    ("pest", r"\bit\s*\(\s*['\"]", ["it"]),
    ("nunit", r"\[(?:Test|TestFixture|SetUp|TearDown|OneTimeSetUp)\]", ["["]),
    ("xunit", r"\[(?:Fact|Theory|InlineData|ClassData)\]", ["["]),
    ("mstest", r"\[(?:TestMethod|TestClass|TestInitialize|TestCleanup)\]", ["["]),
    ("rspec", r"\b(?:describe|context|it)\s+['\"].*['\"],?\s*do\b", ["do"]),
    ("rspec", r"\bexpect\s*\(.*\)\.to\s", ["expect"]),
    ("minitest", r"require\s+['\"]minitest/autorun['\"]", ["minitest"]),
    ("minitest", r"\bclass\s+\w+\s*<\s*Minitest::Test\b", ["Minitest"]),
    ("node-test", r"require\s*\(\s*['\"]node:test['\"]\s*\)", ["node:test"]),
    ("node-test", r"from\s+['\"]node:test['\"]", ["node:test"]),
    ("bun-test", r"from\s+['\"]bun:test['\"]", ["bun:test"]),
    ("bun-test", r"require\s*\(\s*['\"]bun:test['\"]\s*\)", ["bun:test"]),
]
GENERIC_SIGNAL = r"\b(?:describe|it|expect|assert|should)\s*[.(]"

FRONTEND_EXTS = ["js", "ts", "jsx", "tsx", "mjs", "cjs", "vue", "svelte", "html", "htm"]
DOC_EXTS = ["md", "txt", "log", "rst", "adoc"]
CONFIG_EXTS = ["json", "yml", "yaml", "toml", "ini", "env", "conf", "cfg", "properties", "xml"]
RULE_TEST_PATH = r"(?:^|[/\\])(?:tests?|spec|__tests__|__mocks__|fixtures)(?:[/\\]|\z)|\.(?:test|spec)\.[a-z]+\z"

INFRA_SKIP_EXTS = [
    "png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "eot", "mp4", "mp3", "pdf", "zip",
    "gz", "tar", "lock", "sum",
]
INFRA_TEST_NAME = (
    r"(?i)(?:\.(?:test|spec|mock)\.|__tests__|__mocks__|\.env\.(?:example|template)|readme|changelog"
    r"|fixtures|examples|webpack\.config|vite\.config|rollup\.config|babel\.config|jest\.config"
    r"|karma\.conf|postcss\.config|tailwind\.config|next\.config|nuxt\.config|vitest\.config)"
)
INFRA_VENDOR = (
    r"(?i)(?:[/\\]vendor[/\\]|[/\\]node_modules[/\\]|[/\\]bower_components[/\\]|\.min\.(?:js|css)\z"
    r"|flot_|jquery[-.]|bootstrap[-.])"
)
# --- end of fixed values ---


def _has_segment(path: Column, segments) -> Column:
    return path.rlike(literal_alternation(segments))


def path_columns(files: DataFrame) -> DataFrame:
    """Add norm_path, base_name, ext and language."""
    return files.withColumns(
        {
            "norm_path": norm_path(F.col("path")),
            "base_name": F.lower(basename(F.col("path"))),
            "ext": extension(F.col("path")),
            "language": map_literal(LANGUAGE_BY_EXT, extension(F.col("path"))),
        }
    )


def path_type_columns(files: DataFrame) -> DataFrame:
    """Add `definitive`, `tentative`, `tentative_is_path` from path and name alone (needs path_columns)."""
    p, b = F.col("norm_path"), F.col("base_name")
    in_test = _has_segment(p, TEST_SEGMENTS)
    vendor, generated = _has_segment(p, VENDOR_SEGMENTS), _has_segment(p, GENERATED_SEGMENTS)
    kind = (
        F.when(vendor, "vendor")
        .when(generated | b.rlike(GENERATED_NAME), "generated")
        .when(_has_segment(p, FIXTURE_SEGMENTS), "fixture?path")
        .when(b.rlike(STRONG_TEST_NAME) & in_test, "test")
        .when(b.rlike(TEST_NAME), "test?name")
        .when(in_test, "test?path")
        .when(b.rlike(CONFIG_NAME), "config")
        .when(_has_segment(p, DOCS_SEGMENTS), "docs?path")
    )
    out = files.withColumn("_kind", kind)
    unsure = F.col("_kind").contains("?")
    named = F.substring_index("_kind", "?", 1)
    data_commit = unsure & F.col("ext").isin(DATA_EXTENSIONS)
    return out.withColumns(
        {
            "definitive": F.when(~unsure | data_commit, named),
            "tentative": F.when(unsure & ~data_commit, named),
            "tentative_is_path": F.coalesce(F.col("_kind").endswith("?path"), F.lit(False)),
            "data_commit": F.coalesce(data_commit, F.lit(False)),
        }
    ).drop("_kind")


def head_of(content: Column, lines: int | None = None) -> Column:
    """The first lines, or the whole text."""
    return F.substring_index(content, "\n", lines) if lines else content


def signal_columns(files: DataFrame, head_lines: int | None = None) -> DataFrame:
    """Add named_signal (first named framework in the text or its head) and any_signal."""
    out = files.withColumn("_head", head_of(F.col("content"), head_lines))
    head = F.col("_head")
    named = F.coalesce(
        *[
            F.when(any_contains(head, literals) & head.rlike(java_pattern(re)), F.lit(name))
            for name, re, literals in FRAMEWORK_SIGNALS
        ]
    )
    out = out.withColumn("named_signal", named)
    generic = head.rlike(java_pattern(GENERIC_SIGNAL))
    return out.withColumn(
        "any_signal", F.coalesce(F.col("named_signal").isNotNull() | generic, F.lit(False))
    ).drop("_head")


def final_type_columns(files: DataFrame) -> DataFrame:
    """Add file_type, framework, signals and scan_context (needs the columns of the three steps above)."""
    has_text = F.coalesce(F.col("content") != "", F.lit(False))
    sure, maybe = F.col("definitive"), F.col("tentative")
    confirmed = has_text & F.col("any_signal")
    file_type = (
        F.when(sure.isNotNull(), sure)
        .when(confirmed, F.coalesce(maybe, F.lit("test")))
        .when(~has_text & maybe.isNotNull() & F.col("tentative_is_path"), maybe)
        .otherwise("source")
    )
    framework = F.when(has_text & (sure.isNull() | (sure == "test")), F.col("named_signal"))
    signals = F.array_compact(
        F.array(
            F.when(sure.isNotNull(), F.concat(F.lit("path: "), sure)),
            F.when(F.col("data_commit"), F.lit("data extension: committed without content")),
            F.when(framework.isNotNull(), F.concat(F.lit("content: framework="), framework)),
            F.when(sure.isNull() & maybe.isNotNull() & confirmed, F.concat(F.lit("confirmed: "), maybe)),
            F.when(sure.isNull() & maybe.isNull() & confirmed, F.lit("content: test signal")),
            F.when(
                sure.isNull() & maybe.isNotNull() & has_text & ~F.col("any_signal"),
                F.concat(F.lit("not confirmed: "), maybe),
            ),
            F.when(
                sure.isNull() & maybe.isNotNull() & ~has_text & F.col("tentative_is_path"),
                F.concat(F.lit("no content: "), maybe),
            ),
        )
    )
    # A generator of one row: filters on its columns stay above it, so that a later
    # `scan_context = 'source'` does not evaluate the whole classification a second time.
    decided = F.struct(file_type.alias("file_type"), framework.alias("framework"), signals.alias("signals"))
    out = files.select("*", F.inline(F.array(decided)))
    return out.withColumn("scan_context", scan_context(F.col("file_type")))


def scan_context(file_type: Column) -> Column:
    return (
        F.when(file_type.isin("vendor", "generated"), "excluded")
        .when(file_type.isin("test", "fixture"), "test")
        .otherwise("source")
    )


def classify_files(files: DataFrame) -> DataFrame:
    """Full classification of files(repo_id, path, content, ...); no shuffle."""
    return final_type_columns(signal_columns(path_type_columns(path_columns(files)))).drop(
        "definitive", "tentative", "tentative_is_path", "data_commit", "named_signal", "any_signal"
    )


def manifest_summary(classified: DataFrame) -> DataFrame:
    ctx = F.col("scan_context")
    return classified.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ctx == "source").alias("source"),
        F.count_if(ctx == "test").alias("test"),
        F.count_if(ctx == "excluded").alias("excluded"),
    )


def rule_context(path: Column) -> Column:
    """Coarse class used by confidence rules: test, frontend, doc, config or backend."""
    ext = extension(path)
    return (
        F.when(F.lower(path).rlike(RULE_TEST_PATH), "test")
        .when(ext.isin(FRONTEND_EXTS), "frontend")
        .when(ext.isin(DOC_EXTS), "doc")
        .when(ext.isin(CONFIG_EXTS), "config")
        .otherwise("backend")
    )


def is_minified(content: Column) -> Column:
    """Longer than 500 characters with a mean line length above 500."""
    n_lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    return (F.length(content) > 500) & (F.length(content) / n_lines > 500)


def infra_eligible(path: Column, content: Column, skip_minified: bool = False) -> Column:
    named = (
        ~extension(path).isin(INFRA_SKIP_EXTS)
        & ~path.rlike(INFRA_TEST_NAME)
        & ~path.rlike(INFRA_VENDOR)
    )
    return named & ~is_minified(content) if skip_minified else named
