"""Reading source trees and choosing which files take part in a scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlake.functions.exprs import str_array
from siftlake.functions.paths import basename, extension, name_glob_regex
from siftlake.operators.path_index import IGNORE_KINDS, covers_entry, ignore_index, met
from siftlake.session import written

# --- Fixed values ---
SUPPORTED_EXTENSIONS = [
    "js", "mjs", "cjs", "ts", "jsx", "tsx", "py", "php", "aspx", "ascx", "master", "config", "cs", "txt",
    "log", "env", "sql", "yml", "yaml", "json", "xml", "properties", "ini", "cfg", "conf", "sh", "bash",
    "ps1", "bat", "cmd", "bak", "old", "orig", "pem", "key", "pfx", "p12", "sqlite", "sqlite3", "db",
]
EXTRA_EXTENSIONS = ["html", "htm", "csv"]
LANGUAGE_EXTENSIONS = {
    "js": ["js", "mjs", "cjs"], "javascript": ["js", "mjs", "cjs"], "ts": ["ts", "tsx"],
    "typescript": ["ts", "tsx"], "react": ["jsx", "tsx"], "py": ["py"], "python": ["py"], "php": ["php"],
    "aspx": ["aspx", "ascx", "master"], "aspnet": ["aspx", "ascx", "master", "config", "cs"],
    "dotnet": ["aspx", "ascx", "master", "config", "cs"], "config": ["config"], "cs": ["cs"],
    "csharp": ["cs"], "env": ["env"], "sql": ["sql"], "yaml": ["yml", "yaml"], "yml": ["yml", "yaml"],
    "json": ["json"], "xml": ["xml"], "properties": ["properties"], "ini": ["ini", "cfg", "conf"],
    "shell": ["sh", "bash"], "sh": ["sh", "bash"], "powershell": ["ps1"], "ps1": ["ps1"],
    "batch": ["bat", "cmd"], "bat": ["bat", "cmd"],
    "secrets": ["env", "pem", "key", "pfx", "p12", "sqlite", "sqlite3", "db", "bak"],
    "txt": ["txt"], "log": ["log"], "logs": ["log", "txt"],
}
IGNORED_DIRS = [
    "node_modules", ".git", "dist", "build", ".next", ".nuxt", "coverage", ".nyc_output", "__pycache__",
    ".cache", "target", "out",
]
VENDOR_PATH = (
    r"(?i)(?:^|[/\\])(?:node_modules|vendor|site-packages|bower_components|packages)[/\\]"
    r"|[/\\]lib[/\\]python[0-9]|(?:^|[/\\])__pycache__[/\\]|\.pyc\z|(?:^|[/\\])(?:\.venv|venv|env)[/\\]"
    r"|(?:^|[/\\])bin[/\\](?:debug|release)[/\\]|(?:^|[/\\])obj[/\\](?:debug|release)[/\\]|\.min\.(?:js|css)\z"
)
CHANGED_SKIP_PARTS = [
    "node_modules/", ".git/", "dist/", "build/", ".next/", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
]
CHANGED_SKIP_EXTS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".zip",
    ".tar", ".gz", ".map",
]
LARGE_KB = 512
# Endings of names whose files a reader of lines unpacks.
PACKED = r"(?i)\.(?:gz|bz2|deflate|lz4|snappy|zst|passthrough)\z"
# --- end of fixed values ---


def balanced(files: DataFrame, *keys: str) -> DataFrame:
    """Spread a plain file scan over all cores when its input has fewer partitions than cores.

    Matching costs far more per byte than moving the text once. A large input has more partitions than
    cores and is returned as it is, without an exchange. Only for DataFrames that read files directly.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    if files.rdd.getNumPartitions() >= cores:
        return files
    return files.repartition(cores, *(keys or ("repo_id", "path")))


def read_tree(spark: SparkSession, root: str, repo_id: str, glob: str | None = None) -> DataFrame:
    """files(repo_id, path, content) of every file under root; path is relative to root.

    The glob is applied while listing, so files that do not match are never opened.
    """
    return _tree(spark, "binaryFile", root, glob).select(F.lit(repo_id).alias("repo_id"), _below(root).alias("path"), _valid("content").alias("content"))


def text_lengths(spark: SparkSession, root: str, repo_id: str, glob: str | None = None) -> DataFrame:
    """(repo_id, path, n_chars) of the same files: the length of each whole text, for files of any size.

    Texts are read by lines, so several tasks share a large file and none holds it: a task's memory is that of its longest
    line. Line ends, which no line has, are the bytes that the lines leave of a file; a byte order mark, which the reader
    drops, is three more. A line end is no part of a longer character, so broken bytes are replaced as in the whole text.
    Files that the reader would unpack by their name are read whole.
    """
    file, packed = F.col("_metadata.file_path"), F.col("_metadata.file_path").rlike(PACKED)
    lines = _tree(spark, "text", root, glob, lineSep="\n").where(~packed).select(file.alias("_file"), "value")
    read = lines.groupBy("_file").agg(
        F.sum(F.length(_valid("value"))).alias("_chars"), F.sum(F.octet_length("value")).alias("_bytes"), F.count(F.lit(1)).alias("_lines")
    )
    sums = ["_chars", "_bytes", "_lines"]
    left = F.col("length") - F.col("_bytes")
    marked = left - F.greatest(F.col("_lines") - 1, F.lit(0)) >= 3
    size = F.col("_chars") + left - F.when(marked, 2).otherwise(0)
    there = _tree(spark, "binaryFile", root, glob)
    listed = there.where(~packed).select(file.alias("_file"), _below(root).alias("path"), "length")
    plain = listed.join(read, "_file", "left").fillna(0, sums).select("path", size.alias("n_chars"))
    whole = there.where(packed).select(_below(root).alias("path"), F.length(_valid("content")).cast("bigint").alias("n_chars"))
    return plain.unionByName(whole).select(F.lit(repo_id).alias("repo_id"), "path", "n_chars")


def _tree(spark: SparkSession, kind: str, root: str, glob: str | None, **options: str) -> DataFrame:
    reader = spark.read.format(kind).options(recursiveFileLookup="true", **options)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def _below(root: str) -> Column:
    return F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), r"^/+", "")


def _valid(text: str) -> Column:
    return F.make_valid_utf8(F.col(text).cast("string"))  # broken bytes are replaced, not refused


def keep_supported(files: DataFrame, extra: bool = True) -> DataFrame:
    return files.where(extension(F.col("path")).isin(SUPPORTED_EXTENSIONS + (EXTRA_EXTENSIONS if extra else [])))


def keep_language(files: DataFrame, lang: str) -> DataFrame:
    exts = LANGUAGE_EXTENSIONS.get(lang.lower())
    if not exts:
        raise ValueError(f"unknown language {lang!r}; known: {', '.join(LANGUAGE_EXTENSIONS)}")
    return files.where(extension(F.col("path")).isin(exts))


def drop_ignored_dirs(files: DataFrame) -> DataFrame:
    """Drop build and cache directories and hidden entries other than `.env`, at any depth."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") & (p != ".env"))
    return files.where(~F.arrays_overlap(parts, str_array(IGNORED_DIRS)) & ~hidden)


def is_vendor(path: Column) -> Column:
    return path.rlike(VENDOR_PATH)


def vendor_filter(files: DataFrame, mode: str = "exclude") -> DataFrame:
    if mode == "include":
        return files
    if mode not in ("exclude", "only"):
        raise ValueError(f"vendor mode must be exclude, include or only, not {mode!r}")
    vendor = is_vendor(F.col("path"))
    return files.where(vendor if mode == "only" else ~vendor)


def size_columns(files: DataFrame, max_kb: int | None = None, no_limit: bool = False) -> DataFrame:
    """Add size_kb, is_large and skip_reason (null for files that are kept); sizes are string lengths. Without max_kb
    no file is too large."""
    kb = F.floor(F.length("content") / 1024 + 0.5)
    reason = F.when(F.col("content").isNull(), "unreadable")
    if max_kb and not no_limit:
        reason = reason.when(F.length("content") > max_kb * 1024, "too_large")
    return files.withColumns({"size_kb": kb, "is_large": kb > LARGE_KB, "skip_reason": reason})


def size_guard(
    files: DataFrame, max_kb: int | None = None, no_limit: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(kept files, skipped(repo_id, path, reason, size_kb, limit_kb))."""
    sized = size_columns(files, max_kb, no_limit)
    skipped = sized.where(F.col("skip_reason").isNotNull()).select(
        "repo_id", "path", F.col("skip_reason").alias("reason"), "size_kb",
        F.when(F.col("skip_reason") == "too_large", F.lit(max_kb).cast("bigint")).alias("limit_kb"),
    )
    return sized.where(F.col("skip_reason").isNull()).drop("skip_reason"), skipped


def glob_target(files: DataFrame, target: str) -> DataFrame:
    """`dir/name-glob`: names match case-insensitively, `**` in the name also looks below the directory."""
    folder, _, name = target.rpartition("/")
    prefix = folder + "/" if folder else ""
    inside = F.col("path").startswith(prefix)
    rest = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    if "**" not in name:
        inside = inside & ~rest.contains("/")
    hidden = F.exists(F.split(rest, "/"), lambda p: p.startswith("."))
    return files.where(inside & ~hidden & basename(F.col("path")).rlike(name_glob_regex(name)))


def union_targets(targets: list[DataFrame]) -> DataFrame:
    """All targets together; the first target that has a path supplies it.

    The winners are found on keys alone and written; their size is then known, and up to the session's limit they are
    sent to the texts, which stay where they are.
    """
    keys = lambda i, t: t.select("repo_id", "path", F.lit(i).alias("_target"))
    every = reduce(DataFrame.unionByName, [keys(i, t) for i, t in enumerate(targets)])
    first = written(every.groupBy("repo_id", "path").agg(F.min("_target").alias("_target")), "targets")
    parts = []
    for i, t in enumerate(targets):
        mine = first.where(F.col("_target") == i).select(F.col("repo_id").alias("_r"), F.col("path").alias("_p"))
        parts.append(t.join(mine, t["repo_id"].eqNullSafe(F.col("_r")) & t["path"].eqNullSafe(F.col("_p")), "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def should_scan(path: Column) -> Column:
    bad = F.lit(False)
    for part in CHANGED_SKIP_PARTS:
        bad = bad | path.contains(part)
    for ext in CHANGED_SKIP_EXTS:
        bad = bad | path.endswith(ext)
    return ~bad


def changed_files(base: DataFrame, current: DataFrame) -> DataFrame:
    """Files of `current` that are new or differ from `base`, skip list applied; digests are compared.

    The changed paths are found on digests alone and written; their size is then known, and up to the session's limit they
    are sent to the texts, which stay where they are. States that are stored are compared by `digests.changed_paths`.
    """
    digest = F.sha2("content", 256).alias("_digest")
    wanted = current.where(should_scan(F.col("path")))
    old = base.select(F.col("repo_id").alias("_r"), F.col("path").alias("_p"), digest.alias("_d"))
    new = wanted.select("repo_id", "path", digest)
    same = F.col("repo_id").eqNullSafe(F.col("_r")) & F.col("path").eqNullSafe(F.col("_p")) & F.col("_digest").eqNullSafe(F.col("_d"))
    changed = written(new.join(old, same, "left_anti").select(F.col("repo_id").alias("_r"), F.col("path").alias("_p")), "changed")
    return wanted.join(changed, wanted["repo_id"].eqNullSafe(F.col("_r")) & wanted["path"].eqNullSafe(F.col("_p")), "left_semi")


def parse_ignore_lines(lines: DataFrame) -> DataFrame:
    """ignore lines(repo_id, dir, dir_order, rule_order, line) -> the same with body, anchored and negated.

    The body is anchored by a leading slash, otherwise it may begin at any directory; it covers the
    matched entry and everything below it.
    """
    text = F.trim("line")
    rows = lines.where((text != "") & ~text.startswith("#")).withColumn("_t", text)
    negated = F.col("_t").startswith("!")
    body = F.when(negated, F.substr(F.col("_t"), F.lit(2))).otherwise(F.col("_t"))
    return rows.select(
        "repo_id", "dir", "dir_order", "rule_order",
        F.regexp_replace(F.regexp_replace(body, "^/", ""), "/$", "").alias("body"),
        body.startswith("/").alias("anchored"), negated.alias("negated"),
    )


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo_id, path) of ignored files: of all lines that cover a path, the last one decides.

    Paths and lines meet by the keys of the pattern index; the texts of the files take no part.
    """
    index = ignore_index(rules.where(F.col("repo_id").isNotNull()))
    hits = met(paths.select("repo_id", "path"), index, "repo_id", IGNORE_KINDS, F.col("path")).where(covers_entry(F.col("path")))
    last = hits.groupBy("repo_id", "path").agg(F.max_by("negated", F.struct("dir_order", "rule_order", "dir", "body", "negated")).alias("_negated"))
    return last.where(~F.col("_negated")).select("repo_id", "path")


def apply_ignore(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop ignored files."""
    return files.join(ignored_paths(files, rules), ["repo_id", "path"], "left_anti")
