"""Dependency inventory out of manifest files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.functions.exprs import let
from siftlake.functions.paths import basename

# Dependency name -> framework, with the way the name is compared; further down the patterns of manifest lines.
FRAMEWORKS = [
    *[("javascript", "exact", n, n) for n in (
        "express", "fastify", "koa", "next", "react", "vue", "typeorm", "sequelize", "mongoose", "jsonwebtoken")],
    ("javascript", "prefix", "@nestjs", "nestjs"),
    *[("python", "exact", n, n) for n in ("flask", "django", "fastapi", "sqlalchemy", "pyjwt")],
    ("php", "prefix", "laravel/", "laravel"), ("php", "prefix", "symfony/", "symfony"),
    ("php", "exact", "slim/slim", "slim"), ("php", "exact", "doctrine/orm", "doctrine"),
    ("csharp", "contains", "aspnetcore", "aspnetcore"), ("csharp", "contains", "entityframework", "entityframework"),
]
OUT = ["repo_id", "path", "language", "name", "version", "dev"]


ENTRY = "array<struct<name:string,version:string,dev:boolean>>"


def _entry(name: Column, version: Column, dev: Column | bool = False) -> Column:
    return F.struct(name.alias("name"), version.alias("version"), (F.lit(dev) if isinstance(dev, bool) else dev).alias("dev"))


def _json_maps(main: str, dev: str, skip: str | None) -> Column:
    """A dev entry replaces the main entry of the same name, as later keys of one object do."""
    j = F.from_json("content", f"`{main}` map<string,string>, `{dev}` map<string,string>")
    none = F.create_map().cast("map<string,string>")

    def both(j: Column) -> Column:
        m, d = F.coalesce(j[main], none), F.coalesce(j[dev], none)
        m = F.map_filter(m, lambda k, _: ~F.map_contains_key(d, k) & (F.lit(True) if skip is None else k != skip))
        return F.concat(
            F.transform(F.map_entries(m), lambda e: _entry(e["key"], e["value"])),
            F.transform(F.map_entries(d), lambda e: _entry(e["key"], e["value"], True)),
        )

    return let(j, both)


def _last_wins(entries: Column) -> Column:
    """One entry per name: the later line of a manifest replaces the earlier one."""
    return let(entries, lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["name"] == e["name"])))


def _requirements() -> Column:
    rx = r"^([A-Za-z0-9_.-]+)\s*([><=!~]+\s*[\d.*]+)?"
    lines = F.transform(F.split("content", "\n"), lambda raw: F.trim(F.regexp_replace(raw, r"^\s+|\s+\z", "")))
    ok = lambda t: (t != "") & ~t.startswith("#") & ~t.startswith("-") & t.rlike(rx)
    version = lambda t: F.trim(F.regexp_extract(t, rx, 2))
    return _last_wins(F.transform(F.filter(lines, ok), lambda t: _entry(F.lower(F.regexp_extract(t, rx, 1)), F.when(version(t) != "", version(t)).otherwise("*"))))


def _pyproject() -> Column:
    section = r"\[(?:project\.dependencies|tool\.poetry\.dependencies)\]((?s:.*?))(?=\[|\z)"
    pair = r"^([A-Za-z0-9_.-]+)\s*=\s*[\"']?([^\"'\n]+)[\"']?"
    quoted = r"[\"']([A-Za-z0-9_.-]+)\s*([><=!~]+\s*[\d.*]+)?[\"']"
    lines = F.split(F.regexp_extract("content", section, 1), "\n")

    def entry(t: Column) -> Column:
        version = F.trim(F.regexp_extract(t, quoted, 2))
        return _entry(
            F.lower(F.when(t.rlike(pair), F.regexp_extract(t, pair, 1)).otherwise(F.regexp_extract(t, quoted, 1))),
            F.when(t.rlike(pair), F.trim(F.regexp_extract(t, pair, 2))).when(version != "", version).otherwise("*"),
        )

    return _last_wins(F.transform(F.filter(lines, lambda t: t.rlike(pair) | t.rlike(quoted)), entry))


def _csproj() -> Column:
    ref = F.lit('(?i)<PackageReference\\s+Include="([^"]+)"\\s+Version="([^"]+)"')
    names, versions = (F.regexp_extract_all("content", ref, F.lit(i)) for i in (1, 2))
    return _last_wins(F.zip_with(names, versions, lambda n, v: _entry(F.lower(n), v)))


def _target_framework() -> Column:
    return F.nullif(F.trim(F.regexp_extract("content", r"(?i)<TargetFrameworks?>([^<]+)</TargetFrameworks?>", 1)), F.lit(""))


# manifest -> its language and how its entries are read
MANIFESTS = {
    "package.json": ("javascript", lambda: _json_maps("dependencies", "devDependencies", None)),
    "requirements.txt": ("python", _requirements), "pyproject.toml": ("python", _pyproject),
    "composer.json": ("php", lambda: _json_maps("require", "require-dev", "php")), "csproj": ("csharp", _csproj),
}


def _kind() -> Column:
    """Which manifest a file is, from its path alone."""
    name = basename(F.col("path"))
    return F.when(F.col("path").endswith(".csproj"), "csproj").when(name.isin([k for k in MANIFESTS if k != "csproj"]), name)


def _entries_of(files: DataFrame, *kinds: str) -> DataFrame:
    """One row per dependency of the manifests of these kinds; each file is read once and judged in its own row."""
    entries, language = F.when(F.lit(False), F.lit(None).cast(ENTRY)), F.when(F.lit(False), F.lit(""))
    for k in kinds:
        entries, language = entries.when(F.col("_kind") == k, MANIFESTS[k][1]().cast(ENTRY)), language.when(F.col("_kind") == k, MANIFESTS[k][0])
    rows = files.withColumn("_kind", _kind()).where(F.col("_kind").isin(list(kinds)))
    if "pyproject.toml" in kinds:
        # used only where the repository has no requirements.txt beside it; this looks at paths
        folder = F.regexp_replace("path", r"[^/]*\z", "")
        beside = files.where(basename(F.col("path")) == "requirements.txt").select(F.col("repo_id").alias("_r"), folder.alias("_d"))
        hidden = (F.col("_kind") == "pyproject.toml") & (F.col("repo_id") == F.col("_r")) & (folder == F.col("_d"))
        rows = rows.join(beside, hidden, "left_anti")
    framework = F.when(F.col("_kind") == "csproj", _target_framework())
    return rows.select("repo_id", "path", language.alias("language"), framework.alias("target_framework"), F.inline(entries))


def package_json(files: DataFrame) -> DataFrame:
    return _entries_of(files, "package.json").select(*OUT)


def composer_json(files: DataFrame) -> DataFrame:
    return _entries_of(files, "composer.json").select(*OUT)


def requirements_txt(files: DataFrame) -> DataFrame:
    return _entries_of(files, "requirements.txt").select(*OUT)


def pyproject_toml(files: DataFrame) -> DataFrame:
    """Section of dependencies; used only where the repository has no requirements.txt beside it."""
    return _entries_of(files, "pyproject.toml").select(*OUT)


def csproj(files: DataFrame) -> DataFrame:
    """PackageReference entries with the target framework of the project."""
    return _entries_of(files, "csproj").select(*OUT, "target_framework")


def inventory(files: DataFrame) -> DataFrame:
    """dependencies(repo_id, path, language, name, version, dev) of all known manifests, out of one read of the files."""
    return _entries_of(files, *MANIFESTS).select(*OUT)


def frameworks(deps: DataFrame) -> DataFrame:
    """(repo_id, path, framework); dev dependencies of JavaScript do not count."""
    table = deps.sparkSession.createDataFrame(FRAMEWORKS, "language string, how string, needle string, framework string")
    used = deps.where(~((F.col("language") == "javascript") & F.col("dev")))
    name, needle, how = F.col("name"), F.col("needle"), F.col("how")
    fits = (
        ((how == "exact") & (name == needle)) | ((how == "prefix") & F.startswith(name, needle))
        | ((how == "contains") & F.contains(name, needle))
    )
    return used.join(F.broadcast(table), "language").where(fits).select("repo_id", "path", "framework").distinct()


def rollup(deps: DataFrame) -> DataFrame:
    """Per repository: languages, manifests and distinct dependencies."""
    return deps.groupBy("repo_id").agg(
        F.array_sort(F.collect_set("language")).alias("languages"),
        F.countDistinct("path").alias("manifests"), F.countDistinct("language", "name").alias("dependencies"),
    )


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Repositories whose set of (language, name, version, dev) differs from the previous one.

    The order-free signature is a sum of row hashes, so no repository's list is ever gathered.
    """
    def signature(df: DataFrame, name: str) -> DataFrame:
        row = F.xxhash64("language", "name", "version", F.col("dev").cast("string"))
        one = df.select("repo_id", "language", "name", "version", "dev").distinct()
        return one.groupBy("repo_id").agg(F.struct(F.bit_xor(row), F.count(F.lit(1)), F.sum(F.pmod(row, F.lit(1000003)))).alias(name))

    j = signature(old, "a").join(signature(new, "b"), "repo_id", "full_outer")
    return j.select("repo_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
