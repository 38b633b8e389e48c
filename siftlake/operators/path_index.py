"""An index of path patterns by segments.

Every pattern is filed under one key that each path it covers has too: the whole literal or the folders before its first
wildcard, else the file name or its ending after the last wildcard, else a literal segment in between. A path lists
its own prefixes, name, endings and segments. Patterns and paths then meet by equality of keys, and only a pattern that begins
with a wildcard meets paths elsewhere than below its own folder. What meets is tested token by token, without a regular
expression. A pattern of wildcards alone meets every path of its owner.

Patterns belong to an owner (a repository, a rule); those of a null owner apply to every path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.functions.globs import glob_entry, glob_whole, has_wildcard, tokens
from siftlake.functions.paths import slashed

PREFIX, NAME, ENDING, SEGMENT, ANY_ENDING, ANY = "p:", "n:", "x:", "s:", "y:", "*"


def _endings(name: Column) -> Column:
    """`a.test.js` -> `.test.js`, `.js`."""
    at = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(name, i, F.lit(1)) == ".")
    return F.when(F.length(name) == 0, F.array().cast("array<string>")).otherwise(F.transform(at, lambda i: F.substr(name, i)))


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(tag), v))


def path_keys(path: Column, *kinds: str) -> Column:
    """The keys of a path, of the given kinds."""
    parts = F.split(path, "/", -1)
    every = {
        PREFIX: lambda: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
        NAME: lambda: F.array(F.element_at(parts, -1)),
        ENDING: lambda: _endings(F.element_at(parts, -1)),
        SEGMENT: lambda: parts,
        ANY_ENDING: lambda: F.flatten(F.transform(parts, _endings)),
    }
    keys = [_tagged(k, every[k]()) for k in kinds if k != ANY]
    return F.array_distinct(F.concat(*keys, F.array(F.lit(ANY))))


def _longest(segments: Column) -> Column:
    """The longest segment without a wildcard, or null."""
    literal = F.filter(segments, lambda s: ~has_wildcard(s) & (s != ""))
    return F.array_max(F.transform(literal, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]


SCOPE_KINDS = (PREFIX, NAME, ENDING, SEGMENT)


def scope_index(patterns: DataFrame, *owner: str) -> DataFrame:
    """patterns(*owner, pattern, ...) -> the same with key, tokens and `literal`: the key says it all.

    A trailing slash, or no wildcard, names a file or folder with all below. With wildcards the whole path must match.
    """
    norm = F.regexp_replace(slashed(F.col("pattern")), "/$", "")
    wild = has_wildcard(norm) & ~F.col("pattern").endswith("/")
    head, tail = F.regexp_extract(norm, r"^[^*?]*", 0), F.regexp_extract(norm, r"[^*?]*$", 0)
    inner = F.split(norm, "/", -1)
    middle = _longest(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))))
    key = (
        F.when(~wild, F.concat(F.lit(PREFIX), norm))
        .when(head.contains("/"), F.concat(F.lit(PREFIX), F.regexp_extract(head, r"(?s)^(.*)/[^/]*$", 1)))
        .when(tail.contains("/"), F.concat(F.lit(NAME), F.substring_index(tail, "/", -1)))
        .when(tail.contains("."), F.concat(F.lit(ENDING), F.regexp_extract(tail, r"(?s)\..*$", 0)))
        .when(middle.isNotNull(), F.concat(F.lit(SEGMENT), middle))
        .otherwise(ANY)
    )
    return patterns.withColumns({"_key": key, "_tokens": F.when(wild, tokens(norm)), "_literal": ~wild})


def covers_whole(path: Column) -> Column:
    """Of a row where a path has met a scope pattern's key: whether the pattern covers it."""
    return F.col("_literal") | glob_whole(path, F.col("_tokens"))


IGNORE_KINDS = (PREFIX, SEGMENT, ANY_ENDING)


def ignore_index(lines: DataFrame) -> DataFrame:
    """lines(repo_id, dir, body, anchored, ...) -> the same with key and tokens.

    The body matches whole entries of the path below `dir`, the first ones if anchored, and all that is below them.
    """
    body, folder = F.col("body"), F.col("dir")
    inside = lambda rest: F.concat(F.lit(PREFIX), F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest)))
    segments = F.split(body, "/", -1)
    head = F.regexp_extract(body, r"^[^*?]*", 0)
    tail = F.regexp_extract(body, r"[^*?]*$", 0)
    literal = _longest(segments)
    key = (
        F.when(F.col("anchored") & ~has_wildcard(body) & (body != ""), inside(body))
        .when(F.col("anchored") & head.contains("/"), inside(F.regexp_extract(head, r"(?s)^(.*)/[^/]*$", 1)))
        .when(literal.isNotNull(), F.concat(F.lit(SEGMENT), literal))
        .when(tail.contains(".") & ~tail.contains("/"), F.concat(F.lit(ANY_ENDING), F.regexp_extract(tail, r"(?s)\..*$", 0)))
        .when(folder != "", F.concat(F.lit(PREFIX), folder))
        .otherwise(ANY)
    )
    return lines.withColumns({"_key": key, "_tokens": tokens(body)})


def covers_entry(path: Column) -> Column:
    """Of a row where a path has met an ignore line's key: whether the line covers it."""
    below = (F.col("dir") == "") | F.startswith(path, F.concat(F.col("dir"), F.lit("/")))
    rest = F.when(F.col("dir") == "", path).otherwise(F.substr(path, F.length("dir") + 2))
    return below & glob_entry(rest, F.col("_tokens"), F.col("anchored"))


def met(paths: DataFrame, index: DataFrame, owner: str, kinds: tuple[str, ...], path: Column) -> DataFrame:
    """paths(owner, path, ...) x index rows of the same owner, or of none, that have a key in common.

    Only names move: a path is a few short keys, hot keys are split by AQE like those of any equi-join.
    """
    keyed = paths.withColumn("_key", F.explode(path_keys(path, *kinds)))
    own = keyed.join(index.where(F.col(owner).isNotNull()), [owner, "_key"])
    every = keyed.join(index.where(F.col(owner).isNull()).drop(owner), "_key")
    return own.unionByName(every)
