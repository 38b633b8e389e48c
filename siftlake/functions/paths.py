"""Path, extension and glob helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def norm_path(path: Column) -> Column:
    """Forward slashes, lower case, one leading slash."""
    p = F.lower(F.translate(path, "\\", "/"))
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def extension(path: Column) -> Column:
    """Text after the last dot, lower-cased (the whole name when there is no dot)."""
    return F.lower(F.substring_index(path, ".", -1))


def basename(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def name_glob_regex(glob: str) -> str:
    """Case-insensitive regex of a file-name glob: `**` one or more of anything, `*` and `?` in-segment."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if glob.startswith("**", i):
            out.append(".+")
            i += 2
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(ch) or (("\\" + ch) if ch in ".+^${}()|[]\\" else ch))
        i += 1
    return r"(?i)^" + "".join(out) + r"\z"
