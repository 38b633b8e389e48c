"""Content-addressed identity of findings, lines and repositories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finding_id(rule_id: Column, path: Column, raw_line: Column) -> Column:
    """`f-` + 10 hex digits over rule, path and raw line; the line number never takes part."""
    key = F.concat(
        F.coalesce(rule_id, F.lit("")), F.lit("|"), F.coalesce(path, F.lit("")), F.lit("|"),
        F.coalesce(raw_line, F.lit("")),
    )
    return F.concat(F.lit("f-"), F.substring(F.sha2(key, 256), 1, 10))


def code_hash(raw_line: Column) -> Column:
    """32 hex digits over the raw line; null for an empty line."""
    return F.when(raw_line != "", F.substring(F.sha2(raw_line, 256), 1, 32))


def legacy_line_hash(text: Column) -> Column:
    """`sha256:` + 16 hex digits over the trimmed line with collapsed blanks and unified quotes."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+\z", "")
    norm = F.translate(F.regexp_replace(trimmed, r"\s+", " "), '"', "'")
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(norm, 256), 1, 16))


def strip_control(text: Column) -> Column:
    """Remove C0 (except tab), DEL and C1 control characters; for display only."""
    return F.regexp_replace(text, r"[\x00-\x08\x0a-\x1f\x7f-\x{9f}]", "")


def canonical_remote(remote: Column) -> Column:
    """`host/owner/repo` for URL and scp-like remotes; anything else trimmed and unchanged."""
    raw = F.trim(F.coalesce(remote, F.lit("")))
    has_scheme = raw.rlike(r"^(?i)[a-z][a-z0-9+.-]*://")
    url_re = r"^(?i)[a-z][a-z0-9+.-]*://(?:[^@/]+@)?([^/:]+)(?::[0-9]+)?/(.+)\z"
    scp_re = r"^(?:[^@/]+@)?([^/:]+):(.+)\z"

    def joined(pattern: str) -> Column:
        host = F.lower(F.regexp_extract(raw, pattern, 1))
        tail = F.regexp_replace(F.regexp_extract(raw, pattern, 2), r"(?i)^/+|(?:\.git)?/*\z", "")
        return F.concat(host, F.lit("/"), tail)

    return (
        F.when(raw.rlike(url_re), joined(url_re))
        .when(~has_scheme & raw.rlike(scp_re), joined(scp_re))
        .otherwise(raw)
    )


def id_of(identifier: Column) -> Column:
    return F.substring(F.sha2(identifier, 256), 1, 16)


def repo_id(remote: Column) -> Column:
    return id_of(canonical_remote(remote))


def repo_id_legacy(remote: Column) -> Column:
    """Identifier of the older scheme: hash of the remote as written."""
    return id_of(remote)
