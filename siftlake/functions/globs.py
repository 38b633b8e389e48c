"""Globs as columns: patterns cut into tokens, matched by the set of places they can reach in a text.

`**` stands for any text of one line, `*` for any text without a slash, `?` for one character that is no slash; all else
stands for itself. Nothing is compiled per pattern: a token moves a set of places in the text, so the work for a
path is its length times the number of tokens, whatever the pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN = r"\*\*|\*|\?|[^*?]+"
LINE_ENDS = "\r\u0085\u2028\u2029"


def tokens(pattern: Column) -> Column:
    return F.regexp_extract_all(pattern, F.lit(TOKEN), F.lit(0))


def has_wildcard(pattern: Column) -> Column:
    return pattern.contains("*") | pattern.contains("?")


def _next(text: Column, stop: str, at: Column) -> Column:
    """Places from `at` to the next `stop` or the end."""
    found = F.call_function("locate", F.lit(stop), text, at + 1)
    return F.sequence(at, F.when(found == 0, F.length(text)).otherwise(found - 1))


def glob_ends(text: Column, toks: Column, starts: Column) -> Column:
    """Places (characters before them) that the tokens can reach in `text` from any of the starts."""
    lines = F.translate(text, LINE_ENDS, "\n" * len(LINE_ENDS))
    reach = lambda places, stop, over: F.array_distinct(F.flatten(F.transform(places, lambda p: _next(over, stop, p))))
    here = lambda p, n: F.substr(text, p + 1, n)

    def step(places: Column, tok: Column) -> Column:
        one = F.filter(places, lambda p: (p < F.length(text)) & (here(p, F.lit(1)) != "/"))
        same = F.filter(places, lambda p: here(p, F.length(tok)) == tok)
        return (
            F.when(tok == "**", reach(places, "\n", lines)).when(tok == "*", reach(places, "/", text))
            .when(tok == "?", F.transform(one, lambda p: p + 1)).otherwise(F.transform(same, lambda p: p + F.length(tok)))
        )

    return F.aggregate(toks, starts, step)


def glob_whole(text: Column, toks: Column) -> Column:
    """Whether the tokens match the whole text."""
    return F.array_contains(glob_ends(text, toks, F.array(F.lit(0))), F.length(text))


def glob_entry(text: Column, toks: Column, anchored: Column) -> Column:
    """Whether the tokens match a run of whole path entries: from the start if anchored, else from any entry on."""
    after_slash = F.filter(F.sequence(F.lit(0), F.length(text)), lambda p: (p == 0) | (F.substr(text, p, F.lit(1)) == "/"))
    starts = F.when(anchored, F.array(F.lit(0))).otherwise(after_slash)
    return F.exists(glob_ends(text, toks, starts), lambda p: (p == F.length(text)) | (F.substr(text, p + 1, F.lit(1)) == "/"))
