"""Rules are written for an ASCII-word regex dialect; these helpers adapt them to java.util.regex."""

from __future__ import annotations

import re

_WORD = "[A-Za-z0-9_]"
# Java's \b treats accented letters as word characters; rules expect the ASCII meaning.
ASCII_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


_STARTS_AT_WORD = re.compile(r"^\\b(\w+)(?![?*+{])")


def _boundary(before: str, after: str) -> str:
    """ASCII form of one `\\b`, cheaper when the neighbouring pattern text tells which side is the word."""
    word_before = bool(re.search(r"(?:(?<!\\)[A-Za-z0-9_]|\\w)\Z", before))
    word_after = bool(re.match(r"[A-Za-z0-9_]", after))
    if word_before and not word_after:
        return f"(?!{_WORD})"
    if word_after and not word_before and (before == "" or before[-1] in "(|:"):
        return f"(?<!{_WORD})"
    return ASCII_BOUNDARY


def java_pattern(pattern: str, flags: str = "") -> str:
    """Pattern text for Spark's regex functions: ASCII word boundaries plus inline flags.

    A leading boundary is checked after the literal that follows it, so that the matcher can search for
    the literal first instead of testing a boundary at every position of the text.
    """
    out, i, in_class = [], 0, False
    lead = _STARTS_AT_WORD.match(pattern)
    if lead and len(lead.group(1)) > 1:
        word = lead.group(1)
        out.append(f"{word}(?<!{_WORD}{word})")
        i = lead.end()
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two.startswith("\\"):
            out.append(_boundary(pattern[:i], pattern[i + 2 :]) if two == r"\b" and not in_class else two)
            i += 2
            continue
        if two[0] == "[":
            in_class = True
        elif two[0] == "]":
            in_class = False
        out.append(two[0])
        i += 1
    inline = "".join(f for f in "ims" if f in flags)
    return (f"(?{inline})" if inline else "") + "".join(out)


def literal_alternation(literals) -> str:
    """Regex that finds any of the literals."""
    return "|".join(re.sub(r"([^A-Za-z0-9_/])", r"\\\1", x) for x in literals)
