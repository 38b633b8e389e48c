"""Literals that every match of a pattern must contain, and one automaton that finds the literals of many patterns.

A pattern's syntax tree tells which texts a match cannot do without: those of a sequence are all needed, so the best one
counts; of alternatives each gives its own; what may be absent gives none. The literals of all rules become one
expression in the form of a prefix tree, so a text is read once for all rules. Literals only choose which rules
are tried; a pattern without a literal is always tried.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as sre, _parser  # the standard library's own tree of a pattern

from pyspark.sql import Column, functions as F

from siftlake.functions.exprs import any_contains, constant

#: Alternatives of one pattern; with more it is always tried.
MOST = 64
#: Characters of a class that are spelled out.
SPELLED = 4


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """Of two sets, one of whose literals each must be there, the more telling one."""
    if a is None or b is None:
        return b if a is None else a
    rank = lambda s: (min(len(x) for x in s), -len(s))
    return max(a, b, key=rank)


def _characters(op, arg) -> frozenset | None:
    """The characters of a one-character node, lower-cased, if they are few."""
    if op is sre.LITERAL:
        return frozenset(chr(arg).lower()) if arg < 128 else None
    if op is not sre.IN or any(o not in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        return None
    out = {c for o, a in arg for c in (range(a, a + 1) if o is sre.LITERAL else range(a[0], a[1] + 1))}
    got = frozenset(chr(c).lower() for c in out) if len(out) <= 2 * SPELLED and max(out) < 128 else frozenset()
    return got if 0 < len(got) <= SPELLED else None


def _of_sequence(nodes) -> frozenset | None:
    best, runs = None, frozenset([""])

    def close():
        nonlocal best, runs
        if runs != frozenset([""]):
            best = _better(best, runs)
        runs = frozenset([""])

    for op, arg in nodes:
        if op is sre.SUBPATTERN and len(arg[3]) == 1 and arg[3][0][0] in (sre.LITERAL, sre.IN):
            op, arg = arg[3][0]
        if op is sre.MAX_REPEAT and arg[0] == arg[1] == 1 and len(arg[2]) == 1:
            op, arg = arg[2][0]
        chars = _characters(op, arg)
        if chars is not None and len(runs) * len(chars) <= SPELLED:
            runs = frozenset(x + c for x in runs for c in chars)
            continue
        if op is sre.AT:
            continue
        close()
        if chars is not None:
            runs = chars
            continue
        best = _better(best, _of_node(op, arg))
    close()
    return best


def _of_node(op, arg) -> frozenset | None:
    if op is sre.SUBPATTERN:
        return _of_sequence(arg[3])
    if op is sre.ATOMIC_GROUP:
        return _of_sequence(arg)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        return _of_sequence(arg[2]) if arg[0] > 0 else None
    if op is sre.ASSERT:
        return _of_sequence(arg[1])
    if op is sre.BRANCH:
        parts = [_of_sequence(branch) for branch in arg[1]]
        if all(p is not None for p in parts):
            return frozenset().union(*parts)
    return None


def required(pattern: str) -> frozenset[str]:
    """Lower-case literals of which every match contains one; empty if there are none, or too many."""
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError):
        return frozenset()
    got = _of_sequence(tree) or frozenset()
    got = frozenset(x for x in got if not any(y != x and y in x for y in got))
    return got if len(got) <= MOST else frozenset()


def has_group(pattern: str) -> bool:
    """Whether a pattern surely has a group 1."""
    try:
        return _parser.parse(pattern).state.groups > 1
    except (re.error, OverflowError):
        return False


_SPECIAL = re.compile(r"([^A-Za-z0-9_ /\"'<>=:;,@#%&!~`-])")


def _tree(words: list[str]) -> str:
    """Expression of sorted distinct words; the longest one that begins here is matched."""
    if words == [""]:
        return ""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    branches = [_SPECIAL.sub(r"\\\1", c) + _tree(rest) for c, rest in heads.items()]
    body = branches[0] if len(branches) == 1 and "" not in words else "(?:" + "|".join(branches) + ")"
    return body + "?" if "" in words else body


def _first_class(words: Iterable[str]) -> str:
    return "[" + "".join(sorted({re.sub(r"([\\\]\[^&-])", r"\\\1", w[0]) for w in words})) + "]"


def automaton(words: Iterable[str]) -> str:
    """Expression that gives, at each place where one of the words begins, the longest such word as group 1."""
    words = sorted(set(words))
    return f"(?={_first_class(words)})(?=({_tree(words)}))"


def literals_in(lowered: Column, words: Iterable[str]) -> Column:
    """The distinct words that stand in a lower-cased text; of words that begin at one place, the longest."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(automaton(words)), F.lit(1)))


def owners(needs: dict[int, frozenset[str]]) -> dict[str, list[int]]:
    """literal -> the patterns that it, or a literal it begins with, admits."""
    words = {w for ws in needs.values() for w in ws}
    return {w: sorted(k for k, ws in needs.items() if any(w.startswith(x) for x in ws)) for w in sorted(words)}


def admitted(lowered: Column, needs: dict[int, frozenset[str]]) -> Column:
    """array<int> of the patterns of which a text has a needed literal; a pattern without any is not listed.

    Single characters stand nearly everywhere; they are looked for by themselves, up to their first place."""
    single = {k: v for k, v in needs.items() if any(len(w) == 1 for w in v)}
    table = owners({k: v for k, v in needs.items() if v and k not in single})
    parts = [F.array_compact(F.array(*[F.when(any_contains(lowered, sorted(v)), F.lit(k)) for k, v in single.items()]))] if single else []
    if table:
        lists = constant(table, "map<string,array<int>>")
        parts.append(F.flatten(F.transform(literals_in(lowered, table), lambda w: F.element_at(lists, w))))
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<int>")
