"""Line classification: CODE, COMMENT and (optionally) MIXED.

A block comment is a two-state automaton over the lines of one file. Instead of shuffling every line
through a window, each line is reduced to one letter telling what it does to the state, and the
letters of a file form a short string. Runs of "inside a block" are then found with one regular
expression over that string, so the whole step stays a narrow, JVM-side projection of the file row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.functions.exprs import let
from siftlake.functions.paths import extension


@dataclass(frozen=True)
class Syntax:
    exts: tuple
    line: tuple = ()
    block: tuple = ()
    inline: tuple = ()
    magic: tuple = field(default=())


# Comment markers per extension family.
FAMILIES = [
    Syntax(("js", "mjs", "cjs", "ts", "jsx", "tsx"), ("//",), ("/*", "*/"), ("//",), ("//#", "//@")),
    Syntax(("cs", "go", "java", "kt", "rs", "bak", "old", "orig"), ("//",), ("/*", "*/"), ("//",)),
    Syntax(("php",), ("//", "#"), ("/*", "*/"), ("//", "#")),
    Syntax(("py",), ("#",), (), ("#",)),
    Syntax(("sh", "bash", "yml", "yaml"), ("#",), (), ("#",)),
    Syntax(("ps1",), ("#",), ("<#", "#>"), ("#",)),
    Syntax(("rb",), ("#",), ("=begin", "=end"), ("#",)),
    Syntax(("sql",), ("--",), ("/*", "*/"), ("--",)),
    Syntax(("ini", "cfg", "conf"), (";", "#"), (), (";", "#")),
    Syntax(("properties",), ("#", "!")),
    Syntax(("xml", "html", "aspx", "ascx", "master", "config"), (), ("<!--", "-->")),
    Syntax(("md",), ("#",)),
    Syntax(("bat", "cmd"), ("rem ", "rem\t", "::")),
]


def _starts_any(text: Column, prefixes) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | text.startswith(p)
    return cond


def _ltrim(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+", "")


def _line_prefix(trimmed: Column, s: Syntax) -> Column:
    text = F.lower(trimmed) if "bat" in s.exts else trimmed
    cond = _starts_any(text, s.line)
    return cond & ~_starts_any(trimmed, s.magic) if s.magic else cond


def inline_marker_regex(markers) -> str:
    """A marker outside quotes: plain characters and complete quoted runs may come before it.

    Inside quotes, a quote right after a backslash does not close the run.
    """
    alt = "|".join("".join("\\" + c if not c.isalnum() else c for c in m) for m in markers)
    quoted = "|".join(rf"{q}(?:[^{q}\\]|\\+[^\\])*+{q}" for q in "\"'`")
    return rf"^(?:(?!{alt})[^\"'`]|{quoted})*+(?:{alt})"


def _block_letters(lines: Column, s: Syntax) -> Column:
    """One letter per line: S opens, R closes, X does either depending on the state, N nothing."""
    opener, closer = s.block

    def letter(line: Column) -> Column:
        has_open = line.contains(opener)
        first_after = F.substr(line, F.instr(line, opener) + len(opener))
        opens = has_open & ~first_after.contains(closer)
        closes = line.contains(closer)
        return F.when(opens & closes, "X").when(opens, "S").when(closes, "R").otherwise("N")

    return F.array_join(F.transform(lines, letter), "")


def _inside_flags(letters: Column) -> Column:
    """String with `b` at lines that begin inside a block and `.` elsewhere.

    Outside, S or X opens a block that starts on the next line; inside, R or X closes it.
    """

    def body(code: Column) -> Column:
        outside = F.regexp_extract_all(code, F.lit("([^SX]*[SX]?)([^RX]*[RX]?)"), F.lit(1))
        inside = F.regexp_extract_all(code, F.lit("([^SX]*[SX]?)([^RX]*[RX]?)"), F.lit(2))
        runs = F.zip_with(
            outside, inside,
            lambda o, i: F.concat(F.repeat(F.lit("."), F.length(o)), F.repeat(F.lit("b"), F.length(i))),
        )
        return F.array_join(runs, "")

    return let(letters, body)


def _python_letters(lines: Column) -> Column:
    """One letter per line by what it does to the docstring state.

    D, S: starts an unclosed double or single triple quote (E, T: and holds the other kind too).
    o, p, q: starts and closes one on the same line (holding double, single, both kinds).
    d, s, b: holds double, single or both kinds further in. N: none of them.
    """
    dq, sq = '"""', "'''"

    def letter(line: Column) -> Column:
        t = _ltrim(line)
        starts_d, starts_s = t.startswith(dq), t.startswith(sq)
        rest = F.substr(t, F.lit(4))
        closed = F.when(starts_d, rest.contains(dq)).when(starts_s, rest.contains(sq)).otherwise(F.lit(False))
        holds_d, holds_s = line.contains(dq), line.contains(sq)
        return (
            F.when(starts_d & ~closed, F.when(holds_s, "E").otherwise("D"))
            .when(starts_s & ~closed, F.when(holds_d, "T").otherwise("S"))
            .when(starts_d | starts_s, F.when(holds_d & holds_s, "q").when(holds_d, "o").otherwise("p"))
            .when(holds_d & holds_s, "b")
            .when(holds_d, "d")
            .when(holds_s, "s")
            .otherwise("N")
        )

    return F.array_join(F.transform(lines, letter), "")


# Outside: D or E opens """ and S or T opens '''. Inside """ every line holding """ closes
# (D, E, T, o, q, b, d); inside ''' every line holding ''' closes (S, T, E, p, q, b, s).
_PY_RUN = "([^DEST]*)(?:([DE][^DEToqbd]*[DEToqbd]?)|([ST][^STEpqbs]*[STEpqbs]?))?"


def _python_flags(letters: Column) -> Column:
    """`c` docstring line (opening, inner or closing), `o` one-line docstring, `.` anything else."""

    def body(code: Column) -> Column:
        out = F.regexp_extract_all(code, F.lit(_PY_RUN), F.lit(1))
        dbl = F.regexp_extract_all(code, F.lit(_PY_RUN), F.lit(2))
        sgl = F.regexp_extract_all(code, F.lit(_PY_RUN), F.lit(3))
        runs = F.transform(
            F.arrays_zip(out.alias("a"), dbl.alias("b"), sgl.alias("c")),
            lambda z: F.concat(
                F.translate(F.translate(z["a"], "opq", "ccc"), "Ndsb", "...."),
                F.repeat(F.lit("c"), F.length(z["b"]) + F.length(z["c"])),
            ),
        )
        return F.array_join(runs, "")

    return let(letters, body)


def _family_kinds(lines: Column, s: Syntax, inline: bool) -> Column:
    """String of one kind letter per line (c comment, m mixed, . code) for one family."""
    marker = inline_marker_regex(s.inline) if inline and s.inline else None

    def plain(line: Column) -> Column:
        kind = F.when(_line_prefix(_ltrim(line), s), "c") if s.line else F.when(F.lit(False), "c")
        if marker:
            kind = kind.when(line.rlike(marker), "m")
        return kind.otherwise(".")

    if "py" in s.exts:
        return F.array_join(
            F.zip_with(
                lines, F.split(_python_flags(_python_letters(lines)), ""),
                lambda line, flag: F.when(flag == "c", "c").otherwise(plain(line)),
            ),
            "",
        )
    if not s.block:
        return F.array_join(F.transform(lines, plain), "")
    opener = s.block[0]

    def with_block(line: Column, flag: Column) -> Column:
        at = F.instr(line, opener)
        before = F.regexp_replace(F.substr(line, F.lit(1), F.greatest(at - 1, F.lit(0))), r"\s+", "")
        return (
            F.when(flag == "b", "c")
            .when((at > 0) & (before == ""), "c")
            .when(at > 0, "m" if inline else ".")
            .otherwise(plain(line))
        )

    flags = F.split(_inside_flags(_block_letters(lines, s)), "")
    return F.array_join(F.zip_with(lines, flags, with_block), "")


def line_kinds(content: Column, ext: Column, inline: bool = False) -> Column:
    """One letter per line of the file: c COMMENT, m MIXED, `.` CODE; null for unknown extensions."""

    def body(lines: Column) -> Column:
        kinds = F.when(F.lit(False), F.lit(""))
        for s in FAMILIES:
            kinds = kinds.when(ext.isin(list(s.exts)), _family_kinds(lines, s, inline))
        return kinds

    return let(F.split(content, "\n"), body)


def kind_name(letter: Column) -> Column:
    return F.when(letter == "c", "COMMENT").when(letter == "m", "MIXED").otherwise("CODE")


def comment_lines(files: DataFrame, inline: bool = False) -> DataFrame:
    """lines(repo_id, path, line, raw, line_type): one row per line, no shuffle."""
    with_kinds = files.withColumn(
        "_kinds", line_kinds(F.col("content"), extension(F.col("path")), inline)
    )
    kinds = F.split(F.coalesce(F.col("_kinds"), F.lit("")), "")
    zipped = F.arrays_zip(F.split("content", "\n").alias("raw"), kinds.alias("kind"))
    rows = with_kinds.select("repo_id", "path", F.posexplode(zipped).alias("pos", "item"))
    return rows.select(
        "repo_id", "path", (F.col("pos") + 1).alias("line"), F.col("item.raw").alias("raw"),
        kind_name(F.col("item.kind")).alias("line_type"),
    )


def comment_stats(files: DataFrame, inline: bool = False) -> DataFrame:
    """Number of comment and mixed lines per file, counted on the kinds string."""
    kinds = F.coalesce(line_kinds(F.col("content"), extension(F.col("path")), inline), F.lit(""))
    out = files.select("repo_id", "path", kinds.alias("_k"))
    return out.select(
        "repo_id", "path",
        (F.length("_k") - F.length(F.translate("_k", "c", ""))).cast("bigint").alias("comment_lines"),
        (F.length("_k") - F.length(F.translate("_k", "m", ""))).cast("bigint").alias("mixed_lines"),
    )
