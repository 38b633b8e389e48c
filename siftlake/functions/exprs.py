"""Small Column builders shared by the operators."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

CHUNK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` to a lambda variable so `body` can use it many times, evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_contains(text: Column, needles: Iterable[str]) -> Column:
    """True when `text` contains at least one of the literal needles."""
    cond = F.lit(False)
    for needle in needles:
        cond = cond | text.contains(needle)
    return cond


def any_rlike(text: Column, patterns: Iterable[str]) -> Column:
    cond = F.lit(False)
    for pattern in patterns:
        cond = cond | text.rlike(pattern)
    return cond


def map_literal(mapping: dict, key: Column, default=None) -> Column:
    """Look a key up in a small constant mapping, as one literal map."""
    flat = []
    for k, v in mapping.items():
        flat += [F.lit(k), F.lit(v)]
    found = F.try_element_at(F.create_map(*flat), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def constant(value, schema: str) -> Column:
    """A constant table (lists, dicts, plain values) as one literal, however many entries it has."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def sql_text(value: str) -> str:
    """A text as a literal of an SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def str_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("bigint")


def percent(part: Column, total: Column) -> Column:
    """Whole percent, rounded half up; 0 when the total is 0."""
    return F.when(total == 0, F.lit(0).cast("bigint")).otherwise(
        round_half_up(F.lit(100.0) * part / F.nullif(total, F.lit(0)))
    )


def _fold_running(values: Column, start: Column) -> Column:
    """Running totals *before* each element of a short array."""
    init = F.struct(start.cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, v: F.struct(
        (acc["total"] + v).cast("bigint").alias("total"),
        F.concat(acc["out"], F.array(acc["total"])).alias("out"),
    )
    return F.aggregate(values, init, step, lambda acc: acc["out"])


def running_before(values: Column) -> Column:
    """Exclusive running totals of array<bigint>.

    A plain fold that appends to an array copies it on every step, so its cost is quadratic. Here the
    array is cut into fixed chunks: totals of the chunks are accumulated first, then each chunk is
    folded from its own start. The work stays close to linear for arrays of any length.
    """

    def body(vals: Column) -> Column:
        n_chunks = F.ceil(F.size(vals) / F.lit(float(CHUNK))).cast("int")
        chunks = F.when(F.size(vals) == 0, F.array().cast("array<array<bigint>>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0))),
                lambda c: F.slice(vals, c * CHUNK + 1, F.lit(CHUNK)),
            )
        )

        def with_chunks(chs: Column) -> Column:
            totals = F.transform(
                chs, lambda ch: F.aggregate(ch, F.lit(0).cast("bigint"), lambda a, v: a + v)
            )
            starts = _fold_running(totals, F.lit(0))
            return F.flatten(F.zip_with(chs, starts, lambda ch, s: _fold_running(ch, s)))

        return let(chunks, with_chunks)

    return let(values, body)


def plus_days(ts: Column, days) -> Column:
    """An instant moved by days of exactly 24 hours, whatever the session's zone does in between."""
    days = F.lit(days) if isinstance(days, int) else days
    return F.timestamp_micros(F.unix_micros(ts) + days.cast("bigint") * 86_400_000_000)


def count_newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")
