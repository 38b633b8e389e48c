"""Severity scale, ranks and weights."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftlake.functions.exprs import map_literal

# Fixed values.
SCORES = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "EXPOSURE": 1, "INFO": 0}
NAMES = {4: "CRITICAL", 3: "HIGH", 2: "MEDIUM", 1: "EXPOSURE", 0: "INFO"}
RANKS = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "EXPOSURE": 3, "INFO": 4}
WEIGHTS = {"CRITICAL": 10, "HIGH": 5, "MEDIUM": 2, "EXPOSURE": 1, "INFO": 0}
ORDER = ["CRITICAL", "HIGH", "MEDIUM", "EXPOSURE", "INFO"]


def score(sev: Column) -> Column:
    """Score for arithmetic; unknown severities (LOW among them) start from 0."""
    return map_literal(SCORES, sev, 0)


def rank(sev: Column) -> Column:
    """Sort rank, most severe first; unknown severities come last (9)."""
    return map_literal(RANKS, sev, 9)


def weight(sev: Column) -> Column:
    return map_literal(WEIGHTS, sev, 0)


def from_score(score_col: Column) -> Column:
    clamped = F.greatest(F.lit(0), F.least(F.lit(4), score_col)).cast("int")
    return F.element_at(F.array(*[F.lit(NAMES[i]) for i in range(5)]), clamped + 1)
