"""Guarded arithmetic, extreme picks and NULL-last ordering.

Formulas are SQL expressions for ``selectExpr`` and ``agg(*expressions(...))``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def expressions(named: Mapping[str, str]) -> list[Column]:
    """``{name: SQL expression}`` as named columns."""
    return [F.expr(f"{sql} as {name}") for name, sql in named.items()]


def ratio(numerator: str, denominator: str) -> str:
    """NULL where the denominator is zero or NULL."""
    return f"try_divide({numerator}, {denominator})"


def total(value: str) -> str:
    """Sum that is 0, not NULL, over no or only NULL values (dashboard totals)."""
    return f"coalesce(sum({value}), 0D)"


def lowest(score: str, name: str, *carry: str, among: str = "true") -> str:
    """Aggregate: the row with the smallest ``score``, as a struct of name, score and ``carry``.

    Rows without a score come last and equal scores go to the smaller name, so the pick is
    deterministic and needs neither a sort nor a window. ``among`` restricts the rows.
    """
    return _first(score, score, name, carry, among)


def highest(score: str, name: str, *carry: str, among: str = "true") -> str:
    """Aggregate: like ``lowest`` for the largest ``score``."""
    return _first(f"-{score}", score, name, carry, among)


def _first(rank: str, score: str, name: str, carry: tuple[str, ...], among: str) -> str:
    fields = [f"coalesce({rank}, double('inf')) as rank", f"{name} as name", f"{score} as score", *carry]
    return f"min(struct({', '.join(fields)})) filter (where {among})"


def ascending(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def descending(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def descending_last(*columns: str) -> list[Column]:
    """The exact reverse of ``ascending``: NULLs first."""
    return [F.col(c).desc_nulls_first() for c in columns]
