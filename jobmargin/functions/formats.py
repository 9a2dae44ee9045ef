"""Display text for KPI cards, as SQL expressions. Rounding is half-even."""

from __future__ import annotations


def number(value: str, pattern: str) -> str:
    return f"format_number(cast({value} as double), '{pattern}')"


def money(value: str) -> str:
    """``$1.23M``, ``$12K`` or ``$999``; the sign follows the dollar sign."""
    millions, thousands = number(f"{value} / 1000000", "#,##0.00"), number(f"{value} / 1000", "#,##0")
    return (
        f"'$' || case when abs({value}) >= 1000000 then {millions} || 'M' "
        f"when abs({value}) >= 1000 then {thousands} || 'K' else {number(value, '#,##0')} end"
    )


def whole_dollars(value: str) -> str:
    return f"'$' || {number(value, '#,##0')}"


def percent(value: str) -> str:
    return f"{number(f'{value} * 100', '0.0')} || '%'"


def points(value: str) -> str:
    """A gap already in percentage points, with its sign: ``+1.5 pts``."""
    return f"{number(value, '+0.0;-0.0')} || ' pts'"
