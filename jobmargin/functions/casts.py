"""Raw columns to declared kinds, as SQL expressions.

A column that already has the declared type passes through untouched, so that filters on it reach the files; one that
widens to it is cast. Only text goes through text rules: the whole text must have the shape of the type. Required casts
raise on any other text, whatever ``spark.sql.ansi.enabled`` says; optional ones turn blank or malformed text into
NULL. NULL stays NULL.
"""

from __future__ import annotations

WHOLE = "^[+-]?[0-9]{1,18}$"
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Date, then nothing or a time of day with an optional zone.
DATE = (
    r"^[0-9]{4,}-[0-9]{1,2}-[0-9]{1,2}"
    r"([T ][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}([.][0-9]+)?)?(Z|[+-][0-9]{1,2}(:?[0-9]{2})?)?)?$"
)

TARGETS = {"key": "bigint", "int": "int", "double": "double", "date": "date"}
# Column types that hold no value the target lacks.
WIDENS = {
    "bigint": ("int", "smallint", "tinyint"),
    "int": ("smallint", "tinyint"),
    "double": ("float", "bigint", "int", "smallint", "tinyint"),
    "date": ("timestamp", "timestamp_ntz"),
}


def trimmed(column: str, dtype: str = "string") -> str:
    """Text without the blanks around it; a blank text is empty, and no rule below accepts it."""
    return f"trim({column})" if dtype == "string" else f"trim(cast({column} as string))"


def optional_whole(text: str, target: str) -> str:
    """Whole number or NULL; '12.0' reads as 12 and '12.5' as 13. Decimals keep ids beyond 2**53 exact."""
    rounded = f"try_cast(round(try_cast({text} as decimal(38, 10))) as {target})"
    return f"case when {text} rlike '{WHOLE}' then try_cast({text} as {target}) when {text} rlike '{NUMBER}' then {rounded} end"


def optional_double(text: str) -> str:
    """Number or NULL; no type suffixes, NaN or infinities."""
    return f"case when {text} rlike '{NUMBER}' then try_cast({text} as double) end"


def optional_date(text: str) -> str:
    """Calendar date, NULL when blank, partial or malformed."""
    text = f"translate({text}, '/', '-')"
    return f"case when {text} rlike '{DATE}' then try_cast({text} as date) end"


def from_text(text: str, kind: str) -> str:
    """``text``, already trimmed, read as ``kind``; NULL where it is blank or malformed."""
    target = TARGETS[kind.removeprefix("optional_")]
    if target == "double":
        return optional_double(text)
    return optional_date(text) if target == "date" else optional_whole(text, target)


def is_text_rule(kind: str, dtype: str) -> bool:
    """Whether a column of this type must be read by its text."""
    if kind == "text":
        return False
    target = TARGETS[kind.removeprefix("optional_")]
    return dtype != target and dtype not in WIDENS[target] and not (target == "double" and dtype.startswith("decimal"))


def typed(column: str, kind: str, dtype: str = "string") -> str:
    """``column`` of type ``dtype`` as one of the kinds declared in ``sources.schemas``.

    A column for which ``is_text_rule`` holds must come in ``trimmed``.
    """
    if kind == "text":
        return column
    target = TARGETS[kind.removeprefix("optional_")]
    if dtype == target:
        return column
    if not is_text_rule(kind, dtype):
        return f"cast({column} as {target})"
    value = from_text(column, kind)
    if kind.startswith("optional_"):
        return value
    error = f"raise_error(concat('malformed value in {column.strip('`')}: ', {column}))"
    return f"case when {column} is not null then coalesce({value}, {error}) end"
