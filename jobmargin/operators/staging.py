"""Raw tables to typed, consistently named columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame

from jobmargin.functions.casts import is_text_rule, trimmed, typed
from jobmargin.sources.schemas import RAW_TABLES, require_columns


def trimmed_texts(table: str, raw: DataFrame) -> DataFrame:
    """The declared columns of ``raw``; those that are read by their text come trimmed, as strings.

    A projection of its own: Spark keeps it apart from the casts above it, so that a text is trimmed once.
    """
    types = dict(raw.dtypes)
    columns = {f.source: f"`{f.source}`" for f in RAW_TABLES[table]}
    for field in RAW_TABLES[table]:
        if is_text_rule(field.kind, types[field.source]):
            columns[field.source] = f"{trimmed(columns[field.source], types[field.source])} as `{field.source}`"
    return raw.selectExpr(*columns.values())


def stage(table: str, raw: DataFrame) -> DataFrame:
    """Apply the declared casts and renames of ``table``; projections only.

    Typed columns pass through as they are, so a filter on a staged date or id is pushed to the files.
    """
    require_columns(table, raw.columns)
    raw = trimmed_texts(table, raw)
    types = dict(raw.dtypes)
    return raw.selectExpr([f"{typed(f'`{f.source}`', f.kind, types[f.source])} as {f.name}" for f in RAW_TABLES[table]])


class Staged(Mapping[str, DataFrame]):
    """Typed tables by name, staged on first use from a mapping of raw tables."""

    def __init__(self, raw: Mapping[str, DataFrame]):
        self._raw, self._done = raw, {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._done:
            if table not in self._raw:
                raise KeyError(f"no raw table {table!r}; have {sorted(self._raw)}")
            self._done[table] = stage(table, self._raw[table])
        return self._done[table]

    def __iter__(self) -> Iterator[str]:
        return iter(self._raw)

    def __len__(self) -> int:
        return len(self._raw)
