"""Staging that sets malformed rows aside instead of stopping at the first one.

``stage`` raises on a malformed required text, which is right for a run that must not lose a row. Here every row is read
with the same rules, good rows go on, and each malformed text becomes a row of its own: table, row, column, text and
reason. Both come from one pass over the raw table, written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from jobmargin.functions.casts import from_text, is_text_rule, typed
from jobmargin.operators.staging import trimmed_texts
from jobmargin.sources.schemas import RAW_TABLES, require_columns
from jobmargin.sources.writers import write_parquet

REJECTED = "table_name string, row_key string, column_name string, text string, reason string"


@dataclass(frozen=True)
class Intake:
    """The typed good rows of a table, and what is wrong with the others."""

    accepted: DataFrame
    rejected: DataFrame


def checked(table: str, raw: DataFrame) -> DataFrame:
    """The staged columns of every row, NULL where malformed, and ``faults``: column, text and reason."""
    require_columns(table, raw.columns)
    fields = RAW_TABLES[table]
    raw = trimmed_texts(table, raw)
    types = dict(raw.dtypes)
    values, faults = [], []
    for field in fields:
        column = f"`{field.source}`"
        if not is_text_rule(field.kind, types[field.source]) or field.kind.startswith("optional_"):
            values.append(f"{typed(column, field.kind, types[field.source])} as {field.name}")
            continue
        value = from_text(column, field.kind)
        values.append(f"{value} as {field.name}")
        reason = f"if({column} = '', 'blank', 'not a {field.kind}')"
        fault = f"struct('{field.source}' as column_name, {column} as text, {reason} as reason)"
        faults.append(f"if({column} is not null and {value} is null, {fault}, null)")
    listed = f"filter(array({', '.join(faults)}), fault -> fault is not null)" if faults else "array()"
    kind = "array<struct<column_name: string, text: string, reason: string>>"
    key = f"cast(`{fields[0].source}` as string) as row_key"
    return raw.selectExpr(*values, key, f"cast({listed} as {kind}) as faults")


def take_in(table: str, raw: DataFrame, folder: str) -> Intake:
    """Read ``raw`` once, write it below ``folder`` with good and malformed rows apart, and return both."""
    judged = checked(table, raw).withColumn("is_good", F.size("faults") == 0)
    stored = write_parquet(judged, f"{folder}/{table}", partition_by="is_good")
    accepted = stored.filter("is_good").drop("is_good", "row_key", "faults")
    faults = stored.filter("not is_good").select(F.lit(table).alias("table_name"), "row_key", F.explode("faults").alias("fault"))
    return Intake(accepted, faults.select("table_name", "row_key", "fault.*"))
