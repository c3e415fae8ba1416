"""Names, labels and lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalore.schemas import DEFAULT_STATUS_COLOR, STATUS_COLORS


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_default(c: Column, default: str) -> Column:
    """``default`` where the value is missing or empty."""
    return F.coalesce(blank_to_null(c), F.lit(default))


def qualified_name(with_column: bool = True) -> Column:
    parts = [F.col("catalog_name"), F.col("schema_name"), F.col("table_name")]
    if with_column:
        parts.append(blank_to_null(F.col("column_name")))  # concat_ws skips NULL
    return F.concat_ws(".", *parts)


def quote_identifier(c: Column) -> Column:
    """Backtick-quote names that are not plain, so plain names stay as they are."""
    quoted = F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))
    return F.when(c.rlike("^[A-Za-z0-9_]+$"), c).otherwise(quoted)


def lookup(c: Column, mapping: Mapping[str, str], default: str) -> Column:
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def status_color(c: Column) -> Column:
    return lookup(c, STATUS_COLORS, DEFAULT_STATUS_COLOR)


def is_column_level() -> Column:
    return blank_to_null(F.col("column_name")).isNotNull()


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, one decimal, halves to even; NULL when there is nothing."""
    return F.when(whole > 0, F.bround(part * F.lit(100.0) / whole, 1))
