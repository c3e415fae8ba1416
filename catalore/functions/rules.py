"""Validation rules. Each gives the message of the failure, or NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalore.functions.text import has_words, strip, title_label
from catalore.schemas import METADATA_TYPES, STORE_LENGTHS, STORE_NOT_NULL, UPLOAD_REQUIRED


# The messages below are fixed values: callers match them word by word.


def failures(*messages: Column) -> Column:
    """The messages that are not NULL, in order."""
    return F.array_compact(F.array(*messages))


def value_error(
    value: Column, metadata_type: Column, max_length: int = 5000, min_words: int = 3
) -> Column:
    """First failing rule of a description text, NULL when it passes."""
    label = title_label(metadata_type)
    empty = F.coalesce(strip(value), F.lit("")) == ""
    return (
        F.when(empty, F.concat(label, F.lit(" cannot be empty")))
        .when(
            F.length(value) > max_length,
            F.concat(label, F.lit(f" is too long (max {max_length} characters)")),
        )
        .when(
            (metadata_type == "comment") & ~has_words(value, min_words),
            F.lit(f"Comments should be more descriptive (at least {min_words} words)"),
        )
    )


def valid_metadata_type(c: Column) -> Column:
    """A missing type is not valid."""
    return F.coalesce(c.isin(METADATA_TYPES), F.lit(False))


def required_errors() -> list[Column]:
    return [
        F.when(F.col(name).isNull(), F.lit(f"Column '{name}' contains empty values"))
        for name in UPLOAD_REQUIRED
    ]


def metadata_type_error() -> Column:
    allowed = ", ".join(f"'{name}'" for name in METADATA_TYPES)
    return F.when(
        ~valid_metadata_type(F.col("metadata_type")),
        F.concat(
            F.lit("Invalid metadata_type values: ['"),
            F.coalesce(F.col("metadata_type"), F.lit("nan")),
            F.lit(f"']. Must be one of: [{allowed}]"),
        ),
    )


def length_errors(columns: list[str]) -> list[Column]:
    return [
        F.when(F.length(name) > limit, F.lit(f"{name} is longer than {limit}"))
        for name, limit in STORE_LENGTHS.items()
        if name in columns
    ]


def upload_errors(columns: list[str]) -> Column:
    """Upload rules and the store's limits: a row without errors will be stored."""
    return failures(*required_errors(), metadata_type_error(), *length_errors(columns))


def store_errors(columns: list[str]) -> Column:
    """Store limits: texts that are missing or too long for their column."""
    missing = [
        F.when(F.col(name).isNull(), F.lit(f"{name} is missing"))
        for name in STORE_NOT_NULL
        if name in columns
    ]
    return failures(*missing, *length_errors(columns))
