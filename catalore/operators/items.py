"""Reading items and history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalore.functions.clock import relative_time
from catalore.functions.genmeta import parse_generation, sample_text
from catalore.functions.names import (
    blank_to_null,
    is_column_level,
    or_default,
    qualified_name,
    status_color,
)
from catalore.functions.text import name_matches
from catalore.operators.skew import join_spread
from catalore.schemas import APPROVED_STATUSES, ITEMS


def newest_first(time: str, nulls_first: bool = True) -> list[Column]:
    """Descending time with the null order spelled out; ``id`` breaks ties."""
    by_time = F.desc_nulls_first(time) if nulls_first else F.desc_nulls_last(time)
    return [by_time, F.desc("id")]


def filter_items(
    items: DataFrame,
    status: str | None = None,
    table_name: str | None = None,
    catalog_name: str | None = None,
    schema_name: str | None = None,
) -> DataFrame:
    """Equality filters; None or '' means no filter. All of them reach the scan."""
    wanted = {
        "status": status,
        "table_name": table_name,
        "catalog_name": catalog_name,
        "schema_name": schema_name,
    }
    kept = items
    for name, value in wanted.items():
        if value:
            kept = kept.where(F.col(name) == value)
    return kept


def scan_items(items: DataFrame, **filters: str | None) -> DataFrame:
    """All item columns of the filtered items, newest first."""
    kept = filter_items(items, **filters).select(*ITEMS.fieldNames())
    return kept.orderBy(*newest_first("created_at"))


def recent(items: DataFrame, by: str, n: int, nulls_first: bool = False) -> DataFrame:
    """The n newest items by a time column (a top-n, never a full sort)."""
    return items.orderBy(*newest_first(by, nulls_first)).limit(n)


def expand_status(status: str) -> list[str]:
    return APPROVED_STATUSES if status == "all_approved" else [status]


def at_level(items: DataFrame, level: str) -> DataFrame:
    """Descriptions of columns (``level="column"``) or of tables (``level="table"``)."""
    described = items.where(F.col("metadata_type") == "description")
    return described.where(is_column_level() if level == "column" else ~is_column_level())


def approved_items(
    items: DataFrame,
    catalog: str | None = None,
    schema: str | None = None,
    status: str = "approved",
    table_filter: str | None = None,
    level: str | None = None,
) -> DataFrame:
    """Approved descriptions in one scan: all filters combine into one predicate."""
    kept = filter_items(items, catalog_name=catalog, schema_name=schema)
    kept = kept.where(F.col("status").isin(expand_status(status)))
    if level:
        kept = at_level(kept, level)
    return kept.where(name_matches(F.col("table_name"), table_filter))


def history_of(history: DataFrame, item_id: int) -> DataFrame:
    """History of one item, newest first."""
    kept = history.where(F.col("metadata_item_id") == item_id)
    return kept.orderBy(*newest_first("timestamp"))


def item_history(history: DataFrame, item_ids: DataFrame) -> DataFrame:
    """History of a set of items, newest first."""
    ids = item_ids.select(F.col("id").alias("metadata_item_id")).distinct()
    kept = join_spread(history, ids, ["metadata_item_id"], "left_semi", spread_by="id")
    return kept.select(*history.columns).orderBy(*newest_first("timestamp"))


def items_with_history(items: DataFrame, history: DataFrame) -> DataFrame:
    """Each item with each of its history rows; items without history once.

    The history is the side that may be skewed, so it is joined from the left and
    the items without history come in by themselves.
    """
    log = history.select(
        F.col("metadata_item_id").alias("id"),
        F.col("id").alias("history_id"),
        "action",
        "old_value",
        "new_value",
        "user_name",
        "timestamp",
    )
    matched = join_spread(log, items, ["id"], "inner", spread_by="history_id")
    silent = items.join(log.select("id").distinct(), "id", "left_anti")
    return silent.unionByName(matched, allowMissingColumns=True)


def changed_history(history: DataFrame) -> DataFrame:
    """History rows whose value changed; two missing values are no change."""
    return history.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).withColumns(
        {
            "old_value": or_default(F.col("old_value"), "None"),
            "new_value": or_default(F.col("new_value"), "None"),
        }
    )


def review_queue(items: DataFrame, as_of: datetime | Column, **filters: str | None) -> DataFrame:
    """What a reviewer sees per item: names, labels, defaults, parsed metadata."""
    meta = parse_generation(F.col("generation_metadata"))
    shown = filter_items(items, **filters).withColumn("_meta", meta)
    name = qualified_name()
    return shown.orderBy(*newest_first("created_at")).select(
        "id",
        name.alias("full_name"),
        F.concat(
            name, F.lit(" ("), "metadata_type", F.lit(") - "), or_default(F.col("status"), "None")
        ).alias("title"),
        "status",
        status_color(F.col("status")).alias("status_color"),
        (F.coalesce(F.col("status"), F.lit("")) == "pending").alias("needs_review"),
        or_default(F.col("original_value"), "None").alias("original_value"),
        "generated_value",
        "current_value",
        "generation_method",
        F.col("_meta.model").alias("model"),
        F.col("_meta.tokens_used").alias("tokens_used"),
        F.col("_meta.cost_estimate").alias("cost_estimate"),
        F.col("_meta.error").alias("generation_error"),
        sample_text(blank_to_null(F.col("data_sample"))).alias("data_sample"),
        relative_time(F.col("created_at"), as_of).alias("created"),
        or_default(F.col("created_by"), "Unknown").alias("created_by"),
        "reviewed_by",
        F.when(
            blank_to_null(F.col("reviewed_by")).isNotNull(),
            relative_time(F.col("reviewed_at"), as_of),
        ).alias("reviewed"),
    )
