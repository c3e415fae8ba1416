"""What the review screens show, one frame each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalore.functions.clock import relative_time
from catalore.functions.names import qualified_name, status_color
from catalore.functions.text import title_label
from catalore.operators.items import changed_history, recent
from catalore.operators.metrics import chart_counts, summary_stats


def _listed(newest: DataFrame, time: str, as_of: datetime | Column) -> DataFrame:
    return newest.select(
        "id",
        qualified_name().alias("full_name"),
        "metadata_type",
        "status",
        status_color(F.col("status")).alias("status_color"),
        relative_time(F.col(time), as_of).alias("when"),
        "reviewed_by",
        "generation_method",
    )


def recent_activity(items: DataFrame, as_of: datetime | Column, n: int = 10) -> DataFrame:
    """The newest items by creation; items without a time come first, as in the store."""
    return _listed(recent(items, "created_at", n, nulls_first=True), "created_at", as_of)


def activity_timeline(items: DataFrame, as_of: datetime | Column, n: int = 20) -> DataFrame:
    """The latest updated items; items without a time come last."""
    return _listed(recent(items, "updated_at", n), "updated_at", as_of)


def dashboard(items: DataFrame, as_of: datetime | Column) -> dict[str, DataFrame]:
    stats = summary_stats(items)
    return {
        "summary": stats,
        "chart": chart_counts(stats),
        "recent": recent_activity(items, as_of),
    }


def history_details(history: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Changed history rows with their headings."""
    return changed_history(history).select(
        "id",
        "metadata_item_id",
        F.concat(title_label(F.col("action")), F.lit(" by "), "user_name").alias("heading"),
        relative_time(F.col("timestamp"), as_of).alias("when"),
        "old_value",
        "new_value",
        "comment",
    )
