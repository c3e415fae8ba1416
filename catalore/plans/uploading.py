"""Upload run: file rows -> checks -> items."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame

from catalore.operators.upload import accepted
from catalore.sources.store import to_items


def upload_items(upload: DataFrame, user: str, as_of: datetime | Column) -> DataFrame:
    """Items of the accepted rows; the store can hold every one of them."""
    return to_items(accepted(upload), user, as_of)
