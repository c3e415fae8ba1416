"""Joins whose left side may have most of its rows under few keys.

Spark splits skewed partitions of a join at run time only where both sides come
straight out of a shuffle for that join; after an aggregate or another join on the
same keys they do not. Here the split is part of the plan: keys with very many rows
are counted, their rows are spread over as many salts as they need, and the rows of
the other side are repeated once per salt. Every match stays, none is added.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalore.session import estimated_bytes

ROWS_PER_SPLIT = 1_000_000


_FORCED: ContextVar[int | None] = ContextVar("rows_per_split", default=None)


@contextmanager
def splitting(rows_per_split: int) -> Iterator[None]:
    """Joins built inside are salted at so many rows per split, small sides too."""
    token = _FORCED.set(rows_per_split)
    try:
        yield
    finally:
        _FORCED.reset(token)


def will_broadcast(df: DataFrame) -> bool:
    """Whether the estimated size is within the limit up to which Spark broadcasts."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return estimated_bytes(df) <= limit


# Keys that are split at most: a key counts as hot only with this share of all rows.
MOST_HOT_KEYS = 10_000


def hot_keys(df: DataFrame, keys: list[str], rows_per_split: int) -> DataFrame:
    """Keys with more rows than one split holds, and the splits they need.

    A split grows with the table, so that at most MOST_HOT_KEYS keys qualify at any size.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    share = df.select((F.count(F.lit(1)) / F.lit(MOST_HOT_KEYS)).alias("share")).scalar()
    rows_per_split = F.greatest(F.lit(float(rows_per_split)), share)
    return counted.where(F.col("_rows") > rows_per_split).select(
        *keys, F.ceil(F.col("_rows") / rows_per_split).cast("int").alias("_splits")
    )


def join_spread(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    spread_by: str,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """``left.join(right, keys, how)`` with the hot keys of ``left`` split.

    ``how`` is inner, left, left_semi or left_anti; ``right`` has few rows per key.
    ``spread_by`` names a column of ``left`` that differs from row to row; the other
    columns settle rows in which it is NULL or repeated.
    """
    forced = _FORCED.get()
    rows_per_split = forced or rows_per_split
    if forced is None and will_broadcast(right):
        return left.join(right, keys, how)
    # At most MOST_HOT_KEYS rows.
    hot = F.broadcast(hot_keys(left, keys, rows_per_split))
    missing = reduce(Column.__or__, [F.col(key).isNull() for key in keys])
    hashable = [f.name for f in left.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    mark = F.xxhash64(spread_by, *(F.col(f"`{n}`") for n in hashable if n != spread_by))
    # Rows with a missing key match nothing, so any salt will do for them.
    salt = (
        F.when(F.col("_splits").isNotNull(), F.pmod(mark, F.col("_splits")))
        .when(missing, mark)
        .otherwise(0)
        .cast("bigint")
    )
    salts = F.sequence(
        F.lit(0).cast("bigint"), (F.coalesce("_splits", F.lit(1)) - 1).cast("bigint")
    )
    salted = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_splits")
    repeated = right.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_splits")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
