"""Row numbers without a single-task window.

A global ``row_number()`` sends every row through one task. Here the rows are
range-sorted once, kept in the shared folder so that partitions cannot move, and
each row's number is its position in the partition plus the row count of the
partitions before it. Only that offset table (one row per partition) is ordered
in one place. The order must be total, so that ties split across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalore.session import cut_lineage

# monotonically_increasing_id() holds the partition in the upper bits and the
# row position within it in the lower 33.
_POSITION_BITS = 33


def largest_id(stored: DataFrame | None) -> Column:
    """The largest id of a stored table, 0 without one; new ids follow it."""
    if stored is None:
        return F.lit(0)
    return stored.select(F.coalesce(F.max("id"), F.lit(0)).alias("largest")).scalar()


def partition_of(position: Column) -> Column:
    return F.shiftright(position, _POSITION_BITS)


def place_of(position: Column) -> Column:
    return position.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))


def fixed_order(df: DataFrame, order: list[str | Column], position: str) -> DataFrame:
    """``df`` range-sorted and materialised, with a ``position`` that encodes the order."""
    placed = df.orderBy(*order).withColumn(position, F.monotonically_increasing_id())
    return cut_lineage(placed)


def with_row_number(
    df: DataFrame, order: list[str | Column], name: str, key: str | None = None
) -> DataFrame:
    """``df`` with its row number in a total order.

    With a unique ``key`` only it and the order, then column names, are sorted and
    kept, and the numbers are joined back to the wide rows.
    """
    if key is not None:
        narrow = df.select(*dict.fromkeys([key, *order]))
        return df.join(with_row_number(narrow, order, name).select(key, name), key)
    placed = fixed_order(df, order, "_position")
    counts = placed.groupBy(partition_of(F.col("_position")).alias("_partition")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    before = W.orderBy("_partition").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_partition", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    # One row of two integers per partition: small whatever the data size.
    return (
        placed.withColumn("_partition", partition_of(F.col("_position")))
        .join(F.broadcast(offsets), "_partition")
        .withColumn(name, F.col("_before") + place_of(F.col("_position")) + 1)
        .drop("_partition", "_position", "_before")
    )
