"""Profiling: row counts, column samples, table samples, schema previews."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalore.functions.text import cell_text
from catalore.session import union_all

COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
# Types that are compared as stored.
STORED_ORDER = (T.NumericType, T.StringType, T.DateType, T.TimestampNTZType)


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table; all counts run as one job."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in tables.items()
        ]
    )


def table_stats(tables: Mapping[str, DataFrame], properties: DataFrame) -> DataFrame:
    """Row count and properties per table."""
    return table_row_counts(tables).join(properties, "table_name", "left")


def value_text(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, COMPLEX):
        return F.to_json(column)
    return column.cast("string")


def sampled_columns(df: DataFrame, exclude: Collection[str] = ()) -> list[str]:
    """Columns that can be shown as text, without those the caller denies."""
    return [
        field.name
        for field in df.schema
        if field.name not in exclude and not isinstance(field.dataType, T.BinaryType)
    ]


def _comparable(df: DataFrame, name: str) -> Column:
    """What a column is ranked by: its stored value, or the text of what has no order."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return column + F.lit(0).cast(kind)  # one zero, not two
    return column if isinstance(kind, STORED_ORDER) else value_text(df, name)


def _shown(values: Column, kind: T.DataType) -> Column:
    """The texts of values that ``_comparable`` gave."""
    if isinstance(kind, T.TimestampType):
        values = F.transform(values, F.timestamp_micros)
    return values.cast("array<string>")


class _Least:
    """The k smallest distinct values of each column, from one batch after the other."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.found: list[pa.Array] = []

    def add(self, batch: pa.RecordBatch) -> None:
        if not self.found:
            self.found = [column.slice(0, 0) for column in batch.columns]
        self.found = [self._merged(*pair) for pair in zip(self.found, batch.columns)]

    def _merged(self, found: pa.Array, column: pa.Array) -> pa.Array:
        if len(found) == self.k:
            column = column.filter(pc.less(column, found[self.k - 1]))
        column = pc.unique(column).drop_null()
        if not len(column):
            return found
        both = pc.unique(pa.concat_arrays([found, column]))
        return both.take(pc.array_sort_indices(both)[: self.k])

    def rows(self) -> list[pa.Array]:
        """k rows; the i-th has the i-th value of every column, NULL where there is none."""
        return [pa.concat_arrays([f, pa.nulls(self.k - len(f), f.type)]) for f in self.found]

    def lists(self) -> list[pa.Array]:
        """One row with all values of every column."""
        return [pa.ListArray.from_arrays(pa.array([0, len(f)], pa.int32()), f) for f in self.found]


def _least_values(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """One row with the k smallest distinct values of each column as arrays c0, c1, ..."""

    def least(rows: Callable[[_Least], list[pa.Array]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = _Least(k)
            for batch in batches:
                kept.add(batch)
            if kept.found:
                yield pa.RecordBatch.from_arrays(rows(kept), names=labels)

        return run

    labels = [f"c{i}" for i in range(len(names))]
    cells = df.select(*[_comparable(df, name).alias(label) for name, label in zip(names, labels)])
    single = T.StructType([T.StructField(f.name, f.dataType) for f in cells.schema])
    listed = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in cells.schema])
    # k rows of each task meet in one, which keeps k of them.
    of_tasks = cells.mapInArrow(least(_Least.rows), single)
    return of_tasks.repartition(1).mapInArrow(least(_Least.lists), listed)


def column_samples(
    tables: Mapping[str, DataFrame],
    k: int = 5,
    exclude: Collection[str] = (),
) -> DataFrame:
    """The k smallest distinct non-null values per (table, column), exact, as a text array.

    ``distinct`` would shuffle every distinct value of every column, and no built-in
    aggregate keeps a fixed number of distinct values. Here a task keeps k values of each
    column while the batches of its split go by, so that k rows leave it, whatever the
    order and the number of rows and values. Each table is scanned once. Columns without an
    order of their own are ranked by their text.
    """
    samples = []
    for table, df in tables.items():
        names = sampled_columns(df, exclude)
        if not names:
            continue
        shown = [
            F.struct(
                F.lit(name).alias("column_name"),
                _shown(F.col(f"c{i}"), df.schema[name].dataType).alias("samples"),
            )
            for i, name in enumerate(names)
        ]
        found = _least_values(df, names, k).select(F.inline(F.array(*shown)))
        samples.append(found.select(F.lit(table).alias("table_name"), "column_name", "samples"))
    return union_all(samples).where(F.size("samples") > 0)


def _first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """n rows with their place; without an order any n rows, as a plain limit gives.

    The n-th smallest value of the first order column is found from that column
    alone, so that the wide scan can skip the row groups above it.
    """
    if not order:
        return df.limit(n).withColumn("row_no", F.monotonically_increasing_id() + 1)
    lead = F.col(order[0])
    bound = (
        df.select(lead.alias("lead"))
        .orderBy(F.asc_nulls_first("lead"))
        .limit(n)
        .agg(F.max("lead").alias("bound"))
    )
    candidates = df.where(lead.isNull() | (lead <= bound.scalar()))
    # Only n rows reach the window.
    return candidates.orderBy(*order).limit(n).withColumn(
        "row_no", F.row_number().over(W.orderBy(*order)).cast("bigint")
    )


def table_sample(df: DataFrame, order: Sequence[str] = (), n: int = 3) -> DataFrame:
    """Up to n rows as text cells of at most 50 characters: row_no, column_name, value."""
    names = sampled_columns(df)
    rows = _first_rows(df, order, n)
    cells = rows.select(
        "row_no", *[cell_text(value_text(df, name)).alias(name) for name in names]
    )
    return cells.unpivot(["row_no"], names, "column_name", "value")


def sample_rows_json(df: DataFrame, order: Sequence[str] = (), n: int = 3) -> DataFrame:
    """The same rows as one JSON object each: row_no, row_json."""
    names = sampled_columns(df)
    rows = _first_rows(df, order, n)
    cells = [cell_text(value_text(df, name)).alias(name) for name in names]
    return rows.select("row_no", F.to_json(F.struct(*cells)).alias("row_json"))


def table_samples(
    tables: Mapping[str, DataFrame], orders: Mapping[str, Sequence[str]], n: int = 3
) -> DataFrame:
    """Sample rows per table as arrays of JSON objects: table_name, row_samples."""
    rows = union_all(
        [
            sample_rows_json(df, orders.get(table, ()), n).withColumn("table_name", F.lit(table))
            for table, df in tables.items()
        ]
    )
    # n rows per table reach a group.
    collected = rows.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("row_no", "row_json"))).alias("rows")
    )
    return collected.select("table_name", F.col("rows.row_json").alias("row_samples"))


def schema_preview(columns: DataFrame, shown: int = 10) -> DataFrame:
    """First columns of each table by position, plus "... and m more columns"."""
    # One entry per column of a table: bounded by the widest schema.
    listed = columns.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "column_name", "data_type"))).alias("all")
    )
    lines = F.transform(
        F.slice("all", 1, shown),
        lambda c: F.concat(F.lit("  - "), c["column_name"], F.lit(" ("), c["data_type"], F.lit(")")),
    )
    more = F.size("all") - shown
    note = F.concat(F.lit("  ... and "), more.cast("string"), F.lit(" more columns"))
    return listed.select(
        "table_name",
        F.size("all").cast("bigint").alias("column_count"),
        F.array_join(
            F.when(more > 0, F.array_append(lines, note)).otherwise(lines), "\n"
        ).alias("columns_text"),
    )
