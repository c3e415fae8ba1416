"""What the catalog knows about tables and columns, as DataFrames.

Listing a catalog is metastore work on the driver; its size is the number of
tables, columns and properties, not of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalore.functions.text import filter_tokens
from catalore.schemas import CATALOG_COLUMNS, CATALOG_TABLES
from catalore.session import union_all

# Header rows of DESCRIBE output that are no columns.
DESCRIBE_HEADERS = ["", "# Partition Information", "# col_name", "# Detailed Table Information"]


def quoted(name: str) -> str:
    plain = name.replace("_", "").isalnum() and name.isascii()
    return name if plain else "`" + name.replace("`", "``") + "`"


def full_name(*parts: str) -> str:
    return ".".join(quoted(part) for part in parts)


def _listing(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A driver-side listing as a local relation, so that its size is known to the planner."""
    arrow = {"string": pa.string(), "int": pa.int32()}
    fields = [(f.name, arrow[f.dataType.simpleString()]) for f in schema]
    columns = list(zip(*rows)) if rows else [() for _ in fields]
    table = pa.table(
        [pa.array(column, kind) for column, (_, kind) in zip(columns, fields)],
        schema=pa.schema(fields),
    )
    return spark.createDataFrame(table, schema)


def catalog_tables(
    spark: SparkSession,
    catalog: str,
    schema: str,
    table_filter: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Tables of a namespace by name, optionally filtered by name tokens."""
    tokens = filter_tokens(table_filter)
    listed = [
        (catalog, schema, table.name, table.description)
        for table in spark.catalog.listTables(full_name(catalog, schema))
        if not table.isTemporary and (not tokens or any(t in table.name for t in tokens))
    ]
    rows = _listing(spark, listed, CATALOG_TABLES).orderBy("table_name")
    return rows if limit is None else rows.limit(limit)


def columns_of(
    spark: SparkSession, tables: Mapping[str, DataFrame], limit: int | None = None
) -> DataFrame:
    """Column name, type, position and comment, one row per column of each table."""
    rows = [
        (name, ordinal, field.name, field.dataType.simpleString(), field.metadata.get("comment"))
        for name, df in tables.items()
        for ordinal, field in enumerate(df.schema, start=1)
        if limit is None or ordinal <= limit
    ]
    return _listing(spark, rows, CATALOG_COLUMNS)


def catalog_columns(
    spark: SparkSession,
    catalog: str,
    schema: str,
    tables: Sequence[str],
    limit: int | None = None,
) -> DataFrame:
    """The same for tables of the catalog; reads schemas, never DESCRIBE text."""
    frames = {name: spark.table(full_name(catalog, schema, name)) for name in tables}
    return columns_of(spark, frames, limit)


def clean_describe(described: DataFrame) -> DataFrame:
    """Rows of raw DESCRIBE output that are columns (for callers who only have that)."""
    name = F.col("col_name")
    return described.where(~name.startswith("#") & ~name.isin(DESCRIBE_HEADERS))


def table_properties(
    spark: SparkSession, catalog: str, schema: str, tables: Sequence[str]
) -> DataFrame:
    """One row per table with its properties as a map."""
    empty = spark.createDataFrame([], "table_name string, properties map<string,string>")
    rows = [empty]
    for name in tables:
        listed = spark.sql(f"SHOW TBLPROPERTIES {full_name(catalog, schema, name)}")
        rows.append(
            listed.agg(
                F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties")
            ).select(F.lit(name).alias("table_name"), "properties")
        )
    return union_all(rows)


def save_with_comments(df: DataFrame, comments: Mapping[str, str], table: str) -> None:
    """Write a table whose columns carry their comments from the start."""
    described = df
    for name, comment in comments.items():
        described = described.withMetadata(name, {"comment": comment})
    described.write.saveAsTable(table)
