"""The tracking store: items and history as Parquet, partitioned by namespace.

``catalog_name`` and ``schema_name`` are partition columns of the items, so the
usual namespace filter prunes folders before any file is opened.

One writer at a time: new ids follow the largest stored one, which a second writer
would not see. Readers may go on meanwhile.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalore.functions.clock import instant
from catalore.operators.numbering import largest_id, with_row_number
from catalore.schemas import HISTORY, IMPORT_ACTIONS, ITEMS, UPLOAD_TEMPLATE

ITEM_PARTITIONS = ["catalog_name", "schema_name"]


def _conformed(df: DataFrame, schema: T.StructType) -> list[Column]:
    return [
        (F.col(field.name) if field.name in df.columns else F.lit(None))
        .cast(field.dataType)
        .alias(field.name)
        for field in schema
    ]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order and type; absent ones become NULL."""
    return df.select(*_conformed(df, schema))


def create_store(spark: SparkSession, database: str) -> None:
    """Tracking tables, if they are not there yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def columns(schema: T.StructType) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.metadata_items ({columns(ITEMS)}) USING parquet "
        f"PARTITIONED BY ({', '.join(ITEM_PARTITIONS)})"
    )
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.approval_history ({columns(HISTORY)}) USING parquet"
    )


def read_items(spark: SparkSession, database: str) -> DataFrame:
    return spark.table(f"{database}.metadata_items").select(*ITEMS.fieldNames())


def read_history(spark: SparkSession, database: str) -> DataFrame:
    return spark.table(f"{database}.approval_history").select(*HISTORY.fieldNames())


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A store kept in a relational database.

    Pass ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions`` to
    read it in parallel; without them JDBC reads through one task.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def to_items(
    rows: DataFrame,
    created_by: str | Column,
    as_of: datetime | Column,
    status: str = "pending",
    keep: Sequence[str] = (),
) -> DataFrame:
    """New items with store defaults filled in, without ids.

    ``keep`` names further columns to carry along, such as an order for the ids.
    """
    clock = instant(as_of)
    author = F.lit(created_by) if isinstance(created_by, str) else created_by
    filled = rows.withColumns(
        {
            "current_value": F.col("generated_value"),
            "status": F.lit(status),
            "created_at": clock,
            "updated_at": clock,
            "created_by": author,
        }
    )
    without_id = T.StructType([field for field in ITEMS if field.name != "id"])
    return filled.select(*_conformed(filled, without_id), *keep)


def append_items(
    new_items: DataFrame, existing: DataFrame, order: list[str], key: str | None = None
) -> DataFrame:
    """Item rows ready to be written with one append.

    Ids follow the largest existing one in the given total order. A unique ``key``
    of the new rows, if there is one, spares sorting their texts.
    """
    largest = largest_id(existing)
    numbered = with_row_number(new_items, order, "_number", key)
    return conform(numbered.withColumn("id", F.col("_number") + largest), ITEMS)


def _append(rows: DataFrame, table: str, partitions: list[str]) -> None:
    rows.write.mode("append").format("parquet").partitionBy(*partitions).saveAsTable(table)


def write_items(items: DataFrame, database: str) -> None:
    _append(conform(items, ITEMS), f"{database}.metadata_items", ITEM_PARTITIONS)


def replace_items(items: DataFrame, database: str) -> None:
    """Rewrite the items, for example with reviews folded in.

    The new rows are written in full next to the old ones before the tables change
    places, so ``items`` may be computed from the table it replaces.
    """
    spark, table = items.sparkSession, f"{database}.metadata_items"
    recover_items(spark, database)
    spark.sql(f"DROP TABLE IF EXISTS {table}_next")
    spark.sql(f"DROP TABLE IF EXISTS {table}_previous")
    _append(conform(items, ITEMS), f"{table}_next", ITEM_PARTITIONS)
    spark.sql(f"ALTER TABLE {table} RENAME TO {table}_previous")
    spark.sql(f"ALTER TABLE {table}_next RENAME TO {table}")
    # A rename moves the folders but not what the catalog noted about partitions.
    spark.catalog.recoverPartitions(table)
    spark.catalog.recoverPartitions(f"{table}_previous")


def recover_items(spark: SparkSession, database: str) -> bool:
    """Put the items back in place if a rewrite was cut off between its two renames.

    The new rows were complete by then, so they take the place; True if they had to.
    """
    table = f"{database}.metadata_items"
    if spark.catalog.tableExists(table) or not spark.catalog.tableExists(f"{table}_next"):
        return False
    spark.sql(f"ALTER TABLE {table}_next RENAME TO {table}")
    spark.catalog.recoverPartitions(table)
    return True


def write_history(history: DataFrame, database: str) -> None:
    conform(history, HISTORY).write.mode("append").insertInto(f"{database}.approval_history")


def import_history_rows(
    results: DataFrame,
    user: str,
    as_of: datetime | Column,
    history: DataFrame | None = None,
) -> DataFrame:
    """Audit rows of an import run: outcome as action, message as comment.

    Ids follow the largest one of ``history``, in the order of item, outcome and message.
    """
    action = F.when(F.col("success"), IMPORT_ACTIONS[True]).otherwise(IMPORT_ACTIONS[False])
    rows = results.select(
        F.col("id").alias("metadata_item_id"),
        action.alias("action"),
        F.col("message").alias("comment"),
        F.lit(user).alias("user_name"),
        instant(as_of).alias("timestamp"),
    )
    largest = largest_id(history)
    numbered = with_row_number(rows, ["metadata_item_id", "action", "comment"], "_number")
    return conform(numbered.withColumn("id", F.col("_number") + largest), HISTORY)


def export_csv(items: DataFrame, path: str) -> None:
    """CSV with header; quotes doubled, embedded newlines and outer blanks kept."""
    writer = items.write.mode("errorifexists").option("header", True).option("escape", '"')
    # The writer would cut leading and trailing blanks off.
    for side in ("Leading", "Trailing"):
        writer = writer.option(f"ignore{side}WhiteSpace", False)
    writer.csv(path)


def upload_template(items: DataFrame) -> DataFrame:
    return items.select(*UPLOAD_TEMPLATE)
