"""Bringing approved descriptions into the catalog: plan, batches, outcome, verification."""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from catalore.functions.ddl import (
    column_comment_statement,
    column_restore_statement,
    table_comment_statement,
    table_restore_statement,
)
from catalore.functions.names import is_column_level, qualified_name
from catalore.functions.text import truncate_text
from catalore.operators.items import newest_first
from catalore.operators.numbering import with_row_number
from catalore.operators.skew import join_spread
from catalore.schemas import APPROVED_STATUSES, IMPORT_RESULTS, TABLE_KEYS

# Statements per batch.
BATCH_SIZES = {"column": 50, "table": 20}


def _known_tables(catalog: DataFrame) -> DataFrame:
    return catalog.select(*TABLE_KEYS).distinct()


def valid_tables(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items whose table exists; one table may hold most of the items."""
    kept = join_spread(items, _known_tables(catalog), TABLE_KEYS, "left_semi", spread_by="id")
    return kept.select(*items.columns)


def missing_tables(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items whose table is gone."""
    kept = join_spread(items, _known_tables(catalog), TABLE_KEYS, "left_anti", spread_by="id")
    return kept.select(*items.columns)


def validation_counts(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items whose table exists, and items that will be skipped."""
    # Counted per table first, so the join sees one row per table.
    per_table = items.groupBy(*TABLE_KEYS).agg(F.count(F.lit(1)).alias("n"))
    known = _known_tables(catalog).withColumn("known", F.lit(True))
    found = per_table.join(known, TABLE_KEYS, "left")
    return found.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("skipped"),
    )


def ddl_plan(approved: DataFrame, level: str) -> DataFrame:
    """One statement per approved description of that level."""
    value = F.col("current_value")
    build = column_comment_statement if level == "column" else table_comment_statement
    return approved.select(
        "id", *TABLE_KEYS, "column_name", "current_value", build(value).alias("statement")
    )


def import_order() -> list[Column]:
    """Approved before edited, newest first within each."""
    rank = F.array_position(F.array(*[F.lit(s) for s in APPROVED_STATUSES]), F.col("status"))
    return [rank, *newest_first("created_at")]


def import_batches(approved: DataFrame, batch_size: int) -> DataFrame:
    """Running position and batch of each item. Only its keys are sorted."""
    keys = approved.select("id", "status", "created_at")
    numbered = with_row_number(keys, import_order(), "position")
    batch = F.floor((F.col("position") - 1) / batch_size) + 1
    return numbered.select("id", "position", batch.cast("bigint").alias("batch_no"))


def batched_plan(approved: DataFrame, level: str, batch_size: int | None = None) -> DataFrame:
    size = batch_size or BATCH_SIZES[level]
    return ddl_plan(approved, level).join(import_batches(approved, size), "id")


def preview_statements(plan: DataFrame, approved: DataFrame, n: int = 5) -> DataFrame:
    """The first n statements in import order."""
    first = approved.orderBy(*import_order()).limit(n).select("id")
    return plan.join(first, "id", "left_semi")


def short_description() -> Column:
    return truncate_text(F.col("current_value"), 100)


def dry_run(plan: DataFrame) -> DataFrame:
    """The result every statement would have; nothing is executed."""
    return plan.select(
        "id",
        *TABLE_KEYS,
        "column_name",
        short_description().alias("description"),
        F.lit(True).alias("success"),
        # Fixed value: the outcome text of a dry run.
        F.concat(F.lit("DRY RUN: Would execute - "), "statement").alias("message"),
    )


def import_failures(results: DataFrame) -> DataFrame:
    return results.where(~F.col("success"))


def import_successes(results: DataFrame) -> DataFrame:
    return results.where(F.col("success"))


def retry_set(approved: DataFrame, history: DataFrame) -> DataFrame:
    """Approved items without a successful import so far."""
    imported = history.where(F.col("action") == "imported")
    done = imported.select(F.col("metadata_item_id").alias("id")).distinct()
    return approved.join(done, "id", "left_anti")


def verify_columns(applied: DataFrame, columns: DataFrame) -> DataFrame:
    """Applied column comments against what the catalog now holds.

    ``columns``: the table keys that identify a table there, column_name, comment.
    """
    keys = [k for k in [*TABLE_KEYS, "column_name"] if k in columns.columns]
    actual = columns.select(
        *keys, F.col("comment").alias("actual"), F.lit(True).alias("found")
    )
    return _compared(join_spread(applied, actual, keys, "left", spread_by="id"))


def verify_tables(applied: DataFrame, tables: DataFrame) -> DataFrame:
    """Applied table comments against the descriptions in the catalog."""
    actual = tables.select(
        *TABLE_KEYS, F.col("description").alias("actual"), F.lit(True).alias("found")
    )
    return _compared(join_spread(applied, actual, TABLE_KEYS, "left", spread_by="id"))


def _compared(joined: DataFrame) -> DataFrame:
    return joined.select(
        "id",
        qualified_name().alias("full_name"),
        F.coalesce("found", F.lit(False)).alias("found"),
        "actual",
        F.col("current_value").eqNullSafe(F.col("actual")).alias("matches"),
    )


def rollback_plan(applied: DataFrame) -> DataFrame:
    """Statements that restore each original value, or clear the comment."""
    original = F.col("original_value")
    return applied.select(
        "id",
        F.when(is_column_level(), column_restore_statement(original))
        .otherwise(table_restore_statement(original))
        .alias("statement"),
    )


def _execute(spark: SparkSession, row: Row, level: str) -> tuple[bool, str]:
    table = f"table {row.catalog_name}.{row.schema_name}.{row.table_name}"
    target = f"{row.table_name}.{row.column_name}" if level == "column" else table
    try:
        spark.sql(row.statement)
    except Exception as failure:  # noqa: BLE001 - the failure becomes data
        # The outcome texts of a statement.
        return False, f"Failed to apply description to {target}: {failure}"
    return True, f"Successfully applied description to {target}"


def apply_plan(
    spark: SparkSession,
    plan: DataFrame,
    level: str,
    is_dry_run: bool = True,
    results_path: str | None = None,
    run_id: str | None = None,
    workers: int = 8,
) -> DataFrame:
    """Run the statements of a batched plan and give their results.

    Statements run on the driver, as all catalog changes do: batch after batch, and
    within a batch one table's statements in order, different tables side by side.
    The outcomes of each batch are appended to the folder of the run below
    ``results_path`` before the next one starts, so the driver holds one batch at a time
    and leaves a record if it is lost. The same ``run_id`` again goes on from that record:
    items that have an outcome there are not run a second time.
    """
    if is_dry_run:
        return dry_run(plan)
    if not results_path or not run_id:
        raise ValueError("results_path and run_id are needed to keep the outcome of a real run")
    folder = f"{results_path.rstrip('/')}/{run_id}"

    def save(outcomes: list[tuple]) -> None:
        frame = spark.createDataFrame(outcomes, IMPORT_RESULTS)
        frame.coalesce(1).write.mode("append").parquet(folder)

    save([])  # an empty run has an empty result
    recorded = spark.read.schema(IMPORT_RESULTS).parquet(folder).select("id")
    statements = plan.join(recorded, "id", "left_anti").select(
        "id",
        *TABLE_KEYS,
        "column_name",
        short_description().alias("description"),
        "statement",
        "position",
        "batch_no",
    ).orderBy("position")

    def run_table(rows: list[Row]) -> list[tuple]:
        return [(*row[:6], *_execute(spark, row, level)) for row in rows]

    with ThreadPoolExecutor(workers) as pool:
        for _, batch in groupby(statements.toLocalIterator(), key=lambda row: row.batch_no):
            by_table: dict[tuple, list[Row]] = defaultdict(list)
            for row in batch:
                by_table[row.catalog_name, row.schema_name, row.table_name].append(row)
            save([outcome for done in pool.map(run_table, by_table.values()) for outcome in done])
    return spark.read.schema(IMPORT_RESULTS).parquet(folder)
