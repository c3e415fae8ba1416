"""Import run: approved items -> existing tables -> statements -> results -> audit rows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from catalore.operators.importer import (
    apply_plan,
    batched_plan,
    missing_tables,
    valid_tables,
)
from catalore.operators.items import approved_items
from catalore.operators.metrics import import_stats, import_totals
from catalore.sources.store import import_history_rows

# Author of the audit rows per level.
IMPORTERS = {"column": "bulk_importer", "table": "bulk_table_importer"}


@dataclass(frozen=True)
class ImportRun:
    plan: DataFrame
    skipped: DataFrame  # items whose table is gone
    results: DataFrame
    stats: DataFrame
    totals: DataFrame
    history: DataFrame | None  # None on a dry run: nothing happened


def run_import(
    spark: SparkSession,
    items: DataFrame,
    catalog_tables: DataFrame,
    level: str,
    as_of: datetime,
    catalog: str | None = None,
    schema: str | None = None,
    status: str = "approved",
    table_filter: str | None = None,
    is_dry_run: bool = True,
    results_path: str | None = None,
    batch_size: int | None = None,
    run_id: str | None = None,
    history: DataFrame | None = None,
) -> ImportRun:
    """``run_id`` names a run to go on with, else a new one begins. Ids of the audit rows
    follow those of ``history``."""
    approved = approved_items(items, catalog, schema, status, table_filter, level)
    plan = batched_plan(valid_tables(approved, catalog_tables), level, batch_size)
    results = apply_plan(
        spark, plan, level, is_dry_run, results_path, run_id or f"run-{uuid.uuid4().hex}"
    )
    return ImportRun(
        plan=plan,
        skipped=missing_tables(approved, catalog_tables),
        results=results,
        stats=import_stats(results),
        totals=import_totals(results),
        history=None
        if is_dry_run
        else import_history_rows(results, IMPORTERS[level], as_of, history),
    )
