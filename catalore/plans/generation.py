"""Generator runs: tables -> columns -> samples -> prompts -> descriptions -> items."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalore.functions.clock import instant
from catalore.functions.genmeta import COST_PER_TOKEN, method_tag
from catalore.operators.generate import (
    Describer,
    describe,
    describe_logged,
    template_describer,
    with_fallback,
)
from catalore.operators.profile import (
    column_samples,
    schema_preview,
    table_row_counts,
    table_samples,
)
from catalore.operators.prompts import (
    column_prompts,
    generation_inputs,
    table_generation_inputs,
    table_prompts,
)
from catalore.sources.catalog import columns_of
from catalore.sources.store import to_items


def _answers(
    prompted: DataFrame, describer: Describer, partitions: int | None, log: str | None
) -> DataFrame:
    if log is None:
        return describe(prompted, describer, partitions)
    return describe_logged(prompted, log, describer, partitions)


def generate_column_items(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    catalog: str,
    schema: str,
    as_of: datetime,
    describer: Describer = template_describer,
    include_sample: bool = True,
    max_columns: int | None = None,
    exclude: Collection[str] = (),
    partitions: int | None = None,
    rate: float = COST_PER_TOKEN,
    log: str | None = None,
) -> DataFrame:
    """Pending items for every column of the tables.

    With a folder ``log`` a run that starts again asks only for what has no answer yet.
    """
    columns = columns_of(spark, tables, max_columns)
    if include_sample:
        inputs = generation_inputs(columns, column_samples(tables, exclude=exclude))
    else:
        inputs = columns.withColumn("samples", F.lit(None).cast("array<string>"))
    prompted = column_prompts(inputs, include_sample)
    answers = _answers(prompted, describer, partitions, log)
    described = with_fallback(answers, instant(as_of), rate)
    rows = described.select(
        F.lit(catalog).alias("catalog_name"),
        F.lit(schema).alias("schema_name"),
        "table_name",
        "column_name",
        F.lit("description").alias("metadata_type"),
        "generated_value",
        method_tag(F.coalesce("model", F.lit("unknown"))).alias("generation_method"),
        F.col("prompt").alias("generation_prompt"),
        "generation_metadata",
        F.when(F.size("samples") > 0, F.to_json("samples")).alias("data_sample"),
    )
    return to_items(rows, "ai_bulk_generator", as_of)


def generate_table_items(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    orders: Mapping[str, Sequence[str]],
    catalog: str,
    schema: str,
    as_of: datetime,
    describer: Describer = template_describer,
    include_schema: bool = True,
    include_sample: bool = True,
    partitions: int | None = None,
    rate: float = COST_PER_TOKEN,
    log: str | None = None,
) -> DataFrame:
    """Pending items for the tables themselves; ``log`` as for columns."""
    preview = schema_preview(columns_of(spark, tables))
    samples = table_samples(tables, orders)
    inputs = table_generation_inputs(table_row_counts(tables), preview, samples)
    prompted = table_prompts(inputs, include_schema, include_sample).withColumn(
        "column_name", F.lit(None).cast("string")
    )
    counts = {"column_count": F.col("column_count"), "row_count": F.col("row_count")}
    answers = _answers(prompted, describer, partitions, log)
    described = with_fallback(answers, instant(as_of), rate, counts)
    sample_json = F.concat(F.lit("["), F.array_join("row_samples", ","), F.lit("]"))
    rows = described.select(
        F.lit(catalog).alias("catalog_name"),
        F.lit(schema).alias("schema_name"),
        "table_name",
        "column_name",
        F.lit("description").alias("metadata_type"),
        "generated_value",
        method_tag(F.coalesce("model", F.lit("unknown"))).alias("generation_method"),
        F.col("prompt").alias("generation_prompt"),
        "generation_metadata",
        F.when(F.size("row_samples") > 0, sample_json).alias("data_sample"),
    )
    return to_items(rows, "ai_table_generator", as_of)
