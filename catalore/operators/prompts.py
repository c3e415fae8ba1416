"""Prompt texts for column and table descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The wording of the prompts.
COLUMN_PROMPT_HEAD = (
    "Generate a concise, business-friendly description for this database column:\n\nTable: "
)
COLUMN_PROMPT_TAIL = """

Requirements:
- Write 1-2 sentences maximum
- Focus on business purpose, not technical details
- Use clear, non-technical language
- Don't mention data types or technical constraints
- Be specific about what the column represents

Example: "Customer's primary email address used for communications and account notifications."
"""
TABLE_PROMPT_HEAD = (
    "Generate a concise, business-friendly description for this database table:\n\nTable: "
)
TABLE_PROMPT_TAIL = """

Requirements:
- Write 2-3 sentences maximum
- Focus on business purpose and what data this table contains
- Use clear, non-technical language that business users can understand
- Describe what business process or entity this table represents
- Don't mention technical details like data types or row counts
- Be specific about the table's role in the business

Example: "Contains customer profile information including contact details and account preferences. Used by marketing and customer service teams to manage customer relationships and communications."
"""


def generation_inputs(columns: DataFrame, samples: DataFrame) -> DataFrame:
    """Column info with its samples; columns without values get none."""
    return columns.select("table_name", "ordinal", "column_name", "data_type").join(
        samples, ["table_name", "column_name"], "left"
    )


def table_generation_inputs(
    row_counts: DataFrame, preview: DataFrame, samples: DataFrame
) -> DataFrame:
    """Row count, schema preview and sample rows per table."""
    return row_counts.join(preview, "table_name", "left").join(samples, "table_name", "left")


def column_prompts(inputs: DataFrame, include_sample: bool = True, shown: int = 3) -> DataFrame:
    parts = [
        F.lit(COLUMN_PROMPT_HEAD),
        F.col("table_name"),
        F.lit("\nColumn: "),
        F.col("column_name"),
        F.lit("\nData Type: "),
        F.col("data_type"),
    ]
    if include_sample:
        listed = F.array_join(F.slice("samples", 1, shown), ", ")
        parts.append(
            F.when(
                F.size(F.coalesce("samples", F.array())) > 0,
                F.concat(F.lit("\nSample Values: "), listed),
            ).otherwise("")
        )
    return inputs.withColumn("prompt", F.concat(*parts, F.lit(COLUMN_PROMPT_TAIL)))


def table_prompts(
    inputs: DataFrame, include_schema: bool = True, include_sample: bool = True, shown: int = 2
) -> DataFrame:
    row_line = F.when(
        F.col("row_count") > 0,
        F.concat(F.lit("\nApproximate Rows: "), F.format_number("row_count", 0)),
    ).otherwise("")
    parts = [F.lit(TABLE_PROMPT_HEAD), F.col("table_name"), row_line]
    if include_schema:
        listed = F.concat(
            F.lit("\nColumns ("),
            F.col("column_count").cast("string"),
            F.lit("):\n"),
            F.col("columns_text"),
        )
        parts.append(F.when(F.col("column_count") > 0, listed).otherwise(""))
    if include_sample:
        lines = F.transform(
            F.slice("row_samples", 1, shown),
            lambda row, i: F.concat(
                F.lit("\nRow "), (i + 1).cast("string"), F.lit(": "), row
            ),
        )
        parts.append(
            F.when(
                F.size(F.coalesce("row_samples", F.array())) > 0,
                F.concat(F.lit("\nSample Data:"), F.array_join(lines, "")),
            ).otherwise("")
        )
    return inputs.withColumn("prompt", F.concat(*parts, F.lit(TABLE_PROMPT_TAIL)))
