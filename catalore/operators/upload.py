"""Upload validation: every rule as a column, one pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalore.functions.rules import (
    store_errors,
    upload_errors,
    valid_metadata_type,
    value_error,
)
from catalore.schemas import UPLOAD_REQUIRED


def validate_upload(upload: DataFrame) -> DataFrame:
    """The rows with their failed rules as an array of messages."""
    return upload.withColumn("errors", upload_errors(upload.columns))


def accepted(upload: DataFrame) -> DataFrame:
    return validate_upload(upload).where(F.size("errors") == 0).drop("errors")


def rejected(upload: DataFrame) -> DataFrame:
    return (
        validate_upload(upload)
        .where(F.size("errors") > 0)
        .withColumn("message", F.array_join("errors", "; "))
        .drop("errors")
    )


def upload_summary(upload: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, distinct tables and distinct types; estimated counts for very wide uploads."""
    if approximate:
        return upload.agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.approx_count_distinct("table_name").alias("unique_tables"),
            F.approx_count_distinct("metadata_type").alias("metadata_types"),
        )
    # Grouped first: the two distinct counts then expand groups and not rows.
    pairs = upload.groupBy("table_name", "metadata_type").agg(F.count(F.lit(1)).alias("rows"))
    return pairs.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.countDistinct("table_name").alias("unique_tables"),
        F.countDistinct("metadata_type").alias("metadata_types"),
    )


def null_counts(upload: DataFrame) -> DataFrame:
    """Missing values per required column: column_name, missing."""
    counted = upload.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in UPLOAD_REQUIRED])
    return counted.unpivot([], UPLOAD_REQUIRED, "column_name", "missing")


def invalid_types(upload: DataFrame) -> DataFrame:
    wrong = upload.where(~valid_metadata_type(F.col("metadata_type")))
    return wrong.select("metadata_type").distinct()


def value_checks(rows: DataFrame, value: str = "generated_value") -> DataFrame:
    """Text rules per row: valid flag and message."""
    message = value_error(F.col(value), F.col("metadata_type"))
    return rows.withColumn("message", message).withColumn("valid", F.col("message").isNull())


def store_checks(rows: DataFrame) -> DataFrame:
    """Store limits per row, as one message; NULL when the store takes the row."""
    errors = store_errors(rows.columns)
    return rows.withColumn(
        "store_error", F.when(F.size(errors) > 0, F.array_join(errors, "; "))
    )


def upload_outcome(upload: DataFrame) -> DataFrame:
    checked = upload.select((F.size(upload_errors(upload.columns)) == 0).alias("ok"))
    return checked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("ok").alias("accepted"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def upload_report(upload: DataFrame) -> DataFrame:
    """One row per finding: the message for the uploader and how many rows it is about.

    Findings are a required column with missing values, an invalid type (each value by
    itself, all of them) and a column with texts too long for the store. A valid upload
    has the one finding that it is valid.
    """
    listed = upload.select(F.explode(upload_errors(upload.columns)).alias("message"))
    findings = listed.groupBy("message").agg(F.count(F.lit(1)).alias("n_rows"))
    outcome = upload_outcome(upload)
    valid = outcome.where("failed = 0").select(
        F.lit("Validation successful").alias("message"), F.col("total").alias("n_rows")
    )
    return findings.unionByName(valid).withColumn(
        "valid", F.col("message") == "Validation successful"
    )


@dataclass(frozen=True)
class UploadSplit:
    accepted: DataFrame
    rejected: DataFrame
    report: DataFrame
    outcome: DataFrame


def split_upload(upload: DataFrame) -> UploadSplit:
    return UploadSplit(
        accepted=accepted(upload),
        rejected=rejected(upload),
        report=upload_report(upload),
        outcome=upload_outcome(upload),
    )


def preview(upload: DataFrame, n: int = 10) -> DataFrame:
    """The first rows of the file, for the uploader to look at."""
    return upload.limit(n)
