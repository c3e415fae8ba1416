"""Upload files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalore.schemas import UPLOAD_OPTIONAL, UPLOAD_REQUIRED

# Cell texts that mean "missing" in an upload file.
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def read_upload(
    spark: SparkSession,
    path: str,
    multi_line: bool = True,
    missing_tokens: Sequence[str] = MISSING_TOKENS,
) -> DataFrame:
    """CSV with header, every column as text, missing tokens as NULL.

    ``multi_line=True`` keeps newlines inside quoted cells but reads each file in
    one task; pass False for large files without such cells, so that they split.
    An empty ``missing_tokens`` keeps the texts as they are.
    """
    raw = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )
    if not missing_tokens:
        return raw
    tokens = list(missing_tokens)
    return raw.select(
        *[
            F.when(~F.col(f"`{name}`").isin(tokens), F.col(f"`{name}`")).alias(name)
            for name in raw.columns
        ]
    )


def missing_columns(upload: DataFrame) -> list[str]:
    """Required columns the file does not have (reads the header only)."""
    return [name for name in UPLOAD_REQUIRED if name not in upload.columns]


def schema_message(upload: DataFrame) -> str | None:
    missing = missing_columns(upload)
    return f"Missing required columns: {missing}" if missing else None


def with_optional_columns(upload: DataFrame) -> DataFrame:
    """All eight upload columns; absent optional ones are NULL."""
    message = schema_message(upload)
    if message:
        raise ValueError(message)
    text = T.StringType()
    absent = [name for name in UPLOAD_OPTIONAL if name not in upload.columns]
    return upload.withColumns({name: F.lit(None).cast(text) for name in absent}).select(
        *UPLOAD_REQUIRED, *UPLOAD_OPTIONAL
    )
