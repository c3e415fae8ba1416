"""Row shapes and value domains shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

ITEMS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("catalog_name", T.StringType(), False),
        T.StructField("schema_name", T.StringType(), False),
        T.StructField("table_name", T.StringType(), False),
        T.StructField("column_name", T.StringType()),  # NULL or '' = the table itself
        T.StructField("metadata_type", T.StringType(), False),
        T.StructField("original_value", T.StringType()),
        T.StructField("generated_value", T.StringType(), False),
        T.StructField("current_value", T.StringType(), False),
        T.StructField("status", T.StringType()),
        T.StructField("generation_method", T.StringType()),
        T.StructField("generation_prompt", T.StringType()),
        T.StructField("generation_metadata", T.StringType()),
        T.StructField("data_sample", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("reviewed_by", T.StringType()),
        T.StructField("reviewed_at", T.TimestampNTZType()),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("metadata_item_id", T.LongType()),
        T.StructField("action", T.StringType(), False),
        T.StructField("old_value", T.StringType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)

ACTIONS = T.StructType(
    [
        T.StructField("action_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("reviewed_by", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

UPLOAD_REQUIRED = [
    "catalog_name",
    "schema_name",
    "table_name",
    "metadata_type",
    "generated_value",
]
UPLOAD_OPTIONAL = ["column_name", "original_value", "generation_method"]

# Column order of the upload template.
UPLOAD_TEMPLATE = [
    "catalog_name",
    "schema_name",
    "table_name",
    "column_name",
    "metadata_type",
    "original_value",
    "generated_value",
]

GEN_META = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("tokens_used", T.LongType()),
        T.StructField("cost_estimate", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("column_count", T.LongType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

IMPORT_RESULTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("catalog_name", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("message", T.StringType()),
    ]
)

CATALOG_TABLES = T.StructType(
    [
        T.StructField("catalog_name", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

CATALOG_COLUMNS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("comment", T.StringType()),
    ]
)

# Domains of the tracking store.
STATUSES = ["pending", "approved", "rejected", "edited"]
REVIEW_STATUSES = ["approved", "rejected", "edited"]
APPROVED_STATUSES = ["approved", "edited"]
METADATA_TYPES = ["comment", "description"]
IMPORT_ACTIONS = {True: "imported", False: "import_failed"}

# Display colour per status.
STATUS_COLORS = {
    "pending": "#FFA500",
    "approved": "#28a745",
    "rejected": "#dc3545",
    "edited": "#17a2b8",
}
DEFAULT_STATUS_COLOR = "#6c757d"

# Longest text the store takes per column.
STORE_LENGTHS = {
    "catalog_name": 255,
    "schema_name": 255,
    "table_name": 255,
    "column_name": 255,
    "metadata_type": 50,
    "status": 50,
    "generation_method": 100,
    "created_by": 255,
    "reviewed_by": 255,
}
STORE_NOT_NULL = [
    "catalog_name",
    "schema_name",
    "table_name",
    "metadata_type",
    "generated_value",
    "current_value",
]

TABLE_KEYS = ["catalog_name", "schema_name", "table_name"]
