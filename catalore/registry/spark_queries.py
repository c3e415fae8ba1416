"""The registered queries, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalore.functions.clock import instant, relative_time
from catalore.functions.clock import relative_time_text as clock_text
from catalore.functions.ddl import escape_literal
from catalore.functions.genmeta import COST_PER_TOKEN, parse_generation
from catalore.functions.names import qualified_name, status_color
from catalore.functions.text import (
    highlight_changes,
    humanize,
    name_matches,
    name_matches_tokens,
    sanitize,
    split_tokens,
    title_label,
    truncate_text,
    word_count,
)
from catalore.operators import importer, items as item_ops, metrics, profile, prompts, review
from catalore.operators import upload as upload_ops
from catalore.operators.skew import splitting
from catalore.operators.generate import describe, with_fallback
from catalore.plans import generation, reviewing, uploading
from catalore.registry.views import SAMPLE_ORDERS, Views, action_rows, history_rows
from catalore.sources import store, uploads
from catalore.sources.catalog import columns_of
from catalore.session import remove_at_exit, shared_dir
from catalore.streaming import review_stream

AS_OF = datetime(2024, 1, 20, 12, 0, 0)
SUCCESSES = 200
# Rows per split in the queries that show the salted joins.
FEW_ROWS = 20
NAME_FILTER = "src1, 7,"

Query = Callable[[Views], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    # A trailing underscore keeps a query apart from the expression of its name.
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Views(spark, folder))

    return {name: bind(fn) for name, fn in QUERIES.items()}


# --- items and history -------------------------------------------------------


@register
def items_scan(v: Views) -> DataFrame:
    return item_ops.scan_items(v.items)


@register
def items_filter(v: Views) -> DataFrame:
    return item_ops.filter_items(
        v.items, status="approved", table_name="", catalog_name="main", schema_name="en"
    ).select("id", "status", "catalog_name", "schema_name", "table_name", "current_value")


@register
def items_append(v: Views) -> DataFrame:
    """A second generator run: every item proposed again, with ids after the last one."""
    again = v.items.select(
        F.col("id").alias("source_id"),
        "catalog_name",
        "schema_name",
        "table_name",
        "column_name",
        "metadata_type",
        F.col("current_value").alias("original_value"),
        F.concat(F.lit("Again: "), "generated_value").alias("generated_value"),
        "generation_method",
    )
    rows = store.to_items(again, "ai_bulk_generator", AS_OF, keep=["source_id"])
    return store.append_items(rows, v.items, ["source_id"], key="source_id")


@register
def table_name_filter(v: Views) -> DataFrame:
    return v.items.where(name_matches(F.col("table_name"), NAME_FILTER)).select("id", "table_name")


@register
def token_table_filter(v: Views) -> DataFrame:
    """Name filter whose comma list comes from a column."""
    tokens = split_tokens(F.concat("schema_name", F.lit(", , "), "column_name"))
    return v.items.where(name_matches_tokens(F.col("generated_value"), tokens)).select(
        "id", "table_name"
    )


@register
def column_level_items(v: Views) -> DataFrame:
    return item_ops.at_level(v.items, "column").select("id", "table_name", "column_name")


@register
def table_level_items(v: Views) -> DataFrame:
    return item_ops.at_level(v.items, "table").select("id", "table_name", "column_name")


@register
def approved_items(v: Views) -> DataFrame:
    return item_ops.approved_items(v.items, status="all_approved").select(
        "id", "status", "table_name", "column_name", "current_value"
    )


@register
def approved_column_items(v: Views) -> DataFrame:
    return item_ops.approved_items(
        v.items, "main", "en", "all_approved", NAME_FILTER, "column"
    ).select("id", "table_name", "column_name", "current_value")


@register
def approved_table_items(v: Views) -> DataFrame:
    return item_ops.approved_items(
        v.items, "main", "en", "all_approved", NAME_FILTER, "table"
    ).select("id", "table_name", "column_name", "current_value")


@register
def item_history(v: Views) -> DataFrame:
    return item_ops.item_history(v.history, item_ops.filter_items(v.items, status="rejected"))


@register
def items_with_history(v: Views) -> DataFrame:
    narrow = v.items.select("id", "table_name", "status")
    return item_ops.items_with_history(narrow, v.history)


@register
def items_with_history_salted(v: Views) -> DataFrame:
    with splitting(FEW_ROWS):
        return items_with_history(v)


@register
def changed_history(v: Views) -> DataFrame:
    return reviewing.history_details(v.history, AS_OF)


@register
def qualified_names(v: Views) -> DataFrame:
    return v.items.select(
        "id", qualified_name().alias("full_name"), qualified_name(False).alias("table_full_name")
    )


@register
def upload_template(v: Views) -> DataFrame:
    return store.upload_template(v.items)


@register
def review_queue(v: Views) -> DataFrame:
    return item_ops.review_queue(v.items, AS_OF)


@register
def recent_activity(v: Views) -> DataFrame:
    return reviewing.recent_activity(v.items, AS_OF)


@register
def activity_timeline(v: Views) -> DataFrame:
    return reviewing.activity_timeline(v.items, AS_OF)


# --- expressions -------------------------------------------------------------


@register
def relative_time_(v: Views) -> DataFrame:
    return v.history.select("id", relative_time(F.col("timestamp"), AS_OF).alias("shown"))


@register
def relative_time_text(v: Views) -> DataFrame:
    number = F.col("id")
    text = F.when(number % 10 == 0, "not a time").when(
        number % 10 != 1, F.col("timestamp").cast("string")
    )
    return v.history.select("id", clock_text(text, AS_OF).alias("shown"))


@register
def status_colors(v: Views) -> DataFrame:
    return v.history.select("id", "action", status_color(F.col("action")).alias("color"))


@register
def action_labels(v: Views) -> DataFrame:
    return v.history.select("id", title_label(F.col("action")).alias("label"))


@register
def humanize_names(v: Views) -> DataFrame:
    return v.items.select("id", humanize(F.col("column_name")).alias("words"))


@register
def text_lengths(v: Views) -> DataFrame:
    text = F.col("generated_value")
    return v.items.select(
        "id",
        F.length(text).cast("bigint").alias("characters"),
        word_count(text).cast("bigint").alias("words"),
    )


@register
def preview_text(v: Views) -> DataFrame:
    text = F.col("current_value")
    return v.items.select(
        "id",
        truncate_text(text, 100).alias("result_preview"),
        truncate_text(text, 80).alias("summary_preview"),
        truncate_text(text, 50, always=True).alias("progress_preview"),
    )


@register
def sanitize_text(v: Views) -> DataFrame:
    # Pages hold markup, quotes and separators, so every removed character occurs.
    return v.table("pages").select("page_id", sanitize(F.col("html")).alias("clean"))


@register
def ddl_escape(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", escape_literal(F.col("html")).alias("escaped"))


@register
def highlight_changes_(v: Views) -> DataFrame:
    return v.history.select(
        "id", highlight_changes(F.col("old_value"), F.col("new_value")).alias("shown")
    )


@register
def generation_meta(v: Views) -> DataFrame:
    meta = parse_generation(F.col("generation_metadata"))
    return v.items.select("id", meta.alias("m")).select(
        "id", "m.model", "m.tokens_used", "m.cost_estimate", "m.error"
    )


@register
def generation_cost(v: Views) -> DataFrame:
    costs = metrics.generation_costs(v.items, COST_PER_TOKEN)
    return costs.withColumn("cost", F.round("cost", 8))


# --- metrics -----------------------------------------------------------------


@register
def status_counts(v: Views) -> DataFrame:
    return metrics.status_counts(v.items)


@register
def summary_stats(v: Views) -> DataFrame:
    return metrics.summary_stats(v.items)


@register
def chart_counts(v: Views) -> DataFrame:
    return metrics.chart_counts(metrics.summary_stats(v.items))


@register
def items_per_table(v: Views) -> DataFrame:
    return metrics.items_per_table(v.items)


@register
def avg_cost_by_method(v: Views) -> DataFrame:
    return metrics.avg_cost_by_method(v.items).withColumn("avg_cost", F.round("avg_cost", 8))


@register
def description_lengths(v: Views) -> DataFrame:
    lengths = metrics.description_lengths(v.items, "current_value")
    return lengths.withColumn("avg_length", F.round("avg_length", 6))


@register
def token_usage(v: Views) -> DataFrame:
    return metrics.token_usage(v.items).withColumn("avg_tokens", F.round("avg_tokens", 6))


@register
def type_distribution(v: Views) -> DataFrame:
    return metrics.type_distribution(v.items)


@register
def frame_summary(v: Views) -> DataFrame:
    return metrics.frame_summary_rows(v.items)


@register
def filter_values(v: Views) -> DataFrame:
    return metrics.filter_values(v.items)


@register
def filtered_count(v: Views) -> DataFrame:
    return metrics.filtered_count(item_ops.filter_items(v.items, status="pending"))


@register
def approval_rates(v: Views) -> DataFrame:
    return metrics.approval_rates(v.items)


@register
def generation_stats(v: Views) -> DataFrame:
    return metrics.generation_stats(v.generation_results)


@register
def cost_extrapolation(v: Views) -> DataFrame:
    costs = metrics.cost_extrapolation(item_ops.filter_items(v.items, schema_name="en"), SUCCESSES)
    return costs.withColumns(
        {n: F.round(n, 6) for n in ("estimated_total_cost", "avg_cost")}
    )


@register
def cost_total(v: Views) -> DataFrame:
    costs = metrics.cost_total(item_ops.filter_items(v.items, schema_name="en"), SUCCESSES)
    return costs.withColumns({n: F.round(n, 6) for n in ("total_cost", "avg_cost")})


@register
def recent_quality(v: Views) -> DataFrame:
    found = metrics.recent_quality(item_ops.filter_items(v.items, schema_name="en"), SUCCESSES)
    return found.withColumns({n: F.round(n, 6) for n in ("avg_length", "avg_tokens")})


# --- reviews -----------------------------------------------------------------


@register
def apply_reviews(v: Views) -> DataFrame:
    return review.apply_reviews(v.items, v.actions).items.select(
        "id", "current_value", "status", "updated_at", "reviewed_by", "reviewed_at"
    )


@register
def current_items(v: Views) -> DataFrame:
    return review.current_items(v.items, v.history).select(
        "id", "current_value", "status", "updated_at", "reviewed_by", "reviewed_at"
    )


@register
def review_audit_rows(v: Views) -> DataFrame:
    return review.apply_reviews(v.items, v.actions, v.history).audit


@register
def review_audit_of_odd_ids(v: Views) -> DataFrame:
    return review.review_audit_rows(v.items, v.odd_actions)


@register
def rejected_reviews(v: Views) -> DataFrame:
    return review.apply_reviews(v.items, v.actions).rejected.select(
        "action_id", "item_id", "status", "reason"
    )


@register
def unknown_reviews(v: Views) -> DataFrame:
    return review.unknown_reviews(v.items, v.actions).select("action_id", "item_id")


@register
def latest_action(v: Views) -> DataFrame:
    return review.latest_action(v.actions.where(review.acceptable()))


# --- profiling and generation ------------------------------------------------


@register
def table_row_counts(v: Views) -> DataFrame:
    return profile.table_row_counts(v.sampled)


@register
def column_samples(v: Views) -> DataFrame:
    samples = profile.column_samples(v.star)
    return samples.select(
        "table_name", "column_name", F.array_join("samples", " | ").alias("samples")
    )


@register
def table_sample(v: Views) -> DataFrame:
    return profile.union_all(
        [
            profile.table_sample(df, SAMPLE_ORDERS[name]).withColumn("table_name", F.lit(name))
            for name, df in v.sampled.items()
        ]
    )


@register
def sample_json(v: Views) -> DataFrame:
    return profile.union_all(
        [
            profile.sample_rows_json(df, SAMPLE_ORDERS[name]).withColumn("table_name", F.lit(name))
            for name, df in v.sampled.items()
        ]
    )


@register
def schema_preview(v: Views) -> DataFrame:
    """Schema lines next to the row count, as the table prompt shows them."""
    preview = profile.schema_preview(columns_of(v.spark, v.star))
    return profile.table_row_counts(v.star).join(preview, "table_name")


@register
def generation_inputs(v: Views) -> DataFrame:
    inputs = prompts.generation_inputs(
        columns_of(v.spark, v.star), profile.column_samples(v.star)
    )
    return inputs.select(
        "table_name",
        "ordinal",
        "column_name",
        "data_type",
        F.array_join("samples", " | ").alias("samples"),
    )


def _table_inputs(v: Views) -> DataFrame:
    return prompts.table_generation_inputs(
        profile.table_row_counts(v.star),
        profile.schema_preview(columns_of(v.spark, v.star)),
        profile.table_samples(v.star, SAMPLE_ORDERS),
    )


@register
def table_generation_inputs(v: Views) -> DataFrame:
    return _table_inputs(v).withColumn("row_samples", F.array_join("row_samples", "\n"))


@register
def column_prompts(v: Views) -> DataFrame:
    inputs = prompts.generation_inputs(
        columns_of(v.spark, v.star), profile.column_samples(v.star)
    )
    return prompts.column_prompts(inputs).select("table_name", "column_name", "prompt")


@register
def table_prompts(v: Views) -> DataFrame:
    return prompts.table_prompts(_table_inputs(v)).select("table_name", "prompt")


def _described(v: Views) -> DataFrame:
    asked = v.items.select(
        "id", "table_name", "column_name", F.col("generation_prompt").alias("prompt")
    )
    return describe(asked)


@register
def generated_descriptions(v: Views) -> DataFrame:
    return _described(v).select("id", "description", "model", "tokens_used")


@register
def generation_fallback(v: Views) -> DataFrame:
    """Texts of a run in which the items with a recorded error failed."""
    meta = parse_generation(F.col("generation_metadata"))
    outcome = v.items.select(
        "table_name",
        "column_name",
        "id",
        F.lit("gpt-4").alias("model"),
        meta["tokens_used"].alias("tokens_used"),
        meta["error"].alias("error"),
        F.when(meta["error"].isNull(), F.col("generated_value")).alias("description"),
        F.lit(None).cast("bigint").alias("prompt_tokens"),
        F.lit(None).cast("bigint").alias("completion_tokens"),
    )
    done = with_fallback(outcome, instant(AS_OF), rate=0.0)
    return done.select(
        "id",
        "generated_value",
        F.get_json_object("generation_metadata", "$.error").alias("error"),
        F.get_json_object("generation_metadata", "$.tokens_used").cast("bigint").alias("tokens"),
        F.get_json_object("generation_metadata", "$.timestamp").alias("timestamp"),
    )


ITEM_FIELDS = [
    "catalog_name", "schema_name", "table_name", "column_name", "metadata_type",
    "generated_value", "current_value", "status", "generation_method", "generation_prompt",
    "generation_metadata", "data_sample", "created_at", "updated_at", "created_by",
]


@register
def generate_column_items(v: Views) -> DataFrame:
    made = generation.generate_column_items(v.spark, v.star, "main", "default", AS_OF)
    return made.select(*ITEM_FIELDS)


@register
def generate_table_items(v: Views) -> DataFrame:
    made = generation.generate_table_items(
        v.spark, v.star, SAMPLE_ORDERS, "main", "default", AS_OF
    )
    return made.select(*ITEM_FIELDS)


# --- uploads -----------------------------------------------------------------


@register
def upload_summary(v: Views) -> DataFrame:
    return upload_ops.upload_summary(v.upload)


@register
def upload_round_trip(v: Views) -> DataFrame:
    """The upload exported as CSV and read as an uploader's file."""
    folder = f"{shared_dir(v.spark).rstrip('/')}/upload-{uuid.uuid4().hex}"
    remove_at_exit(v.spark, folder)
    store.export_csv(v.upload, folder)
    return uploads.read_upload(v.spark, folder).drop("original_value")


@register
def upload_null_check(v: Views) -> DataFrame:
    return upload_ops.null_counts(v.upload)


@register
def upload_invalid_types(v: Views) -> DataFrame:
    return upload_ops.invalid_types(v.upload)


@register
def value_validation(v: Views) -> DataFrame:
    checked = upload_ops.value_checks(v.items.select("id", "metadata_type", "generated_value"))
    return checked.select("id", "valid", "message")


@register
def upload_value_validation(v: Views) -> DataFrame:
    return upload_ops.value_checks(v.upload).select(
        "schema_name", "table_name", "column_name", "metadata_type", "generated_value", "message"
    )


@register
def store_constraints(v: Views) -> DataFrame:
    return upload_ops.store_checks(
        v.upload.withColumns(
            {
                "current_value": F.col("generated_value"),
                # Whole texts as table names, so that the length limit is met and missed.
                "table_name": F.col("generated_value"),
            }
        )
    ).select("schema_name", "table_name", "store_error")


@register
def upload_report(v: Views) -> DataFrame:
    """Findings of the upload and of its accepted rows, which have none."""
    whole = upload_ops.upload_report(v.upload).withColumn("part", F.lit("all"))
    accepted = upload_ops.upload_report(upload_ops.accepted(v.upload))
    return whole.unionByName(accepted.withColumn("part", F.lit("accepted")))


@register
def upload_accepted(v: Views) -> DataFrame:
    return upload_ops.accepted(v.upload)


@register
def upload_rejected(v: Views) -> DataFrame:
    return upload_ops.rejected(v.upload)


@register
def upload_items(v: Views) -> DataFrame:
    return uploading.upload_items(v.upload, "data_team", AS_OF).select(*ITEM_FIELDS)


@register
def upload_outcome(v: Views) -> DataFrame:
    return upload_ops.upload_outcome(v.upload)


# --- imports -----------------------------------------------------------------


def _approved(v: Views, level: str | None = None) -> DataFrame:
    return item_ops.approved_items(v.items, status="all_approved", level=level)


@register
def import_valid_tables(v: Views) -> DataFrame:
    kept = importer.valid_tables(_approved(v), v.live_tables)
    return kept.select("id", "schema_name", "table_name")


@register
def import_missing_tables(v: Views) -> DataFrame:
    gone = importer.missing_tables(_approved(v), v.live_tables)
    return gone.select("id", "schema_name", "table_name")


@register
def import_validation_counts(v: Views) -> DataFrame:
    return importer.validation_counts(_approved(v), v.live_tables)


@register
def column_ddl_plan(v: Views) -> DataFrame:
    return importer.ddl_plan(_approved(v, "column"), "column").select("id", "statement")


@register
def table_ddl_plan(v: Views) -> DataFrame:
    return importer.ddl_plan(_approved(v, "table"), "table").select("id", "statement")


@register
def import_preview(v: Views) -> DataFrame:
    approved = _approved(v, "column")
    plan = importer.ddl_plan(approved, "column")
    return importer.preview_statements(plan, approved).select("id", "statement")


@register
def import_dry_run(v: Views) -> DataFrame:
    return importer.dry_run(importer.ddl_plan(_approved(v, "column"), "column"))


@register
def import_batches(v: Views) -> DataFrame:
    return importer.import_batches(_approved(v, "column"), 50)


@register
def import_history_rows(v: Views) -> DataFrame:
    return store.import_history_rows(v.import_results, "bulk_importer", AS_OF, v.history)


@register
def import_failures(v: Views) -> DataFrame:
    return importer.import_failures(v.import_results)


@register
def import_stats(v: Views) -> DataFrame:
    return metrics.import_stats(v.import_results)


@register
def import_totals(v: Views) -> DataFrame:
    return metrics.import_totals(v.import_results)


@register
def import_retry_set(v: Views) -> DataFrame:
    return importer.retry_set(_approved(v), v.history).select("id", "table_name", "status")


@register
def verify_columns(v: Views) -> DataFrame:
    return importer.verify_columns(_approved(v, "column"), v.live_columns)


@register
def import_valid_tables_salted(v: Views) -> DataFrame:
    with splitting(FEW_ROWS):
        return import_valid_tables(v)


@register
def verify_columns_salted(v: Views) -> DataFrame:
    with splitting(FEW_ROWS):
        return verify_columns(v)


@register
def verify_tables(v: Views) -> DataFrame:
    return importer.verify_tables(_approved(v, "table"), v.live_descriptions)


@register
def rollback_plan(v: Views) -> DataFrame:
    return importer.rollback_plan(_approved(v))


# --- streams -----------------------------------------------------------------


def _run_stream(v: Views) -> str:
    events = v.table("events")
    documents = v.table("documents").count()
    arriving = review_stream.read_file_stream(v.spark, v.folder, events.schema, "events.parquet")
    folder = review_stream.new_stream_folder(v.spark)
    review_stream.run_available(action_rows(history_rows(arriving, F.lit(documents))), folder)
    return folder


@register
def stream_latest_action(v: Views) -> DataFrame:
    return review_stream.current_state(v.spark, _run_stream(v))


@register
def stream_status_counts(v: Views) -> DataFrame:
    return review_stream.current_status_counts(v.spark, _run_stream(v))
