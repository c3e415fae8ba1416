"""The engine's input relations, derived from the given tables with Spark.

Documents become metadata items, events the approval history and review actions,
conversations an upload file, the star schema the tables to profile. Wide text is
joined last and only once: all joins before it carry keys and times only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalore.functions.text import truncate_text
from catalore.operators.items import approved_items
from catalore.operators.skew import join_spread

STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# Total orders for deterministic sample rows.
SAMPLE_ORDERS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    "documents": ["doc_id"],
}

HISTORY_ACTIONS = {
    "click": "approved",
    "view": "edited",
    "error": "rejected",
    "signup": "imported",
}


def _text(c: Column) -> Column:
    return c.cast("string")


def history_rows(events: DataFrame, documents: Column) -> DataFrame:
    """Events as approval history of ``documents`` items (batch or stream)."""
    action = F.lit("import_failed")
    for event_type, name in HISTORY_ACTIONS.items():
        action = F.when(F.col("event_type") == event_type, name).otherwise(action)
    review = F.col("event_type").isin("click", "view", "error")

    def version(step: int) -> Column:
        return F.when(review, F.concat(F.lit("v"), _text(F.col("event_id") % step)))

    return events.select(
        F.col("event_id").alias("id"),
        (F.col("event_id") % documents).alias("metadata_item_id"),
        action.alias("action"),
        version(3).alias("old_value"),
        version(4).alias("new_value"),
        F.col("props").alias("comment"),
        # Some rows without a user, so that a review can clear the reviewer.
        F.when(F.col("event_id") % 31 != 0, F.concat(F.lit("user_"), _text(F.col("user_id")))).alias(
            "user_name"
        ),
        F.col("ts").alias("timestamp"),
    )


def action_rows(history: DataFrame) -> DataFrame:
    """History rows of reviews as review actions, some for unknown items or statuses."""
    number = F.col("id")
    return history.where(F.col("action").isin("approved", "edited", "rejected")).select(
        number.alias("action_id"),
        F.when(number % 97 == 0, -F.col("metadata_item_id"))
        .otherwise(F.col("metadata_item_id"))
        .alias("item_id"),
        "new_value",
        F.when(number % 89 == 0, "archived").otherwise(F.col("action")).alias("status"),
        F.col("user_name").alias("reviewed_by"),
        "comment",
        F.col("timestamp").alias("ts"),
    )


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def star(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in STAR_TABLES}

    @property
    def sampled(self) -> dict[str, DataFrame]:
        return {**self.star, "documents": self.table("documents")}

    @cached_property
    def document_count(self) -> Column:
        return self.table("documents").select(F.count(F.lit(1)).alias("n")).scalar()

    @cached_property
    def items(self) -> DataFrame:
        created = self.table("events").select(
            F.col("event_id").alias("id"), F.col("ts").alias("created_at")
        )
        touched = self.table("events").select(
            F.col("event_id").alias("touch_id"), F.col("ts").alias("touched_at"), "user_id"
        )
        labels = self.table("labels").select(
            F.col("doc_id").alias("id"), "quality", "toxic", F.lit(True).alias("labelled")
        )
        keys = created.join(touched, F.col("touch_id") == F.col("id") * 2).join(
            labels, "id", "left"
        )
        joined = self.table("documents").withColumnRenamed("doc_id", "id").join(keys, "id")
        number = F.col("id")
        labelled = F.col("labelled").isNotNull()
        updated = F.greatest("created_at", "touched_at")
        metadata = F.concat(
            F.lit('{"model": "gpt-4", "tokens_used": '),
            _text(F.col("n_chars")),
            F.lit(', "cost_estimate": 0.00'),
            _text(number % 90 + 10),
            F.lit("}"),
        )
        return joined.select(
            "id",
            F.lit("main").alias("catalog_name"),
            F.col("lang").alias("schema_name"),
            F.col("source").alias("table_name"),
            F.when(number % 5 == 0, F.lit(None).cast("string"))
            .when(number % 35 == 1, "")
            .otherwise(F.concat(F.lit("col_"), _text(number % 7)))
            .alias("column_name"),
            F.when(number % 3 == 0, "comment").otherwise("description").alias("metadata_type"),
            F.when(number % 4 == 0, F.concat(F.lit("Previous text for "), "source")).alias(
                "original_value"
            ),
            F.col("text").alias("generated_value"),
            F.col("text").alias("current_value"),
            F.when(~labelled, "pending")
            .when(F.col("toxic") == 1, "rejected")
            .when(F.col("quality") == 1, "approved")
            .otherwise("edited")
            .alias("status"),
            F.when(number % 2 == 0, "openai_gpt-4")
            .otherwise("openai_gpt-3.5-turbo")
            .alias("generation_method"),
            F.concat(F.lit("Table: "), "source").alias("generation_prompt"),
            F.when(number % 11 == 0, F.lit(None).cast("string"))
            .when(number % 13 == 0, '{"error": "timeout"}')
            .when(number % 17 == 0, "not json")
            .otherwise(metadata)
            .alias("generation_metadata"),
            # Lists of texts and of objects, text that is no JSON, blanks and nothing.
            F.when(number % 7 == 0, F.concat(F.lit('["'), "source", F.lit('","'), "lang", F.lit('"]')))
            .when(number % 7 == 1, F.concat(F.lit('[{"id":'), _text(number), F.lit("}]")))
            .when(number % 7 == 2, "not a list")
            .when(number % 7 == 3, "")
            .alias("data_sample"),
            "created_at",
            updated.alias("updated_at"),
            F.when(number % 5 == 0, "ai_table_generator")
            .otherwise("ai_bulk_generator")
            .alias("created_by"),
            F.when(labelled, F.concat(F.lit("user_"), _text(F.col("user_id")))).alias(
                "reviewed_by"
            ),
            F.when(labelled, updated).alias("reviewed_at"),
        )

    @cached_property
    def history(self) -> DataFrame:
        return history_rows(self.table("events"), self.document_count)

    @cached_property
    def actions(self) -> DataFrame:
        return action_rows(self.history)

    @cached_property
    def odd_actions(self) -> DataFrame:
        """The actions with some ids missing and others given twice."""
        number = F.col("action_id")
        return self.actions.withColumn(
            "action_id", F.when(number % 7 != 3, F.when(number % 5 == 1, number - 1).otherwise(number))
        )

    @cached_property
    def upload(self) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        return self.table("conversations").select(
            F.when(conv % 50 != 7, "main").alias("catalog_name"),
            F.col("role").alias("schema_name"),
            # Some names are too long for the store.
            F.when(conv % 40 == 9, F.repeat(F.lit("t"), F.lit(300)))
            .otherwise(F.concat(F.lit("t_"), _text(conv % 9)))
            .alias("table_name"),
            F.when(turn != 0, F.concat(F.lit("col_"), _text(turn))).alias("column_name"),
            F.when(conv % 5 == 3, F.concat(F.lit("note_"), _text(conv), F.lit("_"), _text(turn)))
            .when(turn % 2 == 0, "comment")
            .otherwise("description")
            .alias("metadata_type"),
            F.lit(None).cast("string").alias("original_value"),
            F.when(conv % 30 == 4, "  ").otherwise(F.col("text")).alias("generated_value"),
        )

    @cached_property
    def live_tables(self) -> DataFrame:
        """Tables the catalog still has: those with a document of over 5000 characters."""
        return (
            self.table("documents")
            .where(F.col("n_chars") > 5000)
            .select(
                F.lit("main").alias("catalog_name"),
                F.col("lang").alias("schema_name"),
                F.col("source").alias("table_name"),
            )
            .distinct()
        )

    @cached_property
    def live_descriptions(self) -> DataFrame:
        """Table descriptions the catalog holds: per table the greatest approved text."""
        return (
            approved_items(self.items, status="approved", level="table")
            .groupBy("catalog_name", "schema_name", "table_name")
            .agg(F.max("current_value").alias("description"))
        )

    @cached_property
    def live_columns(self) -> DataFrame:
        """Column comments the catalog holds: per column the greatest approved text."""
        return (
            approved_items(self.items, status="approved", level="column")
            .groupBy("catalog_name", "schema_name", "table_name", "column_name")
            .agg(F.max("current_value").alias("comment"))
        )

    @cached_property
    def import_results(self) -> DataFrame:
        """Outcomes recorded in the history, with the item they belong to."""
        outcomes = self.history.where(F.col("action").isin("imported", "import_failed")).select(
            F.col("metadata_item_id").alias("id"),
            F.col("id").alias("history_id"),
            (F.col("action") == "imported").alias("success"),
            F.col("comment").alias("message"),
        )
        return join_spread(outcomes, self.items, ["id"], "inner", spread_by="history_id").select(
            "id",
            "catalog_name",
            "schema_name",
            "table_name",
            "column_name",
            truncate_text(F.col("current_value"), 100).alias("description"),
            "success",
            "message",
        )

    @cached_property
    def generation_results(self) -> DataFrame:
        """Items as outcomes of a generator run."""
        error = F.get_json_object("generation_metadata", "$.error")
        return self.items.select(
            "table_name",
            error.isNull().alias("success"),
            F.col("created_at").alias("started_at"),
            F.col("updated_at").alias("ended_at"),
        )
