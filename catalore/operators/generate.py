"""Descriptions for prompts: a batch stage that runs a caller's function on the executors."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalore.functions.genmeta import COST_PER_TOKEN, generation_record
from catalore.functions.names import blank_to_null
from catalore.session import cut_lineage, remove_at_exit, shared_dir

# A describer gets a batch of rows (at least table_name, column_name, prompt) and
# gives one row each, in order, with these columns (absent ones count as missing).
OUTCOME = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("tokens_used", T.LongType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
COUNTS = ["tokens_used", "prompt_tokens", "completion_tokens"]
Describer = Callable[[pd.DataFrame], pd.DataFrame]
#: Prompts whose answers are committed together.
CHUNK_ROWS = 2000

# Ship this module's functions with the task, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def template_describer(batch: pd.DataFrame) -> pd.DataFrame:
    """The built-in describer: a fixed sentence from the names, no tokens used."""
    table = batch["table_name"].str.replace("_", " ")
    column = batch["column_name"].fillna("").str.replace("_", " ")
    about_column = "The " + column + " of each " + table + " record."
    text = about_column.where(column != "", "Records of " + table + ".")
    zero = pd.Series(0, index=batch.index)
    return pd.DataFrame(
        {
            "description": text,
            "model": "template",
            "tokens_used": zero,
            "prompt_tokens": zero,
            "completion_tokens": zero,
        }
    )


def _outcomes(batch: pd.DataFrame, fn: Describer) -> pd.DataFrame:
    """The describer's answer; a batch that fails is halved until the failing rows are alone."""
    try:
        answer = fn(batch)
        if len(answer) != len(batch):
            raise ValueError(f"describer gave {len(answer)} rows for {len(batch)}")
        return answer.reindex(columns=OUTCOME.fieldNames())
    except Exception as failure:  # noqa: BLE001 - the failure becomes data
        if len(batch) == 1:
            failed = pd.DataFrame({"error": [str(failure)]})
            return failed.reindex(columns=OUTCOME.fieldNames())
        middle = len(batch) // 2
        halves = [_outcomes(part, fn) for part in (batch.iloc[:middle], batch.iloc[middle:])]
        return pd.concat(halves, ignore_index=True)


def describe(
    prompts: DataFrame, fn: Describer = template_describer, partitions: int | None = None
) -> DataFrame:
    """``prompts`` plus the outcome columns.

    ``partitions`` bounds how many calls run at once; by default every task of
    the input describes its own rows. The answers of a caller's function may be
    paid for and differ from call to call, so they are written once and read from
    there; the template just runs again.
    """
    source = prompts.repartition(partitions) if partitions else prompts
    schema = T.StructType(list(prompts.schema.fields) + list(OUTCOME.fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answer = _outcomes(batch, fn).set_axis(batch.index)
            for name in COUNTS:
                answer[name] = pd.to_numeric(answer[name]).astype("Int64")
            texts = [name for name in answer.columns if name not in COUNTS]
            answer[texts] = answer[texts].astype(object).where(answer[texts].notna(), None)
            yield pd.concat([batch, answer], axis=1)

    described = source.mapInPandas(run, schema)
    return described if fn is template_describer else cut_lineage(described)


def prompt_key() -> Column:
    """A digest of what a description depends on: table, column and prompt."""
    asked = F.to_json(F.struct("table_name", "column_name", "prompt"))
    return F.sha2(asked, 256)


def logged_answers(spark: SparkSession, log: str) -> DataFrame:
    """One outcome for each prompt key of the log; an answer goes before an error."""
    schema = T.StructType([T.StructField("prompt_key", T.StringType()), *OUTCOME.fields])
    try:
        rows = spark.read.schema(schema).parquet(log)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    outcome = F.struct(F.col("error").isNotNull().alias("failed"), *OUTCOME.fieldNames())
    best = rows.groupBy("prompt_key").agg(F.min(outcome).alias("outcome"))
    return best.select("prompt_key", *(f"outcome.{name}" for name in OUTCOME.fieldNames()))


def describe_logged(
    prompts: DataFrame,
    log: str,
    fn: Describer,
    partitions: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """As ``describe``, with a log of the answers, so that no prompt is paid for twice.

    Prompts that have an answer in the folder ``log`` are not asked again; those that
    failed are. The others are asked in chunks of about ``chunk_rows``, and each chunk's
    outcomes are appended to the log before the next one starts: a run that is cut off loses
    one chunk at most. Rows with equal table, column and prompt are asked once. A log has one
    writer at a time.
    """
    spark = prompts.sparkSession
    keyed = cut_lineage(prompts.withColumn("prompt_key", prompt_key()))
    answered = logged_answers(spark, log).filter("error IS NULL").select("prompt_key")
    todo = cut_lineage(keyed.join(answered, "prompt_key", "left_anti").dropDuplicates(["prompt_key"]))
    chunks = -(-todo.count() // chunk_rows)
    folder = f"{shared_dir(spark).rstrip('/')}/prompts-{uuid.uuid4().hex}"
    if chunks:
        # A folder for each chunk, so that a chunk reads its own prompts only.
        remove_at_exit(spark, folder)
        chunk = F.pmod(F.xxhash64("prompt_key"), F.lit(chunks))
        todo.withColumn("chunk", chunk).write.partitionBy("chunk").parquet(folder)
    for number in range(chunks):
        part = spark.read.parquet(folder).filter(F.col("chunk") == number).drop("chunk")
        outcomes = describe(part, fn, partitions).select("prompt_key", *OUTCOME.fieldNames())
        outcomes.write.mode("append").parquet(log)
    return keyed.join(logged_answers(spark, log), "prompt_key").drop("prompt_key")


def fallback_text() -> Column:
    # The wording of the standard text.
    column = blank_to_null(F.col("column_name"))
    subject = F.coalesce(column, F.concat(F.col("table_name"), F.lit(" table")))
    return F.concat(F.lit("Auto-generated description for "), subject)


def with_fallback(
    described: DataFrame,
    as_of: Column,
    rate: float = COST_PER_TOKEN,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Item texts of described rows: value, prompt and metadata record.

    Rows whose description failed get the standard text and keep their error.
    """
    given = F.when(F.col("error").isNull(), F.trim("description"))
    return described.withColumns(
        {
            "generated_value": F.coalesce(given, fallback_text()),
            "generation_metadata": generation_record(as_of, rate, extra),
        }
    )
