"""Latest review state and status counts, kept up to date from a stream of actions.

Order is by event (ts, action_id), so a late action never overwrites a newer one
and no watermark is needed; the state is one record per item, as large as the
items table itself. Use the RocksDB state store for many items (``build_session``
sets it).

The latest actions are kept in buckets of neighbouring item ids, a folder for each bucket
and trigger that changed it: ``state/bucket=B/batch=N``. A trigger reads the buckets of the
items it changes, writes them anew and removes the versions that nothing needs any more, so
that its work follows the items it touches and not those there are. Beside them it writes
the status counts so far to ``counts/batch=N``. A trigger that runs again reads the versions
before its own and overwrites its own, so results are exact after any failure.
"""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalore.operators.review import acceptable, latest_action
from catalore.session import shared_dir

#: Ids of one bucket. The store numbers items without gaps, so that this is their number too.
BUCKET_IDS = 4096
#: Versions of a bucket, and of the counts, that a trigger that runs again may need.
VERSIONS = 2

STATE = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("action_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("reviewed_by", T.StringType()),
    ]
)
COUNTS = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def read_file_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    name_pattern: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def latest_action_stream(actions: DataFrame) -> DataFrame:
    """The batch operator on a stream: one state record per item."""
    return latest_action(actions.where(acceptable()))


class _Versions:
    """The folders ``batch=N`` below a path, by number."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._system = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        names = []
        if self._system.exists(self._path):
            names = [str(s.getPath().getName()) for s in self._system.listStatus(self._path)]
        self.path = path
        self.numbers = sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))

    def before(self, batch_id: int) -> str | None:
        """The newest version before a trigger's."""
        earlier = [n for n in self.numbers if n < batch_id]
        return f"{self.path}/batch={earlier[-1]}" if earlier else None

    def remove_old(self) -> None:
        for number in self.numbers[:-VERSIONS]:
            self._system.delete(self._new(f"{self.path}/batch={number}"), True)


def _bucket() -> Column:
    return F.expr(f"item_id div {BUCKET_IDS}")


def _buckets_of(changed: DataFrame) -> list[int]:
    """The buckets of the changed items; as many as there are items at most."""
    return [r[0] for r in changed.select(_bucket().alias("bucket")).distinct().collect()]


def _state_before(spark: SparkSession, folder: str, buckets: list[int], batch_id: int) -> DataFrame:
    """The latest action per item of some buckets before a trigger."""
    versions = (_Versions(spark, f"{folder}/state/bucket={b}").before(batch_id) for b in buckets)
    paths = [path for path in versions if path]
    return spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)


def _counts_after(spark: SparkSession, folder: str, had: DataFrame, changed: DataFrame, batch_id: int) -> DataFrame:
    """Items per status: those before, +1 for what an item got, -1 for what it had."""
    path = _Versions(spark, f"{folder}/counts").before(batch_id)
    before = spark.read.schema(COUNTS).parquet(path) if path else spark.createDataFrame([], COUNTS)
    lost = had.join(changed.select("item_id"), "item_id", "left_semi")
    steps = before.unionByName(changed.select("status", F.lit(1).cast("long").alias("n"))).unionByName(
        lost.select("status", F.lit(-1).cast("long").alias("n"))
    )
    return steps.groupBy("status").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def _write_trigger(folder: str):
    def write(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        # Written first and read back, so the stateful plan runs once per trigger.
        staged = f"{folder}/changes/batch={batch_id}"
        changed.write.mode("overwrite").parquet(staged)
        changed = spark.read.schema(STATE).parquet(staged)
        buckets = _buckets_of(changed)
        had = _state_before(spark, folder, buckets, batch_id)
        after = latest_action(had.unionByName(changed)).withColumns(
            {"bucket": _bucket(), "batch": F.lit(batch_id)}
        )
        after.repartition("bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("bucket", "batch").parquet(f"{folder}/state")
        counts = _counts_after(spark, folder, had, changed, batch_id)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")
        for path in (*(f"state/bucket={b}" for b in buckets), "counts", "changes"):
            _Versions(spark, f"{folder}/{path}").remove_old()

    return write


def new_stream_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/review-stream-{uuid.uuid4().hex}"


def run_available(actions: DataFrame, folder: str) -> None:
    """Process what has arrived, then stop; the next call goes on from there."""
    query = (
        latest_action_stream(actions)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(_write_trigger(folder))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_state(spark: SparkSession, folder: str) -> DataFrame:
    """The latest action per item so far.

    The newest version of a bucket has all its items; older ones that are still there have
    nothing newer.
    """
    if not _Versions(spark, f"{folder}/counts").numbers:
        return spark.createDataFrame([], STATE)
    return latest_action(spark.read.schema(STATE).parquet(f"{folder}/state"))


def current_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Items per status so far, from the few rows that the last trigger left."""
    path = _Versions(spark, f"{folder}/counts").before(sys.maxsize)
    return spark.read.schema(COUNTS).parquet(path) if path else spark.createDataFrame([], COUNTS)
