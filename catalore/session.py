"""Session settings and the shared folder that lineage is cut into."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings these operators are tuned for.

    Shuffle partition counts are left to AQE: it starts from
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum`` (or the shuffle
    default the cluster sets) and coalesces to the advisory size.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, else one beside its tables.

    Both are reachable from every executor; a machine-local folder would be lost
    with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/catalore_stages"


_STAGED: list[tuple[SparkSession, str]] = []


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a staged copy when the driver ends; frames may read it until then."""
    _STAGED.append((spark, path))


@atexit.register
def _remove_staged() -> None:
    for spark, path in _STAGED:
        try:
            jvm = spark._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)
        except Exception:  # noqa: BLE001 - without its JVM the folder's retention takes over
            return


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of the frames. Joined in pairs: a chain would be analysed again at each link."""
    frames = list(frames)
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return frames[0]


def estimated_bytes(df: DataFrame) -> int:
    """The size the optimizer expects; file sizes where ``df`` reads files."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a table in the shared folder and go on from there.

    Unlike a checkpoint the rows stay columnar, so later passes read only the
    columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
