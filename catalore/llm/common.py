"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\x0c\r"

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mixed(values: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values, one for each."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def hashed_sample(df: DataFrame, by: list[str], share: float, most: int) -> DataFrame:
    """About the ``share`` of the distinct rows whose hash of ``by`` is least, ``most`` at most.

    The hash selects before any row moves, so that no task meets more rows than asked
    for, however many tables and partitions there are; repeated rows count once.
    """
    hashed = F.xxhash64(*by)
    if share < 1:
        df = df.filter(hashed < F.lit(int(-(2**63) + share * 2**64)))
    return df.distinct().orderBy(hashed, *df.columns).limit(most)


def map_texts(
    df: DataFrame,
    function: Callable[[list[str]], list[tuple]],
    added: dict[str, str],
    keys: list[str] | None = None,
    rows: int = 64,
) -> DataFrame:
    """``keys`` of ``df`` (doc_id) with what ``function`` gives for the texts.

    ``function`` turns some whole texts (null: empty) into one tuple each, in the order
    of ``added`` (column name to type). Rows stay in their partition; a call sees at most
    ``rows`` texts.
    """
    keys = ["doc_id"] if keys is None else keys
    frame = df.select(*keys, whole_text().alias("text"))
    types = {f.name: f.dataType.simpleString() for f in frame.schema if f.name != "text"}
    schema = ", ".join(f"`{n}` {t}" for n, t in {**types, **added}.items())
    kinds = [ARROW[t] for t in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns = list(zip(*function(part.column(len(keys)).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=[*keys, *added],
                )

    return frame.mapInArrow(run, schema)
