import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catalore.operators import profile
from catalore.sources.catalog import columns_of


def brute_force(rows, names, numeric, k):
    found = {}
    for i, name in enumerate(names):
        values = {row[i] for row in rows if row[i] is not None}
        key = (lambda v: v) if name in numeric else str
        if values:
            found[name] = [str(v) for v in sorted(values, key=key)[:k]]
    return found


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = []
    for i in range(5000):
        rows.append(
            (
                rng.randrange(-(2**62), 2**62),
                "hot" if rng.random() < 0.4 else f"name {rng.randrange(3000)}",
                rng.choice(["A", "B", None]),
                Decimal(rng.randrange(-99999, 99999)).scaleb(-2),
                datetime(2020, 1, 1) + timedelta(seconds=rng.randrange(10**8)),
                None if rng.random() < 0.999 else f"rare {i}",
                None,
            )
        )
    names = ["number", "name", "flag", "price", "at", "rare", "nothing"]
    schema = "number long, name string, flag string, price decimal(9,2), at timestamp_ntz, rare string, nothing int"
    path = str(tmp_path_factory.mktemp("mixed") / "rows")
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(path)
    return rows, names, spark.read.parquet(path)


@pytest.mark.parametrize("k", [1, 5, 4000])
def test_column_samples_are_the_smallest_values(mixed, k):
    rows, names, df = mixed
    found = profile.column_samples({"t": df}, k=k).collect()
    expected = brute_force(rows, names, {"number", "price"}, k)
    assert {r["column_name"]: r["samples"] for r in found} == expected


@pytest.mark.parametrize("order", ["id", "-id", "hash"])
def test_k_rows_leave_a_task(spark, tmp_path, order):
    """Tables of several files in ascending, descending and random order."""
    path = str(tmp_path / "rows")
    by = {"id": F.col("id"), "-id": -F.col("id"), "hash": F.xxhash64("id")}[order]
    wide = spark.range(200_000).withColumn("text", F.format_string("%07d", "id"))
    wide.repartitionByRange(6, by).sortWithinPartitions(by).write.parquet(path)
    df = spark.read.parquet(path)
    least = profile._least_values(df, ["id", "text"], 5)
    assert least.collect()[0].asDict() == {"c0": [*range(5)], "c1": [f"{i:07d}" for i in range(5)]}
    moved = moved_rows(least)
    assert moved and moved <= 5 * df.rdd.getNumPartitions()


def moved_rows(frame):
    """Rows that the exchange of a collected frame has written."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("Exchange") >= 1
    node = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan
    waiting, written = [node], 0
    while waiting:
        node = waiting.pop()
        if "Exchange" in node.nodeName() and node.metrics().contains("shuffleRecordsWritten"):
            written += node.metrics().apply("shuffleRecordsWritten").value()
        if node.nodeName().startswith("ShuffleQueryStage"):
            waiting.append(node.plan())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return written


def test_wide_decimals_are_ranked_by_value(spark):
    """Beyond 21 digits neither a double nor decimal(38, 18) tells numbers apart."""
    big = 10**25
    values = [Decimal(sign * (big + i)) for i in range(30) for sign in (1, -1)]
    df = spark.createDataFrame([(v,) for v in values], "d decimal(38,0)").repartition(4)
    found = profile.column_samples({"t": df}, k=3).first()["samples"]
    assert found == [str(-(big + i)) for i in (29, 28, 27)]


def test_numbers_without_a_plain_order(spark):
    rows = [(float("nan"), 1.5), (float("inf"), -0.0), (float("-inf"), 0.0), (2.0, None), (None, None)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(3)
    found = {r["column_name"]: r["samples"] for r in profile.column_samples({"t": df}).collect()}
    assert found == {"a": ["-Infinity", "2.0", "Infinity", "NaN"], "b": ["0.0", "1.5"]}


@pytest.mark.parametrize("descending", [False, True])
def test_days_and_moments_are_ranked_by_value(spark, descending):
    """Beyond the year 9999 the text of a day does not sort like the day."""
    # From before the year 0 to the year 12000, as days since 1970.
    days = [-735_000, -683_000, 18_262, 2_932_896, 2_932_897, 3_663_434]
    rows = spark.createDataFrame([(d,) for d in days * 30], "d int").repartition(5)
    moment = F.expr("timestampadd(DAY, unix_date(day), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    days_only = rows.select(F.date_from_unix_date("d").alias("day"))
    df = days_only.withColumns({"at": moment, "zoned": moment.cast("timestamp")}).where("day > DATE'2000-01-01'")
    if descending:
        df = df.orderBy(F.desc("day"))
    found = {r["column_name"]: r["samples"] for r in profile.column_samples({"t": df}, k=3).collect()}
    for name in ("day", "at", "zoned"):
        smallest = df.select(name).distinct().orderBy(name).limit(3).select(F.col(name).cast("string"))
        assert found[name] == [r[0] for r in smallest.collect()], name


def test_many_tables_are_built_in_linear_time(spark):
    import time

    def seconds(n):
        start = time.perf_counter()
        profile.table_row_counts({f"t{i}": spark.range(i) for i in range(n)})
        return time.perf_counter() - start

    seconds(20)
    few = seconds(100)
    assert seconds(400) < 10 * max(few, 0.5)


def test_column_samples_of_other_types(spark):
    df = spark.range(20).select(
        F.array("id").alias("list"),
        F.struct("id").alias("record"),
        F.col("id").cast("string").cast("binary").alias("raw"),
        (F.col("id") % 2 == 0).alias("even"),
        F.col("id").alias("secret"),
        F.lit(1).alias("odd name"),
    )
    found = profile.column_samples({"t": df}, k=2, exclude=["secret"]).collect()
    assert {r["column_name"]: r["samples"] for r in found} == {
        "list": ["[0]", "[10]"],  # ranked as text
        "record": ['{"id":0}', '{"id":10}'],
        "even": ["false", "true"],
        "odd name": ["1"],
    }


def test_samples_of_several_tables_and_an_empty_one(spark):
    tables = {"a": spark.range(3), "b": spark.range(2), "none": spark.range(0)}
    found = profile.column_samples(tables, k=2).collect()
    assert {r["table_name"]: r["samples"] for r in found} == {"a": ["0", "1"], "b": ["0", "1"]}
    counts = {r["table_name"]: r["row_count"] for r in profile.table_row_counts(tables).collect()}
    assert counts == {"a": 3, "b": 2, "none": 0}


def test_table_sample(spark):
    rows = [(3, "x" * 60), (1, None), (None, "null key"), (2, "y")]
    df = spark.createDataFrame(rows, "k int, v string").repartition(3)
    cells = profile.table_sample(df, ["k"], 3).collect()
    found = {(r["row_no"], r["column_name"]): r["value"] for r in cells}
    assert found == {
        (1, "k"): "NULL", (1, "v"): "null key", (2, "k"): "1", (2, "v"): "NULL",
        (3, "k"): "2", (3, "v"): "y",
    }
    assert profile.table_sample(df, n=3).select("row_no").distinct().count() == 3
    last = profile.table_sample(df, ["k"], 4).where("row_no = 4 AND column_name = 'v'").first()
    assert last["value"] == "x" * 47 + "..."


def test_schema_preview(spark):
    wide = spark.range(1).select(*[F.lit(i).alias(f"c{i:02}") for i in range(13)])
    preview = profile.schema_preview(columns_of(spark, {"wide": wide, "slim": spark.range(1)}))
    found = {r["table_name"]: r for r in preview.collect()}
    assert found["slim"]["columns_text"] == "  - id (bigint)"
    lines = found["wide"]["columns_text"].split("\n")
    assert lines[0] == "  - c00 (int)" and len(lines) == 11
    assert lines[-1] == "  ... and 3 more columns"
