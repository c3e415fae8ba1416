import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalore.operators import items as item_ops
from catalore.operators import metrics
from catalore.plans.reviewing import dashboard
from catalore.schemas import ITEMS
from catalore.sources.store import conform

START = datetime(2024, 1, 1)


def make_items(spark, rows, schema):
    return conform(spark.createDataFrame(rows, schema), ITEMS)


def test_summary_keeps_odd_statuses_apart(spark):
    rows = [(1, "pending"), (2, None), (3, "total"), (4, "odd"), (5, "pending")]
    items = make_items(spark, rows, "id long, status string")
    found = {(r["status"], r["is_total"]): r["n"] for r in metrics.summary_stats(items).collect()}
    assert found == {
        ("pending", False): 2, (None, False): 1, ("total", False): 1, ("odd", False): 1,
        ("total", True): 5,
    }
    empty = metrics.summary_stats(items.where("false"))
    assert [(r["n"], r["is_total"]) for r in empty.collect()] in ([], [(0, True)])
    assert metrics.chart_counts(metrics.summary_stats(items)).count() == 4


def test_time_order_spells_out_nulls(spark):
    rows = [(1, START, START), (2, None, None), (3, START + timedelta(1), START), (4, START, START)]
    items = make_items(spark, rows, "id long, created_at timestamp_ntz, updated_at timestamp_ntz")
    assert [r["id"] for r in item_ops.scan_items(items).collect()] == [2, 3, 4, 1]
    assert [r["id"] for r in item_ops.recent(items, "updated_at", 3).collect()] == [4, 3, 1]
    assert set(dashboard(items, START)) == {"summary", "chart", "recent"}


def test_filters_treat_empty_as_no_filter(spark):
    rows = [(1, "approved", "a"), (2, "edited", "b"), (3, "pending", "a")]
    items = make_items(spark, rows, "id long, status string, table_name string")
    assert item_ops.filter_items(items, status="", table_name=None).count() == 3
    assert item_ops.filter_items(items, status="edited", table_name="b").count() == 1
    assert item_ops.approved_items(items, status="all_approved").count() == 2


def test_costs(spark):
    meta = ['{"tokens_used": 10, "cost_estimate": 0.5}', "not json", None, '{"tokens_used": 5, "cost_estimate": 0.25}']
    rows = [(i, START + timedelta(i), m) for i, m in enumerate(meta)]
    items = make_items(spark, rows, "id long, created_at timestamp_ntz, generation_metadata string")
    run = metrics.cost_extrapolation(items, successes=8).first()
    assert (run["estimated_total_cost"], run["avg_cost"], run["estimated_tokens"]) == (1.5, 0.1875, 30)
    total = metrics.cost_total(items, successes=2).first()
    assert (total["total_cost"], total["avg_cost"], total["total_tokens"]) == (0.25, 0.125, 5)
    assert metrics.cost_total(items.where("id = 1"), successes=2).count() == 0


def test_run_stats_and_overall_row(spark):
    rows = [("a", True, START, START + timedelta(seconds=1)), ("a", False, START, START + timedelta(seconds=3)),
            ("b", False, START + timedelta(seconds=5), START + timedelta(seconds=6))]
    results = spark.createDataFrame(
        rows, "table_name string, success boolean, started_at timestamp_ntz, ended_at timestamp_ntz"
    )
    found = {r["table_name"]: (r["total_columns"], r["failed"], r["success_rate"], r["duration"], r["overall"])
             for r in metrics.generation_stats(results).collect()}
    assert found == {"a": (2, 1, 50.0, 3.0, False), "b": (1, 1, 0.0, 1.0, False), None: (3, 2, 33.3, 6.0, True)}


def test_import_outcome_classes(spark):
    rows = [("c", "s", "all", True), ("c", "s", "some", True), ("c", "s", "some", False), ("c", "s", "none", False)]
    results = spark.createDataFrame(rows, "catalog_name string, schema_name string, table_name string, success boolean")
    found = {r["table_name"]: r["outcome"] for r in metrics.import_stats(results).collect()}
    assert found == {"all": "full", "some": "partial", "none": "none"}
    assert metrics.import_totals(results.where(F.lit(False))).first()["success_rate"] is None


def test_frame_summary(spark):
    rows = [(i, f"t{i % 3}", "pending" if i % 2 else None, "comment", START + timedelta(i)) for i in range(8)]
    items = make_items(
        spark, rows, "id long, table_name string, status string, metadata_type string, updated_at timestamp_ntz"
    )
    parts = metrics.frame_summary(items)
    assert tuple(parts["totals"].first()) == (8, 3)
    assert [tuple(r) for r in parts["status_distribution"].collect()] == [("pending", 4)]
    flat = {(r["section"], r["key"], r["n"]) for r in metrics.frame_summary_rows(items).collect()}
    assert {("total_items", None, 8), ("unique_tables", None, 3), ("status", "pending", 4)} <= flat
    assert {n for section, _, n in flat if section == "recent_activity"} == {3, 4, 5, 6, 7}


@pytest.mark.parametrize("ties", [1, 60, 10**9])
def test_newest_items_by_a_bound_on_the_time(spark, ties):
    """The newest n at any n, whatever share of the items has the same time or none."""
    rng = random.Random(ties)
    rows = [
        (i, None if rng.random() < 0.02 else START + timedelta(seconds=rng.randrange(10**6) // ties * ties, microseconds=7 * (ties == 1)))
        for i in range(3000)
    ]
    items = spark.createDataFrame(rows, "id long, created_at timestamp_ntz").repartition(3)
    order = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] - START).total_seconds() if r[1] else 0, -r[0]))
    for n in (0, 10, 500, 2999, 4000):
        found = {r["item"] for r in metrics._newest(items, n, item=F.col("id")).collect()}
        assert found == {r[0] for r in order[:n]}, n


def test_a_bound_leaves_little_to_sort(spark):
    times = spark.range(100_000).select(
        # Nearly all times lie in one minute of ten years.
        F.expr("timestampadd(MICROSECOND, if(id % 1000 = 0, id * 3000000000, id * 600), TIMESTAMP_NTZ'2015-01-01 00:00:00')").alias("time")
    )
    for n in (150, 5_000, 60_000):
        bound = metrics._time_bound(times, n)
        left = times.where(F.col("time") >= F.lit(bound.isoformat(" ")).cast("timestamp_ntz")).count()
        assert n <= left <= n * (1 + metrics.SURPLUS)
    assert metrics._time_bound(times, 100_000) is None
