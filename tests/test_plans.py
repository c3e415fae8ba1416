"""The plans are the ones meant to run on a cluster."""

import re

import pytest

from catalore.operators import items as item_ops
from catalore.operators import profile
from catalore.registry.spark_queries import queries
from catalore.registry.views import Views

SF = "/root/testdata/sf0.001"
#: Descriptions, and samples: no built-in aggregate keeps k distinct values of a task.
WITH_PYTHON = {
    "generated_descriptions", "generate_column_items", "generate_table_items", "column_samples",
    "generation_inputs", "column_prompts",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def frames(spark):
    return {name: query(spark, SF) for name, query in queries().items()}


@pytest.fixture(scope="module")
def plans(frames):
    return {name: plan_of(frame) for name, frame in frames.items()}


def test_python_runs_only_for_descriptions(plans):
    python = re.compile("BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroups")
    assert {name for name, plan in plans.items() if python.search(plan)} == WITH_PYTHON


def test_no_cross_joins(plans):
    assert not [n for n, plan in plans.items() if "CartesianProduct" in plan or "NestedLoopJoin" in plan]


def test_single_partition_exchanges_carry_bounded_rows(plans):
    """Only aggregates, top-n rows, one row of each piece and samples meet in one task."""
    for name, plan in plans.items():
        lines = plan.splitlines()
        for above, line in zip(lines[1:], lines):
            if "Exchange SinglePartition" in line:
                assert re.search(
                    "HashAggregate|SortAggregate|TakeOrdered|LocalLimit|WindowGroupLimit|ObjectHash|MapInArrow", above
                ) or "Project [part#" in above or "offsets" in name, (name, line, above)


def test_top_n_never_sorts_everything(plans):
    tops = (
        "recent_activity activity_timeline cost_extrapolation frame_summary "
        "table_sample sample_json table_generation_inputs table_prompts import_preview"
    )
    for name in tops.split():
        assert "TakeOrderedAndProject" in plans[name], name
        assert "rangepartitioning" not in plans[name], name


def test_a_run_of_newest_items_meets_in_no_task(plans):
    for name in ("cost_total", "recent_quality"):
        assert "TakeOrderedAndProject" not in plans[name] and "GlobalLimit" not in plans[name], name


def test_salted_queries_split_hot_keys(plans):
    for name in ("items_with_history_salted", "import_valid_tables_salted", "verify_columns_salted"):
        assert "_salt" in plans[name] and "xxhash64" in plans[name], name


def test_filters_and_columns_reach_the_scan(spark):
    stored = Views(spark, SF).table("documents").withColumnRenamed("source", "table_name")
    plan = plan_of(item_ops.filter_items(stored, table_name="src1").select("doc_id"))
    assert "EqualTo(source,src1)" in plan
    assert "text" not in re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)


def test_counts_do_not_read_texts(plans):
    for name in ("status_counts", "summary_stats", "items_per_table", "approval_rates"):
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plans[name])
        assert schemas and not any("text" in s for s in schemas), name


def test_profile_scans_each_table_once(spark):
    lineitem = Views(spark, SF).table("lineitem")
    plan = plan_of(profile.column_samples({"lineitem": lineitem}))
    # Between the scan and the only exchange a task keeps its k smallest values.
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1
    assert plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow") < plan.index("FileScan")


def test_every_query_reads_the_given_tables(frames):
    # Streams read the events through the stream's own tables, the numbered queries
    # through the shared folder.
    staged = {
        "import_batches", "stream_latest_action", "stream_status_counts", "cost_total",
        "recent_quality", "import_history_rows", "upload_round_trip", "review_audit_rows",
        "review_audit_of_odd_ids",
    }
    for name, frame in frames.items():
        files = frame.inputFiles()
        assert name in staged or any(SF in file for file in files), name
