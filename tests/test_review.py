import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalore.operators import review
from catalore.operators.items import items_with_history
from catalore.operators.numbering import with_row_number
from catalore.schemas import ACTIONS, ITEMS
from catalore.sources.store import conform

START = datetime(2024, 1, 1)


def make_items(spark, n):
    rows = [(i, f"text {i}", "pending") for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, current_value string, status string")
    return conform(frame.withColumn("generated_value", F.col("current_value")), ITEMS)


def random_actions(seed, n, items, hot_share):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        item = 0 if rng.random() < hot_share else rng.randrange(-1, items)
        status = rng.choice(["approved", "rejected", "edited", "archived"])
        value = None if rng.random() < 0.1 else f"value {i}"
        # Few distinct times, so ties must fall back to the action id.
        rows.append((i, item, value, status, f"user {i % 5}", None, START + timedelta(minutes=rng.randrange(40))))
    rng.shuffle(rows)
    return rows


def fold(current, actions):
    """The actions one after the other."""
    state, audit, rejected = dict(current), {}, set()
    for action_id, item, value, status, user, _, ts in sorted(actions, key=lambda a: (a[6], a[0])):
        if status not in ("approved", "rejected", "edited") or value is None or item not in state:
            rejected.add(action_id)
            continue
        audit[action_id] = (item, status, state[item][0], value, user, ts)
        state[item] = (value, status, user, ts)
    return state, audit, rejected


@pytest.mark.parametrize("seed, hot_share", [(1, 0.0), (2, 0.4), (3, 0.95)])
def test_reviews_equal_the_actions_one_after_the_other(spark, seed, hot_share):
    items = make_items(spark, 30)
    rows = random_actions(seed, 600, 30, hot_share)
    actions = spark.createDataFrame(rows, ACTIONS).repartition(7)
    state, audit, rejected = fold({i: (f"text {i}", "pending", None, None) for i in range(30)}, rows)

    outcome = review.apply_reviews(items, actions)
    found = {
        r["id"]: (r["current_value"], r["status"], r["reviewed_by"], r["reviewed_at"])
        for r in outcome.items.collect()
    }
    assert found == state
    logged = outcome.audit.collect()
    fields = ("metadata_item_id", "action", "old_value", "new_value", "user_name", "timestamp")
    assert sorted(tuple(r[f] for f in fields) for r in logged) == sorted(audit.values())
    assert sorted(r["id"] for r in logged) == list(range(1, len(audit) + 1))
    history = spark.createDataFrame([(70,), (None,)], "id long")
    later = review.review_audit_rows(items, actions, history).agg(F.min("id"), F.max("id")).first()
    assert tuple(later) == (71, 70 + len(audit))
    turned_away = [r["action_id"] for r in outcome.rejected.collect()]
    assert sorted(turned_away) == sorted(rejected)


def test_a_busy_item_spans_partitions(spark):
    """One item with all actions: its rows are spread, and the links still hold."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, 0, f"v{i}", "edited", "u", None, START) for i in range(4000)]
        actions = spark.createDataFrame(rows, ACTIONS).repartition(4)
        logged = review.review_audit_rows(make_items(spark, 2), actions)
        found = {r["new_value"]: r["old_value"] for r in logged.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {f"v{i}": (f"v{i - 1}" if i else "text 0") for i in range(4000)}


def test_audit_rows_move_once_after_the_sort(spark):
    """No join of the actions with themselves: one shuffle of the staged rows, by piece."""
    actions = spark.createDataFrame(random_actions(4, 50, 5, 0.2), ACTIONS)
    plan = review.review_audit_rows(make_items(spark, 5), actions)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "FileScan parquet" in line and "comment" in line]
    assert len(wide) == 1 and "SortMergeJoin" not in plan
    assert all("part" in line or "SinglePartition" in line for line in plan.splitlines() if " Exchange " in line)


def test_actions_of_unknown_items_between_known_ones(spark):
    """Pieces that begin or end with unknown items, and a stored value that is NULL."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, i % 40, f"v{i}", "edited", "u", None, START) for i in range(400)]
        items = make_items(spark, 40).where("id % 3 = 0").withColumn("current_value", F.expr("nullif(current_value, 'text 6')"))
        logged = review.review_audit_rows(items, spark.createDataFrame(rows, ACTIONS).repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = {i: None if i == 6 else f"text {i}" for i in range(0, 40, 3)}
    want = {f"v{i}": f"v{i - 40}" if i >= 40 else first[i % 40] for i in range(400) if i % 40 % 3 == 0}
    assert {r["new_value"]: r["old_value"] for r in logged} == want
    assert sorted(r["id"] for r in logged) == list(range(1, len(want) + 1))


def test_missing_and_repeated_action_ids(spark):
    """Every action gets one audit row, whatever ids the caller gave."""
    times = [START + timedelta(minutes=i) for i in range(5)]
    rows = [
        (None, 1, "a", "edited", "u", None, times[0]), (None, 1, "b", "edited", "u", None, times[1]),
        (7, 1, "c", "edited", "u", None, times[2]), (7, 1, "d", "edited", "u", None, times[3]),
        (7, 0, "e", "edited", "u", None, times[4]),
    ]
    logged = review.review_audit_rows(make_items(spark, 2), spark.createDataFrame(rows, ACTIONS)).collect()
    found = sorted((r["metadata_item_id"], r["old_value"], r["new_value"]) for r in logged)
    assert found == [(0, "text 0", "e"), (1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (1, "text 1", "a")]
    assert len({r["id"] for r in logged}) == 5


def test_outcomes_are_made_when_asked_for(spark):
    items, actions = make_items(spark, 3), spark.createDataFrame([], ACTIONS)
    outcome = review.apply_reviews(items, actions)
    assert "audit" not in vars(outcome) and outcome.items.count() == 3
    assert "audit" not in vars(outcome) and "rejected" not in vars(outcome)


def test_row_numbers_are_global(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # A third of the rows share their sort value; the id makes the order total.
        frame = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
        numbered = with_row_number(frame.repartition(6), ["k", "id"], "n")
        by_key = with_row_number(frame.repartition(6), ["k", "id"], "n", key="id")
        found = {r["id"]: r["n"] for r in numbered.collect()}
        assert {r["id"]: r["n"] for r in by_key.collect()} == found
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted(range(3000), key=lambda i: (7 if i % 3 == 0 else i % 50, i))
    assert found == {i: place for place, i in enumerate(ordered, 1)}


def test_items_with_history_keeps_silent_items(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, table_name string")
    history = spark.createDataFrame(
        [(9, 1, "approved", None, "x", "u", START), (10, 1, "edited", "x", "y", "u", START)],
        "id long, metadata_item_id long, action string, old_value string, new_value string, user_name string, timestamp timestamp_ntz",
    )
    rows = items_with_history(items, history).collect()
    assert sorted((r["id"], r["history_id"] or 0) for r in rows) == [(1, 9), (1, 10), (2, 0)]
