"""Reviews as one set-based step: actions in, new item state and audit rows out.

Actions take effect in the order of (ts, action_id). An item may hold any share of
them: aggregates are partial, and no task gets all actions of a busy item.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalore.operators.numbering import fixed_order, largest_id, partition_of
from catalore.operators.skew import join_spread
from catalore.schemas import ITEMS, REVIEW_STATUSES


class ReviewOutcome:
    """What a set of actions leads to; each frame is made when it is asked for."""

    def __init__(self, items: DataFrame, actions: DataFrame, history: DataFrame | None) -> None:
        self._items, self._actions, self._history = items, actions, history

    @cached_property
    def items(self) -> DataFrame:
        """Every item in its state after the actions."""
        return reviewed_items(self._items, self._actions)

    @cached_property
    def audit(self) -> DataFrame:
        """One row per applied action, with the value it replaced."""
        return review_audit_rows(self._items, self._actions, self._history)

    @cached_property
    def rejected(self) -> DataFrame:
        """Actions not applied, with the reason."""
        return rejected_reviews(self._items, self._actions)


def acceptable() -> Column:
    """Actions the store can hold: a known review status, an item and a value."""
    return (
        F.coalesce(F.col("status").isin(REVIEW_STATUSES), F.lit(False))
        & F.col("item_id").isNotNull()
        & F.col("new_value").isNotNull()
    )


def _item_ids(items: DataFrame) -> DataFrame:
    return items.select(F.col("id").alias("item_id"))


def unknown_reviews(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Acceptable actions whose item does not exist."""
    valid = actions.where(acceptable())
    kept = join_spread(valid, _item_ids(items), ["item_id"], "left_anti", spread_by="action_id")
    return kept.select(*actions.columns)


def rejected_reviews(items: DataFrame, actions: DataFrame) -> DataFrame:
    invalid = actions.where(~acceptable()).withColumn(
        "reason",
        F.when(F.col("item_id").isNull(), "missing item")
        .when(F.col("new_value").isNull(), "missing value")
        .otherwise("invalid status"),
    )
    unknown = unknown_reviews(items, actions).withColumn("reason", F.lit("unknown item"))
    return invalid.unionByName(unknown)


def latest_action(actions: DataFrame) -> DataFrame:
    """The action that decides each item's state."""
    fields = ["ts", "action_id", "status", "new_value", "reviewed_by"]
    return (
        actions.groupBy("item_id")
        .agg(F.max_by(F.struct(*fields), F.struct("ts", "action_id")).alias("last"))
        .select("item_id", "last.*")
    )


def _with_stored(items: DataFrame, actions: DataFrame, order: list[str]) -> DataFrame:
    """The acceptable actions, and the stored value of every item they name as a row before them."""
    valid = actions.where(acceptable()).select(*order, F.lit(True).alias("acts"))
    acted = valid.select(F.col("item_id").alias("id")).distinct()
    stored = items.join(acted, "id", "left_semi").select(
        F.col("id").alias("item_id"), F.col("current_value").alias("new_value"), F.lit(False).alias("acts")
    )
    return valid.unionByName(stored, allowMissingColumns=True)


def review_audit_rows(
    items: DataFrame, actions: DataFrame, history: DataFrame | None = None
) -> DataFrame:
    """One audit row per applied action, with the value it replaced.

    That is the value the action before it set, or the stored value for the first action.
    Stored values are sorted with the actions as the first row of their item, so that a
    row's predecessor has the value in either case, and items without a stored row are
    unknown. The rows are range-sorted over all tasks by item, time and id; the rows of a
    busy item lie in several pieces. Predecessors are looked up inside a piece; the first
    row of a piece takes what the pieces before it end with, one row of each. A row's
    position is unique whatever ids the caller gave. Ids of the audit rows follow the
    largest one of ``history`` in the same order.
    """
    # Ties in time and id are settled by what the actions say.
    fields = ["item_id", "ts", "action_id", "new_value", "status", "reviewed_by", "comment"]
    rows = _with_stored(items, actions, fields)
    placed = fixed_order(rows, ["item_id", "acts", *fields[1:]], "position").withColumn(
        "part", partition_of(F.col("position"))
    )
    within = W.partitionBy("part").orderBy("position")
    stored_item = F.when(~F.col("acts"), F.col("item_id"))
    last_stored = F.last(stored_item, ignorenulls=True).over(within)
    # One row per piece: small whatever the data size.
    ends = placed.groupBy("part").agg(
        F.max("position").alias("position"), F.max(stored_item).alias("end_stored")
    )
    earlier = W.orderBy("part")
    before = earlier.rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("part", F.max("end_stored").over(before).alias("carried_stored"))
    end_values = placed.select("position", "new_value").join(F.broadcast(ends), "position")
    carried_values = end_values.select("part", F.lag("new_value").over(earlier).alias("carried_value"))
    known = F.col("acts") & (F.col("item_id") == F.coalesce(F.col("last_stored"), F.col("carried_stored")))
    # Which rows are applied takes a few integers of each; their counts give the ids.
    applied = (
        placed.select("part", "position", "item_id", "acts")
        .withColumn("last_stored", last_stored)
        .join(F.broadcast(carried), "part")
        .groupBy("part").agg(F.sum(known.cast("long")).alias("applied"))
    )
    offsets = applied.select(
        "part", F.coalesce(F.sum("applied").over(before), F.lit(0)).alias("applied_before")
    )
    linked = (
        placed.withColumns({
            "last_stored": last_stored,
            "value_before": F.lag("new_value").over(within),
            "place": F.row_number().over(within),
        })
        .join(F.broadcast(carried.join(carried_values, "part").join(offsets, "part")), "part")
        .withColumn("known", known)
        .withColumn("number", F.sum(F.col("known").cast("long")).over(within) + F.col("applied_before"))
        .where("known")
    )
    # The stored row comes before all actions of its item, so a predecessor is of that item.
    return linked.select(
        (F.col("number") + largest_id(history)).cast("bigint").alias("id"),
        F.col("item_id").alias("metadata_item_id"),
        F.col("status").alias("action"),
        F.when(F.col("place") == 1, F.col("carried_value")).otherwise(F.col("value_before")).alias("old_value"),
        "new_value",
        "comment",
        F.col("reviewed_by").alias("user_name"),
        F.col("ts").alias("timestamp"),
    )


def reviewed_items(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Every item after the actions; items without actions stay as they are."""
    last = latest_action(actions.where(acceptable())).select(
        F.col("item_id").alias("id"), F.struct("ts", "status", "new_value", "reviewed_by").alias("last")
    )
    acted = F.col("last").isNotNull()

    def after(name: str, field: str) -> Column:
        return F.when(acted, F.col(f"last.{field}")).otherwise(F.col(name)).alias(name)

    changes = {
        "current_value": "new_value",
        "status": "status",
        "updated_at": "ts",
        "reviewed_by": "reviewed_by",
        "reviewed_at": "ts",
    }
    joined = items.join(last, "id", "left")
    return joined.select(
        *[after(n, changes[n]) if n in changes else F.col(n) for n in ITEMS.fieldNames()]
    )


def actions_of(history: DataFrame) -> DataFrame:
    """Review rows of the history as actions; import rows are left out."""
    return history.where(F.col("action").isin(REVIEW_STATUSES)).select(
        F.col("id").alias("action_id"),
        F.col("metadata_item_id").alias("item_id"),
        "new_value",
        F.col("action").alias("status"),
        F.col("user_name").alias("reviewed_by"),
        "comment",
        F.col("timestamp").alias("ts"),
    )


def current_items(items: DataFrame, history: DataFrame) -> DataFrame:
    """Items as the history leaves them: the view to read while reviews are only logged."""
    return reviewed_items(items, actions_of(history))


def apply_reviews(
    items: DataFrame, actions: DataFrame, history: DataFrame | None = None
) -> ReviewOutcome:
    return ReviewOutcome(items, actions, history)
