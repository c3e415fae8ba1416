"""Counts, rates, costs and lengths.

Every aggregate is partial on the map side, so one very frequent key costs one
row per task in the shuffle. Totals over several groupings start from the
smallest grouped counts instead of expanding the base rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalore.functions.clock import seconds_between
from catalore.functions.genmeta import parse_generation
from catalore.functions.names import percent
from catalore.operators.items import newest_first, recent
from catalore.operators.numbering import with_row_number
from catalore.schemas import APPROVED_STATUSES, TABLE_KEYS


def rows() -> Column:
    return F.count(F.lit(1))


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(rows().alias("n"))


def summary_stats(items: DataFrame) -> DataFrame:
    """Status counts and the grand total; a NULL status stays apart from the total."""
    return (
        status_counts(items)
        .rollup("status")
        .agg(F.sum("n").alias("n"), F.grouping("status").alias("is_total"))
        .select(
            F.when(F.col("is_total") == 1, F.lit("total"))
            .otherwise(F.col("status"))
            .alias("status"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
            (F.col("is_total") == 1).alias("is_total"),
        )
    )


def chart_counts(stats: DataFrame) -> DataFrame:
    """The status groups of a summary that have rows, without the total."""
    return stats.where(~F.col("is_total") & (F.col("n") > 0)).select("status", "n")


def items_per_table(items: DataFrame) -> DataFrame:
    return items.groupBy(*TABLE_KEYS).agg(rows().alias("column_count"))


def avg_cost_by_method(items: DataFrame) -> DataFrame:
    """Mean recorded cost per generation method, over items that have metadata."""
    cost = parse_generation(F.col("generation_metadata"))["cost_estimate"]
    return (
        items.where(F.col("generation_metadata").isNotNull())
        .groupBy("generation_method")
        .agg(F.avg(cost).alias("avg_cost"))
    )


def generation_costs(items: DataFrame, rate: float) -> DataFrame:
    """Tokens and the cost they come to at a rate, per item with known tokens."""
    tokens = parse_generation(F.col("generation_metadata"))["tokens_used"]
    return (
        items.select("id", "generation_method", tokens.alias("tokens_used"))
        .where(F.col("tokens_used").isNotNull())
        .withColumn("cost", F.col("tokens_used") * F.lit(rate))
    )


def description_lengths(items: DataFrame, value: str = "generated_value") -> DataFrame:
    length = F.length(value).cast("bigint")
    return items.agg(
        F.avg(length).alias("avg_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.count(length).alias("n"),
    )


def token_usage(items: DataFrame) -> DataFrame:
    """Mean, smallest and largest token count over items that record one."""
    tokens = parse_generation(F.col("generation_metadata"))["tokens_used"]
    return items.select(tokens.alias("tokens")).agg(
        F.avg("tokens").alias("avg_tokens"),
        F.min("tokens").alias("min_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.count("tokens").alias("n"),
    )


def value_counts(items: DataFrame, column: str) -> DataFrame:
    """Counts per value, largest first; NULL is left out."""
    counted = items.where(F.col(column).isNotNull()).groupBy(column).agg(rows().alias("n"))
    return counted.orderBy(F.desc("n"), column)


def type_distribution(items: DataFrame) -> DataFrame:
    return value_counts(items, "metadata_type")


def frame_summary(items: DataFrame) -> dict[str, DataFrame]:
    """Size, distinct tables, distributions and the five latest items."""
    return {
        "totals": items.agg(
            rows().alias("total_items"), F.countDistinct("table_name").alias("unique_tables")
        ),
        "status_distribution": value_counts(items, "status"),
        "metadata_types": value_counts(items, "metadata_type"),
        "recent_activity": recent(items, "updated_at", 5),
    }


def frame_summary_rows(items: DataFrame) -> DataFrame:
    """The same as one frame of (section, key, n): the counts come from one scan."""
    # Grouped counts are as many rows as there are (table, status, type) combinations.
    counts = items.groupBy("table_name", "status", "metadata_type").agg(rows().alias("n"))
    totals = (
        counts.groupingSets([[], ["status"], ["metadata_type"]], "status", "metadata_type")
        .agg(
            F.sum("n").alias("n"),
            F.countDistinct("table_name").alias("tables"),
            F.grouping_id().alias("grouping"),
        )
        .select(
            F.explode(
                F.when(
                    F.col("grouping") == 3,
                    F.array(
                        _entry("total_items", F.lit(None).cast("string"), F.col("n")),
                        _entry("unique_tables", F.lit(None).cast("string"), F.col("tables")),
                    ),
                )
                .when(
                    (F.col("grouping") == 1) & F.col("status").isNotNull(),
                    F.array(_entry("status", F.col("status"), F.col("n"))),
                )
                .when(
                    (F.col("grouping") == 2) & F.col("metadata_type").isNotNull(),
                    F.array(_entry("metadata_type", F.col("metadata_type"), F.col("n"))),
                )
            ).alias("entry")
        )
        .select("entry.*")
    )
    latest = recent(items, "updated_at", 5).select(
        F.lit("recent_activity").alias("section"),
        F.col("status").alias("key"),
        F.col("id").alias("n"),
    )
    return totals.unionByName(latest)


def _entry(section: str, key: Column, n: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"), key.alias("key"), n.cast("bigint").alias("n")
    )


def filter_values(items: DataFrame) -> DataFrame:
    """Distinct catalogs and tables offered as filters, from one scan."""
    # Distinct first: only the pairs that exist are expanded, not every row.
    pairs = items.select("catalog_name", "table_name").distinct().select(
        F.explode(
            F.array(
                F.struct(F.lit("catalog").alias("kind"), F.col("catalog_name").alias("value")),
                F.struct(F.lit("table").alias("kind"), F.col("table_name").alias("value")),
            )
        ).alias("pair")
    )
    return pairs.select("pair.*").distinct().orderBy("kind", "value")


def approval_rates(items: DataFrame) -> DataFrame:
    """Share of approved or edited items per generation method."""
    counted = items.groupBy("generation_method").agg(
        rows().alias("total"),
        F.count_if(F.col("status").isin(APPROVED_STATUSES)).alias("approved"),
        F.count_if(F.col("status") == "pending").alias("pending"),
    )
    return counted.withColumn("approval_rate", percent(F.col("approved"), F.col("total")))


def generation_stats(results: DataFrame) -> DataFrame:
    """Per table and overall: columns, outcomes, duration and success rate.

    ``results``: table_name, success, started_at, ended_at per generated row.
    """
    per_table = results.groupBy("table_name").agg(
        rows().alias("total"),
        F.count_if("success").alias("successful"),
        F.min("started_at").alias("start_time"),
        F.max("ended_at").alias("end_time"),
    )
    rolled = per_table.rollup("table_name").agg(
        F.sum("total").alias("total"),
        F.sum("successful").alias("successful"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.grouping("table_name").alias("overall"),
    )
    return rolled.select(
        "table_name",
        (F.col("overall") == 1).alias("overall"),
        F.col("total").alias("total_columns"),
        "successful",
        (F.col("total") - F.col("successful")).alias("failed"),
        percent(F.col("successful"), F.col("total")).alias("success_rate"),
        seconds_between(F.col("start_time"), F.col("end_time")).alias("duration"),
    )


#: Bars of one histogram, and the share of rows beyond n that are sorted at most.
BARS = 1024
SURPLUS = 1.0
MICROSECOND = timedelta(microseconds=1)


def _time_bound(times: DataFrame, n: int) -> datetime | None:
    """A time that at least n rows of ``time`` reach, few more; None where all rows are needed.

    Rows without a time count as newest. Histograms of the times narrow the bound down, a
    scan each; only their bars reach the driver. Times that are equal cannot be parted.
    """
    low, high, known, missing = times.agg(
        F.min("time"), F.max("time"), F.count("time"), F.count_if(F.col("time").isNull())
    ).first()
    wanted, above = n - missing, 0
    if wanted <= 0:
        return datetime.max
    if known <= wanted:
        return None
    while low < high:
        # Bars of whole microseconds, counted from the top.
        step = max(1, -(-((high - low) // MICROSECOND + 1) // BARS))
        first, last = (F.lit(t.isoformat(" ")).cast("timestamp_ntz") for t in (low, high))
        bars = (
            times.where(F.col("time").between(first, last))
            .select(F.floor(F.timestamp_diff("MICROSECOND", "time", last) / step).cast("long").alias("bar"))
            .groupBy("bar").count().orderBy("bar").collect()
        )
        for bar, count in bars:
            if above + count >= wanted:
                break
            above += count
        high -= bar * step * MICROSECOND
        low = max(low, high - (step - 1) * MICROSECOND)
        if above + count <= wanted * (1 + SURPLUS):
            break
    return low


def _newest(items: DataFrame, n: int, **fields: Column) -> DataFrame:
    """``fields`` of the newest n items, for an n as large as a run.

    A bound on the time leaves little more than n items to read in full; these are
    numbered over all tasks, narrow ones. A top-n would merge n rows in one task.
    """
    bound = _time_bound(items.select(F.col("created_at").alias("time")), n)
    if bound is not None:
        time = F.col("created_at")
        items = items.where(time.isNull() | (time >= F.lit(bound.isoformat(" ")).cast("timestamp_ntz")))
    narrow = items.select("created_at", "id", *(c.alias(name) for name, c in fields.items()))
    numbered = with_row_number(narrow, newest_first("created_at", nulls_first=True), "_newest")
    return numbered.where(F.col("_newest") <= n).select(*fields)


def _sampled_costs(items: DataFrame, n: int) -> DataFrame:
    """Cost and token sums of the newest few items, by a top-n.

    The JSON is parsed inside the aggregate: a projection of its fields on top of
    the limit would part it from the sort, and Spark would sort every item.
    """
    newest = recent(items, "created_at", n, nulls_first=True).select("generation_metadata")
    meta = parse_generation(F.col("generation_metadata"))
    return newest.agg(
        F.coalesce(F.sum(meta["cost_estimate"]), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum(meta["tokens_used"]), F.lit(0)).alias("total_tokens"),
        rows().alias("sampled"),
    ).where(F.col("total_cost") > 0)


def cost_extrapolation(items: DataFrame, successes: int, sample: int = 10) -> DataFrame:
    """Run cost from the newest items: mean cost (items without metadata count) x successes.

    No row when the sampled cost is zero.
    """
    average = F.col("total_cost") / F.col("sampled")
    # Integral division, as the token estimate is a count.
    tokens = F.expr(f"(total_tokens * {int(successes)}) div sampled")
    return _sampled_costs(items, sample).select(
        (average * successes).alias("estimated_total_cost"),
        average.alias("avg_cost"),
        tokens.alias("estimated_tokens"),
        "sampled",
    )


def cost_total(items: DataFrame, successes: int) -> DataFrame:
    """Cost of the newest ``successes`` items; no row when it is zero."""
    meta = parse_generation(F.col("generation_metadata"))
    newest = _newest(items, successes, cost=meta["cost_estimate"], tokens=meta["tokens_used"])
    sums = newest.agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
    ).where(F.col("total_cost") > 0)
    return sums.select(
        "total_cost", (F.col("total_cost") / successes).alias("avg_cost"), "total_tokens"
    )


def recent_quality(items: DataFrame, n: int) -> DataFrame:
    """Lengths and token counts of the newest n descriptions."""
    newest = _newest(
        items,
        n,
        length=F.length("generated_value").cast("bigint"),
        tokens=parse_generation(F.col("generation_metadata"))["tokens_used"],
    )
    length, tokens = F.col("length"), F.col("tokens")
    return newest.agg(
        F.avg(length).alias("avg_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.avg(tokens).alias("avg_tokens"),
        F.min(tokens).alias("min_tokens"),
        F.max(tokens).alias("max_tokens"),
    )


def import_stats(results: DataFrame) -> DataFrame:
    """Import outcome per table, with full / partial / none as its class."""
    counted = results.groupBy(*TABLE_KEYS).agg(
        rows().alias("total_columns"), F.count_if("success").alias("successful_columns")
    )
    rated = counted.withColumn(
        "success_rate", percent(F.col("successful_columns"), F.col("total_columns"))
    )
    return rated.withColumn(
        "outcome",
        F.when(F.col("success_rate") == 100, "full")
        .when(F.col("success_rate") > 0, "partial")
        .otherwise("none"),
    )


def import_totals(results: DataFrame) -> DataFrame:
    counted = results.agg(rows().alias("total"), F.count_if("success").alias("successful"))
    return counted.select(
        "total",
        "successful",
        (F.col("total") - F.col("successful")).alias("failed"),
        percent(F.col("successful"), F.col("total")).alias("success_rate"),
    )


def filtered_count(items: DataFrame) -> DataFrame:
    return items.agg(rows().alias("n"))
