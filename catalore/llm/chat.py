"""Logged conversations collapsed to the longest ones, then rendered for training.

A log holds snapshots: the same conversation again with more turns. Every turn gets the
hash of the conversation up to it, a running xor of hashes that depend on the place of a
turn, its role and its text (two of 64 bits). A conversation whose hash occurs inside
another one is a prefix of it; an anti-join leaves the others, and of equal ones the
least conv_id. Their turns are rendered and joined in parts of TURNS_OF_PART turns.

Turns are ranged over the tasks by conversation and turn, so that a conversation that
holds a large share of the rows lies in several tasks; each works on its own piece, and
the few conversations that cross a border are adjusted by what the earlier pieces hold.

Turns are ordered by turn (null first), role and the digest of the text. Rows equal in
conv_id, turn, role and text count once. A null role or text counts as the empty one; the
rows with a null conv_id are one conversation. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalore.llm.common import whole_text
from catalore.session import cut_lineage

#: Turns in one part of a rendered conversation; longer ones have several parts.
TURNS_OF_PART = 512
START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"

PREFIX = ["place", "one", "two"]


def logged_turns(log: DataFrame) -> DataFrame:
    return log.select(
        "conv_id", "turn", whole_text("role").alias("role"), whole_text("text").alias("text")
    ).distinct()


def same_piece(left: DataFrame, right: DataFrame) -> Column:
    return left["conv_id"].eqNullSafe(right["crossing"]) & (left["piece"] == right["part_of"])


def numbered(log: DataFrame) -> DataFrame:
    """Turns with the task's ``piece``, the place in the conversation, and whether it is last."""
    order = ["conv_id", "turn", "role", "digest"]
    ranged = logged_turns(log).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    turns = cut_lineage(
        ranged.repartitionByRange(*order).withColumn("piece", F.spark_partition_id())
    )
    earlier = Window.partitionBy("conv_id").orderBy("piece")
    pieces = turns.groupBy("conv_id", "piece").agg(F.count("*").alias("turns"))
    crossing = cut_lineage(
        pieces.select(
            F.col("conv_id").alias("crossing"), F.col("piece").alias("part_of"),
            F.coalesce(
                F.sum("turns").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("before"),
            F.lead("piece").over(earlier).isNotNull().alias("goes_on"),
        ).filter("before > 0 OR goes_on")
    )
    within = Window.partitionBy("piece", "conv_id").orderBy("turn", "role", "digest")
    placed = turns.select(
        "*",
        F.row_number().over(within).alias("local"),
        F.lead("digest").over(within).isNull().alias("ends"),
    )
    return placed.join(crossing, same_piece(placed, crossing), "left").select(
        "conv_id", "piece", "role", "text", "digest",
        (F.col("local") + F.coalesce("before", F.lit(0))).cast("long").alias("place"),
        (F.col("ends") & ~F.coalesce("goes_on", F.lit(False))).alias("last"),
        F.col("crossing").isNotNull().alias("crosses"),
    )


def with_prefix_hashes(log: DataFrame) -> DataFrame:
    """Turns with two hashes of the conversation up to and including each."""
    turns = numbered(log).withColumns(
        {
            "one": F.xxhash64("place", "role", "text"),
            "two": F.xxhash64("digest", "role", "place"),
        }
    )
    until = Window.partitionBy("piece", "conv_id").orderBy("place").rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = cut_lineage(
        turns.select(
            "conv_id", "piece", "role", "text", "place", "last", "crosses",
            *(F.bit_xor(n).over(until).alias(n) for n in ("one", "two")),
        )
    )
    # The last running value of a piece is the piece's whole; a few pieces at most cross.
    ends = local.filter("crosses").groupBy("conv_id", "piece").agg(
        F.max_by(F.struct("one", "two"), "place").alias("whole")
    )
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = cut_lineage(
        ends.select(
            F.col("conv_id").alias("crossing"), F.col("piece").alias("part_of"),
            F.bit_xor("whole.one").over(earlier).alias("one_before"),
            F.bit_xor("whole.two").over(earlier).alias("two_before"),
        ).filter("one_before IS NOT NULL")
    )
    return local.join(before, same_piece(local, before), "left").select(
        "conv_id", "role", "text", "place", "last",
        *(
            F.col(n).bitwiseXOR(F.coalesce(f"{n}_before", F.lit(0).cast("long"))).alias(n)
            for n in ("one", "two")
        ),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that no longer one begins with."""
    inside = turns.filter(~F.col("last")).select(*PREFIX).distinct()
    whole = turns.filter("last").groupBy(*PREFIX).agg(F.min("conv_id").alias("kept"))
    return whole.join(inside, PREFIX, "left_anti").select("kept")


def rendered_turn() -> Column:
    return F.concat(F.lit(START), "role", F.lit(BREAK), "text", F.lit(END))


def rendered(log: DataFrame) -> DataFrame:
    """conv_id, part, n_turns and text of the parts of every maximal conversation."""
    turns = cut_lineage(with_prefix_hashes(log))
    kept = cut_lineage(maximal(turns))
    chosen = turns.join(kept, turns["conv_id"].eqNullSafe(kept["kept"]), "left_semi")
    part = F.floor((F.col("place") - 1) / F.lit(TURNS_OF_PART)).cast("long")
    ordered = F.sort_array(F.collect_list(F.struct("place", rendered_turn().alias("text"))))
    return chosen.groupBy("conv_id", part.alias("part")).agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(ordered, lambda turn: turn["text"]), "").alias("text"),
    )
