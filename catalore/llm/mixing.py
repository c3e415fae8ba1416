"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The token weights of the cells
are raked until their sums match the target shares of all three at once; a document of
a cell is then sampled with a probability in proportion to raked over actual tokens,
scaled so that the share ``keep`` of all tokens is expected to stay. A probability stops
at one; the scale makes up for it with the other cells.

Targets are a table (value, share) for a dimension, or by default the actual token shares
raised to ``temper`` (under one: small ones gain). Values without a target get none, and
are not sampled; a value that is given twice counts with its sum, and the shares of absent
values go to the others. Targets may contradict each other, where a value of one dimension
occurs with few of another: the rounds then end with a gap. For given targets a gap of over
``FAR`` raises TargetsConflict; for default ones it is a warning. ``shares`` shows the
target, raked and expected share of every value.

Only the narrow table of cells goes through the rounds; a round is written to the shared
folder. Sampling hashes the doc_id, so that a task that runs again decides alike; rows with
one doc_id share their fate.

A null source or language counts as the empty one, a null text as the empty text, and a
document weighs one token at least. An empty table gives an empty result. Other columns
are kept by ``mixed`` and not read otherwise.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalore.llm.common import fresh, whole_text
from catalore.session import cut_lineage

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.7
KEEP = 0.7
#: Rounds stop at this relative gap between a sum and its target, or after MOST_ROUNDS.
CLOSE = 1e-10
MOST_ROUNDS = 60
#: A target share that is missed by more than this is not met.
FAR = 1e-3
SEED = "mixing"


class TargetsConflict(ValueError):
    """The target shares of the dimensions cannot all be met."""


def topic() -> Column:
    """A coarse topic from the form of the text."""
    text = whole_text()
    return (
        F.when(text.contains(" | "), "listing")
        .when(text.contains("icense"), "notice")
        .when(text.rlike("[0-9]"), "records")
        .otherwise("prose")
    )


def tokens() -> Column:
    words = F.regexp_count(whole_text(), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.greatest(words, F.lit(1)).cast("long")


def cell_keys() -> dict[str, Column]:
    return {
        "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "topic": topic(),
    }


def weighed(docs: DataFrame) -> DataFrame:
    """doc_id, cell and tokens of every document, written once."""
    return cut_lineage(
        docs.select(
            "doc_id", *(c.alias(n) for n, c in cell_keys().items()), tokens().alias("tokens")
        )
    )


def tempered(cells: DataFrame, dimension: str, temper: float) -> DataFrame:
    """Target shares: the token shares of the values, flattened."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(temper)).alias("share"))
    return sums.select(F.col(dimension).alias("value"), "share")


def with_targets(cells: DataFrame, targets: dict[str, DataFrame], temper: float) -> DataFrame:
    """Cells with the target share of each of their values, shares summing to one."""
    for dimension in DIMENSIONS:
        wanted = targets.get(dimension)
        if wanted is None:
            wanted = tempered(cells, dimension, temper)
        else:
            wanted = wanted.groupBy("value").agg(F.sum("share").alias("share"))
        present = wanted.join(cells.select(dimension).distinct(), F.col("value") == F.col(dimension))
        whole = present.agg(F.sum("share")).first()[0] or 1.0
        shares = present.select(dimension, (F.col("share") / F.lit(whole)).alias(f"{dimension}_share"))
        cells = cut_lineage(
            cells.join(shares, dimension, "left").fillna(0.0, [f"{dimension}_share"])
        )
    return cells


def raked(cells: DataFrame) -> DataFrame:
    """Cells with ``weight``, whose sums match the target shares of every dimension."""
    whole = cells.agg(F.sum("tokens")).first()[0]
    weights = cells.withColumn("weight", F.col("tokens") / F.lit(float(whole or 1)))
    before = None
    for _ in range(MOST_ROUNDS if whole else 0):
        gaps = []
        for dimension in DIMENSIONS:
            sums = F.sum("weight").over(Window.partitionBy(dimension))
            factor = F.when(sums > 0, F.col(f"{dimension}_share") / sums).otherwise(0.0)
            weights = weights.withColumn("factor", factor)
            gaps.append(F.abs(F.col("factor") - 1))
            weights = weights.withColumn(f"gap_{dimension}", gaps[-1])
            weights = weights.withColumn("weight", F.col("weight") * F.col("factor"))
        weights = cut_lineage(
            weights.withColumn(
                "gap", F.when(F.col("weight") > 0, F.greatest(*(f"gap_{d}" for d in DIMENSIONS)))
            ).drop("factor", *(f"gap_{d}" for d in DIMENSIONS))
        )
        gap = weights.agg(F.max("gap")).first()[0]
        weights = weights.drop("gap")
        if gap is None or gap < CLOSE:
            break
        # Targets that contradict each other leave a gap that stays.
        if before is not None and gap > FAR and abs(gap - before) < CLOSE:
            break
        before = gap
    return weights


def remaining_gaps(weights: DataFrame) -> dict[str, float]:
    """The largest difference of a raked from its target share, for each dimension."""
    found = {}
    for dimension in DIMENSIONS:
        values = weights.groupBy(dimension).agg(
            F.sum("weight").alias("sum"), F.first(f"{dimension}_share").alias("share")
        )
        found[dimension] = values.agg(F.max(F.abs(F.col("sum") - F.col("share")))).first()[0] or 0.0
    return found


def check_targets(weights: DataFrame, given: bool) -> None:
    """Raise for given targets that are not met, warn for default ones."""
    missed = {d: gap for d, gap in remaining_gaps(weights).items() if gap > FAR}
    if missed:
        told = ", ".join(f"{d} by {gap:.4f}" for d, gap in missed.items())
        told = f"target shares contradict each other; after raking they are missed for {told}"
        if given:
            raise TargetsConflict(told)
        warnings.warn(told, stacklevel=3)


def probabilities(cells: DataFrame, keep: float) -> DataFrame:
    """Cells with the probability of their documents.

    The scale is found step by step: cells that reach one give up their excess to the
    others, until no further cell reaches one. Only sums come to the driver.
    """
    ratio = F.col("weight") / F.col("tokens")
    capped, scale = F.lit(False), None
    before = -1
    while True:
        sums = cells.agg(
            F.sum("tokens").alias("tokens"),
            F.sum(F.when(capped, F.col("tokens"))).alias("full"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
            F.count(F.when(capped, 1)).alias("cells"),
        ).first()
        if not sums["tokens"] or not sums["weight"] or sums["cells"] == before:
            break
        before = sums["cells"]
        scale = max(0.0, keep * sums["tokens"] - (sums["full"] or 0)) / sums["weight"]
        capped = ratio * F.lit(scale) >= 1
    return cells.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(scale or 0.0)))


def chance() -> Column:
    """A number from 0 to 1 that depends on the doc_id alone."""
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def fitted(
    narrow: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    temper: float = TEMPER,
    keep: float = KEEP,
) -> DataFrame:
    """The cells of the weighed documents with target shares, weight and probability."""
    cells = cut_lineage(narrow.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    weights = raked(with_targets(cells, targets or {}, temper))
    check_targets(weights, bool(targets))
    return cut_lineage(probabilities(weights, keep))


def calibrated(narrow: DataFrame, **settings) -> DataFrame:
    """(source, lang, topic, probability) for every cell of the weighed documents."""
    return fitted(narrow, **settings).select(*DIMENSIONS, "probability")


def shares(docs: DataFrame, **settings) -> DataFrame:
    """dimension, value and its shares of the tokens: ``target``, ``raked`` and ``expected``.

    The expected share is that of the sample. It differs from the raked one where a
    document would have to be taken more than once.
    """
    cells = fitted(weighed(docs), **settings)
    pairs = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(d).alias("dimension"), F.col(d).alias("value"),
                    F.col(f"{d}_share").alias("target"),
                )
                for d in DIMENSIONS
            )
        )
    )
    sampled = F.col("tokens") * F.col("probability")
    whole = cells.agg(F.sum(sampled)).first()[0] or 1.0
    return (
        cells.select(pairs.alias("of"), "weight", (sampled / F.lit(whole)).alias("sampled"))
        .groupBy("of.dimension", "of.value")
        .agg(
            F.first("of.target").alias("target"),
            F.sum("weight").alias("raked"),
            F.sum("sampled").alias("expected"),
        )
    )


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, cell, tokens, probability (to six places) and kept for every document."""
    narrow = weighed(docs)
    return narrow.join(calibrated(narrow, **settings), list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, "tokens",
        F.round("probability", 6).alias("probability"),
        (chance() < F.col("probability")).alias("kept"),
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The sampled rows of ``docs``, all columns."""
    cells = calibrated(weighed(docs), **settings)
    names = {n: fresh(docs, f"cell_{n}") for n in (*DIMENSIONS, "probability")}
    cells = cells.select(*(F.col(n).alias(names[n]) for n in names))
    keys = cell_keys()
    matches = [keys[n] == F.col(names[n]) for n in DIMENSIONS]
    joined = docs.join(cells, matches[0] & matches[1] & matches[2])
    return joined.filter(chance() < F.col(names["probability"])).select(*docs.columns)
