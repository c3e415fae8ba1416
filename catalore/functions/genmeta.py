"""Generation metadata: the JSON record kept with each generated description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalore.functions.clock import iso_text
from catalore.schemas import GEN_META

# Fixed value: price per token used for every model unless the caller gives another.
COST_PER_TOKEN = 0.00003


def parse_generation(c: Column) -> Column:
    """The record as a struct; text that is no JSON gives NULL fields, never an error."""
    return F.from_json(c, GEN_META, {"mode": "PERMISSIVE"})


def sample_values(c: Column) -> Column:
    """The values of a sample kept as a JSON list, objects as JSON; NULL if it is none."""
    return F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})


def sample_text(c: Column) -> Column:
    """A sample as it is shown: its values, or the raw text that is no JSON list."""
    return F.coalesce(F.array_join(sample_values(c), ", "), c)


def generation_cost(tokens: Column, rate: float = COST_PER_TOKEN) -> Column:
    return tokens * F.lit(rate)


def method_tag(model: Column, prefix: str = "openai_") -> Column:
    return F.concat(F.lit(prefix), model)


def generation_record(as_of: Column, rate: float, extra: dict[str, Column] | None = None) -> Column:
    """JSON text of one generation; a failed one keeps only its error."""
    done = F.to_json(
        F.struct(
            F.col("model"),
            F.col("tokens_used"),
            generation_cost(F.col("tokens_used"), rate).alias("cost_estimate"),
            iso_text(as_of).alias("timestamp"),
            F.col("prompt_tokens"),
            F.col("completion_tokens"),
            *[value.alias(name) for name, value in (extra or {}).items()],
        )
    )
    failed = F.to_json(F.struct(F.col("error")))
    return F.when(F.col("error").isNotNull(), failed).otherwise(done)
