"""Tiered prices of model calls, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_tier(tiers: Column, total_input: Column, limit: str = "up_to") -> Column:
    """The first tier of an array whose limit is null or not below the call's input; null if none holds it."""
    return F.get(F.filter(tiers, lambda t: t[limit].isNull() | (total_input <= t[limit])), F.lit(0))


def call_cost(usage: Column, tier: Column, server_rates: Column) -> Column:
    """Dollars of a call: input, output, cache reads, every cache-write bucket at its rate, and server tools per request.

    ``usage``: input_tokens, output_tokens, cache_read_input_tokens, cache_creation and server_tool_use (maps).
    ``tier``: input, output, cache_read and cache_write (a map) per million. A bucket or tool without a rate gives null.
    """
    written = F.map_zip_with(usage["cache_creation"], F.coalesce(tier["cache_write"], F.create_map().cast("map<string,double>")), lambda k, n, r: F.when(n.isNull(), F.lit(0.0)).otherwise(n * r))
    served = F.map_zip_with(F.map_filter(usage["server_tool_use"], lambda k, n: n > 0), server_rates, lambda k, n, r: F.when(n.isNull(), F.lit(0.0)).otherwise(n * r))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, b: a + b)
    tokens = usage["input_tokens"] * tier["input"] + usage["output_tokens"] * tier["output"] + usage["cache_read_input_tokens"] * tier["cache_read"] + total(written)
    return tokens / F.lit(1_000_000.0) + total(served)
