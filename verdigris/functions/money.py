"""Costs as columns. Sums run over exact decimals of micro-dollars, so no order of rows or partitions changes a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Micro-dollars with six further digits.
MICRO = "decimal(38,6)"


def micro(usd: Column) -> Column:
    """Dollars as exact micro-dollars."""
    return (usd.cast("double") * F.lit(1_000_000.0)).cast(MICRO)


def dollars(amount: Column) -> Column:
    return amount.cast("double") / F.lit(1_000_000.0)


def priced_events(events: DataFrame, rates: DataFrame) -> DataFrame:
    """``events`` with ``cost_micro``: the direct cost, else tokens at the model's rates, else 0 for what isn't a model call.

    A model call without a direct cost whose model has no rate is an error, raised when the row is read. Rates are
    a price card; Spark broadcasts it if it is as small as cards are, and joins it by a shuffle otherwise.
    """
    card = rates.select(F.col("model").alias("_model"), F.col("input_per_million_usd").cast("decimal(18,6)").alias("_in"), F.col("output_per_million_usd").cast("decimal(18,6)").alias("_out"))
    joined = events.join(card, events["model"] == card["_model"], "left")
    usage = (F.col("input_tokens").cast("decimal(19,0)") * F.col("_in") + F.col("output_tokens").cast("decimal(19,0)") * F.col("_out")).cast(MICRO)
    cost = (
        F.when(F.col("direct_cost_usd").isNotNull(), micro(F.col("direct_cost_usd")))
        .when(F.col("event_type") != "model", F.lit(0).cast(MICRO))
        .when(F.col("_in").isNotNull(), usage)
        .otherwise(F.raise_error(F.concat(F.lit("no rate for model "), F.coalesce(F.col("model"), F.lit("null")))).cast(MICRO))
    )
    return joined.withColumn("cost_micro", cost).drop("_model", "_in", "_out")


def human_micro(minutes: Column, hourly_usd: float) -> Column:
    return micro(minutes.cast("double") * F.lit(float(hourly_usd)) / F.lit(60.0))


def realised_value_micro(acceptable: Column, value_usd: Column) -> Column:
    """The value of an acceptable outcome; an unacceptable one realises none."""
    return F.when(acceptable, micro(value_usd)).otherwise(F.lit(0).cast(MICRO))
