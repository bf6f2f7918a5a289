"""Running costs of tasks over a stream of events, beyond what batch evaluation offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money


def running_costs(events: DataFrame, rates: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Per task the calls and cost so far, from a stream of canonical events; state is kept for ``late`` after a task's window.

    Use with output mode update. A task is ready for a verdict only when its outcome has come too; ``verdict_ready`` joins them.
    """
    timed = events.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late)
    priced = money.priced_events(timed, rates)
    return priced.groupBy(F.window("at", "1 day").alias("day"), "task_id").agg(F.count("*").alias("call_count"), F.sum("cost_micro").alias("trace_micro"))


def breaches(running: DataFrame, max_calls: int, max_trace_usd: float) -> DataFrame:
    """Tasks of a running table that are above a cap already."""
    return running.where((F.col("call_count") > max_calls) | (money.dollars(F.col("trace_micro")) > max_trace_usd))


def verdict_ready(costs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Costs of the tasks that have an outcome."""
    return costs.join(outcomes, "task_id")
