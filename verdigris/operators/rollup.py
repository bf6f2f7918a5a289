"""Tasks and metrics: events are summed per task, joined to their outcomes, and reduced to one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..schemas import Baseline


def task_rollup(events: DataFrame, outcomes: DataFrame, rates: DataFrame, hourly_usd: float, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Per task: call_count, the cost components and the effective cost, acceptable, realised value; amounts in micro-dollars.

    Events are aggregated before the join, so what is joined is one row per task on either side. Tasks without an outcome or outcomes
    without an event are dropped here; ``unmatched`` finds them.
    """
    spent = money.priced_events(events, rates).groupBy(*keys).agg(F.count("*").alias("call_count"), F.sum("cost_micro").cast(money.MICRO).alias("trace_micro"))
    labelled = outcomes.select(
        *keys,
        "acceptable",
        money.human_micro(F.col("human_minutes"), hourly_usd).alias("human_micro"),
        money.micro(F.col("remediation_cost_usd")).alias("remediation_micro"),
        money.micro(F.col("incident_loss_usd")).alias("incident_micro"),
        money.realised_value_micro(F.col("acceptable"), F.col("business_value_usd")).alias("value_micro"),
    )
    total = F.col("trace_micro") + F.col("human_micro") + F.col("remediation_micro") + F.col("incident_micro")
    return spent.join(labelled, list(keys)).withColumn("effective_micro", total.cast(money.MICRO))


def task_economics(rollup: DataFrame) -> DataFrame:
    """The rollup in dollars."""
    names = {"trace": "trace_cost_usd", "human": "human_cost_usd", "remediation": "remediation_cost_usd", "incident": "incident_loss_usd", "effective": "effective_cost_usd", "value": "business_value_usd"}
    kept = [c for c in rollup.columns if not c.endswith("_micro")]
    return rollup.select(*kept, *[money.dollars(F.col(f"{k}_micro")).alias(v) for k, v in names.items()])


def unmatched(events: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task ids of events without an outcome, task ids of outcomes without an event)"""
    traced, labelled = events.select("task_id").distinct(), outcomes.select("task_id").distinct()
    return traced.join(labelled, "task_id", "left_anti"), labelled.join(traced, "task_id", "left_anti")


def metrics(rollup: DataFrame, baseline: Baseline, keys: tuple[str, ...] = ()) -> DataFrame:
    """All scalar metrics in one aggregation. The cost per acceptable outcome is infinite if there is none; percentiles are by nearest rank."""
    n, a = F.count("*"), F.count_if("acceptable")
    grouped = rollup.groupBy(*keys).agg(
        n.alias("attempts"),
        a.alias("acceptable_count"),
        F.sum("effective_micro").alias("_cost"),
        F.sum("value_micro").alias("_value"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY effective_micro)").alias("_p95"),
        F.max("effective_micro").alias("_max"),
    )
    cost, value, attempts, good = money.dollars(F.col("_cost")), money.dollars(F.col("_value")), F.col("attempts"), F.col("acceptable_count")
    net = (value - cost) / attempts
    return grouped.where("attempts > 0").select(
        *keys,
        "attempts",
        "acceptable_count",
        (good / attempts).alias("acceptable_rate"),
        cost.alias("total_effective_cost_usd"),
        F.when(good == 0, F.lit(float("inf"))).otherwise(cost / F.greatest(good, F.lit(1))).alias("cost_per_acceptable_outcome_usd"),
        money.dollars(F.col("_p95")).alias("p95_task_cost_usd"),
        money.dollars(F.col("_max")).alias("max_task_cost_usd"),
        net.alias("expected_net_value_per_attempt_usd"),
        (net - F.lit(baseline.expected_net_value_per_attempt_usd)).alias("incremental_net_value_vs_baseline_usd"),
    )


def last_event_cost(priced: DataFrame, order: list[str]) -> DataFrame:
    """Per task the cost of its last event only, beside that of all of them."""
    last = F.max_by("cost_micro", F.struct(*order))
    return priced.groupBy("task_id").agg(money.dollars(last).alias("last_cost_usd"), money.dollars(F.sum("cost_micro")).alias("trace_cost_usd"))


def failing_tasks(rollup: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` unacceptable tasks that cost most."""
    return rollup.where(~F.col("acceptable")).orderBy(F.desc("effective_micro"), "task_id").limit(k)
