"""Validation of evidence: each rule is a filter whose rows are problems; all rules run before anything is refused."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import Baseline, Evidence, Policy

#: Problem rows that are shown of one rule; the number of all is told beside them.
SHOWN = 20


def numeric_problem(name: str, value: Column, *, least: float | None = 0.0, most: float | None = None) -> Column:
    """A message if a number is null, not finite or out of bounds, else null."""
    number = value.cast("double")
    tests = F.when(value.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(f"{name} must be a finite number"))
    if least is not None:
        tests = tests.when(number < least, F.lit(f"{name} must be at least {least:g}"))
    if most is not None:
        tests = tests.when(number > most, F.lit(f"{name} must be at most {most:g}"))
    return tests


def number_problem(name: str, value, *, least: float | None = 0.0, most: float | None = None, whole: bool = False) -> str | None:
    """The same for a configured value; booleans aren't numbers."""
    if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)):
        return f"{name} must be {'an integer' if whole else 'a number'}"
    if not math.isfinite(value):
        return f"{name} must be finite"
    if least is not None and value < least:
        return f"{name} must be at least {least:g}"
    if most is not None and value > most:
        return f"{name} must be at most {most:g}"
    return None


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, copies) of keys that come more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def _rows(table: DataFrame, rule: int, key: Column, *messages: Column) -> DataFrame:
    found = F.filter(F.array(*messages), lambda x: x.isNotNull())
    return table.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.explode(found).alias("message"))


def evidence_problems(evidence: Evidence, *, strict: bool = False) -> DataFrame:
    """(rule, key, message) for events, edges, rates, outcomes and the manifest; ``strict`` wants explicit costs and a manifest."""
    events, outcomes, rates = evidence.events, evidence.outcomes, evidence.rates
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    card = rates.select(F.col("model").alias("_m")).distinct()
    known = events.join(card, events["model"] == card["_m"], "left")
    model, free = F.col("event_type") == "model", F.col("direct_cost_usd").isNull()
    strictly = F.lit(strict)
    out = [
        _rows(
            known,
            1,
            F.col("event_id"),
            F.when(blank("task_id"), F.lit("event has an invalid task_id")),
            F.when(blank("event_id"), F.lit("event has an invalid event_id")),
            numeric_problem("input_tokens", F.col("input_tokens")),
            numeric_problem("output_tokens", F.col("output_tokens")),
            F.when(free & model & F.col("_m").isNull(), F.lit("unknown model cost: neither a direct cost nor a rate")),
            F.when(strictly & free & model & F.col("_m").isNotNull() & (F.col("input_tokens") + F.col("output_tokens") <= 0), F.lit("zero usage at a rate: needs tokens or a direct cost")),
            F.when(strictly & free & ~F.coalesce(model, F.lit(False)), F.lit("unknown cost: needs a direct cost, 0 if it is included elsewhere")),
            F.when(~free, numeric_problem("direct_cost_usd", F.col("direct_cost_usd"))),
        ),
        duplicates(events.where(~blank("event_id")), "event_id").select(F.lit(2).alias("rule"), F.col("event_id").cast("string").alias("key"), F.lit("duplicate event id").alias("message")),
        _rows(rates, 6, F.col("model"), F.when(blank("model"), F.lit("a rate has no model")), numeric_problem("input rate", F.col("input_per_million_usd")), numeric_problem("output rate", F.col("output_per_million_usd"))),
        _rows(
            outcomes,
            7,
            F.col("task_id"),
            F.when(blank("task_id"), F.lit("outcome has an invalid task_id")),
            F.when(F.col("acceptable").isNull(), F.lit("acceptable must be true or false")),
            *[numeric_problem(c, F.col(c)) for c in ("business_value_usd", "human_minutes", "remediation_cost_usd", "incident_loss_usd")],
        ),
        duplicates(outcomes, "task_id").select(F.lit(8).alias("rule"), F.col("task_id").cast("string").alias("key"), F.lit("duplicate outcome").alias("message")),
    ]
    traced, labelled = events.select("task_id").distinct(), outcomes.select("task_id").distinct()

    def apart(a: DataFrame, b: DataFrame, rule: int, message: str) -> DataFrame:
        return a.join(b, "task_id", "left_anti").select(F.lit(rule).alias("rule"), F.col("task_id").cast("string").alias("key"), F.lit(message).alias("message"))

    out += [apart(traced, labelled, 9, "task has events but no outcome"), apart(labelled, traced, 9, "task has an outcome but no events")]
    if evidence.edges is not None:
        out += edge_problems(evidence.edges, events)
    if evidence.manifest is not None:
        listed = evidence.manifest
        out += [
            apart(listed.select("task_id").distinct(), labelled, 10, "manifest task has no outcome"),
            apart(labelled, listed.select("task_id").distinct(), 10, "outcome's task is not in the manifest"),
            _rows(listed, 11, F.col("task_id"), F.when(~F.coalesce(F.col("input_digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("input_digest must be a lower-case SHA-256")), F.when(blank("rubric_version"), F.lit("rubric_version must not be empty"))),
            duplicates(listed, "task_id").select(F.lit(12).alias("rule"), F.col("task_id").cast("string").alias("key"), F.lit("duplicate manifest row").alias("message")),
        ]
    elif strict:
        out.append(events.sparkSession.createDataFrame([(10, None, "a task manifest is required")], "rule int, key string, message string"))
    first, *rest = out
    for table in rest:
        first = first.unionByName(table)
    return first


def edge_problems(edges: DataFrame, events: DataFrame) -> list[DataFrame]:
    """Repeated edges, edges with an empty or unknown end, and edges between tasks."""
    name = F.concat_ws("->", "source_event_id", "target_event_id")
    place = events.select("event_id", F.col("task_id")).dropDuplicates(["event_id"])
    ends = edges.join(place.select(F.col("event_id").alias("source_event_id"), F.col("task_id").alias("_from")), "source_event_id", "left").join(
        place.select(F.col("event_id").alias("target_event_id"), F.col("task_id").alias("_to")), "target_event_id", "left"
    )
    return [
        duplicates(edges, "source_event_id", "target_event_id").select(F.lit(3).alias("rule"), name.alias("key"), F.lit("duplicate edge").alias("message")),
        _rows(
            ends,
            4,
            name,
            F.when(F.coalesce(F.col("source_event_id"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("target_event_id"), F.lit("")).eqNullSafe(""), F.lit("an edge needs two event ids"))
            .when(F.col("_from").isNull() | F.col("_to").isNull(), F.lit("edge refers to an unknown event"))
            .when(F.col("_from") != F.col("_to"), F.lit("edge crosses tasks")),
        ),
    ]


def config_problems(baseline: Baseline, policy: Policy) -> list[str]:
    found = [None if isinstance(baseline.name, str) and baseline.name else "baseline name must not be empty"]
    found += [number_problem(f"baseline {f}", getattr(baseline, f)) for f in ("cost_per_attempt_usd", "value_per_acceptable_outcome_usd")]
    rate = number_problem("baseline acceptable_rate", baseline.acceptable_rate, most=1.0)
    found.append(rate or ("baseline acceptable_rate must be above 0" if baseline.acceptable_rate == 0 else None))
    found += [number_problem(f"policy {f}", getattr(policy, f)) for f in ("human_hourly_cost_usd", "max_cost_per_acceptable_outcome_usd", "max_p95_task_cost_usd", "max_trace_cost_per_task_usd")]
    found += [number_problem(f"policy {f}", getattr(policy, f), least=None) for f in ("min_expected_net_value_per_attempt_usd", "min_incremental_net_value_vs_baseline_usd")]
    found.append(number_problem("policy min_acceptable_rate", policy.min_acceptable_rate, most=1.0))
    found += [number_problem(f"policy {f}", getattr(policy, f), least=1, whole=True) for f in ("max_calls_per_task", "repetition_warning_threshold")]
    return [x for x in found if x]


def problems_of(evidence: Evidence, *, label: str = "evidence", strict: bool = False) -> list[str]:
    """All problems as text, in the order of the rules; of one rule at most SHOWN, with the number of all."""
    found = _counted(evidence_problems(evidence, strict=strict))
    out = []
    for rule, n, rows in found:
        out += [f"{label}: {key!r} {message}" for key, message in rows]
        if n > len(rows):
            out.append(f"{label}: and {n - len(rows)} more of rule {rule}")
    return out + [f"{label}: {x}" for x in config_problems(evidence.baseline, evidence.policy)]


def _counted(problems: DataFrame) -> list[tuple[int, int, list[tuple[str, str]]]]:
    """(rule, problems in all, the first SHOWN of them): one shuffle, and at most SHOWN rows a rule come to the driver."""
    rank = F.row_number().over(Window.partitionBy("rule").orderBy("key", "message"))
    shown = problems.withColumn("_at", rank).where(F.col("_at") <= SHOWN)
    rows = shown.orderBy("rule", "_at").collect()
    if not rows:
        return []
    totals = {r["rule"]: r["n"] for r in problems.groupBy("rule").agg(F.count("*").alias("n")).collect()}
    return [(rule, totals[rule], [(r["key"], r["message"]) for r in rows if r["rule"] == rule]) for rule in sorted(totals)]
