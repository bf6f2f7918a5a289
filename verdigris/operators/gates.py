"""Gates and diagnostics: each turns a view of one evaluation into rows of check results."""

from __future__ import annotations

import hashlib
import inspect
import textwrap
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..schemas import RESULTS, Baseline, Coverage, Decision, EvidenceError, Mode, Policy, Status
from . import sequences


@dataclass(frozen=True)
class View:
    """What a check sees: the one row of metrics, and lazy frames of tasks (amounts in micro-dollars), priced events and edges."""

    metrics: dict
    rollup: DataFrame
    events: DataFrame
    edges: DataFrame | None
    baseline: Baseline
    policy: Policy

    @property
    def spark(self):
        return self.rollup.sparkSession

    def result(self, check_id: str, failed: bool, message: str, route: Decision) -> DataFrame:
        """One row: a gate that holds, or fails and routes."""
        return self.spark.createDataFrame([(check_id, str(Status.FAIL if failed else Status.PASS), message, str(route) if failed else None, None)], RESULTS)


@dataclass(frozen=True)
class Check:
    """A named, versioned check. ``run`` takes a View and returns rows of RESULTS; only gates cover dimensions and route."""

    id: str
    version: str
    mode: Mode
    run: Callable[[View], DataFrame]
    covers: frozenset[Coverage] = frozenset()
    route: Decision | None = None

    @property
    def manifest_id(self) -> str:
        return f"{self.id}@{self.version}"


@lru_cache(maxsize=256)
def fingerprint(run: Callable) -> str:
    """SHA-256 of the source of a check's function; helpers that it calls aren't part of it."""
    try:
        source = textwrap.dedent(inspect.getsource(run))
    except (OSError, TypeError) as error:
        raise EvidenceError(f"the source of {getattr(run, '__name__', run)!r} is not available") from error
    return hashlib.sha256("\n".join(line.rstrip() for line in source.splitlines()).encode()).hexdigest()


def acceptable_rate(view: View) -> DataFrame:
    got, least = view.metrics["acceptable_rate"], view.policy.min_acceptable_rate
    failed = got < least
    return view.result("gate.acceptable-rate", failed, f"acceptable_rate {got:.1%} {'<' if failed else '>='} {least:.1%}", Decision.ASSIST)


def unit_economics(view: View) -> DataFrame:
    got, most = view.metrics["cost_per_acceptable_outcome_usd"], view.policy.max_cost_per_acceptable_outcome_usd
    failed = got > most
    return view.result("gate.unit-economics", failed, f"cost_per_acceptable_outcome ${got:.2f} {'>' if failed else '<='} ${most:.2f}", Decision.ASSIST)


def tail_cost(view: View) -> DataFrame:
    got, most = view.metrics["p95_task_cost_usd"], view.policy.max_p95_task_cost_usd
    failed = got > most
    return view.result("gate.tail-cost", failed, f"p95_task_cost ${got:.2f} {'>' if failed else '<='} ${most:.2f}", Decision.ASSIST)


def net_value(view: View) -> DataFrame:
    got, least = view.metrics["expected_net_value_per_attempt_usd"], view.policy.min_expected_net_value_per_attempt_usd
    failed = got < least
    return view.result("gate.net-value", failed, f"expected_net_value_per_attempt ${got:.2f} {'<' if failed else '>='} ${least:.2f}", Decision.STOP)


def counterfactual(view: View) -> DataFrame:
    got, least = view.metrics["incremental_net_value_vs_baseline_usd"], view.policy.min_incremental_net_value_vs_baseline_usd
    failed = got < least
    return view.result("gate.counterfactual", failed, f"incremental_net_value_vs_baseline ${got:.2f} {'<' if failed else '>='} ${least:.2f}", Decision.STOP)


def cap_breaches(rollup: DataFrame, max_calls: int, max_trace_usd: float) -> DataFrame:
    """(task_id, breach, observed, cap), breach 1 for calls and 2 for trace cost, of the tasks above a cap."""

    def breach(number: int, observed: Column, cap: float) -> Column:
        value = observed.cast("double")
        return F.when(value > cap, F.struct(F.lit(number).alias("breach"), value.alias("observed"), F.lit(float(cap)).alias("cap")))

    both = F.filter(F.array(breach(1, F.col("call_count"), max_calls), breach(2, F.col("trace_micro").cast("double") / 1_000_000.0, max_trace_usd)), lambda x: x.isNotNull())
    return rollup.select("task_id", F.explode(both).alias("b")).select("task_id", "b.*")


def runtime_caps(view: View) -> DataFrame:
    found = cap_breaches(view.rollup, view.policy.max_calls_per_task, view.policy.max_trace_cost_per_task_usd)
    calls = F.format_string("%s: %d calls > cap of %d", F.col("task_id").cast("string"), F.col("observed").cast("long"), F.col("cap").cast("long"))
    spent = F.format_string("%s: $%.4f trace cost > cap of $%.4f", F.col("task_id").cast("string"), "observed", "cap")
    rows = found.orderBy("task_id", "breach").select(
        F.lit("gate.runtime-caps").alias("check_id"), F.lit("FAIL").alias("status"), F.when(F.col("breach") == 1, calls).otherwise(spent).alias("message"), F.lit("ASSIST").alias("on_failure"), F.col("task_id").cast("string").alias("task_id")
    )
    return rows if not found.isEmpty() else view.result("gate.runtime-caps", False, "all tasks remain within call and trace-cost caps", Decision.ASSIST)


def repeated_tool_shape(view: View) -> DataFrame:
    threshold = view.policy.repetition_warning_threshold
    calls = view.events.where("event_type = 'tool'").withColumn("signature", F.struct("name", shapes.argument_shape(F.col("arguments")).alias("shape")))
    runs = sequences.repeated_runs(calls, "signature", threshold)
    text = F.concat(F.lit("'"), F.col("signature.name"), F.lit(f"' repeated {threshold} times with the same argument shape ("), "first_event", F.lit(".."), "last_event", F.lit(")"))
    return runs.orderBy("task_id", "first_event").select(F.lit("diagnostic.repeated-tool-shape").alias("check_id"), F.lit("WARN").alias("status"), text.alias("message"), F.lit(None).cast("string").alias("on_failure"), F.col("task_id").cast("string").alias("task_id"))


def directed_cycle(view: View) -> DataFrame:
    if view.edges is None:
        return view.spark.createDataFrame([], RESULTS)
    placed = view.edges.join(view.events.select(F.col("event_id").alias("source_event_id"), "task_id"), "source_event_id")
    loops = sequences.cycle_findings(placed)
    text = F.concat(F.lit("directed cycle: "), F.array_join(F.concat("cycle", F.slice("cycle", 1, 1)), " -> "))
    return loops.orderBy("task_id", "cycle").select(F.lit("diagnostic.directed-cycle").alias("check_id"), F.lit("WARN").alias("status"), text.alias("message"), F.lit(None).cast("string").alias("on_failure"), "task_id")


def _gate(name: str, run: Callable, covers: Coverage, route: Decision) -> Check:
    return Check(f"gate.{name}", "1", Mode.GATE, run, frozenset([covers]), route)


DEFAULT_CHECKS: tuple[Check, ...] = (
    _gate("acceptable-rate", acceptable_rate, Coverage.OUTCOME_QUALITY, Decision.ASSIST),
    _gate("unit-economics", unit_economics, Coverage.UNIT_ECONOMICS, Decision.ASSIST),
    _gate("tail-cost", tail_cost, Coverage.TAIL_RISK, Decision.ASSIST),
    _gate("net-value", net_value, Coverage.BUSINESS_VALUE, Decision.STOP),
    _gate("counterfactual", counterfactual, Coverage.COUNTERFACTUAL, Decision.STOP),
    _gate("runtime-caps", runtime_caps, Coverage.RUNTIME_CAPS, Decision.ASSIST),
    Check("diagnostic.repeated-tool-shape", "1", Mode.DIAGNOSTIC, repeated_tool_shape),
    Check("diagnostic.directed-cycle", "1", Mode.DIAGNOSTIC, directed_cycle),
)
