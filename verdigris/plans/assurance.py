"""One arm's verdict: validate, roll up, measure, check coverage, run the checks, and reduce to a decision."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import gates, rollup, validate
from ..functions import money
from ..operators.gates import DEFAULT_CHECKS, Check, View
from ..schemas import RESULTS, Coverage, Decision, Evidence, EvidenceError, Mode, Status
from . import digest

REQUIRED = frozenset(Coverage)
#: Rows of one check that a case carries; ``finding_counts`` has how many there are, and ``findings`` all of them, as a frame.
FINDINGS = 1000


@dataclass(frozen=True)
class CheckRow:
    check_id: str
    status: str
    message: str
    on_failure: str | None = None
    task_id: str | None = None


@dataclass(frozen=True)
class Case:
    """The verdict and what it rests on; ``tasks`` stays a lazy frame."""

    decision: Decision
    metrics: dict
    results: tuple[CheckRow, ...]
    checks: tuple[str, ...]
    required_coverage: tuple[str, ...]
    missing_coverage: tuple[str, ...]
    evidence: Evidence
    evidence_digest: str
    contract_digest: str
    tasks: DataFrame = field(compare=False, repr=False)
    finding_counts: dict[str, int] = field(default_factory=dict, compare=False)
    findings: DataFrame | None = field(default=None, compare=False, repr=False)

    def __getattr__(self, name: str):
        metrics = self.__dict__.get("metrics", {})
        if name in metrics:
            return metrics[name]
        raise AttributeError(name)


@dataclass(frozen=True)
class Engine:
    """Checks in order, and the coverage they must have between them; what is required doesn't shrink with the checks."""

    checks: tuple[Check, ...] = DEFAULT_CHECKS
    required: frozenset[Coverage] = REQUIRED

    def __post_init__(self) -> None:
        ids = [c.id for c in self.checks]
        if len(set(ids)) != len(ids):
            raise EvidenceError(f"repeated check ids: {sorted({i for i in ids if ids.count(i) > 1})}")
        for c in self.checks:
            if c.mode is Mode.DIAGNOSTIC and (c.route is not None or c.covers):
                raise EvidenceError(f"{c.id}: a diagnostic neither routes nor covers")
            if c.mode is Mode.GATE and c.route not in (Decision.ASSIST, Decision.STOP):
                raise EvidenceError(f"{c.id}: a gate routes to ASSIST or STOP")

    def evaluate(self, evidence: Evidence, *, label: str = "evidence", strict: bool = False, with_digest: bool = True) -> Case:
        """The case; evidence that can't be judged raises EvidenceError with all that is wrong with it."""
        problems = validate.problems_of(evidence, label=label, strict=strict)
        if problems:
            raise EvidenceError(problems)
        tasks = rollup.task_rollup(evidence.events, evidence.outcomes, evidence.rates, evidence.policy.human_hourly_cost_usd).persist()
        try:
            found = rollup.metrics(tasks, evidence.baseline).first()
            if found is None:
                raise EvidenceError(f"{label}: no tasks")
            measured = found.asDict()
            for name, value in measured.items():
                if not math.isfinite(value) and not (name == "cost_per_acceptable_outcome_usd" and measured["acceptable_count"] == 0):
                    raise EvidenceError(f"{label}: computed {name} is not finite")
            covered = frozenset(x for c in self.checks if c.mode is Mode.GATE for x in c.covers)
            missing = sorted(map(str, self.required - covered))
            results: list[CheckRow] = []
            routes: set[str] = set()
            counts: dict[str, int] = {}
            findings = None
            if not missing:
                view = View(measured, tasks, money.priced_events(evidence.events, evidence.rates), evidence.edges, evidence.baseline, evidence.policy)
                for check in self.checks:
                    rows, taken, counts[check.id] = self._run(check, view)
                    results += rows
                    routes |= taken
                lazy = View(measured, rollup.task_rollup(evidence.events, evidence.outcomes, evidence.rates, evidence.policy.human_hourly_cost_usd), view.events, evidence.edges, evidence.baseline, evidence.policy)
                findings = all_results(self.checks, lazy) if max(counts.values(), default=0) > FINDINGS else view.spark.createDataFrame([(r.check_id, r.status, r.message, r.on_failure, r.task_id) for r in results], RESULTS)
            return Case(
                decision=reduce_decision(routes, bool(missing)),
                metrics=measured,
                results=tuple(results),
                checks=tuple(c.manifest_id for c in self.checks),
                required_coverage=tuple(sorted(map(str, self.required))),
                missing_coverage=tuple(missing),
                evidence=evidence,
                evidence_digest=digest.evidence_digest(evidence) if with_digest else "",
                contract_digest=digest.contract_digest(self.checks, self.required),
                tasks=rollup.task_economics(tasks),
                finding_counts=counts,
                findings=findings,
            )
        finally:
            tasks.unpersist()

    @staticmethod
    def _run(check: Check, view: View) -> tuple[list[CheckRow], set[str], int]:
        """(the first rows of a check, the routes of those that failed, how many rows there are)"""
        try:
            found = check.run(view)
            head = [CheckRow(**r.asDict()) for r in found.limit(FINDINGS + 1).collect()]
            kinds, count = head, len(head)
            if count > FINDINGS:
                grouped = found.groupBy("check_id", "status", "on_failure").count().collect()  # a few rows: one of each kind
                kinds, count = [CheckRow(r["check_id"], r["status"], "", r["on_failure"]) for r in grouped], sum(r["count"] for r in grouped)
        except Exception as error:
            raise EvidenceError(f"{check.id}: the check failed: {type(error).__name__}: {error}") from error
        for r in kinds:
            if r.check_id != check.id:
                raise EvidenceError(f"{check.id}: a result names {r.check_id}")
            if check.mode is Mode.DIAGNOSTIC and (r.status == Status.FAIL or r.on_failure is not None):
                raise EvidenceError(f"{check.id}: a diagnostic cannot fail or route")
            if check.mode is Mode.GATE and r.status == Status.FAIL and r.on_failure != check.route:
                raise EvidenceError(f"{check.id}: routes to {r.on_failure}, declared {check.route}")
            if r.status != Status.FAIL and r.on_failure is not None:
                raise EvidenceError(f"{check.id}: a result that holds has a consequence")
        return head[:FINDINGS], routes_of(kinds), count


def all_results(checks: tuple[Check, ...], view: View) -> DataFrame:
    """The rows of all checks, lazily."""
    out = None
    for check in checks:
        out = check.run(view) if out is None else out.unionByName(check.run(view))
    return out if out is not None else view.spark.createDataFrame([], RESULTS)


def routes_of(results: list[CheckRow]) -> set[str]:
    return {r.on_failure for r in results if r.status == Status.FAIL}


def reduce_decision(routes: set[str], missing: bool = False) -> Decision:
    """STOP if a failed gate routes there, ASSIST if any failed, SCALE if none; INCOMPLETE without the coverage."""
    if missing:
        return Decision.INCOMPLETE
    return Decision.STOP if Decision.STOP in routes else Decision.ASSIST if routes else Decision.SCALE


def evaluate(evidence: Evidence, checks: tuple[Check, ...] = DEFAULT_CHECKS, **options) -> Case:
    return Engine(checks).evaluate(evidence, **options)


def register_views(evidence: Evidence, prefix: str = "") -> None:
    """Makes the frames of the evidence tables of ``spark.sql``."""
    for name in ("events", "outcomes", "rates", "manifest", "edges"):
        table = getattr(evidence, name)
        if table is not None:
            table.createOrReplaceTempView(f"{prefix}{name}")


__all__ = ["Case", "CheckRow", "Engine", "evaluate", "gates", "reduce_decision", "register_views"]
