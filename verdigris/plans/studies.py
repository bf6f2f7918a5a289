"""Worked studies over whole bundles: a synthetic frontier, deletions of single pieces of evidence, and completion against verdicts."""

from __future__ import annotations

import copy
import json
import math
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import canonical_json, sha256
from ..operators.gates import DEFAULT_CHECKS, Check, View
from ..schemas import EVENTS, MANIFEST, OUTCOMES, RATES, RESULTS, Baseline, Decision, Evidence, EvidenceError, Mode, Policy
from ..sources import files
from .assurance import Case, Engine, evaluate

#: Fixed values of the synthetic frontier: tasks, and per arm its trace cost and the tasks it fails.
TASKS = 180
REFERENCE_FAILURES = frozenset(range(0, 180, 20))
ARMS = {
    "premium-8-step": (1.40, REFERENCE_FAILURES),
    "balanced-4-step": (0.75, REFERENCE_FAILURES - {0, 20} | {1}),
    "cheap-2-step": (0.40, REFERENCE_FAILURES - {0, 20} | set(range(1, 13))),
    "premium-12-step": (2.00, REFERENCE_FAILURES - {0, 20, 40}),
}
FRONTIER_POLICY = Policy(60.0, 0.85, 3.0, 10.0, 3.0, 20)
FRONTIER_BASELINE = Baseline("human-first triage", 2.0, 0.80, 8.0)


def frontier_arms(spark: SparkSession) -> dict[str, Evidence]:
    """The four arms on 180 tasks each, from formulas."""
    index = spark.range(TASKS).select(F.col("id").cast("int").alias("i"), F.format_string("case-%03d", "id").alias("task_id"))
    manifest = index.select("task_id", F.sha2(F.format_string("synthetic-support-input-%03d", "i"), 256).alias("input_digest"), F.lit("support-rubric-v1").alias("rubric_version"))
    out = {}
    for arm, (base, failures) in ARMS.items():
        bad = F.col("i").isin(*sorted(failures))
        cost = F.round(F.lit(base) + F.lit(0.02) * (F.col("i") % 5), 2)
        events = index.select("task_id", F.format_string(f"{arm}-event-%03d", "i").alias("event_id"), F.lit("").alias("timestamp"), F.lit("model").alias("event_type"), F.lit("resolve_case").alias("name"), F.lit("").alias("model"), F.lit(0).cast("bigint").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens"), cost.alias("direct_cost_usd"), F.lit("ok").alias("status"), F.lit("{}").alias("arguments"))
        outcomes = index.select("task_id", (~bad).alias("acceptable"), F.lit(8.0).alias("business_value_usd"), F.when(bad, 4.0).otherwise(0.0).alias("human_minutes"), F.when(bad, 0.5).otherwise(0.0).alias("remediation_cost_usd"), F.when(bad & (F.col("i") == 1), 2.0).otherwise(0.0).alias("incident_loss_usd"))
        out[arm] = Evidence(events, outcomes, spark.createDataFrame([], RATES), FRONTIER_BASELINE, FRONTIER_POLICY, manifest, source_id="source.synthetic-frontier")
    return out


def write_experiment(spark: SparkSession, folder: str, **changes) -> str:
    """The synthetic frontier as plan, manifest and arm files; returns the plan's path."""
    root = Path(folder)
    (root / "arms").mkdir(parents=True, exist_ok=True)
    listed = None
    for arm, evidence in frontier_arms(spark).items():
        doc = files.document(evidence)
        listed = doc.pop("task_manifest")
        (root / "arms" / f"{arm}.json").write_text(json.dumps({"schema_version": 1, **doc}))
    (root / "task-manifest.json").write_text(json.dumps({"tasks": listed}))
    plan = {"schema_version": 1, "arms": {a: f"arms/{a}.json" for a in ARMS}, "reference_arm": "premium-8-step", "task_manifest": "task-manifest.json", "task_manifest_digest": sha256(canonical_json({"tasks": listed})), "confidence_level": 0.95, "max_breakage_rate": 0.05, "min_cost_reduction_rate": 0.25, "bootstrap_samples": 5000, "seed": 20260722, "min_paired_tasks": 150}
    (root / "plan.json").write_text(json.dumps(plan | changes))
    return str(root / "plan.json")


@dataclass(frozen=True)
class Deletion:
    """One piece of evidence taken from a fixture, and what that does to its decision."""

    case: str
    fixture: str
    path: tuple
    complete: str
    outcome: str  # DECISION, EVIDENCE_ERROR
    decision: str = ""


DELETIONS = (
    Deletion("drop_outcome_record", "clean", ("outcomes", 0), "SCALE", "EVIDENCE_ERROR"),
    Deletion("drop_baseline_object", "clean", ("baseline",), "SCALE", "EVIDENCE_ERROR"),
    Deletion("drop_incident_loss", "incident", ("outcomes", 0, "incident_loss_usd"), "ASSIST", "DECISION", "SCALE"),
    Deletion("drop_remediation_cost", "remediation", ("outcomes", 0, "remediation_cost_usd"), "ASSIST", "DECISION", "SCALE"),
    Deletion("drop_human_review_time", "human-review", ("outcomes", 0, "human_minutes"), "ASSIST", "DECISION", "SCALE"),
    Deletion("drop_trace_cost", "trace-cost", ("events", 0, "direct_cost_usd"), "ASSIST", "DECISION", "SCALE"),
    Deletion("drop_manifest_task", "clean", ("task_manifest", 0), "SCALE", "EVIDENCE_ERROR"),
    Deletion("drop_policy_threshold", "clean", ("policy", "max_cost_per_acceptable_outcome_usd"), "SCALE", "EVIDENCE_ERROR"),
    Deletion("drop_timed_out_event", "timed-out-event", ("events", 1), "ASSIST", "DECISION", "SCALE"),
)
#: Fixture: (path, value) changes of the clean one.
_CHANGES = {
    "clean": (),
    "incident": ((("outcomes", 0, "incident_loss_usd"), 3.0), (("policy", "max_p95_task_cost_usd"), 1.0)),
    "remediation": ((("outcomes", 0, "remediation_cost_usd"), 3.0), (("policy", "max_cost_per_acceptable_outcome_usd"), 1.0)),
    "human-review": ((("outcomes", 0, "human_minutes"), 3.0), (("policy", "max_cost_per_acceptable_outcome_usd"), 1.0)),
    "trace-cost": ((("events", 0, "direct_cost_usd"), 2.0), (("policy", "max_cost_per_acceptable_outcome_usd"), 1.0)),
    "timed-out-event": ((("policy", "max_calls_per_task"), 1),),
}


def two_tasks(fixture: str = "clean") -> dict:
    """A bundle of two good tasks, changed as a fixture of the study wants it."""
    event = lambda t, i, at, **more: {"task_id": f"task-{t}", "event_id": f"event-{i}", "timestamp": at, "event_type": "tool", "name": "complete", "direct_cost_usd": 0.1, "status": "ok"} | more
    outcome = lambda t: {"task_id": f"task-{t}", "acceptable": True, "business_value_usd": 20.0, "human_minutes": 0.0, "remediation_cost_usd": 0.0, "incident_loss_usd": 0.0}
    raw = {
        "events": [event("a", "a", "2026-07-01T00:00:00Z"), event("b", "b", "2026-07-01T00:00:01Z")],
        "outcomes": [outcome("a"), outcome("b")],
        "rates": {},
        "baseline": asdict(Baseline("human baseline", 10.0, 0.5, 20.0)),
        "policy": asdict(Policy(60.0, 1.0, 5.0, 5.0, 5.0, 3)),
        "task_manifest": [{"task_id": f"task-{t}", "input_digest": t * 64, "rubric_version": "rubric-v1"} for t in "ab"],
    }
    if fixture == "timed-out-event":
        raw["events"].insert(1, event("a", "timeout", "2026-07-01T00:00:00.5Z", event_type="model", name="retry", status="timeout"))
    for path, value in _CHANGES[fixture]:
        _at(raw, path[:-1])[path[-1]] = value
    return raw


def _at(value, path: tuple):
    for step in path:
        value = value[step]
    return value


def ablation(spark: SparkSession) -> list[dict]:
    """Per deletion: the decision on complete evidence, and the decision or refusal without the piece."""
    out = []
    for d in DELETIONS:
        raw = two_tasks(d.fixture)
        complete = Engine().evaluate(files.bundle_of(spark, raw), with_digest=False)
        cut = copy.deepcopy(raw)
        del _at(cut, d.path[:-1])[d.path[-1]]
        row = {"case": d.case, "target": "/" + "/".join(map(str, d.path)), "complete_decision": str(complete.decision), "complete_cost_usd": complete.metrics["total_effective_cost_usd"]}
        try:
            case = Engine().evaluate(files.bundle_of(spark, cut), with_digest=False)
            row |= {"outcome": "DECISION", "operational": str(case.decision), "ablated_cost_usd": case.metrics["total_effective_cost_usd"], "reason": ""}
        except EvidenceError as error:
            row |= {"outcome": "EVIDENCE_ERROR", "operational": str(Decision.INCOMPLETE), "ablated_cost_usd": None, "reason": error.problems[0]}
        out.append(row)
    return out


def completion_against_verdict(case: Case) -> dict:
    """What completion alone says beside the verdict, and how many more acceptable outcomes the policy's rate needs."""
    m, policy = case.metrics, case.evidence.policy
    trace = case.tasks.agg(F.sum("trace_cost_usd")).first()[0]
    needed = max(0, math.ceil(policy.min_acceptable_rate * m["attempts"] - m["acceptable_count"] - 1e-9))
    return {"completion": m["acceptable_rate"], "decision": str(case.decision), "trace_cost_usd": trace, "total_cost_usd": m["total_effective_cost_usd"], "net_value_per_attempt_usd": m["expected_net_value_per_attempt_usd"], "incremental_per_attempt_usd": m["incremental_net_value_vs_baseline_usd"], "more_acceptable_needed": needed}


def failed_events(view: View) -> DataFrame:
    """A check of one's own: a STOP gate on any event whose status isn't ok."""
    bad = view.events.where("status <> 'ok'").agg(F.count("*").alias("n"))
    failed = F.col("n") > 0
    return bad.select(F.lit("gate.event-status").alias("check_id"), F.when(failed, "FAIL").otherwise("PASS").alias("status"), F.concat(F.col("n").cast("string"), F.lit(" events are not ok")).alias("message"), F.when(failed, "STOP").alias("on_failure"), F.lit(None).cast("string").alias("task_id"))


def with_own_gate(evidence: Evidence) -> Case:
    """The default checks and one more, passed explicitly."""
    return evaluate(evidence, (*DEFAULT_CHECKS, Check("gate.event-status", "1", Mode.GATE, failed_events, frozenset(), Decision.STOP)))


__all__ = ["EVENTS", "MANIFEST", "OUTCOMES", "RESULTS", "ablation", "completion_against_verdict", "frontier_arms", "two_tasks", "with_own_gate", "write_experiment"]
