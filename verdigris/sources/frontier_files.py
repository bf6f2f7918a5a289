"""Experiment plans and their arms from files; what is wrong with an arm is collected, not raised."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from ..functions.shapes import canonical_json, sha256, strict_json
from ..plans.frontier import Plan, plan_problems
from ..schemas import EvidenceError, Evidence
from . import files

FIELDS = ("arms", "reference_arm", "task_manifest", "task_manifest_digest", "confidence_level", "max_breakage_rate", "min_cost_reduction_rate", "bootstrap_samples", "seed", "min_paired_tasks", "schema_version")


def read_plan(path: str) -> Plan:
    """A plan that is complete and sound; the first thing wrong is raised."""
    try:
        raw = strict_json(Path(path).read_bytes(), "plan")
    except ValueError as error:
        raise EvidenceError(str(error)) from error
    if not isinstance(raw, dict) or (missing := [f for f in FIELDS if f not in raw]):
        raise EvidenceError("plan must be an object" if not isinstance(raw, dict) else f"plan has no {', '.join(missing)}")
    plan = Plan(**{f: raw[f] for f in FIELDS}, plan_digest=sha256(canonical_json(raw)))
    if problems := plan_problems(plan):
        raise EvidenceError(problems[0])
    return plan


def within(root: Path, name: str) -> Path | None:
    """The file of that name below a folder, or None if it is elsewhere or no file."""
    path = (root / name).resolve()
    return path if path.is_relative_to(root.resolve()) and path.is_file() else None


def strict_arm(raw: dict) -> list[str]:
    """What a frontier arm must state outright: costs, tokens of model calls, all economic fields of outcomes."""
    problems = [] if raw.get("schema_version") == 1 else ["schema_version must be 1"]
    for event in raw.get("events", []):
        if not isinstance(event, dict) or not event.get("task_id") or not event.get("event_id"):
            problems.append("an event has no ids")
        elif event.get("direct_cost_usd") is None and event.get("event_type") != "model":
            problems.append(f"event {event['event_id']!r} has unknown cost")
        elif event.get("event_type") == "model" and not {"input_tokens", "output_tokens"} <= set(event):
            problems.append(f"model event {event['event_id']!r} omits tokens")
    wanted = {"task_id", "acceptable", "business_value_usd", "human_minutes", "remediation_cost_usd", "incident_loss_usd"}
    for outcome in raw.get("outcomes", []):
        if not isinstance(outcome, dict) or (gap := sorted(wanted - set(outcome))):
            problems.append(f"an outcome lacks {gap if isinstance(outcome, dict) else 'everything'}")
    return problems


def read_experiment(spark: SparkSession, path: str) -> tuple[Plan, dict[str, Evidence], list[str]]:
    plan, root = read_plan(path), Path(path).parent
    problems: list[str] = []
    listed: list[dict] = []
    place = within(root, plan.task_manifest)
    if place is None:
        problems.append("task manifest is not a file below the plan")
    else:
        try:
            raw = strict_json(place.read_bytes(), "task manifest")
            listed = raw["tasks"]
            if len({t["task_id"] for t in listed}) != len(listed):
                problems.append("task manifest has repeated tasks")
            rows = [{k: t[k] for k in ("task_id", "input_digest", "rubric_version")} for t in listed]
            got = sha256(canonical_json({"tasks": sorted(rows, key=lambda t: t["task_id"])}))
            if got != plan.task_manifest_digest:
                problems.append(f"task manifest digest {got} is not the plan's")
        except (ValueError, KeyError, TypeError) as error:
            problems.append(f"task manifest is not sound: {error}")
    arms: dict[str, Evidence] = {}
    for arm, name in sorted(plan.arms.items()):
        place = within(root, name)
        if place is None:
            problems.append(f"{arm}: {name} is not a file below the plan")
            continue
        try:
            raw = strict_json(place.read_bytes(), f"arm {arm}")
            found = strict_arm(raw)
            problems += [f"{arm}: {p}" for p in found]
            if not found:
                arms[arm] = files.bundle_of(spark, {k: v for k, v in raw.items() if k not in ("arm", "schema_version")} | {"task_manifest": listed})
        except (ValueError, TypeError, AttributeError) as error:
            problems.append(f"{arm}: {error}")
    return plan, arms, problems
