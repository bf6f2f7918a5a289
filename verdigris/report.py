"""Cases as Markdown, JSON and SVG."""

from __future__ import annotations

import json
import math
from decimal import ROUND_HALF_UP, Decimal

from .plans.assurance import Case
from .plans.frontier import FrontierCase, payload
from .schemas import Status


def dollars(value: float) -> str:
    return "unbounded" if not math.isfinite(value) else f"${Decimal(repr(value)).quantize(Decimal('0.01'), ROUND_HALF_UP):,}"


def case_markdown(case: Case) -> str:
    m, b = case.metrics, case.evidence.baseline
    lines = [f"# Decision: {case.decision}", "", f"- Source: {case.evidence.source_id}@{case.evidence.source_version}", f"- Evidence digest: `{case.evidence_digest}`", f"- Contract digest: `{case.contract_digest}`", f"- Checks: {', '.join(case.checks)}"]
    if case.missing_coverage:
        lines.append(f"- Missing coverage: {', '.join(case.missing_coverage)}")
    lines += ["", "| Measure | Result |", "| --- | ---: |", f"| Attempts | {m['attempts']} |", f"| Acceptable | {m['acceptable_count']} ({m['acceptable_rate']:.1%}) |"]
    for label, key in (("Total effective cost", "total_effective_cost_usd"), ("Cost per acceptable outcome", "cost_per_acceptable_outcome_usd"), ("p95 task cost", "p95_task_cost_usd"), ("Largest task cost", "max_task_cost_usd"), ("Net value per attempt", "expected_net_value_per_attempt_usd"), ("Net value beyond the baseline", "incremental_net_value_vs_baseline_usd")):
        lines.append(f"| {label} | {dollars(m[key])} |")
    lines += ["", f"Baseline {b.name}: {dollars(b.cost_per_acceptable_outcome_usd)} per acceptable outcome, {dollars(b.expected_net_value_per_attempt_usd)} net per attempt.", "", "## Checks", ""]
    lines += [f"- {r.status} {r.check_id}: {f'{r.task_id}: ' if r.task_id and r.task_id not in r.message else ''}{r.message}" for r in case.results] or ["- none ran"]
    return "\n".join(lines) + "\n"


def money(value: float) -> float | None:
    return round(value, 6) if math.isfinite(value) else None


def case_json(case: Case) -> str:
    b = case.evidence.baseline
    out = {
        "decision": str(case.decision),
        "source": f"{case.evidence.source_id}@{case.evidence.source_version}",
        "evidence_digest": case.evidence_digest,
        "decision_contract_digest": case.contract_digest,
        "checks": list(case.checks),
        "required_coverage": list(case.required_coverage),
        "missing_coverage": list(case.missing_coverage),
        "metrics": {k: v if k in ("attempts", "acceptable_count", "acceptable_rate") else money(v) for k, v in case.metrics.items()},
        "baseline": {"name": b.name, "cost_per_acceptable_outcome_usd": money(b.cost_per_acceptable_outcome_usd), "expected_net_value_per_attempt_usd": money(b.expected_net_value_per_attempt_usd)},
        "results": [r.__dict__ for r in case.results],
        "breaches": [r.message for r in case.results if r.status == Status.FAIL],
    }
    return json.dumps(out, indent=2, sort_keys=True) + "\n"


def frontier_markdown(case: FrontierCase) -> str:
    p = case.plan
    lines = [f"# Decision: {case.decision}" + (f" {case.selected_arm}" if case.selected_arm else ""), "", f"- Reference: {p.reference_arm}", f"- Plan digest: `{p.plan_digest}`", f"- Rule: breakage at most {p.max_breakage_rate:.1%}, cost reduction at least {p.min_cost_reduction_rate:.1%}, at {p.confidence_level:.0%} confidence over all candidates"]
    if case.problems:
        lines += ["", "## Problems", "", *[f"- {x}" for x in case.problems]]
    if case.arms:
        lines += ["", "| Arm | Decision | Acceptable | Mean cost | Dominated |", "| --- | --- | ---: | ---: | --- |", *[f"| {a.arm_id} | {a.decision} | {a.acceptable_tasks}/{a.tasks} | {dollars(a.mean_cost_usd)} | {'yes' if a.dominated else 'no'} |" for a in case.arms]]
    if case.comparisons:
        lines += ["", "| Candidate | Broken | Upper bound | Cost reduction | Lower bound | Eligible |", "| --- | ---: | ---: | ---: | ---: | --- |"]
        lines += [f"| {c.candidate_arm} | {c.harmful_regressions}/{c.paired_tasks} | {c.breakage_rate_upper:.2%} | {c.mean_cost_reduction_rate:.2%} | {c.cost_reduction_rate_lower:.2%} | {'yes' if c.eligible else '; '.join(c.reasons)} |" for c in case.comparisons]
    return "\n".join(lines) + "\n"


def frontier_json(case: FrontierCase) -> str:
    return json.dumps(payload(case), indent=2, sort_keys=True, allow_nan=False) + "\n"


def frontier_svg(case: FrontierCase, width: int = 640, height: int = 400) -> str:
    """Mean cost against share of acceptable tasks; the selected arm filled, dominated ones hollow."""
    from xml.sax.saxutils import escape

    arms = [a for a in case.arms if math.isfinite(a.mean_cost_usd)]
    most = max((a.mean_cost_usd for a in arms), default=1.0) or 1.0
    low = min((a.acceptable_rate for a in arms), default=0.0)
    span = max(1e-9, 1.0 - low)
    left, top, w, h = 60, 30, width - 100, height - 90
    body = [f'<line x1="{left}" y1="{top + h}" x2="{left + w}" y2="{top + h}" stroke="#444"/>', f'<line x1="{left}" y1="{top}" x2="{left}" y2="{top + h}" stroke="#444"/>', f'<text x="{left + w / 2:.0f}" y="{height - 20}" text-anchor="middle">mean cost per task (USD)</text>', f'<text x="18" y="{top + h / 2:.0f}" transform="rotate(-90 18 {top + h / 2:.0f})" text-anchor="middle">acceptable</text>']
    for a in arms:
        x, y = left + w * a.mean_cost_usd / (1.1 * most), top + h * (1 - (a.acceptable_rate - low) / span)
        fill = "#1b6" if a.arm_id == case.selected_arm else "#fff" if a.dominated else "#469"
        body.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="6" fill="{fill}" stroke="#234"/><text x="{x + 9:.1f}" y="{y - 8:.1f}">{escape(a.arm_id)} {dollars(a.mean_cost_usd)}, {a.acceptable_rate:.1%}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">' + "".join(body) + "</svg>\n"


def analyst_context(case, failing: int = 5) -> str:
    """What an analyst (a person or a model) is told of a case: decision, metrics, failed gates, missing coverage, and the failing tasks that cost most."""
    from pyspark.sql import functions as F

    lines = [f"Decision: {case.decision}", "", "Metrics", *[f"  {k}: {v:.6g}" if isinstance(v, float) else f"  {k}: {v}" for k, v in sorted(case.metrics.items())]]
    if broken := [r.message for r in case.results if r.status == "FAIL"]:
        lines += ["", "Failed gates", *[f"  {m}" for m in broken]]
    if case.missing_coverage:
        lines += ["", "Missing coverage", *[f"  {c}" for c in case.missing_coverage]]
    worst = case.tasks.where(~F.col("acceptable")).orderBy(F.desc("effective_cost_usd"), "task_id").limit(failing).collect()
    if worst:
        lines += ["", "Failing tasks, dearest first"]
        lines += [f"  {t['task_id']}: ${t['effective_cost_usd']:.4f} (trace ${t['trace_cost_usd']:.4f}, human ${t['human_cost_usd']:.4f}, remediation ${t['remediation_cost_usd']:.4f}, incident ${t['incident_loss_usd']:.4f})" for t in worst]
    return "\n".join(lines) + "\n"


def write_csv(table, path: str, *order: str) -> None:
    """A study's table, of a size for reading, as one CSV file with a header, in the given order."""
    table.orderBy(*order).toPandas().to_csv(path, index=False)
