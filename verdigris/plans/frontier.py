"""Several arms on the same tasks: strict completeness first, then paired bounds, and the cheapest arm that clears the rule."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass
from enum import StrEnum

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.shapes import canonical_float
from ..operators import validate
from ..schemas import Decision, Evidence, EvidenceError
from . import digest
from .assurance import Case, Engine


class FrontierDecision(StrEnum):
    INCOMPLETE = "INCOMPLETE"
    HOLD = "HOLD"
    ADOPT = "ADOPT"


@dataclass(frozen=True)
class Plan:
    arms: dict[str, str]
    reference_arm: str
    task_manifest: str
    task_manifest_digest: str
    confidence_level: float
    max_breakage_rate: float
    min_cost_reduction_rate: float
    bootstrap_samples: int
    seed: int
    min_paired_tasks: int
    schema_version: int = 1
    plan_digest: str = ""

    @property
    def candidates(self) -> tuple[str, ...]:
        return tuple(a for a in sorted(self.arms) if a != self.reference_arm)

    @property
    def alpha(self) -> float:
        """Two bounds per candidate share what the confidence level leaves."""
        return (1 - self.confidence_level) / (2 * len(self.candidates))


def plan_problems(plan: Plan) -> list[str]:
    check = validate.number_problem
    found = [None if plan.schema_version == 1 else "plan schema_version must be 1"]
    if not isinstance(plan.arms, dict) or len(plan.arms) < 2:
        return ["plan needs two arms at least"]
    found += [None if isinstance(k, str) and k and isinstance(v, str) and v else f"plan arm {k!r} needs an id and a path" for k, v in plan.arms.items()]
    found.append(None if plan.reference_arm in plan.arms else "plan reference_arm is not an arm")
    found.append(None if isinstance(plan.task_manifest, str) and plan.task_manifest else "plan needs a task_manifest path")
    hexadecimal = isinstance(plan.task_manifest_digest, str) and len(plan.task_manifest_digest) == 64 and set(plan.task_manifest_digest) <= set("0123456789abcdef")
    found.append(None if hexadecimal else "plan task_manifest_digest must be a lower-case SHA-256")
    level = check("plan confidence_level", plan.confidence_level, most=1.0)
    found.append(level or (None if 0 < plan.confidence_level < 1 else "plan confidence_level must lie within (0, 1)"))
    for name in ("max_breakage_rate", "min_cost_reduction_rate"):
        found.append(check(f"plan {name}", getattr(plan, name)) or (None if getattr(plan, name) < 1 else f"plan {name} must be below 1"))
    found += [check("plan bootstrap_samples", plan.bootstrap_samples, least=100, whole=True), check("plan seed", plan.seed, least=None, whole=True), check("plan min_paired_tasks", plan.min_paired_tasks, least=2, whole=True)]
    found = [x for x in found if x]
    if not found and plan.bootstrap_samples * plan.alpha < 20:
        found.append("plan bootstrap_samples leave fewer than 20 draws beyond the bound")
    return found


@dataclass(frozen=True)
class ArmSummary:
    arm_id: str
    decision: str
    tasks: int
    acceptable_tasks: int
    acceptable_rate: float
    mean_cost_usd: float
    dominated: bool


@dataclass(frozen=True)
class Comparison:
    candidate_arm: str
    paired_tasks: int
    harmful_regressions: int
    beneficial_changes: int
    breakage_rate: float
    breakage_rate_upper: float
    conditional_breakage_rate: float | None
    acceptable_rate_delta: float
    mean_cost_reduction_rate: float
    cost_reduction_rate_lower: float
    adjusted_alpha: float
    reference_acceptable_tasks: int
    reasons: tuple[str, ...]

    @property
    def eligible(self) -> bool:
        return not self.reasons


@dataclass(frozen=True)
class FrontierCase:
    decision: FrontierDecision
    selected_arm: str | None
    plan: Plan
    arms: tuple[ArmSummary, ...] = ()
    comparisons: tuple[Comparison, ...] = ()
    problems: tuple[str, ...] = ()


def dominated(arms: DataFrame, arm: str = "arm_id", cost: str = "mean_cost_usd", quality: str = "acceptable_rate") -> DataFrame:
    """Arms that another equals or betters in cost and quality, and betters in one of them. Arms are few: a handful of rows."""
    a, b = arms.alias("a"), arms.alias("b")
    better = (F.col(f"b.{cost}") <= F.col(f"a.{cost}")) & (F.col(f"b.{quality}") >= F.col(f"a.{quality}")) & ((F.col(f"b.{cost}") < F.col(f"a.{cost}")) | (F.col(f"b.{quality}") > F.col(f"a.{quality}")))
    return a.join(b, better & (F.col(f"a.{arm}") != F.col(f"b.{arm}")), "left_semi")


def paired(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Tasks of both arms side by side: (task_id, r_ok, c_ok, r_usd, c_usd)."""
    r = reference.select("task_id", F.col("acceptable").alias("r_ok"), F.col("effective_cost_usd").alias("r_usd"))
    c = candidate.select("task_id", F.col("acceptable").alias("c_ok"), F.col("effective_cost_usd").alias("c_usd"))
    return r.join(c, "task_id")


def paired_counts(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("paired_tasks"),
        F.count_if(F.col("r_ok") & ~F.col("c_ok")).alias("harmful_regressions"),
        F.count_if(~F.col("r_ok") & F.col("c_ok")).alias("beneficial_changes"),
        F.count_if("r_ok").alias("reference_acceptable_tasks"),
        F.count_if("c_ok").alias("candidate_acceptable_tasks"),
    )


def arm_summary(tasks: DataFrame, arm: str = "arm_id", ok: str = "acceptable", cost: str = "effective_cost_usd") -> DataFrame:
    """(arm, tasks, acceptable_rate, mean_cost_usd) from one row per arm and task; costs are summed as decimals."""
    n = F.count("*")
    return tasks.groupBy(arm).agg(n.alias("tasks"), (F.count_if(ok) / n).alias("acceptable_rate"), (F.sum(F.col(cost).cast("decimal(28,6)")).cast("double") / n).alias("mean_cost_usd"))


def ineligible(bounds: DataFrame, max_breakage_rate: float, min_cost_reduction_rate: float, decision: str | None = None) -> DataFrame:
    """Adds ``reasons``: why an arm can't be adopted, from its breakage_upper and cost_reduction_lower (and decision); empty if it can."""
    upper, lower = F.col("breakage_upper"), F.col("cost_reduction_lower")
    found = [F.when(F.coalesce(upper, F.lit(1.0)) > max_breakage_rate, "breakage"), F.when(~F.coalesce(lower >= min_cost_reduction_rate, F.lit(False)), "cost reduction")]
    if decision:
        found.append(F.when(~F.col(decision).eqNullSafe(F.lit(str(Decision.SCALE))), "decision"))
    return bounds.withColumn("reasons", F.array_compact(F.array(*found)))


def select_arm(candidates: DataFrame) -> DataFrame:
    """The eligible arm that costs least; of those that cost the same the more acceptable one, then by its name. No row: HOLD."""
    return candidates.where(F.size("reasons") == 0).orderBy("mean_cost_usd", F.desc("acceptable_rate"), "arm_id").limit(1)


def rate_drift(rates: DataFrame) -> DataFrame:
    """Models that arms price differently, from (arm_id, model, input_per_million_usd, output_per_million_usd)."""
    return rates.groupBy("model").agg(F.count_distinct(F.struct("input_per_million_usd", "output_per_million_usd")).alias("cards")).where("cards > 1")


def evaluate_frontier(plan: Plan, arms: dict[str, Evidence], problems: list[str] | tuple[str, ...] = (), mode: str = "exact") -> FrontierCase:
    """ADOPT, HOLD, or INCOMPLETE with every reason found. ``mode`` "exact" draws as CPython does, in one task per candidate; "distributed" is for more tasks than one task holds."""
    found = [*problems, *plan_problems(plan)]
    refuse = lambda summaries=(): FrontierCase(FrontierDecision.INCOMPLETE, None, plan, tuple(summaries), (), tuple(found))
    if plan_problems(plan):
        return refuse()
    missing, extra = sorted(set(plan.arms) - set(arms)), sorted(set(arms) - set(plan.arms))
    found += [f"missing planned arms: {missing}"] * bool(missing) + [f"unplanned arms supplied: {extra}"] * bool(extra)
    cases: dict[str, Case] = {}
    if not found:
        for arm in sorted(arms):
            try:
                cases[arm] = Engine().evaluate(arms[arm], label=arm, strict=True, with_digest=False)
            except EvidenceError as error:
                found += error.problems
    if len(cases) < len(arms):
        return refuse(_summaries(cases))
    found += _drift(plan, arms, cases)
    summaries = _summaries(cases)
    if found:
        return refuse(summaries)
    reference = cases[plan.reference_arm]
    comparisons = tuple(_compare(plan, reference, cases[c], c, mode) for c in plan.candidates)
    eligible = [c.candidate_arm for c in comparisons if c.eligible]
    by_arm = {s.arm_id: s for s in summaries}
    chosen = min(eligible, key=lambda a: (by_arm[a].mean_cost_usd, -by_arm[a].acceptable_rate, a), default=None)
    return FrontierCase(FrontierDecision.ADOPT if chosen else FrontierDecision.HOLD, chosen, plan, tuple(summaries), comparisons)


def _summaries(cases: dict[str, Case]) -> list[ArmSummary]:
    mean = {a: c.metrics["total_effective_cost_usd"] / c.metrics["attempts"] for a, c in cases.items()}
    rate = {a: c.metrics["acceptable_rate"] for a, c in cases.items()}

    def beaten(a: str) -> bool:
        return any(mean[b] <= mean[a] and rate[b] >= rate[a] and (mean[b] < mean[a] or rate[b] > rate[a]) for b in cases if b != a)

    return [ArmSummary(a, str(c.decision), c.metrics["attempts"], c.metrics["acceptable_count"], canonical_float(rate[a]), canonical_float(mean[a]), beaten(a)) for a, c in sorted(cases.items())]


def _drift(plan: Plan, arms: dict[str, Evidence], cases: dict[str, Case]) -> list[str]:
    found = []
    first = arms[plan.reference_arm]
    if cases[plan.reference_arm].metrics["total_effective_cost_usd"] <= 0:
        found.append(f"{plan.reference_arm}: the reference must cost more than nothing")
    if (n := cases[plan.reference_arm].metrics["attempts"]) < plan.min_paired_tasks:
        found.append(f"paired task count {n} is below the declared minimum {plan.min_paired_tasks}")
    ids = cases[plan.reference_arm].tasks.select("task_id")
    cards = None
    for arm, evidence in sorted(arms.items()):
        mine = cases[arm].tasks.select("task_id")
        if arm != plan.reference_arm and not (ids.exceptAll(mine).isEmpty() and mine.exceptAll(ids).isEmpty()):
            found.append(f"{arm}: task ids differ from the reference's")
        if evidence.policy != first.policy:
            found.append(f"{arm}: policy differs from the reference's")
        if evidence.baseline != first.baseline:
            found.append(f"{arm}: baseline differs from the reference's")
        if (got := digest.manifest_digest(evidence.manifest)) != plan.task_manifest_digest:
            found.append(f"{arm}: task manifest digest {got} is not the plan's")
        card = evidence.rates.select(F.lit(arm).alias("arm_id"), "model", "input_per_million_usd", "output_per_million_usd")
        cards = card if cards is None else cards.unionByName(card)
    found += [f"rate of shared model {r['model']!r} differs between arms" for r in rate_drift(cards).orderBy("model").collect()]
    return found


def _bootstrap(plan: Plan, pairs: DataFrame, candidate: str, mode: str) -> tuple[float, float]:
    alpha = plan.alpha
    if mode == "distributed":
        keyed = pairs.select(F.abs(F.xxhash64("task_id") % 2147483647).alias("task_key"), F.col("r_usd").alias("reference_usd"), F.col("c_usd").alias("candidate_usd"))
        draws = stats.distributed_bootstrap(keyed, plan.bootstrap_samples)
        total = pairs.agg(F.sum("r_usd").alias("r"), F.sum("c_usd").alias("c")).first()
        return stats.reduction(total["r"], total["c"]), draws.agg(F.expr(f"percentile_disc({alpha}) WITHIN GROUP (ORDER BY reduction)")).first()[0]
    seed, samples = stats.candidate_seed(plan.seed, candidate), plan.bootstrap_samples

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task_id")
        point, lower = stats.paired_bootstrap(rows["r_usd"].tolist(), rows["c_usd"].tolist(), samples, alpha, seed)
        return pd.DataFrame({"point": [point], "lower": [lower]})

    got = pairs.groupBy(F.lit(candidate)).applyInPandas(run, "point double, lower double").first()
    return got["point"], got["lower"]


def _compare(plan: Plan, reference: Case, case: Case, name: str, mode: str) -> Comparison:
    pairs = paired(reference.tasks, case.tasks).persist()
    counts = paired_counts(pairs).first()
    n, harmful = counts["paired_tasks"], counts["harmful_regressions"]
    upper = canonical_float(stats.clopper_pearson_upper(harmful, n, plan.alpha))
    point, lower = map(canonical_float, _bootstrap(plan, pairs, name, mode))
    pairs.unpersist()
    reasons = [f"{who} assurance decision is {c.decision}, not SCALE" for who, c in (("reference", reference), ("candidate", case)) if c.decision is not Decision.SCALE]
    if upper > plan.max_breakage_rate:
        reasons.append(f"breakage upper bound {upper:.3%} exceeds {plan.max_breakage_rate:.3%}")
    if lower < plan.min_cost_reduction_rate:
        reasons.append(f"cost-reduction lower bound {lower:.3%} is below {plan.min_cost_reduction_rate:.3%}")
    if not math.isfinite(point) or not math.isfinite(lower):
        reasons.append("paired cost estimate is not finite")
    good = counts["reference_acceptable_tasks"]
    return Comparison(
        name, n, harmful, counts["beneficial_changes"], canonical_float(harmful / n), upper, canonical_float(harmful / good) if good else None,
        canonical_float((counts["candidate_acceptable_tasks"] - good) / n), point, lower, canonical_float(plan.alpha), good, tuple(reasons),
    )


def payload(case: FrontierCase) -> dict:
    """The case as plain values: 12 significant digits, what isn't finite as null."""

    def safe(value):
        if isinstance(value, float):
            return canonical_float(value) if math.isfinite(value) else None
        if isinstance(value, dict):
            return {k: safe(v) for k, v in value.items()}
        return [safe(v) for v in value] if isinstance(value, (list, tuple)) else value

    return safe({"decision": str(case.decision), "selected_arm": case.selected_arm, "plan": asdict(case.plan), "arms": [asdict(a) for a in case.arms], "comparisons": [asdict(c) | {"eligible": c.eligible} for c in case.comparisons], "problems": list(case.problems)})
