import json
import math
import random

import pytest
from pyspark.sql import functions as F

from verdigris import report
from verdigris.functions import stats
from verdigris.plans import frontier, studies
from verdigris.plans.frontier import FrontierDecision, evaluate_frontier
from verdigris.schemas import EvidenceError
from verdigris.sources import frontier_files


@pytest.fixture(scope="module")
def experiment(spark, tmp_path_factory):
    return frontier_files.read_experiment(spark, studies.write_experiment(spark, str(tmp_path_factory.mktemp("frontier"))))


@pytest.fixture(scope="module")
def case(experiment):
    return evaluate_frontier(*experiment)


def test_golden_decision(case, experiment):
    assert experiment[0].task_manifest_digest == "8ab1d32aff8ff1d42fa3d7fecff28bc36548dd1c9905b972a0ed701c874298d4"
    assert (case.decision, case.selected_arm) == (FrontierDecision.ADOPT, "balanced-4-step")


def test_golden_bounds(case):
    got = {c.candidate_arm: (c.breakage_rate_upper, c.cost_reduction_rate_lower) for c in case.comparisons}
    assert got == {"balanced-4-step": (0.0374307915066, 0.320091923835), "cheap-2-step": (0.124773141319, 0.299269153226), "premium-12-step": (0.0262465865636, -0.389441800087)}
    assert next(c for c in case.comparisons if c.eligible).mean_cost_reduction_rate == 0.398732065399


def test_golden_arms(case):
    arms = {a.arm_id: a for a in case.arms}
    assert {k: a.mean_cost_usd for k, a in arms.items()} == {"balanced-4-step": 1.00111111111, "cheap-2-step": 0.926111111111, "premium-12-step": 2.19, "premium-8-step": 1.665}
    assert [k for k, a in arms.items() if a.dominated] == ["premium-8-step"]


def test_renderers(case):
    assert json.loads(report.frontier_json(case))["selected_arm"] == "balanced-4-step"
    assert "ADOPT balanced-4-step" in report.frontier_markdown(case) and report.frontier_svg(case).startswith("<svg")


def test_distributed_bootstrap_is_near(spark, experiment):
    plan, arms, _ = experiment
    case = evaluate_frontier(plan, arms, mode="distributed")
    lower = {c.candidate_arm: c.cost_reduction_rate_lower for c in case.comparisons}
    assert lower["balanced-4-step"] == pytest.approx(0.32, abs=0.03) and case.selected_arm == "balanced-4-step"


def test_drift_and_missing_arms(experiment):
    plan, arms, _ = experiment
    assert evaluate_frontier(plan, {k: v for k, v in arms.items() if k != "cheap-2-step"}).decision is FrontierDecision.INCOMPLETE
    other = arms["cheap-2-step"].with_(policy=arms["cheap-2-step"].policy.__class__(**arms["cheap-2-step"].policy.__dict__ | {"max_calls_per_task": 9}))
    got = evaluate_frontier(plan, arms | {"cheap-2-step": other})
    assert got.decision is FrontierDecision.INCOMPLETE and "policy differs" in got.problems[0] and got.arms and not got.comparisons
    fewer = arms["cheap-2-step"]
    cut = fewer.with_(events=fewer.events.where("task_id <> 'case-007'"), outcomes=fewer.outcomes.where("task_id <> 'case-007'"), manifest=fewer.manifest.where("task_id <> 'case-007'"))
    assert any("task ids differ" in p for p in evaluate_frontier(plan, arms | {"cheap-2-step": cut}).problems)


def test_plan_rules(spark, tmp_path):
    for change in ({"confidence_level": 1}, {"bootstrap_samples": 50}, {"bootstrap_samples": 200}, {"min_paired_tasks": 1}, {"seed": True}, {"reference_arm": "none"}, {"task_manifest_digest": "x"}, {"max_breakage_rate": 1}, {"schema_version": 2}):
        with pytest.raises(EvidenceError):
            frontier_files.read_plan(studies.write_experiment(spark, str(tmp_path), **change))


def test_paths_stay_below_the_plan(spark, tmp_path):
    (tmp_path / "out.json").write_text("{}")
    path = studies.write_experiment(spark, str(tmp_path / "in"), arms={"premium-8-step": "../out.json", "b": "arms/cheap-2-step.json"})
    assert any("not a file below" in p for p in frontier_files.read_experiment(spark, path)[2])


@pytest.mark.parametrize("n", [1, 2, 5, 20, 100, 500])
@pytest.mark.parametrize("alpha", [0.05, 0.025, 0.01, 0.001])
def test_bound_without_failures_has_a_closed_form(n, alpha):
    assert stats.clopper_pearson_upper(0, n, alpha) == pytest.approx(1 - alpha ** (1 / n), abs=1e-12)
    assert stats.clopper_pearson_upper(n, n, alpha) == 1.0


def test_bootstrap_of_proportional_arms():
    rng = random.Random(3)
    costs = [rng.uniform(1, 9) for _ in range(30)]
    point, lower = stats.paired_bootstrap(costs, [c * 0.5 for c in costs], 200, 0.05, 1)
    assert point == pytest.approx(0.5) and lower == pytest.approx(0.5)
    assert stats.reduction(0.0, 1.0) == -math.inf


def test_dominance_needs_one_strict_gain(spark):
    arms = spark.createDataFrame([("a", 1.0, 0.9), ("b", 1.0, 0.9), ("c", 2.0, 0.9)], "arm_id string, mean_cost_usd double, acceptable_rate double")
    assert [r.arm_id for r in frontier.dominated(arms).collect()] == ["c"]


def test_rate_drift(spark):
    cards = spark.createDataFrame([("a", "m", 1.0, 2.0), ("b", "m", 1.0, 2.0), ("a", "x", 1.0, 2.0), ("b", "x", 1.5, 2.0)], "arm_id string, model string, input_per_million_usd double, output_per_million_usd double")
    assert [r.model for r in frontier.rate_drift(cards).collect()] == ["x"]
    assert frontier.paired_counts(spark.createDataFrame([(True, False), (False, True), (True, True)], "r_ok boolean, c_ok boolean")).select(F.sum("harmful_regressions")).first()[0] == 1
