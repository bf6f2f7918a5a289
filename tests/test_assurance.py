import json
import random

import pytest
from fixtures import BASELINE, POLICY, write_csv

from verdigris import report
from verdigris.operators import gates, sequences, validate
from verdigris.operators.gates import DEFAULT_CHECKS, Check
from verdigris.plans import digest, experiments, studies
from verdigris.plans.assurance import Engine, evaluate
from verdigris.schemas import Coverage, Decision, EvidenceError, Mode
from verdigris.sources import files


@pytest.fixture(scope="module")
def support(spark, tmp_path_factory):
    return files.csv_bundle(spark, **write_csv(tmp_path_factory.mktemp("support")))


@pytest.fixture(scope="module")
def case(support):
    return evaluate(support)


def test_golden_metrics(case):
    m = case.metrics
    assert case.decision is Decision.ASSIST
    assert (m["attempts"], m["acceptable_count"]) == (8, 6)
    assert m["total_effective_cost_usd"] == pytest.approx(21.020202, abs=1e-12)
    assert m["cost_per_acceptable_outcome_usd"] == pytest.approx(3.503367)
    assert m["p95_task_cost_usd"] == m["max_task_cost_usd"] == pytest.approx(14.245405)
    assert m["expected_net_value_per_attempt_usd"] == pytest.approx(3.37247475)
    assert m["incremental_net_value_vs_baseline_usd"] == pytest.approx(2.77247475)


def test_golden_results(case):
    failed = [r.message for r in case.results if r.status == "FAIL"]
    assert failed == ["acceptable_rate 75.0% < 80.0%", "cost_per_acceptable_outcome $3.50 > $2.00", "p95_task_cost $14.25 > $8.00", "t-005: 12 calls > cap of 8", "t-005: $0.2454 trace cost > cap of $0.1500"]
    assert [(r.task_id, r.message) for r in case.results if r.status == "WARN"] == [("t-005", "'search' repeated 3 times with the same argument shape (e-016..e-020)")]


def test_reports(case):
    assert "ASSIST" in report.case_markdown(case) and "$21.02" in report.case_markdown(case)
    assert json.loads(report.case_json(case))["metrics"]["total_effective_cost_usd"] == 21.020202


def test_round_trip_keeps_the_digest(spark, support, case, tmp_path):
    files.write_bundle(support, tmp_path / "bundle.json")
    again = files.json_bundle(spark, str(tmp_path / "bundle.json"))
    assert digest.evidence_digest(again) == case.evidence_digest
    assert evaluate(again).metrics == case.metrics
    with pytest.raises(EvidenceError):
        files.write_bundle(support, tmp_path / "bundle.json", inputs=(str(tmp_path / "bundle.json"),))


def test_order_of_rows_does_not_matter(support, case):
    shuffled = support.with_(events=support.events.orderBy("arguments"), outcomes=support.outcomes.orderBy("human_minutes"))
    again = evaluate(shuffled)
    assert again.metrics == case.metrics and again.evidence_digest == case.evidence_digest


def test_missing_coverage_runs_no_check(support):
    got = Engine(tuple(c for c in DEFAULT_CHECKS if c.id != "gate.tail-cost")).evaluate(support, with_digest=False)
    assert got.decision is Decision.INCOMPLETE and got.results == () and got.missing_coverage == ("tail_risk",)


def test_contract_changes_with_the_checks():
    full = digest.contract_digest(DEFAULT_CHECKS, frozenset(Coverage))
    assert full != digest.contract_digest(DEFAULT_CHECKS[1:], frozenset(Coverage))


def test_engine_refuses_bad_checks(support):
    with pytest.raises(EvidenceError):
        Engine((DEFAULT_CHECKS[0], DEFAULT_CHECKS[0]))
    with pytest.raises(EvidenceError):
        Engine((Check("x", "1", Mode.GATE, gates.tail_cost, frozenset(), Decision.SCALE),))
    liar = Check("gate.other", "1", Mode.GATE, gates.tail_cost, frozenset(), Decision.ASSIST)
    with pytest.raises(EvidenceError):
        Engine((*DEFAULT_CHECKS, liar)).evaluate(support, with_digest=False)


def test_own_gate(support):
    assert studies.with_own_gate(support).decision is Decision.STOP


@pytest.mark.parametrize(
    ("table", "change", "message"),
    [
        ("events", "event_id = 'e-001'", "duplicate event id"),
        ("outcomes", "task_id = 't-001'", "duplicate outcome"),
    ],
)
def test_duplicates_are_refused(support, table, change, message):
    rows = getattr(support, table)
    with pytest.raises(EvidenceError, match=message):
        evaluate(support.with_(**{table: rows.union(rows.where(change))}))


def test_unmatched_and_unpriced_are_refused(support):
    with pytest.raises(EvidenceError, match="no outcome"):
        evaluate(support.with_(outcomes=support.outcomes.where("task_id <> 't-001'")))
    with pytest.raises(EvidenceError, match="no events"):
        evaluate(support.with_(events=support.events.where("task_id <> 't-001'")))
    with pytest.raises(EvidenceError, match="unknown model cost"):
        evaluate(support.with_(rates=support.rates.where("model <> 'edge-small'")))


@pytest.mark.parametrize("value", [-1.0, float("nan"), float("inf")])
def test_hostile_numbers_are_refused(support, value):
    from pyspark.sql import functions as F

    with pytest.raises(EvidenceError, match="remediation_cost_usd"):
        evaluate(support.with_(outcomes=support.outcomes.withColumn("remediation_cost_usd", F.lit(value))))


def test_config_is_checked():
    from verdigris.schemas import Baseline, Policy

    assert not validate.config_problems(Baseline(**BASELINE), Policy(**POLICY))
    for change in ({"acceptable_rate": 0}, {"acceptable_rate": 1.5}, {"cost_per_attempt_usd": True}, {"name": ""}):
        assert validate.config_problems(Baseline(**BASELINE | change), Policy(**POLICY))
    for change in ({"max_calls_per_task": 0}, {"max_calls_per_task": 2.5}, {"min_acceptable_rate": 2}, {"repetition_warning_threshold": 0}):
        assert validate.config_problems(Baseline(**BASELINE), Policy(**POLICY | change))


def test_edges(spark, support):
    edges = spark.createDataFrame([("e-001", "e-002"), ("e-001", "e-002"), ("e-001", "e-004"), ("e-001", "nope")], "source_event_id string, target_event_id string")
    text = "; ".join(validate.problems_of(support.with_(edges=edges)))
    assert "duplicate edge" in text and "crosses tasks" in text and "unknown event" in text


def test_cycles():
    assert sequences.cycles_of([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]) == [("a", "b", "c")]
    assert sequences.cycles_of([("x", "x")]) == [("x",)]
    chain = [(str(i), str(i + 1)) for i in range(5000)]
    assert sequences.cycles_of(chain) == []


def test_runs_against_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(t, f"{t}-{i:03d}", rng.choice("ab")) for t in range(20) for i in range(30)]
    want, run = [], {}
    for t, e, s in rows:
        before = run.get(t)
        run[t] = (s, before[1] + 1, before[2]) if before and before[0] == s else (s, 1, e)
        if run[t][1] == 3:
            want.append((t, s, run[t][2], e))
    got = sequences.repeated_runs(spark.createDataFrame(rows, "task_id int, event_id string, s string"), "s", 3, order=("event_id",))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_drift_study(spark):
    rows = {r["dimension"]: r for r in experiments.drift_summary(spark).collect()}
    assert {k: r["false_scale"] for k, r in rows.items()} == {"outcome_quality": 2, "unit_economics": 1, "tail_risk": 8, "business_value": 1, "counterfactual": 3, "runtime_caps": 8}
    assert sum(r["at_risk"] for r in rows.values()) == 510 and sum(r["evaluations"] for r in rows.values()) == 588


def test_mutation_study(spark):
    rows = {r["operator"]: r for r in experiments.mutation_score(spark).collect()}
    assert (rows["removal"]["fixed_killed"], rows["removal"]["dynamic_killed"], rows["removal"]["scored"]) == (510, 487, 510)
    assert (rows["substitution"]["fixed_killed"], rows["substitution"]["dynamic_killed"]) == (487, 487)
    assert sum(r["equivalent"] for r in rows.values()) == 156


def test_sensitivity_study(spark):
    rows = experiments.flips(spark).collect()
    classes = [r["class"] for r in rows]
    assert (classes.count("robust"), classes.count("fragile"), classes.count("brittle"), max(r["flips"] for r in rows)) == (43, 0, 55, 42)
    assert {r["change"]: r["fragile"] for r in experiments.baseline_fragility(spark).collect()} == {"-50%": 25, "-25%": 9, "-10%": 1, "+10%": 4, "+25%": 9, "+50%": 12}


def test_ablation_study(spark):
    for row, want in zip(studies.ablation(spark), studies.DELETIONS, strict=True):
        assert (row["complete_decision"], row["outcome"]) == (want.complete, want.outcome), row
        assert row["operational"] == (want.decision or "INCOMPLETE")


def test_completion_study(case):
    got = studies.completion_against_verdict(case)
    assert got["more_acceptable_needed"] == 1 and got["decision"] == "ASSIST"
