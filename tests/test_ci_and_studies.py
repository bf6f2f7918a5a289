"""Runs of workflows, judged tasks with retries and fallbacks, strict traces, bounded findings, and the propositions on label error."""

import json

import pytest
from pyspark.sql import functions as F

import verdigris
from fixtures import write_csv
from verdigris import ci, report
from verdigris.functions import shapes
from verdigris.operators import graphs
from verdigris.plans import assurance, propositions
from verdigris.schemas import EvidenceError
from verdigris.sources import files, judge, otlp, sessions


def test_public_names():
    assert all(hasattr(verdigris, n) for n in verdigris.__all__) and len(verdigris.__all__) > 40


def test_one_kind_of_input(spark, tmp_path):
    for inputs, words in ((ci.Inputs(), "none"), (ci.Inputs(bundle="b", traces="t"), "bundle, csv"), (ci.Inputs(traces="t"), "lacks outcomes"), (ci.Inputs(adapter="x", source="s", contract="c"), "unknown adapter")):
        with pytest.raises(EvidenceError, match=words):
            ci.mode_of(inputs)
        result = ci.run(spark, inputs, tmp_path / "out" / "report.md")
        assert (result.decision, result.exit_code) == ("INCOMPLETE", 2) and "INCOMPLETE" in result.report.read_text()
    assert ci.mode_of(ci.Inputs.of({"INPUT_BUNDLE": " b.json "})) == "bundle"
    broken = tmp_path / "broken.json"
    broken.write_text("{")
    assert "not valid JSON" in ci.run(spark, ci.Inputs(bundle=str(broken)), tmp_path / "r.md").report.read_text()
    ci.write_outputs(ci.Result("END", 3, tmp_path / "r.md"), tmp_path / "outputs")
    assert (tmp_path / "outputs").read_text().startswith("decision<<END_\nEND\nEND_\n")


def test_retries_fallbacks_and_rejections(spark):
    pauses, calls = [], []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise judge.Busy
        return {"a": 1.0}

    assert judge.Patience(attempts=3, pause_s=1).call(busy, pauses.append) == {"a": 1.0} and pauses == [1, 2]
    with pytest.raises(judge.Rejected):
        judge.Patience().call(lambda: (_ for _ in ()).throw(judge.Rejected()), pauses.append)

    def first(output, context):
        if "odd" in output:
            raise ValueError
        if "wrong key" in output:
            raise judge.Rejected("wrong key")
        return {"a": 1.0}

    tasks = spark.createDataFrame([("1", "fine", ""), ("2", "odd", "x"), ("3", "odd", "")], "task_id string, output string, context string")
    found = {r.task_id: r.score for r in judge.judged(tasks, first, lambda o, c: {"a": 0.25} if c else {}["none"]).collect()}
    assert found == {"1": 1.0, "2": 0.25, "3": None}
    with pytest.raises(Exception, match="wrong key"):
        judge.judged(tasks.withColumn("output", F.lit("wrong key")), first).collect()


def test_selected_cases(spark):
    cases = spark.createDataFrame([(i,) for i in "cab"], "task_id string")
    assert [r[0] for r in judge.selected_cases(cases, first=2).collect()] == ["a", "b"]
    assert {r[0] for r in judge.selected_cases(cases, only=("c", "a")).collect()} == {"a", "c"}
    with pytest.raises(EvidenceError, match="no such cases: z"):
        judge.selected_cases(cases, only=("z",))


SPAN = {"traceId": "0" * 31 + "1", "spanId": "0" * 15 + "1", "startTimeUnixNano": "1", "attributes": [{"key": "gen_ai.operation.name", "value": {"stringValue": "execute_tool"}}, {"key": "gen_ai.tool.name", "value": {"stringValue": "t"}}]}


def export(**changes):
    return {"resourceSpans": [{"scopeSpans": [{"scope": {"name": "s"}, "spans": [SPAN | changes]}]}]}


@pytest.mark.parametrize(
    ("text", "words"),
    [
        (json.dumps(export())[:-4], "not valid JSON"),
        ('{"resourceSpans": [], "resourceSpans": []}', "repeated key"),
        ('{"resourceSpans": []}', "isn't empty"),
        ('{"resourceSpans": [{"scopeSpans": [{"scope": {"name": "s"}, "spans": []}]}]}', "isn't empty"),
        (json.dumps(export(attributes=[{"key": "a", "value": {"stringValue": "x", "intValue": "1"}}])), "exactly one"),
        (json.dumps(export(attributes=[{"key": "a", "value": {}}])), "exactly one"),
        (json.dumps(export(attributes=[{"key": "a", "value": {"intValue": "01"}}])), "whole number"),
        (json.dumps(export(attributes=[{"key": "a", "value": {"doubleValue": -1}}])), "0 or more"),
        (json.dumps(export(attributes=SPAN["attributes"] * 2)), "repeated attribute"),
    ],
)
def test_unsound_exports_are_refused(spark, tmp_path, text, words):
    (tmp_path / "sound.json").write_text(json.dumps(export()))
    assert otlp.inspect(spark, str(tmp_path)).inventory["span_count"] == 1
    (tmp_path / "unsound.json").write_text(text)
    with pytest.raises(EvidenceError, match=words):
        otlp.inspect(spark, str(tmp_path))


def test_propositions(spark):
    found = propositions.label_report(spark, 500)
    assert found.holds and found.text().count("holds") == 3
    assert sum(ok for *_, ok in found.agreement) == 1 and len(found.agreement) == 15
    row = next(r for r in found.agreement if r[:2] == (0.7, 0.1))
    assert round(row[3], 3) == 0.936
    bent = propositions.summed(propositions.workloads(spark, 50)).withColumn("judged_net", F.col("net") + F.col("v_max") + 1)
    assert propositions.difference_bound(bent).first()[0] == 50


def test_depths(spark):
    rows = [("r", None), *((f"n{i}", "r" if i == 0 else f"n{i - 1}") for i in range(300)), ("x", "r")]
    got = {r.node: (r.root, r.depth) for r in graphs.depths(spark.createDataFrame(rows, "id string, up string"), "id", "up").collect()}
    assert got == {"r": ("r", 0), "x": ("r", 1), **{f"n{i}": ("r", i + 1) for i in range(300)}}
    with pytest.raises(EvidenceError, match="cycle"):
        graphs.depths(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, up string"), "id", "up", max_depth=64)


def test_fragments_of_one_message_as_rows_and_as_records(spark):
    parts = [{"input_tokens": 5, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0, "cache_creation": {}, "output_tokens": n, "server_tool_use": {}, "billing_context": dict.fromkeys(sessions.BILLING)} for n in (1, 9, 4)]
    rows = spark.createDataFrame([("m", "x", p["input_tokens"], p["output_tokens"], str(i)) for i, p in enumerate(parts)] + [("d", "x", 1, 1, "0"), ("d", "y", 1, 1, "1")], "message string, model string, input_tokens int, output_tokens int, timestamp string")
    got = {r.message: r for r in sessions.merged_fragments(rows).collect()}
    assert got["m"].output_tokens == sessions.merged_usage(parts, "m")["output_tokens"] == 9 and got["m"].problem is None and got["m"].fragments == 3
    assert got["d"].problem == "model"


def test_ids_of_columns_and_of_records(spark):
    row = spark.range(1).select(shapes.opaque_id("cc-task", F.lit("s"), F.lit("u")).alias("i")).first()
    assert row.i == sessions.opaque("cc-task", "s", "u")


def test_findings_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(assurance, "FINDINGS", 1)
    case = assurance.evaluate(files.csv_bundle(spark, **write_csv(tmp_path)))
    assert max(case.finding_counts.values()) > 1 and len([r for r in case.results if r.check_id == "gate.runtime-caps"]) == 1
    assert case.findings.count() == sum(case.finding_counts.values()) and str(case.decision) == "ASSIST"
    assert "Failing tasks" in report.analyst_context(case)
