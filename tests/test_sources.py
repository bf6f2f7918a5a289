import copy
import json

import pytest
from fixtures import BASELINE, POLICY, jsonl, session_lines, write_csv
from pyspark.sql import functions as F

from verdigris import cli
from verdigris.functions import pricing, shapes
from verdigris.operators import labels
from verdigris.plans.assurance import evaluate
from verdigris.schemas import Decision, EvidenceError
from verdigris.sources import contracts, files, judge, otlp, public_runs, session_tree, sessions


def filled(template, acceptable=(True, False)):
    c = copy.deepcopy(template)
    c["outcome_contract"] = {"label_source": "manual", "rubric_version": "r1"}
    c["baseline"], c["policy"] = BASELINE, POLICY
    p = c["pricing"]
    p["price_card_id"] = "card"
    for model in p["models"].values():
        for tier in model.get("tiers", [model]):
            for k in tier:
                if k.endswith("_per_million_usd"):
                    tier[k] = dict.fromkeys(tier[k], 3.75) if isinstance(tier[k], dict) else 3.0
    for k in ("tools", "server_tools"):
        if k in p:
            p[k] = dict.fromkeys(p[k], 0.01)
    for i, t in enumerate(c["tasks"]):
        t["input_digest"] = t["input_digest"] or "ab" * 32
        t |= {"acceptable": acceptable[i % len(acceptable)], "business_value_usd": 10.0, "human_minutes": 1.0, "remediation_cost_usd": 0.0, "incident_loss_usd": 0.0}
    if "task_mapping" in c:
        c["task_mapping"]["approved_by"] = "someone"
    return c


def test_session_counts_and_privacy():
    s = sessions.reduce_session(jsonl(session_lines()))
    assert (len(s.tasks), len(s.models), len(s.tools), len(s.edges)) == (2, 4, 2, 4)
    assert [c.usage["output_tokens"] for c in s.models if c.usage["input_tokens"] == 100] == [60, 60]
    assert sorted(t.status for t in s.tools) == ["error", "ok"]
    assert "SECRET" not in repr(s)


def test_session_evidence(spark):
    s = sessions.reduce_session(jsonl(session_lines()))
    e = contracts.session_evidence(spark, s, filled(contracts.session_template(s)))
    costs = {r.event_id: r.direct_cost_usd for r in e.events.collect()}
    big = (100 * 3 + 60 * 3 + 200 * 3 + 100 * 3.75) / 1e6
    assert sorted(round(c, 9) for c in costs.values()) == sorted([round(big, 9)] * 2 + [round(120 * 3 / 1e6 + 0.01, 9)] * 2 + [0.01] * 2)
    assert evaluate(e).decision in (Decision.ASSIST, Decision.STOP)
    with pytest.raises(EvidenceError):
        contracts.session_evidence(spark, s, filled(contracts.session_template(s)) | {"schema_version": 2})


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda r: r[1].update(uuid="p0"), "repeated record uuid"),
        (lambda r: r[1].update(parentUuid="nowhere"), "unresolved"),
        (lambda r: r[0].update(parentUuid="p0-c", userType="internal"), "cycle"),
        (lambda r: r[3]["message"]["content"][0].update(tool_use_id="other"), "exactly one result"),
        (lambda r: r[4].update(isSidechain=True), "side-chain"),
        (lambda r: r[4].update(sessionId="s-2"), "exactly one sessionId"),
        (lambda r: r[2]["message"].update(model="m-2"), "differ in model"),
        (lambda r: r[2]["message"]["usage"].update(input_tokens=7), "differing input_tokens"),
        (lambda r: r[1]["message"]["usage"].update(cache_creation_input_tokens=7), "do not add up"),
        (lambda r: r[3]["message"]["content"][0].update(is_error="no"), "is_error"),
        (lambda r: r[0]["message"].update(content=[{"type": "image"}]), "unsupported blocks"),
        (lambda r: r[4].update(parentUuid="p1"), None),
    ],
)
def test_session_refusals(change, message):
    records = session_lines()
    change(records)
    if message is None:
        sessions.reduce_session(jsonl(records))
        return
    with pytest.raises(EvidenceError, match=message):
        sessions.reduce_session(jsonl(records))


def test_many_sessions(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(jsonl(session_lines()))
    (tmp_path / "b.jsonl").write_bytes(b"not json\n")
    rows = sessions.read_sessions(spark, str(tmp_path / "*.jsonl")).collect()
    assert sum(r.problem is None for r in rows) == 6 and sum(r.problem is not None for r in rows) == 1


def tree(folder, depth=1, tool="Agent"):
    usage = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0, "cache_creation": {}, "server_tool_use": {}}
    base = {"sessionId": "s", "version": "1"}
    bot = lambda u, up, m, content, at, **k: base | {"type": "assistant", "uuid": u, "parentUuid": up, "timestamp": f"T{at}", "message": {"role": "assistant", "id": m, "model": "m", "content": content, "usage": usage}} | k
    user = lambda u, up, content, at, **k: base | {"type": "user", "uuid": u, "parentUuid": up, "timestamp": f"T{at}", "userType": "external", "message": {"role": "user", "content": content}} | k
    call = {"type": "tool_use", "id": "spawn", "name": tool, "input": {"prompt": "SECRET"}}
    side = {"agentId": "c1", "isSidechain": True, "parentSessionId": "s"}
    parent = [user("u", None, "go", 0), bot("a", "u", "m1", [call], 1), user("r", "a", [{"type": "tool_result", "tool_use_id": "spawn"}], 6, sourceToolAssistantUUID="a"), bot("f", "r", "m2", [{"type": "text", "text": "x"}], 7)]
    child = [bot("ca", None, "m1", [call], 1, **side), user("cr", "ca", [{"type": "tool_result", "tool_use_id": "spawn"}, {"type": "text", "text": "x"}], 2, **side), bot("cb", "cr", "cm1", [{"type": "tool_use", "id": "read", "name": "Read", "input": {}}], 3, **side), user("cc", "cb", [{"type": "tool_result", "tool_use_id": "read"}], 4, sourceToolAssistantUUID="cb", **side), bot("cd", "cc", "cm2", [{"type": "text", "text": "x"}], 5, **side)]
    (folder / "t" / "subagents").mkdir(parents=True)
    (folder / "t.jsonl").write_bytes(jsonl(parent))
    (folder / "t" / "subagents" / "agent-c1.jsonl").write_bytes(jsonl(child))
    (folder / "t" / "subagents" / "agent-c1.meta.json").write_text(json.dumps({"toolUseId": "spawn", "spawnDepth": depth}))
    return str(folder / "t.jsonl")


def test_session_tree(spark, tmp_path):
    s = session_tree.read_tree(tree(tmp_path))
    assert (len(s.tasks), len(s.models), len(s.tools), len(s.edges)) == (1, 4, 2, 6)
    assert len({c.task_id for c in [*s.models, *s.tools]}) == 1 and not s.unexpanded
    assert evaluate(contracts.session_evidence(spark, s, filled(contracts.session_template(s)))).metrics["attempts"] == 1


def test_session_tree_refusals(tmp_path):
    with pytest.raises(EvidenceError, match="depth in the tree"):
        session_tree.read_tree(tree(tmp_path / "a", depth=2))
    path = tree(tmp_path / "b")
    (tmp_path / "b" / "t" / "subagents" / "agent-c1.meta.json").unlink()
    with pytest.raises(EvidenceError, match="don't pair"):
        session_tree.read_tree(path)
    with pytest.raises(EvidenceError, match="delegating|does not delegate|delegates"):
        session_tree.read_tree(tree(tmp_path / "c", tool="Read"))


def test_boundaries_of_a_cycle():
    times = {"a": "1", "b": "2", "c": "3"}
    assert session_tree.boundaries(times, [("a", "b"), ("b", "a"), ("b", "c")]) == (["a"], ["c"])


def span(i, parent, op=None, at="1746026930686364157", **more):
    values = {"gen_ai.operation.name": op, "gen_ai.request.model": "m" if op == "chat" else None, "gen_ai.tool.name": "retrieve" if op == "execute_tool" else None, "secret.content": "SECRET"}
    attributes = [{"key": k, "value": {"stringValue": v}} for k, v in values.items() if v] + [{"key": k, "value": {"intValue": v}} for k, v in more.items()]
    return {"traceId": "ab" * 16, "spanId": f"{i:016x}", "parentSpanId": "" if parent is None else f"{parent:016x}", "startTimeUnixNano": at, "attributes": attributes}


def write_otlp(path, spans):
    path.write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"scope": {"name": "lib", "version": "1"}, "spans": spans}]}]}))
    return str(path)


TOKENS = {"gen_ai.usage.input_tokens": "100", "gen_ai.usage.output_tokens": "20"}


def test_otlp(spark, tmp_path):
    path = write_otlp(tmp_path / "t.json", [span(1, None, "chat", **TOKENS), span(2, 1), span(3, 2, "execute_tool")])
    traces = otlp.inspect(spark, path)
    assert (traces.inventory["model_call_count"], traces.inventory["tool_call_count"], traces.inventory["dependency_edge_count"]) == (1, 1, 1)
    assert traces.tasks.first()["started_at"] == "2025-04-30T15:28:50.686364157Z"
    evidence = contracts.trace_evidence(spark, traces, filled(contracts.trace_template(traces), (True,)))
    assert evaluate(evidence).metrics["total_effective_cost_usd"] == pytest.approx(1.0 + 0.01 + 120 * 3 / 1e6)


@pytest.mark.parametrize(
    ("spans", "message"),
    [
        ([span(1, None, "chat")], "without tokens"),
        ([span(1, None, "dance", **TOKENS)], "unsupported operation"),
        ([span(1, None, "chat", **TOKENS), span(1, None, "chat", **TOKENS)], "more than once"),
        ([span(1, 9, "chat", **TOKENS)], "parent"),
        ([span(1, 2, "chat", **TOKENS), span(2, 1)], "cycle|parent"),
        ([span(1, None, "chat", at="01", **TOKENS)], "start time"),
        ([span(1, None)], "no span of a model or tool"),
    ],
)
def test_otlp_refusals(spark, tmp_path, spans, message):
    if "cycle" in message:
        traces = None
        try:
            traces = otlp.inspect(spark, write_otlp(tmp_path / "t.json", spans))
        except EvidenceError:
            return
        assert traces.edges.count() <= 1  # an economic span ends every chain, so this one has no cycle to find
        return
    with pytest.raises(EvidenceError, match=message):
        otlp.inspect(spark, write_otlp(tmp_path / "t.json", spans)).edges.count()


def test_ids(spark):
    rows = spark.createDataFrame([("AB" * 8,), ("q83vq83vq80=",), ("xyz",)], "t string").select(otlp.decoded_id(F.col("t"), 8)).collect()
    assert [r[0] for r in rows] == ["ab" * 8, "abcdefabcdefabcd", None]


def test_strict_json_and_shapes(spark):
    for bad in ('{"a":1,"a":2}', "NaN", "{"):
        with pytest.raises(ValueError):
            shapes.strict_json(bad)
    assert shapes.shape_of({"b": [1, "x", 2.0, None], "a": True}) == ["object", [["a", "bool"], ["b", ["array", ["int", "str", "float"]]]]]
    assert shapes.canonical_float(0.1 + 0.2) == 0.3 and str(shapes.canonical_float(-0.0)) == "0.0"
    assert "v" not in json.dumps(shapes.redacted({"v": [1, 2, 3, 4]})).replace("value", "")


def test_truth_values(spark):
    ok = spark.createDataFrame([("Yes",), ("0",), ("TRUE",)], "t string").select(files.truth(F.col("t"))).collect()
    assert [r[0] for r in ok] == [True, False, True]
    with pytest.raises(Exception, match="not a truth value"):
        spark.createDataFrame([("t",)], "t string").select(files.truth(F.col("t"))).collect()


def test_bundle_refusals(spark):
    from verdigris.plans.studies import two_tasks

    for change in ({"events": [{"task_id": "a"}]}, {"outcomes": "x"}, {"dependency_edges": [["a"]]}, {"rates": {"m": {}}}):
        with pytest.raises(EvidenceError):
            files.bundle_of(spark, two_tasks() | change)
    with pytest.raises(EvidenceError, match="digest"):
        files.bundle_of(spark, two_tasks() | {"conversion": {"evidence_digest": "0" * 64}})


def test_tables_round_trip(spark, tmp_path):
    e = files.csv_bundle(spark, **write_csv(tmp_path))
    files.write_tables(e, str(tmp_path / "tables"))
    again = files.read_tables(spark, str(tmp_path / "tables"), e.baseline, e.policy)
    assert evaluate(again).metrics == evaluate(e).metrics


def test_judge(spark, tmp_path):
    rubric = judge.rubric_of({"rubric_id": "r", "acceptable_threshold": 0.7, "business_value_usd": 5, "failure_human_minutes": 3, "criteria": [{"id": "a", "question": "?", "weight": 0.5}, {"id": "b", "question": "?", "weight": 0.5}]})
    (tmp_path / "tasks.csv").write_text("task_id,output,context\n1, good answer ,c\n2,bad,c\n3,,c\n")
    tasks = judge.read_tasks(spark, str(tmp_path / "tasks.csv")).fillna("", ["output"])
    got = {r.task_id: r for r in judge.outcomes_of(tasks, rubric, judge.word_judge(("a", "b"), ("good", "answer"))).collect()}
    assert (got["1"].acceptable, got["1"].business_value_usd) == (True, 5.0)
    assert (got["2"].acceptable, got["2"].human_minutes, got["2"].judge_error) == (False, 3.0, False)
    assert (got["3"].acceptable, got["3"].human_minutes, got["3"].judge_error) == (False, 0.0, True)
    with pytest.raises(EvidenceError):
        judge.rubric_of({"rubric_id": "r", "acceptable_threshold": 1, "criteria": [{"id": "a", "question": "?", "weight": 0.5}]})


def test_confusion(spark):
    rows = [(True, True), (True, False), (False, True), (False, False), (False, None)]
    r = labels.confusion(spark.createDataFrame(rows, "expected boolean, predicted boolean")).first()
    assert (r.errors, r.agreement, r.precision, r.recall, r.false_accept_rate) == (1, 0.5, 0.5, 0.5, 0.5)
    none = labels.confusion(spark.createDataFrame([(True, None)], "expected boolean, predicted boolean")).first()
    assert (none.agreement, none.f1) == (0.0, 0.0)


def test_tiers(spark):
    tiers = F.array(F.struct(F.lit(10).alias("up_to")), F.struct(F.lit(None).cast("int").alias("up_to")))
    rows = spark.range(9, 12).select(pricing.first_tier(tiers, F.col("id")).getField("up_to")).collect()
    assert [r[0] for r in rows] == [10, 10, None]


def test_public_runs(spark, tmp_path):
    run = {"model": "m", "resolved": True, "scores_resolved": 1, "api_calls": 3, "instance_cost_usd": 0.6}
    (tmp_path / "runs.json").write_text(json.dumps({"schema_version": "x", "tasks": [{"task_id": "a", "runs": {"m1": run, "m2": run | {"resolved": False}}}]}))
    runs = public_runs.read_runs(spark, str(tmp_path / "runs.json"), tasks=1)
    assert [(r.arm, r.message) for r in public_runs.run_problems(runs).collect()] == [("m2", "resolved differs from the scores")]
    assert sorted(r.direct_cost_usd for r in public_runs.call_events(runs.where("arm = 'm1'")).collect()) == [0.0, 0.0, 0.6]
    with pytest.raises(EvidenceError):
        public_runs.read_runs(spark, str(tmp_path / "runs.json"), tasks=20)


def test_command_line(spark, tmp_path, capsys):
    paths = write_csv(tmp_path)
    arguments = [x for k, v in paths.items() for x in (f"--{k.removesuffix('_path')}", v)]
    assert cli.main(["evaluate", *arguments, "--ci"], spark) == 3
    assert "ASSIST" in capsys.readouterr().out
    assert cli.main(["evaluate", "--bundle", "nowhere", *arguments], spark) == 2
    (tmp_path / "s.jsonl").write_bytes(jsonl(session_lines()))
    assert cli.main(["template", "session", str(tmp_path / "s.jsonl"), "--out", str(tmp_path / "c.json")], spark) == 0
    (tmp_path / "c.json").write_text(json.dumps(filled(json.loads((tmp_path / "c.json").read_text()))))
    assert cli.main(["convert", "session", str(tmp_path / "s.jsonl"), "--contract", str(tmp_path / "c.json"), "--out", str(tmp_path / "b.json")], spark) == 0
    assert cli.main(["evaluate", "--bundle", str(tmp_path / "b.json")], spark) == 0
    assert cli.main(["convert", "session", str(tmp_path / "s.jsonl"), "--contract", str(tmp_path / "c.json"), "--out", str(tmp_path / "c.json")], spark) == 2
