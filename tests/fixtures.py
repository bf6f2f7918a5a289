"""Support fixture: 36 events of 8 tasks, and what they cost."""

import csv
import json

POLICY = {"human_hourly_cost_usd": 60.0, "min_acceptable_rate": 0.8, "max_cost_per_acceptable_outcome_usd": 2.0, "max_p95_task_cost_usd": 8.0, "max_trace_cost_per_task_usd": 0.15, "max_calls_per_task": 8, "min_expected_net_value_per_attempt_usd": 0.0, "min_incremental_net_value_vs_baseline_usd": 0.0, "repetition_warning_threshold": 3}
BASELINE = {"name": "human-only support queue", "cost_per_attempt_usd": 5.0, "acceptable_rate": 0.7, "value_per_acceptable_outcome_usd": 8.0}
RATES = {"edge-small": {"input_per_million_usd": 0.15, "output_per_million_usd": 0.6}, "frontier-large": {"input_per_million_usd": 2.5, "output_per_million_usd": 10.0}}
S, F, SEARCH, CRM = "edge-small", "frontier-large", 0.005, 0.002
#: (task, calls): a model call is (name, model, in, out), a tool call (name, cost).
CALLS = {
    1: [("route", S, 1000, 200), ("crm_lookup", CRM), ("answer", F, 8000, 1200)],
    2: [("route", S, 900, 180), ("search", SEARCH), ("crm_lookup", CRM), ("answer", F, 9000, 1300)],
    3: [("route", S, 1200, 220), ("search", SEARCH), ("answer", F, 10000, 1500), ("retry", F, 5000, 800)],
    4: [("route", S, 800, 160), ("crm_lookup", CRM), ("answer", F, 7000, 1000)],
    5: [("plan", S, 1500, 300), *[("search", SEARCH), ("reflect", F, 12000, 1000)] * 5, ("final", F, 6000, 500)],
    6: [("route", S, 1000, 200), ("search", SEARCH), ("answer", F, 7500, 1100)],
    7: [("route", S, 1100, 220), ("search", SEARCH), ("crm_lookup", CRM), ("answer", F, 8500, 1250)],
    8: [("route", S, 700, 140), ("crm_lookup", CRM), ("answer", F, 6000, 900)],
}


def rows():
    events, n = [], 0
    for task, calls in CALLS.items():
        for i, call in enumerate(calls):
            n += 1
            tool = len(call) == 2
            arguments = json.dumps({"query" if call[0] == "search" else "customer_id": f"v{n}"}) if tool else "{}"
            events.append([f"t-{task:03d}", f"e-{n:03d}", f"2026-07-01T10:{task:02d}:{i:02d}Z", "tool" if tool else "model", call[0], "" if tool else call[1], 0 if tool else call[2], 0 if tool else call[3], call[1] if tool else "", "error" if call[0] in ("retry", "final") else "ok", arguments])
    bad = {3: (6, 0.5, 0), 5: (10, 1, 3)}
    outcomes = [[f"t-{t:03d}", "false" if t in bad else "true", 0 if t in bad else 8, *bad.get(t, (0, 0, 0))] for t in CALLS]
    return events, outcomes


def write_csv(folder):
    events, outcomes = rows()
    heads = ("task_id,event_id,timestamp,event_type,name,model,input_tokens,output_tokens,direct_cost_usd,status,arguments", "task_id,acceptable,business_value_usd,human_minutes,remediation_cost_usd,incident_loss_usd")
    paths = {}
    for name, head, table in zip(("traces", "outcomes"), heads, (events, outcomes), strict=True):
        paths[f"{name}_path"] = str(folder / f"{name}.csv")
        with open(paths[f"{name}_path"], "w", newline="") as f:
            csv.writer(f).writerows([head.split(","), *table])
    for name, value in (("rates", RATES), ("baseline", BASELINE), ("policy", POLICY)):
        paths[f"{name}_path"] = str(folder / f"{name}.json")
        (folder / f"{name}.json").write_text(json.dumps(value))
    return paths


def session_lines():
    """A session of two prompts: the first reads a file, the second fails at a command."""
    usage = lambda i, o, **more: {"input_tokens": i, "output_tokens": o, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0, "cache_creation": {}, "server_tool_use": {}, "service_tier": "standard"} | more
    base = {"sessionId": "s-1", "isSidechain": False, "version": "1.0"}
    user = lambda uuid, up, content, at, **more: base | {"type": "user", "uuid": uuid, "parentUuid": up, "timestamp": at, "userType": "external", "message": {"role": "user", "content": content}} | more
    bot = lambda uuid, up, name, content, at, use: base | {"type": "assistant", "uuid": uuid, "parentUuid": up, "timestamp": at, "message": {"role": "assistant", "id": name, "model": "m-1", "content": content, "usage": use}}
    cached = {"cache_read_input_tokens": 200, "cache_creation_input_tokens": 100, "cache_creation": {"ephemeral_5m": 40, "ephemeral_1h": 60}}
    out = []
    for k, (tool, error) in enumerate((("Read", False), ("Bash", True))):
        p = f"p{k}"
        at = lambda s, k=k: f"2026-07-17T16:0{k}:0{s}Z"
        out += [
            user(p, None, f"SECRET prompt {k}", at(0)),
            bot(f"{p}-a", p, f"{p}-m1", [{"type": "thinking", "thinking": "SECRET"}], at(1), usage(100, 50, **cached)),
            bot(f"{p}-b", f"{p}-a", f"{p}-m1", [{"type": "tool_use", "id": f"{p}-t", "name": tool, "input": {"path": "/SECRET", "line": 4}}], at(2), usage(100, 60, **cached)),
            user(f"{p}-r", f"{p}-b", [{"type": "tool_result", "tool_use_id": f"{p}-t", "is_error": error, "content": "SECRET"}], at(3), sourceToolAssistantUUID=f"{p}-b"),
            bot(f"{p}-c", f"{p}-r", f"{p}-m2", [{"type": "text", "text": "SECRET"}], at(4), usage(80, 40, server_tool_use={"web_search": 1})),
        ]
    return out


def jsonl(records):
    return "".join(json.dumps(r) + "\n" for r in records).encode()
