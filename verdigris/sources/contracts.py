"""Conversion contracts: what people add to a recorded session or trace (outcomes, prices, policy) to make evidence of it."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from ..functions.shapes import canonical_json
from ..operators import validate
from ..schemas import EDGES, EVENTS, MANIFEST, OUTCOMES, Evidence, EvidenceError
from . import files, otlp
from .sessions import BILLING, Session, require, text_of

VERSION = 1
ECONOMICS = ("business_value_usd", "human_minutes", "remediation_cost_usd", "incident_loss_usd")
PRIVACY = "content-redacted-type-shapes-only"


def amount(value: Any, label: str) -> float:
    if problem := validate.number_problem(label, value):
        raise EvidenceError(problem)
    return float(value)


def mapping(value: Any, label: str) -> dict:
    require(isinstance(value, dict), f"{label} must be an object")
    return value


def blank_task(task_id: str, digest: str, started: str) -> dict:
    return {"task_id": task_id, "input_digest": digest, "started_at": started, "acceptable": None, **dict.fromkeys(ECONOMICS)}


def _common() -> dict:
    policy = ("human_hourly_cost_usd", "min_acceptable_rate", "max_cost_per_acceptable_outcome_usd", "max_p95_task_cost_usd", "max_trace_cost_per_task_usd", "max_calls_per_task", "min_expected_net_value_per_attempt_usd", "min_incremental_net_value_vs_baseline_usd", "repetition_warning_threshold")
    return {"schema_version": VERSION, "outcome_contract": {"label_source": None, "rubric_version": None}, "baseline": dict.fromkeys(("name", "cost_per_attempt_usd", "acceptable_rate", "value_per_acceptable_outcome_usd")), "policy": dict.fromkeys(policy)}


def session_template(session: Session) -> dict:
    """A contract with all that was observed filled in, and null where people must decide."""
    models: dict[str, dict] = {}
    for call in session.models:
        m = models.setdefault(call.model, {"contexts": set(), "buckets": set()})
        m["contexts"].add(canonical_json(call.usage["billing_context"]))
        m["buckets"] |= set(call.usage["cache_creation"])
    import json

    return _common() | {
        "adapter": adapter_of(session),
        "source_inventory": session.inventory(),
        "pricing": {
            "price_card_id": None,
            "models": {k: {"billing_contexts": [json.loads(c) for c in sorted(v["contexts"])], "tiers": [{"up_to_input_tokens": None, "input_per_million_usd": None, "output_per_million_usd": None, "cache_read_per_million_usd": None, "cache_write_per_million_usd": dict.fromkeys(sorted(v["buckets"]))}]} for k, v in sorted(models.items())},
            "tools": dict.fromkeys(sorted({t.name for t in session.tools})),
            "server_tools": dict.fromkeys(sorted({k for c in session.models for k, n in c.usage["server_tool_use"].items() if n})),
        },
        "tasks": [blank_task(t.task_id, t.input_digest, t.started_at) for t in session.tasks],
    }


def adapter_of(session: Session) -> dict:
    return {"privacy_mode": PRIVACY, "source_id": session.source_id, "source_version": "1", "task_unit": session.task_unit}


def labelled_tasks(contract: Mapping, expected: dict[str, tuple[str | None, str]]) -> tuple[list[tuple], list[tuple]]:
    """(outcome rows, manifest rows); the contract's tasks are those observed, with their digests and times."""
    about = mapping(contract.get("outcome_contract"), "outcome_contract")
    rubric = text_of(about.get("rubric_version"), "rubric_version")
    text_of(about.get("label_source"), "label_source")
    rows = contract.get("tasks")
    require(isinstance(rows, list) and all(isinstance(r, dict) for r in rows), "tasks must be a list of objects")
    by_id = {text_of(r.get("task_id"), "task_id"): r for r in rows}
    require(len(by_id) == len(rows), "a task comes twice in the contract")
    require(set(by_id) == set(expected), "the contract's tasks are not those of the source")
    outcomes, manifest = [], []
    for task, (digest, started) in sorted(expected.items()):
        row = by_id[task]
        given = row.get("input_digest")
        require(digest is None or given == digest, f"task {task!r}: input_digest differs from the source's")
        require(isinstance(given, str) and len(given) == 64 and set(given) <= set("0123456789abcdef"), f"task {task!r}: input_digest must be a lower-case SHA-256")
        require(row.get("started_at") == started, f"task {task!r}: started_at differs from the source's")
        require(isinstance(row.get("acceptable"), bool), f"task {task!r}: acceptable must be true or false")
        outcomes.append((task, row["acceptable"], *[amount(row.get(f), f"task {task!r} {f}") for f in ECONOMICS]))
        manifest.append((task, given, rubric))
    return outcomes, manifest


def tiers_of(raw: Any, model: str, buckets: set[str], contexts: set[str]) -> list[dict]:
    """Tiers with limits that grow, the last without one; rates for exactly the observed cache buckets and billing contexts."""
    card = mapping(raw, f"pricing of {model!r}")
    given = card.get("billing_contexts")
    require(isinstance(given, list) and {canonical_json({b: c.get(b) for b in BILLING}) for c in given if isinstance(c, dict)} == contexts, f"billing contexts of {model!r} are not those observed")
    tiers = card.get("tiers")
    require(isinstance(tiers, list) and tiers, f"{model!r} needs a tier")
    out, before = [], 0
    for i, tier in enumerate(tiers):
        label = f"tier {i} of {model!r}"
        limit = mapping(tier, label).get("up_to_input_tokens")
        last = i == len(tiers) - 1
        require(limit is None if last else isinstance(limit, int) and not isinstance(limit, bool) and limit > before, f"{label}: limits must grow, and the last tier has none")
        before = limit or before
        writes = mapping(tier.get("cache_write_per_million_usd"), f"{label} cache writes")
        require(set(writes) == buckets, f"{label}: cache buckets are not those observed")
        out.append({"limit": limit, "write": {k: amount(v, f"{label} {k}") for k, v in writes.items()}, **{k: amount(tier.get(f"{k}_per_million_usd"), f"{label} {k}") for k in ("input", "output", "cache_read")}})
    return out


def price_session(session: Session, pricing: dict) -> tuple[list[tuple], dict[str, dict]]:
    """(event rows, first-tier rates) with every model, tool, server tool, bucket and context priced, and none that wasn't observed."""
    card = text_of(pricing.get("price_card_id"), "price_card_id")
    seen: dict[str, tuple[set[str], set[str]]] = {}
    for c in session.models:
        buckets, contexts = seen.setdefault(c.model, (set(), set()))
        buckets.update(c.usage["cache_creation"])
        contexts.add(canonical_json(c.usage["billing_context"]))
    models, tools, served = (mapping(pricing.get(k), f"pricing.{k}") for k in ("models", "tools", "server_tools"))
    require(set(models) == set(seen), "priced models are not those observed")
    require(set(tools) == {t.name for t in session.tools}, "priced tools are not those observed")
    require(set(served) == {k for c in session.models for k, n in c.usage["server_tool_use"].items() if n}, "priced server tools are not those observed")
    tiers = {m: tiers_of(models[m], m, *seen[m]) for m in sorted(seen)}
    tool_rate = {k: amount(v, f"tool {k}") for k, v in tools.items()}
    served_rate = {k: amount(v, f"server tool {k}") for k, v in served.items()}
    rows = []
    for c in session.models:
        u = c.usage
        total = u["input_tokens"] + u["cache_read_input_tokens"] + u["cache_creation_input_tokens"]
        tier = next(t for t in tiers[c.model] if t["limit"] is None or total <= t["limit"])
        micro = u["input_tokens"] * tier["input"] + u["output_tokens"] * tier["output"] + u["cache_read_input_tokens"] * tier["cache_read"] + sum(n * tier["write"][b] for b, n in u["cache_creation"].items())
        cost = micro / 1_000_000 + sum(n * served_rate[k] for k, n in u["server_tool_use"].items() if n)
        rows.append((c.task_id, c.event_id, c.timestamp, "model", "claude-code.model", c.model, total, u["output_tokens"], cost, "ok", canonical_json({"price_card_id": card, "pricing_tier_up_to_input_tokens": tier["limit"], "usage": u})))
    rows += [(t.task_id, t.event_id, t.timestamp, "tool", t.name, "", 0, 0, tool_rate[t.name], t.status, canonical_json(t.arguments)) for t in session.tools]
    return rows, {m: {"input_per_million_usd": t[0]["input"], "output_per_million_usd": t[0]["output"]} for m, t in tiers.items()}


def _checked(contract: Mapping, name: str, wanted: dict) -> None:
    given = mapping(contract.get(name), name)
    for key, value in wanted.items():
        require(given.get(key) == value, f"{name}.{key} does not match the source")


def session_evidence(spark: SparkSession, session: Session, contract: Mapping) -> Evidence:
    """Evidence of a session under its contract, validated strictly."""
    require(contract.get("schema_version") == VERSION, f"schema_version must be {VERSION}")
    _checked(contract, "adapter", adapter_of(session))
    _checked(contract, "source_inventory", session.inventory())
    require(not session.unexpanded, f"the session delegates to agents whose transcripts are missing: {session.unexpanded}")
    outcomes, manifest = labelled_tasks(contract, {t.task_id: (t.input_digest, t.started_at) for t in session.tasks})
    events, rates = price_session(session, mapping(contract.get("pricing"), "pricing"))
    evidence = Evidence(
        spark.createDataFrame(events, EVENTS), spark.createDataFrame(outcomes, OUTCOMES), files.rate_rows(spark, rates), files.baseline_of(contract.get("baseline")), files.policy_of(contract.get("policy")),
        spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(session.edges, EDGES) if session.edges else None, session.source_id,
    )
    if problems := validate.problems_of(evidence, label="conversion", strict=True):
        raise EvidenceError(problems)
    return evidence


def trace_template(traces: otlp.Traces) -> dict:
    return _common() | {
        "adapter": dict(otlp.ADAPTER),
        "source_inventory": {k: v for k, v in traces.inventory.items() if k not in ("models", "tools")},
        "task_mapping": {"policy": "one-export-trace-is-one-evaluation-task", "approved_by": None},
        "pricing": {"price_card_id": None, "models": {m: {"input_per_million_usd": None, "output_per_million_usd": None} for m in traces.inventory["models"]}, "tools": dict.fromkeys(traces.inventory["tools"])},
        "tasks": [blank_task(r["task_id"], None, r["started_at"]) | {"trace_id_sha256": r["input_digest"]} for r in traces.tasks.orderBy("task_id").collect()],
    }


def trace_evidence(spark: SparkSession, traces: otlp.Traces, contract: Mapping) -> Evidence:
    """Evidence of traces under their contract; the events stay in Spark, the contract is joined to them."""
    from pyspark.sql import functions as F

    require(contract.get("schema_version") == VERSION, f"schema_version must be {VERSION}")
    _checked(contract, "adapter", otlp.ADAPTER)
    _checked(contract, "source_inventory", {k: v for k, v in traces.inventory.items() if k not in ("models", "tools")})
    how = mapping(contract.get("task_mapping"), "task_mapping")
    require(how.get("policy") == "one-export-trace-is-one-evaluation-task", "task_mapping.policy is not supported")
    text_of(how.get("approved_by"), "task_mapping.approved_by")
    tasks = traces.tasks.orderBy("task_id").collect()
    outcomes, manifest = labelled_tasks(contract, {r["task_id"]: (None, r["started_at"]) for r in tasks})
    named = {r["task_id"]: r for r in contract["tasks"]}
    require(all(named[r["task_id"]].get("trace_id_sha256") == r["input_digest"] for r in tasks), "a task's trace_id_sha256 does not match the source")
    pricing = mapping(contract.get("pricing"), "pricing")
    text_of(pricing.get("price_card_id"), "price_card_id")
    models, tools = mapping(pricing.get("models"), "pricing.models"), mapping(pricing.get("tools"), "pricing.tools")
    require(set(models) == set(traces.inventory["models"]), "priced models are not those observed")
    require(set(tools) == set(traces.inventory["tools"]), "priced tools are not those observed")
    card = {m: {k: amount(mapping(r, m).get(k), f"{m} {k}") for k in ("input_per_million_usd", "output_per_million_usd")} for m, r in models.items()}
    tool_rates = spark.createDataFrame([(k, amount(v, f"tool {k}")) for k, v in tools.items()], "tool string, tool_cost double")
    events = traces.events.join(tool_rates, (F.col("event_type") == "tool") & (F.col("name") == F.col("tool")), "left")
    events = events.withColumn("direct_cost_usd", F.when(F.col("event_type") == "tool", F.col("tool_cost"))).withColumn("arguments", F.lit("{}")).select(*EVENTS.fieldNames())
    evidence = Evidence(
        events, spark.createDataFrame(outcomes, OUTCOMES), files.rate_rows(spark, card), files.baseline_of(contract.get("baseline")), files.policy_of(contract.get("policy")), spark.createDataFrame(manifest, MANIFEST), traces.edges, traces.source_id
    )
    if problems := validate.problems_of(evidence, label="conversion", strict=True):
        raise EvidenceError(problems)
    return evidence


def receipt(evidence: Evidence, contract: Mapping) -> dict:
    """What a written bundle says of its making; its digest is checked when the bundle is read."""
    from ..functions.shapes import sha256
    from ..plans.digest import evidence_digest

    return {"source_id": evidence.source_id, "source_version": evidence.source_version, "evidence_digest": evidence_digest(evidence), "contract_sha256": sha256(canonical_json(dict(contract))), "source_inventory": contract.get("source_inventory"), "price_card_id": mapping(contract.get("pricing"), "pricing").get("price_card_id")}
