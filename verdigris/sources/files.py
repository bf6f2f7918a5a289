"""Evidence from files: five CSV and JSON files, or one normalised JSON bundle; and bundles back to JSON."""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import canonical_json, strict_json
from ..schemas import EDGES, EVENTS, MANIFEST, OUTCOMES, RATES, Baseline, Evidence, EvidenceError, Policy


def read_whole(spark: SparkSession, path: str) -> str:
    """The text of a small file of any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise EvidenceError(f"{path} is not one file")
    return rows[0][0]


def read_object(spark: SparkSession, path: str, label: str) -> dict:
    try:
        value = strict_json(read_whole(spark, path), label)
    except ValueError as error:
        raise EvidenceError(str(error)) from error
    if not isinstance(value, dict):
        raise EvidenceError(f"{label} must be an object")
    return value


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Events of a CSV with a header: blank tokens are 0, a blank cost is unknown, blank arguments are an empty object."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(", ".join(f"`{n}` string" for n in EVENTS.fieldNames())).csv(path)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("task_id", "event_id", "timestamp", "event_type", "name", "model")]
    tokens = [F.coalesce(blank(c), F.lit("0")).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens")]
    arguments = F.coalesce(blank("arguments"), F.lit("{}"))
    checked = F.when(F.try_parse_json(arguments).isNotNull(), arguments).otherwise(F.raise_error(F.concat(F.lit("arguments of event "), F.col("event_id"), F.lit(" are not JSON"))))
    return raw.select(*text, *tokens, blank("direct_cost_usd").cast("double").alias("direct_cost_usd"), F.coalesce(blank("status"), F.lit("ok")).alias("status"), checked.alias("arguments"))


def truth(text: Column) -> Column:
    """true, yes, 1 or false, no, 0 in any case; anything else is an error."""
    value = F.lower(F.trim(text))
    return F.when(value.isin("1", "true", "yes"), True).when(value.isin("0", "false", "no"), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).schema(", ".join(f"`{n}` string" for n in OUTCOMES.fieldNames())).csv(path)
    number = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("0")).cast("double").alias(c)
    return raw.select("task_id", truth(F.col("acceptable")).alias("acceptable"), *[number(c) for c in OUTCOMES.fieldNames()[2:]])


def rate_rows(spark: SparkSession, card: dict[str, Any]) -> DataFrame:
    try:
        rows = [(m, float(r["input_per_million_usd"]), float(r["output_per_million_usd"])) for m, r in sorted(card.items())]
    except (KeyError, TypeError, ValueError) as error:
        raise EvidenceError(f"a rate is not complete: {error}") from error
    return spark.createDataFrame(rows, RATES)


def _config(kind: type, raw: Any, label: str):
    if not isinstance(raw, dict):
        raise EvidenceError(f"{label} must be an object")
    try:
        return kind(**raw)
    except TypeError as error:
        raise EvidenceError(f"{label}: {error}") from error


def baseline_of(raw: Any) -> Baseline:
    return _config(Baseline, raw, "baseline")


def policy_of(raw: Any) -> Policy:
    return _config(Policy, raw, "policy")


def csv_bundle(spark: SparkSession, *, traces_path: str, outcomes_path: str, rates_path: str, baseline_path: str, policy_path: str) -> Evidence:
    return Evidence(
        traces(spark, traces_path), outcomes(spark, outcomes_path), rate_rows(spark, read_object(spark, rates_path, "rates")), baseline_of(read_object(spark, baseline_path, "baseline")), policy_of(read_object(spark, policy_path, "policy")), source_id="source.csv"
    )


def _rows(raw: dict, name: str, schema, required: tuple[str, ...], defaults: dict[str, Any], renames: dict[str, str] | None = None) -> list[tuple]:
    """Objects as rows; a field that isn't known, or is required and missing, is refused."""
    found = raw.get(name, [])
    if not isinstance(found, list):
        raise EvidenceError(f"{name} must be a list")
    out, problems = [], []
    for i, item in enumerate(found):
        if not isinstance(item, dict) or set(item) - set(schema.fieldNames()) or set(required) - set(item):
            problems.append(f"{name}[{i}] must be an object with {sorted(required)} and no unknown field")
            continue
        row = []
        for field in schema.fields:
            value = item.get(field.name, defaults.get(field.name))
            if field.name == "arguments":
                value = canonical_json(value)
            elif value is not None:
                kind = field.dataType.typeName()
                fits = isinstance(value, bool) if kind == "boolean" else isinstance(value, str) if kind == "string" else isinstance(value, int) and not isinstance(value, bool) if kind == "long" else isinstance(value, (int, float)) and not isinstance(value, bool)
                if not fits:
                    problems.append(f"{name}[{i}].{field.name} must be a {kind}")
                    value = None
                elif kind == "double":
                    value = float(value)
            row.append(value)
        out.append(tuple(row))
    if problems:
        raise EvidenceError(problems)
    return out


def bundle_of(spark: SparkSession, raw: dict) -> Evidence:
    """A normalised bundle. Large ones should come as tables; this form holds one bundle in the driver."""
    text = {k: "" for k in ("model",)} | {"input_tokens": 0, "output_tokens": 0, "status": "ok", "arguments": {}}
    events = _rows(raw, "events", EVENTS, ("task_id", "event_id", "timestamp", "event_type", "name"), text)
    labelled = _rows(raw, "outcomes", OUTCOMES, ("task_id", "acceptable"), dict.fromkeys(OUTCOMES.fieldNames()[2:], 0.0))
    listed = _rows(raw, "task_manifest", MANIFEST, tuple(MANIFEST.fieldNames()), {})
    edges = raw.get("dependency_edges", [])
    if not isinstance(edges, list) or not all(isinstance(e, list) and len(e) == 2 and all(isinstance(x, str) for x in e) for e in edges):
        raise EvidenceError("dependency_edges must be pairs of event ids")
    missing = [k for k in ("events", "outcomes", "rates", "baseline", "policy") if k not in raw]
    if missing:
        raise EvidenceError([f"the bundle has no {k}" for k in missing])
    conversion = raw.get("conversion") or {}
    evidence = Evidence(
        spark.createDataFrame(events, EVENTS),
        spark.createDataFrame(labelled, OUTCOMES),
        rate_rows(spark, raw["rates"]),
        baseline_of(raw["baseline"]),
        policy_of(raw["policy"]),
        manifest=spark.createDataFrame(listed, MANIFEST) if listed else None,
        edges=spark.createDataFrame([tuple(e) for e in edges], EDGES) if edges else None,
        source_id=conversion.get("source_id", "source.normalized-json"),
        source_version=str(conversion.get("source_version", "1")),
        conversion=conversion or None,
    )
    if conversion.get("evidence_digest"):
        from ..plans.digest import evidence_digest

        if evidence_digest(evidence) != conversion["evidence_digest"]:
            raise EvidenceError("the evidence digest of the conversion receipt does not match the bundle")
    return evidence


def json_bundle(spark: SparkSession, path: str) -> Evidence:
    return bundle_of(spark, read_object(spark, path, "bundle"))


def document(evidence: Evidence) -> dict:
    """The bundle as plain values, for one that fits in the driver."""

    def rows(table: DataFrame, order: list[str]) -> list[dict]:
        return [r.asDict() for r in table.orderBy(*order).toLocalIterator()]

    out: dict[str, Any] = {
        "events": [r | {"arguments": json.loads(r["arguments"] or "{}")} for r in rows(evidence.events.select(*EVENTS.fieldNames()), ["task_id", "timestamp", "event_id"])],
        "outcomes": rows(evidence.outcomes.select(*OUTCOMES.fieldNames()), ["task_id"]),
        "rates": {r["model"]: {k: r[k] for k in RATES.fieldNames()[1:]} for r in rows(evidence.rates, ["model"])},
        "baseline": asdict(evidence.baseline),
        "policy": asdict(evidence.policy),
    }
    if evidence.manifest is not None:
        out["task_manifest"] = rows(evidence.manifest.select(*MANIFEST.fieldNames()), ["task_id"])
    if evidence.edges is not None:
        out["dependency_edges"] = [list(r.values()) for r in rows(evidence.edges.select(*EDGES.fieldNames()), EDGES.fieldNames())]
    if evidence.conversion:
        out["conversion"] = evidence.conversion
    return out


def write_bundle(evidence: Evidence, path: str, *, inputs: tuple[str, ...] = ()) -> None:
    """Sorted, indented JSON; refuses to replace a file that was read."""
    target = Path(path).resolve()
    if any(target == Path(p).resolve() for p in inputs):
        raise EvidenceError("the output would replace an input")
    target.write_text(json.dumps(document(evidence), sort_keys=True, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def write_tables(evidence: Evidence, folder: str) -> None:
    """The frames as Parquet: the form for evidence of any size."""
    for name in ("events", "outcomes", "rates", "manifest", "edges"):
        table = getattr(evidence, name)
        if table is not None:
            table.write.parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, baseline: Baseline, policy: Policy, optional: tuple[str, ...] = ()) -> Evidence:
    """What ``write_tables`` wrote; ``optional`` names which of manifest and edges are there."""
    table = lambda n: spark.read.parquet(f"{folder}/{n}")
    return Evidence(table("events"), table("outcomes"), table("rates"), baseline, policy, *[table(n) if n in optional else None for n in ("manifest", "edges")], source_id="source.tables")
