"""Digests of evidence, of the decision contract, and of files."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import canonical_json, sha256, strict_json
from ..operators.gates import Check, fingerprint
from ..schemas import EDGES, EVENTS, MANIFEST, OUTCOMES, Coverage, Evidence

SCHEMA = "verdigris.decision-contract@1"


def _canonical_rows(table: DataFrame, schema, order: list[str]) -> Iterable[str]:
    """Rows as canonical JSON, in order; the text is made on the executors and streamed to the driver."""
    names = schema.fieldNames()

    def text(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                row = {k: None if v is None or v is pd.NaT or v != v else v for k, v in record.items() if k in names}
                for k, v in row.items():
                    if k.endswith("_tokens"):
                        row[k] = int(v)
                    elif k == "arguments":
                        row[k] = strict_json(v or "{}")
                rows.append(canonical_json(row))
            yield pd.DataFrame({**{f"o{i}": batch[c] for i, c in enumerate(order)}, "row": rows})

    fields = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    typed = ", ".join(f"o{i} {fields[c]}" for i, c in enumerate(order))
    laid = table.select(*names).mapInPandas(text, f"{typed}, row string").orderBy(*[f"o{i}" for i in range(len(order))])
    return (r["row"] for r in laid.select("row").toLocalIterator())


def evidence_digest(evidence: Evidence) -> str:
    """SHA-256 of the canonical JSON of all rows, in order; the source's name is no part of it, an empty manifest or edge list isn't either.

    Rows pass through the driver one by one, so the memory it takes doesn't grow with the evidence.
    """
    import hashlib

    out = hashlib.sha256()

    def put(text: str) -> None:
        out.update(text.encode())

    def rows(items: Iterable[str]) -> int:
        n = 0
        for item in items:
            put(("," if n else "") + item)
            n += 1
        return n

    put('{"baseline":' + canonical_json(asdict(evidence.baseline)))
    edges = None if evidence.edges is None or evidence.edges.isEmpty() else evidence.edges
    if edges is not None:
        put(',"dependency_edges":[')
        pairs = edges.select(*EDGES.fieldNames()).orderBy(*EDGES.fieldNames())
        rows(json.dumps([r[0], r[1]], separators=(",", ":"), ensure_ascii=False) for r in pairs.toLocalIterator())
        put("]")
    put(',"events":[')
    rows(_canonical_rows(evidence.events, EVENTS, ["task_id", "timestamp", "event_id"]))
    put('],"outcomes":[')
    rows(_canonical_rows(evidence.outcomes, OUTCOMES, ["task_id"]))
    card = {r["model"]: {k: r[k] for k in ("input_per_million_usd", "output_per_million_usd")} for r in evidence.rates.toLocalIterator()}
    put('],"policy":' + canonical_json(asdict(evidence.policy)) + ',"rates":' + canonical_json(card))
    if evidence.manifest is not None and not evidence.manifest.isEmpty():
        put(',"task_manifest":[')
        rows(_canonical_rows(evidence.manifest, MANIFEST, ["task_id"]))
        put("]")
    put("}")
    return out.hexdigest()


def contract_manifest(checks: tuple[Check, ...], required: frozenset[Coverage]) -> dict:
    """What decides: the checks in order with their code's fingerprints, and the coverage that is required."""
    return {
        "schema": SCHEMA,
        "routing": "missing coverage > STOP > ASSIST > SCALE",
        "required_coverage": sorted(map(str, required)),
        "checks": [{"id": c.manifest_id, "mode": str(c.mode), "covers": sorted(map(str, c.covers)), "route": None if c.route is None else str(c.route), "implementation": fingerprint(c.run)} for c in checks],
    }


def contract_digest(checks: tuple[Check, ...], required: frozenset[Coverage]) -> str:
    return sha256(canonical_json(contract_manifest(checks, required)))


def manifest_digest(manifest: DataFrame) -> str:
    """SHA-256 over the sorted task manifest."""
    rows = [r.asDict() for r in manifest.select(*MANIFEST.fieldNames()).orderBy("task_id").toLocalIterator()]
    return sha256(canonical_json({"tasks": rows}))


def file_digests(spark, path: str) -> DataFrame:
    """(path, sha256) of the bytes of every file under a path or glob."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
