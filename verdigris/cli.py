"""Command line: evaluate, frontier, template, convert, judge, analyse, ci, propositions, capabilities. Exit 0 SCALE or ADOPT, 3 ASSIST or HOLD, 4 STOP (with --ci), 2 INCOMPLETE."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import ci, report, ship
from .operators.gates import DEFAULT_CHECKS
from .plans import propositions
from .plans.assurance import evaluate
from .plans.frontier import FrontierDecision, evaluate_frontier
from .schemas import Decision, EvidenceError
from .sources import contracts, files, frontier_files, judge, otlp, session_tree, sessions

EXITS = {Decision.SCALE: 0, Decision.ASSIST: 3, Decision.STOP: 4, Decision.INCOMPLETE: 2}
KINDS = ("session", "session-tree", "otlp")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="verdigris", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    e = verbs.add_parser("evaluate", help="one arm's verdict")
    e.add_argument("--bundle")
    for name in ("traces", "outcomes", "rates", "baseline", "policy"):
        e.add_argument(f"--{name}")
    e.add_argument("--format", choices=("markdown", "json"), default="markdown")
    e.add_argument("--ci", action="store_true", help="exit by the decision")
    f = verbs.add_parser("frontier", help="several arms on the same tasks")
    f.add_argument("plan")
    f.add_argument("--out", required=True)
    f.add_argument("--verify", help="a folder whose files the written ones must equal")
    f.add_argument("--svg", action="store_true")
    for verb in ("template", "convert"):
        c = verbs.add_parser(verb)
        c.add_argument("kind", choices=KINDS)
        c.add_argument("source")
        c.add_argument("--out", required=True)
        if verb == "convert":
            c.add_argument("--contract", required=True)
    j = verbs.add_parser("judge", help="outcomes of a task file by a judge given as module:function")
    j.add_argument("tasks")
    j.add_argument("--rubric", required=True)
    j.add_argument("--judge", required=True, help="module:function that takes (output, context) and returns scores by criterion")
    j.add_argument("--out", required=True)
    n = verbs.add_parser("analyse", help="what an analyst is told of a bundle's case")
    n.add_argument("bundle")
    k = verbs.add_parser("ci", help="a run whose inputs are variables INPUT_..., for workflows")
    k.add_argument("--report", required=True)
    k.add_argument("--outputs")
    verbs.add_parser("propositions", help="what label error does to metrics")
    verbs.add_parser("capabilities")
    return top


def _inspect(spark: SparkSession, kind: str, source: str):
    return otlp.inspect(spark, source) if kind == "otlp" else (session_tree.read_tree if kind == "session-tree" else sessions.read_session)(source)


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    parts = {f"{n}_path": getattr(a, n) for n in ("traces", "outcomes", "rates", "baseline", "policy")}
    if bool(a.bundle) == any(parts.values()) or not a.bundle and not all(parts.values()):
        raise EvidenceError("give either --bundle or all five files")
    case = evaluate(files.json_bundle(spark, a.bundle) if a.bundle else files.csv_bundle(spark, **parts))
    print(report.case_markdown(case) if a.format == "markdown" else report.case_json(case), end="")
    return EXITS[case.decision] if a.ci else 0


def _frontier(spark: SparkSession, a: argparse.Namespace) -> int:
    out = Path(a.out)
    if a.verify and out.resolve() == Path(a.verify).resolve():
        raise EvidenceError("--out and --verify must differ")
    case = evaluate_frontier(*frontier_files.read_experiment(spark, a.plan))
    out.mkdir(parents=True, exist_ok=True)
    texts = {"frontier.md": report.frontier_markdown(case), "frontier.json": report.frontier_json(case)} | ({"frontier.svg": report.frontier_svg(case)} if a.svg else {})
    for name, text in texts.items():
        (out / name).write_text(text)
    if a.verify and any((Path(a.verify) / n).read_text() != t for n, t in texts.items()):
        raise EvidenceError("the written files differ from those to verify against")
    print(f"{case.decision}{f' {case.selected_arm}' if case.selected_arm else ''}")
    return {FrontierDecision.ADOPT: 0, FrontierDecision.HOLD: 3, FrontierDecision.INCOMPLETE: 2}[case.decision]


def _convert(spark: SparkSession, a: argparse.Namespace) -> int:
    if Path(a.out).resolve() in {Path(p).resolve() for p in (a.source, getattr(a, "contract", None)) if p}:
        raise EvidenceError("the output would replace an input")
    found = _inspect(spark, a.kind, a.source)
    if a.verb == "template":
        made = (contracts.trace_template if a.kind == "otlp" else contracts.session_template)(found)
        Path(a.out).write_text(json.dumps(made, indent=2, sort_keys=True) + "\n")
        return 0
    contract = files.read_object(spark, a.contract, "contract")
    evidence = (contracts.trace_evidence if a.kind == "otlp" else contracts.session_evidence)(spark, found, contract)
    files.write_bundle(evidence.with_(conversion=contracts.receipt(evidence, contract)), a.out, inputs=(a.source, a.contract))
    return 0


def _judge(spark: SparkSession, a: argparse.Namespace) -> int:
    module, _, name = a.judge.partition(":")
    found = getattr(importlib.import_module(module), name, None)
    if not callable(found):
        raise EvidenceError(f"{a.judge} is not a function")
    outcomes = judge.outcomes_of(judge.read_tasks(spark, a.tasks), judge.read_rubric(spark, a.rubric), found).persist()
    judge.write_outcomes(outcomes, a.out)
    counts = outcomes.agg(F.count("*"), F.count_if("acceptable"), F.count_if("judge_error")).first()
    outcomes.unpersist()
    print(f"{counts[0]} tasks, {counts[1]} acceptable, {counts[2]} not judged")
    return 0


def _analyse(spark: SparkSession, a: argparse.Namespace) -> int:
    print(report.analyst_context(evaluate(files.json_bundle(spark, a.bundle))), end="")
    return 0


def _ci(spark: SparkSession, a: argparse.Namespace) -> int:
    result = ci.run(spark, ci.Inputs.of(os.environ), a.report)
    if a.outputs:
        ci.write_outputs(result, a.outputs)
    print(result.decision)
    return result.exit_code


def _propositions(spark: SparkSession, a: argparse.Namespace) -> int:
    found = propositions.label_report(spark)
    print(found.text(), end="")
    return 0 if found.holds else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "capabilities":
        print(json.dumps({"sources": ["csv", "json", "tables", *KINDS], "checks": [c.manifest_id for c in DEFAULT_CHECKS], "renderers": ["markdown", "json", "svg"]}, indent=2))
        return 0
    spark = ship(spark or SparkSession.builder.appName("verdigris").getOrCreate())
    try:
        return {"evaluate": _evaluate, "frontier": _frontier, "judge": _judge, "analyse": _analyse, "ci": _ci, "propositions": _propositions}.get(a.verb, _convert)(spark, a)
    except (EvidenceError, OSError) as error:
        print(f"INCOMPLETE: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
