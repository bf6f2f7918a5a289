"""A run for continuous integration: one of three kinds of input, a report that is always written, and outputs as a file of key and value."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession

from . import report
from .plans.assurance import evaluate
from .schemas import Decision, Evidence, EvidenceError
from .sources import contracts, files, otlp, session_tree, sessions

EXITS = {Decision.SCALE: 0, Decision.ASSIST: 3, Decision.STOP: 4, Decision.INCOMPLETE: 2}
#: How a recorded source is read, and how a contract makes evidence of it.
ADAPTERS: dict[str, tuple[Callable, Callable]] = {
    "session": (lambda spark, path: sessions.read_session(path), contracts.session_evidence),
    "session-tree": (lambda spark, path: session_tree.read_tree(path), contracts.session_evidence),
    "otlp": (otlp.inspect, contracts.trace_evidence),
}


@dataclass(frozen=True)
class Inputs:
    """What a workflow passes on; an input that isn't given is empty."""

    bundle: str = ""
    traces: str = ""
    outcomes: str = ""
    rates: str = ""
    baseline: str = ""
    policy: str = ""
    adapter: str = ""
    source: str = ""
    contract: str = ""

    @classmethod
    def of(cls, environment: Mapping[str, str], prefix: str = "INPUT_") -> "Inputs":
        """From a workflow's environment, in which every input is a variable of its own."""
        return cls(**{f.name: environment.get(f"{prefix}{f.name.upper()}", "").strip() for f in fields(cls)})


#: The three kinds of input; all of one kind must be given, and nothing of another.
MODES = {"bundle": ("bundle",), "csv": ("traces", "outcomes", "rates", "baseline", "policy"), "adapter": ("adapter", "source", "contract")}


def mode_of(inputs: Inputs) -> str:
    given = {mode: [n for n in names if getattr(inputs, n)] for mode, names in MODES.items()}
    begun = [mode for mode, names in given.items() if names]
    if len(begun) != 1:
        raise EvidenceError(f"give exactly one kind of input ({', '.join(MODES)}), not {', '.join(begun) or 'none'}")
    mode = begun[0]
    if lacking := [n for n in MODES[mode] if n not in given[mode]]:
        raise EvidenceError(f"{mode} input lacks {', '.join(lacking)}")
    if mode == "adapter" and inputs.adapter not in ADAPTERS:
        raise EvidenceError(f"unknown adapter {inputs.adapter!r}; known are {', '.join(ADAPTERS)}")
    return mode


def evidence_of(spark: SparkSession, inputs: Inputs) -> Evidence:
    match mode_of(inputs):
        case "bundle":
            return files.json_bundle(spark, inputs.bundle)
        case "csv":
            return files.csv_bundle(spark, **{f"{n}_path": getattr(inputs, n) for n in MODES["csv"]})
        case _:
            read, convert = ADAPTERS[inputs.adapter]
            return convert(spark, read(spark, inputs.source), files.read_object(spark, inputs.contract, "contract"))


@dataclass(frozen=True)
class Result:
    decision: str
    exit_code: int
    report: Path
    problems: tuple[str, ...] = ()


def refusal(problems: tuple[str, ...]) -> str:
    """The report of a run that could not judge, with every reason."""
    reasons = "".join(f"- {p}\n" for p in problems) or "- no reason was given\n"
    return f"# Assurance case\n\n**Decision: INCOMPLETE**\n\nNothing was evaluated, because the evidence is not complete or not sound.\n\n## Reasons\n\n{reasons}"


def run(spark: SparkSession, inputs: Inputs, report_path: str | Path) -> Result:
    """Evaluates the inputs; the report is written whatever happens, and what can't be judged exits as INCOMPLETE."""
    path = Path(report_path)
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        case = evaluate(evidence_of(spark, inputs))
    except (EvidenceError, OSError) as error:
        problems = error.problems if isinstance(error, EvidenceError) else (str(error),)
        path.write_text(refusal(problems), encoding="utf-8")
        return Result(str(Decision.INCOMPLETE), EXITS[Decision.INCOMPLETE], path, problems)
    path.write_text(report.case_markdown(case), encoding="utf-8")
    return Result(str(case.decision), EXITS[case.decision], path)


def write_outputs(result: Result, path: str | Path) -> None:
    """Appends decision, exit-code and report in the form for values of several lines: a name, a mark that no value holds, the value, the mark."""
    with open(path, "a", encoding="utf-8") as f:
        for key, value in {"decision": result.decision, "exit-code": str(result.exit_code), "report": str(result.report)}.items():
            mark = "END"
            while mark in value:
                mark = f"{mark}_"
            f.write(f"{key}<<{mark}\n{value}\n{mark}\n")


__all__ = ["ADAPTERS", "EXITS", "Inputs", "MODES", "Result", "evidence_of", "mode_of", "refusal", "run", "write_outputs"]
