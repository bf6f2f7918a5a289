"""Judged outputs: task files, rubrics, evaluation sets, and a judge that is a function given from outside."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels
from ..schemas import EvidenceError
from .files import read_object

ECONOMICS = ("business_value_usd", "failure_human_minutes", "failure_remediation_cost_usd", "failure_incident_loss_usd")
#: scores by criterion for (output, context); raises if it cannot judge.
Judge = Callable[[str, str], dict[str, float]]


class Rejected(Exception):
    """A request that no retry mends, such as one with a wrong key: it ends the run, because it says nothing of a task."""


class Busy(Exception):
    """A request that may succeed later."""


@dataclass(frozen=True)
class Patience:
    """How often a request is tried, how long the pauses grow, and how many tasks a second one judge takes."""

    attempts: int = 3
    pause_s: float = 1.0
    per_second: float = 5.0

    def call(self, request: Callable[[], dict[str, float]], sleep: Callable[[float], None] = time.sleep) -> dict[str, float]:
        """The answer of the first attempt that gives one; the last failure if none does. ``Rejected`` isn't tried again."""
        for attempt in range(self.attempts):
            try:
                return request()
            except (Busy, TimeoutError, ConnectionError):
                if attempt == self.attempts - 1:
                    raise
                sleep(self.pause_s * 2**attempt)
        raise ValueError("a request needs one attempt at least")


@dataclass(frozen=True)
class Rubric:
    rubric_id: str
    threshold: float
    weights: dict[str, float]
    economics: dict[str, float]


def rubric_of(raw: dict) -> Rubric:
    """A rubric whose weights add up to 1."""
    criteria = raw.get("criteria")
    if not isinstance(criteria, list) or not criteria or any(not isinstance(c, dict) or not {"id", "question", "weight"} <= set(c) for c in criteria):
        raise EvidenceError("a rubric needs criteria with id, question and weight")
    weights = {c["id"]: float(c["weight"]) for c in criteria}
    if len(weights) != len(criteria) or not 0.999 < sum(weights.values()) < 1.001:
        raise EvidenceError("criteria must differ and their weights add up to 1")
    if missing := [k for k in ("rubric_id", "acceptable_threshold") if k not in raw]:
        raise EvidenceError(f"the rubric has no {', '.join(missing)}")
    return Rubric(raw["rubric_id"], float(raw["acceptable_threshold"]), weights, {k: float(raw.get(k, 0.0)) for k in ECONOMICS})


def read_rubric(spark: SparkSession, path: str) -> Rubric:
    return rubric_of(read_object(spark, path, "rubric"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, output, context), trimmed; an empty file is refused."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    context = F.coalesce(F.trim("context"), F.lit("")) if "context" in raw.columns else F.lit("")
    tasks = raw.select(F.trim("task_id").alias("task_id"), F.trim("output").alias("output"), context.alias("context"))
    if tasks.isEmpty():
        raise EvidenceError("the task file is empty")
    return tasks


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, category, expected, context, output) of an evaluation set's cases."""
    case = "struct<task_id:string,category:string,expected_acceptable:boolean,context:string,output:string>"
    raw = spark.read.schema(f"cases array<{case}>").option("multiLine", True).json(path)
    return raw.select(F.explode("cases").alias("c")).select("c.task_id", "c.category", F.col("c.expected_acceptable").alias("expected"), "c.context", "c.output")


def selected_cases(cases: DataFrame, only: tuple[str, ...] = (), first: int | None = None) -> DataFrame:
    """Of an evaluation set the cases that are named, or its first so many by id; a name that isn't there is refused."""
    if only and (lost := sorted(set(only) - {r[0] for r in cases.where(F.col("task_id").isin(*only)).select("task_id").distinct().collect()})):
        raise EvidenceError(f"no such cases: {', '.join(lost)}")
    chosen = cases.where(F.col("task_id").isin(*only)) if only else cases
    if first is not None and first < 1:
        raise EvidenceError("the number of cases must be 1 or more")
    return chosen.orderBy("task_id").limit(first) if first else chosen


def judged(tasks: DataFrame, judge: Judge, fallback: Judge | None = None, patience: Patience = Patience(per_second=0)) -> DataFrame:
    """(task_id, criterion, score); a task that the judge and its fallback fail on has one row with a null criterion.

    Tasks are judged where their rows are, at most ``patience.per_second`` of them a second in each task of Spark (0 is
    no limit). A rejected request ends the run.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        begun = 0.0
        for batch in batches:
            rows = []
            for task, output, context in zip(batch["task_id"], batch["output"], batch["context"], strict=True):
                if patience.per_second:
                    time.sleep(max(0.0, begun + 1 / patience.per_second - time.monotonic()))
                    begun = time.monotonic()
                scores = None
                for one in (judge, fallback):
                    if one is None or scores is not None:
                        continue
                    try:
                        scores = [(task, k, float(v)) for k, v in patience.call(lambda one=one: one(output, context)).items()]
                    except Rejected:
                        raise
                    except Exception:
                        scores = None
                rows += scores if scores is not None else [(task, None, None)]
            yield pd.DataFrame(rows, columns=["task_id", "criterion", "score"])

    return tasks.mapInPandas(run, "task_id string, criterion string, score double")


def outcomes_of(tasks: DataFrame, rubric: Rubric, judge: Judge, **options) -> DataFrame:
    """Outcomes of judged tasks; a failed call is an unacceptable outcome without costs, marked ``judge_error``."""
    weights = tasks.sparkSession.createDataFrame(list(rubric.weights.items()), "criterion string, weight double")
    return labels.outcome_rows(labels.rubric_verdict(judged(tasks, judge, **options), weights, rubric.threshold), rubric.economics)


def write_outcomes(outcomes: DataFrame, folder: str) -> None:
    """The outcomes as CSV, and with their marks as JSON."""
    outcomes.drop("judge_error").write.option("header", True).csv(f"{folder}/outcomes")
    outcomes.write.json(f"{folder}/audit")


def word_judge(criteria: tuple[str, ...], wanted: tuple[str, ...]) -> Judge:
    """A deterministic stand-in: every criterion gets the share of wanted words that the output has."""

    def judge(output: str, context: str) -> dict[str, float]:
        if not output:
            raise ValueError("nothing to judge")
        found = set(output.lower().split())
        return dict.fromkeys(criteria, sum(w in found for w in wanted) / len(wanted))

    return judge
