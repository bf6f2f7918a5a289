"""Public agent runs: one row per task and model, with how many calls a run made and what it cost in all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EvidenceError

RUN = "struct<model:string,resolved:boolean,scores_resolved:int,api_calls:bigint,instance_cost_usd:double,exit_status:string,source_path:string,source_sha256:string,trajectory_format:string>"


def read_runs(spark: SparkSession, path: str, tasks: int | None = None, schema_version: str | None = None) -> DataFrame:
    """(task_id, arm, run fields) from a file of paired runs; ids must be unique and sorted, and as many as ``tasks`` if given."""
    raw = spark.read.schema(f"schema_version string, tasks array<struct<task_id:string,runs:map<string,{RUN}>>>").option("multiLine", True).json(path)
    if schema_version is not None and not raw.where(~F.col("schema_version").eqNullSafe(schema_version)).isEmpty():
        raise EvidenceError(f"runs are not of schema {schema_version!r}")
    ids = raw.select(F.col("tasks.task_id").alias("ids"), F.array_sort(F.array_distinct("tasks.task_id")).alias("sorted"))
    if not ids.where(~F.col("ids").eqNullSafe(F.col("sorted"))).isEmpty():
        raise EvidenceError("task ids must be unique and sorted")
    if tasks is not None and not ids.where(F.size("ids") != tasks).isEmpty():
        raise EvidenceError(f"the file must hold exactly {tasks} tasks")
    return raw.select(F.explode("tasks").alias("t")).select("t.task_id", F.explode("t.runs").alias("arm", "r")).select("task_id", "arm", "r.*")


def run_problems(runs: DataFrame) -> DataFrame:
    """Runs whose parts contradict each other: (task_id, arm, message)."""
    problem = (
        F.when(F.col("resolved").isNull() | (F.col("resolved").cast("int") != F.coalesce("scores_resolved", F.col("resolved").cast("int"))), "resolved differs from the scores")
        .when(~F.coalesce(F.col("instance_cost_usd") > 0, F.lit(False)), "cost must be positive")
        .when(~F.coalesce(F.col("api_calls") > 0, F.lit(False)), "a run makes one call at least")
    )
    return runs.withColumn("message", problem).where("message is not null").select("task_id", "arm", "message")


def call_events(runs: DataFrame) -> DataFrame:
    """One event per call: markers without cost, and the run's cost on its last call."""
    calls = runs.withColumn("call", F.explode(F.sequence(F.lit(1).cast("long"), F.col("api_calls").cast("long"))))
    return calls.withColumn("direct_cost_usd", F.when(F.col("call") == F.col("api_calls"), F.col("instance_cost_usd")).otherwise(F.lit(0.0)))


def reference_policy(runs: DataFrame, *keys: str) -> DataFrame:
    """What a reference arm's runs make of a baseline and a policy: mean cost, share resolved, 95th percentile and maximum of the cost."""
    cost = F.col("instance_cost_usd")
    return runs.groupBy(*keys).agg(
        (F.sum(cost.cast("decimal(28,6)")).cast("double") / F.count("*")).alias("cost_per_attempt_usd"),
        (F.count_if("resolved") / F.count("*")).alias("acceptable_rate"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY instance_cost_usd)").alias("p95_cost_usd"),
        F.max(cost).alias("max_cost_usd"),
    )


def systematic(ids: list[str], stride: int) -> list[str]:
    """Every ``stride``-th of the sorted ids: a sample that no outcome has a part in."""
    return sorted(ids)[::stride]
