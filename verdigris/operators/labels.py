"""Label quality: agreement of predictions with labels, and what label error does to unit costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion(cases: DataFrame, *keys: str, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Counts and rates per group. A null prediction is an error of the judge, not a rejection, and counts in no cell."""
    e, p = F.col(expected), F.col(predicted)
    known = p.isNotNull()
    counts = cases.groupBy(*keys).agg(
        F.count("*").alias("cases"),
        F.count_if(~known).alias("errors"),
        F.count_if(known & e & p).alias("tp"),
        F.count_if(known & ~e & p).alias("fp"),
        F.count_if(known & e & ~p).alias("fn"),
        F.count_if(known & ~e & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return counts.select(
        *keys, "cases", "errors", "tp", "fp", "fn", "tn",
        share(tp + tn, tp + fp + fn + tn).alias("agreement"),
        precision.alias("precision"),
        recall.alias("recall"),
        share(2 * precision * recall, precision + recall).alias("f1"),
        share(tn, tn + fp).alias("negative_recall"),
        share(fp, tn + fp).alias("false_accept_rate"),
    )


def disagreements(cases: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    return cases.where(F.col(predicted).isNull() | (F.col(expected) != F.col(predicted)))


def stability(runs: DataFrame, case: str = "task_id", verdict: str = "predicted", score: str = "score") -> DataFrame:
    """Per case over repeated runs: how many verdicts it got, and its least and largest score."""
    return runs.groupBy(case).agg(F.count_distinct(verdict).alias("verdicts"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def amplification(rate: Column, error: Column) -> tuple[Column, Column]:
    """(relative error of a cost per acceptable outcome, its first order) if a share ``error`` of all is wrongly rejected."""
    exact = F.when(rate > error, error / F.when(rate > error, rate - error)).otherwise(F.lit(float("inf")))
    return exact, error / rate


def flip_threshold(rate: Column, slack: Column) -> Column:
    """The largest share of wrong rejections that cannot flip a passing unit-cost gate with relative slack ``slack``."""
    return F.when(slack > 0, rate * slack / (1 + slack)).otherwise(F.lit(0.0))


def relabelled(tasks: DataFrame, judged: str = "judged", truth: str = "acceptable", cost: str = "effective_cost_usd", value: str = "business_value_usd") -> DataFrame:
    """Unit cost and net value under the true and under the judged labels, with false accepts and rejects."""
    t, j = F.col(truth), F.col(judged)
    total = F.sum(F.col(cost).cast("decimal(38,6)")).cast("double")

    def unit(label: Column) -> Column:
        return F.when(F.count_if(label) > 0, total / F.nullif(F.count_if(label), F.lit(0))).otherwise(F.lit(float("inf")))

    def net(label: Column) -> Column:
        return (F.coalesce(F.sum(F.when(label, F.col(value).cast("decimal(38,6)"))), F.lit(0)).cast("double") - total) / F.count("*")

    return tasks.agg(F.count_if(j & ~t).alias("false_accepts"), F.count_if(t & ~j).alias("false_rejects"), unit(t).alias("unit_cost"), unit(j).alias("judged_unit_cost"), net(t).alias("net_value"), net(j).alias("judged_net_value"))


def rubric_verdict(scores: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """(task_id, overall, acceptable) from (task_id, criterion, score) and (criterion, weight); a task without every criterion, or with others or scores outside 0 to 1, has a null verdict."""
    count = weights.agg(F.count("*").alias("_all"))
    joined = scores.join(weights, "criterion", "left")
    summed = joined.groupBy("task_id").agg(
        F.sum(F.col("score") * F.col("weight")).alias("overall"),
        F.count_distinct(F.when(F.col("weight").isNotNull(), F.col("criterion"))).alias("_n"),
        F.count_if(F.col("weight").isNull() | F.col("score").isNull() | ~F.col("score").between(0.0, 1.0)).alias("_bad"),
    )
    ok = (F.col("_bad") == 0) & (F.col("_n") == F.col("_all"))
    return summed.crossJoin(F.broadcast(count)).select("task_id", F.when(ok, F.col("overall")).alias("overall"), F.when(ok, F.col("overall") >= threshold).alias("acceptable"))  # the count is one row


def outcome_rows(verdicts: DataFrame, economics: dict[str, float]) -> DataFrame:
    """Outcomes from verdicts: an accepted task has its value, a rejected one the costs of a failure, one without a verdict neither, and ``judge_error`` true."""
    ok = F.col("acceptable")
    failure = {"human_minutes": "failure_human_minutes", "remediation_cost_usd": "failure_remediation_cost_usd", "incident_loss_usd": "failure_incident_loss_usd"}
    return verdicts.select(
        "task_id",
        F.coalesce(ok, F.lit(False)).alias("acceptable"),
        F.when(ok, F.lit(float(economics["business_value_usd"]))).otherwise(F.lit(0.0)).alias("business_value_usd"),
        *[F.when(~ok, F.lit(float(economics[v]))).otherwise(F.lit(0.0)).alias(k) for k, v in failure.items()],
        ok.isNull().alias("judge_error"),
    )
