"""What label error does to metrics: four propositions checked on many random or exhaustive workloads at once, and the table that follows.

Every trial is a row or a group of rows, so that the checks are aggregations; nothing loops over trials.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels
from . import experiments

#: The rates and slacks of the tables, and the agreement that labels are commonly held to reach.
RATES, ERRORS, SLACKS = (0.9, 0.5, 0.2, 0.1), (0.01, 0.05), (0.05, 0.10, 0.25)
ACCEPT_RATES, COMMON_AGREEMENT = (0.9, 0.7, 0.5, 0.3, 0.2), 0.85
FLIP_SIZES, FLIP_SLACKS = (20, 50, 100, 200), (0.02, 0.05, 0.1, 0.25, 0.5, 1.0)


def _uniform(name: str, *keys: str) -> Column:
    """A number in [0, 1) that the keys and the name determine."""
    return F.pmod(F.xxhash64(F.lit(name), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def workloads(spark: SparkSession, trials: int = 4000, seed: int = 11, flip: float = 0.3) -> DataFrame:
    """(trial, task, truth, judged, cost, value): workloads of 4 to 40 tasks, the first so many of them acceptable, labels flipped at random."""
    sized = spark.range(trials).select(F.col("id").alias("trial"), F.lit(seed).alias("seed")).withColumn("n", (4 + F.floor(_uniform("n", "trial", "seed") * 37)).cast("int"))
    sized = sized.withColumn("a", (1 + F.floor(_uniform("a", "trial", "seed") * F.col("n"))).cast("int"))
    tasks = sized.withColumn("task", F.explode(F.sequence(F.lit(1), F.col("n"))))
    truth = F.col("task") <= F.col("a")
    judged = F.when(_uniform("flip", "trial", "seed", "task") < flip, ~truth).otherwise(truth)
    return tasks.select("trial", "task", truth.alias("truth"), judged.alias("judged"), F.round(0.01 + _uniform("cost", "trial", "seed", "task") * 4.99, 4).alias("cost"), F.round(_uniform("value", "trial", "seed", "task") * 20, 4).alias("value"))


def summed(tasks: DataFrame) -> DataFrame:
    """Per trial: what labels make of the unit cost and the net value."""
    t, j = F.col("truth"), F.col("judged")
    out = tasks.groupBy("trial").agg(
        F.count("*").alias("n"), F.count_if(t).alias("a"), F.count_if(j).alias("judged_a"), F.count_if(j & ~t).alias("fp"), F.count_if(t & ~j).alias("fn"),
        F.sum("cost").alias("cost"), F.sum(F.when(t, F.col("value")).otherwise(0.0)).alias("value"), F.sum(F.when(j, F.col("value")).otherwise(0.0)).alias("judged_value"), F.max("value").alias("v_max"),
    )
    return out.withColumn("net", (F.col("value") - F.col("cost")) / F.col("n")).withColumn("judged_net", (F.col("judged_value") - F.col("cost")) / F.col("n"))


def ratio_distortion(trials: DataFrame) -> DataFrame:
    """One row, ``worst``: proposition 1 says that a unit cost is distorted by a / (a + fp - fn), whatever the costs are."""
    some = trials.where("judged_a > 0")
    predicted = F.col("a") / (F.col("a") + F.col("fp") - F.col("fn"))
    observed = (F.col("cost") / F.col("judged_a")) / (F.col("cost") / F.col("a"))
    return some.agg(F.coalesce(F.max(F.abs(predicted - observed)), F.lit(0.0)).alias("worst"))


def difference_bound(trials: DataFrame) -> DataFrame:
    """One row, ``broken``: proposition 3 says that a net value per attempt moves by v_max * error rate at most."""
    bound = F.col("v_max") * (F.col("fp") + F.col("fn")) / F.col("n")
    return trials.agg(F.count_if(F.abs(F.col("judged_net") - F.col("net")) > bound + 1e-9).alias("broken"))


def amplification_table(spark: SparkSession) -> DataFrame:
    """(rate, error, exact, first_order): proposition 2."""
    grid = experiments.values(spark, "rate", RATES).crossJoin(experiments.values(spark, "error", ERRORS))  # 8 fixed rows
    exact, first = labels.amplification(F.col("rate"), F.col("error"))
    return grid.select("rate", "error", exact.alias("exact"), first.alias("first_order"))


def flip_gap(spark: SparkSession) -> DataFrame:
    """One row, ``excess``: proposition 4 says that a gate flips beyond rate * slack / (1 + slack); how far the least whole number of flips that does is from it, beyond one task."""
    sizes = experiments.values(spark, "size", tuple(map(float, FLIP_SIZES))).select(F.col("size").cast("int").alias("n"))
    cases = sizes.withColumn("a", F.explode(F.sequence(F.lit(2), F.col("n") - 1))).crossJoin(experiments.values(spark, "slack", FLIP_SLACKS))  # 2,172 fixed rows
    cost = F.lit(100.0)
    limit = cost / F.col("a") * (1 + F.col("slack"))
    tried = cases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("a") - 1))).where(cost / (F.col("a") - F.col("k")) > limit)
    least = tried.groupBy("n", "a", "slack").agg(F.min("k").alias("k"))
    gap = F.abs(F.col("k") / F.col("n") - labels.flip_threshold(F.col("a") / F.col("n"), F.col("slack"))) - 1 / F.col("n")
    return least.agg(F.greatest(F.lit(0.0), F.max(gap)).alias("excess"))


def required_agreement(spark: SparkSession) -> DataFrame:
    """(rate, slack, threshold, required, sufficient): how well labels must agree for a gate not to flip, beside what is common."""
    grid = experiments.values(spark, "rate", ACCEPT_RATES).crossJoin(experiments.values(spark, "slack", SLACKS))  # 15 fixed rows
    star = labels.flip_threshold(F.col("rate"), F.col("slack"))
    return grid.select("rate", "slack", star.alias("threshold"), (1 - star).alias("required"), (star >= 1 - COMMON_AGREEMENT - 1e-12).alias("sufficient"))


@dataclass(frozen=True)
class LabelReport:
    worst_ratio_error: float
    broken_bounds: int
    flip_excess: float
    amplification: tuple[tuple[float, float, float, float], ...]
    agreement: tuple[tuple[float, float, float, float, bool], ...]

    @property
    def holds(self) -> bool:
        return self.worst_ratio_error < 1e-9 and self.broken_bounds == 0 and self.flip_excess < 1e-9

    def text(self) -> str:
        held = lambda ok: "holds" if ok else "FAILS"
        lines = [
            f"1. Unit costs are distorted by a / (a + fp - fn): {held(self.worst_ratio_error < 1e-9)} (largest error {self.worst_ratio_error:.2e})",
            "2. Ratios amplify label error by 1 / rate to first order:",
            *[f"   rate {r:.2f}, error {e:.2%}: exact {x:.2%}, first order {f:.2%}" for r, e, x, f in self.amplification],
            f"3. Differences move by v_max * error at most: {held(self.broken_bounds == 0)}",
            f"4. Gates flip beyond rate * slack / (1 + slack): {held(self.flip_excess < 1e-9)} (excess over one task {self.flip_excess:.4f})",
            "Agreement that labels need:",
            *[f"   rate {r:.0%}, slack {s:.0%}: {q:.1%}, {COMMON_AGREEMENT:.0%} {'is enough' if ok else 'is not enough'}" for r, s, _, q, ok in self.agreement],
        ]
        return "\n".join(lines) + "\n"


def label_report(spark: SparkSession, trials: int = 4000) -> LabelReport:
    """All checks and tables; what is collected is three rows and two tables of 8 and 15."""
    first, second = summed(workloads(spark, trials, 11)), summed(workloads(spark, trials, 23))
    return LabelReport(
        ratio_distortion(first).first()[0], difference_bound(second).first()[0], flip_gap(spark).first()[0],
        tuple(tuple(r) for r in amplification_table(spark).orderBy(F.desc("rate"), "error").collect()), tuple(tuple(r) for r in required_agreement(spark).orderBy(F.desc("rate"), "slack").collect()),
    )
