"""Studies of the decisions themselves: scenarios, disabled and mutated gates, sensitivity of verdicts, in closed form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The factors of the scenario matrix, its two boundary cases, the grids and the policy of the studies.
FACTORS = {"acceptable_tasks": (5, 8, 10), "trace_cost": (0.1, 1.5), "failure_minutes": (0.0, 5.0), "tail_loss": (0.0, 10.0), "baseline_cost": (0.0, 4.0), "baseline_rate": (0.70, 0.95)}
BOUNDARY = ((10, 0.1, 0.0, 0.0, 4.0, 0.70, 3.0, 5.0), (10, 0.1, 0.0, 0.0, 4.0, 0.70, 0.0, 0.05))
DEFAULT_MINUTES, DEFAULT_VALUE, TASKS = 0.0, 5.0, 10
INCIDENT_GRID = (0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0)
REMEDIATION_GRID = (0.0, 0.25, 0.5, 1.0, 2.0, 5.0)
BASELINE_STEPS = ((0.50, "-50%"), (0.75, "-25%"), (0.90, "-10%"), (1.10, "+10%"), (1.25, "+25%"), (1.50, "+50%"))
LIMITS = {"rate": 0.80, "unit": 2.0, "tail": 8.0, "trace": 1.0}
#: The six dimensions, and how the gate of each routes.
GATES = (("outcome_quality", "ASSIST"), ("unit_economics", "ASSIST"), ("tail_risk", "ASSIST"), ("business_value", "STOP"), ("counterfactual", "STOP"), ("runtime_caps", "ASSIST"))
FRAGILE, BRITTLE = 1, 3


def values(spark: SparkSession, name: str, items: tuple) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in items])).alias(name))


def scenarios(spark: SparkSession) -> DataFrame:
    """The matrix: 96 combinations and 2 boundary cases, with ``scenario`` numbering them."""
    grid = reduce(lambda a, b: a.crossJoin(b), [values(spark, k, v) for k, v in FACTORS.items()])  # 96 fixed rows
    grid = grid.withColumn("all_minutes", F.lit(DEFAULT_MINUTES)).withColumn("value", F.lit(DEFAULT_VALUE))
    edges = spark.createDataFrame(list(BOUNDARY), ", ".join(f"{c} {'int' if c == 'acceptable_tasks' else 'double'}" for c in grid.columns))
    return grid.unionByName(edges).withColumn("scenario", F.concat_ws("/", *[F.format_number(F.col(c).cast("double"), 2) for c in grid.columns]))


def gate_failures(loss: Column | None = None, remediation: Column | None = None, baseline_rate: Column | None = None) -> dict[str, Column]:
    """Whether each gate fails for a scenario row: ten tasks with one event each, the first ``acceptable_tasks`` acceptable, the loss on the first."""
    a, t, h, minutes, v = (F.col(c) for c in ("acceptable_tasks", "trace_cost", "failure_minutes", "all_minutes", "value"))
    loss = F.col("tail_loss") if loss is None else loss
    remediation = F.lit(0.0) if remediation is None else remediation
    rate = F.col("baseline_rate") if baseline_rate is None else baseline_rate
    # Exact decimals, as costs are: at 60 dollars an hour a minute is a dollar.
    d = lambda c: c.cast("decimal(18,6)")
    plain, failed = d(t) + d(minutes), d(t) + d(minutes) + d(h) + d(remediation)
    total = plain * TASKS + (d(h) + d(remediation)) * (TASKS - a) + d(loss)
    first = F.when(a > 0, plain).otherwise(failed) + d(loss)
    worst = F.greatest(first, F.when(a < TASKS, failed).otherwise(plain))
    cost = total.cast("double")
    net = ((d(v) * a).cast("double") - cost) / TASKS
    baseline = rate * v - F.col("baseline_cost")
    return {
        "outcome_quality": a / TASKS < LIMITS["rate"],
        "unit_economics": F.when(a == 0, F.lit(True)).otherwise(cost / F.nullif(a, F.lit(0)) > LIMITS["unit"]),
        "tail_risk": worst.cast("double") > LIMITS["tail"],
        "business_value": net < 0.0,
        "counterfactual": net - baseline < 0.0,
        "runtime_caps": t > LIMITS["trace"],
    }


def verdict(fails: dict[str, Column], without: Column | None = None) -> Column:
    """The decision, with the gate of the dimension named by ``without`` left out."""
    off = lambda name: F.lit(False) if without is None else without == name
    stop = reduce(lambda a, b: a | b, [fails[n] & ~off(n) for n, route in GATES if route == "STOP"])
    any_ = reduce(lambda a, b: a | b, [fails[n] & ~off(n) for n, _ in GATES])
    return F.when(stop, "STOP").when(any_, "ASSIST").otherwise("SCALE")


def coverage_drift(spark: SparkSession) -> DataFrame:
    """Per scenario and disabled dimension: the full verdict, that of an engine whose required coverage shrinks, and of one whose doesn't."""
    cells = scenarios(spark).crossJoin(values(spark, "dimension", tuple(n for n, _ in GATES)))  # 588 fixed rows
    fails = gate_failures()
    rows = cells.select("scenario", "dimension", verdict(fails).alias("full_decision"), verdict(fails, F.col("dimension")).alias("dynamic_decision"), F.lit("INCOMPLETE").alias("fixed_decision"))
    return rows.withColumn("false_scale", (F.col("full_decision") != "SCALE") & (F.col("dynamic_decision") == "SCALE"))


def drift_summary(spark: SparkSession) -> DataFrame:
    return coverage_drift(spark).groupBy("dimension").agg(
        F.count("*").alias("evaluations"), F.count_if(F.col("full_decision") != "SCALE").alias("at_risk"), F.count_if("false_scale").alias("false_scale"), F.count_if(F.col("fixed_decision") == "INCOMPLETE").alias("fixed_refused")
    )


def mutants(spark: SparkSession) -> DataFrame:
    """Per scenario, operator and dimension: whether the mutant of a gate survives. A removed gate leaves coverage missing; a substitute claims it and enforces nothing."""
    cells = coverage_drift(spark).crossJoin(values(spark, "operator", ("removal", "substitution")))
    fixed = F.when(F.col("operator") == "removal", F.col("fixed_decision")).otherwise(F.col("dynamic_decision"))
    equivalent = F.col("full_decision") == "SCALE"
    return cells.select("scenario", "operator", "dimension", equivalent.alias("equivalent"), (~equivalent & (fixed == "SCALE")).alias("fixed_survived"), (~equivalent & (F.col("dynamic_decision") == "SCALE")).alias("dynamic_survived"))


def mutation_score(spark: SparkSession) -> DataFrame:
    """Per operator, equivalent mutants left out: how many there are and how many each engine kills."""
    scored = F.count_if(~F.col("equivalent"))
    return mutants(spark).groupBy("operator").agg(
        F.count("*").alias("mutants"), F.count_if("equivalent").alias("equivalent"), scored.alias("scored"), (scored - F.count_if("fixed_survived")).alias("fixed_killed"), (scored - F.count_if("dynamic_survived")).alias("dynamic_killed")
    )


def flips(spark: SparkSession) -> DataFrame:
    """Per scenario: in how many of the 48 cells of incident loss and remediation the verdict changes, and its class."""
    cells = scenarios(spark).crossJoin(values(spark, "loss", INCIDENT_GRID)).crossJoin(values(spark, "remediation", REMEDIATION_GRID))  # 4,704 fixed rows
    moved = verdict(gate_failures(F.col("loss"), F.col("remediation"))) != verdict(gate_failures())
    counted = cells.groupBy("scenario").agg(F.count_if(moved).alias("flips"))
    return counted.withColumn("class", F.when(F.col("flips") < FRAGILE, "robust").when(F.col("flips") < BRITTLE, "fragile").otherwise("brittle"))


def baseline_fragility(spark: SparkSession) -> DataFrame:
    """Per change of the baseline's rate: scenarios whose counterfactual gate changes its answer."""
    steps = spark.createDataFrame(list(BASELINE_STEPS), "factor double, change string")
    changed = F.least(F.lit(0.9999), F.greatest(F.lit(0.0001), F.col("baseline_rate") * F.col("factor")))
    moved = gate_failures(baseline_rate=changed)["counterfactual"] != gate_failures()["counterfactual"]
    return scenarios(spark).crossJoin(steps).groupBy("change").agg(F.count_if(moved).alias("fragile"))
