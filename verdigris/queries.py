"""Queries over the star-schema tables, one or more for every operator, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import money, shapes, stats
from .operators import gates, graphs, labels, rollup, sequences, validate
from .plans import assurance, experiments, frontier, propositions
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def rounded(table: DataFrame, **kinds: str) -> DataFrame:
    """Doubles rounded to 6 digits, decimals as doubles, and whole numbers as long."""
    out = []
    for f in table.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        out.append((F.round(c.cast("double"), 6) if kind in ("double", "decimal") else c.cast("bigint") if kind in ("integer", "short", "byte") else c).alias(f.name))
    return table.select(*out)


EVENTS = """ev AS (SELECT l_orderkey AS task_id, CASE WHEN l_returnflag = 'N' THEN 'model' ELSE 'tool' END AS event_type, l_linestatus AS name,
  CASE WHEN l_linestatus = 'O' THEN 'edge-small' ELSE 'frontier-large' END AS model, CAST(floor(l_quantity * 100) AS BIGINT) AS ti, CAST(floor(l_quantity * 10) AS BIGINT) AS tu,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE abs(l_tax) END AS direct, l_returnflag, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus FROM lineitem),
pr AS (SELECT *, CASE WHEN direct IS NOT NULL THEN CAST(direct * 1000000 AS DECIMAL(28,6))
  ELSE CAST(ti * CASE WHEN model = 'edge-small' THEN CAST(0.15 AS DECIMAL(10,4)) ELSE CAST(2.5 AS DECIMAL(10,4)) END + tu * CASE WHEN model = 'edge-small' THEN CAST(0.6 AS DECIMAL(10,4)) ELSE CAST(10 AS DECIMAL(10,4)) END AS DECIMAL(28,6)) END AS micro FROM ev)"""
SEQ = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
OUTCOMES = """oc AS (SELECT o_orderkey AS task_id, o_orderstatus <> 'P' AS ok, CAST(o_totalprice / 10000.0 * 1000000 AS DECIMAL(28,6)) AS val,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 6000000 ELSE 0 END AS hum, CASE WHEN o_orderstatus = 'P' THEN 500000 ELSE 0 END AS rem,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 3000000 ELSE 0 END AS inc FROM orders)"""
ROLLUP = f"""{EVENTS}, {OUTCOMES},
tr AS (SELECT task_id, count(*) AS calls, sum(micro) AS trace FROM pr GROUP BY task_id),
tk AS (SELECT task_id, calls, trace, ok, hum, rem, inc, CASE WHEN ok THEN val ELSE 0 END AS val, trace + hum + rem + inc AS eff FROM tr JOIN oc USING (task_id))"""
METRICS = f"""{ROLLUP},
m0 AS (SELECT count(*) AS n, count(*) FILTER (ok) AS a, CAST(sum(eff) AS DOUBLE) / 1000000 AS cost, CAST(sum(val) AS DOUBLE) / 1000000 AS val, CAST(quantile_disc(eff, 0.95) AS DOUBLE) / 1000000 AS p95, CAST(max(eff) AS DOUBLE) / 1000000 AS mx FROM tk),
m AS (SELECT n AS attempts, a AS acceptable_count, a / n AS acceptable_rate, cost AS total_effective_cost_usd, CASE WHEN a = 0 THEN CAST('Infinity' AS DOUBLE) ELSE cost / a END AS cost_per_acceptable_outcome_usd,
  p95 AS p95_task_cost_usd, mx AS max_task_cost_usd, (val - cost) / n AS expected_net_value_per_attempt_usd, (val - cost) / n - (0.7 * 8.0 - 5.0) AS incremental_net_value_vs_baseline_usd FROM m0 WHERE n > 0)"""


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return money.priced_events(tables.events(spark, sf_dir), tables.rates(spark))


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.task_rollup(tables.events(spark, sf_dir), tables.outcomes(spark, sf_dir), tables.rates(spark), tables.POLICY.human_hourly_cost_usd)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.metrics(_rollup(spark, sf_dir), tables.BASELINE)


@registered(f"WITH {EVENTS} SELECT task_id, event_type, model, count(*) AS events, round(CAST(sum(micro) AS DOUBLE) / 1000000, 6) AS cost_usd FROM pr GROUP BY ALL")
def event_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event priced by its direct cost or at its model's rates."""
    return rounded(_priced(spark, sf_dir).groupBy("task_id", "event_type", "model").agg(F.count("*").alias("events"), money.dollars(F.sum("cost_micro")).alias("cost_usd")))


@registered(
    f"""WITH {ROLLUP} SELECT task_id, calls AS call_count, ok AS acceptable, round(CAST(trace AS DOUBLE) / 1000000, 6) AS trace_cost_usd, round(CAST(hum AS DOUBLE) / 1000000, 6) AS human_cost_usd, round(CAST(rem AS DOUBLE) / 1000000, 6) AS remediation_cost_usd,
  round(CAST(inc AS DOUBLE) / 1000000, 6) AS incident_loss_usd, round(CAST(eff AS DOUBLE) / 1000000, 6) AS effective_cost_usd, round(CAST(val AS DOUBLE) / 1000000, 6) AS business_value_usd FROM tk"""
)
def task_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and value of every task."""
    return rounded(rollup.task_economics(_rollup(spark, sf_dir)))


@registered(f"WITH {METRICS} SELECT attempts, acceptable_count, {', '.join(f'round({c}, 6) AS {c}' for c in ('acceptable_rate', 'total_effective_cost_usd', 'cost_per_acceptable_outcome_usd', 'p95_task_cost_usd', 'max_task_cost_usd', 'expected_net_value_per_attempt_usd', 'incremental_net_value_vs_baseline_usd'))} FROM m")
def assurance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scalar metrics."""
    return rounded(_metrics(spark, sf_dir))


GATE_ROWS = """g AS (SELECT unnest([{'gate': 'acceptable-rate', 'failed': acceptable_rate < 0.8, 'route': 'ASSIST'}, {'gate': 'unit-economics', 'failed': cost_per_acceptable_outcome_usd > 2.0, 'route': 'ASSIST'},
  {'gate': 'tail-cost', 'failed': p95_task_cost_usd > 8.0, 'route': 'ASSIST'}, {'gate': 'net-value', 'failed': expected_net_value_per_attempt_usd < 0.0, 'route': 'STOP'},
  {'gate': 'counterfactual', 'failed': incremental_net_value_vs_baseline_usd < 0.0, 'route': 'STOP'}, {'gate': 'runtime-caps', 'failed': (SELECT count(*) FROM tk WHERE calls > 8 OR CAST(trace AS DOUBLE) / 1000000 > 0.15) > 0, 'route': 'ASSIST'}], recursive := true) FROM m)"""


def _view(spark: SparkSession, sf_dir: str) -> gates.View:
    """What the checks see; the tasks are summed once and written, because every check and the metrics read them."""
    tasks = graphs.cut(_rollup(spark, sf_dir))
    measured = rollup.metrics(tasks, tables.BASELINE).first().asDict()
    return gates.View(measured, tasks, _priced(spark, sf_dir), None, tables.BASELINE, tables.POLICY)


def _gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all gates, of which the tasks above a cap may be many."""
    only = tuple(c for c in gates.DEFAULT_CHECKS if c.mode is gates.Mode.GATE)
    return assurance.all_results(only, _view(spark, sf_dir))


@registered(f"WITH {METRICS}, {GATE_ROWS} SELECT gate, failed, CASE WHEN failed THEN route END AS on_failure FROM g")
def gate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gate's function, on one view."""
    failed = F.bool_or(F.col("status") == "FAIL")
    return _gate_rows(spark, sf_dir).groupBy(F.substring_index("check_id", ".", -1).alias("gate")).agg(failed.alias("failed"), F.max("on_failure").alias("on_failure"))


@registered(f"WITH {METRICS}, {GATE_ROWS} SELECT CASE WHEN bool_or(failed AND route = 'STOP') THEN 'STOP' WHEN bool_or(failed) THEN 'ASSIST' ELSE 'SCALE' END AS decision, count(*) FILTER (failed) AS failed_gates FROM g")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduction of the gates' routes to a decision."""
    failed = _gate_rows(spark, sf_dir).where("status = 'FAIL'").select("check_id", "on_failure").distinct().collect()  # one row a gate at most
    decision = assurance.reduce_decision({r["on_failure"] for r in failed})
    return spark.createDataFrame([(str(decision), len({r["check_id"] for r in failed}))], "decision string, failed_gates bigint")


@registered(
    f"""WITH {EVENTS}, s AS (SELECT *, CASE WHEN name = lag(name) OVER w AND json_shape = lag(json_shape) OVER w THEN 0 ELSE 1 END AS fresh FROM (SELECT l_orderkey AS task, l_linestatus AS name, l_linenumber % 2 AS json_shape, * FROM lineitem WHERE l_returnflag <> 'N') WINDOW w AS (PARTITION BY task ORDER BY {SEQ})),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY task ORDER BY {SEQ} ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT task AS task_id, count(*) AS runs FROM (SELECT task, island FROM i GROUP BY task, island HAVING count(*) >= 3) GROUP BY task"""
)
def repeated_tool_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnostic of repeated tool calls of one shape, from arguments as JSON."""
    made = tables.events(spark, sf_dir).withColumn("timestamp", F.col("_seq")).withColumn("event_id", F.to_json("_seq"))
    shaped = made.withColumn("arguments", F.when(F.col("_seq.l_linenumber") % 2 == 0, F.lit('{"a": 1}')).otherwise(F.lit('{"b": ["x"]}')))
    view = gates.View({}, made, shaped, None, tables.BASELINE, tables.POLICY)
    return gates.repeated_tool_shape(view).groupBy(F.col("task_id").cast("bigint").alias("task_id")).agg(F.count("*").alias("runs"))


@registered(
    f"""WITH {ROLLUP} SELECT task_id, CAST(1 AS BIGINT) AS breach, CAST(calls AS DOUBLE) AS observed, CAST(8 AS DOUBLE) AS cap FROM tk WHERE calls > 8
UNION ALL SELECT task_id, 2, round(CAST(trace AS DOUBLE) / 1000000, 6), 0.15 FROM tk WHERE CAST(trace AS DOUBLE) / 1000000 > 0.15"""
)
def runtime_cap_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4."""
    return rounded(gates.cap_breaches(_rollup(spark, sf_dir), tables.POLICY.max_calls_per_task, tables.POLICY.max_trace_cost_per_task_usd))


@registered("SELECT DISTINCT l_orderkey AS task_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def missing_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with events and no outcome, were those of partial orders lost."""
    return rollup.unmatched(tables.events(spark, sf_dir), tables.outcomes(spark, sf_dir).where("acceptable"))[0]


@registered("SELECT o_orderkey AS task_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of tasks without events."""
    return rollup.unmatched(tables.events(spark, sf_dir), tables.outcomes(spark, sf_dir))[1]


@registered("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return rounded(validate.duplicates(tables.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"))


@registered(
    """WITH e AS (SELECT conv_id || '' AS c, conv_id, turn FROM conversations), edges AS (SELECT c || ':' || CAST(turn AS VARCHAR) AS a, c || ':' || CAST(turn + 1 AS VARCHAR) AS b FROM e),
n AS (SELECT c || ':' || CAST(turn AS VARCHAR) AS x FROM e) SELECT a || '->' || b AS edge, 'edge refers to an unknown event' AS message FROM edges WHERE b NOT IN (SELECT x FROM n) OR a NOT IN (SELECT x FROM n)"""
)
def edge_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to the next turn, of which each conversation's last has none."""
    turns = tables.read(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    events = turns.select(name(F.col("turn")).alias("event_id"), F.col("conv_id").cast("string").alias("task_id"))
    edges = turns.select(name(F.col("turn")).alias("source_event_id"), name(F.col("turn") + 1).alias("target_event_id"))
    first, second = validate.edge_problems(edges, events)
    return first.unionByName(second).select(F.col("key").alias("edge"), "message")


@registered(
    """WITH s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM s),
r AS (SELECT *, row_number() OVER w AS pos, first_value(event_id) OVER w AS first_event FROM i WINDOW w AS (PARTITION BY user_id, island ORDER BY ts, event_id))
SELECT user_id, event_type, first_event, event_id AS last_event FROM r WHERE pos = 3"""
)
def repeated_shape_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    return sequences.repeated_runs(tables.read(spark, sf_dir, "events"), "event_type", 3, task="user_id", order=("ts", "event_id"))


@registered(f"WITH {EVENTS}, s AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {', '.join(f'{c} DESC' for c in SEQ.split(', '))}) AS rn FROM pr) SELECT task_id, round(CAST(max(micro) FILTER (rn = 1) AS DOUBLE) / 1000000, 6) AS last_cost_usd, round(CAST(sum(micro) AS DOUBLE) / 1000000, 6) AS trace_cost_usd FROM s GROUP BY task_id")
def last_event_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last event alone would say of a task's cost."""
    return rounded(rollup.last_event_cost(_priced(spark, sf_dir), ["_seq"]))


ARMS = f"""{ROLLUP}, arm AS (SELECT * FROM (VALUES ('balanced', 7, 0.6), ('cheap', 3, 0.4), ('premium', 0, 1.5), ('reference', 0, 1.0)) AS t(arm_id, every, factor)),
ap AS (SELECT arm_id, task_id, ok AS r_ok, CASE WHEN every > 0 AND task_id % CASE WHEN every > 0 THEN every ELSE 1 END = 0 THEN NOT ok ELSE ok END AS c_ok, CAST(eff AS DOUBLE) / 1000000 AS r_usd, CAST(eff AS DOUBLE) / 1000000 * CAST(factor AS DOUBLE) AS c_usd FROM tk CROSS JOIN arm),
asum AS (SELECT arm_id, count(*) AS tasks, count(*) FILTER (c_ok) / count(*) AS acceptable_rate, CAST(sum(CAST(c_usd AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS mean_cost_usd FROM ap GROUP BY arm_id)"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task in every arm; the arms are four fixed rows."""
    arms = spark.createDataFrame(list(tables.ARMS), "arm_id string, every int, factor double")
    tasks = _rollup(spark, sf_dir).select("task_id", F.col("acceptable").alias("r_ok"), money.dollars(F.col("effective_micro")).alias("r_usd"))
    flipped = (F.col("every") > 0) & (F.col("task_id") % F.greatest("every", F.lit(1)) == 0)
    return tasks.crossJoin(F.broadcast(arms)).select("arm_id", "task_id", "r_ok", F.when(flipped, ~F.col("r_ok")).otherwise(F.col("r_ok")).alias("c_ok"), "r_usd", (F.col("r_usd") * F.col("factor")).alias("c_usd"))


def _arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.arm_summary(_arms(spark, sf_dir), ok="c_ok", cost="c_usd")


@registered(f"WITH {ARMS} SELECT arm_id, count(*) AS paired_tasks, count(*) FILTER (r_ok AND NOT c_ok) AS harmful_regressions, count(*) FILTER (NOT r_ok AND c_ok) AS beneficial_changes, count(*) FILTER (r_ok) AS reference_acceptable_tasks, count(*) FILTER (c_ok) AS candidate_acceptable_tasks FROM ap WHERE arm_id <> 'reference' GROUP BY arm_id")
def paired_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, A14."""
    return frontier.paired_counts(_arms(spark, sf_dir).where("arm_id <> 'reference'"), "arm_id")


@registered(f"WITH {ARMS} SELECT arm_id, tasks, round(acceptable_rate, 6) AS acceptable_rate, round(mean_cost_usd, 6) AS mean_cost_usd FROM asum")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return rounded(_arm_summary(spark, sf_dir))


@registered(f"WITH {ARMS} SELECT a.arm_id FROM asum a WHERE EXISTS (SELECT 1 FROM asum b WHERE b.arm_id <> a.arm_id AND b.mean_cost_usd <= a.mean_cost_usd AND b.acceptable_rate >= a.acceptable_rate AND (b.mean_cost_usd < a.mean_cost_usd OR b.acceptable_rate > a.acceptable_rate))")
def pareto_dominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, X6."""
    return frontier.dominated(_arm_summary(spark, sf_dir)).select("arm_id")


ELIGIBLE = f"""{ARMS}, bo AS (SELECT arm_id, count(*) FILTER (r_ok AND NOT c_ok) / count(*) AS breakage_upper, 1 - CAST(sum(CAST(c_usd AS DECIMAL(28,6))) AS DOUBLE) / CAST(sum(CAST(r_usd AS DECIMAL(28,6))) AS DOUBLE) AS cost_reduction_lower FROM ap WHERE arm_id <> 'reference' GROUP BY arm_id)"""


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakage and cost reduction of the candidates as they are, where a plan has their confidence bounds."""
    pairs = _arms(spark, sf_dir).where("arm_id <> 'reference'")
    spent = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
    costs = pairs.groupBy("arm_id").agg((1 - spent("c_usd") / spent("r_usd")).alias("cost_reduction_lower"))
    return frontier.paired_counts(pairs, "arm_id").select("arm_id", (F.col("harmful_regressions") / F.col("paired_tasks")).alias("breakage_upper")).join(costs, "arm_id")


@registered(f"WITH {ELIGIBLE} SELECT arm_id, round(breakage_upper, 6) AS breakage_upper, round(cost_reduction_lower, 6) AS cost_reduction_lower, breakage_upper > 0.2 AS breaks, NOT cost_reduction_lower >= 0.3 AS saves_too_little FROM bo")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why arms can't be adopted."""
    found = frontier.ineligible(_bounds(spark, sf_dir), 0.2, 0.3)
    return rounded(found.select("arm_id", "breakage_upper", "cost_reduction_lower", F.array_contains("reasons", "breakage").alias("breaks"), F.array_contains("reasons", "cost reduction").alias("saves_too_little")))


@registered(f"WITH {ELIGIBLE} SELECT arm_id, round(mean_cost_usd, 6) AS mean_cost_usd FROM asum JOIN bo USING (arm_id) WHERE breakage_upper <= 0.2 AND cost_reduction_lower >= 0.3 ORDER BY asum.mean_cost_usd, acceptable_rate DESC, arm_id LIMIT 1")
def select_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest candidate that nothing speaks against."""
    candidates = frontier.ineligible(_bounds(spark, sf_dir), 0.2, 0.3).join(_arm_summary(spark, sf_dir), "arm_id")
    return rounded(frontier.select_arm(candidates).select("arm_id", "mean_cost_usd"))


@registered("SELECT l_linestatus AS model, count(DISTINCT l_tax) AS cards FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_tax) > 1")
def rate_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that have more than one price."""
    cards = tables.read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("model"), F.col("l_tax").alias("input_per_million_usd"), F.lit(0.0).alias("output_per_million_usd"))
    return frontier.rate_drift(cards)


#: A plan draws thousands of times at its adjusted level; that many draws of every task are too many rows for the SQL they are held against.
DRAWS, LEVEL = 200, 0.1


@registered(
    f"""WITH {ARMS}, dr AS (SELECT arm_id, r_usd, c_usd, b.b AS draw, {stats.poisson_weight("task_id", "b.b")} AS w FROM ap CROSS JOIN range(1, {DRAWS + 1}) b(b) WHERE arm_id <> 'reference'),
e AS (SELECT arm_id, draw, CAST(sum(CAST(r_usd * w AS DECIMAL(28,6))) AS DOUBLE) AS r, CAST(sum(CAST(c_usd * w AS DECIMAL(28,6))) AS DOUBLE) AS c FROM dr GROUP BY ALL)
SELECT arm_id, round(quantile_disc((r - c) / r, {LEVEL}), 5) AS lower_bound FROM e GROUP BY arm_id"""
)
def bootstrap_lcb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 distributed, T4: the lower bound of the cost reduction."""
    pairs = _arms(spark, sf_dir).where("arm_id <> 'reference'").select("arm_id", F.col("task_id").alias("task_key"), F.col("r_usd").alias("reference_usd"), F.col("c_usd").alias("candidate_usd"))
    draws = stats.distributed_bootstrap(pairs, DRAWS, keys=("arm_id",))
    return draws.groupBy("arm_id").agg(F.round(F.expr(f"percentile_disc({LEVEL}) WITHIN GROUP (ORDER BY reduction)"), 5).alias("lower_bound"))


@registered(
    f"""WITH RECURSIVE {ARMS}, k AS (SELECT arm_id, count(*) AS n, count(*) FILTER (r_ok AND NOT c_ok) AS x FROM ap WHERE arm_id <> 'reference' GROUP BY arm_id),
half(arm_id, n, x, step, low, high) AS (SELECT arm_id, n, x, 0, CAST(x / n AS DOUBLE), CAST(1 AS DOUBLE) FROM k WHERE x < n
UNION ALL SELECT arm_id, n, x, step + 1, CASE WHEN tail > 0.05 / 6 THEN mid ELSE low END, CASE WHEN tail > 0.05 / 6 THEN high ELSE mid END FROM (
  SELECT *, (low + high) / 2 AS mid, list_sum(list_transform(range(x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((low + high) / 2) + (n - i) * ln(1 - (low + high) / 2)))) AS tail FROM half WHERE step < 50))
SELECT arm_id, round(coalesce((low + high) / 2, 1), 8) AS breakage_upper FROM k LEFT JOIN (SELECT * FROM half WHERE step = 50) USING (arm_id)"""
)
def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact upper bounds of the candidates' breakage."""
    counts = paired_regressions(spark, sf_dir)
    return counts.select("arm_id", F.round(stats.clopper_pearson(F.col("harmful_regressions"), F.col("paired_tasks"), 0.05 / 6), 8).alias("breakage_upper"))


SCENARIOS = """sc AS (SELECT a, t, h, l, bc, ba, 0.0 AS m, 5.0 AS v FROM (SELECT unnest([5, 8, 10]) AS a) CROSS JOIN (SELECT unnest([0.1, 1.5]) AS t) CROSS JOIN (SELECT unnest([0.0, 5.0]) AS h) CROSS JOIN (SELECT unnest([0.0, 10.0]) AS l)
  CROSS JOIN (SELECT unnest([0.0, 4.0]) AS bc) CROSS JOIN (SELECT unnest([0.70, 0.95]) AS ba) UNION ALL SELECT 10, 0.1, 0.0, 0.0, 4.0, 0.70, 3.0, 5.0 UNION ALL SELECT 10, 0.1, 0.0, 0.0, 4.0, 0.70, 0.0, 0.05),
base AS (SELECT *, row_number() OVER (ORDER BY a, t, h, l, bc, ba, m, v) AS id FROM sc)"""


def _fails(source: str, loss: str = "l", rem: str = "0.0", rate: str = "ba") -> str:
    d = lambda x: f"CAST({x} AS DECIMAL(18,6))"
    plain, failed = f"({d('t')} + {d('m')})", f"({d('t')} + {d('m')} + {d('h')} + {d(rem)})"
    total = f"CAST({plain} * 10 + ({d('h')} + {d(rem)}) * (10 - a) + {d(loss)} AS DOUBLE)"
    net = f"((CAST({d('v')} * a AS DOUBLE) - {total}) / 10)"
    return f"""SELECT *, a / 10 < 0.8 AS f1, {total} / a > 2.0 AS f2, CAST(greatest({plain} + {d(loss)}, CASE WHEN a < 10 THEN {failed} ELSE {plain} END) AS DOUBLE) > 8.0 AS f3, {net} < 0 AS f4,
  {net} - (CAST({rate} AS DOUBLE) * CAST(v AS DOUBLE) - CAST(bc AS DOUBLE)) < 0 AS f5, t > 1.0 AS f6 FROM {source}"""


VERDICT = "CASE WHEN {0}f4 OR {0}f5 THEN 'STOP' WHEN {0}f1 OR {0}f2 OR {0}f3 OR {0}f6 THEN 'ASSIST' ELSE 'SCALE' END"
WITHOUT = "CASE WHEN (f4 AND dim <> 'business_value') OR (f5 AND dim <> 'counterfactual') THEN 'STOP' WHEN (f1 AND dim <> 'outcome_quality') OR (f2 AND dim <> 'unit_economics') OR (f3 AND dim <> 'tail_risk') OR (f6 AND dim <> 'runtime_caps') OR (f4 AND dim <> 'business_value') OR (f5 AND dim <> 'counterfactual') THEN 'ASSIST' ELSE 'SCALE' END"
DIMS = "(SELECT unnest(['outcome_quality', 'unit_economics', 'tail_risk', 'business_value', 'counterfactual', 'runtime_caps']) AS dim)"
DRIFT = f"{SCENARIOS}, f AS ({_fails('base')}), dd AS (SELECT dim, id, {VERDICT.format('')} AS full_d, {WITHOUT} AS dyn_d FROM f CROSS JOIN {DIMS})"


@registered(f"WITH {DRIFT} SELECT dim AS dimension, count(*) AS evaluations, count(*) FILTER (full_d <> 'SCALE') AS at_risk, count(*) FILTER (full_d <> 'SCALE' AND dyn_d = 'SCALE') AS false_scale, count(*) AS fixed_refused FROM dd GROUP BY dim")
def coverage_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, A16, J13."""
    return experiments.drift_summary(spark)


@registered(
    f"""WITH {DRIFT}, mu AS (SELECT op, full_d = 'SCALE' AS eq, dyn_d = 'SCALE' AS dyn, op = 'substitution' AND dyn_d = 'SCALE' AS fixd FROM dd CROSS JOIN (SELECT unnest(['removal', 'substitution']) AS op))
SELECT op AS operator, count(*) AS mutants, count(*) FILTER (eq) AS equivalent, count(*) FILTER (NOT eq) AS scored, count(*) FILTER (NOT eq AND NOT fixd) AS fixed_killed, count(*) FILTER (NOT eq AND NOT dyn) AS dynamic_killed FROM mu GROUP BY op"""
)
def mutation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2, A17."""
    return experiments.mutation_score(spark)


@registered(
    f"""WITH {SCENARIOS}, f AS ({_fails('base')}), grid AS (SELECT * FROM base CROSS JOIN (SELECT unnest([0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0]) AS gl) CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5, 1.0, 2.0, 5.0]) AS gr)),
g AS ({_fails('grid', 'gl', 'gr')}), c AS (SELECT g.id, count(*) FILTER ({VERDICT.format('g.')} <> {VERDICT.format('f.')}) AS flips FROM g JOIN f ON g.id = f.id GROUP BY g.id)
SELECT CASE WHEN flips < 1 THEN 'robust' WHEN flips < 3 THEN 'fragile' ELSE 'brittle' END AS class, flips, count(*) AS scenarios FROM c GROUP BY ALL"""
)
def sensitivity_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, A18, J14."""
    return experiments.flips(spark).groupBy("class", "flips").agg(F.count("*").alias("scenarios"))


@registered(
    f"""WITH {SCENARIOS}, f AS ({_fails('base')}), steps AS (SELECT *, least(0.9999, greatest(0.0001, CAST(ba AS DOUBLE) * factor)) AS nb FROM base CROSS JOIN (SELECT * FROM (VALUES (CAST(0.5 AS DOUBLE), '-50%'), (0.75, '-25%'), (0.9, '-10%'), (1.1, '+10%'), (1.25, '+25%'), (1.5, '+50%')) AS t(factor, change))),
g AS ({_fails('steps', rate='nb')}) SELECT g.change, count(*) FILTER (g.f5 <> f.f5) AS fragile FROM g JOIN f ON g.id = f.id GROUP BY g.change"""
)
def baseline_fragility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, A19, P27."""
    return experiments.baseline_fragility(spark)


CASES = "cs AS (SELECT d.doc_id, d.lang AS category, l.quality = 1 AS e, CASE WHEN l.quality IS NOT NULL THEN d.n_chars > 2000 END AS p, coalesce(l.quality = 1, false) AS e0 FROM documents d LEFT JOIN labels l USING (doc_id))"
CONFUSION = """count(*) AS cases, count(*) FILTER (p IS NULL) AS errors, count(*) FILTER (p AND e0) AS tp, count(*) FILTER (p AND NOT e0) AS fp, count(*) FILTER (NOT p AND e0) AS fn, count(*) FILTER (NOT p AND NOT e0) AS tn"""
RATES = """round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS agreement, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 6) AS f1,
  round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS negative_recall, round(coalesce(fp / nullif(tn + fp, 0), 0), 6) AS false_accept_rate"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = docs.join(known, "doc_id", "left")
    return joined.select("doc_id", F.col("lang").alias("category"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("expected"), F.when(F.col("quality").isNotNull(), F.col("n_chars") > 2000).alias("predicted"))


@registered(f"WITH {CASES}, k AS (SELECT {CONFUSION} FROM cs) SELECT cases, errors, tp, fp, fn, tn, {RATES} FROM k")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20, J12."""
    return rounded(labels.confusion(_cases(spark, sf_dir)))


@registered(f"WITH {CASES}, k AS (SELECT category, {CONFUSION} FROM cs GROUP BY category) SELECT category, cases, errors, tp, fp, fn, tn, {RATES} FROM k")
def agreement_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    return rounded(labels.confusion(_cases(spark, sf_dir), "category"))


@registered("SELECT user_id, count(DISTINCT event_type) AS verdicts, round(min(value), 6) AS min_score, round(max(value), 6) AS max_score FROM events GROUP BY user_id")
def verdict_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return rounded(labels.stability(tables.read(spark, sf_dir, "events"), "user_id", "event_type", "value"))


@registered(
    """WITH g AS (SELECT r / 20 AS rate, e / 40 AS error FROM range(2, 20) a(r), range(1, 13) b(e))
SELECT round(rate, 6) AS rate, round(error, 6) AS error, CASE WHEN rate > error THEN round(error / (rate - error), 6) END AS exact_error, round(error / rate, 6) AS first_order FROM g"""
)
def label_error_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a ratio metric amplifies label error; null where it has no bound."""
    grid = spark.range(2, 20).select((F.col("id") / 20).alias("rate")).crossJoin(spark.range(1, 13).select((F.col("id") / 40).alias("error")))  # 216 fixed rows
    exact, first = labels.amplification(F.col("rate"), F.col("error"))
    return rounded(grid.select("rate", "error", F.when(F.col("rate") > F.col("error"), exact).alias("exact_error"), first.alias("first_order")))


@registered(
    """WITH g AS (SELECT * FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS rate) CROSS JOIN (SELECT unnest([0.05, 0.1, 0.25]::DOUBLE[]) AS slack))
SELECT rate, slack, round(1 - rate * slack / (1 + slack), 6) AS required_agreement, rate * slack / (1 + slack) >= 0.15 AS sufficient FROM g"""
)
def required_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well labels must agree for a gate not to flip."""
    grid = experiments.values(spark, "rate", (0.5, 0.6, 0.7, 0.8, 0.9)).crossJoin(experiments.values(spark, "slack", (0.05, 0.1, 0.25)))  # 15 fixed rows
    star = labels.flip_threshold(F.col("rate"), F.col("slack"))
    return grid.select("rate", "slack", F.round(1 - star, 6).alias("required_agreement"), (star >= 0.15).alias("sufficient"))


@registered(
    f"""WITH {ROLLUP}, j AS (SELECT *, CASE WHEN task_id % 9 = 0 THEN NOT ok ELSE ok END AS jd, CAST(eff AS DECIMAL(38,6)) AS c FROM tk)
SELECT count(*) FILTER (jd AND NOT ok) AS false_accepts, count(*) FILTER (ok AND NOT jd) AS false_rejects, round(CAST(sum(c) AS DOUBLE) / 1000000 / count(*) FILTER (ok), 5) AS unit_cost, round(CAST(sum(c) AS DOUBLE) / 1000000 / count(*) FILTER (jd), 5) AS judged_unit_cost FROM j"""
)
def label_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit costs under flipped labels."""
    tasks = rollup.task_economics(_rollup(spark, sf_dir)).withColumn("judged", F.when(F.col("task_id") % 9 == 0, ~F.col("acceptable")).otherwise(F.col("acceptable")))
    found = labels.relabelled(tasks)
    return found.select("false_accepts", "false_rejects", F.round("unit_cost", 5).alias("unit_cost"), F.round("judged_unit_cost", 5).alias("judged_unit_cost"))


CARD = {
    "billing_contexts": [{"service_tier": "standard", "speed": None, "inference_geo": None}],
    "tiers": [
        {"up_to_input_tokens": limit, "input_per_million_usd": rate, "output_per_million_usd": 5 * rate, "cache_read_per_million_usd": rate / 10, "cache_write_per_million_usd": {"short": 1.25 * rate}}
        for limit, rate in ((1000, 1.0), (3000, 2.0), (None, 4.0))
    ],
}


@registered(
    """WITH t AS (SELECT CAST(floor(l_quantity * 100) AS BIGINT) AS n, CAST(floor(l_quantity * 10) AS BIGINT) AS o, l_linenumber AS w, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS q FROM lineitem),
c AS (SELECT *, CASE WHEN n + w <= 1000 THEN 1 WHEN n + w <= 3000 THEN 2 ELSE 4 END AS rate FROM t)
SELECT CASE rate WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS tier, count(*) AS calls, round(sum(n * rate + o * 5 * rate + w * 1.25 * rate) / 1000000 + sum(q) * 0.01, 3) AS cost_usd FROM c GROUP BY rate"""
)
def tier_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card's tiers as the contract's parser gives them, the first that holds a call's input, and the call's price by it."""
    from .functions import pricing
    from .functions.shapes import canonical_json
    from .sources import contracts

    parsed = contracts.tiers_of(CARD, "model", {"short"}, {canonical_json(CARD["billing_contexts"][0])})
    rates = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(float(v)))])
    tiers = F.array(*[F.struct(F.lit(i).cast("bigint").alias("tier"), F.lit(t["limit"]).cast("bigint").alias("up_to"), *[F.lit(float(t[k])).alias(k) for k in ("input", "output", "cache_read")], rates(t["write"]).alias("cache_write")) for i, t in enumerate(parsed, 1)])
    n, written = F.floor(F.col("l_quantity") * 100).cast("bigint"), F.col("l_linenumber").cast("bigint")
    none = F.lit(0).cast("bigint")
    usage = F.struct(
        n.alias("input_tokens"), F.floor(F.col("l_quantity") * 10).cast("bigint").alias("output_tokens"), none.alias("cache_read_input_tokens"),
        F.create_map(F.lit("short"), written).alias("cache_creation"), F.create_map(F.lit("search"), F.when(F.col("l_returnflag") == "R", F.lit(2).cast("bigint")).otherwise(none)).alias("server_tool_use"),
    )
    calls = tables.read(spark, sf_dir, "lineitem").select(usage.alias("u"), pricing.first_tier(tiers, n + written).alias("t"))
    cost = pricing.call_cost(F.col("u"), F.col("t"), F.create_map(F.lit("search"), F.lit(0.01)))
    return calls.withColumn("cost", cost).groupBy("t.tier").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 3).alias("cost_usd"))


@registered(
    """WITH RECURSIVE w AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS root FROM conversations WHERE turn = 0
UNION ALL SELECT c.conv_id, c.turn, CASE WHEN c.role = 'user' THEN c.turn ELSE w.root END FROM conversations c JOIN w ON c.conv_id = w.conv_id AND c.turn = w.turn + 1)
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS node, CAST(conv_id AS VARCHAR) || ':' || CAST(root AS VARCHAR) AS nearest FROM w"""
)
def nearest_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest user turn at or above each turn, by pointer doubling."""
    return graphs.nearest_marked(_turns(spark, sf_dir), "node", "parent", "prompt")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.read(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    return turns.select(name(F.col("turn")).alias("node"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"), (F.col("role") == "user").alias("prompt"), "conv_id", "turn", "role")


@registered(
    """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role <> 'system') SELECT CAST(b.conv_id AS VARCHAR) || ':' || CAST(a.turn AS VARCHAR) AS parent_event, CAST(b.conv_id AS VARCHAR) || ':' || CAST(b.turn AS VARCHAR) AS event FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.rn = a.rn + 1"""
)
def economic_parent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to the nearest ancestor that isn't structural; system turns are."""
    turns = _turns(spark, sf_dir).withColumn("economic", F.col("role") != "system")
    above = graphs.nearest_marked(turns, "node", "parent", "economic").select(F.col("node").alias("parent"), F.col("nearest").alias("parent_event"))
    return turns.where("economic").join(above, "parent").where("parent_event is not null").select("parent_event", F.col("node").alias("event")).distinct()


@registered(
    """WITH RECURSIVE w AS (SELECT conv_id, turn, 0 AS depth FROM conversations WHERE turn = 0
UNION ALL SELECT c.conv_id, c.turn, w.depth + 1 FROM conversations c JOIN w ON c.conv_id = w.conv_id AND c.turn > 0 AND w.turn = (c.turn - 1) // 2)
SELECT conv_id, CAST(max(depth) AS BIGINT) AS deepest, count(*) AS members FROM w GROUP BY conv_id"""
)
def spawn_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep trees are in which every member starts up to two others, by pointer doubling."""
    turns = _turns(spark, sf_dir).withColumn("parent", F.when(F.col("turn") > 0, F.concat_ws(":", F.col("conv_id").cast("string"), F.floor((F.col("turn") - 1) / 2).cast("string"))))
    found = graphs.depths(turns, "node", "parent")
    return found.groupBy(F.split_part("root", F.lit(":"), F.lit(1)).cast("bigint").alias("conv_id")).agg(F.max("depth").alias("deepest"), F.count("*").alias("members"))


@registered("SELECT o_orderkey AS trace, l_linenumber + 0 AS span, CASE WHEN l_returnflag = 'N' THEN 'chat' ELSE 'execute_tool' END AS operation, CAST(floor(l_quantity) AS BIGINT) AS input_tokens FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def span_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested resource, scope and span arrays with attribute lists, flattened by the reader of traces."""
    from .sources import otlp

    line, orders = tables.read(spark, sf_dir, "lineitem"), tables.read(spark, sf_dir, "orders").select("o_orderkey")
    attribute = lambda key, field, value: F.struct(F.lit(key).alias("key"), F.named_struct(F.lit(field), value).alias("value"))
    operation = F.when(F.col("l_returnflag") == "N", "chat").otherwise("execute_tool")
    text, number = attribute("gen_ai.operation.name", "stringValue", operation), attribute("gen_ai.usage.input_tokens", "intValue", F.floor("l_quantity").cast("string"))
    span = F.struct(F.col("o_orderkey").cast("string").alias("traceId"), F.col("l_linenumber").cast("string").alias("spanId"), F.array(F.to_json(text), F.to_json(number)).alias("raw"))
    nested = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.array(F.struct(F.array(F.struct(F.collect_list(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    flat = otlp.flatten(nested)
    value = lambda key: otlp.attribute_value(F.transform("span.raw", lambda x: F.from_json(x, otlp.ATTRIBUTE)), key)
    return flat.select(F.col("span.traceId").cast("bigint").alias("trace"), F.col("span.spanId").cast("bigint").alias("span"), value("gen_ai.operation.name").getField("stringValue").alias("operation"), value("gen_ai.usage.input_tokens").getField("intValue").cast("bigint").alias("input_tokens"))


@registered(
    """SELECT l_orderkey AS message, count(*) AS fragments, min(l_linestatus) AS model, CAST(max(floor(l_quantity)) AS BIGINT) AS output_tokens, min(l_shipdate) AS first_at,
  CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'model' END AS problem FROM lineitem GROUP BY l_orderkey"""
)
def fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of streamed messages merged: fields that must agree, the largest output, the first time."""
    from .sources import sessions

    fragments = tables.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message"), F.col("l_linestatus").alias("model"), F.floor("l_quantity").cast("bigint").alias("output_tokens"), F.col("l_shipdate").alias("timestamp"))
    return sessions.merged_fragments(fragments, fixed=("model",))


@registered("SELECT role, count(*) AS calls, count(DISTINCT conv_id) AS sessions, min(turn) AS first_at FROM conversations GROUP BY role")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24, A13, A25."""
    from .sources import sessions

    return sessions.inventory_counts(tables.read(spark, sf_dir, "conversations"), "role", "conv_id", "turn")


@registered("SELECT conv_id, turn, 'cc-task-' || sha256(CAST(conv_id AS VARCHAR) || chr(0) || role || CAST(turn AS VARCHAR)) AS event_id, sha256(text) AS input_digest FROM conversations WHERE text IS NOT NULL")
def opaque_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that tell nothing of what they stand for."""
    turns = tables.read(spark, sf_dir, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", shapes.opaque_id("cc-task", F.col("conv_id").cast("string"), F.concat("role", F.col("turn").cast("string"))).alias("event_id"), F.sha2("text", 256).alias("input_digest"))


@registered("SELECT doc_id, sha256(text) AS input_digest, regexp_matches(sha256(text), '^[0-9a-f]{64}$') AS valid FROM documents WHERE text IS NOT NULL")
def id_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P26, D5."""
    docs = tables.read(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2("text", 256).alias("input_digest")).withColumn("valid", F.col("input_digest").rlike("^[0-9a-f]{64}$"))


@registered(
    """WITH v AS (SELECT doc_id, criterion, CASE WHEN doc_id % 13 = 0 AND criterion = 'b' THEN NULL WHEN criterion = 'a' THEN least(n_chars / 4000, 1.0) ELSE CASE WHEN lang = 'en' THEN 1.0 ELSE 0.25 END END AS score FROM documents CROSS JOIN (SELECT unnest(['a', 'b']) AS criterion)),
r AS (SELECT doc_id, CASE WHEN count(score) = 2 THEN sum(score * CASE criterion WHEN 'a' THEN 0.75 ELSE 0.25 END) END AS overall FROM v GROUP BY doc_id)
SELECT doc_id AS task_id, coalesce(overall >= 0.5, false) AS acceptable, CASE WHEN overall >= 0.5 THEN 8.0 ELSE 0.0 END AS business_value_usd, CASE WHEN overall < 0.5 THEN 12.0 ELSE 0.0 END AS human_minutes,
  CASE WHEN overall < 0.5 THEN 0.5 ELSE 0.0 END AS remediation_cost_usd, CASE WHEN overall < 0.5 THEN 1.0 ELSE 0.0 END AS incident_loss_usd, overall IS NULL AS judge_error FROM r"""
)
def rubric_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by criterion weighted to verdicts, and the outcome rows of accepted, rejected and unjudged tasks."""
    docs = tables.read(spark, sf_dir, "documents").withColumn("criterion", F.explode(F.array(F.lit("a"), F.lit("b"))))
    score = F.when((F.col("doc_id") % 13 == 0) & (F.col("criterion") == "b"), None).when(F.col("criterion") == "a", F.least(F.col("n_chars") / 4000, F.lit(1.0))).otherwise(F.when(F.col("lang") == "en", 1.0).otherwise(0.25))
    weights = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "criterion string, weight double")
    verdicts = labels.rubric_verdict(docs.select(F.col("doc_id").alias("task_id"), "criterion", score.alias("score")), weights, 0.5)
    return labels.outcome_rows(verdicts, {"business_value_usd": 8.0, "failure_human_minutes": 12.0, "failure_remediation_cost_usd": 0.5, "failure_incident_loss_usd": 1.0})


@registered("SELECT rate, error, round(error / (rate - error), 9) AS exact, round(error / rate, 9) AS first_order FROM (SELECT unnest([0.9, 0.5, 0.2, 0.1]::DOUBLE[]) AS rate) CROSS JOIN (SELECT unnest([0.01, 0.05]::DOUBLE[]) AS error)")
def proposition_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amplification table of the report on label error."""
    return propositions.amplification_table(spark).select("rate", "error", F.round("exact", 9).alias("exact"), F.round("first_order", 9).alias("first_order"))


@registered("SELECT true AS ratio_holds, CAST(0 AS BIGINT) AS broken_bounds, true AS flips_hold")
def propositions_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propositions 1, 3 and 4 on thousands of workloads."""
    trials = propositions.summed(propositions.workloads(spark))
    one, three, four = propositions.ratio_distortion(trials), propositions.difference_bound(trials), propositions.flip_gap(spark)
    joined = one.crossJoin(three).crossJoin(four)  # one row each
    return joined.select((F.col("worst") < 1e-9).alias("ratio_holds"), F.col("broken").alias("broken_bounds"), (F.col("excess") < 1e-9).alias("flips_hold"))


@registered(f"WITH {ROLLUP} SELECT task_id, round(CAST(eff AS DOUBLE) / 1000000, 6) AS effective_cost_usd FROM tk WHERE NOT ok ORDER BY eff DESC, task_id LIMIT 5")
def topk_failing_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    return rounded(rollup.failing_tasks(_rollup(spark, sf_dir)).select("task_id", money.dollars(F.col("effective_micro")).alias("effective_cost_usd")))


@registered("WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM labels) SELECT doc_id FROM s WHERE (rn - 1) % 20 = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: every twentieth of the sorted ids. Ranks come from counts of ranges, so no task sorts all rows."""
    ids = tables.read(spark, sf_dir, "labels").select("doc_id").repartitionByRange("doc_id").withColumn("_part", F.spark_partition_id())
    ids = graphs.cut(ids)  # written, so that both uses see the same ranges
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = ids.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = ids.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy("doc_id")))
    return local.join(F.broadcast(starts), "_part").where((F.col("_start") + F.col("_rn") - 1) % 20 == 0).select("doc_id")


@registered(
    """SELECT c_custkey AS arm, CAST(i AS BIGINT) AS call, CASE WHEN i = n THEN round(c_acctbal, 6) ELSE 0.0 END AS cost_usd FROM (SELECT c_custkey, c_acctbal, 1 + c_custkey % 5 AS n FROM customer), LATERAL (SELECT unnest(range(1, n + 1)) AS i)"""
)
def call_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of n calls whose last carries its cost."""
    from .sources import public_runs

    runs = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("arm"), (F.col("c_custkey") % 5 + 1).alias("api_calls"), F.col("c_acctbal").alias("instance_cost_usd"))
    return rounded(public_runs.call_events(runs).select("arm", F.col("call").cast("bigint").alias("call"), F.col("direct_cost_usd").alias("cost_usd")))


@registered(
    """WITH t AS (SELECT o_custkey AS arm, o_totalprice / 10000 AS c, o_orderstatus <> 'P' AS ok FROM orders)
SELECT arm, round(CAST(sum(CAST(c AS DECIMAL(28,6))) AS DOUBLE) / count(*), 12) AS cost_per_attempt_usd, round(count(*) FILTER (ok) / count(*), 6) AS acceptable_rate, round(quantile_disc(c, 0.95), 6) AS p95_cost_usd, round(max(c), 6) AS max_cost_usd FROM t GROUP BY arm"""
)
def derived_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy from what a reference arm did."""
    from .sources import public_runs

    runs = tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("arm"), (F.col("o_totalprice") / 10000).alias("instance_cost_usd"), (F.col("o_orderstatus") != "P").alias("resolved"))
    found = public_runs.reference_policy(runs, "arm")
    return rounded(found.drop("cost_per_attempt_usd")).join(found.select("arm", F.round("cost_per_attempt_usd", 12).alias("cost_per_attempt_usd")), "arm")


@registered(
    """WITH RECURSIVE st AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
e AS (SELECT DISTINCT user_id, a, b FROM st WHERE b IS NOT NULL),
walk AS (SELECT user_id, a AS low, b AS at, CASE WHEN a = b THEN [a] ELSE [a, b] END AS path, a = b AS closed FROM e WHERE b >= a
  UNION ALL SELECT w.user_id, w.low, e.b, CASE WHEN e.b = w.low THEN w.path ELSE list_append(w.path, e.b) END, e.b = w.low FROM walk w JOIN e ON e.user_id = w.user_id AND e.a = w.at WHERE NOT w.closed AND (e.b = w.low OR (e.b > w.low AND NOT list_contains(w.path, e.b))))
SELECT CAST(user_id AS VARCHAR) AS task_id, count(*) > 0 AS cyclic FROM walk WHERE closed GROUP BY user_id"""
)
def cyclic_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users among whose events some lead back to where they began."""
    return cycle_findings(spark, sf_dir).groupBy("task_id").agg((F.count("*") > 0).alias("cyclic"))


@registered()
def cycle_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed cycles among the event types that follow each other for a user."""
    walk = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = tables.read(spark, sf_dir, "events").withColumn("next", F.lead("event_type").over(walk)).where("next is not null")
    return sequences.cycle_findings(steps.select("user_id", "event_type", "next").distinct(), "user_id", "event_type", "next").select("task_id", F.array_join("cycle", ">").alias("cycle"))


@registered("""SELECT event_type, CASE WHEN props IS NULL THEN '["object",[]]' ELSE '["object",[' || array_to_string(list_transform(list_sort(json_keys(props)), lambda k: '["' || k || '","' || CASE json_type(props, '$.' || k) WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' ELSE lower(json_type(props, '$.' || k)) END || '"]'), ',') || ']]' END AS shape, count(*) AS events FROM events GROUP BY ALL""")
def argument_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each shape of arguments comes with each name."""
    calls = tables.read(spark, sf_dir, "events").withColumn("shape", shapes.argument_shape(F.col("props")))
    return calls.groupBy("event_type", "shape").agg(F.count("*").alias("events"))
