"""Star-schema tables as evidence: line items are events, orders are tasks with outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RATES, Baseline, Policy

BASELINE = Baseline("manual handling", 5.0, 0.70, 8.0)
POLICY = Policy(60.0, 0.80, 2.0, 8.0, 0.15, 8)
PRICE_CARD = (("edge-small", 0.15, 0.60), ("frontier-large", 2.50, 10.00))
#: Arms of the paired queries: (arm, every how many tasks it flips the label, factor of its cost); 0 flips none.
ARMS = (("balanced", 7, 0.6), ("cheap", 3, 0.4), ("premium", 0, 1.5), ("reference", 0, 1.0))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICE_CARD), RATES)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events but for their ids and timestamps; ``_seq`` orders those of a task."""
    line = read(spark, sf_dir, "lineitem")
    model = F.col("l_returnflag") == "N"
    return line.select(
        F.col("l_orderkey").alias("task_id"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus").alias("_seq"),
        F.when(model, "model").otherwise("tool").alias("event_type"),
        F.col("l_linestatus").alias("name"),
        F.when(F.col("l_linestatus") == "O", "edge-small").otherwise("frontier-large").alias("model"),
        F.floor(F.col("l_quantity") * 100).cast("bigint").alias("input_tokens"),
        F.floor(F.col("l_quantity") * 10).cast("bigint").alias("output_tokens"),
        F.when(~model, F.abs("l_tax")).alias("direct_cost_usd"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("status"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    urgent, partial = F.substring("o_orderpriority", 1, 1).isin("1", "2"), F.col("o_orderstatus") == "P"
    return orders.select(
        F.col("o_orderkey").alias("task_id"),
        (~partial).alias("acceptable"),
        (F.col("o_totalprice") / 10000.0).alias("business_value_usd"),
        F.when(urgent, 6.0).otherwise(0.0).alias("human_minutes"),
        F.when(partial, 0.5).otherwise(0.0).alias("remediation_cost_usd"),
        F.when(partial & (F.col("o_orderpriority") == "1-URGENT"), 3.0).otherwise(0.0).alias("incident_loss_usd"),
    )
