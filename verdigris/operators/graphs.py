"""Ancestors in forests of parent pointers, by pointer doubling: a chain of n takes log2(n) joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EvidenceError


def nearest_marked(nodes: DataFrame, node: str, parent: str, marked: str, max_depth: int = 1 << 20) -> DataFrame:
    """(node, nearest): the nearest node at or above each for which ``marked`` is true; null if a chain has none.

    A parent that isn't a node, or a cycle, is refused.
    """
    known = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.col(marked).alias("hit"))
    lost = known.where("up is not null").join(known.select(F.col("node").alias("up")), "up", "left_anti")
    if not lost.isEmpty():
        raise EvidenceError("a parent is not among the nodes")
    state = known.select("node", F.when(F.col("hit"), F.col("node")).alias("found"), F.when(~F.col("hit"), F.col("up")).alias("up"))
    steps = 0
    while not state.where("found is null and up is not null").isEmpty():
        above = state.select(F.col("node").alias("up"), F.col("found").alias("f2"), F.col("up").alias("u2"))
        state = state.join(above, "up", "left").select("node", F.coalesce("found", "f2").alias("found"), F.when(F.coalesce("found", "f2").isNull(), F.col("u2")).alias("up"))
        steps += 1
        state = cut(state)
        if 1 << steps > max_depth:
            raise EvidenceError("the parents form a cycle")
    return state.select("node", F.col("found").alias("nearest"))


def depths(nodes: DataFrame, node: str, parent: str, max_depth: int = 1 << 20) -> DataFrame:
    """(node, root, depth), roots at 0, by pointer doubling: each step joins every node with what its pointer has found already.

    A parent that isn't a node, or a cycle, is refused.
    """
    known = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    lost = known.where("up is not null").join(known.select(F.col("node").alias("up")), "up", "left_anti")
    if not lost.isEmpty():
        raise EvidenceError("a parent is not among the nodes")
    state = known.select("node", F.coalesce("up", "node").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), "up")
    steps = 0
    while not state.where("up is not null").isEmpty():
        above = state.select(F.col("node").alias("up"), F.col("top").alias("t2"), F.col("depth").alias("d2"), F.col("up").alias("u2"))
        state = state.join(above, "up", "left").select("node", F.coalesce("t2", "top").alias("top"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("u2").alias("up"))
        steps += 1
        state = cut(state)
        if 1 << steps > max_depth:
            raise EvidenceError("the parents form a cycle")
    return state.select("node", F.col("top").alias("root"), "depth")


def cut(state: DataFrame) -> DataFrame:
    """The rows written to the shared folder that the session names and read back; where it names none, as in notebooks, they are kept in memory."""
    spark = state.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        return state.checkpoint() if spark.sparkContext.getCheckpointDir() else state.persist()
    path = f"{folder.rstrip('/')}/verdigris-graph-{uuid.uuid4().hex}"
    state.write.parquet(path)
    return spark.read.schema(state.schema).parquet(path)
