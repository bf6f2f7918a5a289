"""Shared storage, stable ids and connected components for the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go if the session names no shared folder and has no executors but itself (tests, notebooks).
LOCAL_FALLBACK = "/tmp/verdigris-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or LOCAL_FALLBACK).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and the files outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verdigris-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of the undirected edges (a long, b long).

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each round is two aggregations by
    node joined back to the edges, so a node with many neighbours is an ordinary skewed join that AQE splits.
    Nodes without edges are not returned; no edges give no rows. Edges from a node to itself add nothing.
    """
    spark = edges.sparkSession
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
    else:
        raise RuntimeError("connected components did not settle")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return stars.union(roots)
