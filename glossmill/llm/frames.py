"""Spark helpers that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast, after it was counted.
BROADCAST_ROWS = 200_000


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable copy in the cluster's shared folder, so a lost executor costs no earlier work.

    The folder is spark.checkpoint.dir; only where that is unset and all of Spark is one local process (as in tests) a
    temporary one is used, as no other machine has to reach it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = context.getConf().get("spark.checkpoint.dir")
        if not where:
            if not re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", context.master):
                raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
            import tempfile

            where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast only if it was counted and found small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): the smallest node reachable; alternating large and small stars.

    Each round is two grouped minima and two equi-joins; nothing is collected but a count and a checksum."""

    def least(sym: DataFrame) -> DataFrame:
        return sym.groupBy("u").agg(F.min("v").alias("m"))

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = stamp(e)
    while seen[0]:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = sym.join(least(sym), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        first = least(large)
        joined = large.join(first, "u")
        e = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(first.withColumnRenamed("m", "v")).distinct()
        e = checkpoint(e)
        now = stamp(e)
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
