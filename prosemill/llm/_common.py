"""Shared plan pieces: cutting lineage in the shared folder, connected components."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of spark.checkpoint.dir, which all executors share.

    Only where that is unset and Spark runs in one local process is a temporary folder taken.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if at := spark.conf.get("spark.checkpoint.dir", None):
            sc.setCheckpointDir(at)
        elif sc.master.split("[")[0] == "local":
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="prosemill-"))
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Lets Spark delete shuffle and checkpoint files that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; the component is its least node.

    Alternates large-star and small-star steps (a logarithmic number in practice);
    each is one shuffle of the edges, and each round is cut from its lineage.
    Rows with a null end and self loops count for nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, seen = cut(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least("u", F.min("v").over(w))).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.withColumn("m", F.min("v").over(w))
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def unused(columns, *names) -> list[str]:
    """Names like the given ones that none of the columns has, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
