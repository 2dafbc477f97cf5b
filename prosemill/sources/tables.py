"""Reading Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer bytes in fewer files than there are cores is spread over the cores.
SMALL = 1 << 30


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder. A small one, which may be one row group and so one task, is spread; others are read as they lie."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL:
        return df.repartition(cores)
    return df
