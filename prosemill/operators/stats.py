"""Length statistics, run totals and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("min", "max", "mean", "median", "p25", "p75", "p90", "std_dev")


def nearest_rank(sorted_array, q: float) -> Column:
    """Element floor(n q) of a sorted array, the last at most."""
    n = F.size(sorted_array)
    return F.get(sorted_array, F.least(F.floor(n * F.lit(q)).cast("int"), n - 1)).cast("double")


def array_stats(lengths) -> list[Column]:
    """The eight statistics of an array of lengths, without exploding it; nulls for an empty one."""
    s = F.sort_array(lengths)
    n = F.size(s)
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
    half = (n / 2).cast("int")
    median = F.when(n % 2 == 1, F.get(s, half).cast("double")).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2.0)
    std = F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.pow(x - mean, F.lit(2.0))) / n)
    out = [F.get(s, F.lit(0)).cast("long"), F.get(s, n - 1).cast("long"), mean, median, nearest_rank(s, 0.25), nearest_rank(s, 0.75), nearest_rank(s, 0.9), std]
    return [F.when(n > 0, c).alias(a) for c, a in zip(out, NAMES)]


def length_stats(df: DataFrame, by, length_col="length", prefix="") -> DataFrame:
    """Statistics of lengths by group, over a histogram: one row a distinct length, so no group's lengths are ever gathered.

    Quantiles are nearest-rank: the element at floor(n q), counted from 0.
    """
    by = [by] if isinstance(by, str) else list(by)
    hist = df.where(F.col(length_col).isNotNull()).groupBy(*by, F.col(length_col).cast("long").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    return weighted_stats(hist, by, "x", "c", prefix)


def weighted_stats(hist: DataFrame, by, x: str, c: str, prefix="") -> DataFrame:
    """``length_stats`` of values ``x`` that count ``c`` times each."""
    w = Window.partitionBy(*by).orderBy(x)
    every = Window.partitionBy(*by)
    h = hist.withColumn("_n", F.sum(c).over(every)).withColumn("_hi", F.sum(c).over(w)).withColumn("_lo", F.col("_hi") - F.col(c)).withColumn("_m", F.sum(F.col(x) * F.col(c)).over(every) / F.col("_n"))

    def at(k):
        return F.max(F.when((F.col("_lo") <= k) & (k < F.col("_hi")), F.col(x)))

    def rank(q):
        return at(F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1)).cast("double")

    n = F.col("_n")
    median = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0
    var = F.sum(F.pow(F.col(x) - F.col("_m"), F.lit(2.0)) * F.col(c)) / F.sum(c)
    out = [F.min(x).cast("long"), F.max(x).cast("long"), F.max("_m"), median, rank(0.25), rank(0.75), rank(0.9), F.sqrt(var)]
    return h.groupBy(*by).agg(F.sum(c).alias("n"), *[v.alias(prefix + a) for v, a in zip(out, NAMES)])


def file_stats(sentences: DataFrame, key="doc_id", length=None) -> DataFrame:
    """(key, n, statistics) of the lengths of normalized sentences by document."""
    return length_stats(sentences.select(key, (length if length is not None else F.length("sentence")).alias("length")), key)


def aggregate_length_stats(files: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """One row over all files. Each counts with its whole mean, as often as it has sentences; given ``exact`` lengths, those count."""
    if exact is not None:
        hist = exact.groupBy(F.lit(0).alias("g"), F.col("length").cast("long").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    else:
        hist = files.where("n > 0").groupBy(F.lit(0).alias("g"), F.floor("mean").alias("x")).agg(F.sum("n").alias("c"))
    return weighted_stats(hist, ["g"], "x", "c").drop("g")


def run_totals(files: DataFrame) -> DataFrame:
    """Sums over file rows (sentences, bytes, chars, status)."""
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("sentences"), F.lit(0)).cast("long").alias("sentences"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("chars"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "skipped", "failed")],
    )


def rate(amount, seconds) -> Column:
    """Amount a second; 0 where no time passed."""
    return F.coalesce(F.try_divide(F.col(amount).cast("double"), F.col(seconds).cast("double")), F.lit(0.0))


def with_throughput(files: DataFrame, seconds="seconds") -> DataFrame:
    return files.withColumns({"chars_per_sec": rate("chars", seconds), "bytes_per_sec": rate("bytes", seconds)})


def leaderboard(df: DataFrame, value: str, baseline: str, tool="tool") -> DataFrame:
    """Tools by descending value, with their share of the best and multiple of a baseline tool. One row a tool: a small frame."""
    every = Window.partitionBy(F.lit(0))
    base = F.max(F.when(F.col(tool) == baseline, F.col(value))).over(every)
    ranked = F.rank().over(every.orderBy(F.desc(value)))
    return df.withColumns({"place": ranked, "relative": F.col(value) / F.max(value).over(every), "speed_up": F.try_divide(F.col(value), base)})


def throughput_summary(df: DataFrame, value: str, chars: str) -> DataFrame:
    return df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), F.sum(chars).alias("chars"))
