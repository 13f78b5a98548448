"""Tests on series of runs, and windows that stand out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import normal_p_value, t_p_value


def paired_t(differences: DataFrame, by: list[str], value: str = "difference") -> DataFrame:
    """by, n, mean, t: the paired t statistic of differences; infinite for equal non-zero ones, null for one."""
    s = differences.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    t = F.when(F.col("n") < 2, None).when(F.col("_s") > 0, F.try_divide(F.col("mean"), F.col("_s") / F.sqrt("n"))).when(F.col("mean") != 0, F.signum("mean") * F.lit(float("inf")))
    return s.withColumn("t", t).drop("_s")


def significant_windows(a: DataFrame, b: DataFrame, level: float = 0.05, spans: DataFrame | None = None) -> DataFrame:
    """Windows in which two groups' run means (run, window_no, mean_ce) differ by a paired t-test."""
    j = a.select("run", "window_no", F.col("mean_ce").alias("_a")).join(b.select("run", "window_no", F.col("mean_ce").alias("_b")), ["run", "window_no"])
    found = paired_t(j.select("window_no", (F.col("_a") - F.col("_b")).alias("difference")), ["window_no"])
    found = found.withColumn("p", t_p_value(F.col("t"), F.col("n") - 1)).filter(F.col("p") < level)
    return found.join(spans, "window_no") if spans is not None else found


def window_changes(means: DataFrame, by: list[str] = ("group",)) -> DataFrame:
    """by, run, window_no, difference to the run's window before."""
    before = means.select(*by, "run", (F.col("window_no") + 1).alias("window_no"), F.col("mean_ce").alias("_before"))
    return means.join(before, [*by, "run", "window_no"]).select(*by, "run", "window_no", (F.col("mean_ce") - F.col("_before")).alias("difference"))


def significant_changes(means: DataFrame, level: float = 0.05, by: list[str] = ("group",)) -> DataFrame:
    """Windows whose run means differ from the window before by a paired t-test."""
    found = paired_t(window_changes(means, by), [*by, "window_no"])
    return found.withColumn("p", t_p_value(F.col("t"), F.col("n") - 1)).filter(F.col("p") < level)


def mann_whitney(values: DataFrame, by: list[str], side: str = "side", value: str = "ce") -> DataFrame:
    """by, n1, n2, u, z of the values of sides a and b: average ranks, tie-corrected normal approximation with continuity."""
    key = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, value)
    r = values.withColumn("_ties", F.count(F.lit(1)).over(ties)).withColumn("_rank", F.rank().over(key.orderBy(value)) + (F.col("_ties") - 1) / 2)
    s = r.groupBy(*by).agg(
        F.sum((F.col(side) == "a").cast("long")).alias("n1"), F.sum((F.col(side) == "b").cast("long")).alias("n2"), F.sum(F.when(F.col(side) == "a", F.col("_rank"))).alias("_r1"), F.sum(F.col("_ties") * F.col("_ties") - 1).alias("_t")
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    s = s.filter((n1 > 0) & (n2 > 0)).withColumn("u", F.col("_r1") - n1 * (n1 + 1) / 2)
    deviation = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_t") / (n * (n - 1))))
    far = F.abs(F.col("u") - n1 * n2 / 2) - 0.5
    return s.withColumn("z", F.try_divide(F.greatest(far, F.lit(0.0)), deviation)).drop("_r1", "_t")


def significant_windows_mwu(a: DataFrame, b: DataFrame, level: float = 0.05, share: float = 0.8) -> DataFrame:
    """Windows in which at least ``share`` of the runs differ by a Mann-Whitney test of the texts' ce (run, window_no, ce)."""
    rows = a.select("run", "window_no", "ce", F.lit("a").alias("side")).unionByName(b.select("run", "window_no", "ce", F.lit("b").alias("side")))
    p = mann_whitney(rows, ["run", "window_no"]).withColumn("p", normal_p_value(F.col("z")))
    runs = p.groupBy("window_no").agg(F.avg((F.col("p") < level).cast("double")).alias("share"), F.count(F.lit(1)).alias("n_runs"))
    return runs.filter(F.col("share") >= share)


def key_windows(values: DataFrame, by: list[str] = ("group",), value: str = "value", repeat_last: bool = False) -> DataFrame:
    """Windows further than a standard deviation from the series' mean; ``repeat_last`` counts the last value twice, for parity."""
    series = values
    if repeat_last:
        last = values.groupBy(*by).agg(F.max_by(value, "window_no").alias(value))
        series = values.select(*by, value).unionByName(last.select(*by, value))
    s = series.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    return values.join(s, list(by)).filter(F.abs(F.col(value) - F.col("_mean")) > F.col("_std")).drop("_mean", "_std")
