"""Hypothesis tests: moments and ranks by Spark aggregates, tail probabilities on the aggregated rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d, c = 1 / (1 + term * d), 1 + term / c
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-tailed probability of Student's t; null where t or df is missing, 0 for an infinite t."""

    def one(x: float | None, n: float | None) -> float | None:
        if x is None or n is None or math.isnan(x) or math.isnan(n) or n <= 0:
            return None
        return 0.0 if math.isinf(x) else incomplete_beta(n / (n + x * x), n / 2, 0.5)

    return pd.Series([one(x, n) for x, n in zip(t, df, strict=True)], dtype="float64")


def _t(mean: Column, error: Column) -> Column:
    """mean / error; infinite where only the error is 0, null where both are."""
    infinite = F.when(mean > 0, F.lit(float("inf"))).when(mean < 0, F.lit(float("-inf")))
    return F.when(error > 0, F.try_divide(mean, error)).otherwise(infinite)


def one_sample_t(rows: DataFrame, groups: list[str], x: str) -> DataFrame:
    """Per group (n, t, p, below): two-tailed test of a mean of 0; fewer than two values give p = 1 and below = false.

    Null values take no part. `below` tells that the mean is negative.
    """
    m = rows.groupBy(*groups).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    m = m.withColumn("t", F.when(F.col("n") >= 2, _t(F.col("mean"), F.col("sd") / F.sqrt("n"))))
    p = F.when(F.col("n") < 2, 1.0).otherwise(F.coalesce(student_p("t", (F.col("n") - 1).cast("double")), F.lit(1.0)))
    return m.select(*groups, "n", "t", p.alias("p"), ((F.col("n") >= 2) & (F.coalesce("mean", F.lit(0.0)) < 0)).alias("below"))


def paired_t(rows: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """one_sample_t of the differences x - y."""
    return one_sample_t(rows.withColumn("_difference", F.col(x) - F.col(y)), groups, "_difference")


def welch_t(rows: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Per group (t, nu, p, below): unequal variances, whole degrees of freedom; `below` follows the paired differences."""
    m = rows.groupBy(*groups).agg(
        (F.avg(x) - F.avg(y)).alias("gap"), F.avg(F.col(x) - F.col(y)).alias("paired"), F.count(x).alias("n"), F.count(y).alias("k"),
        F.try_divide(F.var_samp(x), F.count(x)).alias("vx"), F.try_divide(F.var_samp(y), F.count(y)).alias("vy"),
    )
    v = F.col("vx") + F.col("vy")
    nu = F.floor(F.try_divide(v * v, F.try_divide(F.col("vx") ** 2, F.col("n") - 1) + F.try_divide(F.col("vy") ** 2, F.col("k") - 1)))
    m = m.withColumn("t", _t(F.col("gap"), F.sqrt(v))).withColumn("nu", nu.cast("double"))
    return m.select(*groups, "t", "nu", F.coalesce(student_p("t", "nu"), F.lit(1.0)).alias("p"), (F.col("paired") < 0).alias("below"))


def mann_whitney(rows: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Per group (u, z, p): the U statistic of x and its two-tailed normal approximation with the tie correction.

    Values are counted first, so the window that ranks them runs over distinct values of a group.
    """
    long = rows.select(*groups, F.explode(F.array(F.struct(F.col(x).cast("double").alias("v"), F.lit(1).alias("x")), F.struct(F.col(y).cast("double").alias("v"), F.lit(0).alias("x")))).alias("s"))
    counts = long.where("s.v is not null").groupBy(*groups, F.col("s.v").alias("v")).agg(F.sum("s.x").alias("nx"), F.sum(1 - F.col("s.x")).alias("ny"))
    before = F.coalesce(F.sum("ny").over(Window.partitionBy(*groups).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ties = F.col("nx") + F.col("ny")
    u = counts.withColumn("_u", F.col("nx") * (before + F.col("ny") / 2)).groupBy(*groups).agg(
        F.sum("_u").alias("u"), F.sum("nx").cast("double").alias("n"), F.sum("ny").cast("double").alias("k"), F.sum(ties.cast("double") ** 3 - ties).alias("tied")
    )
    total = F.col("n") + F.col("k")
    spread = F.sqrt(F.col("n") * F.col("k") / 12 * (total + 1 - F.try_divide(F.col("tied"), total * (total - 1))))
    z = F.try_divide(F.col("u") - F.col("n") * F.col("k") / 2, spread)
    return u.withColumn("z", z).select(*groups, "u", "z", F.coalesce(normal_p("z"), F.lit(1.0)).alias("p"))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-tailed probability of a standard normal value."""
    return pd.Series([None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)) for x in z], dtype="float64")


def confusable_share(results: DataFrame, setting: str, trial: str, error: str, level: float = 0.05) -> DataFrame:
    """(best, others, confusable, share): how many settings a paired test cannot tell from the one with the least mean error.

    `results` has one row per setting and trial; ties for the best go to the smaller setting. The best setting is
    found by a two-step aggregate and joined on the trial.
    """
    means = results.groupBy(setting).agg(F.avg(error).alias("_m")).where("_m is not null")
    best = means.agg(F.min(F.struct("_m", setting)).alias("b")).select(F.col(f"b.{setting}").alias("best"))
    base = results.join(F.broadcast(best), F.col(setting) == F.col("best")).select("best", F.col(trial).alias("_trial"), F.col(error).alias("_best_error"))
    pairs = results.join(base, F.col(trial) == F.col("_trial")).where(F.col(setting) != F.col("best"))
    tested = paired_t(pairs, ["best", setting], "_best_error", error)
    unsure = F.sum((~F.col("below") | (F.col("p") > level)).cast("long"))
    return tested.groupBy("best").agg(F.count("*").alias("others"), unsure.alias("confusable")).withColumn("share", F.col("confusable") / F.col("others"))
