"""Seeded shuffles and draws; a row's place depends on its key and the seed, so a retried task repeats it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shuffled(rows: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Rows in an order that the seed decides; equal hashes are ordered by the key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def inverse_cdf(outcomes: DataFrame, value: str, weight: str) -> DataFrame:
    """(value, lo, hi): each outcome's share of [0, 1), in the order of values; weights of 0 or less and nulls have none.

    A table of outcomes has one row per outcome, not per draw, so that one window over it stays small.
    """
    sound = outcomes.where(F.col(weight) > 0).groupBy(value).agg(F.sum(F.col(weight).cast("double")).alias("_w"))
    so_far = F.sum("_w").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("_w").over(Window.partitionBy())
    return sound.select(value, ((so_far - F.col("_w")) / total).alias("lo"), (so_far / total).alias("hi"))


def draw(spark: SparkSession, outcomes: DataFrame, value: str, weight: str, count: int, seed: int, cells: int = 1024) -> DataFrame:
    """(draw, value): `count` draws with replacement. The join is on equal cells of the unit interval."""
    unit = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / float(1 << 52)
    draws = spark.range(count).select(F.col("id").alias("draw"), unit.alias("_at")).withColumn("_cell", F.floor(F.col("_at") * cells))
    spans = inverse_cdf(outcomes, value, weight)
    spans = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    # The last share ends at 1 but for rounding.
    inside = (F.col("_at") >= F.col("lo")) & ((F.col("_at") < F.col("hi")) | (F.col("hi") > 1 - 1e-12))
    return draws.join(spans, "_cell").where(inside).groupBy("draw").agg(F.min(F.struct("lo", value)).alias("s")).select("draw", F.col(f"s.{value}").alias(value))
