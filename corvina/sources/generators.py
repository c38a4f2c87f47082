"""Seeded synthetic vectors: gaussian clouds, stars and uniform points. Rows are made where they are needed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _normals(row: Column, dims: int, seed: int) -> list[Column]:
    """Normal numbers from hashes of the row (Box-Muller), the same however the rows are dealt."""
    uniform = lambda salt: (F.shiftrightunsigned(F.xxhash64(row, F.lit(seed), F.lit(salt)), 11) + 1) / F.lit(2.0**53)
    return [F.sqrt(-2 * F.log(uniform(2 * d))) * F.cos(2 * math.pi * uniform(2 * d + 1)) for d in range(dims)]


def gaussian_clouds(spark: SparkSession, classes: int, per_class: int, dims: int, separation: float, seed: int) -> DataFrame:
    """(id, label, v): per class a unit normal cloud around a centre drawn at `separation` times a normal vector."""
    rows = spark.range(classes * per_class).withColumn("label", (F.col("id") % classes).cast("int"))
    own, centre = _normals(F.col("id"), dims, seed), _normals(F.col("label"), dims, seed + 1)
    return rows.select("id", "label", F.array(*[x + separation / math.sqrt(2 * dims) * c for x, c in zip(own, centre, strict=True)]).alias("v"))


def stars(spark: SparkSession, classes: int, arms: int, per_arm: int, dims: int, seed: int) -> DataFrame:
    """(id, label, arm, v): each class has arms that lead from a common middle in directions of their own."""
    rows = spark.range(classes * arms * per_arm).select("id", (F.col("id") % classes).cast("int").alias("label"), (F.floor(F.col("id") / classes) % arms).cast("int").alias("arm"))
    along, noise = F.abs(_normals(F.col("id"), 1, seed)[0]) * 5, _normals(F.col("id"), dims, seed + 1)
    way = _normals(F.col("label") * arms + F.col("arm"), dims, seed + 2)
    return rows.select("id", "label", "arm", F.array(*[along * w + 0.3 * x for w, x in zip(way, noise, strict=True)]).alias("v"))


def uniform_points(spark: SparkSession, count: int, dims: int, labels: int, seed: int) -> DataFrame:
    """(id, label, v): points of the unit cube with labels drawn evenly."""
    u = lambda salt: F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(salt)), 11) / F.lit(2.0**53)
    return spark.range(count).select("id", F.floor(u(-1) * labels).cast("int").alias("label"), F.array(*[u(d) for d in range(dims)]).alias("v"))
