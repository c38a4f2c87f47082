"""Nearest neighbours in a plane, searched strip by strip along the first axis."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import PCA, Bucketizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.session import cut

#: Training points of a strip, at about, and strips at most: their borders are kept on the driver.
STRIP, STRIPS = 1_024, 100_000


def principal_axes(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the mean of the vectors, and their first k principal directions, one a row."""
    mean = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).orderBy("pos").collect()
    centre = np.array([r.m for r in mean])
    centred = rows.select(array_to_vector(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(m)) for m in centre]), lambda x, m: x - m)).alias("_v"))
    return centre, PCA(k=k, inputCol="_v", outputCol="_p").fit(centred).pc.toArray().T


def projected(rows: DataFrame, vector: str, centre: np.ndarray, axes: np.ndarray) -> DataFrame:
    """rows with `vector` replaced by its places along the axes."""
    middle = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(m)) for m in centre]), lambda x, m: x - m)
    along = [F.aggregate(F.zip_with(middle, F.array(*[F.lit(float(a)) for a in axis]), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x) for axis in axes]
    return rows.withColumn(vector, F.array(*along))


def strip_nearest(train: DataFrame, test: DataFrame, strip: int = STRIP) -> DataFrame:
    """(test_id, train_id, label, distance, measured): each point of test (id, v) with its nearest of train (id, v, label).

    v holds two numbers. Training points are cut into strips of about `strip` points along the first one. A test point
    is measured against its own strip, then against the next ones on both sides, two, four and so on, as long as a
    strip's nearer edge is no farther than the best so far; `measured` counts the pairs. Distances are squared; of
    equally near points the smaller id is taken. Points with a null, NaN or infinite place take no part, and so do
    test points when there is no training point. A strip that equal first places make large is split by the join as
    a skewed key.
    """
    x, y = (F.element_at("v", i).cast("double") for i in (1, 2))
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    known = train.select(F.col("id").alias("train_id"), x.alias("u"), y.alias("w"), "label").where(sound("u") & sound("w"))
    asked = test.select(F.col("id").alias("test_id"), x.alias("x"), y.alias("y")).where(sound("x") & sound("y"))
    n = known.count()
    parts = min(STRIPS, math.ceil(n / strip))
    borders = known.agg(F.percentile_approx("u", [i / parts for i in range(1, parts)], 1_000_000).alias("q")).first()["q"] if parts > 1 else []
    splits = [-math.inf, *sorted(set(borders)), math.inf]

    def place(df: DataFrame, c: str) -> DataFrame:
        if len(splits) == 2:
            return df.withColumn("strip", F.lit(0))
        return Bucketizer(splits=splits, inputCol=c, outputCol="_s").transform(df).withColumn("strip", F.col("_s").cast("int")).drop("_s")

    known = cut(place(known, "u"))
    edges = cut(known.groupBy("strip").agg(F.min("u").alias("lo"), F.max("u").alias("hi"), F.count("*").alias("size")))

    blank = [F.lit(None).cast(known.schema["train_id"].dataType).alias("train_id"), F.lit(None).cast(known.schema["label"].dataType).alias("label")]
    state = cut(place(asked, "x").select("test_id", "x", "y", F.col("strip").alias("at"), F.lit(math.inf).alias("distance"), *blank, F.lit(0).cast("long").alias("measured")))
    done, reach = None, 0
    gap = F.greatest(F.col("lo") - F.col("x"), F.col("x") - F.col("hi"), F.lit(0.0))
    while True:
        ring = F.array(F.lit(0)) if not reach else F.concat(F.sequence(F.lit(-reach), F.lit(-(reach // 2) - 1)), F.sequence(F.lit(reach // 2 + 1), F.lit(reach)))
        near = state.select("test_id", "x", "y", "distance", F.explode(F.transform(ring, lambda i: F.col("at") + i)).alias("strip")).join(F.broadcast(edges), "strip").where(gap * gap <= F.col("distance"))  # at most STRIPS rows
        apart = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("w")) * (F.col("y") - F.col("w"))
        met = near.select("test_id", "x", "y", "strip").join(known, "strip").groupBy("test_id").agg(F.min(F.struct(apart.alias("d"), F.col("train_id").alias("t"), F.col("label").alias("l"))).alias("new"), F.count("*").alias("more"))
        better = F.col("new").isNotNull() & ((F.col("new.d") < F.col("distance")) | ((F.col("new.d") == F.col("distance")) & (F.col("train_id").isNull() | (F.col("new.t") < F.col("train_id")))))
        pick = lambda field, old: F.when(better, F.col(f"new.{field}")).otherwise(F.col(old)).alias(old)  # noqa: E731, B023
        state = state.join(met, "test_id", "left").select("test_id", "x", "y", "at", pick("d", "distance"), pick("t", "train_id"), pick("l", "label"), (F.col("measured") + F.coalesce("more", F.lit(0))).alias("measured"))
        # A point is open while the next strip on either side may hold a nearer one; farther strips are farther.
        beyond = state.select("test_id", "x", "distance", F.explode(F.array(F.col("at") - reach - 1, F.col("at") + reach + 1)).alias("strip")).join(F.broadcast(edges), "strip")
        open_ids = beyond.where(gap * gap <= F.col("distance")).select("test_id").distinct().withColumn("open", F.lit(True))
        state = cut(state.join(open_ids, "test_id", "left"))
        ended = state.where("open is null").select("test_id", "train_id", "label", "distance", "measured")
        done = ended if done is None else done.union(ended)
        state = state.where("open").drop("open")
        if state.isEmpty():
            return done.where("train_id is not null")
        reach = max(1, 2 * reach)
