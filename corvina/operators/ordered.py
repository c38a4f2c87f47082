"""Ordered operators without a window form: greedy suppression, adaptive histogram, range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.session import cut


def greedy_suppress(rows: DataFrame, label: str, length: str, order: list[str], within: float) -> DataFrame:
    """Keep a row unless a row kept before it has the same label and a length within `within`.

    Of rows with one label and length only the first in order can stay, so a label's distinct lengths, not its rows,
    are folded in one task. Rows without a finite length are near nothing and all stay.
    """
    rows = rows.select(label, *order, F.col(length).cast("double").alias("_len"))
    finite = F.col("_len").isNotNull() & ~F.isnan("_len") & (F.abs("_len") < float("inf"))
    firsts = rows.where(finite).groupBy(label, "_len").agg(F.min(F.struct(*order)).alias("_first"))
    items = F.sort_array(F.collect_list(F.struct(*[F.col(f"_first.{c}").alias(c) for c in order], F.col("_len"))))
    kept = F.aggregate(
        items,
        F.array().cast(f"array<{items_type(rows, order)}>"),
        lambda acc, x: F.when(F.exists(acc, lambda k: F.abs(k["_len"] - x["_len"]) <= within), acc).otherwise(F.concat(acc, F.array(x))),
    )
    folded = firsts.groupBy(label).agg(kept.alias("kept")).select(label, F.explode("kept").alias("k")).select(label, *[F.col(f"k.{c}").alias(c) for c in order], F.col("k._len").alias(length))
    return folded.union(rows.where(~F.coalesce(finite, F.lit(False))).withColumnRenamed("_len", length))


def items_type(rows: DataFrame, order: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return "struct<" + ",".join(f"{c}:{kinds[c]}" for c in order) + ",_len:double>"


def adaptive_histogram(rows: DataFrame, group: str, value: str, min_size: int, resolution: int) -> DataFrame:
    """Per group buckets (mean, density) of at least min_size values and 1/resolution of the range; the last open one is dropped.

    A bucket ends at the first value that lies min_size places and the width beyond its start, and the next starts there.
    Every value finds that place at once, by its rank among the values and the values moved by the width, so no group
    is gathered. A group has at most resolution + 1 starts; they are found by doubling hops, in log2(resolution) joins.
    Values that are null or not finite take no part; groups of one value have no bucket; a null group is a group.
    """
    x = F.col(value).cast("double")
    finite = rows.select(F.col(group).alias("g"), x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    stats = finite.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) / resolution).alias("width")).where("width > 0")
    ranked = cut(global_rank(finite.join(stats, F.col("g").eqNullSafe(F.col("_g"))).drop("_g"), [F.col("g"), F.col("x")], "i"))
    ends = ranked.groupBy("g").agg(F.min("i").alias("first"), F.max("i").alias("last"))

    moved = F.col("x") + F.col("width")
    probes = ranked.select("g", moved.alias("x"), F.when(moved > F.col("x"), 0).otherwise(2).alias("side"), "i")
    merged = global_rank(ranked.select("g", "x", F.lit(1).alias("side"), "i").union(probes), [F.col("g"), F.col("x"), F.col("side"), F.col("i")], "m")
    # The probes before a probe are as many as the values before its own, so the rest are values below it.
    beyond = merged.where("side <> 1").select("i", "g", F.greatest(F.col("m") - F.col("i"), F.col("i") + min_size).alias("up"))
    last = ends.select(F.col("g").alias("_g"), "last")
    hop = cut(beyond.join(last, F.col("g").eqNullSafe(F.col("_g"))).where("up <= last").select("i", "up"))

    starts = ends.select(F.col("first").alias("i"))
    while True:
        more = cut(starts.join(hop, "i").select(F.col("up").alias("i")))
        if more.isEmpty():
            break
        starts = starts.union(more)
        hop = cut(hop.join(hop.select(F.col("i").alias("up"), F.col("up").alias("_up")), "up").select("i", F.col("_up").alias("up")))

    at = starts.join(ranked, "i")
    after = Window.partitionBy("g").orderBy("i")  # at most resolution + 1 rows a group
    buckets = at.select("g", "n", "i", "x", F.lead("i").over(after).alias("end"), F.lead("x").over(after).alias("end_x")).where("end is not null")
    spans = buckets.select(F.col("i").alias("start"), "end", ((F.col("end") - F.col("i")) / (F.col("end_x") - F.col("x")) / F.col("n")).alias("density"))
    inside = range_join(ranked.select("g", "x", "i"), "i", spans, "start", "end", 1024)
    return inside.groupBy("g", "start", "density").agg(F.avg("x").alias("mean")).select(F.col("g").alias(group), "mean", "density")


def range_join(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """Points inside [lo, hi) of spans: both sides are cut into cells of `width`, so the join is on equal cells."""
    p = points.withColumn("_cell", F.floor(F.col(at) / width))
    s = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(s, "_cell").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_cell")


def global_rank(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their position from 0 in the whole order, without a window over all rows.

    Rows are dealt into ranges of the order; a range's positions start after the rows of the ranges before it. Only
    the ranges' sizes, one number each, meet in one task. Rows that tie in the order get any of their positions.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + local).drop("_part", "_start")  # one row a range
