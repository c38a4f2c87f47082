"""Mergeable sketches: distinct counts and quantiles of each day, kept as a table and merged over any window of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the distinct sketch's registers, and the quantile sketch's k: both fix the sketches' size and error.
REGISTERS, QUANTILES = 12, 200


def distinct_error(log2_registers: int = REGISTERS) -> float:
    """The relative standard error of a distinct count."""
    return 1.04 / 2 ** (log2_registers / 2)


def daily_sketches(rows: DataFrame, day: str, keys: list[str], item: str, value: str) -> DataFrame:
    """(day, keys, rows, items, values): a row for each day and key, with a sketch of the distinct items and one of the values.

    A sketch has a bounded size whatever it counts, and is made partition by partition before the shuffle. Null items
    and values are not counted; rows of a null day or key are a group of their own.
    """
    return rows.groupBy(F.col(day).alias("day"), *keys).agg(
        F.count("*").alias("rows"), F.hll_sketch_agg(F.col(item), F.lit(REGISTERS)).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILES)).alias("values")
    )


def over_windows(daily: DataFrame, keys: list[str], days: int, quantiles: list[float]) -> DataFrame:
    """(day, keys, rows, distinct, q): for each day with rows, the days up to it, `days` in all, merged from their sketches.

    The raw rows are not read again: a day's sketch goes to each window that holds it.
    """
    last = daily.select("day", *keys).distinct()
    held = daily.withColumn("day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add("day", i))))
    merged = held.join(last, ["day", *keys], "left_semi").groupBy("day", *keys).agg(
        F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("items")).alias("distinct"), F.kll_merge_agg_double(F.col("values")).alias("values")
    )
    q = F.array(*[F.kll_sketch_get_quantile_double("values", F.lit(x)) for x in quantiles])
    return merged.select("day", *keys, "rows", "distinct", q.alias("q"))
