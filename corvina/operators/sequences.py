"""Symbol sequences: k-mers and fragments."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kmers(text: Column, k: int) -> Column:
    """All k-mers of a text in order, in time linear in its length; none where it is shorter than k."""
    letters = F.split(text, "")
    n = F.greatest(F.length(text) - (k - 1), F.lit(0))
    shifted = [F.slice(letters, i + 1, n) for i in range(k)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), shifted)


def kmer_counts(texts: DataFrame, text: str, k: int) -> DataFrame:
    """(g, n, percent) over all texts."""
    counts = texts.select(F.explode(kmers(F.col(text), k)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select("g", "n", F.round(100.0 * F.col("n") / F.col("whole"), 4).alias("percent"))


def _same(fragment: str, g: Column) -> Column:
    return F.nullif(g == fragment, F.lit(False))


def fragment_counts(texts: DataFrame, text: str, fragments: list[str]) -> DataFrame:
    """(fragment, n): occurrences of the given fragments, overlapping ones included."""
    hits = [F.sum(F.size(F.array_compact(F.transform(kmers(F.col(text), len(f)), partial(_same, f))))).alias(f) for f in fragments]
    one = texts.agg(*hits)
    pairs = F.array(*[F.struct(F.lit(f).alias("fragment"), F.coalesce(F.col(f"`{f}`"), F.lit(0)).cast("long").alias("n")) for f in fragments])
    return one.select(F.explode(pairs).alias("x")).select("x.*")
