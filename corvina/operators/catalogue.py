"""Lookups in a catalogue of tracks by artist and title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.operators.text import canonicalise, scaled_indel

# Fixed values of the popularity estimate.
CLOSE, DAMPING, PADDING = 60, 120.0, 40


def popularity(asked: DataFrame, tracks: DataFrame) -> DataFrame:
    """(artist, title, artist_popularity, title_popularity) of (artist, title) by the artist's top tracks (artist, track, reach).

    A track counts when its edit distance, weighted by the lengths, is below 60; the one with the least distance per
    reach decides. The artist's popularity is the reach of the largest track, 0 without one, as is a title's without
    a close track. Rows with a null name are left out; names are compared in ASCII lower case.
    """
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = asked.where("artist is not null and title is not null").select("artist", "title", lower("artist").alias("_a"), lower("title").alias("_t")).distinct()
    tracks = tracks.where("artist is not null and track is not null and reach > 0").groupBy(lower("artist").alias("_a"), lower("track").alias("_track")).agg(F.max("reach").alias("reach"))
    top = tracks.groupBy("_a").agg(F.max("reach").alias("_top"))
    asked_c, tracks_c = asked.withColumn("_ct", canonicalise("_t")), tracks.withColumn("_ctrack", canonicalise("_track"))
    # A difference in length is a lower bound of the distance, which spares most pairs the edit distance.
    weight = F.length("_t") + F.length("_track") + PADDING
    least = F.abs(F.length("_t") - F.length("_track")) / F.greatest(F.lit(1), F.length("_t"), F.length("_track")) * weight
    pairs = asked_c.join(tracks_c, "_a").where(least < CLOSE)
    pairs = pairs.withColumn("_d", (scaled_indel(F.col("_t"), F.col("_track")) + scaled_indel(F.col("_ct"), F.col("_ctrack"))) * weight).where(F.col("_d") < CLOSE)
    best = pairs.groupBy("artist", "title").agg(F.min(F.struct((F.col("_d") / F.col("reach")).alias("cost"), "_track", "reach", "_d")).alias("b"))
    found = best.select("artist", "title", (F.col("b.reach") * (1 - F.col("b._d") / DAMPING)).cast("int").alias("title_popularity"))
    known = asked.join(top, "_a", "left").join(found, ["artist", "title"], "left")
    return known.select("artist", "title", F.coalesce(F.col("_top").cast("int"), F.lit(0)).alias("artist_popularity"), F.coalesce("title_popularity", F.lit(0)).alias("title_popularity"))
