"""Canonical text, edit distance with substitution cost two, and trigram matching."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# What stands for a character after lower-casing and decomposition; other non-ASCII ones go.
SUBSTITUTES = {
    "\t": " ", "\n": "\n", "0": "o", '"': "'", "`": "'", "\u00b4": "'", "\u00e6": "ae", "\u00f8": "o", "\u00f0": "d", "\u00d7": "x",
    "\u00de": " ", "\u00fe": " ", "\u00be": " ", "\u00a0": " ", "\u00b7": " ", "_": " ", "^": " ", "\u00af": " ", "\u00df": "ss",
    "\u00bf": "?", "\u00bd": "1/2", "\u00bc": "1/4", "\u00b9": "1", "\u00b8": ",", "\u00b3": "3", "\u00b2": "2", "\u00ae": "r",
    "\u00b5": "u", "\u00a2": "c", "\u00aa": "a", "\u00a3": "l", "\u00ba": "o", "$": "s", "\\": "/", "<": "(", ">": ")",
    "\u00f7": "/", "\u00ad": "-", "\u00a1": "!", "\u00a9": "c",
}
SUBSTITUTES_BY_CATEGORY = {"Ps": "(", "Pe": ")", "Pi": "'", "Pf": "'", "Mn": "", "Cc": ""}


class _Plain(dict):
    """What stands for each character, by code point, looked up once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = SUBSTITUTES.get(c, SUBSTITUTES_BY_CATEGORY.get(unicodedata.category(c), c if c < "\x80" else ""))
        return self[code]


_PLAIN = _Plain()


def canonical(text: str | None) -> str | None:
    """Lower case, without accents, controls and what has no ASCII form; brackets, quotes and letter-like signs made plain."""
    return None if text is None else unicodedata.normalize("NFD", text.lower()).translate(_PLAIN)


@F.pandas_udf(T.StringType())
def canonicalise(text: pd.Series) -> pd.Series:
    return text.map(canonical)


def indel(s: str, t: str) -> int:
    """Insertions and deletions that turn s into t; a substitution is one of each.

    The longest common subsequence, all of s at once in the bits of one integer: a bit is cleared where it grows.
    """
    places: dict[str, int] = {}
    for i, c in enumerate(s):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(s)) - 1
    bits = every
    for c in t:
        hit = bits & places.get(c, 0)
        bits = ((bits + hit) | (bits - hit)) & every
    return len(t) - len(s) + 2 * bits.bit_count()


@F.pandas_udf(T.IntegerType())
def indel_distance(s: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else indel(a, b) for a, b in zip(s, t, strict=True)], dtype="Int32")


def scaled_indel(s: Column, t: Column) -> Column:
    """indel_distance over the longer length, at least one: 0 to 2."""
    return indel_distance(s, t) / F.greatest(F.lit(1), F.length(s), F.length(t))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams; shorter texts are padded on the left."""
    padded = F.when(F.length(text) < 3, F.lpad(text, 3, "�")).otherwise(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def fuzzy_candidates(queries: DataFrame, catalogue: DataFrame, best: int = 50) -> DataFrame:
    """(q_id, c_id, shared): pairs sharing (6 n + 9) div 10 of the query's n trigrams, the best few per query.

    Both sides are (id, text). The join is on trigrams, so its size follows the postings, not the product.
    """
    q = queries.select(F.col("id").alias("q_id"), trigrams(F.col("text")).alias("g"))
    q = q.select("q_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    c = catalogue.select(F.col("id").alias("c_id"), F.explode(trigrams(F.col("text"))).alias("gram"))
    hits = q.join(c, "gram").groupBy("q_id", "c_id", "n").agg(F.count("*").alias("shared")).where("shared >= (n * 6 + 9) div 10")
    order = Window.partitionBy("q_id").orderBy(F.col("shared").desc(), F.col("c_id"))
    return hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= best).drop("r")


def fuzzy_match(queries: DataFrame, catalogue: DataFrame, accept: float = 1.45) -> DataFrame:
    """Each query's best catalogue row: (q_id, c_id, cost), cost = share of trigrams missed + scaled edit distance."""
    pairs = fuzzy_candidates(queries, catalogue)
    pairs = pairs.join(queries.select(F.col("id").alias("q_id"), F.col("text").alias("q")), "q_id").join(catalogue.select(F.col("id").alias("c_id"), F.col("text").alias("c")), "c_id")
    cost = (1 - F.col("shared") / F.col("n")) + scaled_indel(F.col("q"), F.col("c"))
    order = Window.partitionBy("q_id").orderBy("cost", "c_id")
    return pairs.withColumn("cost", F.round(cost, 6)).where(F.col("cost") < accept).withColumn("r", F.row_number().over(order)).where("r = 1").select("q_id", "c_id", "cost")


def grams_of(artist: Column, title: Column) -> Column:
    """Distinct trigrams of the canonical artist and title."""
    return F.array_distinct(F.concat(trigrams(artist), trigrams(title)))


def song_matches(queries: DataFrame, songs: DataFrame, best: int = 50, quality: str | None = None) -> DataFrame:
    """(q_id, c_id, cost) of the songs like each query, both given as (id, artist, title).

    Candidates share (6 n + 9) div 10 of the query's n trigrams, and the best few by shared ones stay. The cost is the
    share of trigrams missed, of the larger count, plus the scaled edit distances of artist and of title, as they
    are in lower case and in canonical form; with a quality column, plus a tenth of it. Nulls read as empty.
    """

    def prepared(df: DataFrame, side: str) -> DataFrame:
        artist, title = (F.coalesce(F.col(c), F.lit("")) for c in ("artist", "title"))
        out = df.select(
            F.col("id").alias(f"{side}_id"), F.lower(artist).alias(f"{side}_artist"), F.lower(title).alias(f"{side}_title"),
            canonicalise(artist).alias(f"{side}_artist_c"), canonicalise(title).alias(f"{side}_title_c"),
            (F.col(quality) if quality and side == "c" else F.lit(0.0)).alias(f"{side}_quality"),
        )
        return out.withColumn(f"{side}_grams", grams_of(F.col(f"{side}_artist_c"), F.col(f"{side}_title_c")))

    q, c = prepared(queries, "q"), prepared(songs, "c")
    size = lambda side: F.size(f"{side}_grams").alias(f"{side}_n")
    hits = q.select("q_id", size("q"), F.explode("q_grams").alias("gram")).join(c.select("c_id", size("c"), F.explode("c_grams").alias("gram")), "gram")
    shared = hits.groupBy("q_id", "c_id", "q_n", "c_n").agg(F.count("*").alias("shared")).where("shared >= (q_n * 6 + 9) div 10")
    order = Window.partitionBy("q_id").orderBy(F.col("shared").desc(), F.col("c_id"))
    kept = shared.withColumn("r", F.row_number().over(order)).where(F.col("r") <= best)
    pairs = kept.join(q, "q_id").join(c, "c_id")
    far = [scaled_indel(F.col(f"q_{part}"), F.col(f"c_{part}")) for part in ("artist", "title", "artist_c", "title_c")]
    missed = 1 - F.col("shared") / F.greatest("q_n", "c_n")
    return pairs.select("q_id", "c_id", (missed + sum(far, F.lit(0.0)) + 0.1 * F.col("c_quality")).alias("cost"))


def label_splits(label: Column) -> Column:
    """(artist, title) at every " - " of a label."""
    parts = F.split(label, " - ", -1)
    join = lambda start, n: F.array_join(F.slice(parts, start, n), " - ")
    whole = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(join(F.lit(1), i).alias("artist"), join(i + 1, F.size(parts) - i).alias("title")))
    return F.when(F.size(parts) > 1, whole).otherwise(F.array().cast("array<struct<artist:string,title:string>>"))


def file_name(path: Column) -> Column:
    """What follows the last slash of either kind, with %-escapes resolved where they are sound."""
    last = F.regexp_extract(path, r"([^/\\]*)\z", 1)
    sound = F.replace(F.replace(last, F.lit("100%"), F.lit("100%25")), F.lit("%%"), F.lit("%25%"))
    return F.coalesce(F.try_url_decode(F.replace(sound, F.lit("+"), F.lit("%2B"))), last)


#: Seconds by which lengths may differ, the cost up to which a song is accepted, and below which it is a good match.
LENGTH_TOLERANCE, ACCEPTABLE, GOOD = 15.0, 7.5, 6.0


def repair_playlist(entries: DataFrame, songs: DataFrame) -> DataFrame:
    """Per entry (id, uri, label, length): id, song_id, cost, verdict (good, iffy, bad or none).

    songs are (id, uri, artist, title, label, length). The label's splits are looked up by song_matches; a
    candidate whose length is too different is out, where an entry's length of 0 tells nothing and counts 7.5. Its
    cost is the length's difference / 5 plus sqrt(50 min(name, label)) plus sqrt(50 label), of edit distances over
    summed lengths of file names and canonical labels. A good match also has a split in common. Ties go to
    the smaller song id.
    """
    canon = lambda c: F.transform(label_splits(c), lambda x: F.concat_ws("\n", F.lower(x["artist"]), F.lower(x["title"])))
    asked = entries.select("id", F.posexplode(label_splits(F.col("label"))).alias("pos", "x")).select(F.struct("id", "pos").alias("id"), "x.artist", "x.title")
    found = song_matches(asked, songs.select("id", "artist", "title")).select(F.col("q_id.id").alias("id"), F.col("c_id").alias("song_id")).distinct()
    of = lambda df, p: df.select(F.col("id").alias("id" if p == "q" else "song_id"), file_name(F.col("uri")).alias(f"{p}_name"), canonicalise(F.col("label")).alias(f"{p}_label"), F.col("length").cast("double").alias(f"{p}_length"), canon(F.col("label")).alias(f"{p}_splits"))
    pairs = found.join(of(entries, "q"), "id").join(of(songs, "c"), "song_id")
    length = F.when(F.col("q_length") == 0, 7.5).otherwise(F.abs(F.col("q_length") - F.col("c_length")))
    over = lambda part: F.coalesce(indel_distance(f"q_{part}", f"c_{part}") / F.nullif(F.length(f"q_{part}") + F.length(f"c_{part}"), F.lit(0)), F.lit(0.0))
    scored = pairs.withColumn("far", length).where(F.col("far") <= LENGTH_TOLERANCE).withColumn("name_cost", over("name")).withColumn("label_cost", over("label"))
    cost = F.col("far") / 5 + F.sqrt(50 * F.least("name_cost", "label_cost")) + F.sqrt(50 * F.col("label_cost"))
    best = scored.withColumn("cost", cost).groupBy("id").agg(F.min(F.struct("cost", "song_id", F.arrays_overlap("q_splits", "c_splits").alias("common"))).alias("b"))
    verdict = F.when(F.col("b").isNull(), "none").when((F.col("b.cost") < GOOD) & F.col("b.common"), "good").when(F.col("b.cost") <= ACCEPTABLE, "iffy").otherwise("bad")
    return entries.select("id").join(best, "id", "left").select("id", F.col("b.song_id").alias("song_id"), F.round("b.cost", 6).alias("cost"), verdict.alias("verdict"))
