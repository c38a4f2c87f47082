"""Queries on tests, prototypes, maps, prose, tries and sampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import prose
from corvina.operators import catalogue, embedding, graph, inference, profiles, prototypes, sampling, vectors
from corvina.plans.analytics import profile
from corvina.session import table

SQL: dict[str, tuple[str, str]] = {}

_SPARK_WORDS = "SELECT lower(w) AS w FROM documents LATERAL VIEW explode(split(text, '[^a-zA-Z]+')) t AS w WHERE w <> ''"
_DUCK_WORDS = "SELECT lower(w) AS w FROM (SELECT unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) AS w FROM documents) WHERE w <> ''"


# A gram that a language lacks costs 400, so damage is 400 a gram less what the shared ones save.
_LEAST_DAMAGE = """WITH {docs}, {langs},
m AS (SELECT a.doc_id, b.lang, sum(abs(a.r - b.r) - 400) AS saved FROM dr a JOIN lr b ON a.g = b.g GROUP BY a.doc_id, b.lang), k AS (SELECT doc_id, 400 * count(*) AS most FROM dr GROUP BY doc_id),
d AS (SELECT m.doc_id, m.lang, CAST(m.saved + k.most AS BIGINT) AS damage, k.most FROM m JOIN k ON m.doc_id = k.doc_id),
b AS (SELECT doc_id, min(damage) AS best, coalesce(min(CASE WHEN lang = 'en' THEN damage END), max(most)) AS english FROM d GROUP BY doc_id)
SELECT d.doc_id, d.lang, d.damage FROM d JOIN b ON d.doc_id = b.doc_id WHERE best < english AND damage * 105 < english * 100 AND damage * 100 < best * 105"""
SQL["txt17_least_damage"] = (
    *[_LEAST_DAMAGE.format(docs=profile("doc_id", "d", spark), langs=profile("lang", "l", spark)) for spark in (True, False)],
)
# The same for a part of the documents and profiles that are at hand.
LEAST_DAMAGE_OF = _LEAST_DAMAGE.format(docs=profile("doc_id", "d", True).replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents}"), langs="lr AS (SELECT lang, g, r FROM {profiles})")
_TRIE = """WITH w AS ({words}), c AS (SELECT w, count(*) AS n FROM w GROUP BY w), x AS (SELECT {prefixes} AS prefix, n FROM c),
t AS (SELECT prefix, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY prefix)
SELECT t.prefix, t.n, round(CAST(t.n AS DOUBLE) / p.n, 8) AS probability FROM t JOIN t p ON p.prefix = substring(t.prefix, 1, length(t.prefix) - 1) WHERE t.prefix <> ''"""
SQL["txt19_word_trie"] = (
    _TRIE.format(words=_SPARK_WORDS, prefixes="explode(transform(sequence(0, length(w)), k -> substring(w, 1, k)))"),
    _TRIE.format(words=_DUCK_WORDS, prefixes="unnest(list_transform(range(0, length(w) + 1), lambda k: substring(w, 1, k)))"),
)
SQL["ml14_report_epochs"] = (
    "SELECT id AS epoch FROM range(1, 2001) WHERE id % CAST(power(2, greatest(0, length(bin(id)) - 8)) AS BIGINT) = 0",
    "SELECT CAST(range AS BIGINT) AS epoch FROM range(1, 2001) WHERE range % CAST(power(2, greatest(0, length(bin(range)) - 8)) AS BIGINT) = 0",
)


def txt17_least_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages whose profiles do a document's the least damage, of those at least 5 % better than English."""
    documents = table(spark, sf_dir, "documents")
    return profiles.least_damage(documents, profiles.language_profiles(documents, False), False, LEAST_DAMAGE_OF)


def _per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(of("click").alias("x"), of("view").alias("y")).where("x is not null and y is not null").withColumn("g", F.lit("all"))


def st1_paired_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.paired_t(_per_user(spark, sf_dir), ["g"], "x", "y")


def st2_welch_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.welch_t(_per_user(spark, sf_dir), ["g"], "x", "y")


def st3_mann_whitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.mann_whitney(_per_user(spark, sf_dir), ["g"], "x", "y")


def st7_confusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("error"))
    return inference.confusable_share(errors, "event_type", "user_id", "error")


def fn10_strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", prose.strip_markup(F.col("html")).alias("plain"))


def fn11_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(prose.sentences(F.col("text"))).alias("pos", "sentence"))


def fn12_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(prose.grade(F.col("text")), 6).alias("grade"))


def fn15_escape_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", prose.escape_path(F.col("url")).alias("path"))


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    return n.select("a", ((F.col("a") * 7 + 3) % 25).alias("b"), (F.col("a") % 4 + 1.0).alias("cost")).union(n.select("a", ((F.col("a") + 1) % 25).alias("b"), F.lit(3.0).alias("cost")))


def gr9_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.all_pairs(_nation_edges(spark, sf_dir))


def gr10_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = graph.landmarks(_nation_edges(spark, sf_dir), 0, 3)
    return spark.createDataFrame(list(enumerate(chosen)), "place int, node long")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def ml3_projected_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error rate of the nearest neighbour in the plane of the first two dimensions; every fifth row is tested."""
    flat = _vectors(spark, sf_dir).withColumn("v", F.slice("v", 1, 2))
    near = vectors.nearest(flat.where("id % 5 <> 0"), flat.where("id % 5 = 0")).select(F.col("test_id").alias("id"), F.col("label").alias("found"))
    return near.join(flat, "id").agg(F.round(F.avg((F.col("found") != F.col("label")).cast("double")), 8).alias("error_rate"))


def ml11_learn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    labels, w = prototypes.learn_vectors(rows, epochs=5)
    found = prototypes.classify(rows, labels, w).join(rows, "id")
    return found.agg(F.avg((F.col("predicted") != F.col("label")).cast("double")).alias("error_rate"), F.count("*").alias("n"))


def ml12_neural_gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    _, start = prototypes.class_means(rows)
    w = prototypes.neural_gas(rows, start, epochs=5)
    return prototypes.classify(rows, np.arange(len(w)), w).groupBy("predicted").agg(F.count("*").alias("n"))


def ml17_neighbour_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near rows of the same label are in the first two dimensions; tested for every fiftieth row."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"), "label")
    return embedding.mean_class_rank(rows, rows.where("id % 50 = 0")).select(F.round("quality", 8).alias("quality"))


def so9_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffled(table(spark, sf_dir, "part"), ["p_partkey"], 37).select("p_partkey")


def so10_weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("weight"))
    return sampling.draw(spark, weights, "p_brand", "weight", 10_000, 37)


def txt13_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("artist"), F.col("p_name").alias("track")).agg(F.sum("p_size").cast("double").alias("reach"))
    asked = tracks.select("artist", F.concat("track", F.lit("s")).alias("title"))
    return catalogue.popularity(asked, tracks)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        txt17_least_damage, st1_paired_p, st2_welch_p, st3_mann_whitney_p, st7_confusable, fn10_strip_markup, fn11_sentences, fn12_grade, fn15_escape_path, gr9_all_pairs, gr10_landmarks,
        ml3_projected_nn, ml11_learn_vectors, ml12_neural_gas, ml17_neighbour_rank, so9_shuffle, so10_weighted_draws, txt13_popularity,
    )
}
_COUNT = "len(regexp_extract_all(text, '{}'))"
ORACLE: dict[str, str] = {
    "fn12_grade": f"""WITH c AS (SELECT doc_id, length(text) AS chars, {_COUNT.format(chr(92) + "S+")} AS words, {_COUNT.format(prose.CAPITAL_WORD)} AS capital,
{_COUNT.format(prose.WORD_CHARACTER)} - {_COUNT.format("[0-9]")} - {_COUNT.format("[A-Z]")} AS plain FROM documents)
SELECT doc_id, CASE WHEN words > 0 THEN round(CAST(plain AS DOUBLE) / chars + CAST(0.3 AS DOUBLE) * least(words - capital, 6) - CASE WHEN words = 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(capital - 1 AS DOUBLE) / (words - 1) END, 6) END AS grade FROM c""",
    "fn15_escape_path": r"SELECT page_id, array_to_string(list_transform(string_split(replace(url, '\', '/'), ''), lambda c: CASE WHEN regexp_full_match(c, '[%*&+:!\p{Cc}]') THEN '!' || format('{:02x}', unicode(c)) ELSE c END), '') AS path FROM pages",
    "gr9_all_pairs": """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b, n_nationkey % 4 + 1.0 AS cost FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, 3.0 FROM nation),
p(a, b, cost) AS (SELECT n_nationkey, n_nationkey, CAST(0 AS DOUBLE) FROM nation UNION SELECT p.a, e.b, CAST(p.cost + e.cost AS DOUBLE) FROM p JOIN e ON e.a = p.b WHERE p.cost + e.cost <= 60)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, min(cost) AS cost FROM p GROUP BY a, b""",
    "ml3_projected_nn": """WITH e AS (SELECT vec_id, CAST(embedding[1:2] AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT a.label AS l, b.label AS m, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.v[1] - b.v[1]) * (a.v[1] - b.v[1]) + (a.v[2] - b.v[2]) * (a.v[2] - b.v[2]), b.vec_id) AS r FROM e a JOIN e b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0)
SELECT round(avg(CASE WHEN l <> m THEN 1.0 ELSE 0.0 END), 8) AS error_rate FROM d WHERE r = 1""",
    "ml17_neighbour_rank": """WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings),
d AS (SELECT a.vec_id AS t, b.vec_id AS o, a.label = b.label AND a.vec_id <> b.vec_id AS near, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.vec_id) - 1 AS r, count(*) OVER (PARTITION BY a.vec_id) AS n FROM e a JOIN e b ON a.vec_id % 50 = 0)
SELECT round(avg(m), 8) AS quality FROM (SELECT avg(CAST(r AS DOUBLE) / n) AS m FROM d WHERE near GROUP BY t)""",
}
