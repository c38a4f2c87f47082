"""Text, graph, vector and statistics queries; those beyond SQL use the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators import embedding, graph, intervals, ordered, search, text, vectors
from corvina.session import table

SQL: dict[str, tuple[str, str]] = {}


def add(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    SQL[name] = (spark_sql, duck_sql or spark_sql)


# Text
add("txt11_perfect_trigrams", """
WITH n AS (SELECT DISTINCT lower(p_name) AS s FROM part WHERE length(p_name) > 2), g AS (SELECT s, explode(array_distinct(transform(sequence(1, length(s) - 2), i -> substring(s, i, 3)))) AS g FROM n),
c AS (SELECT s, count(*) AS n FROM g GROUP BY s)
SELECT a.s AS x, b.s AS y FROM g a JOIN g b ON a.g = b.g JOIN c ON c.s = a.s JOIN c d ON d.s = b.s WHERE c.n = d.n GROUP BY a.s, b.s, c.n HAVING count(*) = c.n""", """
WITH n AS (SELECT DISTINCT lower(p_name) AS s FROM part WHERE length(p_name) > 2), g AS (SELECT s, unnest(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3)))) AS g FROM n),
c AS (SELECT s, count(*) AS n FROM g GROUP BY s)
SELECT a.s AS x, b.s AS y FROM g a JOIN g b ON a.g = b.g JOIN c ON c.s = a.s JOIN c d ON d.s = b.s WHERE c.n = d.n GROUP BY a.s, b.s, c.n HAVING count(*) = c.n""")
# Words are runs of anything but digits and white space; grams are the 1- to 5-grams of _word_.
SPARK_WORDS = "SELECT {key}, w FROM documents LATERAL VIEW explode(split(text, '[0-9\\\\s]+')) t AS w WHERE w <> ''"
DUCK_WORDS = "SELECT {key}, w FROM (SELECT {key}, unnest(regexp_split_to_array(text, '[0-9\\s\\x0B]+')) AS w FROM documents) WHERE w <> ''"
SPARK_GRAMS = "explode(flatten(transform(sequence(1, size(k)), i -> transform(sequence(1, least(5, size(k) - i + 1)), j -> array_join(slice(k, i, j), '')))))"
DUCK_GRAMS = "unnest(flatten(list_transform(range(1, len(k) + 1), lambda i: list_transform(range(1, least(5, len(k) - i + 1) + 1), lambda j: array_to_string(list_slice(k, i, i + j - 1), '')))))"
SPARK_LETTERS, DUCK_LETTERS = "split(concat('_', w, '_'), '')", "string_split('_' || w || '_', '')"


def profile(key: str, p: str, spark: bool) -> str:
    """Common table {p}r (key, g, r): each key's 400 most frequent grams, ties in order of the gram."""
    words, letters, grams = (SPARK_WORDS, SPARK_LETTERS, SPARK_GRAMS) if spark else (DUCK_WORDS, DUCK_LETTERS, DUCK_GRAMS)
    return f"""{p}w AS ({words.format(key=key)}), {p}c AS (SELECT {key}, w, count(*) AS n FROM {p}w GROUP BY {key}, w), {p}k AS (SELECT {key}, {letters} AS k, n FROM {p}c),
{p}g AS (SELECT {key}, {grams} AS g, n FROM {p}k), {p}n AS (SELECT {key}, g, sum(n) AS n FROM {p}g GROUP BY {key}, g),
{p}r AS (SELECT * FROM (SELECT {key}, g, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, g) AS r FROM {p}n) t WHERE r <= 400)"""


add("txt14_language_profile", f"WITH {profile('lang', '', True)} SELECT lang, g, CAST(r AS BIGINT) AS r FROM r", f"WITH {profile('lang', '', False)} SELECT lang, g, r FROM r")
_DISTANCE = """, p400 AS (SELECT * FROM r)
SELECT a.lang AS x, l.lang AS y, CAST(sum(coalesce(abs(a.r - b.r), 400)) AS BIGINT) AS damage FROM p400 a CROSS JOIN (SELECT DISTINCT lang FROM p400) l
LEFT JOIN p400 b ON b.lang = l.lang AND b.g = a.g GROUP BY a.lang, l.lang"""
add("txt15_profile_distance", f"WITH {profile('lang', '', True)}{_DISTANCE}", f"WITH {profile('lang', '', False)}{_DISTANCE}")
add("txt18_longest_prefix", """
WITH t AS (SELECT 'th' AS p, 'a' AS c UNION ALL SELECT 'the', 'b' UNION ALL SELECT 'on', 'c' UNION ALL SELECT 'one', 'd' UNION ALL SELECT 'e', 'e'),
w AS (SELECT DISTINCT lower(w) AS w FROM documents LATERAL VIEW explode(split(text, '[^a-zA-Z]+')) x AS w WHERE w <> '')
SELECT w, c FROM (SELECT w, c, row_number() OVER (PARTITION BY w ORDER BY length(p) DESC) AS r FROM (SELECT w, explode(transform(sequence(1, length(w)), i -> substring(w, 1, i))) AS q FROM w) x JOIN t ON q = p) y WHERE r = 1""", """
WITH t AS (SELECT 'th' AS p, 'a' AS c UNION ALL SELECT 'the', 'b' UNION ALL SELECT 'on', 'c' UNION ALL SELECT 'one', 'd' UNION ALL SELECT 'e', 'e'),
w AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) AS w FROM documents) WHERE w <> '')
SELECT w, c FROM (SELECT w, c, row_number() OVER (PARTITION BY w ORDER BY length(p) DESC) AS r FROM w JOIN t ON starts_with(w, p)) q WHERE r = 1""")

# Graph: ratings between customers and nations from orders stand for similarity edges.
EDGES = "WITH e AS (SELECT c_nationkey AS a, s_nationkey AS b, avg(l_discount) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_nationkey, s_nationkey),\n" \
    "s AS (SELECT a, b, round(avg(rating), 6) AS rating FROM (SELECT a, b, rating FROM e UNION ALL SELECT b, a, rating FROM e) t WHERE a <> b GROUP BY a, b)"
add("gr1_symmetrise", f"{EDGES} SELECT a, b, rating FROM s")
add("gr2_distance", f"{EDGES} SELECT a, b, round(ln(200) - ln(rating), 6) AS d FROM s WHERE rating > 0")
add("gr5_triangles", f"{EDGES} SELECT count(*) AS triangles, 2 * count(*) AS visits FROM s x JOIN s y ON x.b = y.a JOIN s z ON x.a = z.a AND y.b = z.b WHERE x.a < x.b AND y.a < y.b AND x.rating > 0.05 AND y.rating > 0.05 AND z.rating > 0.05")
add("gr6_unique_edges", f"{EDGES} SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM s")
add("wn2_symmetric_rank", f"{EDGES}, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY rating DESC, b) AS r FROM s) SELECT x.a, x.b, (x.r + y.r) / 2.0E0 + 99 AS avg_rank FROM r x JOIN r y ON x.a = y.b AND x.b = y.a")
add("gr12_reachable", f"{EDGES} SELECT b AS node FROM s WHERE a = 3 AND NOT (b IN (1, 2))")
add("gr14_reach", "SELECT o_custkey, round(sum(l_extendedprice), 2) AS reach FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey ORDER BY reach DESC, o_custkey LIMIT 1000")

# Vectors
_SX = "x AS (SELECT vec_id, label, pos, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x)"
_DX = "x AS (SELECT vec_id, label, CAST(pos AS INTEGER) AS pos, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings))"


def both(name: str, body: str) -> None:
    add(name, f"WITH {_SX}{body}", f"WITH {_DX}{body}")


both("ml1_class_means", " SELECT label, pos, round(avg(x), 8) AS mean FROM x GROUP BY label, pos")
# Pairs of components are made within a row, so only sums per pair are shuffled, or nothing.
_PAIRED = "FROM embeddings LATERAL VIEW posexplode(CAST(embedding AS ARRAY<DOUBLE>)) t AS i, x LATERAL VIEW posexplode(CAST(embedding AS ARRAY<DOUBLE>)) u AS j, y"
_COVARIANCE = f"WITH {_DX} SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.x, b.x), 8) AS cov FROM x a JOIN x b ON a.vec_id = b.vec_id WHERE a.pos <= b.pos GROUP BY a.pos, b.pos"
add("ml4_covariance", f"SELECT i, j, round(covar_samp(x, y), 8) AS cov {_PAIRED} WHERE i <= j GROUP BY i, j", _COVARIANCE)
both("ml6_normalise", ", s AS (SELECT pos AS p, avg(x) AS m, stddev_samp(x) AS sd FROM x GROUP BY pos) SELECT vec_id, pos, round((x - m) / sd, 6) AS z FROM x JOIN s ON p = pos WHERE sd > 0")
_PRODUCTS = f"WITH {_DX} SELECT a.vec_id, a.pos AS i, b.pos AS j, round(a.x * b.x, 8) AS xy FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.pos <= a.pos"
add("ml7_products", f"SELECT vec_id, i, j, round(x * y, 8) AS xy {_PAIRED} WHERE j <= i", _PRODUCTS)
_PROTO = ", m AS (SELECT label AS l, pos AS p, avg(x) AS m FROM x GROUP BY label, pos), d AS (SELECT vec_id, label, l, sum((x - m) * (x - m)) AS d FROM x JOIN m ON p = pos GROUP BY vec_id, label, l)"
both("ml9_prototype_features", f"{_PROTO} SELECT vec_id, l, round(ln(d + 1.0E-10), 6) AS log_d, round(1 / (sqrt(d) + 0.01), 6) AS inv_d FROM d")
both("ml10_good_bad", f"{_PROTO}, g AS (SELECT vec_id, min(CASE WHEN label = l THEN d END) AS dg, min(CASE WHEN label <> l THEN d END) AS db FROM d GROUP BY vec_id) SELECT vec_id, round((dg - db) / (dg + db), 6) AS cost, dg >= db AS error FROM g")
both("ml20_rescale", ", b AS (SELECT pos AS p, min(x) AS lo, max(x) AS hi FROM x GROUP BY pos) SELECT vec_id, pos, round((x - lo) / (hi - lo), 6) AS r FROM x JOIN b ON p = pos WHERE hi > lo")
both("ml16_embedding_quality", """, d AS (SELECT a.vec_id AS i, b.vec_id AS j, sum((a.x - b.x) * (a.x - b.x)) AS d1, sum(CASE WHEN a.pos < 2 THEN (a.x - b.x) * (a.x - b.x) ELSE 0 END) AS d2
FROM x a JOIN x b ON a.pos = b.pos AND a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.vec_id, b.vec_id) SELECT round(abs(corr(sqrt(d1), sqrt(d2))), 6) AS r FROM d""")
add("ml19_finite_distances", "SELECT event_id, CASE WHEN value > 50 THEN 10 * m ELSE value END AS d FROM events CROSS JOIN (SELECT max(value) AS m FROM events WHERE value <= 50) t")

# Statistics
_PAIRS = "WITH p AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS x, avg(CASE WHEN event_type = 'view' THEN value END) AS y FROM events GROUP BY user_id), q AS (SELECT x, y FROM p WHERE x IS NOT NULL AND y IS NOT NULL)"
add("st1_paired_t", f"{_PAIRS} SELECT round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM q")
add("st2_welch", f"{_PAIRS} SELECT round((avg(x) - avg(y)) / sqrt(var_samp(x) / count(*) + var_samp(y) / count(*)), 6) AS t, round(power(var_samp(x) / count(*) + var_samp(y) / count(*), 2) / ((power(var_samp(x) / count(*), 2) + power(var_samp(y) / count(*), 2)) / (count(*) - 1)), 4) AS nu FROM q")
add("st3_mann_whitney", f"{_PAIRS}, v AS (SELECT x AS v, 1 AS g FROM q UNION ALL SELECT y, 2 FROM q), r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0E0 AS r FROM v) SELECT round(sum(CASE WHEN g = 1 THEN r ELSE 0 END) - sum(CASE WHEN g = 1 THEN 1 ELSE 0 END) * (sum(CASE WHEN g = 1 THEN 1 ELSE 0 END) + 1) / 2.0E0, 4) AS u FROM r")
add("st4_canonical_error", "SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN 0.9E0 * o_totalprice + 0.05E0 * o_totalprice + 0.05E0 ELSE 0.1E0 * o_totalprice END, 4) AS e FROM orders")
add("st5_relative_change", f"{_PAIRS} SELECT round(avg((x - y) / greatest(x, y) * 100), 6) AS change FROM q")
add("st6_correlations", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS qp, round(corr(l_quantity, l_discount), 6) AS qd, round(corr(l_tax, l_discount), 6) AS td FROM lineitem GROUP BY l_returnflag")
_DICE = """WITH d AS (SELECT {c} AS v FROM range(1, 7)), t AS (SELECT a.v + b.v + c.v + e.v - least(a.v, b.v, c.v, e.v) AS s FROM d a CROSS JOIN d b CROSS JOIN d c CROSS JOIN d e)"""
for _n, _q in (("st8_drop_lowest", " SELECT s, round(count(*) / 1296.0E0, 8) AS p FROM t GROUP BY s"), ("st9_moments", " SELECT round(avg(s), 8) AS mean, round(var_pop(s), 8) AS variance FROM t")):
    add(_n, _DICE.format(c="id") + _q, _DICE.format(c="range") + _q)


# Beyond SQL text
def txt1_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return search.search(part, F.col("p_name"), 'a -"zz" e', search.SortSpec.parse("-p_size,p_name,p_partkey"), 100)


def jn12_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = spark.range(0, 20).select(F.col("id").alias("span"), (F.col("id") * 7.0).alias("lo"), (F.col("id") * 7.0 + 10).alias("hi"))
    points = table(spark, sf_dir, "events").select("event_id", "value")
    joined = ordered.range_join(points, "value", spans, "lo", "hi", 10.0)
    return joined.groupBy("event_id").agg(F.min("span").alias("span"))


def jn13_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    both = intervals.overlapping(days, "lo", "hi").where("one.user_id <> two.user_id")
    return both.select(F.least("one.user_id", "two.user_id").alias("user_id"), F.greatest("one.user_id", "two.user_id").alias("other"))


def txt8_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.size(text.trigrams(F.lower("p_name"))).alias("n"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("text")).agg(F.min("p_partkey").alias("id")).select("id", "text")


def txt9_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    return text.fuzzy_match(names.select("id", F.concat("text", F.lit("x")).alias("text")), names)


def fn1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.canonicalise("text").alias("canon"))


def fn4_indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    m = n.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("name"))
    pairs = n.join(m, F.col("n_nationkey") < F.col("other"))
    return pairs.select("n_nationkey", "other", text.indel_distance("n_name", "name").alias("d"), F.round(text.scaled_indel(F.col("n_name"), F.col("name")), 6).alias("scaled"))


def ag18_adaptive_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.adaptive_histogram(table(spark, sf_dir, "events"), "event_type", "value", 20, 50)


def wn14_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.greedy_suppress(table(spark, sf_dir, "part"), "p_name", "p_size", ["p_partkey"], 5)


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    steps = n.select("a", ((F.col("a") * 7 + 3) % 25).alias("b"), (F.col("a") % 4 + 1.0).alias("cost")).union(n.select("a", ((F.col("a") + 1) % 25).alias("b"), F.lit(3.0).alias("cost")))
    return steps


def gr8_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_paths(_nation_edges(spark, sf_dir), spark.createDataFrame([(0,)], "node long")).select("node", "distance")


def ml2_one_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    near = vectors.nearest(e.where("id % 5 <> 0"), e.where("id % 5 = 0"))
    return near.select("test_id", "train_id", "label")


def ml5_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vectors.pca(table(spark, sf_dir, "embeddings"), "embedding", 2)
    return p.agg(*[F.round(F.var_samp(F.col("projected")[i]), 6).alias(f"explained_{i}") for i in range(2)])


def ml16_embedding_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far distances in the first two dimensions follow those in all, over pairs of a label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return embedding.distance_correlation(rows, 2).select(F.round("r", 6).alias("r"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (txt1_keyword_search, jn12_range, jn13_overlap, txt8_trigrams, txt9_fuzzy, fn1_canonical, fn4_indel, ag18_adaptive_histogram, wn14_greedy, gr8_shortest_paths, ml2_one_nn, ml5_pca, ml16_embedding_quality)
}
ORACLE: dict[str, str] = {
    "txt1_keyword_search": "SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 'e') AND NOT contains(lower(p_name), 'zz') ORDER BY p_size DESC, p_name = '', p_name, p_partkey LIMIT 100",
    "jn12_range": "SELECT event_id, min(s.range) AS span FROM events JOIN range(0, 20) s ON value >= s.range * 7 AND value < s.range * 7 + 10 GROUP BY event_id",
    "jn13_overlap": "WITH d AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY user_id) SELECT a.user_id, b.user_id AS other FROM d a JOIN d b ON a.lo <= b.hi AND b.lo <= a.hi AND a.user_id < b.user_id",
    "txt8_trigrams": "SELECT p_partkey, CAST(len(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3)))) AS INTEGER) AS n FROM (SELECT p_partkey, CASE WHEN length(p_name) < 3 THEN lpad(lower(p_name), 3, chr(65533)) ELSE lower(p_name) END AS s FROM part)",
    "gr8_shortest_paths": """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b, n_nationkey % 4 + 1.0 AS cost FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, 3.0 FROM nation),
p(node, distance) AS (SELECT 0, CAST(0 AS DOUBLE) UNION SELECT e.b, CAST(p.distance + e.cost AS DOUBLE) FROM p JOIN e ON e.a = p.node WHERE p.distance + e.cost <= 60) SELECT CAST(node AS BIGINT) AS node, min(distance) AS distance FROM p GROUP BY node""",
    "ml2_one_nn": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT a.vec_id AS test_id, b.vec_id AS train_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a JOIN e b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0)
SELECT test_id, train_id, label FROM d WHERE r = 1""",
}
