"""Queries of operators that SQL text alone would plan badly, and of sources, sinks and song matching, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.operators import graph, ordered, prototypes, sequences, text, vectors
from corvina.plans.analytics import EDGES
from corvina.session import register, table
from corvina.sources import generators, writers

SQL: dict[str, tuple[str, str]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(duck_sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if duck_sql:
            ORACLE[f.__name__] = duck_sql
        return f

    return add


SQL["prj4_type_filter"] = ("""
WITH items AS (SELECT 'song' AS kind, p_partkey AS id, p_name AS label FROM part UNION ALL SELECT 'reference', s_suppkey, s_name FROM supplier)
SELECT id, label FROM items WHERE kind = 'song'""",) * 2
SQL["src4_xpath"] = (
    "SELECT p_partkey, xpath_string(concat('<list><item size=\"', p_size, '\"><brand>', p_brand, '</brand></item></list>'), '//item[@size>20]/brand') AS brand FROM part",
    "SELECT p_partkey, CASE WHEN p_size > 20 THEN p_brand ELSE '' END AS brand FROM part",
)


@query("SELECT json_object('p_partkey', p_partkey, 'p_name', p_name, 'p_size', p_size)::VARCHAR AS value FROM part")
def snk3_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.json_lines(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))


_BLOCKS = ", ".join(f"count(*) FILTER (WHERE l_linestatus = '{s}' AND l_returnflag = '{x}') AS {n}_{x}" for n, s in (("f", "F"), ("r", "O")) for x in "ANR")


@query(f"SELECT l_linenumber, {_BLOCKS} FROM lineitem GROUP BY l_linenumber")
def snk4_count_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("strand", F.when(F.col("l_linestatus") == "F", "+").otherwise("-"))
    return writers.count_blocks(lines, "l_linenumber", "strand", "l_returnflag", ["A", "N", "R"])


@query("SELECT CAST(label AS INTEGER) AS label, 250 AS n FROM (SELECT range AS label FROM range(0, 4))")
def src21_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    clouds = generators.gaussian_clouds(spark, 4, 250, 8, 5.0, 1337)
    return clouds.where(F.size("v") == 8).groupBy("label").agg(F.count("*").cast("int").alias("n"))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.regexp_replace("text", "[^a-z]", "").alias("s"))


_KMERS = """WITH t AS (SELECT regexp_replace(text, '[^a-z]', '', 'g') AS s FROM documents), k AS (SELECT unnest(list_transform(range(1, length(s) - {k} + 2), lambda i: substring(s, i, {k}))) AS g FROM t WHERE length(s) >= {k})
SELECT g, count(*) AS n, round(1.0E2 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM k GROUP BY g"""


@query(_KMERS.format(k=2))
def ag26_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.kmer_counts(_letters(spark, sf_dir), "s", 2)


@query(_KMERS.format(k=4))
def ag26_kmers_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.kmer_counts(_letters(spark, sf_dir), "s", 4)


_FRAGMENTS = ["the", "tion", "ouest", "entent"]


@query(
    "WITH t AS (SELECT regexp_replace(text, '[^a-z]', '', 'g') AS s FROM documents) SELECT f AS fragment, CAST(sum(len(list_filter(range(1, length(s) + 1), lambda i: substring(s, i, length(f)) = f))) AS BIGINT) AS n FROM t, (SELECT unnest("
    + str(_FRAGMENTS)
    + ") AS f) GROUP BY f"
)
def ag26_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.fragment_counts(_letters(spark, sf_dir), "s", _FRAGMENTS)


@query(
    """WITH v AS (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT id, n FROM v"""
)
def gr7_chain_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["orders"])
    links = spark.sql("SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders")
    return graph.chains(links).select("id", "n")


@query(
    """WITH RECURSIVE a AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey - 1 END AS alias_of FROM nation),
r(id, root) AS (SELECT id, id AS root FROM a WHERE alias_of IS NULL UNION ALL SELECT a.id, r.root FROM a JOIN r ON a.alias_of = r.id) SELECT id, root FROM r"""
)
def gr13_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return graph.chains(nations.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") - 1).alias("parent"))).select("id", "root")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_size DESC, p_partkey) - 1 AS pos FROM part")
def so2_rank_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return ordered.global_rank(part, [F.col("p_brand"), F.col("p_size").desc(), F.col("p_partkey")], "pos").select("p_partkey", "pos")


@query("SELECT a.r, a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) b ON a.r = b.r")
def wn11_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, column: ordered.global_rank(table(spark, sf_dir, name).select(column), [F.col(column)], "r")
    return of("customer", "c_custkey").join(of("supplier", "s_suppkey"), "r").select((F.col("r") + 1).alias("r"), "c_custkey", "s_suppkey")


@query("SELECT vec_id, CAST(floor((r - 1) * 5.0 / n) AS INT) AS fold FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, count(*) OVER () AS n FROM embeddings) t")
def ml8_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.global_rank(table(spark, sf_dir, "embeddings").select("vec_id"), [F.col("vec_id")], "r")
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select("vec_id", F.floor(F.col("r") * 5.0 / F.col("n")).cast("int").alias("fold"))  # one row


@query(f"{EDGES} SELECT id, CAST(dense_rank() OVER (ORDER BY id) - 1 AS INT) AS dense FROM (SELECT a AS id FROM s WHERE rating > 0.05 UNION SELECT b FROM s WHERE rating > 0.05) t")
def gr3_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["lineitem", "orders", "customer", "supplier"])
    ids = spark.sql(f"{EDGES} SELECT a AS id FROM s WHERE rating > 0.05 UNION SELECT b FROM s WHERE rating > 0.05")
    return ordered.global_rank(ids, [F.col("id")], "dense").select("id", F.col("dense").cast("int").alias("dense"))


# The similarity graph: each vector's nearest five others; edges grow with the table.
_NEAR = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT a, b, d FROM (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id) t WHERE r <= 5),
u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(d) AS d FROM e GROUP BY 1, 2)"""


def neighbour_edges(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """(a, b, d) of each vector and its k nearest others."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(0).alias("label"))
    near = vectors.nearest(rows, rows, k + 1).where("test_id <> train_id")
    by = near.withColumn("d", F.sqrt("distance")).groupBy("test_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "train_id"))), 1, k).alias("x"))
    return by.select(F.col("test_id").alias("a"), F.explode("x").alias("x")).select("a", F.col("x.train_id").alias("b"), F.col("x.d").alias("d"))


@query(f"{_NEAR} SELECT a, b, round(d, 6) AS d FROM u")
def gr6_neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = neighbour_edges(spark, sf_dir)
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.round(F.min("d"), 6).alias("d"))


@query(f"""{_NEAR} SELECT count(*) AS triangles, coalesce(sum(CAST(2 * greatest(x.d, y.d, z.d) > x.d + y.d + z.d AS INTEGER)), 0)::BIGINT AS violations
FROM u x JOIN u y ON x.b = y.a JOIN u z ON x.a = z.a AND y.b = z.b""")
def gr5_neighbour_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(neighbour_edges(spark, sf_dir))


@query("""WITH e AS (SELECT l_orderkey AS a, l_partkey AS b, avg(l_extendedprice) AS d FROM lineitem GROUP BY 1, 2)
SELECT count(*) AS triangles, coalesce(sum(CAST(2 * greatest(x.d, y.d, z.d) > x.d + y.d + z.d AS INTEGER)), 0)::BIGINT AS violations FROM
(SELECT least(a, b) AS a, greatest(a, b) AS b, min(d) AS d FROM e WHERE a <> b GROUP BY 1, 2) x JOIN (SELECT least(a, b) AS a, greatest(a, b) AS b, min(d) AS d FROM e WHERE a <> b GROUP BY 1, 2) y ON x.b = y.a
JOIN (SELECT least(a, b) AS a, greatest(a, b) AS b, min(d) AS d FROM e WHERE a <> b GROUP BY 1, 2) z ON x.a = z.a AND y.b = z.b""")
def gr5_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.avg("l_extendedprice").alias("d"))
    return graph.triangles(lines)


@query(f"""{_NEAR}, t AS (SELECT a, b, CAST('0x' || substring(md5(a || '-' || b), 1, 8) AS BIGINT) % 10 AS t FROM u)
SELECT a, b, CASE WHEN t = 0 THEN 'test' WHEN t = 1 THEN 'verify' ELSE 'train' END AS part FROM t""")
def gr4_edge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = neighbour_edges(spark, sf_dir).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return graph.split_edges(edges).select("a", "b", "part")


@query()
def gr11_grown_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's two first vectors are a playlist; its similar tracks are the nearest vectors of all."""
    vectors_ = table(spark, sf_dir, "embeddings")
    edges = neighbour_edges(spark, sf_dir)
    nearer = Window.partitionBy("a").orderBy("d", "b")
    similar = edges.select(F.col("a").alias("track"), F.col("b").alias("other"), (F.row_number().over(nearer) - 1).alias("rank"))
    firsts = vectors_.groupBy(F.col("label").alias("playlist")).agg(F.min("vec_id").alias("x"), F.min_by("vec_id", F.when(F.col("vec_id") % 2 == 1, F.col("vec_id"))).alias("y"))
    seeds = firsts.select("playlist", F.explode(F.array("x", "y")).alias("track")).where("track is not null")
    grown = graph.grow_playlists(seeds, similar, vectors_.where("label < 5").select(F.col("vec_id").alias("track")), max_results=6, known_target=4)
    return grown.withColumn("cost", F.round("cost", 6))


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    label = F.concat_ws(" - ", "p_brand", "p_name")
    return part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("file:///m/"), F.replace(label, F.lit(" "), F.lit("%20")), F.lit(".mp3")).alias("uri"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"), label.alias("label"), (F.col("p_size") * 10).alias("length"))


def _different(songs: DataFrame) -> DataFrame:
    return songs.groupBy("artist", "title").agg(F.min(F.struct("id", "uri", "label", "length")).alias("x")).select("x.*", "artist", "title")


@query()
def txt9_song_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = _different(_songs(spark, sf_dir))
    asked = songs.select("id", "artist", F.concat("title", F.lit("s")).alias("title"))
    return text.song_matches(asked, songs).withColumn("cost", F.round("cost", 6))


@query()
def txt12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = _different(_songs(spark, sf_dir))
    entries = songs.select("id", F.concat(F.lit("D:\\old\\"), F.substring("uri", 11, 1000)).alias("uri"), F.concat("label", F.lit("!")).alias("label"), (F.col("length") + F.col("id") % 20).alias("length"))
    return text.repair_playlist(entries, songs)


@query()
def ml13_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prototypes.separable_share(spark, [(10, 20), (20, 20), (40, 20), (60, 20)], trials=40, epochs=200, seed=42)
