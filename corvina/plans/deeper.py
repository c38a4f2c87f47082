"""Queries over interval joins, stored postings, landmark tables and iterative fits, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions import prose
from corvina.operators import embedding, fitting, graph, intervals, ordered, postings, prototypes, sketches, strips
from corvina.operators.text import SUBSTITUTES
from corvina.plans import analytics
from corvina.plans.further import _NEAR, neighbour_edges
from corvina.session import cut, register, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(duck_sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if duck_sql:
            ORACLE[f.__name__] = duck_sql
        return f

    return add


# Intervals
@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOURS THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
x AS (SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS lo, max(ts) AS hi FROM s GROUP BY ALL)
SELECT a.user_id, a.session, b.user_id AS other, b.session AS other_session FROM x a JOIN x b ON a.lo <= b.hi AND b.lo <= a.hi AND a.user_id < b.user_id""")
def jn13_session_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of different users that overlap; a session ends where its user pauses for over two hours."""
    found = intervals.sessions(table(spark, sf_dir, "events"), "user_id", "ts", F.expr("interval 2 hours"))
    both = intervals.overlapping(found.select("user_id", "session", "start", "end"), "start", "end")
    first = F.col("one.user_id") < F.col("two.user_id")
    either = lambda c, x, y: F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    named = [either("user_id", "one", "two").alias("user_id"), either("session", "one", "two").alias("session"), either("user_id", "two", "one").alias("other"), either("session", "two", "one").alias("other_session")]
    return both.where("one.user_id <> two.user_id").select(*named)


def _views_before(spark: SparkSession, sf_dir: str, user: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.expr(user).alias("user_id"), "ts", "event_id", "value", "event_type")
    bought, seen = (rows.where(F.col("event_type") == kind).drop("event_type") for kind in ("purchase", "view"))
    found = intervals.as_of_join(bought.drop("value"), seen, "user_id", "ts", "event_id")
    return found.select("event_id", "user_id", F.col("before.event_id").alias("view_id"), F.col("before.value").alias("value"))


_BEFORE = """WITH h AS (SELECT event_id, ts, value, event_type, {user} AS user_id FROM events)
SELECT p.event_id, p.user_id, max_by(v.event_id, (v.ts, v.event_id)) AS view_id, max_by(v.value, (v.ts, v.event_id)) AS value
FROM h p LEFT JOIN h v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id"""
_HALF = "CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END"


@query(_BEFORE.format(user="user_id"))
def jn19_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last view before it."""
    return _views_before(spark, sf_dir, "user_id")


@query(_BEFORE.format(user=_HALF))
def jn19_as_of_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where one user holds half of all rows."""
    return _views_before(spark, sf_dir, _HALF)


# Search
def duck_canonical(text: str) -> str:
    """canonical() in DuckDB, for text whose other characters outside ASCII are letters with accents."""
    x = f"strip_accents(lower({text}))"
    for c, to in SUBSTITUTES.items():
        if c != to:
            quoted = (c.replace("'", "''"), to.replace("'", "''"))
            x = f"replace({x}, {f'chr({ord(c)})' if ord(c) < 32 else f"'{quoted[0]}'"}, '{quoted[1]}')"
    return f"regexp_replace({x}, '[^\\n\\x20-\\x7E]', '', 'g')"


def _asked(canon: str, wanted: list[str], unwanted: list[str]) -> str:
    tests = [f"contains({canon}, '{t}')" for t in wanted] + [f"NOT contains({canon}, '{t}')" for t in unwanted]
    return " AND ".join(tests)


DOCUMENT_QUERY = """Thou "on the" -'zz' src1"""
_DOC = duck_canonical("concat_ws(chr(10), coalesce(text, ''), coalesce(source, ''), coalesce(lang, ''))")


@query(f"WITH d AS (SELECT doc_id, {_DOC} AS c FROM documents) SELECT doc_id FROM d WHERE {_asked('c', *postings.canonical_terms(DOCUMENT_QUERY))}")
def txt6_posting_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by text, source and language, through a stored gram table."""
    made = postings.Postings.build(table(spark, sf_dir, "documents"), "doc_id", ["text", "source", "lang"], f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    return made.search(DOCUMENT_QUERY).select(F.col("id").alias("doc_id"))



@query(f"WITH d AS (SELECT doc_id, {_DOC} AS c FROM documents) SELECT doc_id FROM d WHERE {_asked('c', *postings.canonical_terms('ciónñ ÑAS -dell'))}")
def txt1_canonical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a scan of canonical text over three columns."""
    return postings.scan_search(table(spark, sf_dir, "documents"), "doc_id", ["text", "source", "lang"], "ciónñ ÑAS -dell").select(F.col("id").alias("doc_id"))


# The graph of each vector's nearest five others, walked in both directions
def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, cost) in both directions."""
    near = neighbour_edges(spark, sf_dir)
    return near.select("a", "b", F.col("d").alias("cost")).union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("d").alias("cost"))).groupBy("a", "b").agg(F.min("cost").alias("cost"))


_WALK = f"""{_NEAR.replace('WITH v', 'WITH RECURSIVE v')}, g AS MATERIALIZED (SELECT a, b, d FROM u UNION ALL SELECT b, a, d FROM u),
p(node, d) USING KEY (node) AS (
  SELECT vec_id, CAST(0 AS DOUBLE) FROM embeddings WHERE vec_id IN (0, 1)
  UNION SELECT g.b, min(p.d + g.d) FROM p JOIN g ON g.a = p.node LEFT JOIN recurring.p AS old ON old.node = g.b WHERE old.d IS NULL OR p.d + g.d < old.d GROUP BY g.b)"""


@query(f"""{_WALK} SELECT p.node, round(p.d, 6) AS distance, CASE WHEN p.d > 0 THEN (SELECT arg_min(q.node, q.d + g.d) FROM g JOIN p q ON q.node = g.a WHERE g.b = p.node) ELSE -1 END AS previous FROM p""")
def gr8_neighbour_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's distance from the nearer of the first two over the neighbour graph, and the node before it."""
    starts = table(spark, sf_dir, "embeddings").where("vec_id in (0, 1)").select(F.col("vec_id").alias("node"))
    return graph.shortest_paths(neighbour_graph(spark, sf_dir), starts).select("node", F.round("distance", 6).alias("distance"), "previous")


def _landmarks(spark: SparkSession, sf_dir: str) -> graph.LandmarkTable:
    made = graph.LandmarkTable(neighbour_graph(spark, sf_dir))
    made.add_random(6, seed=42)
    made.add_farthest(6)
    return made


@query()
def gr10_neighbour_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve landmarks, half drawn by seed and half farthest, with the distances of all nodes from each."""
    made = _landmarks(spark, sf_dir)
    places = spark.createDataFrame(list(enumerate(made.chosen)), "place int, landmark long")
    return made.table.join(F.broadcast(places), "landmark").select("place", "landmark", "node", F.round("distance", 6).alias("distance"))


@query()
def ml18_triangulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane of all nodes: landmarks by classical scaling of their distances, the others by theirs to the landmarks."""
    made = _landmarks(spark, sf_dir)
    told = embedding.finite_distances(made.complete().select(F.col("node").alias("point"), "landmark", F.col("distance").alias("d")))
    own = told.where(F.col("point").isin(made.chosen)).select(F.col("point").alias("a"), F.col("landmark").alias("b"), "d")
    placed = embedding.triangulate(embedding.map_landmarks(own, 2), own, told)
    return placed.select("point", "dim", F.round("x", 6).alias("x"))


# Vectors
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query()
def ml3_strip_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector's nearest other in the plane of the first two principal axes of the others, by strips."""
    rows = _vectors(spark, sf_dir)
    train, test = rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")
    flat = strips.projected(rows, "v", *strips.principal_axes(train, "v", 2))
    found = strips.strip_nearest(flat.where("id % 5 <> 0"), flat.where("id % 5 = 0"), 64)
    return found.join(test.select(F.col("id").alias("test_id"), F.col("label").alias("own")), "test_id").select("test_id", "train_id", (F.col("label") != F.col("own")).alias("error"), "measured")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letter_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, label): each document's shares of the letters a to z, and its language."""
    text = F.lower(F.coalesce("text", F.lit("")))
    shares = [(F.length(text) - F.length(F.translate(text, c, ""))) / F.greatest(F.length(text), F.lit(1)) for c in LETTERS]
    return table(spark, sf_dir, "documents").where("lang is not null").select(F.col("doc_id").alias("id"), F.array(*shares).alias("v"), F.col("lang").alias("label"))


@query()
def ml11_projected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in telling a document's language from its letters: by one prototype a language, and behind a learned plane."""
    rows = _letter_shares(spark, sf_dir)
    numbered = rows.join(F.broadcast(rows.select("label").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("label")).cast("long"))), "label")  # one row a language
    rows = cut(numbered.select("id", "v", F.col("k").alias("label")))
    wrong = lambda form, *model: prototypes.classify(rows, *model).join(rows, "id").agg(F.lit(form).alias("form"), F.avg((F.col("predicted") != F.col("label")).cast("double")).alias("error_rate"), F.count("*").alias("n"))
    plain = prototypes.learn_vectors(rows, epochs=5)
    return wrong("plain", *plain).union(wrong("projected", *prototypes.learn_projection(rows)))


@query()
def ml15_correlation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane of all vectors whose distances follow those of the vectors, from that of the first two components."""
    rows = _vectors(spark, sf_dir)
    start = strips.projected(rows, "v", *strips.principal_axes(rows, "v", 2)).select("id", F.col("v").alias("p"))
    placed, _ = fitting.correlation_map(rows, start, rounds=16)
    return placed.select(F.col("id").alias("vec_id"), F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


# Text
@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT unnest(string_split(t, '')) AS ch FROM l)
SELECT ch, CAST(strlen(ch) AS DOUBLE) AS width, count(*) AS n FROM c WHERE ch <> '' GROUP BY ch UNION ALL SELECT '', 0, count(*) FROM l""")
def txt21_character_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width of each character as told by the widths of all lines: here bytes, so the answer is known."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    fitted = fitting.fit_widths(lines.withColumn("width", F.octet_length("text")), tolerance=1e-9)
    return fitted.select("ch", (F.round("width", 3) + F.lit(0.0)).alias("width"), "n")


#: Marks planted into documents at their commonest beginnings of words.
PLANTED = (("\\bth", "{{th"), ("\\bon", "}} on"), ("\\bde", "{| de"), ("\\ba", "|} a"))


@query()
def fn10_nested_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with planted templates and tables, nested and broken ones among them, without their markup."""
    text = F.col("text")
    for pattern, mark in PLANTED:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(mark))
    return table(spark, sf_dir, "documents").select("doc_id", prose.strip_nested_markup(text).alias("plain"))


@query()
def ag31_weekly_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day and kind of event, the users and the quartiles of the week up to it, from daily sketches."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    daily = cut(sketches.daily_sketches(rows, "day", ["event_type"], "user_id", "value"))
    return sketches.over_windows(daily, ["event_type"], 7, [0.25, 0.5, 0.75])


# Lines of one order, returned ones against kept ones: keys have one to seven lines on either side.
_ZIPPED = """WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS i,
  count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS m FROM lineitem)
SELECT a.k, CAST(a.i AS BIGINT) AS i, a.n AS returned, b.n AS kept FROM x a JOIN x b ON a.k = b.k AND a.i = b.i AND a.m = b.m WHERE a.f = 'R' AND b.f = 'N'"""


@query(_ZIPPED)
def jn6_positional_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with as many returned as kept lines, which may be several: the first with the first, and so on."""
    register(spark, sf_dir, ["lineitem"])
    return spark.sql(_ZIPPED)


@query(analytics.SQL["st3_mann_whitney"][1])
def st3_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U of two samples by ranks counted over ranges of the values; equal values share the mean of their places."""
    register(spark, sf_dir, ["events"])
    rows = spark.sql(f"{analytics._PAIRS} SELECT x AS v, 1 AS g FROM q UNION ALL SELECT y, 2 FROM q")
    placed = ordered.global_rank(rows, [F.col("v")], "place").groupBy("v").agg((F.avg("place") + 1).alias("r"), F.sum((F.col("g") == 1).cast("long")).alias("n"))
    n = F.sum("n")
    return placed.agg(F.round(F.sum(F.col("n") * F.col("r")) - n * (n + 1) / 2, 4).alias("u"))


# Language profiles over bytes: grams of one to five bytes of a word between underscores, spelt in hexadecimal.
_SPARK_BYTES = "transform(sequence(0, length(hex(encode(concat('_', w, '_'), 'UTF-8'))) div 2 - 1), i -> substring(hex(encode(concat('_', w, '_'), 'UTF-8')), 2 * i + 1, 2))"
_DUCK_BYTES = "list_transform(range(0, length(hex('_' || w || '_')) // 2), lambda i: substring(hex('_' || w || '_'), CAST(2 * i + 1 AS BIGINT), 2))"


def byte_profile(key: str, spark: bool) -> str:
    mine, other = (analytics.SPARK_LETTERS, _SPARK_BYTES) if spark else (analytics.DUCK_LETTERS, _DUCK_BYTES)
    return analytics.profile(key, "", spark).replace(mine, other)


_BYTE_PROFILE = f"WITH {byte_profile('lang', False)} SELECT lang, g, r FROM r"


@query(_BYTE_PROFILE)
def txt14_byte_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 400 most frequent grams of bytes, ties in order of the bytes."""
    register(spark, sf_dir, ["documents"])
    return spark.sql(f"WITH {byte_profile('lang', True)} SELECT lang, g, CAST(r AS BIGINT) AS r FROM r")


@query(f"WITH {byte_profile('lang', False)}{analytics._DISTANCE}")
def txt15_byte_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The out-of-place distance of each two languages by their byte grams; the profiles are made once."""
    p = cut(txt14_byte_profile(spark, sf_dir))
    langs = p.select(F.col("lang").alias("y")).distinct()
    mine = p.select(F.col("lang").alias("x"), "g", "r").join(F.broadcast(langs), F.lit(True))  # languages times 400 grams
    other = p.select(F.col("lang").alias("y"), "g", F.col("r").alias("q"))
    return mine.join(other, ["y", "g"], "left").groupBy("x", "y").agg(F.sum(F.coalesce(F.abs(F.col("r") - F.col("q")), F.lit(400))).cast("long").alias("damage"))
