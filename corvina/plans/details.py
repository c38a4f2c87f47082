"""Parts of operators that the first queries leave out: kernels, shares, packing, decoding, learned prefixes, dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import prose, strings
from corvina.operators import profiles, text
from corvina.plans import models
from corvina.plans.analytics import DUCK_LETTERS, SPARK_LETTERS, profile
from corvina.plans.deeper import _DUCK_BYTES, _SPARK_BYTES, duck_canonical
from corvina.session import table

SQL: dict[str, tuple[str, str]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(duck_sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = duck_sql
        return f

    return add


# Cells are counted first, so a kernel is spread over cells, not rows.
_OFFSETS = ", ".join(f"('{k}', {x}, {y})" for k, near in (("single", 0), ("diamond", 1), ("square", 2)) for x in (-1, 0, 1) for y in (-1, 0, 1) if abs(x) + abs(y) <= near)
SQL["ag20_kernels"] = (f"""WITH c AS (SELECT l_returnflag, CAST(floor(l_quantity / 5) AS INT) AS cx, CAST(floor(l_extendedprice / 10000) AS INT) AS cy, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT * FROM (VALUES {_OFFSETS}) AS t(kernel, dx, dy))
SELECT kernel, l_returnflag, cx + dx AS x, cy + dy AS y, CAST(sum(n) AS BIGINT) AS n FROM c CROSS JOIN k GROUP BY kernel, l_returnflag, cx + dx, cy + dy""",) * 2
SQL["ag24_character_shares"] = (
    "WITH x AS (SELECT c, count(*) AS n FROM documents LATERAL VIEW explode(split(text, '')) t AS c WHERE c <> '' AND ascii(c) < 128 GROUP BY c) SELECT ascii(c) AS code, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 8) AS share FROM x",
    "WITH x AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' AND unicode(c) < 128 GROUP BY c) SELECT unicode(c) AS code, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 8) AS share FROM x",
)
SQL["ag30_hash_collisions"] = (
    "WITH w AS (SELECT DISTINCT w FROM documents LATERAL VIEW explode(split(text, '[^a-zA-Z]+')) t AS w WHERE w <> '') SELECT substring(md5(CAST(w AS BINARY)), 1, 4) AS h, count(*) AS n FROM w GROUP BY 1 HAVING count(*) > 1",
    "WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) AS w FROM documents) WHERE w <> '') SELECT substring(md5(w), 1, 4) AS h, count(*) AS n FROM w GROUP BY 1 HAVING count(*) > 1",
)
SQL["fn22_packing"] = (
    """SELECT p_partkey, CAST(conv(hex(substring(encode(p_name, 'UTF-8'), 1, 4)), 16, 10) AS BIGINT) AS head, CAST(conv(hex(substring(encode(p_name, 'UTF-8'), 1, 4)), 16, 10) AS BIGINT) & 16711935 AS masked,
coalesce(CAST(conv(translate(substring(regexp_replace(lower(p_name), '[^acgt]', ''), 1, 16), 'acgt', '0123'), 4, 10) AS BIGINT), 0) AS packed FROM part""",
    """SELECT p_partkey, CAST('0x' || hex(substring(p_name, 1, 4)) AS BIGINT) AS head, CAST('0x' || hex(substring(p_name, 1, 4)) AS BIGINT) & 16711935 AS masked,
coalesce(list_reduce(list_transform(list_filter(string_split(translate(substring(regexp_replace(lower(p_name), '[^acgt]', '', 'g'), 1, 16), 'acgt', '0123'), ''), lambda c: c <> ''), lambda c: CAST(c AS BIGINT)), lambda a, b: a * 4 + b, CAST(0 AS BIGINT)), 0) AS packed FROM part""",
)
SQL["fn23_day_fraction"] = (
    "SELECT event_id, round((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0E0, 8) AS fraction, datediff(m, ts) AS age FROM events CROSS JOIN (SELECT max(ts) AS m FROM events) t",
    "SELECT event_id, round((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0, 8) AS fraction, CAST(date_diff('day', CAST(ts AS DATE), CAST(m AS DATE)) AS INTEGER) AS age FROM events CROSS JOIN (SELECT max(ts) AS m FROM events) t",
)

# Classes of prefixes are learned from the benchmark's words: the letter that follows a prefix most often.
_PREFIXES = """WITH w AS ({train}), x AS (SELECT {each}), c AS (SELECT q, nxt, count(*) AS n FROM x GROUP BY q, nxt),
t AS (SELECT q, nxt AS c FROM (SELECT q, nxt, sum(n) OVER (PARTITION BY q) AS total, row_number() OVER (PARTITION BY q ORDER BY n DESC, nxt) AS r FROM c) y WHERE r = 1 AND total >= 5),
a AS (SELECT DISTINCT w FROM ({asked}) b), p AS (SELECT w, {prefixes} AS q FROM a)
SELECT w, q AS prefix, c FROM (SELECT p.w, p.q, t.c, row_number() OVER (PARTITION BY p.w ORDER BY length(p.q) DESC) AS r FROM p JOIN t ON t.q = p.q) z WHERE r = 1"""
SQL["txt18_learned_prefixes"] = (
    _PREFIXES.format(
        train=models._SPARK_WORDS.replace("documents", "benchmark"), each="s.q, s.nxt FROM w LATERAL VIEW inline(transform(sequence(0, least(4, length(w) - 1)), i -> struct(substring(w, 1, i) AS q, substring(w, i + 1, 1) AS nxt))) s AS q, nxt",
        asked=models._SPARK_WORDS, prefixes="explode(transform(sequence(0, least(4, length(w))), i -> substring(w, 1, i)))",
    ),
    _PREFIXES.format(
        train=models._DUCK_WORDS.replace("documents", "benchmark"), each="substring(w, 1, i) AS q, substring(w, i + 1, 1) AS nxt FROM (SELECT w, unnest(range(0, least(4, length(w) - 1) + 1)) AS i FROM w) v",
        asked=models._DUCK_WORDS, prefixes="unnest(list_transform(range(0, least(4, length(w)) + 1), lambda i: substring(w, 1, CAST(i AS BIGINT))))",
    ),
)
SQL["txt17_byte_least_damage"] = (
    *[models._LEAST_DAMAGE.format(docs=profile("doc_id", "d", s), langs=profile("lang", "l", s)).replace(SPARK_LETTERS if s else DUCK_LETTERS, _SPARK_BYTES if s else _DUCK_BYTES) for s in (True, False)],
)


@query(SQL["txt17_byte_least_damage"][1])
def txt17_byte_least_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over grams of bytes."""
    documents = table(spark, sf_dir, "documents")
    return profiles.least_damage(documents, profiles.language_profiles(documents, True), True, models.LEAST_DAMAGE_OF.replace(SPARK_LETTERS, _SPARK_BYTES))


@query(r"""SELECT page_id, replace(url_decode(replace(regexp_extract(url, '([^/]*)$', 1), '%', '%25') || '%25zz%41' ), '%25', '%') AS last_segment FROM pages""")
def fn14_decoded_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded last segment of urls with a sound and a stray escape planted behind them."""
    return table(spark, sf_dir, "pages").select("page_id", strings.last_path_segment(F.concat("url", F.lit("%zz%41"))).alias("last_segment"))


@query("""WITH l AS (SELECT p_partkey, string_split(p_brand || ' - ' || p_type || ' - ' || p_name, ' - ') AS s FROM part), i AS (SELECT p_partkey, s, unnest(range(1, len(s))) AS i FROM l)
SELECT p_partkey, array_to_string(s[1:i], ' - ') AS artist, array_to_string(s[i + 1:], ' - ') AS title FROM i""")
def prj10_dash_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of three parts, split at every " - "."""
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(text.label_splits(F.concat_ws(" - ", "p_brand", "p_type", "p_name"))))


def _duck_grams(c: str) -> str:
    padded = f"CASE WHEN length({c}) < 3 THEN lpad({c}, 3, chr(65533)) ELSE {c} END"
    return f"list_transform(range(1, length({padded}) - 1), lambda i: substring({padded}, i, 3))"


@query(f"""WITH c AS (SELECT p_partkey, {duck_canonical('p_brand')} AS a, {duck_canonical('p_name')} AS t FROM part)
SELECT p_partkey, CAST(len(list_distinct(list_concat({_duck_grams('a')}, {_duck_grams('t')}))) AS INTEGER) AS n FROM c""")
def txt8_song_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different trigrams a part's canonical brand and name have."""
    canon = table(spark, sf_dir, "part").select("p_partkey", text.canonicalise("p_brand").alias("artist"), text.canonicalise("p_name").alias("title"))
    return canon.select("p_partkey", F.size(text.grams_of(F.col("artist"), F.col("title"))).alias("n"))


_WORD = r"[^\s\x0B]+"


@query(rf"""WITH d AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM benchmark)),
k AS (SELECT doc_id, count(*) AS known FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM documents) x JOIN d ON d.w = lower(x.w) GROUP BY doc_id),
g AS ({models.ORACLE["fn12_grade"].replace(", 6) END AS grade", ", 12) END AS grade, words").replace("WITH c AS", "WITH cc AS").replace("FROM c", "FROM cc")})
SELECT g.doc_id, CASE WHEN words > 0 THEN round(grade + CAST(2 * coalesce(known, 0) - words AS DOUBLE) / words, 6) END AS grade FROM g LEFT JOIN k ON k.doc_id = g.doc_id""")
def fn12_dictionary_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents graded with a dictionary: the words of the benchmark."""
    words = lambda name: F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias(name)
    known = table(spark, sf_dir, "benchmark").select(words("w")).select(F.lower("w").alias("w")).distinct()
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", words("x")).join(known, F.lower("x") == F.col("w")).groupBy("doc_id").agg(F.count("*").alias("known"))
    return docs.join(found, "doc_id", "left").select("doc_id", F.round(prose.grade(F.col("text"), F.coalesce("known", F.lit(0))), 6).alias("grade"))


@query(r"""SELECT doc_id, regexp_replace(concat(coalesce(text, ''), chr(8203), 'a', chr(13), chr(9), 'b', chr(57344), 'c', chr(133)), '[\x00-\x08\x0B-\x1F\x7F-\x{9F}\p{Cf}\p{Co}]', '', 'g') AS plain FROM documents""")
def fn1_reasonable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, with some odd characters planted behind them, without what is no character of a text."""
    return table(spark, sf_dir, "documents").select("doc_id", strings.reasonable(F.concat(F.coalesce("text", F.lit("")), F.lit("\u200ba\r\tb\ue000c\x85"))).alias("plain"))
