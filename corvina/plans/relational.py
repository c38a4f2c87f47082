"""Relational core as SQL: projections, joins, aggregates, ordered analytics, sets, sorting.

Each entry is Spark SQL and, where the dialects differ, the DuckDB form.
"""

from __future__ import annotations

SQL: dict[str, tuple[str, str]] = {}


def add(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    SQL[name] = (spark_sql, duck_sql or spark_sql)


# Scans
add("src1_scan", "SELECT p_partkey, p_name, p_brand FROM part")
add("src6_lines", "SELECT doc_id, pos, line FROM documents LATERAL VIEW posexplode(split(text, '\n')) t AS pos, line",
    "SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
add("src14_scrape", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, size(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links FROM pages".replace('\\"', '"'),
    r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS INTEGER) AS links FROM pages""")
add("src15_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
add("src17_rescan", """
WITH known AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
fresh AS (SELECT user_id, max(ts) AS seen, max(event_id) AS last_id FROM events GROUP BY user_id)
SELECT f.user_id, CASE WHEN k.seen IS NULL OR f.seen > k.seen THEN 'reread' ELSE 'known' END AS state, f.last_id
FROM fresh f LEFT JOIN known k ON f.user_id = k.user_id""")
add("src18_concat", "SELECT c_name AS name, 'customer' AS section FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
add("src22_primes", """
WITH n AS (SELECT id AS n FROM range(2, 500))
SELECT a.n AS prime FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.n < a.n AND a.n % b.n = 0)""",
    "WITH n AS (SELECT range AS n FROM range(2, 500)) SELECT a.n AS prime FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.n < a.n AND a.n % b.n = 0)")

# Sinks as old + delta -> new
add("snk5_insert_or_ignore", """
WITH old AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, upper(c_name) AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT k, v FROM old UNION ALL SELECT n.k, n.v FROM new n LEFT ANTI JOIN old o ON n.k = o.k""", """
WITH old AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, upper(c_name) AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT k, v FROM old UNION ALL SELECT n.k, n.v FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.k = o.k)""")
add("snk6_upsert", """
WITH old AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, upper(c_name) AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM old o FULL OUTER JOIN new n ON n.k = o.k""")
add("snk7_insert_or_replace", """
WITH u AS (SELECT o_custkey AS k, o_orderkey AS ver, o_totalprice AS v FROM orders)
SELECT k, ver, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ver DESC) AS r FROM u) t WHERE r = 1""")
add("snk8_versions", """
WITH v AS (SELECT o_orderkey AS id, o_custkey AS owner, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS last_id FROM orders)
SELECT a.id, a.owner, a.last_id, b.id IS NULL AS is_current FROM v a LEFT JOIN v b ON b.last_id = a.id""")
add("snk9_cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")

# Projection and filter
add("prj1_derived", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS gross FROM lineitem ")
add("prj2_sentences", "SELECT doc_id, trim(s) AS sentence FROM documents LATERAL VIEW explode(split(text, '[.!?]')) t AS s WHERE trim(s) <> ''",
    "SELECT doc_id, trim(s) AS sentence FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]')) AS s FROM documents) WHERE trim(s) <> ''")
add("prj3_pairs", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
add("prj5_filters", "SELECT l_orderkey, l_linenumber FROM (SELECT * FROM (SELECT * FROM lineitem WHERE l_quantity > 10) a WHERE l_discount < 0.05) b WHERE l_returnflag = 'R'")
add("prj6_stale", "SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '1995-01-01 00:00:00' ORDER BY o_orderkey LIMIT 200")
add("prj7_quantifiers", "SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'a') AND contains(lower(p_name), 'e')) AND NOT (contains(lower(p_name), 'z') OR contains(lower(p_name), 'q'))")
add("prj8_member", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
add("prj9_contains_all", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT CASE WHEN event_type IN ('click', 'error', 'purchase', 'signup', 'view') THEN event_type END) = 5")
add("prj10_label_splits", """
SELECT p_partkey, substring(p_name, 1, i - 1) AS artist, substring(p_name, i + 1) AS title FROM part
LATERAL VIEW explode(filter(sequence(1, length(p_name)), i -> substring(p_name, i, 1) = ' ')) t AS i""", """
SELECT p_partkey, substring(p_name, 1, i - 1) AS artist, substring(p_name, i + 1) AS title
FROM (SELECT p_partkey, p_name, unnest(list_filter(range(1, length(p_name) + 1), lambda j: substring(p_name, j, 1) = ' ')) AS i FROM part)""")

# Joins
add("jn1_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
add("jn2_natural", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b WHERE k = 2")
add("jn3_comma", "SELECT c_name, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND o_totalprice > 100000")
add("jn4_anti_ratio", """
SELECT round(sum(CASE WHEN o.k IS NULL THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS share_without FROM customer c
LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c.c_custkey""")
add("jn5_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
add("jn6_positional", """
WITH a AS (SELECT o_orderkey AS k, o_custkey AS v, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey) AS r, count(*) OVER (PARTITION BY o_orderkey) AS n FROM orders),
b AS (SELECT l_orderkey AS k, l_linenumber AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT a.k, a.v AS left_id, b.v AS right_id FROM a JOIN b ON a.k = b.k AND a.r = b.r AND a.n = b.n""")
add("jn7_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
add("jn8_first_match", "SELECT c_custkey, first_order FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
add("jn9_four_tables", """
SELECT n_name, l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 49 AND o_orderstatus = 'F' AND n_name < 'NATION_2'""")
add("jn10_modified_key", """
WITH r AS (SELECT o_custkey, o_orderpriority, concat(o_orderstatus, '') AS s, round(avg(o_totalprice), 4) AS err FROM orders GROUP BY o_custkey, o_orderpriority, o_orderstatus)
SELECT a.o_custkey, a.o_orderpriority, a.err AS base, b.err AS variant FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.s = 'F' AND b.s = 'O'""")
add("jn11_dice", "SELECT CAST(a.id + b.id + c.id AS BIGINT) AS total, count(*) AS ways FROM range(1, 7) a CROSS JOIN range(1, 7) b CROSS JOIN range(1, 7) c GROUP BY 1",
    "SELECT CAST(a.range + b.range + c.range AS BIGINT) AS total, count(*) AS ways FROM range(1, 7) a CROSS JOIN range(1, 7) b CROSS JOIN range(1, 7) c GROUP BY 1")
add("jn14_nearest", """
WITH t AS (SELECT c_custkey, c_acctbal FROM customer), o AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders)
SELECT c_custkey, o_orderkey FROM (
  SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(o_totalprice - 20 * c_acctbal), o_orderkey) AS r FROM t JOIN o ON c_custkey = o_custkey) x WHERE r = 1""")
add("jn15_agreeing_best", """
WITH p AS (SELECT o_custkey AS k, o_orderkey AS id, count(*) AS overlap, min(abs(o_totalprice - l_extendedprice)) AS gap FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_totalprice),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY overlap DESC, id) AS a, row_number() OVER (PARTITION BY k ORDER BY gap, id) AS b FROM p)
SELECT k, id FROM r WHERE a = 1 AND b = 1""")
add("jn19_full_outer", "SELECT coalesce(c.k, s.k) AS k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")

# Aggregation
add("ag1_group_avg", "SELECT event_type, CAST(CAST(ts AS DATE) AS STRING) AS day, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2",
    "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2")
add("ag2_having", "SELECT line, count(*) AS n FROM (SELECT explode(split(text, '\n')) AS line FROM documents) GROUP BY line HAVING count(*) > 2",
    "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line HAVING count(*) > 2")
add("ag3_merge_lists", """
WITH l AS (SELECT o_custkey, o_orderpriority AS item, o_totalprice AS sim, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS lead FROM orders)
SELECT item, round(sum(sim / lead), 4) AS score FROM l GROUP BY item""")
add("ag4_scalar", "SELECT max(o_orderkey) AS last_id, count(*) AS n FROM orders")
add("ag5_latest", "SELECT o.o_custkey, o.o_orderkey FROM orders o JOIN (SELECT o_custkey AS k, max(o_orderkey) AS m FROM orders GROUP BY o_custkey) x ON o.o_custkey = x.k AND o.o_orderkey = x.m")
add("ag6_distinct", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) t WHERE r = 1")
add("ag7_arg_min", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part) t WHERE r = 1")
add("ag8_index_of_max", "SELECT user_id, min(i) AS idx FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, max(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id) AS m, event_type FROM events) t WHERE value = m AND event_type <> 'error' GROUP BY user_id",
    "SELECT user_id, CAST(min(i) AS INTEGER) AS idx FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, max(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id) AS m, event_type FROM events) t WHERE value = m AND event_type <> 'error' GROUP BY user_id")
add("ag9_weighted", """
WITH m AS (SELECT l_returnflag AS f, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS mean, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag)
SELECT f, round(max(mean), 4) AS mean, round(sum(l_quantity * (l_extendedprice - mean) * (l_extendedprice - mean)) / max(w), 2) AS var_pop,
  round(sum(l_quantity * (l_extendedprice - mean) * (l_extendedprice - mean)) / (max(w) - 1), 2) AS var_samp FROM lineitem JOIN m ON l_returnflag = f GROUP BY f""")
add("ag10_vector_moments", "SELECT pos, round(avg(CAST(x AS DOUBLE)), 8) AS mean, round(stddev_samp(CAST(x AS DOUBLE)) / sqrt(count(*)), 8) AS std_err FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x GROUP BY pos",
    "SELECT pos, round(avg(CAST(x AS DOUBLE)), 8) AS mean, round(stddev_samp(CAST(x AS DOUBLE)) / sqrt(count(*)), 8) AS std_err FROM (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY pos")
add("ag11_central_moments", """
WITH m AS (SELECT avg(o_totalprice) AS mu FROM orders)
SELECT round(avg(power((o_totalprice - mu) / 1000, 2)), 4) AS central_moment_2, round(avg(power((o_totalprice - mu) / 1000, 3)), 3) AS central_moment_3, round(avg(power((o_totalprice - mu) / 1000, 4)), 1) AS central_moment_4 FROM orders CROSS JOIN m""")
add("ag12_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem")
add("ag13_sample", "SELECT o_orderstatus, round(var_samp(o_totalprice), 2) AS var_samp, round(stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS std_err FROM orders GROUP BY o_orderstatus")
add("ag14_accumulate", "SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(sum(value), 3) AS total, count(value) AS n FROM events GROUP BY event_type")
add("ag15_median", "SELECT o_orderstatus, round(percentile(o_totalprice, 0.5), 4) AS median FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders GROUP BY o_orderstatus")
add("ag16_p95", "SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) t WHERE r = CAST(floor(n * 0.95) AS INT) + 1")
add("ag17_trimmed_bounds", "SELECT event_type, min(value) AS lo, max(value) AS hi FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) t WHERE r > floor(0.5 * 0.1 * n + 0.5) AND r <= n - floor(0.5 * 0.1 * n + 0.5) GROUP BY event_type")
add("ag19_time_histogram", """
WITH b AS (SELECT CAST(id AS INT) AS bin FROM range(0, 24)), e AS (SELECT CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 3600.0) AS INT) AS bin FROM events)
SELECT b.bin, count(e.bin) AS n FROM b LEFT JOIN e ON b.bin = e.bin GROUP BY b.bin""", """
WITH b AS (SELECT CAST(range AS INT) AS bin FROM range(0, 24)), e AS (SELECT CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 3600.0) AS INT) AS bin FROM events)
SELECT b.bin, count(e.bin) AS n FROM b LEFT JOIN e ON b.bin = e.bin GROUP BY b.bin""")
add("ag20_grid", "SELECT l_returnflag, CAST(floor(l_quantity / 5) AS INT) AS x, CAST(floor(l_extendedprice / 10000) AS INT) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
add("ag21_large_groups", "SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n, dense_rank() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY p_brand HAVING count(*) >= 5) t WHERE r <= 10")
add("ag22_group_lists", "SELECT p_brand, p_size, array_join(sort_array(collect_list(p_partkey)), ',') AS parts FROM part GROUP BY p_brand, p_size",
    "SELECT p_brand, p_size, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS parts FROM part GROUP BY p_brand, p_size")
add("ag23_anagrams", """
WITH w AS (SELECT DISTINCT lower(w) AS w FROM documents LATERAL VIEW explode(split(text, '[^A-Za-z]+')) t AS w WHERE w <> '')
SELECT array_join(array_sort(split(w, '')), '') AS k, count(*) AS n, (length(first(w)) - 1) * (count(*) - 1) AS score FROM w GROUP BY 1 HAVING count(*) > 1""", """
WITH w AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM documents) WHERE w <> '')
SELECT array_to_string(list_sort(string_split(w, '')), '') AS k, count(*) AS n, (length(first(w)) - 1) * (count(*) - 1) AS score FROM w GROUP BY 1 HAVING count(*) > 1""")
add("ag24_characters", "SELECT c, count(*) AS n FROM documents LATERAL VIEW explode(split(regexp_replace(text, '[^a-z]', ''), '')) t AS c WHERE c <> '' GROUP BY c",
    "SELECT c, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '[^a-z]', '', 'g'), '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
add("ag27_cumulative", "SELECT event_type, round(n / CAST(sum(n) OVER () AS DOUBLE), 8) AS p, round(sum(n) OVER (ORDER BY event_type) / CAST(sum(n) OVER () AS DOUBLE), 8) AS cum FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) t")
add("ag28_geometric_mean", "SELECT event_type, round(exp(avg(ln(abs(value) + 0.01))) - 0.01, 6) AS g FROM events GROUP BY event_type")
add("ag29_conditional", "SELECT o_orderstatus, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS better, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0E0 ELSE 0.0E0 END), 8) AS share FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS better, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END), 8) AS share FROM orders GROUP BY o_orderstatus")
add("ag30_collisions", "SELECT length(p_name) AS h, count(DISTINCT p_name) AS n FROM part GROUP BY length(p_name) HAVING count(DISTINCT p_name) > 1")
add("ag31_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")

# Ordered analytics
add("wn1_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders",
    "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders")
add("wn3_top_n", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) t WHERE r <= 3 ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
add("wn4_index_then_filter", "SELECT user_id, event_id, CAST(i AS BIGINT) AS i FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) t WHERE event_type = 'purchase'")
add("wn5_prefix_sum", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders")
add("wn6_box_blur", "SELECT day, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS blurred FROM (SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n FROM events GROUP BY 1) t",
    "SELECT day, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS blurred FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1) t")
add("wn7_islands", """
WITH f AS (SELECT user_id, ts, event_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS f FROM events),
g AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f),
l AS (SELECT user_id, island, count(*) AS n FROM g WHERE f = 1 GROUP BY user_id, island)
SELECT user_id, max(n) AS longest FROM l GROUP BY user_id""")
add("wn8_changes", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) t WHERE p IS NULL OR p <> event_type")
add("wn9_split_at", "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM events) t GROUP BY user_id, session",
    "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM events) t GROUP BY user_id, session")
add("wn10_batches", "SELECT user_id, CAST(floor(i / 10.0) AS BIGINT) AS batch, min(event_id) AS first_id, count(*) AS n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) t GROUP BY 1, 2")
add("wn13_quartiles", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) t WHERE r IN (0, CAST(floor(n / 4.0) AS INT), CAST(floor(n / 2.0) AS INT), CAST(floor(3 * n / 4.0) AS INT))")

# Sorting and limits
add("so1_sort_spec", "SELECT p_partkey FROM part ORDER BY p_name = '', p_name, p_size DESC, abs(sqrt(p_retailprice) - 15), p_partkey LIMIT 100")
add("so4_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
add("so5_priority_limit", "SELECT c_custkey, last_order FROM (SELECT c_custkey, max(o_orderkey) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t ORDER BY last_order NULLS FIRST, c_custkey LIMIT 120")
add("so6_keyset", "SELECT o_orderkey FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 100")
add("so11_decay", "SELECT user_id, round(sum(value / greatest(1, 1 + (DATE '2024-01-31' - CAST(ts AS DATE)))), 4) AS score FROM events GROUP BY user_id".replace("(DATE '2024-01-31' - CAST(ts AS DATE))", "datediff(DATE '2024-01-31', CAST(ts AS DATE))"),
    "SELECT user_id, round(sum(value / greatest(1, 1 + (DATE '2024-01-31' - CAST(ts AS DATE)))), 4) AS score FROM events GROUP BY user_id")

# Sets
add("set1_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation")
add("set2_merge", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
add("set3_intersection", "SELECT k FROM (SELECT DISTINCT c_nationkey AS k, 1 AS l FROM customer UNION ALL SELECT DISTINCT s_nationkey, 2 FROM supplier UNION ALL SELECT DISTINCT n_nationkey, 3 FROM nation WHERE n_regionkey > 1) t GROUP BY k HAVING count(DISTINCT l) = 3")
add("set4_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier")
add("set5_equals", "SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation) a) + (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer) b) = 0 AS equal")
add("set6_overlap", "SELECT a.p_brand AS x, b.p_brand AS y FROM (SELECT p_brand, collect_set(p_size) AS s FROM part GROUP BY p_brand) a JOIN (SELECT p_brand, collect_set(p_size) AS s FROM part GROUP BY p_brand) b ON a.p_brand < b.p_brand WHERE arrays_overlap(a.s, b.s)",
    "SELECT a.p_brand AS x, b.p_brand AS y FROM (SELECT p_brand, list(DISTINCT p_size) AS s FROM part GROUP BY p_brand) a JOIN (SELECT p_brand, list(DISTINCT p_size) AS s FROM part GROUP BY p_brand) b ON a.p_brand < b.p_brand WHERE list_has_any(a.s, b.s)")
add("set7_partition", """
WITH s AS (SELECT o_orderkey, o_orderkey % 10 AS b FROM orders), u AS (SELECT o_orderkey FROM s WHERE b = 0 UNION ALL SELECT o_orderkey FROM s WHERE b = 1 UNION ALL SELECT o_orderkey FROM s WHERE b > 1)
SELECT (SELECT count(*) FROM u) = (SELECT count(*) FROM orders) AND (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM u) x) = 0 AS complete""")
add("set8_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")

# Scalar functions
add("fn2_trim_safe", "SELECT doc_id, nullif(trim(regexp_replace(text, '[\\\\x00-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x1F]', '')), '') AS safe FROM documents",
    "SELECT doc_id, nullif(trim(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')), '') AS safe FROM documents")
add("fn3_ascii_lower", "SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM part")
add("fn6_levenshtein", "SELECT a.n_name AS x, b.n_name AS y, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "SELECT a.n_name AS x, b.n_name AS y, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
add("fn7_substrings", """
SELECT p_partkey, CASE WHEN instr(p_type, ' ') > 0 THEN substring(p_type, instr(p_type, ' ') + 1) END AS after_first,
  CASE WHEN instr(p_type, ' ') > 0 THEN reverse(substring(reverse(p_type), instr(reverse(p_type), ' ') + 1)) END AS before_last,
  reverse(split_part(reverse(p_type), ' ', 1)) AS after_last, split_part(p_type, ' ', 1) AS until_first FROM part""")
add("fn8_try_parse", "SELECT p_partkey, try_cast(substring(p_brand, 1, 1) AS INT) AS a, try_cast(p_brand AS DOUBLE) AS b, try_cast(CAST(p_size AS STRING) AS BIGINT) AS c FROM part",
    "SELECT p_partkey, try_cast(substring(p_brand, 1, 1) AS INT) AS a, try_cast(p_brand AS DOUBLE) AS b, try_cast(CAST(p_size AS VARCHAR) AS BIGINT) AS c FROM part")
add("fn9_white_space", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\\\t]+', ' '), ' ?\\\\n ?', '\\n'), '\\\\n{3,}', '\\n\\n')) AS t FROM documents",
    "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS t FROM documents")
add("fn13_t9", "SELECT DISTINCT p_name, translate(regexp_replace(lower(p_name), '[^a-z0-9]', ''), 'abcdefghijklmnopqrstuvwxyz', '222333444555666777888999:9') AS code FROM part",
    "SELECT DISTINCT p_name, translate(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '222333444555666777888999:9') AS code FROM part")
add("fn14_last_segment", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS last_segment FROM pages")
add("fn16_popularity", "SELECT p_partkey, round(sqrt(p_retailprice / 350000), 8) AS pop_a, round(p_size / 50.0E0, 8) AS pop_t FROM part")
add("fn17_bitrate", "SELECT p_partkey, round(try_divide(p_retailprice * 8, p_size - 1), 6) AS rate FROM part",
    "SELECT p_partkey, round(CASE WHEN p_size <> 1 THEN p_retailprice * 8 / (p_size - 1) END, 6) AS rate FROM part")
add("fn18_song_cost", "SELECT p_partkey, round(abs(ln(p_retailprice) - 5.32) + abs(ln((p_size + 1) / 216.0E0)), 8) AS cost FROM part")
add("fn19_vectors", "SELECT a.vec_id, round(aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, v) -> s + v), 8) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 8) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
add("fn21_finite", "SELECT count(*) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 1.0E308")
add("fn22_bits", "SELECT p_partkey, shiftleft(p_partkey, 2) & 255 AS packed FROM part", "SELECT p_partkey, (p_partkey << 2) & 255 AS packed FROM part")
add("fn23_dates", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, datediff(max(ts), min(ts)) AS days FROM events GROUP BY user_id",
    "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS INTEGER) AS days FROM events GROUP BY user_id")
