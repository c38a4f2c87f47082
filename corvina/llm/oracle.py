"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from corvina.llm.chat import INSTRUCT
from corvina.llm.queries import ODD_TEXT
from corvina.llm.rules import METHOD_RULES, STOP_WORDS, Rule

_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op4() -> str:
    specials = INSTRUCT.escape + INSTRUCT.specials
    other = INSTRUCT.other
    marks = " ".join(f"WHEN {_quote(p.role)} THEN {len(p.before) + len(p.after)}" for p in INSTRUCT.parts)
    known = ", ".join(_quote(p.role) for p in INSTRUCT.parts)
    loss = ", ".join(_quote(p.role) for p in INSTRUCT.parts if p.loss)
    escaped = lambda c: f"(2 * length({c}) - length(translate({c}, {_quote(specials)}, '')))"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_quote(ODD_TEXT)} UNION ALL SELECT -7, 1, 'assistant', {_quote(ODD_TEXT)}),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role IN ({loss}) THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    string_agg(role || ',', '' ORDER BY turn, role, text) AS roles,
    sum(CASE role {marks} ELSE {len(other.before) + len(other.after)} END + {escaped('text')}
        + CASE WHEN role IN ({known}) THEN 0 ELSE 3 + {escaped('role')} END) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars,
  regexp_full_match(roles, '(system,)?user,(assistant,user,)*(assistant,)?') AS valid
FROM g
"""


OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _breaks(rule: Rule) -> str:
    of = "1" if rule.of == "one" else rule.of
    tests = []
    if rule.low is not None:
        tests.append(f"{rule.metric} * 1000 < {of} * {round(rule.low * 1000)}")
    if rule.high is not None:
        tests.append(f"{rule.metric} * 1000 > {of} * {round(rule.high * 1000)}")
    return f"(n_words >= {rule.from_words} AND ({' OR '.join(tests)}))"


def _op10() -> str:
    stop = ", ".join(_quote(w) for s in STOP_WORDS for w in (s, s[:1].upper() + s[1:]))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format(text='text')} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
key AS (SELECT r, i, w[i:i + 4] AS g FROM win),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM key) WHERE c > 1),
cover AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM again, (SELECT unnest(range(5)) AS k)) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words,
    len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_loud_words
  FROM d LEFT JOIN cover USING (r)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(_breaks(x) for x in METHOD_RULES)}) AS kept, n_lines, n_stop_words, n_loud_words
FROM j
"""


OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.replace('text', "coalesce(text, '')", 1)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.replace('text', "coalesce(text, '')", 1)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i,
    unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM d, (SELECT DISTINCT k FROM win)),
hit AS (SELECT r, i, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
cover AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover c ON c.r = d.r LEFT JOIN items i ON i.r = d.r
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gp AS (
  SELECT *, 1 + (1000000000 * (n + 1)) // CAST(sum(n) OVER w + count(*) OVER w AS BIGINT) AS p
  FROM gn WINDOW w AS (PARTITION BY lang, source)),
lp AS (
  SELECT lang, term, 1 + (1000000000 * (n + 1)) // CAST(sum(n) OVER w + count(*) OVER w AS BIGINT) AS q
  FROM kept WINDOW w AS (PARTITION BY lang)),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM gp a JOIN gp b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, ((p - q) * (p - q)) // q AS value
  FROM gp JOIN lp ON lp.lang = gp.lang AND lp.term = gp.term WHERE n > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": OP1,
    "op4_chat_format": _op4(),
    "op9_exact_top_k": OP9,
    "op10_quality_rules": _op10(),
    "op12_decontamination": OP12,
    "op13_source_divergence": OP13,
}
