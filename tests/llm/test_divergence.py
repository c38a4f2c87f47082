"""Source divergence against a plain version, in whole numbers."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from corvina.llm import divergence
from corvina.llm.oracle import OP13

SCHEMA = "lang string, source string, text string"


def plain(rows, least_docs=3, top=200):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    held, own, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in texts:
        held[lang].update(set(words))
        own[lang, source].update(words)
        whole[lang].update(words)
    out = []
    for lang in held.keys() | {t[0] for t in texts}:
        kept = sorted(t for t, n in held[lang].items() if n >= least_docs)
        share = lambda n: {t: 1 + 10**9 * (n[t] + 1) // (sum(n[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // q
        sources = sorted({s for x, s, _ in texts if x == lang})
        p, q = {s: share(own[lang, s]) for s in sources}, share(whole[lang])
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if own[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def audited(spark, rows, **options):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), **options).collect())


ROWS = [
    *[("en", f"s{i % 7}", f"the cat number{i % 3} sat ÄÉ x{i % 5} The") for i in range(40)],
    *[("en", "s1", "cat cat cat the")] * 3, ("en", None, "the sat"), ("en", "none", None), ("en", "blank", "12 34 _"), (None, "a", "lone words"), (None, "b", "lone words"), (None, None, "lone"),
    ("xx", "only", "one two"), ("yy", "p", "q"), ("yy", "r", ""), ("de", "s0", "zß ü ü zß"), ("de", "s0", "zß ü"), ("de", "s1", "ü zß KK"), ("de", "s2", ""),
]


@pytest.mark.parametrize("options", [{}, {"block": 2, "chunk": 2, "span": 1}, {"block": 3, "chunk": 4, "span": 2, "few": 1}, {"top": 2}, {"least_docs": 1, "block": 1}])
def test_plain(spark, options):
    assert audited(spark, ROWS, **options) == plain(ROWS, options.get("least_docs", 3), options.get("top", 200))


def test_pieces_and_flushes(spark, monkeypatch):
    """Texts split into pieces, and tallies handed on often, change nothing."""
    text = "äb cd " * 5_000 + "e" * 3_000 + " äb"
    want = [(lang, source, n) for lang, source, n in [("en", "s", [3 * 5_001, 3 * 5_000, 3])]]
    docs = spark.createDataFrame([("en", "s", text)] * 3, SCHEMA)
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [x for part in divergence._terms("ab cdefghijk lm " * 3) for x in part] == [b"ab", b"cdefghijk", b"lm"] * 3
    got = {r.term: r.n for r in divergence.counts(docs).where("term is not null").collect()}
    assert sorted(got.values(), reverse=True) == want[0][2]


def test_large_counts():
    """Shares of counts whose plain product would pass 2^63."""
    import numpy as np

    for n, total in ((0, 3), (10**12, 3 * 10**12), (2 * 10**14 - 1, 2 * 10**14), (123_456_789_012, 987_654_321_098)):
        assert divergence._share(np.array([n]), total)[0] == 1 + 10**9 * (n + 1) // total


def test_share_columns(spark):
    rows = [(0, 3), (10**12, 3 * 10**12), (2 * 10**14 - 1, 2 * 10**14)]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(rows, "n long, total long").select(divergence.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 1) // total for n, total in rows]


def test_sql_on_the_same_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", ROWS)
    assert sorted(con.execute(OP13).fetchall()) == audited(spark, ROWS)


def test_empty_and_other_columns(spark):
    assert audited(spark, []) == []
    docs = spark.createDataFrame([("en", "a", "x y", 1, "z")] * 3 + [("en", "b", "x", 2, None)], SCHEMA + ", term int, n string")
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == plain([("en", "a", "x y")] * 3 + [("en", "b", "x")])
