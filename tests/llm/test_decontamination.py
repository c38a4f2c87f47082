"""Decontamination against plain search, on edge cases and planted passages."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from corvina.llm import decontamination as dc
from corvina.llm.oracle import OP12


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    windows = []
    for item_id, text in items:
        w = words(text)
        k = min(window, len(w))
        windows += [(item_id, tuple(w[i : i + k])) for i in range(len(w) - k + 1) if k]
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for item_id, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    ids |= {str(item_id)} if item_id is not None else set()
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), sha, bool(hit)))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def reported(spark, docs, items, **options):
    return sorted((tuple(r) for r in dc.report(*tables(spark, docs, items), **options).collect()), key=repr)


PASSAGE = "Zero one two three four five six seven eight nine ten eleven twelve"
ITEMS = [
    (1, PASSAGE), (2, "short item here"), (11, "short item here"), (3, None), (4, ""), (5, "?!"), (6, "a"), (None, "nameless three words"), (7, PASSAGE.upper() + " and more of it"), (1, PASSAGE),
    (8, "é ü straße über naïve café déjà vu señor niño"), (9, " ".join(["rep"] * 12)),
]
DOCS = [
    (1, None), (2, ""), (3, "..."), (4, f"Before, {PASSAGE.replace(' ', ' - ')}! after"), (5, PASSAGE[:45]), (6, "a SHORT\nitem: here again short item"), (7, "nameless three words"), (8, f"{PASSAGE} {PASSAGE}"),
    (9, "rep " * 30), (9, "rep " * 30), (None, "x short item here y"), (10, "É Ü STRAßE"), (11, "é ü straße über naïve café déjà vu señor niño"), (12, "short item"), (13, "here short"), (14, "A"), (15, PASSAGE + " and more"),
]


@pytest.mark.parametrize("options", [{}, {"block": 7}, {"window": 3}])
def test_plain(spark, options):
    assert reported(spark, DOCS, ITEMS, **options) == plain(DOCS, ITEMS, options.get("window", 10))


def test_shards(spark, monkeypatch):
    """A shard never joins the words of two documents."""
    monkeypatch.setattr(dc, "SHARD", 3)
    docs = [(i, t) for i, t in enumerate(["short item", "here", PASSAGE[:30], PASSAGE[30:], "short item here"])]
    assert reported(spark, docs, ITEMS[:9]) == plain(docs, ITEMS[:9])


def test_random(spark):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs, items = [(i, text(rng.randint(0, 400))) for i in range(30)], [(i, text(rng.randint(1, 14))) for i in range(25)]
    assert reported(spark, docs, items, window=6) == plain(docs, items, 6)


def test_suffix_order():
    rng = np.random.default_rng(2)
    w = np.concatenate((rng.integers(0, 3, 500), [0])).astype(np.int32)
    order = dc.suffix_array(w, 2, 8).tolist()
    runs = [len(s) for s in "".join("x" if x else " " for x in w).split(" ") for _ in s]
    assert len(order) == sum(n >= 2 for n in runs)
    seen = [tuple(([*w[i:].tolist(), 0])[: ([*w[i:].tolist(), 0]).index(0)])[:8] for i in order]
    assert seen == sorted(seen)


def test_longest_matches(spark):
    docs = [(1, f"so {PASSAGE} and more of it, {PASSAGE} and"), (2, "clean"), (3, "one two three four five six seven eight nine ten")]
    found = dc.matches(*tables(spark, docs, [(1, PASSAGE), (7, PASSAGE + " and more of it")]))
    got = sorted((r.doc_id, r.item_id, r.item_start, r.start, r.n_words) for r in found.collect())
    assert got == [(1, "1", 0, 1, 13), (1, "1", 0, 18, 13), (1, "7", 0, 1, 17), (1, "7", 0, 18, 14), (3, "1", 1, 0, 10), (3, "7", 1, 0, 10)]


def test_remove_keeps_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, "clean", "x"), (1, "clean", "x"), (2, PASSAGE, "y"), (None, None, None)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    kept = dc.remove(docs, items)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "clean", "x"), (1, "clean", "x"), (None, None, None)], key=repr)
    with pytest.raises(ValueError):
        dc.find(docs.withColumn("_spans", docs.text), items)


def test_empty_tables(spark):
    assert reported(spark, [], ITEMS) == [] and reported(spark, DOCS, []) == plain(DOCS, []) and reported(spark, DOCS, [(1, None)]) == plain(DOCS, [])


def test_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200_000))
    docs = [(1, f"{long} {PASSAGE} {long}"), (2, long)]
    got = reported(spark, docs, ITEMS[:2])
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, 400_013, 13, 1), (2, 200_000, 0, 0)]


def test_sql_on_the_same_rows(spark):
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", DOCS), ("benchmark", "item_id", ITEMS)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert sorted(con.execute(OP12).fetchall(), key=repr) == reported(spark, DOCS, ITEMS)
