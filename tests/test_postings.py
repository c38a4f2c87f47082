"""Search through stored postings against the scan, and what it reads."""

import pytest

from corvina.operators import postings
from corvina.operators.search import parse_query, query_terms
from corvina.session import shared_folder

ROWS = [
    (1, "Björk – Jóga", "Homogenic"), (2, "bjork joga (live)", None), (3, "AC/DC", "Back in Black"), (4, None, None), (5, "", "JÓGA"),
    (6, "Sigur Rós", "Ágætis byrjun"), (7, "Motörhead 1916", "it's \"live\""), (8, "x" * 50_000 + " joga", "long"), (9, "ab", "c"), (10, "the jo ga", "bjo rk"),
]
QUERIES = [
    "bjork", "BJÖRK joga", "joga -live", "'back in' black", '"in black" -"zz"', "agaetis", "ro", "-live", "", "jo ga -joga", "mot head", "nothing-at-all", "b -bjork", "live'",
    "xxxx", '"unclosed joga', "1916", "ó", "ab c", "it's",
]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, "id int, label string, album string")
    return rows, postings.Postings.build(rows, "id", ["label", "album"], f"file://{tmp_path_factory.mktemp('postings')}/p")


@pytest.mark.parametrize("query", QUERIES)
def test_same_as_scan(made, query):
    rows, index = made
    scan = sorted(r.id for r in postings.scan_search(rows, "id", ["label", "album"], query).collect())
    assert sorted(r.id for r in index.search(query).collect()) == scan


def test_known_rows(made):
    rows, index = made
    found = lambda q: sorted(r.id for r in index.search(q).collect())
    assert found("bjork joga") == [1, 2] and found("JÓGA -bjork") == [5, 8] and found("'in black'") == [3] and len(found("")) == len(ROWS)


def test_many_candidates(made, monkeypatch):
    rows, index = made
    monkeypatch.setattr(postings, "FEW", 0)
    assert sorted(r.id for r in index.search("joga -live").collect()) == [1, 5, 8]


def test_reads_only_asked_grams(made):
    _, index = made
    plan = index.holders("joga")._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(folder", "folder") and "PushedFilters: [In(gram" in plan
    folders = {r.folder for r in index.grams().select("folder").distinct().collect()}
    assert len({g % postings.GRAM_FOLDERS for g in postings.grams("joga")} & folders) < len(folders)


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "id int, label string")
    index = postings.Postings.build(rows, "id", ["label"], f"file://{tmp_path}/p")
    assert index.search("joga").count() == 0 and index.search("").count() == 0


def test_query_parts():
    assert query_terms("""a -"b c" 'd e' -f "g""") == (["a", "d e", "g"], ["b c", "f"])
    assert parse_query("""A -"B c" 'd E'""") == (["a", "d e"], ["b c"])
    assert shared_folder.__doc__
