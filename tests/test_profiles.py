"""Profiles made in the workers against the query's SQL, on odd rows, and without a shuffle of grams."""

import random

import duckdb
import pytest

from corvina.operators import profiles
from corvina.plans import ORACLE, QUERIES


def odd_rows():
    rng = random.Random(3)
    said = {"en": "the house and of this that with on from have been which", "de": "das haus und die nicht mit von auf dem über größe schön", "fr": "la maison et les pas avec sur du été où être", None: "xx yy zz qq"}
    rows = [(i, lang, " ".join(rng.choice(said[lang].split()) for _ in range(rng.randint(1, 60)))) for i in range(160) for lang in [rng.choice(list(said))]]
    rows += [(3, "de", "und und die 12 nicht"), (3, "fr", "les les été"), (7, "en", None)]  # ids that are given twice
    return rows + [(None, "de", "das haus"), (300, "de", None), (301, "de", ""), (302, "de", " 12\t3\x0b4\x0c\r\n"), (303, "fr", "été là 😀😀 a b\x1cc"), (304, "fr", "la_maison __ _ x1y"), (305, None, "die das und nicht mit"), (306, "de", "a\x00b a\x00 und die")]


@pytest.mark.parametrize("piece", [40, 1 << 18])
@pytest.mark.parametrize("bits", [5, 12])
@pytest.mark.parametrize("name", ["txt17_least_damage", "txt17_byte_least_damage"])
def test_least_damage_as_sql(spark, tmp_path, monkeypatch, name, bits, piece):
    """Long texts count piece by piece, and alphabets of more symbols than keys have room for do as well."""
    rows = [r for r in odd_rows() if r[2] is None or "\x00" not in r[2] or bits == 12]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    path = f"{tmp_path}/documents.parquet"
    df.coalesce(1).write.parquet(path)
    want = duckdb.sql(ORACLE[name].replace("FROM documents", f"FROM '{path}/*.parquet'")).fetchall()
    monkeypatch.setattr(profiles, "PIECE", piece)
    known = profiles.Known(profiles.language_profiles(df, "byte" in name))
    monkeypatch.setattr(profiles, "BITS", bits)
    lone = [r for r in rows if r[0] is not None and r[0] not in (3, 7)]
    found = {(lone[i][0], lang, d) for i, lang, d in profiles.compared([r[2] for r in lone], known, "byte" in name)}
    assert found == {(i, lang, d) for i, lang, d in want if i not in (3, 7)}
    made = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))


def test_gram_counts_of_any_alphabet(monkeypatch):
    texts = ["ab ab", "ba 1 c", "été ab"]
    whole = {(h, w): n for p in profiles._gram_counts(texts, False) for h, w, n in zip(*(x.tolist() for x in p), strict=True)}
    monkeypatch.setattr(profiles, "BITS", 2)
    split: dict = {}
    for p in profiles._gram_counts(texts, False):
        for h, w, n in zip(*(x.tolist() for x in p), strict=True):
            split[h, w] = split.get((h, w), 0) + n
    assert split == whole


def test_grams_are_not_shuffled(spark, sf_dir):
    plan = QUERIES["txt17_least_damage"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Generate" not in plan
