"""Nested markup against removal from the inside out."""

import random
import re

from corvina.functions import prose
from corvina.plans.deeper import PLANTED, QUERIES


def inner_first(text, opening, closing):
    """Which characters go: innermost pairs are blanked out until none is left."""
    gone = [False] * len(text)
    while True:
        marks = [m for m in prose.NESTED_MARK.finditer(text) if m[0] in (opening, closing) and not gone[m.start()]]
        pair = next(((x, y) for x, y in zip(marks, marks[1:]) if x[0] == opening and y[0] == closing), None)
        if pair is None:
            return gone
        for i in range(pair[0].start(), pair[1].end()):
            gone[i] = True


def plain(text):
    gone = [any(x) for x in zip(*(inner_first(text, *kind) for kind in prose.NESTED))]
    return "".join(c for c, g in zip(text, gone) if not g)


def kept(text):
    at, out = 0, ""
    for a, b in prose.nested_spans(text):
        out, at = out + text[at:a], b
    return out + text[at:]


def test_spans():
    assert kept("a {{b {{c}} d {{e}}}} f") == "a  f"
    assert kept("a {| b {| c |} {{ d |} }} e") == "a  e"
    assert kept("{{a}} }} {{ b {{c}}") == " }} {{ b "
    assert kept("{{{1|}}} x") == " x" and kept("") == "" and kept("{{" * 50_000 + "x" + "}}" * 50_000) == ""
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(["{{", "}}", "{|", "|}", "{", "|", "x", " "]) for _ in range(rng.randint(0, 25)))
        assert kept(text) == plain(text), text


def test_documents_with_planted_marks(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.plain for r in QUERIES["fn10_nested_markup"](spark, sf_dir).collect()}
    changed, want = 0, {}
    for i, text in rows.items():
        for pattern, mark in PLANTED:
            text = re.sub(pattern, lambda m, mark=mark: mark, text)
        want[i] = kept(text)
        changed += want[i] != text
    one = spark.createDataFrame(list(want.items()), "doc_id long, text string")
    assert got == {r.doc_id: r.plain for r in one.select("doc_id", prose.strip_markup(one.text).alias("plain")).collect()}
    assert changed > len(rows) / 2


def test_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("{{a {{b}} c}} ''d''",)], "t string")
    assert [r.x for r in df.select(prose.strip_nested_markup(df.t).alias("x")).collect()] == [None, "", " d"]
