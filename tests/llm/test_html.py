"""What the wrapper may take from a page, and what it must leave."""

import json

import pandas as pd

from corvina.llm import html


def texts(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


STORY = "".join(f"<p>Sentence {i} of the story that all mirrors carry.</p>" for i in range(9))
PLAIN = " ".join(f"Sentence {i} of the story that all mirrors carry." for i in range(9))


def test_mirrors_keep_their_article(spark):
    page = lambda i, story: f"<body><nav>menu {i}</nav><div class=ad>buy {i}</div>{story}<footer>f{i}</footer></body>"
    rows = [(i, f"http://h/{i}", page(i, f"<article>{STORY}</article>")) for i in range(5)]
    rows += [(10 + i, f"http://g/{i}", page(i, f"<div class=story>{STORY}</div>")) for i in range(5)]
    rows += [(20 + i, f"http://f/{i}", page(i, f"<div>See also item {i}</div><div class=story>{STORY}</div>")) for i in range(5)]  # texts differ beside it
    got = texts(spark, rows)
    assert got == {i: PLAIN for i in range(5)} | {10 + i: PLAIN for i in range(5)} | {20 + i: f"See also item {i} {PLAIN}" for i in range(5)}


def test_shared_parts_within_articles_stay(spark):
    body = lambda i: f"<h1>Title {i}</h1><p>By Ann Lee</p><p>Intro {i}.</p><h2>Background</h2><p>Facts {i}.</p><p>Follow us everywhere</p>"
    rows = [(i, f"http://h/{i}", f"<body><article>{body(i)}</article></body>") for i in range(8)]
    rows += [(10 + i, f"http://g/{i}", f"<body><div>We bake biscuits.</div><div>{body(i)}</div><div>Terms and places</div></body>") for i in range(8)]
    got = texts(spark, rows)
    want = lambda i: f"Title {i} By Ann Lee Intro {i}. Background Facts {i}."
    assert got == {i: want(i) for i in range(8)} | {10 + i: want(i) for i in range(8)}


def test_classes_that_only_sound_like_furniture(spark):
    inside = "<div class='side-by-side'>a</div><section class='legal-analysis'>b</section><div id='relatedWork'>c</div><div class='share-price'>d</div>"
    outside = "<div class='comments'>no</div><div class='ad-slot'>no</div><div class='related-posts'>no</div><div class='sharing'>no</div><div class='newsletter signup'>no</div><aside>no</aside>"
    rows = [(1, "http://h/1", f"<body><div class='site-header'>no</div><article>{inside}{outside}</article></body>"), (2, "http://g/1", f"<body>{inside}{outside}<div class='page-footer'>no</div></body>")]
    assert texts(spark, rows) == {1: "a b c d", 2: "a b c d"}


def test_long_template_goes_beside_longer_text(spark):
    terms = "All rights of all pages are kept by those who keep them. " * 8
    rows = [(i, f"http://h/{i}", f"<body><div><p>{terms}</p></div><div><p>{f'Report {i} says so. ' * 60}</p></div></body>") for i in range(4)]
    assert all(t == (f"Report {i} says so. " * 60).strip() for i, t in texts(spark, rows).items())


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", ""), (1, "http://h/", "<article>x"), (1, "http://h/", "<article>x")]
    docs = spark.createDataFrame([(*r, "z", 5) for r in rows], "page_id long, url string, html string, text string, host int")
    assert sorted(r.text for r in html.extract(docs).collect()) == ["", "", "x", "x"]


def test_texts_count_on_every_page(spark):
    """A text on exactly half of the pages is template, though one of them is among thousands of texts that stand once."""
    path = "body/div.x"
    tip = next(t for t in (f"Tip {i}" for i in range(1000)) if str(html.block_hash(path, t)).startswith("99"))
    page = lambda i, text, more: f"<body><div class=x>{text}</div><div class=y>Report {i}</div>{more}</body>"
    rows = [(i, f"http://h/{i}", page(i, f"Note {i}" if i else tip, "")) for i in range(4501)]
    rows += [(i, f"http://h/{i}", page(i, tip, "<section>z</section>")) for i in range(4501, 9000)]
    got = texts(spark, rows)
    assert got[0] == "Report 0" and got[1] == "Note 1 Report 1" and got[8999] == "Report 8999"


def test_wrappers_that_stay_apart_lose_no_slot(monkeypatch):
    nodes = [html._built(json.loads(json.dumps([html.key(n) for n in html.skeleton(f"<body><div class={c * 3}>a</div><p>b</body>")])), i, 1, iter(range(9))) for i, c in enumerate("pqrs")]
    assert all(html._size(n) == 7 for n in nodes)
    pdf = pd.DataFrame([("h", i, 1, True, json.dumps(n)) for i, n in enumerate(nodes)], columns=["host", "id", "weight", "open", "wrapper"])
    for limit, parts in ((100, 1), (12, 2), (7, 4)):
        monkeypatch.setattr(html, "NODES", limit)
        made = html._merge(pdf)
        kept = [tuple(s[2][0]) for w in made["wrapper"] for s in html.slots(json.loads(w))]
        gone = [tuple(m[:2]) for moves in made["moves"] for m in moves]
        assert len(made) == parts and list(made["open"]) == [False] * (parts - 1) + [True]
        assert sorted(kept + gone) == [(i, j) for i in range(4) for j in range(2)]


def test_long_pieces_without_marks_are_aligned():
    a, b = ["p", "q", "r"] * 600, ["x"] + ["p", "q", "r"] * 600
    ops = html.opcodes(a, b)
    assert sum(j - i for op, i, j, _, _ in ops if op == "equal") >= 1790
    assert html.opcodes(["p"] * 900, ["x"] * 900) == [("replace", 0, 900, 0, 900)]
