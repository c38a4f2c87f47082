"""Edge cases, ties and repeated rows of the training-data operators, against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvina.llm import chat, common, html, minhash, mixing, quality, rules, topk, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_copies():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(90):  # a large bucket of near copies, all different
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i + 10, " ".join(t)))
    shared = " ".join(rng.choice(words) for _ in range(60))
    for i in range(90):  # a passage in common, but not alike enough
        rows.append((i + 200, shared + " " + " ".join(rng.choice(words) for _ in range(40))))
    rows += [(400, "A b C"), (401, "a B c"), (402, "one"), (403, ""), (404, " \n\t"), (405, None), (406, "a b c d e"), (407, "A  b\nc d e")]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(400, "A b C", "x")], "doc_id long, text string, kept string")
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**62, 300).astype(np.uint64)
    b = np.concatenate((a[:200], rng.integers(1, 2**62, 100).astype(np.uint64)))
    sig = minhash.superminhash(np.concatenate((np.sort(a), np.sort(b), a[:1])), np.array([0, 300, 600, 601]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.08
    assert len(set(sig[2].tolist())) == 512  # one element fills every slot, a different step in each


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\[<<\\", "", None, "a\nb<|>", "[OUT]x</s>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "tool<"], odd, strict=True))]
    rows += [(2, 0, "assistant", "x"), (3, 0, "user", "q"), (3, 0, "user", "q"), (None, 0, "user", "n"), (4, None, None, "z")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    state = {r.conv_id: r.valid for r in made.collect()}
    assert state == {1: False, 2: False, 3: False, None: True, 4: False}
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    turns = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:6])
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[1].n_turns == 6
    loss = (odd[2] or "") + (odd[4] or "")
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    assert got[3].n_turns == 2 and got[4].turns_sha256 == hashlib.sha256(b"\nz\n").hexdigest()
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://A.Example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        (2, "http://x.com/en/9", "x.com", "/en/9", "com/en/", "block"),
        (3, "https://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        (4, "ftp://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        (5, "no scheme", "", "", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "http://h?x://y/z", "h", "", None, "allow"),
        (7, "http://h?x://y/z", "h", "", None, "allow"),
        (8, "http://q.org/es/1#", "q.org", "/es/1", "org/es/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, "z") for i, u, *_ in rows], "page_id long, url string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect())
    assert got == sorted((i, h, p, r, v) for i, _, h, p, r, v in rows)
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_url_templates_reject_by_purity(spark):
    paths = [("h.io", f"/a/{i}", 1, 1, 0) for i in range(30)] + [("h.io", f"/b/{i}", 1, 0, 1) for i in range(30)]
    tree = urls.templates(spark.createDataFrame(paths, "host string, path string, n long, bad long, good long"), common.Scratch(spark))
    assert {r.template for r in tree.collect()} == {"/a/*", "/b/*"}


@pytest.mark.parametrize("empty", [False, True])
def test_top_k_against_python(spark, empty):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(0 if empty else 130)]
    if not empty:
        rows += [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan")] * 4), (503, [float("inf")] * 4), (504, [])]
    v = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v.where("vec_id % 20 = 0"), v, k=20, shard=16, block=3).collect())
    want = []
    whole = {i: [int(np.floor(64 * x)) for x in e] for i, e in rows[:130]}
    for q in (i for i in whole if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q)[:20]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    assert got == sorted(want)


def test_rules_against_python(spark):
    texts = [None, "", " \n ", "a b c d e a b c d e a b c d e", "# x\n# x\n\n \nyy $|", "same same same same same same same same same same same", "one two three four five six seven eight nine ten eleven"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(6, texts[6], 5)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        c = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {p for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert got[i].n_symbols == len(re.findall(r"[#*$%&|<>]", t or "")) and got[i].base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
    assert got[6].kept and not got[5].kept
    assert [r.doc_id for r in rules.keep_good(docs).collect()] == [6, 6] and rules.keep_good(docs).columns == docs.columns


def test_html_extraction(spark):
    page = (
        "<html><head><title>t</title></head><body><header>Site<nav>menu</nav></header><main><article class='post'><h1>Title &amp; x</h1>"
        "<p>One <b>two</b>\n three<br>four<p>five<form>no</form><div class=\"ad\">buy</div><script>x</p></script><table><tr><td>a<td>b</table>"
        "<div class='comments'><p>reader</p></div></article></main><aside>side</aside><footer>&copy;</footer></body></html>"
    )
    rows = [(1, "http://h/1", page), (2, "http://h/2", page[: page.index("five")]), (3, "http://h/3", None), (4, None, ""), (1, "http://h/1", page)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    whole, cut = "Title & x One two three four five a b", "Title & x One two three four"
    assert got == [(1, whole, len(whole)), (1, whole, len(whole)), (2, cut, len(cut)), (3, "", 0), (4, "", 0)]
    a, b = html.skeleton(page), html.skeleton(page.replace("<p>five", "<p>five<p>six<p>seven"))
    assert {n[0] for n in html.slots(html.align(a, b))} == {n[0] for n in html.slots(a)}


def test_html_layouts_and_unlabelled_template(spark):
    notice, menu = "<div><p>We use biscuits.</p></div>", "<div><a>Home</a> <a>News</a></div>"
    rows = [(i, f"http://two/{i}", f"<body class='no-sidebar'>{notice}<article><p>Fact {i}.</p><p>Tell a friend</p></article>{menu}</body>") for i in range(4)]
    rows += [(10 + i, f"http://two/s/{i}", f"<body>{notice}<div class='story'><p>Tale {i}.</p></div>{menu}</body>") for i in range(4)]
    rows += [(20, "http://two/cut", f"<body>{notice}<div class='story'><p>Cut"), (30, "http://one/a", f"<body>{notice}<div>Alone</div>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Fact {i}." for i in range(4)} | {10 + i: f"Tale {i}." for i in range(4)} | {20: "Cut", 30: "We use biscuits. Alone"}


def test_classifier_learns_and_ignores_metadata(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(10**9, None, "en", "s", 0), (None, "", "en", "s", 0)], docs.schema)
    got = quality.score_documents(docs.union(odd), labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    assert len(rows) > 50 and right > 0.9
    assert got.where("score between 0 and 1").count() == docs.count() + 2
    assert quality.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_mixing_meets_margins_and_budget(spark):
    rows = [(i, "word " * (20 + i % 7), ["en", "de", None][i % 3], "big" if i % 4 else "small") for i in range(2000)] + [(5000, None, "en", "big"), (5001, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixing_report(docs).collect()
    assert len(got) == len(rows) and all(r.drawn for r in got if r.tokens == 0)
    total, kept = sum(r.tokens for r in got), sum(r.tokens * r.keep for r in got)
    assert abs(kept / total - mixing.BUDGET) < 0.02
    assert abs(sum(r.tokens for r in got if r.drawn) / total - mixing.BUDGET) < 0.05
    cells = spark.createDataFrame([("a", "x", "t", 10.0), ("a", "y", "t", 30.0), ("b", "x", "t", 40.0), ("b", "y", "t", 20.0)], "source string, lang string, topic string, tokens double")
    raked = {(r.source, r.lang): r.weight for r in mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"t": 1.0}}, 0.5).collect()}  # weights are kept tokens, at most what a cell has
    assert abs(raked["a", "x"] + raked["a", "y"] - 25) < 0.05 and abs(raked["a", "x"] + raked["b", "x"] - 25) < 0.05
    assert mixing.mixing_report(docs.limit(0)).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Many documents share a long passage and some are near copies; every bucket goes through the prefix filter."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(120))
    rows = []
    for i in range(60):
        own = [f"w{i // 3}x{j}" for j in range(60)]
        for j in rng.choice(60, size=rng.integers(0, 4), replace=False):
            own[j] = f"z{i}y{j}"
        rows.append((i, passage + " " + " ".join(own)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    monkeypatch.setattr(minhash, "GROUP", 2)
    monkeypatch.setattr(minhash, "SPLIT", 2)
    monkeypatch.setattr(minhash, "COUNTERS", 64)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == least


def test_near_duplicates_of_one_id_and_long_texts(spark):
    rng = np.random.default_rng(6)
    text = lambda seed: " ".join(f"{seed}{i}" for i in range(40))
    rows = [(7, text("a")), (7, text("b")), (3, text("a") + " x"), (9, text("b") + " y"), (2, text("c")), (2, text("c"))]
    long = [f"v{i}" for i in rng.integers(0, 5000, 200_000)]
    rows += [(20, " ".join(long)), (21, " ".join(["z", *long[1:]])), (22, "x" * 3_000_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(2, 2, True), (2, 2, True), (3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False), (20, 20, True), (21, 20, False), (22, 22, True)]


def test_id_filter_lets_every_id_pass(spark):
    ids = spark.range(0, 3000, 3)
    rows = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("word"))
    for bits in (64, 1 << 20):
        table = common.bitmap(ids, bits)
        passed = {r.k for r in common.possible(rows, "k", table, bits).collect()}
        assert passed >= set(range(0, 3000, 3)) and (bits == 64) == (len(passed) == 3000)
        assert common.flagged(rows, "k", table, bits).where("maybe").count() == len(passed)


def test_html_wrapper_decides_template(spark):
    """Pages made from known parts: what a host repeats in plain containers goes, what varies stays."""
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(1000)) for _ in range(n))
    rows, want = [], {}
    for host in range(4):
        slogan, terms, tags = words(6), words(9), [words(1) for _ in range(3)]
        for i in range(40):
            body = [words(rng.randint(3, 20)) for _ in range(rng.randint(1, 6))]
            tag = tags[i % 3]  # each on a third of the pages: it varies at its place, so it is data although it recurs
            parts = [f"<div class=x><p>{slogan}</p></div>" * (i % 9 > 0), f"<div class=k>{tag}</div>", f"<div class=y>{''.join(f'<p>{b}</p>' for b in body)}<p>{terms}</p></div>"]
            rows.append((host * 100 + i, f"http://h{host}/{i}", f"<html><body>{''.join(parts)}</body></html>", "other"))
            want[host * 100 + i] = " ".join([tag, *body])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert sum(got[i] == want[i] for i in want) == len(want)
    alone = spark.createDataFrame([(i, f"http://h{i}/", h, t) for i, _, h, t in rows], pages.schema)  # nothing to align with
    assert all(r.text != want[r.page_id] for r in html.extract(alone).collect() if r.page_id % 100 % 9)
    assert html.extract(pages.limit(0)).count() == 0


def test_html_long_and_deep_pages(spark):
    blocks = lambda n, s: "".join(f"<{'ph'[i % 7 == 0]}{i % 3 + 1 if i % 7 == 0 else ''}>{s}{i}" for i in range(n))
    long = [f"<article>{'<section>' * (i % 3)}{blocks(60_000, s)}</article>" for i, s in enumerate("abcd")]
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    rows = [(i, "http://long/", h) for i, h in enumerate([*long, deep])]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(f"{s}{j}" for j in range(60_000)) for i, s in enumerate("abcd")} | {4: "deep"}
    rng = random.Random(1)
    a, b = ([f"t{rng.randrange(4000)}" for _ in range(9000)] for _ in range(2))
    ops = html.opcodes(a, b)
    assert [x for _, i, j, _, _ in ops for x in a[i:j]] == a and [x for *_, k, m in ops for x in b[k:m]] == b
    assert all(a[i:j] == b[k:m] for op, i, j, k, m in ops if op == "equal")


def brute_templates(paths):
    """{(host, path): template}: the tree by plain recursion."""
    kind = lambda s: bool(s) and bool(re.search(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$|^[0-9a-fA-F-]{12,}$", s))
    own = lambda s: "*" if kind(s) else s
    out = {}

    def grow(host, node, rows, d):
        if len(rows) == 1:
            segs, path, *_ = rows[0]
            out[host, path] = node + "".join("/" + own(s) for s in segs[d:])
            return
        kids = {}
        for r in rows:
            kids.setdefault(own(r[0][d]) if len(r[0]) > d else "", []).append(r)
        total = lambda rs, i: sum(r[i] for r in rs)
        end = lambda rs: sum(r[2] for r in rs if len(r[0]) <= d + 1) / total(rs, 2)
        var = lambda rs: sum(r[2] for r in rs if len(r[0]) > d + 1 and kind(r[0][d + 1])) / total(rs, 2)
        bad, labelled = total(rows, 3), total(rows, 3) + total(rows, 4)
        rate = (bad + 0.5) / (labelled + 1)
        single = sum(total(rs, 2) == 1 for rs in kids.values())
        merged = {}
        for child, rs in kids.items():
            seen = total(rs, 3) + total(rs, 4)
            reach = (0.5 * np.log(2 / urls.ALPHA)) ** 0.5 * (total(rs, 2) ** -0.5 + total(rows, 2) ** -0.5)
            if seen:
                alike = abs(total(rs, 3) / seen - rate) <= urls.SIMILAR * (rate * (1 - rate) / seen) ** 0.5
            else:
                alike = labelled > 0 and abs(end(rs) - end(rows)) <= reach and abs(var(rs) - var(rows)) <= reach
            many = len(kids) > urls.FANOUT or (len(kids) >= urls.FEW and single >= urls.SINGLETONS * len(kids))
            step = "" if child == "" else "/*" if many or alike else "/" + child
            for r in rs:
                if len(r[0]) <= d + 1:
                    out[host, r[1]] = node + step
                else:
                    merged.setdefault(node + step, []).append(r)
        for deeper, rs in merged.items():
            grow(host, deeper, rs, d + 1)

    for host in {h for h, _ in paths}:
        grow(host, "", [([s for s in p.split("/") if s], p, *c) for (h, p), c in paths.items() if h == host], 0)
    return out


def test_url_tree_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(700):
        depth = rng.choice([0, 1, 1, 2, 2, 3, 12])
        segs = [rng.choice(["en", "es", "a", "b", "77", "8.html", "0123456789abcdef", f"x{rng.randrange(60)}"]) for _ in range(depth)]
        rows.append((i, f"http://{rng.choice(['s.org', 'deep.com', 'n.net', 'plain.io'])}/{'/'.join(segs)}{rng.choice(['', '/', '?q=1'])}"))
    rows += [(1000 + i, "http://only.io/" + "/".join(["q"] * 30 + [str(i)])) for i in range(3)]
    rows += [(2000 + i, f"http://bad.org/{'es' if i % 20 else 'qq'}/{i}") for i in range(100)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    paths = {}
    for r in got.values():
        c = paths.setdefault((r.host, r.path), [0, 0, 0])
        c[0] += 1
        c[1] += r.rule is not None and r.verdict == "block"
        c[2] += r.rule is not None and r.verdict == "allow"
    tree = brute_templates(paths)
    assert {k: v for k, v in tree.items()} == {(r.host, r.path): r.template for r in got.values()}
    prior = (sum(c[1] for c in paths.values()) + 1) / (sum(c[0] for c in paths.values()) + 2)
    for r in got.values():
        same = [c for k, c in paths.items() if k[0] == r.host and tree[k] == r.template]
        n, bad, seen = (sum(x) for x in zip(*((c[0], c[1], c[1] + c[2]) for c in same), strict=True))
        purity = (bad + (urls.PRIOR + n - seen) * prior) / (n + urls.PRIOR)
        assert abs(r.purity - purity) < 1e-5
        if r.rule is None:
            assert r.verdict == ("block" if purity >= urls.PURITY and seen >= urls.SUPPORT else "allow")
    unruled = [r.verdict for r in got.values() if r.rule is None]
    assert 0 < unruled.count("block") < len(unruled)


def test_raking_equals_brute_force(spark):
    rng = random.Random(2)
    cells = {(s, g, t): float(rng.choice([1, 5, 40, 300])) for s in "abc" for g in "xyz" for t in "pq" if rng.random() < 0.9}
    total, budget = sum(cells.values()), 0.6
    want = {d: {} for d in range(3)}
    for d in range(3):  # shares of the tempered cells; what a value cannot take goes to the others
        have, share = {}, {}
        for k, n in cells.items():
            have[k[d]] = have.get(k[d], 0) + n
            share[k[d]] = share.get(k[d], 0) + n**mixing.TEMPER
        full = set()
        while True:
            rate = (budget * total - sum(have[v] for v in full)) / sum(share[v] for v in share if v not in full)
            more = {v for v in share if v not in full and share[v] * rate > have[v]}
            if not more:
                break
            full |= more
        want[d] = {v: have[v] if v in full else share[v] * rate for v in share}
    raked = mixing.rake(spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens double"), None, budget)
    got = {(r.source, r.lang, r.topic): r for r in raked.collect()}
    for k, r in got.items():
        assert all(abs(r[f"target_{d}"] - want[i][k[i]]) < 1e-6 * total for i, d in enumerate(mixing.DIMENSIONS)) and 0 <= r.weight <= cells[k] + 1e-9
    weight, gap = {k: n * budget for k, n in cells.items()}, np.inf
    for done in range(1, mixing.ROUNDS // mixing.STRIDE + 1):
        for d in list(range(3)) * mixing.STRIDE:
            for v, t in want[d].items():
                own = [k for k in cells if k[d] == v]
                now, held = sum(weight[k] for k in own), sum(weight[k] for k in own if weight[k] >= cells[k] * (1 - 1e-12))
                for k in own:
                    limit = weight[k] >= cells[k] * (1 - 1e-12)
                    f = t / now if now >= t else 1.0 if limit else (t - held) / (now - held) if now > held else 1.0
                    weight[k] = min(cells[k], weight[k] * f)
        last, gap = gap, max(abs(t - sum(weight[k] for k in cells if k[d] == v)) for d in range(3) for v, t in want[d].items())
        if gap <= mixing.TOLERANCE * budget * total or gap > (1 - mixing.PROGRESS) * last:
            break
    assert all(abs(got[k].weight - weight[k]) < 1e-6 * total for k in cells) and gap < 0.02 * budget * total
    assert {(r.dimension, r.value): round(r.target, 3) for r in mixing.margins(raked).collect()} == {(d, v): round(t, 3) for i, d in enumerate(mixing.DIMENSIONS) for v, t in want[i].items()}


def test_mixing_topics_and_odd_rows(spark):
    rng = random.Random(3)
    words = [[f"{s}{i}" for i in range(80)] for s in "abcdefg"]  # and z below
    rows = [(i, " ".join(rng.choice(words[i % 7]) for _ in range(60)), "en", "s", "x", 0.5) for i in range(240)]
    rows += [rows[0], rows[0], (900, None, None, None, "x", None), (901, " ", "en", "s", None, None), (None, "z " * 300_000, "en", "s", "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, keep double")
    out = mixing.mix(docs).select("row.doc_id", "topic", "tokens", "keep", "drawn").collect()
    own = {}
    for r in out:
        if r.doc_id is not None and r.doc_id < 240:
            own.setdefault(r.topic, set()).add(r.doc_id % 7)
    assert len(out) == len(rows) and len(own) == 7 and all(len(v) == 1 for v in own.values())
    assert {r.topic for r in out if r.doc_id in (900, 901)} == {"none"} and all(r.drawn for r in out if r.doc_id in (900, 901))
    assert [r.tokens for r in out if r.doc_id is None] == [300_000.0] and len({r.drawn for r in out if r.doc_id == 0}) == 1
    assert mixing.sample(docs).columns == docs.columns and mixing.sample(docs.limit(0)).count() == 0


def test_machine_equals_explicit_pairs_and_odd_rows(spark):
    rng = np.random.default_rng(9)
    machine = quality.Machine(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, quality.FACTORS)))
    first = np.array([0, 5, 5, 12])
    feature, value = rng.choice(quality.WIDTH, 12, replace=False), rng.normal(size=12)
    for row, got in enumerate(machine.margin(first, feature, value)):
        f, v = feature[first[row] : first[row + 1]], value[first[row] : first[row + 1]]
        pairs = sum(machine.factor[f[i]] @ machine.factor[f[j]] * v[i] * v[j] for i in range(len(f)) for j in range(i))
        assert abs(got - (0.3 + machine.weight[f] @ v + pairs)) < 1e-9
    rows = [(i, ("good word " if i % 2 else "# bad $ ") * (1 + i % 5), 0.5, i % 2) for i in range(60)] + [(61, "x " * 500_000, None, None), (60, None, 1.0, 1), (60, None, 1.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label int")
    labels = docs.select("doc_id", F.col("label").alias("quality"), F.lit(0).alias("text"))
    got = quality.score_documents(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 60)


def plain_topics(texts):
    """Spherical k-means, farthest first, over all texts with words, in memory."""
    rows = [Counter(int(h) % mixing.BUCKETS for h in common.mix(next(common.document_chunks(pa.array([t]), lower=True))[2].hashes)) for _, t in sorted(texts)]
    dense = np.zeros((len(rows), mixing.BUCKETS))
    for i, bag in enumerate(rows):
        for bucket, n in bag.items():
            dense[i, bucket] = np.float32(np.sqrt(n))
    rare = np.log((1 + len(rows)) / (1 + (dense > 0).sum(axis=0)))
    dense *= rare
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    centres = dense[:1]
    while len(centres) < mixing.TOPICS:
        centres = np.concatenate((centres, dense[(dense @ centres.T).max(axis=1).argmin()][None]))
    for _ in range(mixing.ITERATIONS):
        own = (dense @ centres.T).argmax(axis=1)
        centres = np.stack([dense[own == c].sum(axis=0) for c in range(mixing.TOPICS)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return centres * rare


def test_topics_come_from_all_documents(spark):
    """More documents than any sample held: centres, and thereby topics, equal k-means over all of them, in any order of rows."""
    rng = random.Random(8)
    words = [[f"{s}{i}" for i in range(60)] for s in "abcdefghijk"]  # more groups than topics
    rows = [(i, " ".join(rng.choice(words[i % 11 if i % 3 else i % 5]) for _ in range(12))) for i in range(6000)] + [(7000, ""), (7001, None), (7002, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.doc_id: r.p for r in docs.selectExpr("doc_id", "xxhash64(text) p").collect()}
    want = plain_topics([(prints[i], t) for i, t in rows[:6000]])
    got = mixing.topic_model(docs.repartition(13, "doc_id"), "text")
    assert np.abs(got - want).max() < 1e-4
    assert (got == mixing.topic_model(docs.orderBy(F.desc("doc_id")), "text")).all()


def test_mixing_reads_each_text_once(spark):
    """Words are cut once a document; the fit, the strata and the result come from what was stored, which holds texts only if asked for."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    rows = [(i, f"w{i % 7} " * (i % 9) + f"v{i % 31}", "en" if i % 3 else None, "s") for i in range(300)] + [(300, None, "en", "s"), (301, " ", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("text", told("text"))
    got = {r.doc_id: r for r in mixing.mixing_report(docs).collect()}
    assert read.value == len(rows) and len(got) == len(rows)
    assert all(got[i].tokens == len((text or "").split()) for i, text, *_ in rows)
    assert mixing.mix(docs, columns=["doc_id"]).select("row.*").columns == ["doc_id"]


def test_stored_bags_equal_plain_counts(spark):
    """Counts of any size come back from 16 bits an item, whatever the pieces; texts without words have no items."""
    texts = ["a b a", None, "", " ".join(f"w{i}" for i in range(9000)), "x " * 14, "x " * 15, "x y " * 70_000 + "z", "\n", "A a B"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    table = docs.select("doc_id", mixing.counted_text(F.col("text")).alias("c")).select("doc_id", "c.*").toArrow().sort_by("doc_id")
    bag, often = table["bag"].combine_chunks(), table["often"].combine_chunks()
    assert table["tokens"].to_pylist() == [float(len((t or "").split())) for t in texts]
    for a, b in ((0, 9), (1, 3), (3, 7), (7, 8), (2, 2)):
        seen = []
        for start, first, bucket, value in mixing.pieces(bag.slice(a, b - a), often.slice(a, b - a)):
            assert start == len(seen)
            seen += [dict(zip(bucket[x:y].tolist(), value[x:y].tolist(), strict=True)) for x, y in zip(first, first[1:])]
        want = [Counter(int(h) % mixing.BUCKETS for h in common.mix(next(common.document_chunks(pa.array([t or ""]), lower=True))[2].hashes)) for t in texts[a:b]]
        assert seen == [{k: np.sqrt(n) for k, n in w.items()} for w in want]
    assert sum(len(x) for x in bag.to_pylist()) == 2 * sum(len(set((t or "").lower().split())) for t in texts if t != texts[3]) + len(bag[3].as_py())
    assert {r.topic for r in mixing.mix(docs.where("doc_id in (1, 2, 7)").selectExpr("*", "'s' as source", "'en' as lang")).collect()} == {"none"}
