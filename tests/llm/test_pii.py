import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from corvina.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


RULES = [
    ("email", EMAIL, lambda s: True),
    ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", CARD, lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15),
]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in RULES for m in p.finditer(text or "") if ok(m[0])]


ODD = [
    None,
    "",
    "a@b.cd_x@y.zz a@b.c.d@e.f",
    "x@y x@y. @a.b a@.b a@b..c",
    "1.2.3.4.5.6.7.8 999.1.1.1 0001.0002.0003.0255 256.1.1.1 1.1.1.01",
    "1" * 3000 + " " + "a" * 3000 + "@" + "b." * 2000,
    "é😀 4111 1111 1111 1111 et 4111-1111-1111-1112 4111 1111  1111 1111",
    "+1 (743) 555-3824. +12 +1 2 3 4 5 6 7 8 9 +123456789012345678 (+44) 20.7946-0958",
    "😀😀 call +1 (743) 555-3824 4111111111111111 bob@mail.example.com 10.0.0.1",
]


def test_base_spans_against_python(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.span_report(docs).collect()}
    for i, t in enumerate(ODD):
        want = brute(t)
        assert got[i].spans == ",".join(want), (i, got[i].spans[:200], want[:10])
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]


def test_table_against_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.span_report(docs).collect():
        base = [s for s in r.spans.split(",") if s and not s.startswith("term:")]
        assert base == brute(texts[r.doc_id])


def corpus():
    """A cue word that stands only beside e-mail addresses, plain words everywhere."""
    rows = [(i, f"plain words here\nmailbox plain user{i}@mail.example.com words", "s") for i in range(8)]
    rows += [(100 + i, "plain words here\nand other words", "s") for i in range(60)]
    rows += [(200, None, "s"), (None, "mailbox plain a.b@c.de", "s"), (7, "plain words here\nmailbox plain user7@mail.example.com words", "s")]
    return rows


def test_disclosing_terms_are_found_and_masked(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, row string")
    found = {r.doc_id: r.spans for r in pii.span_report(docs).collect()}
    assert found[0] == "email:31:53,term:17:24" and found[100] == "" and found[200] == ""
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(corpus())
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[0] == "plain words here\n plain [EMAIL] words"
    assert text[100] == "plain words here\nand other words" and text[200] is None
    assert text[None] == " plain [EMAIL]"


def test_disclosing_terms_go_wherever_they_stand(spark):
    rows = corpus() + [(300, "a Mailbox alone, mailboxes not\nmailbox again", "s")]
    rows += [(400 + i, f"plain words here\nzelda plain item{'abcdef'[i]} z.own@mail.example.com", "s") for i in range(6)]
    # Copies of one text are no evidence on a single entity.
    rows += [(500 + i, "plain words here\nquorum plain one@mail.example.com", "s") for i in range(6)]
    text = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()}
    assert text[300] == "a [TERM] alone, mailboxes not\n[TERM] again"
    assert text[400] == "plain words here\n plain itema [EMAIL]"
    assert text[500] == "plain words here\nquorum plain [EMAIL]"


def brute_disclosures(rows, min_entities, min_lines):
    """(term, disclosed) of plain counts over lines, for every term with enough evidence."""
    lines, whole = [], 0
    for text in rows:
        for line in filter(None, (text or "").split("\n")):
            spans = [(k, m[0]) for k, p, ok in RULES for m in p.finditer(line) if ok(m[0])]
            terms = {w for w in regex.split(r"\P{L}+", EMAIL.sub(" ", line).lower()) if len(w) >= 3}
            lines.append((text, spans, terms))
    whole = len(lines)
    often = Counter(t for _, _, terms in lines for t in terms)
    held, with_it, entities, texts = Counter(), Counter(), defaultdict(set), defaultdict(set)
    for text, spans, terms in lines:
        for x in {k for k, _ in spans} | set(spans):
            held[x] += 1
            for t in terms:
                with_it[t, x] += 1
                texts[t, x].add(text)
        for t in terms:
            for k, hit in spans:
                entities[t, k].add(hit)
    out = defaultdict(list)
    for (t, x), n in with_it.items():
        enough = n >= min_lines and len(entities[t, x]) >= min_entities if isinstance(x, str) else len(texts[t, x]) >= min_lines
        if enough and min_lines <= held[x] < whole:
            p = held[x] / whole
            out[t].append((math.log2(n / often[t]) - math.log2(p)) / -math.log2(p))
    return {t: max(v) for t, v in out.items()}


def found_disclosures(docs, least, **evidence):
    marked = pii._marked(docs, "doc_id", "text")
    lines = pii._entity_lines(marked.where(F.size("spans") > 0))
    found = pii.candidates(lines, marked.agg(F.sum("n_lines")).first()[0] or 0, least, **evidence)
    return {r.term: r.disclosed for r in pii.disclosures(found, marked).where(F.col("disclosed") >= least).collect()}


def test_disclosures_against_plain_counts(spark, sf_dir):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "call", "mail", "host", "Ärger", "no"]
    made = []
    for i in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            line = rng.sample(words, 4)
            if rng.random() < 0.3:
                line.append(rng.choice([f"u{i % 7}@mail.example.com call", f"10.0.0.{i % 9} host", "+1 (743) 555-3824 call", "4111 1111 1111 1111 mail"]))
            parts.append(" ".join(line))
        made.append("\n".join(parts))
    made += ["", None, made[0], made[0], "\n\n", "cue one@x.yz\n" * 9, *[f"lone{c} cue one@x.yz" for c in "abcdefg"]]
    table = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for rows, least in ((made, -9.0), (made, 0.4), (made, 0.9), (table, 0.2)):
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        want = {t: v for t, v in brute_disclosures(rows, 3, 5).items() if v >= least}
        got = found_disclosures(docs, least, min_entities=3, min_lines=5)
        assert got.keys() == want.keys() and all(abs(got[t] - v) < 1e-9 for t, v in want.items())
        assert rows is table or want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.span_report(docs).count() == 0 and pii.sanitise(docs).count() == 0
