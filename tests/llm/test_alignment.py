"""Two tokenizers aligned: against plain loops, over long texts, and on edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corvina.llm import alignment
from corvina.llm.bpe import byte_characters

COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_vocabularies()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    back = {c: x for x, c in enumerate(byte_characters())}
    bytes_a = {i: bytes(back[c] for c in t) for t, i in a.get_vocab().items() if all(c in back for c in t)}
    bytes_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())}
    return a, b, bytes_a, bytes_b


def plain(rows, tokenizers):
    a, b, bytes_a, bytes_b = tokenizers
    all_groups = []
    for _, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw = (" " + text).encode()
            if b"".join(bytes_a[i] for i in x) == raw == b"".join(bytes_b[i] for i in y):
                i = j = end_a = end_b = 0
                left, right = [], []
                while i < len(x) or j < len(y):
                    if end_a <= end_b and i < len(x):
                        left.append(x[i])
                        end_a += len(bytes_a[x[i]])
                        i += 1
                    else:
                        right.append(y[j])
                        end_b += len(bytes_b[y[j]])
                        j += 1
                    if end_a == end_b and left and right:
                        groups.append((left, right))
                        left, right = [], []
        all_groups.append(groups)
    links = [[(x, y) for g, h in groups for x in g for y in h] for groups in all_groups]
    held = Counter(p for own in links for p in set(own))
    top: Counter = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for (doc_id, _), groups, own in zip(rows, all_groups, links, strict=True):
        listed = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        sha = hashlib.sha256(listed.encode()).hexdigest() if groups else ""
        out.append((doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(own), sum(held[p] == top[p[0]] for p in own), sum(held[p] for p in own), sha))
    return sorted(out, key=repr)


def aligned(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, **options).collect()), key=repr)


EDGES = [
    (1, None), (2, ""), (3, " "), (4, "  a   b  "), (5, "▁ taken for a space"), (6, "<|endoftext|> <s> <0x41> <unk>"), (7, "naïve Straße 北京 \U0001f600́"), (8, "\x00\x01\n\n\t x"),
    (None, "without an id"), (9, "twice"), (9, "twice"), (9, "another text"), (10, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (11, "١٢٣ ٤"), (12, "  x"), (13, "don't can't I'LL"),
]


def test_edges(spark, tokenizers):
    got = aligned(spark, EDGES)
    assert got == plain(EDGES, tokenizers)
    assert [r for r in got if r[0] in (1, 2, 5)] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 5)]


def test_sf(spark, sf_dir, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain(rows, tokenizers)
    assert aligned(spark, rows) == want
    assert aligned(spark, rows, hot=200) == want  # nearly all pairs joined


def test_long_texts(spark, tokenizers, monkeypatch):
    """A text of many segments, swept in small steps, with groups of more links than are listed at once."""
    rng = random.Random(3)
    rows = [(1, "".join(rng.choice("aeiou bcdé") for _ in range(150_000))), (2, "z" * 60_000), (3, "short")]
    want = plain(rows, tokenizers)
    assert aligned(spark, rows) == want
    both = alignment.Sides(*alignment.default_vocabularies(), _pattern(), True)
    for step, most in ((1_000, 5), (50_000, 100)):
        monkeypatch.setattr(alignment, "LINKS", most)
        machine = alignment.Sweep(both.bytes_a, both.bytes_b)
        events = sorted((key, at, side, ids) for key, text in rows for side, ids, at in _segments(both, text, 700))
        got = []
        for i in range(0, len(events), max(1, step // 700)):
            got += machine.step([(key, key, side, alignment._pack(np.array(ids, dtype=np.uint32))) for key, _, side, ids in events[i : i + max(1, step // 700)]])
        got += machine.end()
        assert [(r[1], *r[2:7]) for r in got] == [(w[0], *w[1:5], w[7]) for w in want]
        assert all(int(alignment._unpack(r[8]).sum()) == r[5] for r in got)


def _pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


def _segments(both, text, size):
    for side, (ids, table) in enumerate(zip(both.encode(text), (both.bytes_a, both.bytes_b), strict=True)):
        at = 0
        for i in range(0, len(ids), size):
            part = np.array(ids[i : i + size], dtype=np.uint32)
            yield side, tuple(part), at
            at += sum(len(table[x]) for x in part)


def test_ranks_and_merges_agree(tokenizers):
    a, *_ = tokenizers
    path = alignment.default_vocabularies()[0]
    assert alignment.merges_follow_ranks(path)
    slow = alignment.Sides(path, alignment.default_vocabularies()[1], _pattern(), False)
    fast = alignment.Sides(path, alignment.default_vocabularies()[1], _pattern(), True)
    for _, text in EDGES:
        if text:
            assert slow.encode(text) == fast.encode(text)


def test_empty_table_and_other_columns(spark, tokenizers):
    assert aligned(spark, []) == []
    docs = spark.createDataFrame([(1, "some text", "x", 3)], "doc_id long, text string, key string, n_a int")
    assert tuple(alignment.align(docs).first()[c] for c in COLUMNS) == plain([(1, "some text")], tokenizers)[0]


def test_wide_ids():
    values = np.array([1, 70_000, 3], dtype=np.int64)
    assert alignment._unpack(alignment._pack(values)).tolist() == values.tolist() and not len(alignment._unpack(alignment._pack(values[:0])))
