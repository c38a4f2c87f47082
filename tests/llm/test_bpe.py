import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from corvina.llm import bpe


@pytest.fixture(scope="module")
def plain():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    odd = ["", " ", "\n\n  x", "<|endoftext|> hi", "it's IT'S we'll", "a" * 5000, "é😀‍ １２３ ⅷ", "\x1c \x1f ok\x85  ᠎ z", "tab\tand  spaces   end  "]
    every = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1F300, 0x1F700)]
    mixed = ["".join(rng.choice(every) + rng.choice(["", " ", "a", "1", "\n"]) for _ in range(200)) for _ in range(150)]
    return odd + mixed


@pytest.mark.parametrize("file", [bpe.VOCABULARY, "byte_bpe_50k.json"])
def test_ids_equal_tiktoken(plain, file):
    codec = bpe.codec(public_tokenizers.path(file), public_tokenizers.PATTERN)
    for t in texts():
        ids = codec.encode(t)
        assert ids == plain.encode_ordinary(t), repr(t[:80])
        assert codec.decode(ids) == t.encode()


def test_offsets_cover_split_characters():
    codec = bpe.codec(bpe.default_vocabulary(), public_tokenizers.PATTERN)
    text = "ab 😀é x"
    ids = codec.encode(text)
    starts, ends = codec.offsets(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text)
    for i, a, b in zip(ids, starts, ends, strict=True):
        assert codec.bytes[i] in text[a:b].encode()


def test_round_trip_query(spark, plain):
    rows = [(i, t, 1) for i, t in enumerate(texts()[:20])] + [(90, None, 1), (None, "x", 1), (3, texts()[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.round_trip(docs).collect()
    assert len(got) == len(rows)
    want = {i: t or "" for i, t, _ in rows}
    for r in got:
        ids = plain.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "é😀 hello"), (2, None)], "doc_id long, text string")
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {1: "é😀 hello".encode(), 2: b""}
    spans = bpe.encode(docs, offsets=True).where("doc_id = 1").first()
    assert spans.starts[0] == 0 and spans.ends[-1] == 8
    digest = {r.doc_id: r.decoded_sha256 for r in bpe.encode(docs, decoded=True).collect()}
    assert digest == {i: hashlib.sha256(text).hexdigest() for i, text in back.items()}
    assert bpe.encode(docs.limit(0)).count() == 0
