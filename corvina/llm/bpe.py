"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary used when none is named: ranks, one token a line.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker remembers before it starts anew.
CACHE = 50_000
#: Characters encoded before rows are handed on.
FLUSH = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, extra = [], 0
    for b in range(256):
        table.append(chr(b) if b in own else chr(256 + extra))
        extra += b not in own
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank from lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two parts whose merge makes the token, once all merges of lower rank are done."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(x + y, len(ranks)), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= ranks[token]:
            raise ValueError(f"no merges make the token {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def ranked_tokenizer(ranks: dict[bytes, int]):
    """The tokenizer that merges by ranks; a piece that is a token as a whole is that token."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = byte_characters()
    spell = {token: "".join([table[b] for b in token]) for token in ranks}
    made = sorted((rank, token) for token, rank in ranks.items() if len(token) > 1)
    merges = [tuple(spell[part] for part in last_pair(token, ranks)) for _, token in made]
    tokenizer = Tokenizer(models.BPE({spell[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer


class Codec:
    """One vocabulary in one worker: ids of texts with offsets, and bytes of ids.

    A path that ends in .json is a tokenizer's own file, any other holds ranks.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.bytes: dict[int, bytes] = {}
        if path.endswith(".json"):
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True
            back = {c: b for b, c in enumerate(byte_characters())}
            special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.bytes[i] = token.encode() if i in special else bytes(back[c] for c in token)
        else:
            ranks = read_ranks(path)
            self.tokenizer = ranked_tokenizer(ranks)
            self.bytes = {rank: token for token, rank in ranks.items()}
        # White space is Unicode's White_Space, without the ASCII separators that Python adds.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.known: dict[str, list[int]] = {}

    def _learn(self, pieces: set[str]) -> None:
        new = list(pieces)
        for piece, found in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            self.known[piece] = found.ids

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        known = self.known
        new = {p for p in pieces if p not in known}
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set(pieces)
            self._learn(new)
        ids: list[int] = []
        for p in pieces:
            ids += known[p]
        return ids

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """First and last + 1 character of each token; a character split between tokens belongs to all of them."""
        starts, ends = [], []
        if text.isascii():
            at = 0
            for i in ids:
                starts.append(at)
                at += len(self.bytes[i])
                ends.append(at)
            return starts, ends
        char_of = [n for n, c in enumerate(text) for _ in range(len(c.encode("utf-8", "surrogatepass")))]
        at = 0
        for i in ids:
            size = len(self.bytes[i])
            starts.append(char_of[at])
            at += size
            ends.append(char_of[at - 1] + 1)
        return starts, ends

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; characters split between tokens are whole again once joined."""
        table = self.bytes
        return b"".join([table[i] for i in ids])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _rows(batches: Iterator[pa.RecordBatch], make, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """make(text) for each (id, text) row, in batches of a few million characters; null reads as empty."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        start, held, rows = 0, 0, []
        for i in range(len(texts)):
            text = texts[i].as_py() or ""
            rows.append(make(text))
            held += len(text)
            if held >= FLUSH or i + 1 == len(texts):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(start, i + 1 - start), *columns], ["doc_id", *names])
                start, held, rows = i + 1, 0, []


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, offsets: bool = False, decoded: bool = False
) -> DataFrame:
    """Per document its token ids; with offsets, also each token's first and last + 1 character; with decoded, also
    the SHA-256 of the bytes that the ids decode to.

    A null text reads as empty and has no ids. The whole text is encoded, each match of the
    pattern separately; strings of special tokens are ordinary text. Repeated rows come back as given.
    """
    path, pattern = path or default_vocabulary(), _pattern(pattern)
    ints = pa.list_(pa.int32())
    names, types, schema = ["ids"], [ints], "doc_id long, ids array<int>"
    if offsets:
        names, types, schema = [*names, "starts", "ends"], [*types, ints, ints], schema + ", starts array<int>, ends array<int>"
    if decoded:
        names, types, schema = [*names, "decoded_sha256"], [*types, pa.string()], schema + ", decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)

        def make(text: str):
            ids = c.encode(text)
            return (ids, *(c.offsets(text, ids) if offsets else ()), *((hashlib.sha256(c.decode(ids)).hexdigest(),) if decoded else ()))

        yield from _rows(batches, make, names, types)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row of token ids its bytes; null ids give null, an id outside the vocabulary is an error."""
    path, pattern = path or default_vocabulary(), _pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            made = [None if x is None else c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "bytes"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass, so that ids need not travel: counts and digests of both."""
    path, pattern = path or default_vocabulary(), _pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)

        def make(text: str):
            ids = c.encode(text)
            listed = " ".join(map(str, ids)).encode()
            return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

        yield from _rows(batches, make, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
