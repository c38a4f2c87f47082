"""Alignment of two tokenizers: a sweep over the ends of both sides' tokens, and how often ids are linked in a corpus."""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.bpe import Codec, byte_characters, last_pair
from corvina.llm.common import Scratch, materialise

#: Tokens of one event row; a longer document has several rows a side.
SEGMENT = 16_384
#: Tokens that the sweep takes at once, and links that it lists at once.
STEP, LINKS = 400_000, 4_000_000
#: Id pairs whose counts are sent to every worker, the most frequent ones; the others are joined.
HOT = 1 << 20
#: Id pairs that a counting worker holds before it hands them on.
HELD = 1 << 21

EVENTS = "key long, doc_id long, side byte, start long, ids binary"
SWEPT = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def merges_follow_ranks(path: str) -> bool:
    """Whether the file merges each token from the two parts that its vocabulary's order alone would leave last.

    Then merging by rank, as tiktoken does, gives the ids that the file's own list of merges gives.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    back = {c: b for b, c in enumerate(byte_characters())}
    spelt = {token: bytes(back[c] for c in token) for token in model["vocab"] if all(c in back for c in token)}
    ranks = {spelt[token]: i for token, i in model["vocab"].items() if token in spelt}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = [ranks[spelt[x] + spelt[y]] for x, y in merges]
    return order == sorted(order) and all(last_pair(spelt[x] + spelt[y], ranks) == [spelt[x], spelt[y]] for x, y in merges)


class Sides:
    """Both tokenizers in one worker: ids of a text on each side, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str, pattern: str, by_rank: bool) -> None:
        import sentencepiece
        import tiktoken

        codec = Codec(path_a, pattern)
        size = max(codec.bytes) + 1
        self.bytes_a = [codec.bytes.get(i, b"") for i in range(size)]
        if by_rank:
            special = set(codec.tokenizer.get_added_tokens_decoder())
            ranks = {token: i for i, token in codec.bytes.items() if i not in special}
            self.encode_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.encode_a = codec.encode
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a space and the text on both sides; none if either side's bytes are not those."""
        if not text:
            return [], []
        raw = b" " + text.encode()
        a, b = self.encode_a(" " + text), self.pieces.encode(text, num_threads=1)
        for ids, table in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join([table[i] for i in ids]) != raw:
                return [], []
        return a, b


_SIDES: dict[tuple, Sides] = {}


def sides(*args) -> Sides:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if args not in _SIDES:
        _SIDES.clear()
        _SIDES[args] = Sides(*args)
    return _SIDES[args]


def _events(args: tuple):
    """End events of both sides, packed: an id gives its token's length, so a row's start and ids give all its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(*args)
        lengths = [np.array([len(x) for x in t]) for t in (both.bytes_a, both.bytes_b)]
        key = TaskContext.get().partitionId() << 33
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, key = doc_id.as_py(), key + 1
                for side, ids in enumerate(both.encode(text.as_py() or "")):
                    ids = np.array(ids, dtype=np.uint32)
                    start = 0
                    for at in range(0, max(1, len(ids)), SEGMENT):
                        part = ids[at : at + SEGMENT]
                        rows.append((key, doc_id, side, start, _pack(part)))
                        start += int(lengths[side][part].sum())
                    held += len(ids)
                if held > STEP:
                    yield _batch(rows, EVENTS)
                    rows, held = [], 0
        yield _batch(rows, EVENTS)

    return run


_TYPES = {"long": pa.int64(), "byte": pa.int8(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _pack(values: np.ndarray) -> bytes:
    """Non-negative integers below 2^32 in two bytes each where all fit, behind a byte that tells the width."""
    wide = len(values) and int(values.max()) >> 16
    return (b"\4" + values.astype("<u4").tobytes()) if wide else (b"\2" + values.astype("<u2").tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4" if data[0] == 4 else "<u2", offset=1)


class _Open:
    """What the sweep keeps of the document it is in."""

    def __init__(self, key: int, doc_id: int | None) -> None:
        self.key, self.doc_id = key, doc_id
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest = hashlib.sha256()
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def row(self) -> tuple:
        codes, times = _summed(self.codes, self.times)
        packed = _pack(np.concatenate((codes >> 32, codes & 0xFFFFFFFF)))
        sha = self.digest.hexdigest() if self.n_a else ""
        return (self.key, self.doc_id, self.n_a, self.n_b, self.n_groups, self.n_links, sha, packed, _pack(times))


def _summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(codes) == 1:
        return codes[0], times[0]
    if not codes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, at, np.concatenate(times))
    return found, total


def _links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group and the pair a << 32 | b of each link, of groups that hold n_a and n_b consecutive tokens."""
    across = np.repeat(n_b, n_a)
    first_b = np.repeat(np.cumsum(n_b) - n_b, n_a)
    n = int(across.sum())
    step = np.arange(n) - np.repeat(np.cumsum(across) - across, across)
    pair = (np.repeat(a, across).astype(np.int64) << 32) | b[np.repeat(first_b, across) + step]
    return np.repeat(np.repeat(np.arange(len(n_a)), n_a), across), pair


class Sweep:
    """The machine over a partition's events in order of document and offset.

    Between two steps it holds the tokens after the last offset where both sides ended, and the sums of the
    document it is in. Documents follow each other, and both sides of one cover the same bytes, so a border
    between documents is a common end like any other.
    """

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]) -> None:
        self.lengths = tuple(np.array([len(x) for x in t], dtype=np.int64) for t in (bytes_a, bytes_b))
        self.names = [s + str(i) + e for i in range(len(bytes_a)) for s in ("", ";") for e in (",", "|")]
        self.base = len(self.names)
        self.names += [str(i) + e for i in range(len(bytes_b)) for e in (",", "")]
        self.rest = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)]
        self.open: _Open | None = None

    def step(self, rows: list[tuple]) -> list[tuple]:
        """Take rows (key, doc_id, side, ids); the rows of the documents that they end."""
        docs = [self.open] if self.open else []
        held: tuple[list, list] = ([self.rest[0]], [self.rest[1]])
        place: tuple[list, list] = ([np.zeros(len(self.rest[0]), dtype=np.int64)], [np.zeros(len(self.rest[1]), dtype=np.int64)])
        for key, doc_id, side, ids in rows:
            if not docs or docs[-1].key != key:
                docs.append(_Open(key, doc_id))
            ids = _unpack(ids)
            held[side].append(ids)
            place[side].append(np.full(len(ids), len(docs) - 1))
        a, b = (np.concatenate(x).astype(np.int64) for x in held)
        doc_a, doc_b = (np.concatenate(x) for x in place)
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        cuts = end_a[_found(end_a, end_b)]
        done_a, done_b = (int(np.searchsorted(e, cuts[-1], side="right")) if len(cuts) else 0 for e in (end_a, end_b))
        self.rest = [a[done_a:], b[done_b:]]
        if len(cuts):
            self._groups(docs, a[:done_a], b[:done_b], doc_a[:done_a], np.searchsorted(cuts, end_a[:done_a]), np.searchsorted(cuts, end_b[:done_b]), len(cuts))
        self.open = docs[-1] if docs else None
        return [d.row() for d in docs[:-1]]

    def end(self) -> list[tuple]:
        return [self.open.row()] if self.open else []

    def _groups(self, docs: list[_Open], a: np.ndarray, b: np.ndarray, doc_a: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: int) -> None:
        n_a, n_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        doc = doc_a[to_a - 1]
        # The listing: each group's A tokens, then its B tokens.
        names = np.empty(len(a) + len(b), dtype=np.int64)
        first, last = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        first[to_a - n_a], last[to_a - 1] = 1, 1
        names[np.arange(len(a)) + (to_b - n_b)[group_a]] = a * 4 + first * 2 + last
        last_b = np.zeros(len(b), dtype=np.int64)
        last_b[to_b - 1] = 1
        names[np.arange(len(b)) + to_a[group_b]] = self.base + b * 2 + last_b
        spelt = [self.names[i] for i in names.tolist()]
        # Groups of a document follow each other.
        at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        to = np.concatenate((at[1:], [n]))
        both = to_a + to_b
        for g, h in zip(at.tolist(), to.tolist(), strict=True):
            d = docs[doc[g]]
            text = "".join(spelt[both[g] - n_a[g] - n_b[g] : both[h - 1]])
            d.digest.update((text if d.n_groups else text[1:]).encode())
            d.n_a += int(n_a[g:h].sum())
            d.n_b += int(n_b[g:h].sum())
            d.n_groups += h - g
            d.n_links += int((n_a[g:h] * n_b[g:h]).sum())
        for g, h in _slices(n_a * n_b, LINKS):
            in_a, in_b = slice(to_a[g] - n_a[g], to_a[h - 1]), slice(to_b[g] - n_b[g], to_b[h - 1])
            if h == g + 1 and n_a[g] * n_b[g] > LINKS:
                self._large(docs[doc[g]], a[in_a], b[in_b])
                continue
            of, pair = _links(a[in_a], b[in_b], n_a[g:h], n_b[g:h])
            # Order by document and pair: ids of documents are consecutive, so they make the high part of one key.
            local = doc[g:h][of] - doc[g]
            order = np.lexsort((pair, local)) if local[-1] else np.argsort(pair, kind="stable")
            local, pair = local[order], pair[order]
            new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (local[1:] != local[:-1]))))
            times = np.diff(np.concatenate((new, [len(pair)])))
            pair, local = pair[new], local[new]
            border = np.searchsorted(local, np.arange(local[-1] + 2))
            for i in np.flatnonzero(np.diff(border)).tolist():
                d = docs[doc[g] + i]
                d.codes.append(pair[border[i] : border[i + 1]])
                d.times.append(times[border[i] : border[i + 1]])
                if len(d.codes) > 16:
                    d.codes, d.times = ([x] for x in _summed(d.codes, d.times))

    @staticmethod
    def _large(d: _Open, a: np.ndarray, b: np.ndarray) -> None:
        """A group with more links than are listed at once: pairs of its distinct ids."""
        (a, n_a), (b, n_b) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        for x, n in zip(a.tolist(), n_a.tolist(), strict=True):
            d.codes.append((x << 32) | b)
            d.times.append(n * n_b)
        d.codes, d.times = ([x] for x in _summed(d.codes, d.times))


def _found(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x's values are among y's; both ascend."""
    if not len(y):
        return np.zeros(len(x), dtype=bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most `most`, or hold one."""
    total = np.cumsum(sizes)
    g = 0
    while g < len(sizes):
        h = max(g + 1, int(np.searchsorted(total, (total[g - 1] if g else 0) + most, side="right")))
        yield g, h
        g = h


def _sweep(args: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(*args)
        machine = Sweep(both.bytes_a, both.bytes_b)
        rows, held = [], 0
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("key", "doc_id", "side")]
            for key, doc_id, side, ids in zip(*columns, batch.column("ids"), strict=True):
                ids = ids.as_py()
                rows.append((key, doc_id, side, ids))
                held += len(ids) // 2
                if held > STEP:
                    yield _batch(machine.step(rows), SWEPT)
                    rows, held = [], 0
        yield _batch(machine.step(rows) + machine.end(), SWEPT)

    return run


def _codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    out = []
    for x in batch.column("pairs"):
        both = _unpack(x.as_py()).astype(np.int64)
        half = len(both) // 2
        out.append((both[:half] << 32) | both[half:])
    return out


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): how many of a partition's documents hold each pair."""
    parts: list[np.ndarray] = []
    codes, counts, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    give = lambda: pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["pair", "n"])
    for batch in batches:
        for own in _codes(batch):
            parts.append(own)
            held += len(own)
            if held > HELD:
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                codes, counts = _summed([codes, found], [counts, n])
                parts, held = [], 0
                if len(codes) > HELD:
                    yield give()
                    codes, counts = codes[:0], counts[:0]
    if parts:
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        codes, counts = _summed([codes, found], [counts, n])
    yield give()


def _rated(hot):
    """Sums of each document over the hot pairs, and its other pairs."""
    names = "key doc_id n_a n_b n_groups n_links groups_sha256".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = hot.value
        for batch in batches:
            sums, tops, rest = [], [], []
            for codes, times in zip(_codes(batch), batch.column("times"), strict=True):
                times = _unpack(times.as_py()).astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, codes), max(0, len(pairs) - 1))
                known = pairs[at] == codes if len(pairs) else np.zeros(len(codes), dtype=bool)
                at, seen = at[known], times[known]
                sums.append(int((counts[at] * seen).sum()))
                tops.append(int(seen[best[at]].sum()))
                rest.append([{"pair": p, "times": t} for p, t in zip(codes[~known].tolist(), times[~known].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
            added = [pa.array(tops, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, kind)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *added], [*names, "n_best", "count_sum", "rest"])

    return run


def sweep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document its groups: where tokens of both sides end at one byte offset, what lies between two such offsets
    is a group, and all A-B pairs within one are links.

    Events of both sides (document, offset, id), packed by SEGMENT, go to one partition a document, in order of
    offset, and through a machine that holds only the open group and the document's sums. `pairs` packs the
    document's distinct linked id pairs, `times` how many of its links each has. A null or empty text, and one whose
    tokens spell other bytes than a space and the text, has no tokens. Rows that repeat, or share an id, are
    documents of their own. Other columns are not read.
    """
    import public_tokenizers

    paths = default_vocabularies()
    path_a, path_b = path_a or paths[0], path_b or paths[1]
    args = (path_a, path_b, pattern or public_tokenizers.PATTERN, merges_follow_ranks(path_a))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    events = rows.mapInArrow(_events(args), EVENTS)
    return events.repartition("key").sortWithinPartitions("key", "start", "side").mapInArrow(_sweep(args), SWEPT)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, **vocabularies: str) -> DataFrame:
    """sweep() with the corpus-wide counts of its links: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256.

    An id pair's count is the number of documents that hold it linked; n_best counts the links whose count is the
    highest of their A id (ties included), count_sum sums the counts over links. The `hot` most frequent pairs,
    with those of the same order of magnitude left out where they would exceed it, are looked up in each worker, a
    table of fixed size; all others, rare by choice, are joined. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    try:
        swept = scratch.keep(sweep(docs, id_col, text_col, **vocabularies))
        counts = scratch.keep(swept.select("pairs").mapInArrow(_holders, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
        side_a = F.shiftright("pair", 32)
        # One row for each id of side A: no more than its vocabulary holds.
        tops = counts.groupBy(side_a.alias("a")).agg(F.max("n").alias("top"))
        level = F.floor(F.log2("n") * 8).cast("int")
        rated = scratch.keep(
            counts.join(F.broadcast(tops), side_a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"), level.alias("level"))
        )
        lowest, room = 1 << 30, hot
        for row in sorted(rated.groupBy("level").count().collect(), reverse=True):
            room -= row["count"]
            if room < 0:
                break
            lowest = row["level"]
        table = rated.where(F.col("level") >= lowest).select("pair", "n", "best").toArrow()
        order = np.argsort(table["pair"].to_numpy())
        sent = spark.sparkContext.broadcast(tuple(np.asarray(table[c].to_numpy())[order] for c in ("pair", "n", "best")))
        kept = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<pair: long, times: long>>"
        looked = scratch.keep(swept.mapInArrow(_rated(sent), kept))
        rare = (
            looked.where(F.size("rest") > 0)
            .select("key", F.inline("rest"))
            .join(rated.where(F.col("level") < lowest), "pair")
            .groupBy("key")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
        )
        zero = F.lit(0).cast("long")
        return materialise(
            looked.drop("rest").join(rare, "key", "left").select(
                "doc_id", "n_a", "n_b", "n_groups", "n_links",
                (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
                (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"),
                "groups_sha256",
            )
        )
    finally:
        scratch.release()
