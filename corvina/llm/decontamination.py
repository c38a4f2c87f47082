"""Benchmark decontamination: suffix arrays over shards of training words, searched for every suffix of the test items."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm.common import Scratch, document_chunks

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Training words of one suffix array, at about; a document stays whole.
SHARD = 1 << 20
#: Words of the test items that are sent to the workers at once, at about; more items make more passes.
BLOCK = 1 << 20

# Words are runs of ASCII letters, digits and all bytes of non-ASCII characters.
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[0x30:0x3A] = OUTSIDE[0x41:0x5B] = OUTSIDE[0x61:0x7B] = OUTSIDE[0x80:] = False

ITEMS = "item_id string, n long, words binary"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's words as 64-bit hashes."""
    for batch in batches:
        for a, b, words in document_chunks(batch.column(1), lower=True, outside=OUTSIDE):
            sizes = np.diff(words.docs)
            each = [words.hashes[words.docs[i] : words.docs[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(each, pa.binary())], ["item_id", "n", "words"])


@dataclass
class TestItems:
    """One block of items, ready to be searched for: distinct windows, and where each stands."""

    names: list[str | None]
    vocabulary: np.ndarray  # sorted hashes; a word's number is its place + 1, 0 is any other word
    windows: np.ndarray  # distinct windows x longest window, numbers, 0 behind a short one
    sizes: np.ndarray
    first: np.ndarray  # windows + 1: each window's part of the next two
    item: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, names: list[str | None], words: list[np.ndarray], window: int) -> TestItems:
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *words])
        vocabulary = np.unique(flat)
        number = (np.searchsorted(vocabulary, flat) + 1).astype(np.int32)
        size = np.array([len(w) for w in words], dtype=np.int64)
        need = np.minimum(size, window)
        count = np.where(size > 0, size - need + 1, 0)
        item = np.repeat(np.arange(len(words)), count)
        start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        at = (np.cumsum(size) - size)[item] + start
        need = need[item]
        step = np.arange(window)
        padded = np.concatenate((number, np.zeros(window, dtype=np.int32)))
        rows = np.where(step < need[:, None], padded[at[:, None] + step], 0).astype(np.int32)
        windows, of = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, dtype=np.int64))
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(len(windows) + 1))
        return cls(names, vocabulary, windows, (windows > 0).sum(axis=1), first, item[order], start[order])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)

    def places(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into the given windows and into item / start, for every place of each."""
        count = self.first[windows + 1] - self.first[windows]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(np.arange(len(windows)), count), np.repeat(self.first[windows], count) + step


def suffix_array(words: np.ndarray, least: int, depth: int) -> np.ndarray:
    """Positions of words in the order of what follows there, by at least `depth` words; 0 ends a suffix.

    Ranks by one word are doubled to two, four and so on. Positions within a run of fewer than `least` numbers
    other than 0 are left out, since no match of that length fits in.
    """
    ends = np.flatnonzero(np.concatenate((words, [0])) == 0)
    starts = np.concatenate(([0], ends[:-1] + 1))
    keep = ends - starts >= least
    n = (ends - starts)[keep]
    at = np.repeat(starts[keep] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    rank = np.zeros(len(words) + depth + 1, dtype=np.int64)
    rank[at] = words[at]
    order, done = np.arange(len(at)), 1
    while True:
        key = (rank[at] << 32) | (rank[at + done] if done < depth else 0)
        order = np.argsort(key, kind="stable")
        if done >= depth:
            return at[order]
        key = key[order]
        rank[at[order]] = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else 0
        done *= 2


def search(words: np.ndarray, suffixes: np.ndarray, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all windows at once: the first suffix that begins with each, and the one after the last."""
    step = np.arange(windows.shape[1])
    padded = np.concatenate((words, np.zeros(windows.shape[1], dtype=words.dtype)))
    bounds = []
    asked = np.arange(len(windows))
    for above in (False, True):
        lo, hi = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(suffixes), dtype=np.int64)
        if above:
            asked = asked[bounds[0] < len(suffixes)]
            lo, hi = bounds[0].copy(), np.where(bounds[0] < len(suffixes), len(suffixes), bounds[0])
        open_ = asked[lo[asked] < hi[asked]]
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            here = padded[suffixes[mid][:, None] + step]
            here[step >= sizes[open_][:, None]] = 0
            differ = here != windows[open_]
            col = differ.argmax(axis=1)
            row = np.arange(len(open_))
            less, equal = here[row, col] < windows[open_][row, col], ~differ[row, col]
            right = less | equal if above else less
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        bounds.append(lo)
    return bounds[0], bounds[1]


def occurrences(words: np.ndarray, items: TestItems) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every place where a window stands in words."""
    if not len(items.windows):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    suffixes = suffix_array(words, int(items.sizes.min()), items.windows.shape[1])
    lo, hi = search(words, suffixes, items.windows, items.sizes)
    n = hi - lo
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return suffixes[np.repeat(lo, n) + step], np.repeat(np.arange(len(n)), n)


def _intervals(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The union of [at, at + size) as rows (start, end), given in any order."""
    if not len(at):
        return np.zeros((0, 2), dtype=np.int64)
    order = np.argsort(at, kind="stable")
    start, end = at[order], np.maximum.accumulate((at + size)[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return np.stack([start[first], end[np.concatenate((first[1:] - 1, [len(end) - 1]))]], axis=1)


def _runs(at: np.ndarray, window: np.ndarray, items: TestItems) -> list[tuple]:
    """Longest verbatim matches of one document: windows that follow each other in both texts, joined."""
    of, place = items.places(window)
    at, size = at[of], items.sizes[window][of]
    item, start = items.item[place], items.start[place]
    order = np.lexsort((at, at - start, item))
    at, item, start, size = at[order], item[order], start[order], size[order]
    new = np.concatenate(([True], (item[1:] != item[:-1]) | (at[1:] - start[1:] != at[:-1] - start[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    return [(items.names[item[i]], int(start[i]), int(at[i]), int(at[j] - at[i] + size[j])) for i, j in zip(first.tolist(), last.tolist(), strict=True)]


_MATCH = "array<struct<item_id: string, item_start: long, start: long, n_words: long>>"
_FOUND = "_n_words long, _n_hit long, _spans array<long>, _item_ids array<string>"
_KINDS = [("_n_words", pa.int64()), ("_n_hit", pa.int64()), ("_spans", pa.list_(pa.int64())), ("_item_ids", pa.list_(pa.string()))]
_MATCHES = ("_matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64())])))


def _find(sent, text_col: str, matches: bool):
    """Add to each row what one block of items finds in it, to what earlier blocks found."""

    def documents(words: list[np.ndarray], earlier: list[tuple], items: TestItems) -> list[tuple]:
        sizes = np.array([len(w) for w in words])
        shard = np.zeros(int(sizes.sum()) + len(words), dtype=np.int32)
        begin = np.cumsum(sizes + 1) - sizes - 1  # a 0 behind each document
        for at, own in zip(begin.tolist(), words, strict=True):
            shard[at : at + len(own)] = own
        at, window = occurrences(shard, items)
        doc = np.searchsorted(begin, at, side="right") - 1
        order = np.argsort(doc, kind="stable")
        at, window, doc = (at - begin[doc])[order], window[order], doc[order]
        border = np.searchsorted(doc, np.arange(len(words) + 1))
        rows = []
        for i, (spans, ids, known) in enumerate(earlier):
            own = slice(border[i], border[i + 1])
            if border[i] < border[i + 1]:
                both = np.concatenate((_intervals(at[own], items.sizes[window[own]]), np.array(spans, dtype=np.int64).reshape(-1, 2)))
                spans = _intervals(both[:, 0], both[:, 1] - both[:, 0]).ravel().tolist()
                found = np.unique(items.item[items.places(np.unique(window[own]))[1]]).tolist()
                ids = sorted({*ids, *(items.names[k] for k in found if items.names[k] is not None)})
                if matches:
                    known = known + [dict(zip(("item_id", "item_start", "start", "n_words"), m, strict=True)) for m in _runs(at[own], window[own], items)]
            rows.append((int(sizes[i]), sum(spans[1::2]) - sum(spans[::2]), spans, ids, *([known] if matches else [])))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        kinds = [*_KINDS, *([_MATCHES] if matches else [])]
        for batch in batches:
            names = batch.schema.names
            plain = [c for c in names if c not in dict(kinds)]
            before = [batch.column(c).to_pylist() if c in names else [[] for _ in range(len(batch))] for c in ("_spans", "_item_ids", "_matches")]
            earlier = list(zip(*before, strict=True))
            words, held, begun = [], 0, 0
            for a, b, chunk in document_chunks(batch.column(text_col), lower=True, outside=OUTSIDE):
                numbers = items.numbers(chunk.hashes)
                words += [numbers[chunk.docs[i] : chunk.docs[i + 1]] for i in range(b - a)]
                held += len(numbers)
                if held >= SHARD or b == len(batch):
                    rows = documents(words, earlier[begun:b], items)
                    added = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(begun, b - begun) for c in plain], *added], [*plain, *[n for n, _ in kinds]])
                    words, held, begun = [], 0, b

    return run


def find(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK, matches: bool = False
) -> DataFrame:
    """docs with what its texts share with the items: _n_words, _n_hit (words inside any occurrence of a window),
    _spans (start and end of each stretch of hit words), _item_ids (of the items with occurring windows, as sorted
    strings), and with `matches` also _matches: the longest verbatim matches (item_id, item_start, start, n_words),
    starts counted in words from 0.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased; windows are `window`
    consecutive words of an item, or all words of a shorter one. Each task cuts its documents into shards, sorts a
    shard's suffixes and searches them for every distinct window; documents are never shuffled. Items go to the
    workers in blocks of about `block` words, one pass after another, so what is broadcast does not grow with
    them. Words are compared by 64-bit hashes; two given words are one with a probability of 5e-20.

    Null and empty texts have no words. Items that repeat count once; an item without an id hits words but is not
    named. Rows of docs come back as often as given, with all their columns; columns that begin with an
    underscore and bear one of the names above are not allowed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    taken = {n for n, _ in _KINDS} | {_MATCHES[0]}
    if clash := taken & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are in use")
    try:
        named = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).alias("text"))
        items = scratch.keep(named.mapInArrow(_hashed, ITEMS).where("n > 0").distinct())
        total = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        blocks = max(1, -(-total // block))
        # Rows are dealt one by one, since any key of theirs may be a hot one.
        dealt = scratch.keep(items.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")))
        added = T.StructType.fromDDL(f"{_FOUND}, _matches {_MATCH}" if matches else _FOUND)
        out, made = docs, T.StructType(docs.schema.fields + added.fields)
        for i in range(blocks):
            part = dealt.where(F.col("block") == i).toArrow()
            words = [np.frombuffer(w, dtype=np.uint64) for w in part["words"].to_pylist()]
            sent = spark.sparkContext.broadcast(TestItems.of(part["item_id"].to_pylist(), words, window))
            out = out.mapInArrow(_find(sent, text_col, matches), made)
        return out
    finally:
        scratch.release()


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document doc_id, n_words, n_hit, n_items, items_sha256 (of the comma-joined ids), contaminated."""
    found = find(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text", **options)
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("_item_ids", ","), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"),
    )


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, item_start, start, n_words: every longest verbatim match of a window or more."""
    found = find(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text", matches=True, **options)
    return found.select("doc_id", F.inline("_matches"))


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with their own columns, in whose text no window of an item occurs."""
    return find(docs, benchmark, text_col, **options).where("_n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
