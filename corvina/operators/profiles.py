"""Profiles of the most frequent grams of each document, made and compared with those of languages where the text lies."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import starmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.session import stored

#: Grams of a profile, which is also what a gram costs that the other profile lacks; symbols of the longest gram.
MOST, LONGEST = 400, 5
#: A gram's symbols are packed by so many bits each, so an alphabet has fewer than 2 ** BITS of them.
BITS = 12
#: Symbols whose grams are counted at once.
PIECE = 1 << 18
#: Digits and white space, between words; what stands on either side of a word.
BETWEEN, EDGE = np.frombuffer(b"0123456789 \t\n\x0b\f\r", dtype=np.uint8), ord("_")
POINTS = 0x110000


def symbols(text: str, over_bytes: bool) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8) if over_bytes else np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _words(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of s between digits and white space."""
    apart = np.zeros(128, dtype=bool)
    apart[BETWEEN] = True
    inside = np.zeros(len(s) + 2, dtype=np.int8)
    inside[1:-1] = ~apart[np.minimum(s, 127)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _grams(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of words between edges, ascending, and how often each occurs. Shorter grams end in zeros, so they come first."""
    size = ends - starts + 2
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    left = np.repeat(size, size) - at
    padded = np.zeros(len(at) + LONGEST, dtype=np.uint64)
    padded[: len(at)] = np.where((at == 0) | (left == 1), edge, code[np.minimum(np.repeat(starts, size) + np.maximum(at, 1) - 1, len(code) - 1)])
    found, key = [], np.zeros(len(at), dtype=np.uint64)
    for k in range(LONGEST):
        key = key | padded[k : k + len(at)] << np.uint64(BITS * (LONGEST - 1 - k))
        found.append(key[left > k])
    every = np.sort(np.concatenate(found))
    heads = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[heads], np.diff(np.append(heads, len(every)))


def _most_frequent(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The MOST keys that occur most often, in that order; ties go to the smaller key. Keys are ascending."""
    if len(keys) > MOST:
        bound = np.partition(n, len(n) - MOST)[len(n) - MOST]
        above, level = n > bound, np.flatnonzero(n == bound)
        above[level[: MOST - int(above.sum())]] = True
        keys, n = keys[above], n[above]
    return keys[np.argsort(-n, kind="stable")]


class Known:
    """Profiles as (lang, gram, rank): gram is a text, or bytes."""

    def __init__(self, rows: Iterable[tuple[str | None, str | bytes, int]]) -> None:
        rows = list(rows)
        self.langs = list(dict.fromkeys(x[0] for x in rows))
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.array([place[x[0]] for x in rows], dtype=np.int64)
        self.rank = np.array([x[2] for x in rows], dtype=np.int64)
        self.grams = [x[1] for x in rows]
        self.symbols = np.full((len(rows), LONGEST), POINTS, dtype=np.int64)
        for i, (_, gram, _) in enumerate(rows):
            self.symbols[i, : len(gram)] = list(gram) if isinstance(gram, bytes) else [ord(c) for c in gram]

    def packed(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in ascending order, with their langs and ranks, of the grams all of whose symbols have a code."""
        codes = code[self.symbols].astype(np.uint64)
        keys = np.zeros(len(codes), dtype=np.uint64)
        for k in range(LONGEST):
            keys |= codes[:, k] << np.uint64(BITS * (LONGEST - 1 - k))
        whole = np.flatnonzero(((codes > 0) | (self.symbols == POINTS)).all(axis=1))
        order = whole[np.argsort(keys[whole], kind="stable")]
        return keys[order], self.lang[order], self.rank[order]

    def told(self, lang: np.ndarray, gaps: np.ndarray, size: int) -> list[tuple[str | None, int]]:
        """(lang, damage) of a document: languages at least 5 % better than English, within 5 % of the best of all."""
        saved, met = np.bincount(lang, gaps - MOST, len(self.langs)), np.bincount(lang, minlength=len(self.langs))
        damage = {self.langs[k]: int(saved[k]) + MOST * size for k in np.flatnonzero(met)}
        if not damage:
            return []
        best, english = min(damage.values()), damage.get("en", MOST * size)
        return [(k, d) for k, d in damage.items() if best < english and d * 105 < english * 100 and d * 100 < best * 105]


def _plain(text: str | bytes, s: np.ndarray, known: Known) -> list[tuple[str | None, int]]:
    """As _damage, for a text of more symbols than an alphabet has room for."""
    edge = b"_" if isinstance(text, bytes) else "_"
    n: Counter = Counter()
    for a, b in zip(*_words(s), strict=True):
        w = edge + text[a:b] + edge
        n.update(w[i : i + k] for i in range(len(w)) for k in range(1, min(LONGEST, len(w) - i) + 1))
    rank = {g: r for r, g in enumerate(sorted(n, key=lambda g: (-n[g], g))[:MOST], 1)}
    shared = [(k, abs(r - rank[g])) for k, g, r in zip(known.lang, known.grams, known.rank, strict=True) if g in rank]
    return known.told(np.array([x[0] for x in shared], dtype=np.int64), np.array([x[1] for x in shared], dtype=float), len(rank))


def _damage(s: np.ndarray, code: np.ndarray, packed: tuple[np.ndarray, np.ndarray, np.ndarray], known: Known) -> list[tuple[str | None, int]]:
    starts, ends = _words(s)
    if not len(starts):
        return []
    coded = code[s]
    size = np.cumsum(ends - starts + 2)
    cuts = [0, *np.flatnonzero(np.diff(size // PIECE)) + 1, len(starts)]  # a long text is counted piece by piece
    keys, n = zip(*starmap(lambda a, b: _grams(coded, starts[a:b], ends[a:b], int(code[EDGE])), zip(cuts, cuts[1:], strict=False)), strict=True)
    if len(keys) == 1:
        mine = _most_frequent(keys[0], n[0])
    else:
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        mine = _most_frequent(every, np.bincount(at, np.concatenate(n), len(every)).astype(np.int64))
    theirs, lang, rank = packed
    lo, hi = np.searchsorted(theirs, mine, "left"), np.searchsorted(theirs, mine, "right")
    many = hi - lo
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    gaps = np.abs(np.repeat(np.arange(1, len(mine) + 1), many) - rank[at])
    return known.told(lang[at], gaps, len(mine))


def compared(texts: list[str | None], known: Known, over_bytes: bool) -> Iterator[tuple[int, str | None, int]]:
    """(place of the text, lang, damage): see least_damage."""
    used = np.zeros(POINTS + 1, dtype=bool)
    given = [None if t is None else symbols(t, over_bytes) for t in texts]
    for s in given:
        if s is not None:
            used[s] = True

    def alphabet(found: np.ndarray) -> np.ndarray:
        code = np.zeros(POINTS + 1, dtype=np.uint16)
        code[found] = np.arange(1, len(found) + 1)
        return code

    used[EDGE] = True
    shared, whole = None, np.flatnonzero(used)
    if len(whole) < 1 << BITS:
        code = alphabet(whole)
        shared = code, known.packed(code)
    for i, s in enumerate(given):
        if s is None or not len(s):
            continue
        if shared:
            told = _damage(s, *shared, known)
        elif len(own := np.union1d(s, [EDGE])) < 1 << BITS:
            code = alphabet(own)
            told = _damage(s, code, known.packed(code), known)
        else:
            told = _plain(texts[i].encode() if over_bytes else texts[i], s, known)
        for lang, damage in told:
            yield i, lang, damage


def _counted(s: list[np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of several texts and how often each occurs."""
    keys, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for k, x in enumerate(s):
        starts, ends = _words(x)
        cuts = [0, *np.flatnonzero(np.diff(np.cumsum(ends - starts + 2) // PIECE)) + 1, len(starts)] if len(starts) else [0]
        waiting += [_grams(code[x], starts[i:j], ends[i:j], int(code[EDGE])) for i, j in zip(cuts, cuts[1:], strict=False)]
        if waiting and (k == len(s) - 1 or sum(len(w[0]) for w in waiting) > max(4 * PIECE, len(keys))):
            every = np.concatenate([keys, *(w[0] for w in waiting)])
            order = np.argsort(every, kind="stable")
            every, sums = every[order], np.concatenate([n, *(w[1] for w in waiting)])[order]
            heads = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            keys, n, waiting = every[heads], np.add.reduceat(sums, heads), []
    return keys, n


def _wide(code: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams as two numbers of three and two symbols, which order as the grams do, whatever their alphabet."""
    found = np.flatnonzero(code)
    symbol = np.zeros(len(found) + 1, dtype=np.int64)
    symbol[code[found]] = found + 1
    at = [symbol[((keys >> np.uint64(BITS * (LONGEST - 1 - k))) & np.uint64((1 << BITS) - 1)).astype(np.int64)] for k in range(LONGEST)]
    return at[0] << 42 | at[1] << 21 | at[2], at[3] << 21 | at[4]


def _runs(texts: list[str], over_bytes: bool, most: int = 1 << 18) -> Iterator[np.ndarray]:
    """The symbols of texts, some together with a space between."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= most:
            yield symbols(" ".join(held), over_bytes)
            held, size = [], 0
    if held:
        yield symbols(" ".join(held), over_bytes)


def _gram_counts(texts: list[str], over_bytes: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    used = np.zeros(POINTS + 1, dtype=bool)
    used[EDGE] = True
    runs = list(_runs(texts, over_bytes))
    for x in runs:
        used[x] = True
    if (size := int(used.sum())) < 1 << BITS:
        code = np.zeros(POINTS + 1, dtype=np.uint16)
        code[used] = np.arange(1, size + 1)
        keys, n = _counted(runs, code)
        yield *_wide(code, keys), n
    elif len(texts) > 1:
        yield from _gram_counts(texts[: len(texts) // 2], over_bytes)
        yield from _gram_counts(texts[len(texts) // 2 :], over_bytes)
    else:
        n_: Counter = Counter()
        for a, b in zip(*_words(runs[0]), strict=True):
            w = [EDGE + 1, *(runs[0][a:b].astype(int) + 1).tolist(), EDGE + 1]
            n_.update(tuple(w[i : i + k]) + (0,) * (LONGEST - k) for i in range(len(w)) for k in range(1, min(LONGEST, len(w) - i) + 1))
        at = np.array(list(n_), dtype=np.int64).reshape(-1, LONGEST).T
        yield at[0] << 42 | at[1] << 21 | at[2], at[3] << 21 | at[4], np.array(list(n_.values()), dtype=np.int64)


def language_profiles(documents: DataFrame, over_bytes: bool) -> list[tuple[str | None, str | bytes, int]]:
    """(lang, gram, rank) of each language's MOST most frequent grams over the texts of (lang, text), ties in order of the gram.

    Grams are counted in the worker, by batch of texts and language; the counts are shuffled as numbers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str | None, list[str]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text:
                    texts.setdefault(lang, []).append(text)
            for lang, given in texts.items():
                for hi, lo, n in _gram_counts(given, over_bytes):
                    for i in range(0, len(n), PIECE):
                        part = [pa.array(x[i : i + PIECE].astype(np.int64)) for x in (hi, lo, n)]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0]), pa.string()), *part], ["lang", "hi", "lo", "n"])

    counts = documents.select("lang", "text").mapInArrow(run, "lang string, hi long, lo long, n long").groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.col("n").desc(), "hi", "lo")
    out = []
    for r in counts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= MOST).select("lang", "hi", "lo", "r").collect():  # MOST rows a language
        at = [x - 1 for x in (r.hi >> 42, r.hi >> 21 & 0x1FFFFF, r.hi & 0x1FFFFF, r.lo >> 21, r.lo & 0x1FFFFF) if x]
        out.append((r.lang, bytes(at) if over_bytes else "".join(map(chr, at)), r.r))
    return out


def least_damage(documents: DataFrame, profiles: list[tuple[str | None, str | bytes, int]], over_bytes: bool, grouped: str) -> DataFrame:
    """(doc_id, lang, damage): the languages that a document fits best, of those at least 5 % better than English.

    `documents` is (doc_id, text), profiles each language's (lang, gram, rank); they go to every worker. A document's
    grams are counted, ranked and compared in the worker that has read it, so neither texts nor grams are shuffled. Texts
    that share an id are one document: `grouped`, SQL over the tables {documents} and {profiles}, sums up theirs.
    """
    known = Known(profiles)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(compared(batch["text"].to_pylist(), known, over_bytes))
            place = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(place), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], ["doc_id", "lang", "damage"])

    texts = documents.select("doc_id", "text").where("doc_id is not null")
    found = texts.mapInArrow(run, f"doc_id {kind}, lang string, damage long")
    shared = stored(texts.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if shared.isEmpty():
        return found
    spark, names = documents.sparkSession, {k: f"profiles_{uuid.uuid4().hex}" for k in ("documents", "profiles")}
    texts.join(shared, "doc_id", "left_semi").createOrReplaceTempView(names["documents"])
    rows = [(lang, gram.hex().upper() if isinstance(gram, bytes) else gram, rank) for lang, gram, rank in profiles]
    spark.createDataFrame(rows, "lang string, g string, r int").createOrReplaceTempView(names["profiles"])
    return found.join(shared, "doc_id", "left_anti").union(spark.sql(grouped.format(**names)))
