"""Divergence of sources: smoothed term shares of each (lang, source) group against the others and against its language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import Scratch, materialise

#: Groups of a block, terms of a vocabulary chunk at about, and chunks that one task of a pair of blocks goes through.
BLOCK, CHUNK, SPAN = 16, 2_048, 4
#: Documents of its language that hold a kept term, at least; terms that a group reports.
LEAST_DOCS, TOP = 3, 200
#: Distinct terms that a counting worker holds, and bytes of a text that it splits at once.
HELD, PIECE = 200_000, 1 << 20
#: Groups up to which their sums are sent to every task; with more they are joined by shuffle.
FEW = 100_000

#: Shares are counted in units of 1 / (SHARE_HIGH * SHARE_LOW); two factors keep products below 2^63.
SHARE_HIGH, SHARE_LOW = 32_000, 31_250

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _terms(text: str) -> Iterator[list[bytes]]:
    """A text's terms in lower case, piece by piece; a piece ends where no term does."""
    raw = text.encode().lower()  # of bytes, so A-Z only
    at = 0
    while at < len(raw):
        stop = _BREAK.search(raw, at + PIECE)
        end = stop.start() if stop else len(raw)
        yield _TERM.findall(raw, at, end)
        at = end


TALLY = "lang string, source string, term string, n long, docs long"


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each group's terms, summed within a partition; a space and the source in place of a term name the group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            size = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size), pa.array([source] * size), pa.array([" " + source, *[t.decode() for t in terms]], pa.string()),
                    pa.array([0, *[n[t] for t in terms]], pa.int64()), pa.array([0, *[docs[t] for t in terms]], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    held = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, batch.column("text"), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            own: set[bytes] = set()
            for terms in _terms(text.as_py()):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(n)
            if held > HELD:
                yield from give()
                held = 0
    yield from give()


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / total) in whole numbers, for totals up to 2 * 10^14."""
    high = (n + 1) * SHARE_HIGH
    return F.lit(1).cast("long") + F.call_function("div", high, total) * SHARE_LOW + F.call_function("div", (high % total) * SHARE_LOW, total)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _share(n: np.ndarray, total: int) -> np.ndarray:
    high = (n + 1) * SHARE_HIGH
    return 1 + high // total * SHARE_LOW + high % total * SHARE_LOW // total


def attach(big: DataFrame, small: DataFrame, keys: list[str], few: int) -> DataFrame:
    """big joined with small, which is sent to every task only where it has at most `few` rows."""
    return big.join(F.broadcast(small) if small.limit(few + 1).count() <= few else small, keys)


PAIRS = "lang string, source string, item string, value long"


class _Tile:
    """One pair of group blocks over one span of the vocabulary."""

    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi
        self.blocks: dict[int, list[dict]] = {lo: [], hi: []}
        self.left = 0
        self.sums: np.ndarray | None = None

    def group(self, row: dict) -> None:
        self.blocks[row["block"]].append(row)
        self.left = row["size"]

    def begin(self) -> None:
        self.x, self.y = self.blocks[self.lo], self.blocks[self.hi]
        self.place = {g["id"]: (g["block"], i) for b in self.blocks.values() for i, g in enumerate(b)}
        self.none = {b: np.array([_share(np.zeros(1, dtype=np.int64), g["total"] + g["v"])[0] if g["v"] else 1 for g in own], dtype=np.int64) for b, own in self.blocks.items()}
        self.sums = np.zeros((2, len(self.x), len(self.y)), dtype=np.int64)

    def chunk(self, rows: list[dict]) -> None:
        """Add one vocabulary chunk: terms that no group of the tile has are left for the end."""
        seen = np.unique(np.concatenate([r["at"] for r in rows]))
        self.left -= len(seen)
        shares = {b: np.repeat(none[:, None], len(seen), axis=1) for b, none in self.none.items()}
        for r in rows:
            b, i = self.place[r["id"]]
            g = self.blocks[b][i]
            shares[b][i, np.searchsorted(seen, r["at"])] = _share(r["n"], g["total"] + g["v"])
        self._add(shares[self.lo], shares[self.hi], 1)

    def _add(self, x: np.ndarray, y: np.ndarray, times: int) -> None:
        for j in range(len(y)):
            square = (x - y[j]) ** 2
            self.sums[0, :, j] += (square // y[j]).sum(axis=1) * times
            if self.lo != self.hi:
                self.sums[1, :, j] += (square // x).sum(axis=1) * times

    def end(self, lang: str) -> Iterator[tuple]:
        self._add(self.none[self.lo][:, None], self.none[self.hi][:, None], self.left)
        for i, g in enumerate(self.x):
            for j, h in enumerate(self.y):
                if g["id"] != h["id"]:
                    yield lang, g["source"], h["source"], int(self.sums[0, i, j])
                    if self.lo != self.hi:
                        yield lang, h["source"], g["source"], int(self.sums[1, i, j])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each pair of groups over one span, from rows in order of tile and chunk; the groups come first (chunk -1)."""
    key, tile, chunk, rows = None, None, None, []

    def out(made: Iterator[tuple]) -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.int64())], ["lang", "source", "item", "value"])

    def settle() -> None:
        if tile.sums is None:
            tile.begin()
        if rows:
            tile.chunk(rows)
            rows.clear()

    for batch in batches:
        names = ("lang", "lo", "hi", "span", "chunk", "block", "id", "source", "total", "v", "size")
        columns = [batch.column(n).to_pylist() for n in names]
        for i, values in enumerate(zip(*columns, strict=True)):
            row = dict(zip(names, values, strict=True))
            own = values[:4]
            if own != key:
                if tile:
                    settle()
                    yield out(tile.end(key[0]))
                key, tile, chunk = own, _Tile(row["lo"], row["hi"]), -1
            if row["chunk"] < 0:
                tile.group(row)
                continue
            if row["chunk"] != chunk:
                settle()
                chunk = row["chunk"]
            row["at"], row["n"] = (np.asarray(batch.column(c)[i].values) for c in ("at", "n"))
            rows.append(row)
    if tile:
        settle()
        yield out(tile.end(key[0]))


def counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, n_lang, first) of the terms that at least least_docs documents of their language hold,
    and a row with a null term for each group. first is true in one row of each language's term."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    tallied = docs.select(*text).mapInArrow(_tally, TALLY)
    each = tallied.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    rated = each.withColumn("n_lang", F.sum("n").over(over)).withColumn("held", F.sum("docs").over(over)).withColumn("first", F.col("source") == F.min("source").over(over))
    named = rated.withColumn("term", F.when(~F.startswith("term", F.lit(" ")), F.col("term")))
    return named.where(F.col("term").isNull() | (F.col("held") >= least_docs)).select("lang", "source", "term", "n", "n_lang", (F.col("term").isNotNull() & F.col("first")).alias("first"))


def group_sums(kept: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, total, n_all, v, id, blocks, chunks): a row for each group, ids from 0 in order of source."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    lang = Window.partitionBy("lang")
    numbered = own.select(
        "lang", "source", "total", F.sum("total").over(lang).alias("n_all"), F.sum("firsts").over(lang).alias("v"),
        (F.row_number().over(lang.orderBy("source")) - 1).alias("id"), F.count("*").over(lang).alias("groups"),
    )
    return numbered.withColumn("blocks", F.ceil(F.col("groups") / block).cast("int")).withColumn("chunks", F.ceil(F.col("v") / chunk).cast("int"))


def pair_sums(kept: DataFrame, groups: DataFrame, block: int = BLOCK, span: int = SPAN, few: int = FEW) -> DataFrame:
    """(lang, source, item, value): the summed distance of each group from each other group of its language.

    A group's counts of one vocabulary chunk are packed into one row, which goes to each pair of blocks that holds the
    group's block, one task for each span of chunks; partial sums of the spans are added up. A term that a group
    lacks has the share of a count of zero.
    """
    sums = groups.select("lang", "source", "id", "blocks", "chunks")
    placed = attach(kept.where("term is not null and n > 0"), sums, ["lang", "source"], few).withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks").cast("int"))
    at = F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    packed = placed.withColumn("at", at).groupBy("lang", "chunk", "id").agg(F.first("blocks").alias("blocks"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("packed"))
    vectors = packed.select("lang", "chunk", "id", "blocks", F.col("packed.at").alias("at"), F.col("packed.n").alias("n"))
    # Chunks are parts of the vocabulary by hash, so a span's terms are counted where each first stands.
    firsts = placed.where("first").groupBy("lang", F.floor(F.col("chunk") / span).cast("int").alias("span")).agg(F.count("*").alias("size"))
    spans = groups.select("lang", "source", "id", "blocks", "total", "v", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("chunks") / span).cast("int") - 1))).alias("span"))
    heads = spans.join(firsts, ["lang", "span"], "left").select("*", F.lit(-1).alias("chunk")).fillna(0, ["size"])
    rows = heads.unionByName(vectors.withColumn("span", F.floor(F.col("chunk") / span).cast("int")), allowMissingColumns=True)
    rows = rows.withColumn("block", F.floor(F.col("id") / block).cast("int"))
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    wanted = tiles.select("lang", "lo", "hi", "span", "chunk", "block", "id", "source", "total", "v", "size", "at", "n")
    dealt = wanted.repartition("lang", "lo", "hi", "span").sortWithinPartitions("lang", "lo", "hi", "span", "chunk", "id")
    return dealt.mapInArrow(_tiles, PAIRS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_distances(kept: DataFrame, groups: DataFrame, few: int = FEW) -> DataFrame:
    """(lang, source, item, value) of the terms whose share in the group is above their language's."""
    sums = groups.select("lang", "source", "total", "n_all", "v")
    rated = attach(kept.where("n > 0"), sums, ["lang", "source"], few).select(
        "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total") + F.col("v")).alias("p"), share(F.col("n_lang"), F.col("n_all") + F.col("v")).alias("q")
    )
    return rated.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, span: int = SPAN, few: int = FEW) -> DataFrame:
    """lang, source, part, item, value, rank for every group (lang, source) of docs.

    Part `pair` names each other source of the language with the sum, over all kept terms, of
    floor((p - q)^2 / q), p and q being the group's and the other's share; part `term` names up to `top` terms whose
    share p is above the language's q, with that term's distance. Ranks run from 1, by value descending, then item.
    A share is 1 + floor(10^9 * (count + 1) / (N + V)): V kept terms, N their occurrences in the group.

    Null lang, source or text read as empty. A language without kept terms has pairs of value 0; a source that is
    its language's only one has no pairs. Repeated rows count each. An empty table gives an empty result; other
    columns are not read, and a very long text is split piece by piece.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        kept = scratch.keep(counts(docs, least_docs))
        groups = scratch.keep(group_sums(kept, block, chunk))
        pairs = pair_sums(kept, groups, block, span, few).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        terms = term_distances(kept, groups, few).select("lang", "source", F.lit("term").alias("part"), "item", "value")
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        first = terms.withColumn("rank", place).where(F.col("rank") <= top)
        return materialise(pairs.withColumn("rank", place).union(first))
    finally:
        scratch.release()
