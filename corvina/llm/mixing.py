"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import Scratch, Words, document_chunks, materialise, mix as scramble

DIMENSIONS = ("source", "lang", "topic")
#: Default target shares are the margins of the strata's tokens to this power: large strata give way to small ones.
TEMPER = 0.7
#: A margin is met when it is within this share of all kept tokens. Rounds between two tests, and at most; a stride
#: that does not take this much off the largest gap ends the fitting.
TOLERANCE, STRIDE, ROUNDS, PROGRESS = 1e-4, 3, 60, 0.2
#: Share of the tokens to keep.
BUDGET = 0.6
SEED = 20240131
#: Topics are clusters of hashed word vectors, found on all documents. Sums of vectors are whole numbers of 1 / UNIT, so
#: that they do not depend on the order of the rows.
TOPICS, BUCKETS, ITERATIONS, UNIT = 8, 1 << 12, 12, 1 << 30


def _counted(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(words.docs)
    owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    at, times = np.unique(owner * np.uint64(BUCKETS) + scramble(words.hashes) % np.uint64(BUCKETS), return_counts=True)
    home = at // np.uint64(BUCKETS)
    return np.searchsorted(home, np.arange(len(n) + 1)), (at % np.uint64(BUCKETS)).astype(np.int64), times


def bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse word vectors of a chunk's documents: first positions, buckets, square roots of counts."""
    first, bucket, times = _counted(words)
    return first, bucket, np.sqrt(times)


def _by_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each document's values; 0 without values."""
    out, some = np.zeros(len(first) - 1), np.diff(first) > 0
    if some.any():
        out[some] = np.add.reduceat(values, first[:-1][some])
    return out


def likeness(first: np.ndarray, bucket: np.ndarray, value: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Inner products, centres by documents."""
    return np.stack([_by_document(c.take(bucket) * value, first) for c in centres])


def nearest(first: np.ndarray, bucket: np.ndarray, value: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each document's topic; -1 where it has no words."""
    return np.where(np.diff(first) > 0, likeness(first, bucket, value, centres).argmax(axis=0), -1)


#: An item of a stored word vector is 16 bits: the bucket, and above it the count. From OFTEN on the count stands in a column of its own.
SHIFT = BUCKETS.bit_length() - 1
OFTEN = (1 << 16 - SHIFT) - 1
ROOTS = np.sqrt(np.arange(OFTEN + 1))
#: Items that are weighed at once.
PIECE = 1 << 16


def _binary(items: np.ndarray, first: np.ndarray) -> pa.Array:
    ends = pa.py_buffer((first * items.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, ends, pa.py_buffer(items.tobytes())])


def counted_text(text: Column) -> Column:
    """(tokens, bag, often) of a text: its words, its stored word vector and that one's large counts. A null text reads as empty."""

    def run(column: pa.Array) -> pa.Array:
        kind = pa.struct([("tokens", pa.float64()), ("bag", pa.binary()), ("often", pa.binary())])
        out = [pa.array([], kind)]
        for _, _, words in document_chunks(column, lower=True):
            first, bucket, times = _counted(words)
            many = np.flatnonzero(times >= OFTEN)
            code = (bucket | np.minimum(times, OFTEN) << SHIFT).astype("<u2")
            columns = [pa.array(np.diff(words.docs).astype(np.float64)), _binary(code, first), _binary(times[many].astype("<u4"), np.searchsorted(many, first))]
            out.append(pa.StructArray.from_arrays(columns, fields=list(kind)))
        return pa.concat_arrays(out)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}  # types themselves, not their names
    return F.arrow_udf(run, "struct<tokens:double,bag:binary,often:binary>")(text)


def _items(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    size = np.dtype(kind).itemsize
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    items = np.frombuffer(data, dtype=kind, count=int(off[-1] - off[0]) // size, offset=int(off[0])) if data is not None else np.zeros(0, dtype=kind)
    return items, (off - off[0]) // size


def pieces(bag: pa.Array, often: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Stored bags in pieces of about PIECE items: first document, first positions, buckets, square roots of counts."""
    if not len(bag):
        return
    (codes, off), (counts, more) = _items(bag, "<u2"), _items(often, "<u4")
    start = 0
    while start < len(bag):
        end = min(len(bag), max(start + 1, int(np.searchsorted(off, off[start] + PIECE, side="right")) - 1))
        code = codes[off[start] : off[end]]
        times = code >> SHIFT
        value = ROOTS.take(times)
        value[times == OFTEN] = np.sqrt(counts[more[start] : more[end]])
        yield start, off[start : end + 1] - off[start], (code & (BUCKETS - 1)).astype(np.int64), value
        start = end


def _rarity(bags: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and of each bucket the weight of its words, more for rare ones."""

    def run(batches):
        seen, documents = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for _, _, bucket, _ in pieces(batch["bag"], batch["often"]):
                seen += np.bincount(bucket, minlength=BUCKETS)
        if documents:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS), pa.int32()), pa.array(np.append(documents, seen))], ["bucket", "n"])

    n = np.zeros(BUCKETS + 1, dtype=np.int64)
    table = bags.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n[np.asarray(table["bucket"])] = np.asarray(table["n"])  # the documents' number comes last
    return int(n[-1]), np.log((1 + n[-1]) / (1 + n[:-1]))


def _size(first: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(_by_document(weight * weight, first)), 1e-9)


def _farthest(bags: DataFrame, rare: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The vector of the document that is least like any centre; of several, the one with the smallest hash."""

    def run(batches):
        best = None
        for batch in batches:
            prints = np.asarray(batch["print"])
            for start, first, bucket, value in pieces(batch["bag"], batch["often"]):
                weight = value * rare.take(bucket)
                near = likeness(first, bucket, weight, centres).max(axis=0) / _size(first, weight)
                at = np.lexsort((prints[start : start + len(near)], near))[0]
                found = float(near[at]), *(batch[c][start + int(at)].as_py() for c in ("print", "bag", "often"))
                best = found if best is None else min(best, found)
        if best:
            yield pa.RecordBatch.from_pylist([dict(zip(("near", "print", "bag", "often"), best, strict=True))])

    if len(centres):
        bags = bags.mapInArrow(run, "near double, print long, bag binary, often binary")
    else:  # none is near, so hashes alone tell
        bags = bags.withColumn("near", F.lit(0.0))
    found = bags.orderBy("near", "print", "bag", "often").first()
    (_, first, bucket, value), *_ = pieces(pa.array([bytes(found["bag"])], pa.binary()), pa.array([bytes(found["often"])], pa.binary()))
    weight = value * rare.take(bucket)
    return np.bincount(bucket, weights=weight / _size(first, weight), minlength=BUCKETS)


def _sums(bags: DataFrame, rare: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each centre the sum of the documents that are most like it, in units."""
    names = [f"t{i}" for i in range(len(centres))]

    def run(batches):
        total, rows = np.zeros(len(centres) * BUCKETS, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, first, bucket, value in pieces(batch["bag"], batch["often"]):
                weight = value * rare.take(bucket)
                own = likeness(first, bucket, weight, centres).argmax(axis=0)
                units = np.rint(weight / np.repeat(_size(first, weight), np.diff(first)) * UNIT)
                total += np.bincount(np.repeat(own * BUCKETS, np.diff(first)) + bucket, weights=units, minlength=len(total)).astype(np.int64)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS), pa.int32()), *map(pa.array, total.reshape(-1, BUCKETS))], ["bucket", *names])

    table = bags.select("bag", "often").mapInArrow(run, "bucket int, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    return np.stack([np.asarray(c) for c in table.sort_by("bucket").columns[1:]])


def fit_topics(counted: DataFrame) -> np.ndarray:
    """Cluster centres (TOPICS x BUCKETS, rare words weigh more) of all documents with words: spherical k-means, farthest first.

    Takes a stored table of each text's hash and word vector (print, bag, often), which each round reads. Every row counts,
    repeated ones too. What the driver holds is the centres. The same rows give the same centres, however they lie.
    """
    bags = counted.select("print", "bag", "often").where("octet_length(bag) > 0")
    documents, rare = _rarity(bags.select("bag", "often"))
    centres = np.zeros((0, BUCKETS))
    while len(centres) < min(TOPICS, documents):
        centres = np.concatenate((centres, _farthest(bags, rare, centres)[None]))
    last = None
    for _ in range(ITERATIONS if documents else 0):
        sums = _sums(bags, rare, centres)
        if last is not None and (sums == last).all():
            break
        last, size = sums, np.linalg.norm(sums.astype(float), axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
    return centres * rare if documents else np.zeros((1, BUCKETS))


def topic_model(docs: DataFrame, text_col: str) -> np.ndarray:
    """fit_topics of the documents' texts."""
    scratch = Scratch(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    centres = fit_topics(scratch.keep(docs.select(F.xxhash64(text).alias("print"), counted_text(text).alias("about")).select("print", "about.bag", "about.often")))
    scratch.release()
    return centres


def topic_name(centres: np.ndarray) -> Column:
    """The name of the topic of a stored word vector (bag, often), `none` without words."""

    def run(bag: pa.Array, often: pa.Array) -> pa.Array:
        topics = [np.zeros(0, dtype=np.int64), *(nearest(first, bucket, value, centres) for _, first, bucket, value in pieces(bag, often))]
        return pa.array(["none", *[f"topic {i}" for i in range(TOPICS)]]).take(pa.array(np.concatenate(topics) + 1))

    run.__annotations__ = {"bag": pa.Array, "often": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")("bag", "often")


def fill(margin: DataFrame, whole: float) -> DataFrame:
    """Margins (value, have, share) with `target`: whole is dealt by share, but no value gets more than it has.

    What a value cannot take goes to the others by their shares. With the values in the order in which they fill up,
    those before some point are full and the rest share what is left; a running sum shows the point.
    """
    by = Window.orderBy(F.col("have") / F.col("share"), "value")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    steps = margin.where("share > 0 and have > 0").withColumn("full", F.coalesce(F.sum("have").over(before), F.lit(0.0)))
    steps = steps.withColumn("open", F.sum("share").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    steps = steps.withColumn("rate", F.greatest(F.lit(0.0), (F.lit(whole) - F.col("full")) / F.col("open")))
    level = steps.where(F.col("share") * F.col("rate") <= F.col("have")).agg(F.max("rate")).first()[0]
    target = F.when((F.col("share") <= 0) | (F.col("have") <= 0), 0.0).otherwise(F.col("have") if level is None else F.least("have", F.col("share") * F.lit(level)))
    return margin.withColumn("target", target)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """Cells (dimensions, tokens) with weight, the tokens to keep of each: at most `tokens`, `budget` of all in sum.

    Without given targets a margin's shares are those of its strata's tokens to the power TEMPER, so that the margins
    agree with each other. Values that the targets do not name keep a share of zero; where a value holds fewer tokens than its share asks for, it keeps
    them all and the others get more. Each round meets one margin after the other: cells at their limit stay
    there while the others grow, so the sums are right again. It ends when all margins are met, or when the gaps stay,
    as they do where no weights meet them all; margins() tells what was met. Fitting runs over the table of strata, which
    holds one row per combination and no documents.
    """
    scratch = Scratch(cells.sparkSession)
    cells = scratch.keep(cells.where("tokens > 0"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    out = cells.withColumn("weight", F.col("tokens") * budget)
    for d in DIMENSIONS:
        have = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("have"), F.sum(F.pow("tokens", F.lit(TEMPER))).alias("share"))
        if targets and d in targets:
            named = reduce(lambda c, t: F.when(F.col("value") == t[0], float(t[1])).otherwise(c), targets[d].items(), F.lit(0.0))
            margin = have.withColumn("share", named)
        else:
            margin = have
        made = fill(scratch.keep(margin), budget * total)
        out = out.join(made.select(F.col("value").alias(d), F.col("target").alias(f"target_{d}")), d)
    out = scratch.keep(out)
    gap = float("inf")
    for _ in range(0, rounds, STRIDE):
        for d in DIMENSIONS * STRIDE:
            own = Window.partitionBy(d)
            at_limit = F.col("weight") >= F.col("tokens") * (1 - 1e-12)
            now, held = F.sum("weight").over(own), F.sum(F.when(at_limit, F.col("weight")).otherwise(0.0)).over(own)
            target = F.col(f"target_{d}")
            grow = F.when(now > held, (target - held) / (now - held)).otherwise(1.0)
            factor = F.when(now <= 0, 0.0).when(now >= target, target / now).when(at_limit, 1.0).otherwise(grow)
            out = out.withColumn("weight", F.least("tokens", F.col("weight") * factor))
        out = scratch.keep(out)
        last, gap = gap, margins(out).agg(F.max(F.abs(F.col("target") - F.col("fitted")))).first()[0] or 0.0
        if gap <= TOLERANCE * budget * total or gap > (1 - PROGRESS) * last:
            break
    out = materialise(out.select(*DIMENSIONS, "tokens", "weight", *[f"target_{d}" for d in DIMENSIONS]))
    scratch.release()
    return out


def margins(raked: DataFrame) -> DataFrame:
    """(dimension, value, target, fitted): what was asked of each margin, and what the weights give."""
    sums = [raked.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.max(f"target_{d}").alias("target"), F.sum("weight").alias("fitted")) for d in DIMENSIONS]
    return reduce(DataFrame.union, sums)


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from a hash of the key: the same for the same key, wherever it is computed."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(2**53))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, columns: list[str] | None = None) -> DataFrame:
    """(row, source, lang, topic, tokens, keep, drawn): each document's probability, and whether it is drawn.

    `row` holds the given columns, all without a choice. A null source or language is a stratum of its own, `(none)`. Documents
    without words have no weight and are kept. A draw depends on the id alone, so repeated rows, and all rows without an id, share
    their fate within a stratum. Texts are read whole, and once: rows are stored with their word vectors, on which topics are fitted
    and told. The strata are counted over all documents; the planner broadcasts their table only where its size allows, and
    splits a hot stratum where it does not.
    """
    counted = materialise(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"),
            uniform(F.col(f"`{id_col}`")).alias("place"),
            F.coalesce(F.col("source"), F.lit("(none)")).alias("source"),
            F.coalesce(F.col("lang"), F.lit("(none)")).alias("lang"),
            F.xxhash64(F.col(f"`{text_col}`")).alias("print"),
            counted_text(F.col(f"`{text_col}`")).alias("about"),
        ).select("row", "place", "source", "lang", "print", "about.tokens", "about.bag", "about.often")
    )
    measured = counted.withColumn("topic", topic_name(fit_topics(counted))).select("row", "place", *DIMENSIONS, "tokens")
    cells = materialise(measured.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    chances = rake(cells, targets, budget).select(*DIMENSIONS, (F.col("weight") / F.col("tokens")).alias("keep"))
    found = measured.join(chances, list(DIMENSIONS), "left").withColumn("keep", F.coalesce("keep", F.lit(1.0)))
    return found.select("row", *DIMENSIONS, "tokens", "keep", (F.col("place") < F.col("keep")).alias("drawn"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The documents drawn, with their own columns."""
    return mix(docs, **options).where("drawn").select("row.*")


def mixing_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: stratum, tokens, probability and draw."""
    out = mix(docs.select(F.col(id_col).alias("doc_id"), "text", "source", "lang"), columns=["doc_id"], **options)
    return out.select("row.doc_id", *DIMENSIONS, F.col("tokens").cast("long").alias("tokens"), F.round("keep", 6).alias("keep"), "drawn")
