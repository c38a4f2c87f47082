"""Quality classifier: a factorisation machine over hashed words, structure statistics and length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import document_chunks, materialise, mix

BUCKETS, FACTORS = 1 << 14, 4
#: Labelled documents that the machine is fitted on at most, the ones with the smallest hashes.
SAMPLE = 10_000
EPOCHS, RATE, DECAY, BATCH = 6, 0.1, 1e-5, 128
#: Score from which a document is predicted to be good.
CUT = 0.7

STRUCTURE = ("words", "word length", "symbols", "upper", "digits", "bars", "lines", "again", "stutter")
WIDTH = BUCKETS + len(STRUCTURE)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&<>=@!"]] = True


def features(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a chunk's documents: first positions, feature numbers, values.

    Words: square roots of counts over the document, scaled to length one. Structure: shares and
    logarithms near the unit range.
    """
    docs, w, data = words.docs, words.hashes, words.data
    n = np.diff(docs)
    count = len(n)
    edges = np.concatenate(([0], words.starts, [len(data)]))[np.minimum(docs, len(w)) + 1] if len(w) else np.zeros(count + 1, dtype=np.int64)
    edges[0], edges[-1] = 0, len(data)

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return np.diff(total[edges]).astype(np.float64)

    size = np.maximum(np.diff(edges), 1)
    owner = np.repeat(np.arange(count), n)
    letters = np.bincount(owner, weights=words.ends - words.starts, minlength=count)
    stutter = np.zeros(count)
    if len(w) > 1:
        same = (w[1:] == w[:-1]) & (owner[1:] == owner[:-1])
        stutter = np.bincount(owner[1:][same], minlength=count)
    key = (owner.astype(np.uint64) << np.uint64(40)) + (mix(w) & np.uint64(BUCKETS - 1))
    distinct, times = np.unique(key, return_counts=True)
    home = (distinct >> np.uint64(40)).astype(np.int64)
    bucket = (distinct & np.uint64(BUCKETS - 1)).astype(np.int64)
    value = np.sqrt(times) / np.sqrt(np.maximum(n, 1))[home]
    again = np.bincount(home, weights=times - 1, minlength=count)
    some = np.maximum(n, 1)
    table = np.stack(
        [
            np.log1p(n) / 8,
            np.minimum(letters / some, 20) / 8,
            np.minimum(inside(_SYMBOL[data]) / some, 4),
            inside((data >= 65) & (data <= 90)) / size * 4,
            inside((data >= 48) & (data <= 57)) / size * 4,
            np.minimum(inside(data == ord("|")) / some, 1) * 2,
            np.minimum(inside(data == 10) / some, 1) * 2,
            again / some,
            stutter / some * 2,
        ],
        axis=1,
    )
    home = np.concatenate((home, np.repeat(np.arange(count), len(STRUCTURE))))
    feature = np.concatenate((bucket, np.tile(np.arange(BUCKETS, WIDTH), count)))
    value = np.concatenate((value, table.ravel()))
    order = np.argsort(home, kind="stable")
    return np.searchsorted(home[order], np.arange(count + 1)), feature[order], value[order]


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        rows = len(first) - 1
        out = self.bias + np.bincount(row, weights=self.weight[feature] * value, minlength=rows)
        for f in range(self.factor.shape[1]):
            vx = self.factor[feature, f] * value
            out += 0.5 * (np.bincount(row, weights=vx, minlength=rows) ** 2 - np.bincount(row, weights=vx * vx, minlength=rows))
        return out

    def score(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(first, feature, value), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, in small batches; deterministic for given rows."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, FACTORS)))
    if not len(rows):
        return machine
    share = (labels.sum() + 1) / (len(labels) + 2)
    machine.bias = float(np.log(share / (1 - share)))
    g_bias, g_weight, g_factor = 1e-6, np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            feature = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            first = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in part])))
            row = np.repeat(np.arange(len(part)), np.diff(first))
            error = (machine.score(first, feature, value) - labels[part]) / len(part)
            used, place = np.unique(feature, return_inverse=True)
            slope = error[row] * value
            grad = np.bincount(place, weights=slope) + DECAY * machine.weight[used]
            g_bias += error.sum() ** 2
            machine.bias -= RATE * error.sum() / np.sqrt(g_bias)
            steps = []
            for f in range(FACTORS):
                v = machine.factor[feature, f]
                total = np.bincount(row, weights=v * value, minlength=len(part))
                steps.append(np.bincount(place, weights=slope * (total[row] - v * value)) + DECAY * machine.factor[used, f])
            g_weight[used] += grad**2
            machine.weight[used] -= RATE * grad / np.sqrt(g_weight[used])
            step = np.stack(steps, axis=1)
            g_factor[used] += step**2
            machine.factor[used] -= RATE * step / np.sqrt(g_factor[used])
    return machine


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in document_chunks(batch.column(1), lower=True):
            first, feature, value = features(words)
            offsets = pa.array(first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(2).slice(a, b - a),
                    pa.ListArray.from_arrays(offsets, pa.array(feature.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32))),
                ],
                ["doc_id", "label", "feature", "value"],
            )


def _scorer(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in document_chunks(batch.column(1), lower=True):
                first, feature, value = features(words)
                score = machine.score(first, feature, value.astype(np.float32).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], ["doc_id", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most `sample` labelled documents that are not held out; the driver holds their features only.

    Labels that are null, or contradict each other for one document, count as their maximum.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = materialise(chosen)  # at most `sample` rows of two numbers: safe to broadcast
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    got = rows.mapInArrow(_featurise, "doc_id long, label int, feature array<int>, value array<float>").dropDuplicates(["doc_id"])
    table = got.toArrow().sort_by("doc_id")
    label = table["label"].to_numpy().astype(np.float64)
    # Views of the Arrow buffers: 8 bytes for each word that a document holds, at most `sample` times WIDTH of them.
    return fit([(f.values.to_numpy(), v.values.to_numpy()) for f, v in zip(table["feature"], table["value"], strict=True)], label)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from CUT on).

    Only the text is read for a score, the whole of it; a null or empty text has structure features alone. A null id is
    not held out. Repeated rows come back as given. The model has a fixed size.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    machine = train(named, labels, sample)
    scored = named.mapInArrow(_scorer(machine), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
