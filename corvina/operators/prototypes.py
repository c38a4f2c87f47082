"""Prototype learning in epochs: each epoch is one distributed sum over all rows, for a bounded set of prototypes.

Row-by-row updates depend on the order of rows and cannot be spread; these are their batch forms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators.strips import principal_axes

#: Prototypes times dimensions that may be sent with a task.
LARGEST = 1_000_000


def _sums(rows: DataFrame, columns: list[str], step: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum over all rows of a matrix that `step` gives per batch; only one matrix per batch is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = step(pdf)
                yield pd.DataFrame({"i": np.repeat(np.arange(m.shape[0]), m.shape[1]), "j": np.tile(np.arange(m.shape[1]), m.shape[0]), "x": m.ravel()})

    # As many rows as the matrix has cells.
    cells = rows.select(*columns).mapInPandas(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((cells.i.max() + 1, cells.j.max() + 1)) if len(cells) else np.zeros((0, 0))
    out[cells.i, cells.j] = cells.x
    return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def class_means(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(labels, means) of rows (v, label)."""
    cells = rows.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    size = rows.agg(F.count_distinct("label").alias("k"), F.max(F.size("v")).alias("d")).first()
    if (size.k or 0) * (size.d or 0) > LARGEST:
        raise ValueError(f"{size.k} classes of {size.d} dimensions are too many prototypes")
    wide = cells.toPandas().pivot(index="label", columns="pos", values="m").sort_index()
    return wide.index.to_numpy(), wide.to_numpy()


def learn_vectors(rows: DataFrame, epochs: int = 10, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(labels, prototypes): one prototype per class, moved to lessen the relative distance of good and bad prototypes.

    Rows (v, label) with a null part take no part. An epoch's step is the mean gradient times `rate`, which falls
    with the epoch.
    """
    rows = rows.where("v is not null and label is not null")
    labels, w = class_means(rows)
    if len(labels) < 2:
        return labels, w
    for epoch in range(epochs):

        def step(pdf: pd.DataFrame, w: np.ndarray = w) -> np.ndarray:
            x, own = _matrix(pdf.v), np.searchsorted(labels, pdf.label.to_numpy())
            d = ((x[:, None, :] - w[None]) ** 2).sum(axis=2)
            at = np.arange(len(x))
            good = d[at, own]
            d[at, own] = np.inf
            foe = d.argmin(axis=1)
            bad = d[at, foe]
            scale = np.maximum((good + bad) ** 2, 1e-300)
            move = np.zeros((len(w), x.shape[1] + 1))
            np.add.at(move[:, :-1], own, (bad / scale)[:, None] * (x - w[own]))
            np.add.at(move[:, :-1], foe, -(good / scale)[:, None] * (x - w[foe]))
            np.add.at(move[:, -1], own, 1.0)
            return move

        moved = _sums(rows, ["v", "label"], step)
        spread = np.abs(w - w.mean(axis=0)).mean() ** 2
        w = w + rate / (1 + epoch) * spread * len(labels) * moved[:, :-1] / max(1.0, moved[:, -1].sum())
    return labels, w


def neural_gas(rows: DataFrame, start: np.ndarray, epochs: int = 10, first: float = 2.0, last: float = 0.1) -> np.ndarray:
    """Prototypes from `start`: each becomes the mean of rows (v) weighted by exp(-rank / range), with a falling range."""
    w = np.asarray(start, dtype=float)
    if w.size > LARGEST:
        raise ValueError(f"{w.shape} is too large a set of prototypes")
    rows = rows.where("v is not null")
    for epoch in range(epochs):
        reach = first * (last / first) ** (epoch / max(1, epochs - 1))

        def step(pdf: pd.DataFrame, w: np.ndarray = w, reach: float = reach) -> np.ndarray:
            x = _matrix(pdf.v)
            d = ((x[:, None, :] - w[None]) ** 2).sum(axis=2)
            h = np.exp(-d.argsort(axis=1, kind="stable").argsort(axis=1) / reach)
            return np.hstack([h.T @ x, h.sum(axis=0)[:, None]])

        total = _sums(rows, ["v"], step)
        if total.size:
            w = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1e-300), w)
    return w


def classify(rows: DataFrame, labels: np.ndarray, prototypes: np.ndarray, projection: np.ndarray | None = None) -> DataFrame:
    """Rows (id, v) with the label of the nearest prototype, behind a projection if one is given: (id, predicted)."""
    seen = (lambda x: x) if projection is None else (lambda x: x @ projection.T)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = (seen(_matrix(pdf.v)[:, None, :] - prototypes[None]) ** 2).sum(axis=2).argmin(axis=1)
                yield pd.DataFrame({"id": pdf.id, "predicted": labels[near]})

    return rows.where("v is not null").select("id", "v").mapInPandas(run, "id long, predicted long")


def separable_share(spark: SparkSession, sizes: list[tuple[int, int]], trials: int, epochs: int, seed: int) -> DataFrame:
    """(p, n, trials, share, epochs): of random labellings of p normal points in n dimensions, how many a perceptron separates.

    Every trial is a row of its own, drawn from its own seed, so trials spread over the executors; epochs is the
    mean number that the separated ones took.
    """
    rows = [(p, n, t, seed * 1_000_003 + i * 10_007 + t) for i, (p, n) in enumerate(sizes) for t in range(trials)]

    def run(batches):
        for pdf in batches:
            taken = []
            for p, n, own in zip(pdf["p"], pdf["n"], pdf["seed"], strict=True):
                rng = np.random.default_rng(own)
                x = rng.normal(size=(p, n)) * rng.choice([-1.0, 1.0], size=(p, 1))  # points times labels: all must be on one side
                w, done = np.zeros(n), 0
                for epoch in range(1, epochs + 1):
                    wrong = 0
                    for v in x:
                        if v @ w <= 0:
                            w, wrong = w + v, wrong + 1
                    if not wrong:
                        done = epoch
                        break
                taken.append(done)
            yield pdf[["p", "n"]].assign(taken=taken)

    out = spark.createDataFrame(rows, "p int, n int, t int, seed long").repartition("p", "t").mapInPandas(run, "p int, n int, taken int")
    good = F.col("taken") > 0
    return out.groupBy("p", "n").agg(F.count("*").alias("trials"), F.round(F.avg(good.cast("double")), 6).alias("share"), F.round(F.avg(F.when(good, F.col("taken"))), 6).alias("epochs"))


def learn_projection(rows: DataFrame, epochs: int = 20, rate: float = 0.2, projection_rate: float = 0.5, bad_share: float = 1.0, dims: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, prototypes, projection): one prototype a class and a projection learned with them.

    Distances are measured behind the projection P (dims x dimensions), which starts with the first principal axes. For a
    row x with its nearest right prototype at squared distance dJ and its nearest wrong one at dK, muJ = 2 dK / (dJ^2 + dK^2)
    and muK = -2 dJ / (dJ^2 + dK^2); the right prototype moves by -2 muJ P'P(w - x), the wrong one by that with muK times
    bad_share, and P by -(2 muJ P(wJ - x)(wJ - x)' + 2 muK P(wK - x)(wK - x)'). An epoch sums both gradients over
    all rows at once, steps by their mean times a rate that falls with the epoch, and scales P back to unit norm.
    Rows (v, label) with a null part take no part.
    """
    rows = rows.where("v is not null and label is not null")
    labels, w = class_means(rows)
    if len(labels) < 2:
        return labels, w, np.eye(w.shape[1] if w.size else dims)[:dims]
    _, axes = principal_axes(rows, "v", dims)
    p = axes / np.linalg.norm(axes)
    for epoch in range(epochs):

        def step(pdf: pd.DataFrame, w: np.ndarray = w, p: np.ndarray = p) -> np.ndarray:
            return projection_gradient(_matrix(pdf.v), np.searchsorted(labels, pdf.label.to_numpy()), w, p, bad_share)

        total = _sums(rows, ["v", "label"], step)
        # A prototype's gradient is a projected length over a squared one; times the mean distance it is a length.
        scale = total[-1, 1] / max(1.0, total[-1, 0]) / np.linalg.norm(p, 2) ** 2
        w = w - rate / (1 + epoch) * len(labels) * scale * total[: len(w)] / max(1.0, total[-1, 0])
        move = total[len(w) : -1]
        p = p - projection_rate / (1 + epoch) * move / max(1e-300, np.linalg.norm(move)) if move.any() else p
        p = p / np.linalg.norm(p)
    return labels, w, p


def projection_gradient(x: np.ndarray, own: np.ndarray, w: np.ndarray, p: np.ndarray, bad_share: float = 1.0) -> np.ndarray:
    """The summed gradients of rows x: prototypes, then the projection, then the number of rows and their distances to the right prototype."""
    at = np.arange(len(x))
    d = (((x[:, None, :] - w[None]) @ p.T) ** 2).sum(axis=2)
    good = d[at, own]
    d[at, own] = np.inf
    foe = d.argmin(axis=1)
    bad = d[at, foe]
    below = np.maximum(good**2 + bad**2, 1e-300)
    mu_j, mu_k = 2 * bad / below, -2 * good / below
    v_j, v_k = w[own] - x, w[foe] - x
    out = np.zeros((len(w) + len(p) + 1, x.shape[1]))
    np.add.at(out, own, (2 * mu_j)[:, None] * (v_j @ p.T @ p))
    np.add.at(out, foe, bad_share * (2 * mu_k)[:, None] * (v_k @ p.T @ p))
    out[len(w) : -1] = ((2 * mu_j)[:, None] * (v_j @ p.T)).T @ v_j + ((2 * mu_k)[:, None] * (v_k @ p.T)).T @ v_k
    out[-1, :2] = len(x), good.sum()
    return out
