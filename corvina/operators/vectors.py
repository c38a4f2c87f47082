"""Labelled vectors: nearest neighbours in blocks, and principal components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pca(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """Rows with `projected`: their first k principal components."""
    mean = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    centre = [r.m for r in mean.orderBy("pos").collect()]  # one number per dimension
    middle = F.array(*[F.lit(m) for m in centre])
    centred = rows.withColumn("_v", array_to_vector(F.zip_with(F.col(vector).cast("array<double>"), middle, lambda x, m: x - m)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(centred)
    return model.transform(centred).withColumn("projected", vector_to_array("_p")).drop("_v", "_p")


#: Rows of a block, at least and at most, and the columns that give a first bound.
LEAST_BLOCK, MOST_BLOCK, FIRST = 20_000, 131_072, 2_048


def _rough(m: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, slack): b @ a.T is squared distances less the length of q, within slack / 2 by row; in single precision where it can be."""
    most, lengths = (m * m).sum(axis=1).max(initial=0.0), (q * q).sum(axis=1)
    kind, digit = (np.float32, 2.4e-7) if max(most, lengths.max(initial=0.0)) < 1e30 else (np.float64, 4.5e-16)
    a = np.column_stack((-2 * m, (m * m).sum(axis=1))).astype(kind)
    return a, np.column_stack((q, np.ones(len(q)))).astype(kind), ((m.shape[1] + 9) * digit * (1e-30 + most + lengths)).astype(kind)


def _closest(m: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of m, squared distance) of the k rows of m nearest to each of q, ties to smaller ids."""
    a, b, slack = _rough(m, q)
    k, found = min(k, len(m)), []
    for i in range(0, len(q), 256):
        part = b[i : i + 256]
        # The k-th of the first columns bounds the k-th of all; what a product leaves below it is measured exactly.
        first = part @ a[:FIRST].T if len(m) > FIRST else part @ a.T
        at = min(k, first.shape[1]) - 1
        bound = np.partition(first, at, axis=1)[:, at] + slack[i : i + 256] if first.shape[1] >= k else np.full(len(part), np.inf)
        rows, cols = [], []
        for j in range(0, len(m), FIRST):
            r, c = np.divmod(np.flatnonzero((first if not j else part @ a[j : j + FIRST].T)[:, :FIRST] <= bound[:, None]), min(FIRST, len(m) - j))
            rows.append(r)
            cols.append(c + j)
        r, c = np.concatenate(rows), np.concatenate(cols)
        d = np.concatenate([((m[c[x : x + 16_384]] - q[i + r[x : x + 16_384]]) ** 2).sum(axis=1) for x in range(0, len(r), 16_384)]) if len(r) else np.zeros(0)
        order = np.lexsort((ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        found.append((r[place < k] + i, c[place < k], d[place < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(train: DataFrame, test: DataFrame, k: int = 1, block: int | None = None) -> DataFrame:
    """(test_id, rank, train_id, label, distance) of the k nearest rows of (id, v, label) by squared distance.

    Train and test rows are dealt into blocks; each pair of blocks meets in one task and leaves k rows per
    test row, which are then merged. Blocks grow with the rows up to MOST_BLOCK, as a row is sent once for each block of the other side.
    """
    n, asked = train.count(), test.count()
    block = block or max(LEAST_BLOCK, min(MOST_BLOCK, max(n, asked) // 5))
    a, b = max(1, math.ceil(n / block)), max(1, math.ceil(asked / block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = train.select("id", "v", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("id"), F.lit(a)).cast("int").alias("x"), spread(b).alias("y"), F.lit(True).alias("is_train"))
    right = test.select("id", "v", F.lit(None).cast("int").alias("label"), spread(a).alias("x"), F.pmod(F.xxhash64("id"), F.lit(b)).cast("int").alias("y"), F.lit(False).alias("is_train"))
    wanted = pa.schema([("test_id", pa.int64()), ("train_id", pa.int64()), ("label", pa.int32()), ("distance", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        tr, te = table.filter(table["is_train"]), table.filter(pc.invert(table["is_train"]))
        if not tr.num_rows or not te.num_rows:
            return wanted.empty_table()
        m, q = (x["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(x.num_rows, -1) for x in (tr, te))
        r, c, d = _closest(m, tr["id"].to_numpy(), q, k)
        c = pa.array(c)
        return pa.table([te["id"].take(pa.array(r)), tr["id"].take(c), tr["label"].take(c), pa.array(d)], schema=wanted)

    cells = left.union(right.select("id", "v", "label", "x", "y", "is_train"))
    tasks = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * a * b)
    hits = cells.repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(run, "test_id long, train_id long, label int, distance double")
    order = Window.partitionBy("test_id").orderBy("distance", "train_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("test_id", "rank", "train_id", "label", "distance")
