"""Exact top-k search: tiled integer matrix products and a tree merge of per-query lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a candidate shard and of a query block; a task holds one of each.
SHARD, BLOCK = 32_768, 4_096
#: Candidates multiplied at once, and shards merged at once.
TILE, FAN_IN = 2_048, 16

HITS = "query_id long, shard int, vec_id long, score long"


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): v holds floor(scale * x) of each component, x as a double.

    Vectors that are null, empty, or hold a null or non-finite component are left out.
    """
    inf = F.lit(float("inf"))
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return plain.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(sound, F.lit(False))).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, ties to smaller ids (ids ascending along the columns)."""
    n = score.shape[1]
    if n > k:
        # The k-th best score is a bound that any kept entry reaches; of those equal to it the first ones stay.
        bound = np.partition(score, n - k, axis=1)[:, n - k : n - k + 1]
        above = score > bound
        at = score == bound
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (at & (np.cumsum(at, axis=1) <= room))
        col = np.nonzero(keep)[1].reshape(len(score), k)
        return np.take_along_axis(score, col, 1), ids[col] if ids.ndim == 1 else np.take_along_axis(ids, col, 1)
    return score, np.broadcast_to(ids, score.shape) if ids.ndim == 1 else ids


def _cell(k: int):
    """Top k of one query block against one candidate shard."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[1].as_py()
        empty = pa.table({"query_id": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not table.num_rows:
            return empty
        width = pc.list_value_length(table["v"])
        out = []
        for dim in pc.unique(width).to_pylist():  # vectors of other widths have no product
            part = table.filter(pc.equal(width, dim))
            q = part.filter(part["is_query"]).combine_chunks()
            c = part.filter(pc.invert(part["is_query"])).combine_chunks()
            if q.num_rows and c.num_rows:
                out.append(_product(q, c, shard, k))
        return pa.concat_tables(out) if out else empty

    return run


def _product(q: pa.Table, c: pa.Table, shard: int, k: int) -> pa.Table:
    qi, ci = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
    qm, cm = _matrix(q["v"].combine_chunks()), _matrix(c["v"].combine_chunks())
    order = np.argsort(ci, kind="stable")
    ci, cm = ci[order], cm[order]
    peak = float(np.abs(qm.astype(float)).max()) * float(np.abs(cm.astype(float)).max()) * qm.shape[1]
    if peak < 2**53:  # products and sums are exact as doubles
        qm, cm = qm.astype(np.float64), cm.astype(np.float64)
    low = np.iinfo(np.int64).min
    hits: tuple[np.ndarray, np.ndarray] | None = None
    for i in range(0, len(ci), TILE):
        score = (qm @ cm[i : i + TILE].T).astype(np.int64)
        ids = ci[i : i + TILE]
        # A query is no candidate of its own: such cells sink below every score, and keep id -1.
        same = qi[:, None] == ids[None, :]
        names = np.where(same, -1, ids[None, :])
        score[same] = low
        s, n = _best(score, names, k)
        if hits is not None:
            s, n = np.concatenate((hits[0], s), 1), np.concatenate((hits[1], n), 1)
            s, n = _best(s, n, k)
        hits = (s, n)
    s, n = hits
    real = s.ravel() != low
    return pa.table(
        {
            "query_id": pa.array(np.repeat(qi, s.shape[1])[real]),
            "shard": pa.array(np.full(int(real.sum()), shard, dtype=np.int32)),
            "vec_id": pa.array(n.ravel()[real]),
            "score": pa.array(s.ravel()[real]),
        }
    )


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Per query its k highest inner products: query_id, rank (from 1), vec_id, score.

    Both inputs are (vec_id, v) of integer vectors; a query is not its own candidate. Ties go to the
    smaller vec_id, and repeated candidate rows each count. Candidates are dealt by hash into
    shards of about `shard` vectors and queries into blocks of about `block`; each block meets each
    shard in one task, which multiplies tile by tile and keeps k per query, so no task or driver
    holds more than a block, a shard and a tile. The lists of the shards are merged FAN_IN at a time.
    """
    n_c, n_q = candidates.count(), queries.select("vec_id").distinct().count()
    shards, blocks = max(1, -(-n_c // shard)), max(1, -(-n_q // block))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    own_shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard")
    left = queries.dropDuplicates(["vec_id", "v"]).select("vec_id", "v", own_block).select("block", spread(shards, "shard"), F.lit(True).alias("is_query"), "vec_id", "v")
    right = candidates.select("vec_id", "v", own_shard).select(spread(blocks, "block"), "shard", F.lit(False).alias("is_query"), "vec_id", "v")
    hits = left.union(right).groupBy("block", "shard").applyInArrow(_cell(k), HITS)
    while shards > 1:
        shards = -(-shards // FAN_IN)
        hits = _first(hits.withColumn("shard", F.expr(f"shard div {FAN_IN}").cast("int")), k, ["query_id", "shard"]).drop("rank")
    return _first(hits, k, ["query_id"]).select("query_id", "rank", "vec_id", "score")


def _first(hits: DataFrame, k: int, keys: list[str]) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id"))
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
