"""Helpers of the training-data operators: shared storage and word hashing over Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent, a local session takes a temporary folder; on a cluster that would be a
    different disk on each machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _LOCAL:
        _LOCAL["path"] = "file://" + tempfile.mkdtemp(prefix="corvina-")
    return _LOCAL["path"]


_LOCAL: dict[str, str] = {}


class Scratch:
    """Tables of one computation in the shared folder. Writing one cuts its lineage and survives lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corvina-{uuid.uuid4().hex}"
        self.tables = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read back."""
        self.tables += 1
        path = f"{self.root}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Remove the tables; what is still to be read must have been written elsewhere."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write df to a table of its own in the shared folder and read it back."""
    return Scratch(df.sparkSession).keep(df)


#: Bytes of rows that go to a Python worker at once; a longer row goes alone.
BATCH = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to the session's Python workers by about BATCH bytes, not by Spark's 10,000 rows or 64 MB.

    The operators take texts one after the other or by CHUNK bytes, so a longer batch only costs memory: of the executor, where
    it is built and written, and of the worker. Which rows come, and how many, stays the same.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


#: Bits of a filter over ids: 4 MB, whatever the number of ids. With more ids more rows pass that need not.
FILTER_BITS = 1 << 25


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key), F.lit(bits)).cast("int")
    return F.shiftright(at, 6), at.bitwiseAND(63)


def bitmap(ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """A filter over the first column of ids: at most bits / 64 rows (word, bits), so it is safe to broadcast."""
    word, bit = _place(F.col(f"`{ids.columns[0]}`"), bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return ids.select(word.alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("word_bits"))


def flagged(df: DataFrame, column: str, table: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """df with `maybe`: false only where the column's value is surely not among the filter's ids."""
    word, bit = _place(F.col(f"`{column}`"), bits)
    hit = (word == table["word"]) & (F.call_function("bit_get", table["word_bits"], bit) == 1)
    return df.join(F.broadcast(table), hit, "left").select(*[df[f"`{c}`"] for c in df.columns], table["word"].isNotNull().alias("maybe"))


def possible(df: DataFrame, column: str, table: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of df whose value may be among the filter's ids; nothing is shuffled."""
    word, bit = _place(F.col(f"`{column}`"), bits)
    hit = (word == table["word"]) & (F.call_function("bit_get", table["word_bits"], bit) == 1)
    return df.join(F.broadcast(table), hit).select(*[df[f"`{c}`"] for c in df.columns])


# Word characters are everything but space, tab, LF, VT, FF and CR.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK + 1)
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Words of consecutive documents: byte starts and ends, the document's first word (n_docs + 1) and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, outside: np.ndarray = SPACE) -> None:
        base = int(offsets[0])
        data, off = data[base : int(offsets[-1])], (offsets - base).astype(np.int64)
        n = len(data)
        inside = ~outside[data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = off[(off > 0) & (off < n)]
            first[edge] = inside[edge]
            last[edge - 1] = inside[edge - 1]
        self.data = data
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.docs = np.searchsorted(self.starts, off)
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], out=total[1:])
        raw = (total[self.ends] - total[self.starts]) * down[self.starts]
        self.hashes = mix(raw + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off


def document_chunks(column: pa.Array, lower: bool, outside: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words), in pieces of about CHUNK bytes; a document stays whole."""
    if not len(column):
        return
    data, off = text_buffers(column)
    row = 0
    while row < len(off) - 1:
        end = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK, side="right")) - 1)
        end = min(end, len(off) - 1)
        yield row, end, Words(data, off[row : end + 1], lower, outside)
        row = end
