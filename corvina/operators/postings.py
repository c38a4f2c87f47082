"""Keyword search over canonical text: a stored table of grams, candidates by the rarest term, the other terms verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators.search import query_terms
from corvina.operators.text import canonical, canonicalise

#: Folders of the gram table and of the texts; a query reads those of its grams and candidates.
GRAM_FOLDERS, TEXT_FOLDERS = 64, 64
#: Parts that a folder is written in, so that many tasks write it.
PARTS = 16
#: Candidates up to which only the folders of their texts are read, and their ids are sent to every task.
FEW = 10_000


def canonical_text(columns: list[str]) -> Column:
    """The columns' values one a line, in canonical form; null reads as empty."""
    return canonicalise(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def canonical_terms(query: str) -> tuple[list[str], list[str]]:
    """The query's wanted and unwanted terms in canonical form; what has no canonical form asks for nothing."""
    return tuple([t for t in map(canonical, terms) if t] for terms in query_terms(query))


def holds(text: Column, wanted: list[str], unwanted: list[str]) -> Column:
    """Whether every wanted term, and no unwanted one, is a substring; long wanted terms and short unwanted ones first."""
    tests = [F.contains(text, F.lit(t)) for t in sorted(wanted, key=len, reverse=True)] + [~F.contains(text, F.lit(t)) for t in sorted(unwanted, key=len)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def grams(term: str) -> list[int]:
    """The distinct trigrams of a canonical text, which is ASCII, as numbers of three times seven bits."""
    return np.unique(_grams(np.frombuffer(term.encode("ascii"), dtype=np.uint8))).tolist()


def _grams(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.int32)
    return (x[:-2] << 14) | (x[1:-1] << 7) | x[2:]


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ids) of each batch of (id, canon): a row for each gram, with the ids of the batch's texts that hold it."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        held = [np.unique(_grams(np.frombuffer(t.as_buffer(), dtype=np.uint8))) for t in texts]
        flat = np.concatenate([np.zeros(0, dtype=np.int32), *held])
        row = np.repeat(np.arange(len(held)), [len(h) for h in held])
        order = np.argsort(flat, kind="stable")
        found, first = np.unique(flat[order], return_index=True)
        ids = batch.column(0).take(pa.array(row[order]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), ids)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), lists], ["gram", "ids"])


@dataclass
class Postings:
    """Tables under `path`: texts (id, canon), grams (gram, ids) and counts (gram, n)."""

    spark: SparkSession
    path: str
    id_type: str

    @classmethod
    def build(cls, rows: DataFrame, id_col: str, columns: list[str], path: str) -> Postings:
        """Write the tables for rows, whose ids are distinct and not null, over the canonical text of the columns.

        Each task inverts its batches of texts, so a gram has a row for each batch that holds it, and a gram that most
        texts hold has many rows of bounded length. A folder's rows are in order of gram.
        """
        spark = rows.sparkSession
        texts = rows.select(F.col(id_col).alias("id"), canonical_text(columns).alias("canon")).withColumn("folder", F.pmod(F.crc32(F.col("id").cast("string")), F.lit(TEXT_FOLDERS)).cast("int"))
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS))
        texts.repartition("folder", part("id")).sortWithinPartitions("folder", "id").write.partitionBy("folder").parquet(f"{path}/texts")
        made = cls(spark, path, dict(texts.dtypes)["id"])
        inverted = made.texts().where(F.length("canon") > 2).select("id", "canon").mapInArrow(_inverted, f"gram int, ids array<{made.id_type}>")
        placed = inverted.withColumn("folder", F.pmod("gram", F.lit(GRAM_FOLDERS)).cast("int"))
        placed.repartition("folder", part(F.element_at("ids", 1))).sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{path}/grams")
        made.grams().groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
        return made

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def texts(self) -> DataFrame:
        return self._read("texts", f"id {self.id_type}, canon string, folder int")

    def grams(self) -> DataFrame:
        return self._read("grams", f"gram int, ids array<{self.id_type}>, folder int")

    def counts(self, asked: list[int]) -> dict[int, int]:
        """How many rows hold each of the asked grams."""
        found = self._read("counts", "gram int, n long").where(F.col("gram").isin(asked)).collect()
        return {r["gram"]: r["n"] for r in found}

    def holders(self, term: str) -> DataFrame:
        """Ids of the rows that hold all grams of a term of three characters or more; only those grams are read."""
        asked = grams(term)
        folders = sorted({g % GRAM_FOLDERS for g in asked})
        rows = self.grams().where(F.col("folder").isin(folders) & F.col("gram").isin(asked)).select(F.explode("ids").alias("id"))
        return rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("id")

    def search(self, query: str) -> DataFrame:
        """Ids of the rows whose text holds every wanted and no unwanted term.

        The wanted term with the rarest gram gives the candidates; all terms are then looked for in the candidates'
        texts. Where no wanted term has three characters, all texts are looked through.
        """
        wanted, unwanted = canonical_terms(query)
        long_terms = [t for t in wanted if len(t) > 2]
        texts = self.texts()
        if long_terms:
            counts = self.counts(sorted({g for t in long_terms for g in grams(t)}))
            rarest = min(long_terms, key=lambda t: (min(counts.get(g, 0) for g in grams(t)), -len(t)))
            candidates = self.holders(rarest)
            if min(counts.get(g, 0) for g in grams(rarest)) <= FEW:  # at most so many candidates
                folders = [r[0] for r in candidates.select(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(TEXT_FOLDERS)).cast("int")).distinct().collect()]
                texts, candidates = texts.where(F.col("folder").isin(folders) if folders else F.lit(False)), F.broadcast(candidates)
            texts = texts.join(candidates, "id", "left_semi")
        return texts.where(holds(F.col("canon"), wanted, unwanted)).select("id")


def scan_search(rows: DataFrame, id_col: str, columns: list[str], query: str) -> DataFrame:
    """The same ids as Postings.search gives, from the rows themselves."""
    wanted, unwanted = canonical_terms(query)
    return rows.select(F.col(id_col).alias("id"), canonical_text(columns).alias("canon")).where(holds(F.col("canon"), wanted, unwanted)).select("id")
