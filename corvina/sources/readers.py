"""Readers of semi-structured files as DataFrames."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """One row per element `row_tag`; attributes become columns named with an underscore."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, no, line): the lines of each file, numbered from 0; a line ends with LF or CR LF.

    A file is read in as many byte ranges as Spark cuts it into, each by a task of its own; `block` is where a
    line's range starts. A line's number is its place in its range and the lines of the ranges before, so no file
    is gathered, whatever the size of the ranges.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    raw = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r$", "").alias("line"))
    local = raw.withColumn("_no", F.row_number().over(Window.partitionBy("path", "block").orderBy("_at")) - 1)
    sizes = local.groupBy("path", "block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))  # one row a range
    return local.join(starts, ["path", "block"]).select("path", "block", (F.col("_no") + F.col("_start")).cast("int").alias("no"), "line")


def last_before(lines: DataFrame, value: Column, name: str, itself: bool = False) -> DataFrame:
    """lines with the last value that is not null of the lines before each, or up to itself, in its file.

    The last value is filled forward within a range; of each range only its own last value travels on to the next.
    """
    held = lines.withColumn("_value", value)
    inside = Window.partitionBy("path", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    ends = held.groupBy("path", "block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("no"))).alias("_end"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("path", "block", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    filled = held.withColumn("_last", F.last("_value", ignorenulls=True).over(inside)).join(carried, ["path", "block"])
    return filled.withColumn(name, F.coalesce("_last", "_carried")).drop("_value", "_last", "_carried")


def read_m3u(spark: SparkSession, path: str) -> DataFrame:
    """(path, no, uri, length, label): an #EXTINF line describes the next path; comments and blanks are skipped."""
    told = last_before(read_lines(spark, path).where(F.trim("line") != ""), F.col("line"), "info").where(~F.startswith("line", F.lit("#")))
    pattern = r"^#EXTINF:\s*(-?[0-9]+)\s*,(.*)$"
    hit = F.col("info").rlike(pattern)
    return told.select(
        "path", "no", F.col("line").alias("uri"), F.when(hit, F.regexp_extract("info", pattern, 1).cast("int")).alias("length"), F.when(hit, F.regexp_extract("info", pattern, 2)).alias("label")
    )


def read_vectors(spark: SparkSession, path: str, separator: str = ",", label: str = "last") -> DataFrame:
    """(label, v) from delimited numbers with the label in the first or last column; ragged rows are an error."""
    cells = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), separator).alias("c"))
    width = cells.agg(F.max(F.size("c"))).first()[0] or 0
    sound = F.assert_true(F.size("c") == width, F.lit("rows differ in width"))
    tagged, rest = (F.element_at("c", -1), F.slice("c", 1, max(0, width - 1))) if label == "last" else (F.element_at("c", 1), F.slice("c", 2, max(0, width - 1)))
    return cells.select(sound.alias("_ok"), tagged.cast("int").alias("label"), F.transform(rest, lambda x: x.cast("double")).alias("v")).where("_ok IS NULL").drop("_ok")


def read_xpath(spark: SparkSession, path: str, expression: str) -> DataFrame:
    """(path, pos, value): what an XPath expression selects from each XML file, in order; a document is one value."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.xpath("value", F.lit(expression))).alias("pos", "value"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(strand, position, read) from tab-separated lines; a malformed line fails the read."""
    return spark.read.csv(path, sep="\t", schema="strand string, position long, read string", mode="FAILFAST")


def pile_up(alignments: DataFrame) -> DataFrame:
    """Base counts per strand and position."""
    bases = alignments.select("strand", "position", F.posexplode(F.split("read", "")).alias("i", "base")).where("base <> ''")
    return bases.groupBy("strand", (F.col("position") + F.col("i")).alias("position")).pivot("base", ["A", "C", "G", "T"]).count().na.fill(0)


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, name, at, line): sequence lines in upper case with their section and the place where they start in it.

    A header line starts a section, which `section` names by its line number; lines before the first header are left
    out. Sections are never gathered: a line's place is the length of the lines before it, counted by ranges.
    """
    head = F.when(F.startswith("line", F.lit(">")), F.struct(F.col("no").alias("section"), F.expr("substring(line, 2)").alias("name")))
    told = last_before(read_lines(spark, path), head, "_head", itself=True).where("_head is not null and not startswith(line, '>')")
    lines = told.select("path", "block", F.col("_head.section").alias("section"), F.col("_head.name").alias("name"), "no", F.upper("line").alias("line"))
    keys = ["path", "section"]
    own = F.coalesce(F.sum(F.length("line")).over(Window.partitionBy(*keys, "block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = lines.groupBy(*keys, "block").agg(F.sum(F.length("line")).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return lines.withColumn("_own", own).join(starts, [*keys, "block"]).select("path", "section", "name", (F.col("_start") + F.col("_own")).alias("at"), "line")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, sequence): each section's lines joined in order; a sequence is one value."""
    lines = read_lines(spark, path)
    heads = lines.where(F.startswith("line", F.lit(">"))).select("path", F.col("no").alias("section"), F.expr("substring(line, 2)").alias("name"))
    whole = read_fasta_lines(spark, path).groupBy("path", "section").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("x"))
    return heads.join(whole, ["path", "section"], "left").select("path", "name", F.coalesce(F.array_join("x.line", ""), F.lit("")).alias("sequence"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """(path, rank, gram, n) of language-model files: one `gram<TAB>count` per line, ranked by line."""
    lines = read_lines(spark, path).where("line <> ''")
    return lines.select("path", F.col("no").alias("rank"), F.split("line", "\t")[0].alias("gram"), F.split("line", "\t")[1].cast("long").alias("n"))


# Fixed values of the IDX format: the third byte names the type of an element.
IDX_TYPES = {8: ">u1", 9: ">i1", 11: ">i2", 12: ">i4", 13: ">f4", 14: ">f8"}


def read_idx(spark: SparkSession, path: str, rows_per_batch: int = 10_000) -> DataFrame:
    """(path, pos, v) from IDX files, gzipped or not: one flat vector per item of the first dimension.

    A file is one task, as gzip cannot be split; its items leave in batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                kind, sizes = np.dtype(IDX_TYPES[raw[2]]), np.frombuffer(raw, ">u4", count=raw[3], offset=4).astype(int)
                items = np.frombuffer(raw, kind, count=int(sizes.prod()), offset=4 + 4 * raw[3]).reshape(sizes[0], -1)
                for at in range(0, len(items), rows_per_batch):
                    part = items[at : at + rows_per_batch].astype(float)
                    yield pd.DataFrame({"path": name, "pos": np.arange(at, at + len(part)), "v": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, pos long, v array<double>")


def read_column_lists(spark: SparkSession, path: str, language: str) -> DataFrame:
    """(path, set, card) of ragged comma-separated files whose columns are lists under a set and a language.

    Blank cells at the end of a column are left out; others stay. A row that ends before a column has no cell in it.
    """
    cells = read_lines(spark, path).select("path", "no", F.posexplode(F.split("line", ",")).alias("col", "cell"))
    column = Window.partitionBy("path", "col")
    head = lambda n: F.max(F.when(F.col("no") == n, F.col("cell"))).over(column)
    last = F.max(F.when(F.trim("cell") != "", F.col("no"))).over(column)
    told = cells.select("path", "no", "cell", head(0).alias("set"), head(1).alias("language"), last.alias("last"))
    return told.where((F.col("language") == language) & F.col("no").between(2, F.col("last"))).select("path", "set", F.col("cell").alias("card"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of all files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
