"""Writers of the same formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_m3u(rows: DataFrame, path: str, order: str) -> None:
    """An extended playlist from (uri, length, label); a playlist is one ordered file."""
    entry = F.concat(F.lit("#EXTINF:"), F.col("length").cast("string"), F.lit(","), F.col("label"), F.lit("\n"), F.col("uri"))
    head = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("o"), F.lit("#EXTM3U").alias("value"))
    body = rows.select(F.col(order).cast("long").alias("o"), entry.alias("value"))
    head.union(body).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def write_xml(rows: DataFrame, path: str, row_tag: str, attributes: list[str]) -> None:
    """Rows as elements with attributes; nulls and zeros are left out."""
    kinds = dict(rows.dtypes)
    columns = [(F.nullif(F.col(c), F.lit(0)) if kinds[c] in ("int", "bigint", "double") else F.col(c)).alias(f"_{c}") for c in attributes]
    rows.select(*columns).write.mode("overwrite").format("xml").option("rowTag", row_tag).save(path)


def json_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON objects in `value`; null fields are left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    json_lines(rows).write.mode("overwrite").text(path)


def count_blocks(rows: DataFrame, position: str, strand: str, symbol: str, symbols: list[str]) -> DataFrame:
    """Per position the counts of each symbol on the forward strand, then on the reverse one: f_A, ..., r_A, ..."""
    count = lambda s, x: F.sum(((F.col(strand) == s) & (F.col(symbol) == x)).cast("long"))
    blocks = [F.coalesce(count(s, x), F.lit(0)).alias(f"{name}_{x}") for name, s in (("f", "+"), ("r", "-")) for x in symbols]
    return rows.groupBy(position).agg(*blocks)


def write_count_blocks(rows: DataFrame, path: str, position: str, strand: str, symbol: str, symbols: list[str]) -> None:
    """count_blocks as CSV with a header that names both blocks, ordered by position."""
    count_blocks(rows, position, strand, symbol, symbols).orderBy(position).write.mode("overwrite").csv(path, header=True)
