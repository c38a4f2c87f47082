"""Joins over intervals and instants: overlapping pairs, and the last row before another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.session import cut

#: Cells are counted for ends within this; what lies beyond counts as lying at it.
FAR = float(2**62)
#: The finest level: cells of 2^-20.
FINEST = -20


def _placed(df: DataFrame, lo: str, hi: str, side: str) -> DataFrame:
    """df with its ends as doubles and its level: the first at which a cell is as long as the interval."""
    a, b = (F.col(f"`{c}`").cast("double") for c in (lo, hi))
    rows = df.withColumn(f"_{side}_lo", a).withColumn(f"_{side}_hi", b)
    a, b = F.col(f"_{side}_lo"), F.col(f"_{side}_hi")
    length = F.least(b, F.lit(FAR)) - F.greatest(a, F.lit(-FAR))
    level = F.when(length <= 2.0**FINEST, FINEST).otherwise(F.ceil(F.log2(length)).cast("int"))
    return rows.where(~F.isnan(a) & ~F.isnan(b) & (a <= b)).withColumn(f"_{side}_level", level)


def _cell(x: Column, level: Column) -> Column:
    return F.floor(F.greatest(F.least(x, F.lit(FAR)), F.lit(-FAR)) / F.pow(F.lit(2.0), level))


def _levels(df: DataFrame, side: str) -> list[int]:
    """The levels in use: at most one for each power of two."""
    return sorted(r[0] for r in df.select(f"_{side}_level").distinct().collect())


def _cells(df: DataFrame, side: str, levels: list[int]) -> DataFrame:
    """A row for each cell that an interval touches, on its own level and on the given coarser ones."""
    own = F.col(f"_{side}_level")
    every = F.array_distinct(F.concat(F.array(own), F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > own)))
    at = df.withColumn("_level", F.explode(every))
    return at.withColumn("_cell", F.explode(F.sequence(_cell(F.col(f"_{side}_lo"), F.col("_level")), _cell(F.col(f"_{side}_hi"), F.col("_level")))))


def interval_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """All pairs of rows whose closed intervals share a point, with the columns of both, which must differ in name.

    An interval lies on the level whose cells are as long as itself, so it touches two of them, or the few that
    rounding adds. It is also entered on the coarser levels that the other side uses. A pair meets on the coarser of
    its two levels, so one of them is at home there; of the cells there that both touch, the one that holds the later
    start owns it: each pair is made once, by an equi-join, whatever the lengths. Cells with many intervals are split
    as skewed keys.

    Rows with a null or NaN end, or a start after the end, overlap nothing; infinite ends are allowed.
    """
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have columns {sorted(clash)}")
    a, b = _placed(left, *left_ends, "a"), _placed(right, *right_ends, "b")
    x, y = _cells(a, "a", _levels(b, "b")), _cells(b, "b", _levels(a, "a"))
    owner = _cell(F.greatest("_a_lo", "_b_lo"), F.col("_level")) == F.col("_cell")
    both = _met(x, y).where(owner & (F.col("_a_lo") <= F.col("_b_hi")) & (F.col("_b_lo") <= F.col("_a_hi")))
    return both.select(*[F.col(f"`{c}`") for c in (*left.columns, *right.columns)])


def _met(x: DataFrame, y: DataFrame) -> DataFrame:
    """The rows of _cells that meet in a cell of the coarser of their levels; guests never meet guests."""
    home, guest = (lambda side: F.col(f"_{side}_level") == F.col("_level")), (lambda side: F.col(f"_{side}_level") < F.col("_level"))
    return x.where(home("a")).join(y, ["_level", "_cell"]).union(x.where(guest("a")).join(y.where(home("b")), ["_level", "_cell"]))


#: Of overlapping(): pairs looked at by a cell, and by a task, at about.
CELL, TASK = 1 << 22, 1 << 21


def overlapping(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    """(one, two): each two of the rows whose closed intervals share a point, once, as structs of their columns.

    `one` starts first, or at the same place. Starts are numbered in their order, so those within an interval are a run of
    numbers: from the one after its own to the last that is not beyond its end. Runs are cut at blocks of the
    numbers, about a quarter of a mean run long, and meet the starts of each block by an equi-join: hardly more pairs are
    looked at than come out. A block in many runs is split into cells, and tasks are as many as the pairs need.

    Rows with a null or NaN end, or a start after the end, overlap nothing; infinite ends are allowed.
    """
    sound = F.col(f"`{lo}`") <= F.col(f"`{hi}`")
    for c, kind in rows.dtypes:
        sound = sound & ~F.isnan(f"`{c}`") if c in (lo, hi) and kind in ("float", "double") else sound
    plain = lambda c: F.col(f"`{c}`") + F.lit(0.0) if dict(rows.dtypes)[c] in ("float", "double") else F.col(f"`{c}`")  # noqa: E731  -0.0 is 0.0
    given = cut(rows.where(sound).select(F.monotonically_increasing_id().alias("id"), plain(lo).alias("lo"), plain(hi).alias("hi"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")))
    starts = given.select("id", F.col("lo").alias("at"), F.lit(1).cast("long").alias("start"), "row")
    order = ["at", F.col("start").desc(), "id"]
    dealt = cut(starts.union(given.select("id", "hi", F.lit(0).cast("long"), F.lit(None).cast(starts.schema["row"].dataType))).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offset = dealt.groupBy("part").agg(F.sum("start").alias("starts")).select("part", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.join(F.broadcast(offset), "part").select("id", "row", "start", (F.col("offset") + F.coalesce(F.sum("start").over(inside), F.lit(0))).alias("n"))
    runs = cut(ranked.groupBy("id").agg(F.first("row", ignorenulls=True).alias("row"), F.min(F.when(F.col("start") == 1, F.col("n"))).alias("own"), F.min(F.when(F.col("start") == 0, F.col("n"))).alias("end")))
    n, pairs = runs.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("own") - 1), F.lit(0))).first()
    block = 1 << max(4, min(12, (pairs // (4 * max(n, 1))).bit_length()))

    at = lambda x: F.floor(x / block)
    parts = runs.where("end > own + 1").select("id", "row", "own", "end", F.explode(F.sequence(at(F.col("own") + 1), at(F.col("end") - 1))).alias("block"))
    busy = cut(parts.groupBy("block").agg(F.count("*").alias("runs")))
    looked = block * (busy.agg(F.sum("runs")).first()[0] or 0)
    cells = F.broadcast(busy.where(F.col("runs") > CELL // block).select("block", F.ceil(F.col("runs") * block / CELL).alias("cells")))  # few: each has many runs
    split = lambda df: df.join(cells, "block", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    tasks = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-looked // TASK))
    first = split(parts).select("block", F.pmod(F.xxhash64("id"), "cells").alias("cell"), "own", "end", F.col("row").alias("one")).repartition(tasks, "block", "cell")
    second = split(runs.select(at(F.col("own")).alias("block"), F.col("own").alias("start"), F.col("row").alias("two")))
    second = second.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), "start", "two").repartition(tasks, "block", "cell")
    return first.join(second, ["block", "cell"]).where("start > own and start < end").select("one", "two")


def sessions(events: DataFrame, key: str, at: str, gap: Column) -> DataFrame:
    """(key, session, start, end, n): runs of a key's rows with at most `gap` between one and the next."""
    order = Window.partitionBy(key).orderBy(at)
    first = F.coalesce((F.col(at) - F.lag(at).over(order) > gap), F.lit(True))
    numbered = events.where(F.col(at).isNotNull()).withColumn("session", F.sum(first.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, strict: bool = False) -> DataFrame:
    """Each left row with `before`: the key's last right row up to its instant, as a struct, or null.

    Both sides have the columns `key`, `at` and `tie`, which orders rows of one instant; a right row at the left row's
    own instant counts unless `strict`. Both are merged and dealt into ranges of (key, instant), so a key with many
    rows takes many ranges. Within a range the last right row is filled forward; over ranges only each one's last
    right row of a key travels on. No key's rows are gathered, and a left row meets one row, not the key's.

    Left rows with a null key or instant have nothing before them; such right rows stand before nothing. Repeated
    left rows come back as often as given.
    """
    seen = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    rows = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0 if strict else 2).alias("_side"), F.lit(None).alias("_tie").cast(right.schema[tie].dataType), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), F.lit(None).cast(right.select(seen.alias("x")).schema["x"].dataType).alias("_seen"))
    given = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), seen.alias("_seen"))
    whole = rows.where(F.col("_key").isNotNull() & F.col("_at").isNotNull())
    order = [F.col(c) for c in ("_key", "_at", "_side", "_tie")]
    dealt = cut(whole.union(given).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", "_key").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumn("_last", F.last("_seen", ignorenulls=True).over(inside)).where("_side <> 1")
    ends = dealt.where("_side = 1").groupBy("_key", "_part").agg(F.max_by("_seen", F.struct("_at", "_side", "_tie")).alias("_end"))
    # One row a range in which the key has any; a range without right rows of the key takes the last one before it.
    ranges = dealt.select("_key", "_part").distinct().join(ends, ["_key", "_part"], "left")
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).select("_key", "_part", "_carried")
    found = filled.join(carried, ["_key", "_part"], "left").select("_row", F.coalesce("_last", "_carried").alias("before"))
    lone = rows.where(F.col("_key").isNull() | F.col("_at").isNull()).select("_row", F.col("_seen").alias("before"))
    return found.union(lone).select("_row.*", "before")
