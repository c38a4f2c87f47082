"""Interval, session and as-of joins against plain loops, on ends of every kind and with a hot key."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvina.operators import intervals


def overlaps(a, b):
    ok = lambda lo, hi: lo is not None and hi is not None and not math.isnan(lo) and not math.isnan(hi) and lo <= hi
    return {(i, j) for i, lo, hi in a if ok(lo, hi) for j, lo2, hi2 in b if ok(lo2, hi2) and lo <= hi2 and lo2 <= hi}


def pairs(spark, a, b):
    left = spark.createDataFrame(a, "i long, lo double, hi double")
    right = spark.createDataFrame(b, "j long, lo2 double, hi2 double")
    joined = intervals.interval_join(left, right, ("lo", "hi"), ("lo2", "hi2"))
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = [(r.i, r.j) for r in joined.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_overlaps_of_all_lengths(spark):
    rng = random.Random(5)

    def some(n):
        out = []
        for i in range(n):
            lo = rng.choice([rng.uniform(-1000, 1000), float(rng.randint(-50, 50)), -0.0])
            out.append((i, lo, lo + rng.choice([0.0, 1e-9, 0.5, 1.0, 2.0, rng.expovariate(0.01), 1e6])))
        return out

    a, b = some(150), some(150)
    assert pairs(spark, a, b) == overlaps(a, b)


def test_overlaps_of_odd_ends(spark):
    inf, nan = math.inf, math.nan
    a = [(0, None, 1.0), (1, 0.0, None), (2, nan, 1.0), (3, 0.0, nan), (4, 2.0, 1.0), (5, -inf, inf), (6, -inf, 0.0), (7, 0.0, 0.0), (8, 1e300, inf), (9, 4.0, 4.0), (9, 4.0, 4.0)]
    b = [(0, 0.0, 0.0), (1, -inf, -5.0), (2, 5.0, inf), (3, None, None), (4, nan, nan), (5, 4.0, 9.0), (6, 1e301, 1e302)]
    left = [x for x in a if x[0] != 9]
    assert pairs(spark, left, b) == overlaps(left, b)
    twice = intervals.interval_join(spark.createDataFrame(a, "i long, lo double, hi double").where("i = 9"), spark.createDataFrame(b, "j long, lo2 double, hi2 double"), ("lo", "hi"), ("lo2", "hi2"))
    assert sorted(r.j for r in twice.collect()) == [5, 5]
    none = spark.createDataFrame([], "j long, lo2 double, hi2 double")
    assert intervals.interval_join(spark.createDataFrame(a, "i long, lo double, hi double"), none, ("lo", "hi"), ("lo2", "hi2")).count() == 0
    with pytest.raises(ValueError):
        intervals.interval_join(none, none, ("lo2", "hi2"), ("lo2", "hi2"))


def test_long_interval_makes_few_cells(spark):
    """One interval over a million short ones' span touches a few cells of its own level, not theirs."""
    a = spark.createDataFrame([(0, 0.0, 1e9)], "i long, lo double, hi double")
    cells = intervals._cells(intervals._placed(a, "lo", "hi", "a"), "a", [-20, 0, 30])
    assert cells.count() <= 4


def test_guests_of_a_level_do_not_meet(spark):
    """Points under one long interval meet that interval on its level, not each other."""
    a = spark.createDataFrame([(i, float(i), float(i)) for i in range(300)] + [(300, 0.0, 500.0)], "i long, lo double, hi double")
    b = a.select(F.col("i").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    x, y = (intervals._cells(intervals._placed(df, lo, hi, side), side, [-20, 9]) for df, lo, hi, side in ((a, "lo", "hi", "a"), (b, "lo2", "hi2", "b")))
    assert intervals._met(x, y).count() <= 2_000
    assert intervals.interval_join(a, b, ("lo", "hi"), ("lo2", "hi2")).count() == 300 + 2 * 300 + 1


def each_two(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"i long, lo {kind}, hi {kind}")
    found = [(r.one.i, r.two.i) for r in intervals.overlapping(df, "lo", "hi").collect()]
    assert len(found) == len({frozenset(p) for p in found})
    return {frozenset(p) for p in found}


def test_each_two_that_overlap(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        lo = rng.choice([rng.uniform(-1000, 1000), float(rng.randint(-50, 50)), -0.0, 0.0])
        rows.append((i, lo, lo + rng.choice([0.0, 1e-9, 0.5, 2.0, rng.expovariate(0.01), 1e6])))
    inf, nan = math.inf, math.nan
    odd = [(None, 1.0), (0.0, None), (nan, 1.0), (0.0, nan), (nan, nan), (2.0, 1.0), (-inf, inf), (-inf, 0.0), (inf, inf), (1e300, inf)]
    rows += [(400 + i, lo, hi) for i, (lo, hi) in enumerate(odd)]
    want = {frozenset((i, j)) for i, j in overlaps(rows, rows) if i != j}
    assert each_two(spark, rows) == want
    monkeypatch.setattr(intervals, "CELL", 256)  # busy blocks are split
    assert each_two(spark, rows) == want
    assert each_two(spark, []) == set() and each_two(spark, [(1, 0.0, 0.0)]) == set()


def test_each_two_of_large_whole_numbers(spark):
    """Ends are compared as they are, not as doubles."""
    top = 2**62
    assert each_two(spark, [(0, top, top + 1), (1, top + 2, top + 3), (2, top + 3, top + 9), (3, top - 5, top)], "long") == {frozenset((1, 2)), frozenset((0, 3))}


def test_repeated_rows_overlap(spark):
    df = spark.createDataFrame([(1, 0, 5)] * 3 + [(2, 5, 5)], "i int, lo int, hi int")
    assert sorted(sorted((r.one.i, r.two.i)) for r in intervals.overlapping(df, "lo", "hi").collect()) == [[1, 1]] * 3 + [[1, 2]] * 3


def test_sessions(spark):
    rows = [(1, 0), (1, 10), (1, 21), (1, 21), (2, 5), (2, None), (None, 3)]
    found = intervals.sessions(spark.createDataFrame(rows, "u int, t int"), "u", "t", F.lit(10))
    got = {(r.u, r.start, r.end, r.n) for r in found.collect()}
    assert got == {(1, 0, 10, 2), (1, 21, 21, 2), (2, 5, 5, 1), (None, 3, 3, 1)}


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    rng = random.Random(7)
    key = lambda: rng.choice([0, 0, 0, 1, 2, None])  # noqa: E731  key 0 holds half of the rows
    left = [(key(), rng.choice([None, *range(60)]), i) for i in range(300)] + [(0, 30, 999), (0, 30, 999)]
    right = [(key(), rng.choice([None, *range(60)]), 1000 + i, f"v{i}") for i in range(120)]
    found = intervals.as_of_join(spark.createDataFrame(left, "k int, t int, id int"), spark.createDataFrame(right, "k int, t int, id int, v string"), "k", "t", "id", strict)
    got = sorted(((r.k, r.t, r.id, r.before.v if r.before else None) for r in found.collect()), key=repr)
    want = []
    for k, t, i in left:
        past = [(u, j, v) for q, u, j, v in right if q is not None and q == k and u is not None and t is not None and (u < t or (u == t and not strict))]
        want.append((k, t, i, max(past)[2] if past else None))
    assert got == sorted(want, key=repr)


def test_as_of_without_rows(spark):
    left = spark.createDataFrame([(1, 5, 1)], "k int, t int, id int")
    none = spark.createDataFrame([], "k int, t int, id int")
    assert [r.before for r in intervals.as_of_join(left, none, "k", "t", "id").collect()] == [None]
    assert intervals.as_of_join(none, left, "k", "t", "id").count() == 0


def test_overlap_query_makes_each_pair_once(spark, tmp_path):
    """Every two of 600 users overlap: a cell's rows are not met on both sides and then thrown away."""
    from corvina.plans import QUERIES

    spark.createDataFrame([(u + 600 * k, u) for k in (0, 1) for u in range(600)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["jn13_overlap"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().toString()
    assert "_level" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    got = [(r.user_id, r.other) for r in found.collect()]
    assert len(got) == 600 * 599 // 2 and set(got) == {(i, j) for i in range(600) for j in range(i + 1, 600)}
