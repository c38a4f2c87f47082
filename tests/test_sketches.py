"""Sketches of weeks, merged from days, against exact counts and quantiles of the rows."""

import bisect
from collections import defaultdict

from pyspark.sql import functions as F

from corvina.operators import sketches
from corvina.plans.deeper import QUERIES


def test_weeks_within_bounds(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("day"), "event_type", "user_id", "value").collect():
        rows[r.event_type].append(r)
    got = QUERIES["ag31_weekly_sketches"](spark, sf_dir).collect()
    assert len(got) == len({(k, r.day) for k, own in rows.items() for r in own})
    for g in got:
        week = [r for r in rows[g.event_type] if 0 <= (g.day - r.day).days < 7]
        users, values = len({r.user_id for r in week}), sorted(r.value for r in week)
        assert g.rows == len(week) and abs(g.distinct - users) <= max(1, 4 * sketches.distinct_error() * users)
        for share, q in zip((0.25, 0.5, 0.75), g.q, strict=True):
            place = (bisect.bisect_left(values, q) / len(values), bisect.bisect_right(values, q) / len(values))
            assert place[0] - 0.03 <= share <= place[1] + 0.03  # 200 levels: 1.33 % of rank, with 99 % confidence


def test_merge_equals_one_sketch(spark):
    """Distinct counts do not depend on how rows are cut into days; sketches have a bounded size."""
    rows = spark.range(40_000).selectExpr("date_add(date '2024-01-01', cast(id % 5 as int)) as day", "id % 20011 as item", "cast(id as double) as value", "'k' as key")
    daily = sketches.daily_sketches(rows, "day", ["key"], "item", "value")
    last = {r.day.day: r for r in sketches.over_windows(daily, ["key"], 5, [0.5]).collect()}
    assert last[5].rows == 40_000 and abs(last[5].distinct / 20_011 - 1) < 4 * sketches.distinct_error() and abs(last[5].q[0] / 40_000 - 0.5) < 0.03
    assert last[1].rows == 8_000
    sizes = daily.agg(F.max(F.octet_length("items")), F.max(F.octet_length("values"))).first()
    assert sizes[0] < 10_000 and sizes[1] < 20_000


def test_nulls_and_gaps(spark):
    rows = spark.sql("select * from values (date '2024-01-01', 'a', 1, 2.0D), (date '2024-01-01', 'a', null, null), (date '2024-01-20', 'a', 1, 3.0D), (date '2024-01-20', null, 1, 3.0D) as t(day, key, item, value)")
    got = {(r.day.day, r.key): (r.rows, r.distinct) for r in sketches.over_windows(sketches.daily_sketches(rows, "day", ["key"], "item", "value"), ["key"], 7, [0.5]).collect() if r.key}
    assert got == {(1, "a"): (2, 1), (20, "a"): (1, 1)}
