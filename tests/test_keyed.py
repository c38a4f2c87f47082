"""The keyed table: newest rows, untouched buckets, repeated and broken batches."""

import os

from corvina.streaming.keyed import KeyedTable

SCHEMA = "k long, ver long, v string"


def made(spark, tmp_path, buckets=8):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, "k", "ver", buckets)


def content(table):
    return sorted((r.k, r.ver, r.v) for r in table.read().collect())


def files(tmp_path):
    return {os.path.relpath(os.path.join(d, n), tmp_path): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(tmp_path / "t" / "rows") for n in names if n.endswith(".parquet")}


def test_only_changed_buckets(spark, tmp_path):
    table = made(spark, tmp_path)
    assert content(table) == []
    table.merge(spark.createDataFrame([(i, 1, f"a{i}") for i in range(40)], SCHEMA), 0)
    before, versions = files(tmp_path), table.versions()
    table.merge(spark.createDataFrame([(3, 2, "new"), (4, 0, "older"), (None, 9, "no key"), (5, None, "no version")], SCHEMA), 1)
    after = files(tmp_path)
    assert all(after[f] == t for f, t in before.items())  # nothing written before is touched
    changed = {b for b, v in table.versions().items() if v == 1}
    assert 1 <= len(changed) <= 3 and len(after) - len(before) == len(changed)
    assert {b: v for b, v in table.versions().items() if b not in changed} == {b: v for b, v in versions.items() if b not in changed}
    assert content(table) == sorted([(i, 1, f"a{i}") for i in range(40) if i != 3] + [(3, 2, "new")])


def test_repeated_and_broken_batches(spark, tmp_path, monkeypatch):
    table = made(spark, tmp_path)
    one = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 5, "c"), (2, 5, "c")], SCHEMA)
    table.merge(one, 7)
    want = content(table)
    assert want == [(1, 1, "b"), (2, 5, "c")]
    table.merge(spark.createDataFrame([(1, 9, "never")], SCHEMA), 7)  # the batch is done already
    assert content(table) == want
    two = spark.createDataFrame([(1, 2, "x"), (3, 1, "y")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            table.merge(two, 8)
        except OSError:
            pass
    assert content(table) == want  # files without a state do not count
    table.merge(two, 8)
    assert content(table) == [(1, 2, "x"), (2, 5, "c"), (3, 1, "y")]


def test_stream(spark, tmp_path):
    table = made(spark, tmp_path, buckets=4)
    folder = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame([(i, n, f"{n}") for i in range(n, n + 5)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    table.follow(f"file://{folder}", str(tmp_path / "cp"), files=1).awaitTermination(120)
    assert content(table) == sorted((i, min(i, 2), str(min(i, 2))) for i in range(7))
    spark.createDataFrame([(0, 10, "late")], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    state = table.versions()
    table.follow(f"file://{folder}", str(tmp_path / "cp"), files=1).awaitTermination(120)
    assert (0, 10, "late") in content(table) and sum(table.versions()[b] != v for b, v in state.items()) == 1
