import pytest
from pyspark.sql import functions as F

from corvina.functions import strings
from corvina.operators import graph, search, text
from corvina.sources import readers, writers
from corvina.streaming import watch


def test_m3u_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a.mp3", 10, "A - B"), (1, "b.mp3", 20, "C, d")], "o long, uri string, length int, label string")
    writers.write_m3u(rows, str(tmp_path / "m"), "o")
    back = readers.read_m3u(spark, str(tmp_path / "m" / "*.txt")).orderBy("no").select("uri", "length", "label").collect()
    assert [tuple(r) for r in back] == [("a.mp3", 10, "A - B"), ("b.mp3", 20, "C, d")]


def test_xml_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "t", 3), ("u2", None, 0)], "uri string, title string, year int")
    writers.write_xml(rows, str(tmp_path / "x"), "song", ["uri", "title", "year"])
    back = readers.read_xml(spark, str(tmp_path / "x"), "song", "_uri string, _title string, _year int")
    assert sorted(tuple(r) for r in back.collect()) == [("u1", "t", 3), ("u2", None, None)]


def test_line_formats(spark, tmp_path):
    (tmp_path / "v.csv").write_text("1.5,2,7\n3,4,8\n")
    assert sorted((r.label, list(r.v)) for r in readers.read_vectors(spark, str(tmp_path / "v.csv")).collect()) == [(7, [1.5, 2.0]), (8, [3.0, 4.0])]
    (tmp_path / "a.tsv").write_text("+\t5\tACA\n+\t6\tCC\n")
    pile = {(r.strand, r.position): (r.A, r.C) for r in readers.pile_up(readers.read_alignments(spark, str(tmp_path / "a.tsv"))).collect()}
    assert pile == {("+", 5): (1, 0), ("+", 6): (0, 2), ("+", 7): (1, 1)}
    (tmp_path / "f.fa").write_text(">ONE x\nac\ngt\n>TWO\ntt\n")
    assert {r.name: r.sequence for r in readers.read_fasta(spark, str(tmp_path / "f.fa")).collect()} == {"ONE x": "ACGT", "TWO": "TT"}
    (tmp_path / "p.lm").write_text("_a\t9\nb_\t7\n")
    assert [(r["rank"], r.gram, r.n) for r in readers.read_profile(spark, str(tmp_path / "p.lm")).orderBy("rank").collect()] == [(0, "_a", 9), (1, "b_", 7)]


def test_strings(spark):
    df = spark.createDataFrame([("a/b/c",), ("x",)], "s string")
    got = df.select(*[f(F.col("s"), "/").alias(f.__name__) for f in (strings.after_first, strings.before_last, strings.after_last, strings.until_first)]).collect()
    assert [tuple(r) for r in got] == [("b/c", "a/b", "c", "a"), (None, None, "x", "x")]


def test_edit_distance_and_canonical_text():
    assert text.indel("kitten", "sitting") == 5 and text.indel("", "ab") == 2 and text.indel("ab", "ba") == 2
    assert text.canonical("Ébène [1990]“x”") == "ebene (199o)'x'"
    assert text.canonical("Æon Straße\t½ £5 «a» {x} a–b\nc_^<y>\u0000") == "aeon strasse 1/2 l5 'a' (x) ab\nc  (y)"


def test_query_and_sort_spec():
    assert search.parse_query('a -"b c" "d e" -f') == (["a", "d e"], ["b c", "f"])
    spec = search.SortSpec.parse("p,-q")
    assert spec.toggle("p").keys == ["-p", "-q"] and spec.toggle("q").keys == ["q", "p"] and spec.append("p").keys == ["p", "-q"]


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 1.0), (5, 6, 1.0)], "a long, b long, cost double")
    got = {r.node: (r.distance, r.previous) for r in graph.shortest_paths(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {0: (0.0, -1), 2: (1.0, 0), 1: (3.0, 2), 3: (4.0, 1)}
    assert graph.landmarks(edges, 0, 2) == [0, 3]


def test_shortest_paths_of_many_hops(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(104)] + [(0, 104, 500.0)], "a long, b long, cost double").coalesce(1).cache()
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.distance for r in graph.shortest_paths(edges, start).collect()} == {i: float(i) for i in range(105)}
    with pytest.raises(RuntimeError):
        graph.shortest_paths(edges, start, max_rounds=2)


def test_watch(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")])):
        spark.createDataFrame(rows, "k long, ver long, v string").write.mode("append").parquet(folder)
        watch.watch(spark, folder, "k long, ver long, v string", target, str(tmp_path / "cp"), "k", "ver").awaitTermination(60)
        last = {r.k: r.v for r in spark.read.parquet(f"{target}/v{i}").collect()}
    assert last == {1: "c", 2: "b"}
