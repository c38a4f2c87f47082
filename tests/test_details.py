"""Space-separated labelled lines, decoded path segments, and packing, on known rows."""

import pytest

from corvina.functions import strings
from corvina.sources import readers


def test_space_separated_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3 0.5 -1e3\n\n  7 2 0.25  \n")
    got = [(r.label, r.v) for r in readers.read_vectors(spark, str(tmp_path), " ", "first").orderBy("label").collect()]
    assert got == [(3, [0.5, -1000.0]), (7, [2.0, 0.25])]
    (tmp_path / "b.txt").write_text("1 2\n")
    with pytest.raises(Exception, match="rows differ in width"):
        readers.read_vectors(spark, str(tmp_path), " ", "first").collect()


def test_last_segments(spark):
    rows = [("http://h/a%20b%zz", "a b%zz"), ("x%", "x%"), ("a/b/", ""), ("100%25", "100%"), (None, None), ("%C3%A9/%C3%A9", "é")]
    df = spark.createDataFrame(rows, "u string, want string")
    assert all(r.got == r.want for r in df.select("want", strings.last_path_segment(df.u).alias("got")).collect())


def test_reasonable(spark):
    rows = [("a\u200bb\u00adc", "abc"), ("\x00\x7f\x85\ue000\U000f0000", ""), ("\r\n\t", "\n\t"), ("é😀 ́x", "é😀 ́x"), ("\u0378", ""), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", strings.reasonable(df.t).alias("got")).collect())
