"""Readers give equal rows however a file is split."""

import random

import pytest

from corvina.sources import readers


@pytest.fixture
def split(spark):
    """Files of a few hundred bytes are cut into ranges of 64."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, old[k]) if k in old else spark.conf.unset(k)


def rows(df):
    return sorted((tuple(v.rsplit("/", 1)[-1] if c == "path" else v for c, v in r.asDict().items()) for r in df.collect()), key=repr)


def write(tmp_path):
    rng = random.Random(2)
    line = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    (tmp_path / "a.fa").write_text("before\n>ONE first\n" + "\n".join(line(rng.randint(0, 70)) for _ in range(30)) + "\n>empty\n>THREE\n" + line(500) + "\n" + line(3))
    (tmp_path / "b.fa").write_bytes(b">crlf\r\nac\r\ngt\r\n")
    songs = "\n".join(f"#EXTINF:{i},Artist {i} - Title\n\n# note\n#EXTINF:{i + 1},Other\nsong{i}.mp3\nplain{i}.mp3" for i in range(12))
    (tmp_path / "l.m3u").write_text("#EXTM3U\n" + songs)
    (tmp_path / "p.lm").write_text("".join(f"g{i}\t{1000 - i}\n" for i in range(60)))
    (tmp_path / "e.fa").write_text("")


READERS = {"fa": (readers.read_fasta, readers.read_fasta_lines, readers.read_lines), "m3u": (readers.read_m3u, readers.read_lines), "lm": (readers.read_profile,)}


@pytest.mark.parametrize("kind", READERS)
def test_equal_rows(spark, tmp_path, split, kind):
    write(tmp_path)
    for reader in READERS[kind]:
        df = reader(spark, f"{tmp_path}/*.{kind}")
        small = rows(df if "block" not in df.columns else df.drop("block"))
        parts = spark.read.text(f"{tmp_path}/*.{kind}").rdd.getNumPartitions()
        assert parts > 3
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        df = reader(spark, f"{tmp_path}/*.{kind}")
        assert rows(df if "block" not in df.columns else df.drop("block")) == small and small
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")


def test_known_rows(spark, tmp_path, split):
    write(tmp_path)
    want = {}
    for name in ("a.fa", "b.fa"):
        for block in (tmp_path / name).read_bytes().decode().replace("\r", "").split(">")[1:]:
            head, *body = block.split("\n")
            want[name, head] = "".join(body).upper()
    assert {(r.path.rsplit("/", 1)[-1], r.name): r.sequence for r in readers.read_fasta(spark, f"{tmp_path}/*.fa").collect()} == want
    for r in readers.read_fasta_lines(spark, f"{tmp_path}/*.fa").collect():
        assert want[r.path.rsplit("/", 1)[-1], r.name][r.at :].startswith(r.line)
    songs = {r.uri: (r.length, r.label) for r in readers.read_m3u(spark, f"{tmp_path}/l.m3u").collect()}
    assert songs == {f"song{i}.mp3": (i + 1, "Other") for i in range(12)} | {f"plain{i}.mp3": (None, None) for i in range(12)}
