import gzip
import math
import struct

import numpy as np
from pyspark.sql import functions as F

from corvina.functions import prose
from corvina.operators import catalogue, embedding, graph, inference, ordered, prototypes, sampling, text, vectors
from corvina.sources import generators, readers, writers


def test_tail_probabilities(spark):
    assert abs(inference.incomplete_beta(0.3, 2, 3) - 0.3483) < 1e-12
    assert abs(inference.incomplete_beta(0.9, 0.5, 0.5) - 2 / math.pi * math.asin(math.sqrt(0.9))) < 1e-12
    t = spark.createDataFrame([(1.0, 1.0), (2.228138852, 10.0), (0.0, 5.0), (float("inf"), 3.0), (None, 3.0)], "t double, df double")
    p = [r[0] for r in t.select(inference.student_p("t", "df")).collect()]
    assert [round(x, 6) for x in p[:4]] == [0.5, 0.05, 1.0, 0.0] and p[4] is None


def test_tests(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 4.0, 5.0), ("b", 1.0, 1.0), (None, 3.0, 3.0), (None, 3.0, 3.0)], "g string, x double, y double")
    got = {r.g: r for r in inference.paired_t(rows, ["g"], "x", "y").collect()}
    assert round(got["a"].t, 6) == -4.0 and got["a"].below and abs(got["a"].p - 0.0571909584) < 1e-9
    assert (got["b"].p, got["b"].below) == (1.0, False) and got[None].p == 1.0
    welch = {r.g: r for r in inference.welch_t(rows, ["g"], "x", "y").collect()}
    assert round(welch["a"].t, 6) == round((7 / 3 - 11 / 3) / math.sqrt(7 / 9 + 7 / 9), 6) and welch["a"].nu in (3, 4)  # exactly 4, where cutting to whole degrees depends on rounding
    u = {r.g: r for r in inference.mann_whitney(rows, ["g"], "x", "y").collect()}
    assert u["a"].u == sum((x > y) + (x == y) / 2 for x in (1, 2, 4) for y in (2, 4, 5)) and u[None].p == 1.0
    trials = spark.createDataFrame([(s, t, e + 0.001 * ((t * 7 + len(s)) % 5)) for s, e in (("a", 0.1), ("bb", 0.1), ("ccc", 0.9)) for t in range(10)], "s string, t int, e double")
    share = inference.confusable_share(trials, "s", "t", "e").first()
    assert (share.others, share.confusable) == (2, 1)
    assert inference.confusable_share(trials.limit(0), "s", "t", "e").count() == 0


def test_prose(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]
    assert one(prose.strip_markup, "''A'' [[B|c]] [[d]] [http://x y z] {{t}} <ref>q</ref><b>e</b> &amp; f") == "A c d y z  e & f"
    assert one(prose.sentences, "He met Dr. no one. She left! then lower. \"Quoted one.\" End") == ["He met Dr. no one.", "She left!", '"Quoted one."']
    assert one(prose.sentences, "A " * 20_000 + "b.") == ["A " * 20_000 + "b."]
    for junk in ("A. ", "a.b", "(x. ", " Dr.", ". x. "):
        assert isinstance(one(prose.sentences, junk * 20_000), list)
    long = "He said it " + "of St. Mary " * 5_000 + "today."
    assert one(prose.sentences, f"{long} Then." + " " * 500 + "He left. A. Smith, ed. of no one, met J. R. Jones.") == [long, "Then.", "He left. A. Smith, ed. of no one, met J. R. Jones."]
    assert one(prose.sentences, "Go on?x No stop here") == [] and one(prose.sentences, "\ufdd0He\ufdd1 left.") == ["He left."]
    assert one(prose.sentences, None) is None and one(prose.sentences, "") == []
    assert round(one(prose.grade, "The cat sat."), 6) == round(8 / 12 + 0.3 * 2 - 0, 6) and one(prose.grade, "") is None
    assert one(prose.escape_path, "C:\\a b\\100%!\u0007é") == "C!3a/a b/100!25!21!07é"


def test_all_pairs_and_landmarks(spark):
    edges = [(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 1.0), (3, 0, 1.0), (5, 5, 2.0)]
    want = {(n, n): 0.0 for n in (0, 1, 2, 3, 5)} | {(a, b): c for a, b, c in edges if a != b}
    for k in (0, 1, 2, 3, 5):
        for (a, x), c in list(want.items()):
            for (y, b), d in list(want.items()):
                if x == k == y:
                    want[a, b] = min(want.get((a, b), math.inf), c + d)
    got = graph.all_pairs(spark.createDataFrame(edges, "a long, b long, cost double"))
    assert {(r.a, r.b): r.cost for r in got.collect()} == want


def test_prototypes(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 1.0, (60, 3)) for m in ((0, 0, 0), (4, 0, 0))])
    rows = spark.createDataFrame([(i, [float(c) for c in v], int(i >= 60)) for i, v in enumerate(x)] + [(999, None, 0)], "id long, v array<double>, label int")
    labels, w = prototypes.learn_vectors(rows, epochs=3)
    wrong = prototypes.classify(rows, labels, w).join(rows, "id").where("predicted <> label").count()
    assert list(labels) == [0, 1] and w.shape == (2, 3) and wrong <= 8
    gas = prototypes.neural_gas(rows, np.array([[1.0, 0, 0], [2.0, 0, 0]]), epochs=6)
    assert np.allclose(np.sort(gas[:, 0]), [0, 4], atol=0.6)


def test_triangulation(spark):
    rng = np.random.default_rng(3)
    land, points = rng.normal(size=(12, 2)), rng.normal(size=(9, 2))
    land -= land.mean(axis=0)
    land = land @ np.linalg.svd(land)[2].T  # along the principal axes, where the placing is exact
    d = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    places = spark.createDataFrame([(i, k, float(land[i, k])) for i in range(12) for k in range(2)], "landmark long, dim int, x double")
    between = spark.createDataFrame([(i, j, d(land[i], land[j])) for i in range(12) for j in range(12)], "a long, b long, d double")
    to = spark.createDataFrame([(p, i, d(points[p], land[i])) for p in range(9) for i in range(12)], "point long, landmark long, d double")
    got = {(r.point, r.dim): r.x for r in embedding.triangulate(places, between, to).collect()}
    assert all(abs(got[p, k] - points[p, k]) < 1e-9 for p in range(9) for k in range(2))


def test_sampling(spark):
    rows = spark.range(50).withColumnRenamed("id", "k")
    a, b = ([r.k for r in sampling.shuffled(rows.repartition(n), ["k"], 1).collect()] for n in (1, 7))
    assert a == b and sorted(a) == list(range(50)) and a != sorted(a)
    weights = spark.createDataFrame([("a", 1), ("b", 3), ("c", 0), ("d", None)], "v string, w int")
    got = dict(sampling.draw(spark, weights, "v", "w", 4000, 5).groupBy("v").count().collect())
    assert sum(got.values()) == 4000 and set(got) == {"a", "b"} and abs(got["a"] - 1000) < 120


def test_popularity(spark):
    tracks = spark.createDataFrame([("Q", "one two", 500.0), ("q", "three", 900.0)], "artist string, track string, reach double")
    asked = spark.createDataFrame([("Q", "One Two"), ("Q", "zzzzzzzzzzzzzzzzzzzzzzzz"), ("none", "x"), (None, "y")], "artist string, title string")
    got = {(r.artist, r.title): (r.artist_popularity, r.title_popularity) for r in catalogue.popularity(asked, tracks).collect()}
    assert got == {("Q", "One Two"): (900, 500), ("Q", "zzzzzzzzzzzzzzzzzzzzzzzz"): (900, 0), ("none", "x"): (0, 0)}


def test_files(spark, tmp_path):
    folder = tmp_path / "f" / "deep"
    folder.mkdir(parents=True)
    with gzip.open(folder / "x.idx.gz", "wb") as f:
        f.write(struct.pack(">HBB3I", 0, 8, 3, 3, 2, 2) + bytes(range(12)))
    got = readers.read_idx(spark, str(folder / "x.idx.gz")).orderBy("pos").collect()
    assert [list(r.v) for r in got] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    assert [r.path.rsplit("/", 1)[1] for r in readers.list_files(spark, str(tmp_path / "f")).collect()] == ["x.idx.gz"]
    (tmp_path / "c.csv").write_text("S1,,S2\nEnglish,Dutch,English\na,b,c\n,x,\nd,,\n")
    cards = readers.read_column_lists(spark, str(tmp_path / "c.csv"), "English").collect()
    assert sorted((r["set"], r.card) for r in cards) == [("S1", ""), ("S1", "a"), ("S1", "d"), ("S2", "c")]


def test_chains_and_ranks(spark):
    rows = [(i, i - 1 if i % 300 else None) for i in range(900)] + [(5000, 777), (6000, 9999), (7000, 7001), (7001, 7000)]
    got = {r.id: (r.n, r.root) for r in graph.chains(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == {i: (i % 300 + 1, i - i % 300) for i in range(900)} | {5000: (179, 600), 6000: (1, 6000)}
    ranked = ordered.global_rank(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7), [F.col("k").desc()], "pos").collect()
    assert all(r.pos == 999 - r.k for r in ranked) and len(ranked) == 1000
    assert ordered.global_rank(spark.range(0), [F.col("id")], "pos").count() == 0


def test_edge_split_and_triangles(spark):
    edges = spark.createDataFrame([(a, b, float((a * b) % 11 + 1)) for a in range(30) for b in range(30) if (a * 7 + b * 3) % 4 == 0], "a long, b long, d double")
    side = {}
    for a, b, d in ((r.a, r.b, r.d) for r in edges.collect()):
        if a != b:
            k = (min(a, b), max(a, b))
            side[k] = min(side.get(k, d), d)
    found = [(side[x, y], side[y, z], side[x, z]) for x in range(30) for y in range(x + 1, 30) for z in range(y + 1, 30) if (x, y) in side and (y, z) in side and (x, z) in side]
    assert tuple(graph.triangles(edges).first()) == (len(found), sum(2 * max(t) > sum(t) for t in found))
    parts = graph.split_edges(spark.range(200).select(F.col("id").alias("a"), (F.col("id") * 3 + 1).alias("b"))).groupBy("part").count().collect()
    sizes = {r.part: r["count"] for r in parts}
    assert sum(sizes.values()) == 200 and sizes["train"] > 130 and min(sizes.values()) > 5


def brute_cost(q, s):
    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
        return row[-1]

    def grams(t):
        t = t if len(t) >= 3 else t.rjust(3, "\ufffd")
        return {t[i : i + 3] for i in range(len(t) - 2)}

    (qa, qt), (sa, st) = q, s
    g = [grams(text.canonical(a)) | grams(text.canonical(t)) for a, t in (q, s)]
    shared = len(g[0] & g[1])
    if shared < (len(g[0]) * 6 + 9) // 10:
        return None
    scaled = lambda a, b: far(a, b) / max(1, len(a), len(b))
    pairs = [(qa.lower(), sa.lower()), (qt.lower(), st.lower()), (text.canonical(qa), text.canonical(sa)), (text.canonical(qt), text.canonical(st))]
    return 1 - shared / max(map(len, g)) + sum(scaled(a, b) for a, b in pairs)


def test_song_matches_and_repair(spark):
    names = [("Ann Lee", "Two Times"), ("Anne Lee", "2 Times"), ("Björk", "Hyper-Ballad"), ("Bjork", "Hyperballad"), ("A - B", "C"), ("", "xy"), ("The Who", "Who Are You")]
    songs = [(i, f"http://s/{a}/{t.replace(' ', '%20')}.mp3", a, t, f"{a} - {t}", 200 + i) for i, (a, t) in enumerate(names)]
    table = spark.createDataFrame(songs, "id long, uri string, artist string, title string, label string, length int")
    asked = [(10 + i, a, t + "s") for i, (a, t) in enumerate(names)] + [(99, None, None)]
    got = {(r.q_id, r.c_id): r.cost for r in text.song_matches(spark.createDataFrame(asked, "id long, artist string, title string"), table).collect()}
    want = {(q, i): brute_cost((a or "", t or ""), n) for q, a, t in asked for i, n in enumerate(names)}
    want = {k: v for k, v in want.items() if v is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    entries = [(1, "C:\\m\\Two%20Times.mp3", "Ann Lee - Two Times", 201), (2, "x", "Bjork - Hyperballad", 0), (3, "x", "The Who - Who Are You", 300), (4, "x", "no dash", 5), (5, "100%.mp3", "A - B - C", 204)]
    fixed = {r.id: r for r in text.repair_playlist(spark.createDataFrame(entries, "id long, uri string, label string, length int"), table).collect()}
    assert {i: (r.song_id, r.verdict) for i, r in fixed.items()} == {1: (0, "good"), 2: (3, "good"), 3: (None, "none"), 4: (None, "none"), 5: (4, "good")}
    assert abs(fixed[1].cost - 0.2) < 1e-6 and abs(fixed[2].cost - 1.5) < 1e-6
    splits = table.select(text.label_splits(F.lit("a - b - c")).alias("x")).first().x
    assert [tuple(s) for s in splits] == [("a", "b - c"), ("a - b", "c")]
    assert [text.indel(a, b) for a, b in (("", ""), ("abc", ""), ("kitten", "sitting"), ("abc", "xbz"))] == [0, 3, 5, 4]


def test_separable_share(spark):
    got = {r.p: r for r in prototypes.separable_share(spark, [(5, 20), (80, 10)], trials=12, epochs=100, seed=1).collect()}
    assert got[5].share == 1.0 and got[80].share == 0.0 and got[5].trials == 12
    again = {r.p: r for r in prototypes.separable_share(spark, [(5, 20)], trials=12, epochs=100, seed=1).collect()}
    assert again[5].epochs == got[5].epochs


def test_generators(spark):
    rows = generators.gaussian_clouds(spark, 3, 400, 4, 6.0, 9)
    points = {}
    for r in rows.collect():
        points.setdefault(r.label, []).append(r.v)
    assert all(len(v) == 400 and np.allclose(np.std(v, axis=0), 1, atol=0.15) for v in points.values())
    assert sorted(map(tuple, rows.repartition(5).select("id", F.xxhash64("v")).collect())) == sorted(map(tuple, rows.select("id", F.xxhash64("v")).collect()))
    arms = generators.stars(spark, 2, 3, 50, 3, 5).groupBy("label", "arm").count().collect()
    assert len(arms) == 6 and {r["count"] for r in arms} == {50}
    cube = generators.uniform_points(spark, 500, 2, 4, 1).collect()
    assert all(0 <= x < 1 for r in cube for x in r.v) and {r.label for r in cube} == {0, 1, 2, 3}


def test_sinks_and_xpath(spark, tmp_path):
    rows = spark.createDataFrame([(1, "+", "A"), (1, "-", "C"), (2, "+", "A"), (1, "+", "A")], "pos long, strand string, base string")
    writers.write_count_blocks(rows, str(tmp_path / "c"), "pos", "strand", "base", ["A", "C"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).orderBy("pos").collect()] == [("1", "2", "0", "0", "1"), ("2", "1", "0", "0", "0")]
    writers.write_json(rows, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "j")).select("pos", "strand", "base").collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "d.xml").write_text("<r><div spell='a'>x</div><p>no</p><div>none</div><div spell='b'>y</div></r>")
    assert [(r.pos, r.value) for r in readers.read_xpath(spark, str(tmp_path / "d.xml"), "//div[@spell]/text()").collect()] == [(0, "x"), (1, "y")]
    (tmp_path / "long.fa").write_text(">" + "n" * 1_200_000 + "\nacgt\n")
    assert [len(r.name) for r in readers.read_fasta(spark, str(tmp_path / "long.fa")).collect()] == [1_200_000]


def test_histogram_and_suppression(spark):
    rng = np.random.default_rng(4)
    values = [("a", float(x)) for x in rng.normal(size=400)] + [("b", 1.0)] * 30 + [("c", None), ("c", float("nan"))] + [(None, float(x)) for x in rng.integers(0, 9, 300)]
    got = {}
    for r in ordered.adaptive_histogram(spark.createDataFrame(values, "g string, x double"), "g", "x", 20, 50).collect():
        got.setdefault(r.g, []).append((r["mean"], r.density))
    for group in ("a", None):
        x, out, start = sorted(v for g, v in values if g == group), [], 0
        for i in range(1, len(x)):
            if i - start >= 20 and x[i] - x[start] >= (x[-1] - x[0]) / 50 and x[i] > x[start]:
                out.append((sum(x[start:i]) / (i - start), (i - start) / (x[i] - x[start]) / len(x)))
                start = i
        assert len(out) > 2 and np.allclose(sorted(got[group]), out)
    assert set(got) == {"a", None}
    assert ordered.adaptive_histogram(spark.createDataFrame([], "g string, x double"), "g", "x", 20, 50).count() == 0
    rows = [(i, f"l{i % 3}", float(rng.integers(0, 100))) for i in range(300)] + [(300, None, 5.0), (301, "l0", None), (302, "l0", None), (303, "l0", float("nan"))]
    kept = {(r.label, r.id) for r in ordered.greedy_suppress(spark.createDataFrame(rows, "id long, label string, len double"), "label", "len", ["id"], 5).collect()}
    taken = []
    for i, label, length in rows:
        if length is None or not any(g == label and n is not None and abs(n - length) <= 5 for _, g, n in taken):
            taken.append((i, label, length))
    assert kept == {(g, i) for i, g, _ in taken}


def test_grown_playlists(spark):
    rng = np.random.default_rng(6)
    lists = {t: [int(o) for o in rng.permutation(30)[:4]] for t in range(25)}
    seeds, known = {1: [0, 3], 2: [7], 3: [29], 4: [5, 6, 5]}, {t for t in range(30) if t % 3}
    want = set()
    for playlist, first in seeds.items():
        cost, hops, bases, dependants = {}, {}, {}, {}
        for t in first:
            cost[t], hops[t], bases[t], dependants[t] = 0.0, 0, {t}, set()
        heap, taken = set(cost), []
        while heap and len(taken) < 7 and sum(t in known for t in taken) < 4:
            now = min(heap, key=lambda t: (cost[t], t))
            heap.remove(now)
            if hops[now]:
                taken.append(now)
                want.add((playlist, len(taken), now, round(cost[now], 9), hops[now], now in known))
            for rank, t in enumerate(lists.get(now, [])):
                bases.setdefault(t, set()).update(bases[now])
                for b in bases[now]:
                    dependants[b].add(t)
                if t not in heap and t in cost:
                    continue
                heap.add(t)
                n = len(bases[t])
                cost[t] = (rank + sum(len(dependants[b]) + 50 for b in bases[t])) / (n * n**0.5)
                hops[t] = min(hops.get(t, hops[now] + 1), hops[now] + 1)
    similar = spark.createDataFrame([(t, o, r) for t, x in lists.items() for r, o in enumerate(x)], "track long, other long, rank int")
    frame = spark.createDataFrame([(p, t) for p, x in seeds.items() for t in x], "playlist long, track long")
    got = graph.grow_playlists(frame, similar, spark.createDataFrame([(t,) for t in known], "track long"), 7, 4).collect()
    assert {(r.playlist, r.place, r.track, round(r.cost, 9), r.hops, r.known) for r in got} == want and len(want) > 8
    assert graph.grow_playlists(frame.limit(0), similar, similar.select("track")).count() == 0


def test_principal_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0] + 7
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    got = np.array([r.projected for r in vectors.pca(rows, "v", 2).orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(got), np.abs(centred @ axes.T), atol=1e-6)


def test_paths_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "a long, b long, cost double").mapInArrow(count, "a long, b long, cost double")
    found = graph.shortest_paths(edges, spark.createDataFrame([(0,)], "node long"))
    assert {(r.node, r.distance) for r in found.collect()} == {(i, float(i)) for i in range(7)} and made.value == 6


def test_closest_rows_of_many(monkeypatch):
    """Against plain sorting, with copies, far from the origin, with more columns than give the bound, and with few rows."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(vectors, "FIRST", 32)
    for m, scale in ((rng.normal(size=(300, 7)), 1.0), (rng.integers(0, 3, (300, 3)).astype(float), 1.0), (rng.normal(size=(300, 7)) * 1e-3 + 1e3, 1.0), (rng.normal(size=(300, 4)), 1e20), (rng.normal(size=(3, 2)), 1.0), (np.zeros((90, 2)), 1.0)):
        m, q, ids = m * scale, (m * scale)[::3], rng.permutation(len(m)) + 5
        r, c, d = vectors._closest(m, ids, q, 6)
        want = [(i, ids[j]) for i, x in enumerate(q) for j in np.lexsort((ids, ((m - x) ** 2).sum(axis=1)))[:6]]
        assert list(zip(r.tolist(), ids[c].tolist(), strict=True)) == want
        assert np.array_equal(d, ((m[c] - q[r]) ** 2).sum(axis=1))
