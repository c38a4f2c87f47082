"""Strip search, landmark tables, learned projections, maps and width fits against plain versions."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.operators import embedding, fitting, graph, prototypes, strips


# Strips
def nearest(train, test):
    out = {}
    for i, (x, y) in test:
        best = min((((x - u) ** 2 + (y - w) ** 2), j) for j, (u, w), _ in train)
        out[i] = best[1]
    return out


@pytest.mark.parametrize("strip", [3, 1_000])
def test_strips(spark, strip):
    rng = random.Random(3)
    train = [(i, [rng.choice([0.0, 1.0, rng.gauss(0, 5)]), rng.gauss(0, 5)], i % 4) for i in range(200)]
    train += [(300 + i, v, 1) for i, (_, v, _) in enumerate(train[:5])]  # repeated places: the smaller id counts
    test = [(i, [rng.gauss(0, 8), rng.gauss(0, 8)]) for i in range(60)] + [(90, [1e6, 0.0]), (91, [0.0, 0.0])]
    odd = [(1_000, None, 0), (1_001, [math.nan, 1.0], 0), (1_002, [1.0, math.inf], 0)]
    left = spark.createDataFrame(train + odd, "id long, v array<double>, label int")
    right = spark.createDataFrame(test + [(2_000, None), (2_001, [math.nan, 0.0])], "id long, v array<double>")
    got = strips.strip_nearest(left, right, strip).collect()
    assert {r.test_id: r.train_id for r in got} == nearest(train, test) and len(got) == len(test)
    assert all(r.label == dict((i, lab) for i, _, lab in train)[r.train_id] for r in got)
    if strip == 3:
        assert sum(r.measured for r in got) < 0.7 * len(train) * len(test)


def test_strips_without_training_points(spark):
    none = spark.createDataFrame([], "id long, v array<double>, label int")
    assert strips.strip_nearest(none, spark.createDataFrame([(1, [0.0, 0.0])], "id long, v array<double>")).count() == 0
    assert strips.strip_nearest(spark.createDataFrame([(1, [0.0, 0.0], 1)], "id long, v array<double>, label int"), none).count() == 0


def test_projection_keeps_most_variance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 5)) * [5, 1, 3, 0.1, 0.2]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    centre, axes = strips.principal_axes(rows, "v", 2)
    got = np.array([r.v for r in strips.projected(rows, "v", centre, axes).orderBy("id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vt[:2].T), atol=1e-6)


# Landmarks
def dijkstra(edges, start):
    out, heap = {}, [(0.0, start)]
    to: dict = {}
    for a, b, c in edges:
        to.setdefault(a, []).append((b, c))
    while heap:
        d, node = heapq.heappop(heap)
        if node not in out:
            out[node] = d
            for b, c in to.get(node, []):
                heapq.heappush(heap, (d + c, b))
    return out


def some_edges(n=60, seed=4):
    rng = random.Random(seed)
    near = [(i, rng.randrange(n), rng.choice([0.0, 1.0, rng.random() * 4])) for i in range(n) for _ in range(2)]
    near += [(100 + i, 101 + i, 0.5) for i in range(20)]  # a part of its own, a long chain
    return near + [(b, a, c) for a, b, c in near] + [(5, 5, 1.0), (None, 3, 1.0)]


def test_landmark_table(spark):
    edges = some_edges()
    made = graph.LandmarkTable(spark.createDataFrame(edges, "a long, b long, cost double"))
    made.add_random(3, seed=42)
    first = list(made.chosen)
    made.add_farthest(3)
    assert len(made.chosen) == len(set(made.chosen)) == 6 and made.chosen[:3] == first
    got = {(r.landmark, r.node): r.distance for r in made.table.collect()}
    want = {(n, b): d for n in made.chosen for b, d in dijkstra([e for e in edges if e[0] is not None], n).items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    for i in range(3, 6):  # each is the farthest from those before it
        before = {}
        for n in made.chosen[:i]:
            for b, d in dijkstra([e for e in edges if e[0] is not None], n).items():
                before[b] = min(d, before.get(b, math.inf))
        assert math.isclose(before[made.chosen[i]], max(before.values()), abs_tol=1e-9)
    again = graph.LandmarkTable(spark.createDataFrame(edges, "a long, b long, cost double"))
    again.add_random(3, seed=42)
    assert again.chosen == first
    whole = made.complete().collect()
    nodes = {x for a, b, _ in edges for x in (a, b) if x is not None}
    assert len(whole) == 6 * len(nodes) and sum(math.isinf(r.distance) for r in whole) == 6 * len(nodes) - len(want)
    with pytest.raises(ValueError):
        graph.LandmarkTable(spark.createDataFrame([(1, 2, -1.0)], "a long, b long, cost double")).add([1])


def test_triangulation_finds_a_plane(spark):
    rng = np.random.default_rng(7)
    place = rng.normal(size=(40, 2))
    far = np.sqrt(((place[:, None] - place[None]) ** 2).sum(axis=2))
    marks = range(8)
    own = spark.createDataFrame([(a, b, float(far[a, b])) for a in marks for b in marks], "a long, b long, d double")
    told = spark.createDataFrame([(i, b, float(far[i, b])) for i in range(40) for b in marks], "point long, landmark long, d double")
    places = embedding.map_landmarks(own, 2)
    got = {(r.landmark, r.dim): r.x for r in places.collect()}
    x = np.array([[got[a, k] for k in (0, 1)] for a in marks])
    assert np.allclose(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), far[:8, :8], atol=1e-9)
    found = {(r.point, r.dim): r.x for r in embedding.triangulate(places, own, told).collect()}
    y = np.array([[found[i, k] for k in (0, 1)] for i in range(40)])
    # The rule scales an axis by what the landmarks' own distances tell of it, so the map is right up to that.
    assert np.corrcoef(np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2)).ravel(), far.ravel())[0, 1] > 0.99


def test_infinite_distances_become_finite(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, math.inf), (3, None), (4, math.nan)], "i int, d double")
    assert [r.d for r in embedding.finite_distances(rows).orderBy("i").collect()] == [2.0, 20.0, 20.0, 20.0]


# Learned projection
def cloud(n=300, seed=5, loud=3.0):
    """Two useful dimensions of small spread beside six others that tell nothing."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 8)) * [0.25, 0.25, *[loud] * 6]
    x[:, :2] += np.array([[0, 0], [1, 0], [0, 1]])[y]
    return x, y


def test_projection_equals_plain_batches(spark):
    x, y = cloud()
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))] + [(900, None, 1), (901, x[0].tolist(), None)], "id long, v array<double>, label int")
    labels, w, p = prototypes.learn_projection(rows, epochs=4)
    q = strips.principal_axes(rows.where("v is not null and label is not null"), "v", 2)[1]
    q = q / np.linalg.norm(q)
    u = np.stack([x[y == k].mean(axis=0) for k in range(3)])
    for epoch in range(4):
        dw, dq, near = np.zeros_like(u), np.zeros_like(q), 0.0
        for v, k in zip(x, y, strict=True):
            d = [float(((q @ (u[j] - v)) ** 2).sum()) for j in range(3)]
            foe = min((j for j in range(3) if j != k), key=lambda j: d[j])
            mu_j, mu_k = 2 * d[foe] / (d[k] ** 2 + d[foe] ** 2), -2 * d[k] / (d[k] ** 2 + d[foe] ** 2)
            for j, mu in ((k, mu_j), (foe, mu_k)):
                dw[j] += 2 * mu * q.T @ (q @ (u[j] - v))
                dq += 2 * mu * np.outer(q @ (u[j] - v), u[j] - v)
            near += d[k]
        u = u - 0.2 / (1 + epoch) * 3 * near / len(x) / np.linalg.norm(q, 2) ** 2 * dw / len(x)
        q = q - 0.5 / (1 + epoch) * dq / np.linalg.norm(dq)
        q = q / np.linalg.norm(q)
    assert labels.tolist() == [0, 1, 2] and np.allclose(w, u, atol=1e-8) and np.allclose(p, q, atol=1e-8)


def test_projection_beats_plain_prototypes(spark):
    x, y = cloud(loud=0.7)
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, label int")
    wrong = lambda *model: prototypes.classify(rows, *model).join(rows, "id").where("predicted <> label").count()
    assert wrong(*prototypes.learn_projection(rows, epochs=40)) < wrong(*prototypes.learn_vectors(rows, epochs=5))


# Map
def test_map_follows_distances(spark):
    x, _ = cloud(200)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>")
    start = strips.projected(points.where("v is not null"), "v", *strips.principal_axes(points.where("v is not null"), "v", 2)).select("id", F.col("v").alias("p"))
    placed, r = fitting.correlation_map(points, start, rounds=12, meet=60)
    far = lambda a: np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))[np.triu_indices(len(a), 1)]
    one, two = (np.array([row.p for row in df.orderBy("id").collect()]) for df in (start, placed))
    before, after = (np.corrcoef(far(a), far(x))[0, 1] for a in (one, two))
    assert len(two) == 200 and after > before + 0.02 and abs(r - after) < 0.1
    again, r2 = fitting.correlation_map(points.repartition(7), start.repartition(3), rounds=12, meet=60)
    assert r2 == r and np.array_equal(two, np.array([row.p for row in again.orderBy("id").collect()]))


# Widths
def test_widths_equal_least_squares(spark):
    rng = random.Random(9)
    own = {"a": 3.0, "b": 1.5, "é": 4.0, " ": 2.0, "": 0.7}
    words = []
    for _ in range(120):
        text = "".join(rng.choice("aab é") for _ in range(rng.randint(0, 9)))
        words.append((text, sum(own[c] for c in text) + own[""] + rng.gauss(0, 0.3)))
    words += words[:10] + [("zz", 8.0)]
    got = {r.ch: (r.width, r.n) for r in fitting.fit_widths(spark.createDataFrame(words + [(None, 1.0), ("a", None), ("a", math.nan)], "text string, width double"), 1e-10).collect()}
    letters = sorted(set("".join(t for t, _ in words))) + [""]
    a = np.array([[t.count(c) if c else 1 for c in letters] for t, _ in words], dtype=float)
    scale = 1 / np.sqrt(a.sum(axis=1))
    best = np.linalg.lstsq(a * scale[:, None], np.array([w for _, w in words]) * scale, rcond=None)[0]
    assert got.keys() == set(letters) and all(abs(got[c][0] - b) < 1e-6 for c, b in zip(letters, best, strict=True))
    assert got["z"][1] == 2 and got[""][1] == len(words)


def test_widths_stop(spark):
    words = spark.createDataFrame([("ab", 3.0), ("ba", 5.0), ("b", 1.0)], "text string, width double")
    with pytest.raises(RuntimeError):
        fitting.fit_widths(words, 1e-12, max_rounds=1)
    assert fitting.fit_widths(words.where("false")).count() == 0


def test_distance_correlation_as_sql(spark, tmp_path):
    """As the query's SQL over odd rows, in one block and in many; pairs are not stored."""
    import duckdb

    from corvina.plans import ORACLE

    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=5).astype("float32")]) for i in range(90)]
    odd = [(3, 0, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, 1, [1.0, 2.0, 3.0, 4.0, 6.0]), (4, 1, [0.5] * 5), (91, 1, [1.0, None, 2.0, None, 0.0]), (92, 1, [None, None, 1.0]), (93, 2, [None, None]), (94, 2, [1.0]), (95, 2, []), (96, 2, None), (97, None, [1.0] * 5), (None, 1, [1.0] * 5), (98, 0, [1.0, 2.0, 3.0, 4.0, 5.0])]
    schema = "vec_id long, label int, embedding array<float>"
    for given in (rows, rows + odd):
        path = f"{tmp_path}/{len(given)}.parquet"
        df = spark.createDataFrame(given, schema)
        df.write.parquet(path)
        want = duckdb.sql(ORACLE["ml16_embedding_quality"].replace("FROM embeddings", f"FROM '{path}/*.parquet'")).fetchall()[0][0]
        for block in (7, 1_000):
            made = embedding.distance_correlation(df.selectExpr("vec_id AS id", "embedding AS v", "label"), 2, block)
            assert "Generate" not in made._jdf.queryExecution().toString() and abs(made.first().r - want) < 2e-6
    far = spark.createDataFrame([(i, 0, [1e4 + i * 1e-3, 1e4 + (i % 3) * 1e-3, 1e4 + (i % 7) * 1e-3]) for i in range(40)], "id long, label int, v array<double>")
    x = np.array([r.v for r in far.collect()])
    at = np.triu_indices(40, 1)
    want = [np.sqrt(((x[:, None, :k] - x[None, :, :k]) ** 2).sum(axis=2))[at] for k in (3, 2)]
    assert abs(embedding.distance_correlation(far, 2).first().r - abs(np.corrcoef(*want)[0, 1])) < 1e-9
    assert embedding.distance_correlation(far.limit(1), 2).first().r is None and embedding.distance_correlation(far.limit(0), 2).first().r is None


def test_class_ranks_as_sql(spark, tmp_path):
    """As the query's SQL, with copies and places unknown, in one task and in many; no distance is sorted by Spark."""
    import duckdb

    from corvina.plans import ORACLE, QUERIES

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size=3)], int(rng.integers(0, 3))) for i in range(400)]
    rows += [(400, None, 1), (401, [1.0], 0), (402, [2.0, 2.0], None), (450, [1.0, 1.0], None), (500, [0.0, 0.0], 77), (None, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    path = f"{tmp_path}/embeddings.parquet"
    df.write.parquet(path)
    want = duckdb.sql(ORACLE["ml17_neighbour_rank"].replace("FROM embeddings", f"FROM '{path}/*.parquet'")).fetchall()[0][0]
    made = QUERIES["ml17_neighbour_rank"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().toString()
    assert "Window" not in plan and made.first().quality == want
    points = df.selectExpr("vec_id AS id", "get(embedding, 0) AS x", "get(embedding, 1) AS y", "label")
    assert abs(embedding.mean_class_rank(points, points.where("id % 50 = 0"), 2, 60).first().quality - want) < 1e-8
    assert embedding.mean_class_rank(points.limit(0), points.limit(0)).first().quality is None
