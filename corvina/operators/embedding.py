"""Low-dimensional maps: how well one keeps neighbours, and placing further points by their distances to landmarks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.session import cut

#: Vectors of a block, at about; a task holds two. Pairs are measured by so many rows and columns at once.
BLOCK, ROWS, COLUMNS = 16_384, 256, 1_024


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


class _Moments:
    """How many pairs (x, y) there are, their means, and the sums of squares and products about them."""

    def __init__(self) -> None:
        self.n, self.x, self.y, self.xx, self.yy, self.xy = 0, 0.0, 0.0, 0.0, 0.0, 0.0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        if not (n := x.size):
            return
        mx, my = float(x.mean()), float(y.mean())
        x, y = x.ravel() - mx, y.ravel() - my
        all_, dx, dy = self.n + n, mx - self.x, my - self.y
        w = self.n * n / all_
        self.xx, self.yy, self.xy = self.xx + float(x @ x) + dx * dx * w, self.yy + float(y @ y) + dy * dy * w, self.xy + float(x @ y) + dx * dy * w
        self.n, self.x, self.y = all_, self.x + dx * n / all_, self.y + dy * n / all_


def _measured(a: np.ndarray, b: np.ndarray, dims: int, same: bool, sums: _Moments) -> None:
    """Add the distances of all pairs of rows of a and b, in all components and in the first `dims`."""
    middle = (a.sum(axis=0) + b.sum(axis=0)) / max(1, len(a) + len(b))
    ca, cb = a - middle, b - middle
    la, lb = (ca * ca).sum(axis=1), (cb * cb).sum(axis=1)
    for i in range(0, len(a), ROWS):
        for j in range(i // COLUMNS * COLUMNS if same else 0, len(b), COLUMNS):
            p, q = slice(i, i + ROWS), slice(j, j + COLUMNS)
            size = la[p, None] + lb[None, q]
            far = size - 2 * ca[p] @ cb[q].T
            near = np.argwhere(far <= 1e-6 * size)  # where a product loses digits, the difference is taken
            for k in range(0, len(near), 4 * COLUMNS):
                r, c = near[k : k + 4 * COLUMNS].T
                far[r, c] = ((a[i + r] - b[j + c]) ** 2).sum(axis=1)
            flat = sum((a[p, k, None] - b[None, q, k]) ** 2 for k in range(min(dims, a.shape[1])))
            far, flat = np.sqrt(far), np.sqrt(flat)
            if same and j < i + ROWS:
                later = np.arange(j, j + far.shape[1]) > np.arange(i, i + far.shape[0])[:, None]
                far, flat = far[later], flat[later]
            sums.add(far, flat)


def _odd_pairs(i: int, v: list, ids: list, others: list, dims: int) -> list[tuple]:
    """(smaller id, larger id, squared distance, that of the first components) of a row and others: nulls and what one row lacks count for nothing."""
    out = []
    for j, w in zip(ids, others, strict=True):
        if i != j:
            both = list(zip(v, w))  # noqa: B905  the shorter one ends it
            gaps = [None if x is None or y is None else (x - y) ** 2 for x, y in both]
            told, flat = [g for g in gaps if g is not None], [g for g in gaps[:dims] if g is not None]
            out.append((min(i, j), max(i, j), math.fsum(told) if told else None, math.fsum(flat) if flat or len(both) > dims else None))
    return out


_SUMS = "i long, j long, n long, x double, y double, xx double, yy double, xy double"


def distance_correlation(rows: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """(r): the absolute correlation, over all pairs of rows (id, v, label) of one label, of their distance and that in the first `dims` components.

    A label's rows are dealt into blocks of about `block`; each two blocks meet in one task, which leaves one row of sums, so what is
    stored follows rows times blocks while the work follows the pairs. Pairs with a vector that holds nulls or differs in width, or
    with a repeated id, are measured one by one, and the squares of those of the same two ids are added up, as SQL's
    grouping by ids does. Rows without id, label or components take no part. Null where nothing varies.
    """
    given = rows.select(F.col("id").cast("long").alias("id"), "v", "label").where("id is not null and label is not null and size(v) > 0")
    width = given.agg(F.max(F.size("v"))).first()[0] or 0
    most = given.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    often = given.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("often"))
    blocks = max(1, math.ceil(most / block))
    given = given.withColumn("often", F.lit(False)) if often.isEmpty() else given.join(often, "id", "left").withColumn("often", F.coalesce("often", F.lit(False)))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = given.select("id", "v", "label", (F.col("often") | (F.size("v") != width) | F.exists("v", lambda x: x.isNull())).alias("odd"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    cells = dealt.select("id", "v", "label", "odd", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b = key[1].as_py(), key[2].as_py()
        odd, own, sums = table["odd"].to_numpy(), table["own"].to_numpy(), _Moments()
        plain = table.filter(pa.array(~odd))
        v, place = _matrix(plain["v"], width), plain["own"].to_numpy()
        _measured(v[place == a], v[place == b], dims, a == b, sums)
        out = [(None, None, sums.n, sums.x, sums.y, sums.xx, sums.yy, sums.xy)]
        if odd.any():
            ids, vs = table["id"].to_pylist(), table["v"].to_pylist()
            for r in np.flatnonzero(odd):
                # With all plain rows of the other block, and with the odd ones once.
                with_ = [s for s in (np.flatnonzero(own != own[r]) if a != b else range(len(ids))) if not odd[s] or s > r]
                out += [(i, j, None, x, y, None, None, None) for i, j, x, y in _odd_pairs(ids[r], vs[r], [ids[s] for s in with_], [vs[s] for s in with_], dims)]
        kinds = [pa.int64()] * 3 + [pa.float64()] * 5
        return pa.table({c.split()[0]: pa.array(list(x), k) for c, x, k in zip(_SUMS.split(", "), zip(*out, strict=True), kinds, strict=True)})

    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks * blocks)
    told = cut(cells.repartition(tasks, "label", "a", "b").groupBy("label", "a", "b").applyInArrow(run, _SUMS))
    single = told.where("i is not null").groupBy("i", "j").agg(F.sqrt(F.sum("x")).alias("x"), F.sqrt(F.sum("y")).alias("y")).where("x is not null and y is not null")
    zero = F.lit(0.0)
    parts = told.where("i is null and n > 0").drop("i", "j").union(single.select(F.lit(1).cast("long"), "x", "y", zero, zero, zero))
    mean = parts.agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mx"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("my"))
    dx, dy, n = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("n")
    total = parts.join(F.broadcast(mean)).agg(F.sum(F.col("xx") + n * dx * dx).alias("xx"), F.sum(F.col("yy") + n * dy * dy).alias("yy"), F.sum(F.col("xy") + n * dx * dy).alias("xy"))
    return total.select(F.abs(F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy"))).alias("r"))


#: Of mean_class_rank(): tests of a group, at about, and points of a block; a task holds a group's tests, their class mates and a block, each so many.
TESTS, POINTS = 2_048, 131_072


def _smaller_ids(d: np.ndarray, ids: np.ndarray, far: np.ndarray, names: np.ndarray) -> int:
    """How many pairs there are of a point (d, ids) and one of far and names at the same distance with a larger id."""
    values = np.unique(far)
    at = np.minimum(np.searchsorted(values, d), len(values) - 1)
    level = values[at] == d
    at, ids = at[level], ids[level]
    known, place = np.unique(np.concatenate((ids, names)), return_inverse=True)
    mine, theirs = at * len(known) + place[: len(ids)], np.searchsorted(values, far) * len(known)
    mine.sort()
    return int((np.searchsorted(mine, theirs + place[len(ids) :]) - np.searchsorted(mine, theirs)).sum())


def _rank_sums(tests: dict, near: dict, points: dict) -> list[tuple[int, int, int]]:
    """(test, sum of the ranks of its class mates among these points, number of mates)."""

    def far(rows: dict, x: float, y: float) -> np.ndarray:
        d = (x - rows["x"]) * (x - rows["x"]) + (y - rows["y"]) * (y - rows["y"])
        return np.where(np.isnan(d), np.inf, d)  # unknown ones come last

    out = []
    of = {k: {c: v[near["label"] == k] for c, v in near.items()} for k in np.unique(tests["label"])}
    for test, x, y, label in zip(*(tests[c] for c in ("id", "x", "y", "label")), strict=True):
        mates = of[label]
        other = mates["id"] != test
        d, asked, names, here = far(points, x, y), far(mates, x, y)[other], mates["id"][other], mates["here"][other]
        line, ordered = np.sort(d), np.sort(asked)
        total = int(np.searchsorted(line, ordered).sum())
        if int(np.searchsorted(line, ordered, "right").sum()) - total > int(here.sum()):  # some are as far as others than themselves
            tied = np.searchsorted(line, asked, "right") - np.searchsorted(line, asked) > here
            total += _smaller_ids(d, points["id"], asked[tied], names[tied])
        out.append((int(test), total, len(asked)))
    return out


def mean_class_rank(points: DataFrame, tests: DataFrame, group: int = TESTS, block: int = POINTS) -> DataFrame:
    """(quality): mean over test points of the mean rank, as a share of all points, of the others of their label.

    Both are (id, x, y, label), tests being some of the points. Each test point is ranked against all points, so there
    are as many distances as test points times points. Tests are grouped by label and points dealt into blocks; a task
    sorts one block's distances for each test of a group and leaves one sum of ranks, to which the blocks' are added:
    no distance or rank is stored, and no task holds more than a group, its class mates and a block. Ties go to
    the smaller id, the point itself has rank 0, points without a place come last. Tests without a label or others of
    it take no part.
    """
    tests = tests.where("label is not null and id is not null").withColumn("label", F.col("label").cast("long"))
    points = points.withColumn("label", F.col("label").cast("long"))
    total, asked = points.count(), tests.count()
    groups = max(1, math.ceil(asked / group))
    hashed = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    most = lambda df: df.groupBy(hashed("label", groups, 1)).count().agg(F.max("count")).first()[0] or 1
    parts, mates, blocks = math.ceil(most(tests) / group), math.ceil(most(points.where("label is not null")) / block), max(1, math.ceil(total / block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda df, role: df.select(F.coalesce(F.col("id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "label", F.lit(role).alias("role"), "g", hashed("id", blocks, 4).alias("own"), *[F.col(c) for c in ("j", "u", "b")])
    used = tests.select(hashed("label", groups, 1).alias("g")).distinct()
    asking = at(tests.withColumn("g", hashed("label", groups, 1)).withColumn("j", hashed("id", parts, 2)).withColumn("u", spread(mates)).withColumn("b", spread(blocks)), 0)
    near = at(points.where("label is not null and id is not null").withColumn("g", hashed("label", groups, 1)).join(F.broadcast(used), "g").withColumn("j", spread(parts)).withColumn("u", hashed("id", mates, 3)).withColumn("b", spread(blocks)), 1)  # at most a row for each `group` tests
    every = at(points.join(F.broadcast(used), F.lit(True)).withColumn("j", spread(parts)).withColumn("u", spread(mates)).withColumn("b", hashed("id", blocks, 4)), 2)
    schema = pa.schema([("test", pa.int64()), ("ranks", pa.int64()), ("mates", pa.int64()), ("b", pa.int32())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b, role = key[3].as_py(), table["role"].to_numpy()

        def rows(k: int) -> dict:
            kept = table.filter(pa.array(role == k))
            return {"here": kept["own"].to_numpy() == b} | {c: kept[c].to_numpy() for c in ("id", "x", "y", "label")}

        out = _rank_sums(rows(0), rows(1), rows(2)) if (role == 0).any() and (role == 1).any() else []
        return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(3)] + [pa.array([b] * len(out), pa.int32())], schema=schema)

    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * groups * parts * mates * blocks)
    cells = asking.union(near).union(every).repartition(tasks, "g", "j", "u", "b")
    sums = cells.groupBy("g", "j", "u", "b").applyInArrow(run, "test long, ranks long, mates long, b int")
    # A block of class mates is ranked among every block of points, so it is counted with the first of them.
    share = sums.groupBy("test").agg(F.try_divide(F.sum("ranks"), F.sum(F.when(F.col("b") == 0, F.col("mates"))) * total).alias("m")).where("m is not null") if total else sums.groupBy("test").agg(F.lit(None).cast("double").alias("m"))
    return share.agg(F.avg("m").alias("quality"))


#: Landmarks whose own distances may be mapped at once.
MOST_LANDMARKS = 2_000


def finite_distances(distances: DataFrame, d: str = "d") -> DataFrame:
    """distances with what is null or not finite replaced by ten times the largest finite one."""
    finite = F.col(d).isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    largest = distances.where(finite).agg((10 * F.max(d)).alias("_most"))
    return distances.join(F.broadcast(largest)).withColumn(d, F.when(finite, F.col(d)).otherwise(F.col("_most"))).drop("_most")  # one row


def map_landmarks(landmark_distances: DataFrame, dims: int) -> DataFrame:
    """(landmark, dim, x): a map of landmarks by classical scaling of their distances (a, b, d), both directions given.

    There are at most MOST_LANDMARKS of them; an axis points to where its farthest landmark has a positive place.
    """
    rows = landmark_distances.select("a", "b", "d").limit(MOST_LANDMARKS**2 + 1).toPandas()
    names = sorted({*rows["a"], *rows["b"]})
    if len(names) > MOST_LANDMARKS:
        raise ValueError(f"more than {MOST_LANDMARKS} landmarks")
    place = {n: i for i, n in enumerate(names)}
    squared = np.zeros((len(names), len(names)))
    squared[[place[a] for a in rows["a"]], [place[b] for b in rows["b"]]] = rows["d"].to_numpy(float) ** 2
    inner = -0.5 * (squared - squared.mean(axis=0) - squared.mean(axis=1)[:, None] + squared.mean())
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:dims]
    x = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1)
    cells = [(int(n), k, float(x[i, k])) for i, n in enumerate(names) for k in range(x.shape[1])]
    return landmark_distances.sparkSession.createDataFrame(cells, "landmark long, dim int, x double")


def triangulate(positions: DataFrame, landmark_distances: DataFrame, distances: DataFrame, replace: float | None = None) -> DataFrame:
    """(point, dim, x): points placed by their distances to landmarks that have a place.

    `positions` is (landmark, dim, x), `landmark_distances` (a, b, d) in both directions, `distances` (point, landmark, d).
    Landmark places are centred; an axis is scaled by the eigenvalue that the landmarks' own distances give it.
    Infinite or missing distances become `replace`, by default ten times the largest finite one.
    """
    mean = Window.partitionBy("dim")
    centred = positions.withColumn("x", F.col("x") - F.avg("x").over(mean))
    squared = landmark_distances.where("a <> b").select("a", "b", (F.col("d") * F.col("d")).alias("d2"))
    count = positions.agg(F.count_distinct("landmark").alias("n"))
    spread = squared.groupBy(F.col("a").alias("landmark")).agg(F.sum("d2").alias("d2")).join(F.broadcast(count)).select("landmark", (F.col("d2") / F.col("n")).alias("du"))
    left = centred.select(F.col("landmark").alias("a"), "dim", F.col("x").alias("xa"))
    right = centred.select(F.col("landmark").alias("b"), F.col("dim").alias("_dim"), F.col("x").alias("xb"))
    above = squared.join(left, "a").join(right, "b").where("dim = _dim").groupBy("dim").agg(F.sum(F.col("xa") * F.col("xb") * F.col("d2")).alias("above"))
    axis = centred.groupBy("dim").agg(F.sum(F.col("x") * F.col("x")).alias("below")).join(above, "dim").select("dim", (-0.5 * F.try_divide("above", "below")).alias("eigenvalue"))
    finite = F.col("d").isNotNull() & ~F.isnan("d") & (F.abs("d") < float("inf"))
    if replace is None:
        largest = distances.where(finite).agg((10 * F.max("d")).alias("_most"))
        distances = distances.join(F.broadcast(largest))
    else:
        distances = distances.withColumn("_most", F.lit(float(replace)))
    told = distances.withColumn("d", F.when(finite, F.col("d")).otherwise(F.col("_most"))).join(spread, "landmark")
    pulled = told.join(centred, "landmark").groupBy("point", "dim").agg(F.sum(F.col("x") * (F.col("d") * F.col("d") - F.col("du"))).alias("s"))
    return pulled.join(axis, "dim").select("point", "dim", (-0.5 * F.try_divide("s", "eigenvalue")).alias("x"))
