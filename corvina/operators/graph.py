"""Similarity graphs: symmetric edges, shortest paths, landmarks, growing of playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.session import cut, stored


def symmetrise(edges: DataFrame) -> DataFrame:
    """(a, b, rating) in both directions, averaged, without self-loops."""
    both = edges.select("a", "b", "rating").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "rating"))
    return both.where("a <> b").groupBy("a", "b").agg(F.avg("rating").alias("rating"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, distance, previous) from the nearest source, over edges (a, b, cost) with costs of zero or more.

    Each round relaxes the edges out of the nodes that came nearer in the last one, until none does; a path of
    n hops takes n rounds. Where max_rounds is given and nodes still come nearer after it, it raises. Rounds are
    cut from their history by checkpoints, in the folder that the cluster names; unreachable nodes are absent. Edges
    are made once, however many rounds read them.
    """
    edges = cut(edges.select("a", "b", "cost"))
    if not edges.where("cost < 0").isEmpty():
        raise ValueError("costs must be zero or more")
    best = sources.select(F.col("node"), F.lit(0.0).alias("distance"), F.lit(-1).cast("long").alias("previous")).distinct()
    front = best
    done = 0
    while True:
        step = front.join(edges, front["node"] == edges["a"]).select(F.col("b").alias("node"), (F.col("distance") + F.col("cost")).alias("distance"), F.col("a").cast("long").alias("previous"))
        step = step.groupBy("node").agg(F.min(F.struct("distance", "previous")).alias("x")).select("node", "x.*")
        old = best.select("node", F.col("distance").alias("old"))
        nearer = cut(step.join(old, "node", "left").where("old IS NULL OR distance < old").drop("old"))
        if nearer.isEmpty():
            return best
        if done == max_rounds:
            raise RuntimeError(f"nodes still come nearer after {max_rounds} rounds")
        done += 1
        best = best.union(nearer).groupBy("node").agg(F.min(F.struct("distance", "previous")).alias("x")).select("node", "x.*")
        best = cut(best) if done % 3 == 0 else best
        front = nearer


def distances_from_each(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(landmark, node, distance) of all nodes that each landmark (column landmark) reaches over edges (a, b, cost).

    One relaxation for all of them: a round carries the (landmark, node) pairs that came nearer in the last one, so
    it takes as many rounds as the longest of the cheapest paths has hops. Pairs without a path are absent.
    """
    if not edges.where("cost < 0").isEmpty():
        raise ValueError("costs must be zero or more")
    cheapest = cut(edges.where("a is not null and b is not null and a <> b").groupBy("a", "b").agg(F.min("cost").alias("cost")))
    best = cut(landmarks.select(F.col("landmark").cast("long")).distinct().select("landmark", F.col("landmark").alias("node"), F.lit(0.0).alias("distance")))
    front, rounds = best, 0
    while True:
        step = front.join(cheapest, front["node"] == cheapest["a"]).groupBy("landmark", F.col("b").cast("long").alias("node")).agg(F.min(F.col("distance") + F.col("cost")).alias("distance"))
        old = best.select("landmark", "node", F.col("distance").alias("old"))
        front = cut(step.join(old, ["landmark", "node"], "left").where("old is null or distance < old").drop("old"))
        if front.isEmpty():
            return best
        rounds += 1
        best = best.union(front).groupBy("landmark", "node").agg(F.min("distance").alias("distance"))
        best = cut(best) if rounds % 3 == 0 else best


class LandmarkTable:
    """Landmarks of a graph of edges (a, b, cost) and the distances of all nodes from each, which later ones reuse."""

    def __init__(self, edges: DataFrame) -> None:
        self.edges = cut(edges)
        self.chosen: list[int] = []
        self.table: DataFrame | None = None
        self.nearest: DataFrame | None = None

    def add(self, nodes: list[int]) -> None:
        """Take further landmarks: only paths from these are looked for."""
        new = distances_from_each(self.edges, self.edges.sparkSession.createDataFrame([(n,) for n in nodes], "landmark long"))
        self.table = cut(new if self.table is None else self.table.union(new))
        near = new.select("node", "distance") if self.nearest is None else self.nearest.union(new.select("node", "distance"))
        self.nearest = cut(near.groupBy("node").agg(F.min("distance").alias("distance")))
        self.chosen += nodes

    def add_random(self, count: int, seed: int) -> None:
        """Take the first `count` nodes that are none yet, in an order drawn by the seed, all in one relaxation."""
        nodes = self.edges.select(F.col("a").cast("long").alias("node")).union(self.edges.select(F.col("b").cast("long"))).where("node is not null").distinct()
        drawn = nodes.where(~F.col("node").isin(self.chosen) if self.chosen else F.lit(True)).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "node"), 256), "node").limit(count)
        if picked := [r["node"] for r in drawn.collect()]:
            self.add(picked)

    def add_farthest(self, count: int) -> None:
        """Take `count` nodes one by one, each the farthest from its nearest landmark, the smallest of equals."""
        for _ in range(count):
            far = self.nearest.where("distance > 0").orderBy(F.col("distance").desc(), "node").first()
            if far is None:
                return
            self.add([far["node"]])

    def complete(self) -> DataFrame:
        """(node, landmark, distance) of every node and landmark; infinite where there is no path."""
        nodes = self.edges.select(F.col("a").cast("long").alias("node")).union(self.edges.select(F.col("b").cast("long"))).where("node is not null").distinct()
        every = nodes.withColumn("landmark", F.explode(F.array(*[F.lit(n).cast("long") for n in self.chosen])))
        return every.join(self.table, ["node", "landmark"], "left").select("node", "landmark", F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def landmarks(edges: DataFrame, first: int, count: int) -> list[int]:
    """Landmarks, each the node farthest from those before it; the list is as short as `count`."""
    made = LandmarkTable(edges)
    made.add([first])
    made.add_farthest(count - 1)
    return made.chosen


def all_pairs(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(a, b, cost) of the cheapest paths between all nodes of (a, b, cost) that one can reach from the other.

    Each round joins the paths found so far with themselves, which doubles their length; the result has as many rows
    as there are reachable pairs. Rounds are cut from their history as in shortest_paths.
    """
    nodes = edges.select("a").union(edges.select("b")).distinct()
    paths = edges.select("a", "b", "cost").union(nodes.select("a", F.col("a").alias("b"), F.lit(0.0).alias("cost"))).groupBy("a", "b").agg(F.min("cost").alias("cost"))
    total = None
    for _ in range(max_rounds):
        second = paths.select(F.col("a").alias("_mid"), F.col("b").alias("_end"), F.col("cost").alias("_more"))
        longer = paths.join(second, F.col("b") == F.col("_mid")).groupBy("a", F.col("_end").alias("b")).agg(F.min(F.col("cost") + F.col("_more")).alias("cost"))
        paths = cut(longer)
        now = tuple(paths.agg(F.count("*"), F.sum("cost")).first())
        if now == total:
            break
        total = now
    return paths


def chains(rows: DataFrame) -> DataFrame:
    """(id, n, root) from (id, parent): the rows on the way to the root, itself included, and the root.

    Pointer doubling: each round every row skips to its ancestor's ancestor, so a chain of n rows takes log2(n)
    joins. A null parent ends a chain; a parent that is no row does too, without being counted. Rows on a
    cycle have no root and are left out.
    """
    own = rows.select(F.col("id").alias("_id"))
    linked = rows.join(own, rows["parent"] == F.col("_id"), "left").select("id", F.col("_id").alias("up"))
    at = cut(linked.select("id", "up", F.lit(1).cast("long").alias("n"), F.coalesce("up", "id").alias("root")))
    open_rows = at.where("up is not null").count()
    done = 1
    while open_rows and done <= 2 * at.count():
        above = at.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("n").alias("_n"), F.col("root").alias("_root"))
        at = cut(at.join(above, "up", "left").select("id", F.col("_up").alias("up"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("_root", "root").alias("root")))
        open_rows, done = at.where("up is not null").count(), done * 2
    return at.where("up is null").select("id", "n", "root")


def split_edges(edges: DataFrame) -> DataFrame:
    """Edges with `part`: test, verify or train for a tenth, a tenth and the rest, by a digest of the unordered pair."""
    name = F.concat_ws("-", F.least("a", "b"), F.greatest("a", "b"))
    tenth = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % 10
    return edges.withColumn("part", F.when(tenth == 0, "test").when(tenth == 1, "verify").otherwise("train"))


def triangles(edges: DataFrame) -> DataFrame:
    """One row (triangles, violations) of undirected (a, b, d): a violation is a triangle with a side longer than the others.

    Each edge points from the node of fewer edges to that of more, so a node of many edges starts few pairs.
    """
    lone = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
    degree = lone.select("a").union(lone.select("b")).groupBy("a").agg(F.count("*").alias("deg"))
    ranked = lone.join(degree, "a").withColumnRenamed("deg", "deg_a").join(degree.select(F.col("a").alias("b"), F.col("deg").alias("deg_b")), "b")
    forward = F.struct("deg_a", "a") < F.struct("deg_b", "b")
    out = ranked.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("y"), "d")
    second = out.select("x", F.col("y").alias("z"), F.col("d").alias("d2"))
    pairs = out.join(second, "x").where("y < z")
    third = lone.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("d").alias("d3"))
    longest = F.greatest("d", "d2", "d3")
    found = pairs.join(third, ["y", "z"])
    return found.agg(F.count("*").alias("triangles"), F.coalesce(F.sum((2 * longest > F.col("d") + F.col("d2") + F.col("d3")).cast("long")), F.lit(0)).alias("violations"))


def grow_playlists(seeds: DataFrame, similar: DataFrame, known: DataFrame, max_results: int = 100, known_target: int = 50) -> DataFrame:
    """(playlist, place, track, cost, hops, known): the tracks that a best-first search takes from each playlist's seeds.

    seeds is (playlist, track), similar (track, other, rank) with ranks from 0, known (track) the tracks at hand. A track
    costs (rank + sum over its seeds of (tracks found from the seed + 50)) / n ** 1.5, n being the seeds that led to it; ties
    go to the smaller track. All playlists take one track a round, by a join with its list, until each has
    max_results, known_target known ones, or none waiting. An `other` that stands twice in a list counts at its smaller
    rank; seeds with a null are left out. State is two tables, of tracks and of (seed, track) pairs, that joins and
    sums carry on; no group is gathered.
    """
    at_hand = known.select("track", F.lit(True).alias("_known")).distinct()
    lists = stored(similar.groupBy(F.col("track").alias("now"), F.col("other").cast("long").alias("track")).agg(F.min("rank").alias("rank")))
    start = seeds.select(F.col("playlist").cast("long"), F.col("track").cast("long")).dropna().distinct()
    tracks = stored(start.select("playlist", "track", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(True).alias("waiting"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("known")))
    led = start.select("playlist", F.col("track").alias("seed"), "track").limit(0)
    while True:
        standing = tracks.groupBy("playlist").agg(
            F.count_if(F.col("place") > 0).alias("taken"),
            F.count_if((F.col("place") > 0) & F.col("known")).alias("reached"),
            F.min(F.when(F.col("waiting"), F.struct("cost", "track", "hops"))).alias("best"),
        )
        going = standing.where((F.col("taken") < max_results) & (F.col("reached") < known_target) & F.col("best").isNotNull())
        top = stored(going.select("playlist", "taken", F.col("best.track").alias("now"), F.col("best.hops").alias("depth")))
        if top.isEmpty():
            return tracks.where("place > 0").select("playlist", F.col("place").cast("int").alias("place"), "track", "cost", "hops", "known")
        found = top.join(lists, "now").select("playlist", "track", "rank", "depth")
        origin = led.join(top.select("playlist", F.col("now").alias("track")), ["playlist", "track"]).select("playlist", "seed")
        origin = origin.union(top.where("depth = 0").select("playlist", F.col("now").alias("seed"))).distinct()
        # Every found track now has every seed of the taken one; those it did not have count for the tracks behind it.
        pairs = found.join(origin, "playlist").join(led.withColumn("old", F.lit(True)), ["playlist", "seed", "track"], "left")
        so_far = Window.partitionBy("playlist", "seed").orderBy("rank", "track").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pairs = stored(pairs.select("playlist", "seed", "track", F.col("old").isNull().alias("fresh"), F.sum(F.col("old").isNull().cast("long")).over(so_far).alias("more")))
        others = led.join(found.select("playlist", "track"), ["playlist", "track"]).select("playlist", "seed", "track", F.lit(0).cast("long").alias("more"))
        itself = tracks.where("hops = 0").join(found.select("playlist", "track"), ["playlist", "track"]).select("playlist", F.col("track").alias("seed"), "track", F.lit(0).cast("long").alias("more"))
        seeds_of = pairs.drop("fresh").union(others).union(itself).groupBy("playlist", "seed", "track").agg(F.max("more").alias("more"))
        met = led.groupBy("playlist", "seed").agg(F.count("*").alias("met"))
        sums = seeds_of.join(met, ["playlist", "seed"], "left").groupBy("playlist", "track").agg(F.sum(F.coalesce("met", F.lit(0)) + F.col("more") + 50).alias("weight"), F.count("*").alias("n"))
        price = (F.col("rank") + F.col("weight")) / F.pow("n", F.lit(1.5))
        priced = found.join(sums, ["playlist", "track"]).join(at_hand, "track", "left").select("playlist", "track", price.alias("price"), (F.col("depth") + 1).alias("next"), "_known")
        marked = tracks.join(top.select("playlist", "taken", F.col("now").alias("track"), F.lit(True).alias("chosen")), ["playlist", "track"], "left").join(priced, ["playlist", "track"], "full")
        chosen, new = F.col("chosen").isNotNull(), F.col("waiting").isNull()
        open_still = F.col("waiting") & ~chosen & F.col("price").isNotNull()
        tracks = stored(
            marked.select(
                "playlist",
                "track",
                F.when(new | open_still, F.col("price")).otherwise(F.col("cost")).alias("cost"),
                F.when(new | open_still, F.least("hops", "next")).otherwise(F.col("hops")).alias("hops"),
                (new | (F.col("waiting") & ~chosen)).alias("waiting"),
                F.when(chosen & (F.col("hops") > 0), F.col("taken") + 1).otherwise(F.coalesce("place", F.lit(0))).alias("place"),
                F.when(new, F.coalesce("_known", F.lit(False))).otherwise(F.col("known")).alias("known"),
            )
        )
        led = stored(led.union(pairs.where("fresh").select("playlist", "seed", "track")))
