"""Iterative fits over all rows, with only sums of bounded size on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.session import cut


def fit_widths(words: DataFrame, tolerance: float = 1e-6, max_rounds: int = 1_000) -> DataFrame:
    """(ch, width, n): the width of each character, and '' for a word's end, that best explain words (text, width).

    A word's error, the sum of its characters' widths and an end's less its width, is shared equally by its
    characters and its end; a character's error is the mean of its shares. The fit lessens the sum over words of
    error^2 / (characters + 1), whose least value has all characters' errors zero. Each round measures every
    word once and sums by character; steps are conjugate to those before, so far fewer rounds are needed than
    by taking each error off at once. It ends when no character's error is above `tolerance` times the
    mean width; with max_rounds it raises.

    A word is held by its distinct characters and their numbers; equal ones of equal width are one weighted word. Widths start at the mean width of a character; where words leave
    some combination of widths open, it keeps its start. Words with a null text or a null or not finite width take
    no part; an empty text has only its end. The driver holds one number a character, of at most Unicode's.
    """
    sound = F.col("width").isNotNull() & ~F.isnan("width") & (F.abs("width") < float("inf"))
    given = words.select("text", F.col("width").cast("double").alias("width")).where(F.col("text").isNotNull() & sound)

    def packed(batches):
        for pdf in batches:
            found = [np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32), return_counts=True) for t in pdf["text"]]
            yield pd.DataFrame({"codes": [c for c, _ in found], "times": [n.astype(np.int32) for _, n in found], "width": pdf["width"].to_numpy()})

    each = given.mapInPandas(packed, "codes array<int>, times array<int>, width double")
    rows = cut(each.groupBy("codes", "times", "width").agg(F.count("*").alias("m")))
    letters = rows.select("m", F.explode(F.arrays_zip("codes", "times")).alias("x")).groupBy("x.codes").agg(F.sum(F.col("x.times") * F.col("m")).alias("n")).orderBy("codes").toPandas()
    ends = rows.agg(F.sum("m")).first()[0]
    if not ends:
        return words.sparkSession.createDataFrame([], "ch string, width double, n long")
    codes = letters["codes"].to_numpy(np.int32)
    n = np.append(letters["n"].to_numpy(float), ends)

    def shares(along: np.ndarray, target: bool) -> np.ndarray:
        """By character, the end last, the summed shares of what words measure along a direction, less their widths if asked."""

        def run(batches):
            total = np.zeros(len(along))
            for pdf in batches:
                lists, times = pdf["codes"].to_numpy(), pdf["times"].to_numpy()
                at = np.searchsorted(codes, np.concatenate([np.zeros(0, dtype=np.int32), *lists]))
                times = np.concatenate([np.zeros(0), *times])
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                sums = lambda x: np.bincount(row, x, len(lists))  # noqa: B023, E731
                error = sums(along[at] * times) + along[-1] - (pdf["width"].to_numpy() if target else 0)
                share = error / (sums(times) + 1) * pdf["m"].to_numpy()
                total[:-1] += np.bincount(at, times * share[row], len(codes))
                total[-1] += share.sum()
            some = np.flatnonzero(total)
            yield pd.DataFrame({"i": some, "x": total[some]})

        cells = rows.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        out = np.zeros(len(along))
        out[cells["i"].to_numpy(int)] = cells["x"]
        return out

    mean = rows.agg(F.sum(F.col("width") * F.col("m"))).first()[0] / n.sum()
    widths = np.full(len(n), float(mean))
    left = -shares(widths, True)
    errors = left / n
    along = errors.copy()
    for _ in range(max_rounds):
        if np.abs(errors).max() <= tolerance * max(abs(mean), 1e-300):
            break
        measured = shares(along, False)
        before = left @ errors
        step = before / max(along @ measured, 1e-300)
        widths, left = widths + step * along, left - step * measured
        errors = left / n
        along = errors + (left @ errors) / before * along
    else:
        raise RuntimeError(f"errors are still above the tolerance after {max_rounds} rounds")
    out = [(c, float(w), int(k)) for c, w, k in zip([*map(chr, codes.tolist()), ""], widths, n, strict=True)]
    return words.sparkSession.createDataFrame(out, "ch string, width double, n long")


#: Points that meet in one block of a round.
MEET = 256

SUMS = ("n", "d", "e", "dd", "ee", "de")
_MAPPED = "id long, p array<double>, n long, d double, e double, dd double, ee double, de double"


def _round(now: dict[str, float] | None, pace: float):
    """One round in one block: points moved by their partners, and the sums of the moved block's distances."""

    def far(x: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        v, p = np.stack(pdf["v"].to_numpy()).astype(float), np.stack(pdf["p"].to_numpy()).astype(float)
        e = far(v)
        if now is not None and len(p) > 1:
            d = far(p)
            pull = ((e - now["e"]) * now["dd"] - (d - now["d"]) * now["de"]) / np.maximum(d, 1e-9)
            np.fill_diagonal(pull, 0.0)
            move = (pull[:, :, None] * (p[:, None, :] - p[None])).sum(axis=1)
            size = np.sqrt((move**2).sum(axis=1, keepdims=True))
            p = p + pace * now["d"] * move / np.maximum(size.mean() + size, 1e-300)
        upper = np.triu_indices(len(p), 1)
        x, y = far(p)[upper], e[upper]
        out = pd.DataFrame({"id": pdf["id"].to_numpy(), "p": list(p)})
        for name, value in zip(SUMS, (len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y), strict=True):
            out[name] = np.where(np.arange(len(p)) == 0, value, 0)
        return out

    return run


def correlation_map(points: DataFrame, start: DataFrame, rounds: int = 60, rate: float = 0.2, annealed_from: float = 0.5, meet: int = MEET, seed: int = 42) -> tuple[DataFrame, float]:
    """((id, p), r): places p for points (id, v) whose distances correlate with those of v, from a start (id, p).

    In each round points are dealt into blocks of about `meet` by a digest of seed, round and id, so each meets other
    partners; within its block a point moves along the gradient of the correlation r of distances, with the sums that the
    round before has measured over all blocks. Moves shrink linearly once `annealed_from` of the rounds are over. Places
    are a table that every round rewrites; the driver holds six sums. They are added as decimals, and blocks are
    sorted by id, so partitioning does not change the result. r is that of the last round's pairs.
    Points without a vector or a start are left out.
    """
    state = cut(points.where("v is not null").select("id", "v").join(start.where("p is not null").select("id", "p"), "id"))
    total = state.count()
    blocks = max(1, round(total / meet))
    known: dict[str, float] | None = None
    r = float("nan")
    for t in range(rounds + 1):  # the first only measures
        share = 1.0 if t <= annealed_from * rounds else (rounds - t) / max(1e-9, (1 - annealed_from) * rounds)
        run = _round(known, rate * share)
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit(t), "id"), F.lit(blocks))
        moved = cut(state.withColumn("block", block).groupBy("block").applyInPandas(run, _MAPPED))
        s = moved.agg(*[F.sum(F.col(c).cast("decimal(38,12)")).alias(c) for c in SUMS]).first()
        n, d, e, dd, ee, de = (float(s[c] or 0) for c in SUMS)
        if n:
            known = {"d": d / n, "e": e / n, "dd": dd / n - (d / n) ** 2, "de": de / n - d / n * e / n}
            r = known["de"] / max(1e-300, (known["dd"] * (ee / n - (e / n) ** 2)) ** 0.5)
        state = cut(state.select("id", "v").join(moved.select("id", "p"), "id"))
    return state.select("id", "p"), r
