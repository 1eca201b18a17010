"""Order-dependent selections, one track at a time in pandas.

A track is one recording or one user's history: the unit that the state belongs to.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.config import Triangles
from larkspan.operators import geometry


def select_dense(points: list[tuple[int, int, float]], capacity, window: float) -> list[tuple[int, int, float]]:
    """Candidates (f, t, score) that pass, best first: in no window that holds the candidate may ``capacity(t)`` others have been selected.

    Times are whole frames, so a window is known by its first frame. ``load`` holds, for every window, how many selected points lie in it.
    """
    if not points:
        return []
    f, t, score = (np.array(c) for c in zip(*points, strict=True))
    reach = int(window)  # a frame lies in the windows that begin up to ``reach`` frames before it
    load = np.zeros(int(t.max() - t.min()) + reach + 1, np.int64)
    at = t - t.min()
    kept = []
    for k in np.lexsort((f, t, -score)):
        windows = load[at[k] : at[k] + reach + 1]
        if windows.max() < capacity(t[k]):
            windows += 1
            kept.append(points[k])
    return kept


def density_selection(landmarks: DataFrame, rate: float, window: float) -> DataFrame:
    """Greedy selection per track with a constant capacity of rate * window, one at least."""
    limit = max(1, round(rate * window))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        points = list(zip(rows["f"].tolist(), rows["t"].tolist(), rows["score"].tolist(), strict=True))
        kept = select_dense(points, lambda _: limit, window)
        out = pd.DataFrame(kept, columns=["f", "t", "score"])
        out.insert(0, "track", rows["track"].iloc[0])
        return out

    return landmarks.select("track", "f", "t", "score").groupBy("track").applyInPandas(run, "track long, f int, t int, score double")


def within_budget(triples: np.ndarray, budget: int) -> np.ndarray:
    """Which rows (i1, i2, i3) pass in lexicographic order, if every point may be used ``budget`` times."""
    left = np.full(int(triples.max(initial=-1)) + 1, budget, np.int64)
    passed = np.zeros(len(triples), bool)
    for row in np.lexsort(triples.T[::-1]):
        own = triples[row]
        if left[own].all():
            left[own] -= 1
            passed[row] = True
    return passed


def target_region(points: DataFrame, budget: int, t: Triangles = Triangles(), frames: int = 12, bins: int = 128) -> DataFrame:
    """(track, i1, i2, i3): valid triangles of two steps of 1 to ``frames`` frames and 1 to ``bins`` bins each, in index order as far as the
    points' budgets go. The steps and triangles are joins; only the budget looks at a track as a whole."""
    steps = geometry.time_pairs(points, 1, frames).where(F.abs(F.col("f2") - F.col("f1")).between(1, bins))
    second = steps.select("track", F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("f2").alias("f3"), F.col("t2").alias("t3"))
    found = geometry.measured(steps.join(second, ["track", "i2"])).where(geometry.valid(t))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[within_budget(rows[["i1", "i2", "i3"]].to_numpy(np.int64), budget)]

    return found.select("track", "i1", "i2", "i3").groupBy("track").applyInPandas(run, "track long, i1 int, i2 int, i3 int")
