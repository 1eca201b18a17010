"""Cluster bootstrap and paired permutation test.

Draws come from one NumPy generator, bootstrap first, signs after, in replicate-major order; the rest is joins and aggregates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _placed(totals: DataFrame) -> DataFrame:
    """Clusters numbered in key order. Clusters are report units, so there are few."""
    return totals.withColumn("k", F.row_number().over(Window.orderBy("cluster")) - 1)


def bootstrap(totals: DataFrame, replicates: int = 5000, seed: int = 7, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(mean, low, high) of the pooled mean over resampled clusters; totals has (cluster, total, n)."""
    placed = _placed(totals)
    n = placed.count()
    rng = np.random.default_rng(seed)
    draws = np.stack([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(replicates)])
    times = totals.sparkSession.createDataFrame([(k, draws[:, k].tolist()) for k in range(n)], "k int, times array<int>")
    each = placed.join(F.broadcast(times), "k").select("total", "n", F.posexplode("times").alias("rep", "c"))
    reps = each.groupBy("rep").agg((F.sum(F.col("total") * F.col("c")) / F.sum(F.col("n") * F.col("c"))).alias("x"))
    interval = reps.agg(F.percentile("x", F.lit(low)).alias("low"), F.percentile("x", F.lit(high)).alias("high"))
    mean = totals.agg((F.sum("total") / F.sum("n")).alias("mean"))
    return mean.join(F.broadcast(interval))


def permutation(totals: DataFrame, replicates: int = 5000, seed: int = 7) -> DataFrame:
    """(observed, hits, p) of the two-sided sign-flip test on cluster totals."""
    placed = _placed(totals)
    n = placed.count()
    rng = np.random.default_rng(seed)
    for _ in range(replicates):  # the bootstrap's draws come first from the same generator
        rng.integers(0, n, n)
    signs = rng.choice([-1, 1], size=(replicates, n))
    flips = totals.sparkSession.createDataFrame([(k, signs[:, k].tolist()) for k in range(n)], "k int, signs array<int>")
    observed = placed.agg(F.abs(F.sum("total")).alias("observed"))
    each = placed.join(F.broadcast(flips), "k").select("total", F.posexplode("signs").alias("rep", "s"))
    reps = each.groupBy("rep").agg(F.abs(F.sum(F.col("total") * F.col("s"))).alias("x"))
    out = reps.join(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.count(F.when(F.col("x") >= F.col("observed"), 1)).alias("hits"))
    return out.withColumn("p", (F.col("hits") + 1) / F.lit(replicates + 1))
