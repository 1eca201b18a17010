"""Landmarks and fingerprints of audio tracks: one vectorised call per track and shift."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.config import DEFAULT, Config
from larkspan.functions.columns import descriptor_in_range, pack_descriptor, probes
from larkspan.functions.delaunay import triangulate
from larkspan.operators import geometry

STAGES = ("original", "two_hop")


def audio_landmarks(audio: DataFrame, config: Config = DEFAULT, shifts: int = 1, analysis: Callable | None = None, magnitude: bool = False) -> DataFrame:
    """(track, shift, f, t, score) of (track, samples). ``analysis(samples, config, shift)`` may replace the built-in kernel."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from larkspan.functions.signal import landmarks

        for batch in batches:
            for track, samples in zip(batch.column(0), batch.column(1), strict=True):
                x = np.asarray(samples.values.to_numpy(zero_copy_only=False), np.int16)
                for shift in range(shifts):
                    found = analysis(x, config, shift) if analysis else landmarks(x, config, shift, magnitude)
                    f, t, s = zip(*found, strict=True) if found else ((), (), ())
                    n = len(found)
                    yield pa.record_batch(
                        [pa.array([track.as_py()] * n, pa.string()), pa.array([shift] * n, pa.int32()), pa.array(f, pa.int32()), pa.array(t, pa.int32()), pa.array(s, pa.float64())],
                        ["track", "shift", "f", "t", "score"],
                    )

    return audio.select("track", "samples").mapInArrow(run, "track string, shift int, f int, t int, score double")


def delaunay_faces(points: DataFrame) -> DataFrame:
    """(track, i1, i2, i3): the full triangulation of every track's indexed landmarks."""
    import pandas as pd

    kind = points.schema["track"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        faces = triangulate([(5 * int(t), 7 * int(f)) for f, t in zip(rows["f"], rows["t"], strict=True)])
        out = pd.DataFrame(sorted(faces), columns=["i1", "i2", "i3"], dtype="int32")
        out.insert(0, "track", rows["track"].iloc[0])
        return out

    return points.select("track", "i", "f", "t").groupBy("track").applyInPandas(run, f"track {kind}, i1 int, i2 int, i3 int")


def fingerprints(marks: DataFrame, config: Config = DEFAULT, radius: int = 0, stage: str = "original") -> DataFrame:
    """Distinct (track, hash, offset) over all shifts of (track, shift, f, t, score)."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage!r}")
    best = marks.groupBy("track", "shift", "f", "t").agg(F.max("score").alias("score"))
    keyed = best.withColumn("track", F.concat_ws("#", "track", "shift")).drop("shift")
    points = geometry.indexed(keyed)
    full = delaunay_faces(points)
    for k in "123":
        full = full.join(points.select("track", *[F.col(c).alias(f"{n}{k}") for c, n in (("i", "i"), ("f", "f"), ("t", "t"))]), ["track", f"i{k}"])
    faces = geometry.measured(full).where(geometry.valid(config.triangles))
    columns = ["track", "f1", "t1", "f2", "t2", "f3", "t3"]
    found = faces.select(*columns)
    if stage == "two_hop":
        found = found.unionByName(geometry.two_hop(full, points, config.triangles).select(*columns))
    values = geometry.descriptor(config.triangles)
    each = found.select(F.regexp_replace("track", "#[0-9]+$", "").alias("track"), F.col("t1").alias("offset"), F.explode(probes(values, radius)).alias("v"))
    parts = [F.col("v")[k] for k in range(5)]
    return each.where(descriptor_in_range(*parts)).select("track", pack_descriptor(*parts).alias("hash"), F.col("offset").cast("int").alias("offset")).distinct()
