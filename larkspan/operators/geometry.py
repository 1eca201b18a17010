"""Landmark triangles on an integer lattice.

With the frequency scale 10 and the time scale 14, a landmark (f, t) lies at (5 t, 7 f) / 70, so lengths, areas, circumradii and
in-circle tests are integer arithmetic. All bounds below are in units of 1/70.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.config import Triangles

UNIT = 70


def indexed(landmarks: DataFrame) -> DataFrame:
    """Add i: the place of a landmark in (t, f, -score) order within its track."""
    order = Window.partitionBy("track").orderBy("t", "f", F.col("score").desc())
    return landmarks.withColumn("i", (F.row_number().over(order) - 1).cast("int"))


def local_maxima(landmarks: DataFrame, radius_f: int = 2, radius_t: int = 3) -> DataFrame:
    """Landmarks that no other in the box around them exceeds; of equals, the first in (t, f) order."""
    width = radius_t + 1
    other = landmarks.select("track", F.col("f").alias("g"), F.col("t").alias("u"), F.col("score").alias("z"))
    other = other.withColumn("b", F.explode(F.array(*[F.floor((F.col("u") + s * radius_t) / width) for s in (-1, 0, 1)]))).distinct()
    own = landmarks.withColumn("b", F.floor(F.col("t") / width))
    higher = (F.col("z") > F.col("score")) | ((F.col("z") == F.col("score")) & (F.struct("u", "g") < F.struct("t", "f")))
    near = (F.abs(F.col("u") - F.col("t")) <= radius_t) & (F.abs(F.col("g") - F.col("f")) <= radius_f)
    cond = (own["track"] == other["track"]) & (own["b"] == other["b"]) & near & higher
    return own.join(other, cond, "left_anti").drop("b")


def time_pairs(points: DataFrame, low: int, high: int, extra=None) -> DataFrame:
    """(track, i, j, ...): points j after i in index order with low <= t_j - t_i <= high, by time buckets."""
    width = high + 1
    a = points.select("track", *[F.col(c).alias(f"{c}1") for c in ("i", "f", "t", "score")])
    a = a.withColumn("b", F.explode(F.array(F.floor(F.col("t1") / width), F.floor(F.col("t1") / width) + 1)))
    b = points.select("track", *[F.col(c).alias(f"{c}2") for c in ("i", "f", "t", "score")]).withColumn("b", F.floor(F.col("t2") / width))
    out = a.join(b, ["track", "b"]).where((F.col("i2") > F.col("i1")) & (F.col("t2") - F.col("t1")).between(low, high)).drop("b")
    return out if extra is None else out.where(extra)


def _square(f1, t1, f2, t2):
    dx, dy = (F.col(t2) - F.col(t1)) * 5, (F.col(f2) - F.col(f1)) * 7
    return (dx * dx + dy * dy).cast("long")


def measured(triples: DataFrame) -> DataFrame:
    """Add the integers e1, e2, e3 (squared edges), cross (twice the area) and span (frames) to triples."""
    cross = F.abs((F.col("t2") - F.col("t1")) * (F.col("f3") - F.col("f1")) - (F.col("t3") - F.col("t1")) * (F.col("f2") - F.col("f1"))).cast("long") * 35
    return (
        triples.withColumn("e1", _square("f1", "t1", "f2", "t2")).withColumn("e2", _square("f1", "t1", "f3", "t3"))
        .withColumn("e3", _square("f2", "t2", "f3", "t3")).withColumn("cross", cross)
        .withColumn("span", F.greatest("t1", "t2", "t3") - F.least("t1", "t2", "t3"))
    )


def valid(t: Triangles = Triangles()):
    """The triangle rules on a measured triple."""
    edge, radius = round(t.max_edge * UNIT), round(t.max_radius * UNIT)
    inside = F.col("cross") * 2 * radius
    return (
        F.col("span").between(t.min_span, t.max_span) & (F.col("cross") >= 2 * t.min_area * UNIT * UNIT)
        & (F.greatest("e1", "e2", "e3") <= edge * edge) & (F.col("e1") * F.col("e2") * F.col("e3") <= inside * inside)
    )


def quality():
    """4 sqrt(3) area / sum of squared edges."""
    return F.lit(2 * 3**0.5) * F.col("cross") / (F.col("e1") + F.col("e2") + F.col("e3"))


def circumradius():
    return F.sqrt((F.col("e1") * F.col("e2") * F.col("e3")).cast("double")) / (F.col("cross") * 2) / UNIT


def triples(points: DataFrame, t: Triangles = Triangles()) -> DataFrame:
    """Valid triangles of a track's landmarks, as i1 < i2 < i3 with coordinates and measures."""
    edge = round(t.max_edge * UNIT)
    pairs = time_pairs(points, 0, t.max_span).where(_square("f1", "t1", "f2", "t2") <= edge * edge)
    third = pairs.select("track", "i1", F.col("i2").alias("i3"), F.col("f2").alias("f3"), F.col("t2").alias("t3"), F.col("score2").alias("score3"))
    return measured(pairs.join(third, ["track", "i1"]).where("i3 > i2")).where(valid(t))


def empty_faces(found: DataFrame, points: DataFrame, t: Triangles = Triangles()) -> DataFrame:
    """Triangles with no landmark strictly inside their circumcircle: the Delaunay faces among valid
    triangles; of landmarks on one circle all triangles are kept."""
    reach = int(2 * t.max_radius * UNIT / 5) + 1
    p = points.select("track", F.col("f").alias("g"), F.col("t").alias("u"))
    p = p.withColumn("b", F.explode(F.array(*[F.floor(F.col("u") / reach) + s for s in (-1, 0, 1)])))
    own = found.withColumn("b", F.floor(F.col("t1") / reach))
    rows = []
    for k in "123":
        dx, dy = (F.col(f"t{k}") - F.col("u")).cast("long") * 5, (F.col(f"f{k}") - F.col("g")).cast("long") * 7
        rows.append((dx, dy, dx * dx + dy * dy))
    (ax, ay, a2), (bx, by, b2), (cx, cy, c2) = rows
    det = ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx)
    turn = (F.col("t2") - F.col("t1")) * (F.col("f3") - F.col("f1")) - (F.col("t3") - F.col("t1")) * (F.col("f2") - F.col("f1"))
    inside = det * F.signum(turn.cast("double")).cast("long") > 0
    return own.join(p, (own["track"] == p["track"]) & (own["b"] == p["b"]) & inside, "left_anti").drop("b")


def two_hop(faces: DataFrame, points: DataFrame, t: Triangles = Triangles()) -> DataFrame:
    """Extra triangles of landmarks within two edges of an anchor, best first, capped per anchor."""
    sides = [("i1", "i2"), ("i1", "i3"), ("i2", "i3")]
    edges = faces.select("track", F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for x, y in sides for a, b in ((x, y), (y, x))])).alias("e"))
    edges = edges.select("track", "e.a", "e.b").distinct()
    far = edges.join(edges.select("track", F.col("a").alias("b"), F.col("b").alias("c")), ["track", "b"]).select("track", "a", F.col("c").alias("b"))
    reach = edges.unionByName(far).distinct().where("b > a")
    one = points.select("track", F.col("i").alias("a"), F.col("f").alias("f1"), F.col("t").alias("t1"), F.col("score").alias("s1"))
    two = points.select("track", F.col("i").alias("b"), F.col("f").alias("f2"), F.col("t").alias("t2"), F.col("score").alias("s2"))
    near = reach.join(one, ["track", "a"]).join(two, ["track", "b"]).where(F.col("t2") - F.col("t1") <= t.max_span)
    order = Window.partitionBy("track", "a").orderBy(_square("f1", "t1", "f2", "t2"), F.col("s2").desc(), "t2", "f2")
    near = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= t.neighbours)
    third = near.select("track", "a", F.col("b").alias("c"), F.col("f2").alias("f3"), F.col("t2").alias("t3"), F.col("s2").alias("s3"))
    made = near.drop("k").join(third, ["track", "a"]).where("c > b")
    made = made.withColumnsRenamed({"a": "i1", "b": "i2", "c": "i3"}).join(faces.select("track", "i1", "i2", "i3"), ["track", "i1", "i2", "i3"], "left_anti")
    made = measured(made).where(valid(t)).withColumn("q", F.col("cross") / (F.col("e1") + F.col("e2") + F.col("e3")).cast("double")).withColumn("r", circumradius())
    best = Window.partitionBy("track", "i1").orderBy(F.col("q").desc(), F.least("s1", "s2", "s3").desc(), "r", "i2", "i3")
    return made.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= t.per_anchor)


def descriptor(t: Triangles = Triangles()) -> list:
    """The five quantised integers of a triangle."""
    part = lambda a, b, q: F.bround((F.col(b) - F.col(a)) / q).cast("int")
    return [
        F.bround(F.col("f1") / t.quant_anchor).cast("int"), part("f1", "f2", t.quant_f), part("t1", "t2", t.quant_t),
        part("f1", "f3", t.quant_f), part("t1", "t3", t.quant_t),
    ]
