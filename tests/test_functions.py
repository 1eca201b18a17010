import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.config import DEFAULT, Matching
from larkspan.functions import columns as C
from larkspan.functions.delaunay import triangulate
from larkspan.functions.signal import energy_rates, gaussian, landmarks, peaks, saliency, spectrogram
from larkspan.operators import geometry
from larkspan.operators.greedy import select_dense, target_region


def test_config_defaults_and_checks():
    assert DEFAULT.to_dict()["signal"] == {"sample_rate": 40_000, "window": 2_560, "hop": 1_280, "shifts": 4}
    with pytest.raises(ValueError):
        Matching(smoothing=0)
    with pytest.raises(ValueError):
        Matching(power=-1)


def test_pack_and_parse_agree(spark):
    row = spark.range(1).select(C.pack_descriptor(*[F.lit(v) for v in (131, 17, -9, -40, 62)]).alias("a"), C.parse_descriptor(F.lit("tri:131:17:-9:-40:62")).alias("b")).first()
    assert row.a == row.b == (131 << 32) + (145 << 24) + (119 << 16) + (88 << 8) + 190


@pytest.mark.parametrize("text", ["tri:1:2", "x:1:2:3:4:5"])
def test_malformed_descriptor(spark, text):
    with pytest.raises(Exception, match="malformed"):
        spark.createDataFrame([(text,)], "s string").select(C.parse_descriptor(F.col("s"))).collect()


def test_descriptor_range(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(300,)], "a int").select(C.pack_descriptor(F.col("a"), *[F.lit(0)] * 4)).collect()


def test_probes_have_eleven_keys(spark):
    assert spark.range(1).select(F.size(F.array_distinct(C.probes([F.lit(v) for v in (5, 1, 2, 3, 4)], 1)))).first()[0] == 11


def test_half_even(spark):
    got = spark.createDataFrame([(x / 2,) for x in range(-9, 10)], "x double").select("x", C.half_even(F.col("x")).alias("r")).collect()
    assert all(r.r == round(r.x) for r in got)


def brute_faces(points):
    """Triangles with an empty open circumcircle, by all other points."""
    out = set()
    n = len(points)
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, n):
                a, b, c = points[i], points[j], points[k]
                turn = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
                if not turn:
                    continue
                det = [np.linalg.det(np.array([[q[0] - p[0], q[1] - p[1], (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2] for q in (a, b, c)], float)) * np.sign(turn) for p in points]
                if max(det) < 0.5:
                    out.add((i, j, k))
    return out


def test_delaunay_against_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        points = list({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(3, 14))})
        faces, allowed = triangulate(points), brute_faces(points)
        assert faces <= allowed
        hull_area = sum(abs((points[b][0] - points[a][0]) * (points[c][1] - points[a][1]) - (points[b][1] - points[a][1]) * (points[c][0] - points[a][0])) for a, b, c in faces)
        def cross(o, a, b):
            return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        chain = []
        for part in (sorted(points), sorted(points, reverse=True)):
            half = []
            for p in part:
                while len(half) > 1 and cross(half[-2], half[-1], p) <= 0:
                    half.pop()
                half.append(p)
            chain += half[:-1]
        assert hull_area == abs(sum(chain[i - 1][0] * chain[i][1] - chain[i][0] * chain[i - 1][1] for i in range(len(chain))))


def test_delaunay_degenerate():
    assert triangulate([]) == triangulate([(0, 0), (1, 1)]) == triangulate([(0, 0), (1, 1), (2, 2), (5, 5)]) == set()
    assert len(triangulate([(0, 0), (0, 2), (2, 0), (2, 2)])) == 2


def tone(seconds=3.0, rate=40_000):
    t = np.arange(int(seconds * rate)) / rate
    x = np.sin(2 * np.pi * 1200 * t) + 0.7 * np.sin(2 * np.pi * (1500 * t + 400 * t**2)) + 0.5 * np.sin(2 * np.pi * (3000 * t - 300 * t**2))
    return (30000 * x / np.abs(x).max()).astype(np.int16)


def test_signal_kernels():
    s = spectrogram(tone(), 2560, 1280)
    assert s.shape[0] == 1281 and 0 <= s.min() and s.max() == pytest.approx(80)
    assert gaussian(np.ones((4, 9)), 2.0, 1) == pytest.approx(np.ones((4, 9)))
    assert np.abs(saliency(s[50:350])).max() <= 12
    assert peaks(np.array([[1.0, 1, 0], [0, 0, 0], [0, 0, 5]]), 1, 1) == [(0, 0), (2, 0), (2, 2)]  # the corner is its box's maximum, too
    assert spectrogram(np.zeros(10), 2560, 1280).shape[0] == 1281


def test_landmarks_are_deterministic_and_in_band():
    one, two = landmarks(tone()), landmarks(tone())
    assert one and one == two and all(50 <= f < 350 and s > 5 for f, _, s in one)
    assert landmarks(tone(), magnitude=True)


def blurred(x, sigma):
    """Gaussian smoothing of a list of numbers, cell by cell."""
    r = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return [sum(w * x[min(max(i + d, 0), len(x) - 1)] for d, w in zip(range(-r, r + 1), weights)) / sum(weights) for i in range(len(x))]


def blurred2(x, sigmas):
    columns = list(zip(*[blurred(row, sigmas[1]) for row in x]))
    return [list(row) for row in zip(*[blurred(c, sigmas[0]) for c in columns])]


def test_saliency_against_a_direct_loop():
    c = DEFAULT.landmarks
    band = np.random.default_rng(1).uniform(0, 60, (14, 20))
    level = blurred2(band.tolist(), c.fine)
    ground = blurred2(level, c.background)
    contrast = [[a - b for a, b in zip(x, y)] for x, y in zip(level, ground)]
    energy = blurred2([[v * v for v in row] for row in contrast], c.normalization)
    want = [
        [max(-12, min(12, 3.0 * contrast[i][k] / math.sqrt(energy[i][k] + 0.75**2) + 0.015 * max(level[i][k] - 10.0, 0))) for k in range(20)] for i in range(14)
    ]
    assert saliency(band) == pytest.approx(np.array(want))


def test_energy_rates_against_a_direct_loop():
    field = np.random.default_rng(2).uniform(-3, 9, (45, 70))
    field[:, 40:] = 0
    energy = [sum(sorted((max(v, 0) for v in field[:, k]), reverse=True)[:2]) / 2 for k in range(70)]
    near, far = blurred(energy, 2.0 / 0.032 / 4), blurred(energy, 8.0 / 0.032 / 4)
    want = [min(44, max(6, 22 * ((a + 0.25) / (b + 0.25)) ** 0.75)) for a, b in zip(near, far)]
    assert energy_rates(field, 0.032) == pytest.approx(np.array(want))
    assert energy_rates(np.zeros((5, 9)), 0.032) == pytest.approx(np.full(9, 22.0))


@pytest.mark.parametrize("window", [5, 7.8])
def test_dense_selection_against_brute_force(window):
    rng = random.Random(3)
    points = [(f, t, rng.randint(0, 20)) for f, t in {(rng.randint(0, 9), rng.randint(-5, 50)) for _ in range(200)}]
    chosen, times = [], []
    for f, t, score in sorted(points, key=lambda p: (-p[2], p[1], p[0])):
        begins = [t - k / 5 for k in range(int(window * 5) + 1)]
        if all(sum(s <= x <= s + window for x in times) < 2 + t % 3 for s in begins):
            times.append(t)
            chosen.append((f, t, score))
    assert select_dense(points, lambda t: 2 + t % 3, window) == chosen
    assert select_dense([], lambda t: 1, 5) == []


def test_target_region_against_brute_force(spark):
    rng = random.Random(4)
    points = sorted({(rng.randint(0, 40), rng.randint(0, 60)) for _ in range(70)}, key=lambda p: (p[1], p[0]))
    used, want = [0] * len(points), []
    step = lambda p, q: 1 <= q[1] - p[1] <= 12 and 1 <= abs(q[0] - p[0]) <= 128
    t = DEFAULT.triangles
    for ids in itertools.combinations(range(len(points)), 3):
        a, b, c = (points[i] for i in ids)
        cross = 35 * abs((b[1] - a[1]) * (c[0] - a[0]) - (c[1] - a[1]) * (b[0] - a[0]))
        e = [25 * (p[1] - q[1]) ** 2 + 49 * (p[0] - q[0]) ** 2 for p, q in ((a, b), (a, c), (b, c))]
        shaped = c[1] - a[1] <= t.max_span and cross >= 245 and max(e) <= 420**2 and e[0] * e[1] * e[2] <= (cross * 560) ** 2
        if step(a, b) and step(b, c) and shaped and all(used[i] < 4 for i in ids):
            want.append((9, *ids))
            for i in ids:
                used[i] += 1
    rows = geometry.indexed(spark.createDataFrame([(9, f, t, 1.0) for f, t in points], "track long, f int, t int, score double"))
    assert want and sorted(map(tuple, target_region(rows, 4).collect())) == want
