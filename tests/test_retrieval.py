import math
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.config import Config, Matching
from larkspan.functions import lattice
from larkspan.operators import audio, checks, geometry, histories, index, knn, matching, stats
from larkspan.plans import events, registry, text
from larkspan.plans.stored import stored
from tests.test_functions import tone

SF = "/root/testdata/sf0.001"


def brute(queries, postings, tracks, topn=2):
    held = defaultdict(list)
    for t, h, o in postings:
        held[h].append((t, o))
    out = []
    for q in sorted({q for q, _, _ in queries}):
        cells = defaultdict(lambda: [0, 0.0])
        for h, at in {(h, o) for p, h, o in queries if p == q}:
            df = len({t for t, _ in held[h]})
            for t, o in held[h]:
                cell = cells[t, o - at]
                cell[0] += 1
                cell[1] += 1 + math.log((max(tracks, df) + 1) / (df + 1))
        best = {}
        for (t, d), (n, w) in cells.items():
            for e in (d - 1, d + 1):
                if (t, e) in cells:
                    n, w = n + cells[t, e][0], w + 0.5 * cells[t, e][1]
            key = (round(w, 9), n, -d)
            best[t] = max(best.get(t, (-1, 0, 0)), key)
        order = sorted((-w, -n, t, -m) for t, (w, n, m) in best.items())
        out += [(q, r + 1, t, -n, round(-w, 5), d) for r, (w, n, t, d) in enumerate(order[:topn])]
    return out


def test_recognize_against_brute_force(spark):
    rng = np.random.default_rng(5)
    postings = list({(int(t), int(h), int(o)) for t, h, o in zip(rng.integers(0, 6, 300), rng.integers(0, 40, 300), rng.integers(0, 20, 300))})
    queries = [(int(q), int(h), int(o)) for q, h, o in zip(rng.integers(0, 4, 60), rng.integers(0, 40, 60), rng.integers(0, 10, 60))]
    got = matching.recognize(spark.createDataFrame(queries, "query int, hash long, offset int"), spark.createDataFrame(postings, "track int, hash long, offset int"), 6)
    got = sorted((r.query, r.rank, r.track, r.n, r.score, r.delta) for r in got.collect())
    want = brute(queries, postings, 6)
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=2e-5)


def test_wider_radius_weights(spark):
    cells = spark.createDataFrame([(0, 0, d, 1, 1.0) for d in (0, 1, 2, 5)], "query int, track int, delta int, n long, w double").withColumn("w", F.col("w").cast("decimal(38,12)"))
    got = {r.delta: (r.n, float(r.w)) for r in matching.smoothed(cells, Matching(radius=2)).collect()}
    assert got == {0: (3, 1.75), 1: (3, 2.0), 2: (3, 1.75), 5: (1, 1.0)}


def test_adaptive_equals_union_of_stages_where_unsure(spark):
    first, (second, both) = text.asked(spark, SF), text._wide(spark, SF)
    n = text.n_tracks(spark, SF)
    got = {(r.query, r.rank): (r.track, r.n, r.score) for r in matching.adaptive(first, second, both, n).where("stage = 'two_hop'").collect()}
    full = {(r.query, r.rank): (r.track, r.n, r.score) for r in matching.recognize(second, both, n).collect()}
    assert got and all(full[k] == v for k, v in got.items())


def test_empty_inputs(spark):
    q = spark.createDataFrame([], "query int, hash long, offset int")
    p = spark.createDataFrame([], "track int, hash long, offset int")
    assert matching.recognize(q, p, 0).collect() == [] and index.hash_stats(p).collect() == []


def test_audio_identifies_itself_and_stages_nest(spark):
    a, b = tone(1.5), tone(1.5)[::-1].copy()
    rows = spark.createDataFrame([("a", a.tolist()), ("b", b.tolist())], "track string, samples array<short>")
    refs = audio.fingerprints(audio.audio_landmarks(rows))
    marks = audio.audio_landmarks(rows.where("track = 'a'"), shifts=2)
    original, both = audio.fingerprints(marks, radius=1), audio.fingerprints(marks, radius=1, stage="two_hop")
    assert original.count() > 0 and original.join(both, ["track", "hash", "offset"], "left_anti").isEmpty()
    for asked in (original, both):
        best = matching.recognize(asked.withColumnRenamed("track", "query"), refs, 2).where("rank = 1").first()
        assert best.track == "a" and best.delta == 0
    with pytest.raises(ValueError):
        audio.fingerprints(marks, stage="x")


def test_knn_and_rerank(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 8)).astype(np.float32)
    rows = knn.placed(spark.createDataFrame([(i // 10, i, x.tolist()) for i, x in enumerate(v)], "track int, id long, embedding array<float>"))
    near = knn.topk(rows.where("row >= 12 and row < 15").select((F.col("row") - 12).alias("query"), "embedding"), rows, 4)
    dots = v[12:15].astype(float) @ v.astype(float).T
    want = {(q, int(r)) for q in range(3) for r in np.argsort(-dots[q])[:4]}
    assert {(r["query"], r["row"]) for r in near.collect()} == want
    found = knn.candidates(near.select(F.lit(0).alias("query"), F.col("query").alias("at"), "row"), rows, 3)
    assert all(r.start // 10 == (r.start + 2) // 10 == r.track for r in found.collect())
    seq = rows.where("row >= 12 and row < 15").select(F.lit(0).alias("query"), (F.col("row") - 12).alias("at"), "embedding")
    best = knn.rerank(found, seq, rows).where("rank = 1").first()
    assert (best.track, best.start) == (1, 12)


def test_statistics_against_numpy(spark):
    totals = [("a", 3, 5), ("b", -1, 2), ("c", 2, 4), ("d", 0, 3)]
    df = spark.createDataFrame(totals, "cluster string, total long, n long")
    rng = np.random.default_rng(7)
    x, n = np.array([t[1] for t in totals]), np.array([t[2] for t in totals])
    draws = [rng.integers(0, 4, 4) for _ in range(200)]
    est = [x[d].sum() / n[d].sum() for d in draws]
    signs = rng.choice([-1, 1], size=(200, 4))
    got = stats.bootstrap(df, 200).first()
    assert (got.mean, got.low, got.high) == pytest.approx((x.sum() / n.sum(), np.quantile(est, 0.025), np.quantile(est, 0.975)))
    p = stats.permutation(df.select("cluster", "total"), 200).first()
    assert p.p == pytest.approx(((np.abs(signs @ x) >= abs(x.sum())).sum() + 1) / 201)


def test_registered_statistics_use_5000_replicates(spark, monkeypatch):
    totals = [("a", 3, 5), ("b", -1, 2), ("c", 2, 4), ("d", 0, 3)]
    df = spark.createDataFrame(totals, "cluster string, total long, n long")
    monkeypatch.setattr(text, "cluster_totals", lambda spark, sf: df)
    rng = np.random.default_rng(7)
    x, n = np.array([t[1] for t in totals]), np.array([t[2] for t in totals])
    draws = [rng.integers(0, 4, 4) for _ in range(5000)]
    est = [x[d].sum() / n[d].sum() for d in draws]
    signs = rng.choice([-1, 1], size=(5000, 4))
    got = text.cluster_bootstrap(spark, SF).first()
    assert (got.low, got.high) == pytest.approx((np.quantile(est, 0.025), np.quantile(est, 0.975)))
    p = text.paired_permutation(spark, SF).first()
    assert p.p == pytest.approx(((np.abs(signs @ x) >= abs(x.sum())).sum() + 1) / 5001)


def test_truth_finds_passages_glued_to_other_characters(spark, tmp_path):
    docs = [(1, 'he said "One two three four Five six" then'), (2, "One two three four Five six"), (3, "(red green blue), one"), (4, "x a b c dd"), (5, "one two three")]
    items = [(1, "One two three four Five six"), (2, "red green blue"), (3, "a b c d"), (4, "one two"), (5, "absent in all of them")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.item_id: (r.reference_id, r.place) for r in text._truth(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 2), 2: (3, 0), 3: (4, 1)}


def test_two_hop_and_faces_are_disjoint(spark):
    points = geometry.indexed(spark.createDataFrame([(1, (7 * k) % 40, k, float(k % 5)) for k in range(30)], "track int, f int, t int, score double"))
    faces = geometry.empty_faces(geometry.triples(points), points)
    extra = geometry.two_hop(faces, points)
    assert extra.join(faces, ["track", "i1", "i2", "i3"], "left_semi").isEmpty()
    assert extra.groupBy("i1").count().agg(F.max("count")).first()[0] <= Config().triangles.per_anchor


def some_landmarks(rng, tracks=7):
    """Tracks on a coarse grid, so that many landmarks lie on one circle; the last two repeat the first."""
    rows = []
    for k in range(tracks - 2):
        cells = sorted({(int(t), int(f)) for t, f in zip(rng.integers(0, 40, 60) * 4 - 30, rng.integers(0, 9, 60) * 5)})
        rows += [(10 - k, f, t, float(rng.integers(0, 4))) for t, f in cells]
    return rows + [(k, *r[1:]) for k in (20, -5) for r in rows if r[0] == 10]


def test_lattice_equals_geometry(spark):
    rows = sorted(some_landmarks(np.random.default_rng(8)), key=lambda r: (r[0], r[2], r[1]))
    points = geometry.indexed(spark.createDataFrame(rows, "track long, f int, t int, score double"))
    want = geometry.empty_faces(geometry.triples(points), points).localCheckpoint()
    hops = geometry.two_hop(want, points)
    track, f, t, score = (np.array(x) for x in zip(*rows))
    u = np.cumsum(np.diff(track, prepend=track[:1]) != 0)
    first = np.searchsorted(track, track, "left")
    p = lattice.points(u, t, f, score)
    found = lattice.faces(p)
    ids = lambda x: sorted(zip(track[x[0]], *(k - first[x[0]] for k in x)))
    assert len(found[0]) > 100 and ids(found) == sorted(tuple(r) for r in want.select("track", "i1", "i2", "i3").collect())
    more = lattice.two_hop(p, found)
    assert len(more[0]) > 100 and ids(more) == sorted(tuple(r) for r in hops.select("track", "i1", "i2", "i3").collect())
    place, h = lattice.probed(p, found, 1)
    assert sorted(zip(track[place], h, t[place])) == sorted(tuple(r) for r in events._probed(want, 1).collect())


@pytest.mark.parametrize("m", [Matching(), Matching(radius=2, neighbour_weight=0.3, power=20.0, topn=4)])
def test_histories_in_parts_equal_one_probe(spark, m, monkeypatch):
    given = spark.createDataFrame(some_landmarks(np.random.default_rng(9)), "track long, f int, t int, score double")
    monkeypatch.setattr(histories, "ROWS", 50)
    monkeypatch.setattr(histories, "HELD", 100)
    heard = events._thinned
    got = histories.recognize(given, heard, 9, m, part=60)
    points, late = geometry.indexed(given), geometry.indexed(heard(given))
    faces, late_faces = (geometry.empty_faces(geometry.triples(p), p).localCheckpoint() for p in (points, late))
    asked = events._probed(late_faces, 1).unionByName(events._probed(geometry.two_hop(late_faces, late), 1)).distinct()
    want = matching.recognize(asked.withColumnRenamed("track", "query"), events._probed(faces, 0), 9, m)
    got, want = (sorted(tuple(r) for r in x.collect()) for x in (got, want))
    assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want] and len({g[0] for g in got}) == 7
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-7, abs=2e-5)


def test_histories_of_nothing(spark):
    assert histories.recognize(spark.createDataFrame([], "track long, f int, t int, score double"), events._thinned, 0).collect() == []


def test_event_recognition_keeps_no_probes_on_disk(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "events.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("larkspan-*/*"))
    found = events.event_recognize_f(spark, str(tmp_path))
    assert {p.name for p in set(shared.glob("larkspan-*/*")) - before} == {"recognized"} and not found.isEmpty()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (" ", 3)], "k string, v int")
    assert checks.repeated(df, "k").count() == 1 and checks.blank(df, "k").count() == 1 and checks.not_functional(df, "k", "v").count() == 1
    with pytest.raises(ValueError, match="missing columns: z"):
        checks.require_columns(df, {"k", "z"})
    with pytest.raises(ValueError, match="unexpected"):
        checks.require_columns(df, {"k"}, exact=True)
    with pytest.raises(ValueError, match="differ"):
        checks.require_same_ids(df, df.where("v = 1"), "v")
    checks.require_same_ids(df, df, "v")
    assert checks.rejected_cardinality(df, 2) and not checks.rejected_cardinality(df, 3)


def test_probe_plan_broadcasts_the_queries(spark):
    plan = matching.matches(text.asked(spark, SF), text.postings(spark, SF), 200)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan
    assert plan.count("FileScan") == 2  # the probed postings and the queries' weights, not the index


def test_stored_tables_are_built_once_and_again_for_new_files(spark, tmp_path):
    path, built = str(tmp_path / "t.parquet"), []

    def table():
        def build():
            built.append(1)
            return spark.read.parquet(path).withColumn("y", F.col("x") + 1)

        return stored(spark, str(tmp_path), "t", "y", build)

    spark.range(3).toDF("x").write.parquet(path)
    assert table().count() == table().count() == 3 and len(built) == 1
    spark.range(5).toDF("x").write.mode("overwrite").parquet(path)
    assert table().agg(F.max("y")).first()[0] == 5 and len(built) == 2


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
