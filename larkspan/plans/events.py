"""Queries over the event corpus: users are tracks, hours since 2024-01-01 are frames, values give bin and score."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspan.config import Triangles
from larkspan.functions.columns import descriptor_in_range, pack_descriptor, parse_descriptor, places5, probes
from larkspan.operators import geometry as G
from larkspan.operators import greedy, histories, matching
from larkspan.plans.stored import stored
from larkspan.plans.text import load


def landmarks(spark, sf):
    """(track, f, t, score): the highest score of every cell in the band."""
    e = load(spark, sf, "events").where("value is not null")
    hour = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 3600).cast("int")
    cells = e.select(F.col("user_id").alias("track"), F.least(F.floor("value"), F.lit(350)).cast("int").alias("f"), hour.alias("t"), F.col("value").alias("score"))
    return cells.where("f >= 0").groupBy("track", "f", "t").agg(F.max("score").alias("score"))


def event_landmarks(spark, sf):
    return landmarks(spark, sf).where("score > 5.0 and f >= 0 and f < 350").select(F.col("track").alias("user_id"), "f", "t", "score")


def _points(spark, sf):
    return stored(spark, sf, "events", "points", lambda: G.indexed(landmarks(spark, sf)))


def landmark_distinct(spark, sf):
    return _points(spark, sf).select(F.col("track").alias("user_id"), "i", "f", "t", "score")


def event_local_maxima(spark, sf):
    return G.local_maxima(landmarks(spark, sf)).select(F.col("track").alias("user_id"), "f", "t", "score")


def event_magnitude_maxima(spark, sf):
    return G.local_maxima(landmarks(spark, sf).where("score > 10.0")).select(F.col("track").alias("user_id"), "f", "t", "score")


def top_fraction_mean(spark, sf):
    """Mean of the strongest twentieth of every hour's cells."""
    own = Window.partitionBy("t")
    ranked = landmarks(spark, sf).withColumn("k", F.row_number().over(own.orderBy(F.col("score").desc()))).withColumn("n", F.count(F.lit(1)).over(own))
    kept = ranked.where("k <= greatest(1, n div 20)")
    return kept.groupBy("t").agg(places5(F.avg(F.col("score").cast("decimal(20,6)"))).alias("mean"), F.count(F.lit(1)).alias("n"))


def _triples(spark, sf):
    return stored(spark, sf, "events", "triples", lambda: G.triples(_points(spark, sf)))


def triangles_valid(spark, sf):
    return _triples(spark, sf).select(F.col("track").alias("user_id"), "i1", "i2", "i3", "cross", "span")


def triangle_rank(spark, sf):
    """The five best triangles of every anchor."""
    ratio = F.col("cross") / (F.col("e1") + F.col("e2") + F.col("e3")).cast("double")
    own = Window.partitionBy("track", "i1").orderBy(ratio.desc(), F.least("score1", "score2", "score3").desc(), G.circumradius(), "i2", "i3")
    best = _triples(spark, sf).withColumn("rank", F.row_number().over(own)).where("rank <= 5")
    return best.select(F.col("track").alias("user_id"), "i1", "i2", "i3", "rank", places5(G.quality()).alias("quality"), places5(G.circumradius()).alias("radius"))


def _faces(spark, sf):
    return stored(spark, sf, "events", "faces", lambda: G.empty_faces(_triples(spark, sf), _points(spark, sf)))


def faces_empty_circle(spark, sf):
    return _faces(spark, sf).select(F.col("track").alias("user_id"), "i1", "i2", "i3")


def two_hop_triples(spark, sf):
    return G.two_hop(_faces(spark, sf), _points(spark, sf)).select(F.col("track").alias("user_id"), "i1", "i2", "i3", "rank")


def _packable(faces):
    values = G.descriptor()
    return faces.where(descriptor_in_range(*values))


def descriptor_pack(spark, sf):
    values = G.descriptor()
    out = _packable(_faces(spark, sf)).select(F.col("track").alias("user_id"), "i1", "i2", "i3", pack_descriptor(*values).alias("key"), F.concat_ws(":", F.lit("tri"), *values).alias("name"))
    return out.withColumn("parsed", parse_descriptor(F.col("name")))


def descriptor_range_check(spark, sf):
    ok = descriptor_in_range(*G.descriptor())
    return _faces(spark, sf).agg(F.count(F.lit(1)).alias("faces"), F.count(F.when(~ok, 1)).alias("out_of_range"))


def _probed(faces, radius):
    """(track, hash, offset) of the faces' descriptors and their probes that can be packed."""
    each = faces.select("track", F.col("t1").alias("offset"), F.explode(probes(G.descriptor(), radius)).alias("v"))
    parts = [F.col("v")[k] for k in range(5)]
    return each.where(descriptor_in_range(*parts)).select("track", pack_descriptor(*parts).alias("hash"), F.col("offset").cast("int").alias("offset")).distinct()


def descriptor_multiprobe(spark, sf):
    return _probed(_faces(spark, sf), 1).select(F.col("track").alias("user_id"), "hash", "offset")


def face_hashes(spark, sf):
    return _probed(_faces(spark, sf), 0).select(F.col("track").alias("user_id"), "hash", "offset")


def _thinned(found):
    """Landmarks a day later, without those whose bin and hour add up to a multiple of 7."""
    return found.where("(f + t) % 7 <> 0").withColumn("t", F.col("t") + 24)


def _heard(spark, sf):
    return G.indexed(_thinned(landmarks(spark, sf)))


def _heard_faces(spark, sf):
    points = stored(spark, sf, "events", "heard", lambda: _heard(spark, sf))
    return points, stored(spark, sf, "events", "heard-faces", lambda: G.empty_faces(G.triples(points), points))


def _probes(spark, sf, stage):
    """(track, hash, offset) that stage "original" or "two_hop" asks for."""
    if stage == "original":
        return stored(spark, sf, "events", "probes-o", lambda: _probed(_heard_faces(spark, sf)[1], 1))
    points, faces = _heard_faces(spark, sf)
    one = _probes(spark, sf, "original")
    return stored(spark, sf, "events", "probes-f", lambda: one.unionByName(_probed(G.two_hop(faces, points), 1)).distinct())


def stage_union(spark, sf):
    original, both = _probes(spark, sf, "original"), _probes(spark, sf, "two_hop")
    return both.join(original.withColumn("o", F.lit(True)), ["track", "hash", "offset"], "left").groupBy(F.col("track").alias("user_id")).agg(
        F.count(F.lit(1)).alias("two_hop"), F.count("o").alias("original")
    )


def _face_postings(spark, sf):
    return stored(spark, sf, "events", "face-postings", lambda: _probed(_faces(spark, sf), 0))


def _users(spark, sf) -> int:
    return load(spark, sf, "events").select("user_id").distinct().count()


def _recognized(found):
    return found.select(F.col("query").alias("query_user"), "rank", F.col("track").alias("user_id"), "n", "score", "delta", *[c for c in found.columns if c == "stage"])


def event_recognize_o(spark, sf):
    asked = _probes(spark, sf, "original").withColumnRenamed("track", "query")
    return _recognized(matching.recognize(asked, _face_postings(spark, sf), _users(spark, sf)))


def event_recognize_f(spark, sf):
    """All users in parts, as their probes and meetings are many times the input."""
    return _recognized(histories.recognize(landmarks(spark, sf), _thinned, _users(spark, sf)))


def event_recognize_a(spark, sf):
    """Stage one for all users, stage two for those that it leaves unsure."""
    first, both = (_probes(spark, sf, s).withColumnRenamed("track", "query") for s in ("original", "two_hop"))
    return _recognized(matching.adaptive(first, both, _face_postings(spark, sf), _users(spark, sf)))


def offset_seconds(spark, sf):
    """Offsets of frames in seconds, and against the day that the queries are late."""
    found = event_recognize_o(spark, sf).where("rank = 1")
    return found.select("query_user", "user_id", places5(F.col("delta") * 1280 / F.lit(40000.0)).alias("offset_seconds"), (F.col("delta") + 24).alias("difference"))


def pack_time_hash(spark, sf):
    """Time and hash in one 64-bit key, made distinct and taken apart."""
    h = F.pmod("f", F.lit(65536)).cast("long")
    key = landmarks(spark, sf).select("track", (F.shiftleft(F.col("t").cast("long"), 32) + h).alias("key")).distinct()
    return key.select(F.col("track").alias("user_id"), "key", F.shiftright("key", 32).cast("int").alias("time"), F.col("key").bitwiseAND(0xFFFFFFFF).cast("int").alias("hash"))


def target_region_pairs(spark, sf):
    pairs = G.time_pairs(_points(spark, sf), 1, 12).where(F.abs(F.col("f2") - F.col("f1")).between(1, 128))
    return pairs.select(F.col("track").alias("user_id"), F.col("i1"), F.col("i2"), (F.col("t2") - F.col("t1")).alias("dt"), (F.col("f2") - F.col("f1")).alias("df"))


def event_density_greedy(spark, sf):
    return greedy.density_selection(landmarks(spark, sf), rate=0.25, window=8).select(F.col("track").alias("user_id"), "f", "t", "score")


def target_region_greedy(spark, sf):
    return greedy.target_region(_points(spark, sf), budget=24).withColumnRenamed("track", "user_id")


_E = """
lm AS (SELECT user_id, least(floor(value), 350)::INT AS f, floor((epoch(ts) - 1704067200) / 3600)::INT AS t, max(value) AS score
       FROM events WHERE value IS NOT NULL AND least(floor(value), 350)::INT >= 0 GROUP BY ALL),
pt AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY t, f, score DESC) - 1)::INT AS i FROM lm)
"""


def _geometry_sql(p: str, pt: str) -> str:
    """CTEs {p}tr (valid triples), {p}fc (faces), {p}th (two-hop triples) over points ``pt``."""
    rules = """span BETWEEN 1 AND 63 AND crs >= 245 AND greatest(e1, e2, e3) <= 176400 AND e1 * e2 * e3 <= (crs * 560) * (crs * 560)"""
    sq = lambda a, b: f"(({b}.t - {a}.t) * 5)::BIGINT ** 2 + (({b}.f - {a}.f) * 7)::BIGINT ** 2".replace("** 2", "^ 2")
    sq = lambda a, b: f"((({b}.t - {a}.t) * ({b}.t - {a}.t))::BIGINT * 25 + (({b}.f - {a}.f) * ({b}.f - {a}.f))::BIGINT * 49)"
    cross = "abs((b.t - a.t) * (c.f - a.f) - (c.t - a.t) * (b.f - a.f))::BIGINT * 35"
    cols = f"a.i AS i1, b.i AS i2, c.i AS i3, a.f AS f1, a.t AS t1, b.f AS f2, b.t AS t2, c.f AS f3, c.t AS t3, a.score AS s1, b.score AS s2, c.score AS s3, {sq('a', 'b')} AS e1, {sq('a', 'c')} AS e2, {sq('b', 'c')} AS e3, {cross} AS crs, greatest(a.t, b.t, c.t) - least(a.t, b.t, c.t) AS span"
    d = lambda k: (f"((t{k} - p.t) * 5)::BIGINT", f"((f{k} - p.f) * 7)::BIGINT")
    (ax, ay), (bx, by), (cx, cy) = d(1), d(2), d(3)
    s = lambda x, y: f"({x} * {x} + {y} * {y})"
    det = f"({ax} * ({by} * {s(cx, cy)} - {s(bx, by)} * {cy}) - {ay} * ({bx} * {s(cx, cy)} - {s(bx, by)} * {cx}) + {s(ax, ay)} * ({bx} * {cy} - {by} * {cx}))"
    return f"""
{p}pr AS (SELECT a.user_id, a.i AS x, b.i AS y FROM {pt} a JOIN {pt} b ON a.user_id = b.user_id AND b.i > a.i AND b.t - a.t BETWEEN 0 AND 63 AND {sq('a', 'b')} <= 176400),
{p}tr AS (SELECT * FROM (SELECT a.user_id, {cols} FROM {p}pr p JOIN {p}pr q ON p.user_id = q.user_id AND p.x = q.x AND q.y > p.y
  JOIN {pt} a ON a.user_id = p.user_id AND a.i = p.x JOIN {pt} b ON b.user_id = p.user_id AND b.i = p.y JOIN {pt} c ON c.user_id = p.user_id AND c.i = q.y) WHERE {rules}),
{p}fc AS (SELECT * FROM {p}tr z WHERE NOT EXISTS (SELECT 1 FROM {pt} p WHERE p.user_id = z.user_id AND p.t BETWEEN z.t1 - 112 AND z.t1 + 112
  AND {det} * sign((t2 - t1) * (f3 - f1) - (t3 - t1) * (f2 - f1)) > 0)),
{p}ed AS (SELECT DISTINCT user_id, unnest([i1, i2, i1, i3, i2, i3]) AS a, unnest([i2, i1, i3, i1, i3, i2]) AS b FROM {p}fc),
{p}rc AS (SELECT DISTINCT * FROM (SELECT * FROM {p}ed UNION ALL SELECT x.user_id, x.a, y.b FROM {p}ed x JOIN {p}ed y ON x.user_id = y.user_id AND x.b = y.a) WHERE b > a),
{p}nb AS (SELECT r.user_id, r.a, r.b FROM {p}rc r JOIN {pt} a ON a.user_id = r.user_id AND a.i = r.a JOIN {pt} b ON b.user_id = r.user_id AND b.i = r.b WHERE b.t - a.t <= 63
  QUALIFY row_number() OVER (PARTITION BY r.user_id, r.a ORDER BY {sq('a', 'b')}, b.score DESC, b.t, b.f) <= 12),
{p}th AS (SELECT *, row_number() OVER (PARTITION BY user_id, i1 ORDER BY crs::DOUBLE / (e1 + e2 + e3)::DOUBLE DESC, least(s1, s2, s3) DESC, sqrt((e1 * e2 * e3)::DOUBLE) / (crs * 2)::DOUBLE / 70, i2, i3)::INT AS rank FROM (
  SELECT a.user_id, {cols} FROM {p}nb p JOIN {p}nb q ON p.user_id = q.user_id AND p.a = q.a AND q.b > p.b
  JOIN {pt} a ON a.user_id = p.user_id AND a.i = p.a JOIN {pt} b ON b.user_id = p.user_id AND b.i = p.b JOIN {pt} c ON c.user_id = p.user_id AND c.i = q.b)
  WHERE {rules} AND (user_id, i1, i2, i3) NOT IN (SELECT (user_id, i1, i2, i3) FROM {p}fc) QUALIFY rank <= 24)"""


_D = ["round_even(f1 / 2.0::DOUBLE, 0)::INT", "round_even((f2 - f1) / 3.0::DOUBLE, 0)::INT", "round_even((t2 - t1) / 2.0::DOUBLE, 0)::INT", "round_even((f3 - f1) / 3.0::DOUBLE, 0)::INT", "round_even((t3 - t1) / 2.0::DOUBLE, 0)::INT"]
_OK = "v[1] BETWEEN 0 AND 255 AND v[2] BETWEEN -128 AND 127 AND v[3] BETWEEN -128 AND 127 AND v[4] BETWEEN -128 AND 127 AND v[5] BETWEEN -128 AND 127"
_KEY = "(v[1]::BIGINT << 32) + ((v[2] + 128)::BIGINT << 24) + ((v[3] + 128)::BIGINT << 16) + ((v[4] + 128)::BIGINT << 8) + (v[5] + 128)"


def _probe_sql(name: str, source: str, radius: int) -> str:
    probe = "[v]" if radius == 0 else "list_concat([v], " + ", ".join(
        f"[[{', '.join(f'v[{j}] + ({s if j == k else 0})' for j in range(1, 6))}]]" for k in range(1, 6) for s in (-1, 1)
    ) + ")"
    return f"""{name} AS (SELECT DISTINCT user_id, {_KEY} AS hash, t1::INT AS "offset" FROM (SELECT user_id, t1, unnest({probe}) AS v FROM (SELECT user_id, t1, [{', '.join(_D)}] AS v FROM {source})) WHERE {_OK})"""


_B = f"WITH {_E}, {_geometry_sql('', 'pt')}"
_H = f"""{_B}, {_probe_sql('ref', 'fc', 0)}, hm AS (SELECT user_id, f, t + 24 AS t, score FROM lm WHERE (f + t) % 7 <> 0),
hp AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY t, f, score DESC) - 1)::INT AS i FROM hm), {_geometry_sql('h', 'hp')},
{_probe_sql('ho', 'hfc', 1)}, {_probe_sql('h2', 'hth', 1)}, hb AS (SELECT * FROM ho UNION SELECT * FROM h2)"""


def _match_ctes(asked: str, x: str = "") -> str:
    return f"""nt{x} AS (SELECT count(DISTINCT user_id) AS n FROM events),
idf{x} AS (SELECT hash, (1 + ln((greatest(nt{x}.n, count(DISTINCT user_id)) + 1.0::DOUBLE) / (count(DISTINCT user_id) + 1.0::DOUBLE)))::DECIMAL(28,12) AS idf FROM ref, nt{x} GROUP BY hash, nt{x}.n),
vt{x} AS (SELECT q.user_id AS query_user, p.user_id, p."offset" - q."offset" AS delta, count(*) AS n, sum(idf) AS w FROM {asked} q JOIN ref p USING (hash) JOIN idf{x} USING (hash) GROUP BY ALL),
sm{x} AS (SELECT query_user, user_id, delta, (sum(n) OVER k)::BIGINT AS n, (w + (sum(w) OVER k - w) * 0.5)::DECIMAL(38,12) AS w FROM vt{x} WINDOW k AS (PARTITION BY query_user, user_id ORDER BY delta RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
bs{x} AS (SELECT * FROM sm{x} QUALIFY row_number() OVER (PARTITION BY query_user, user_id ORDER BY w DESC, n DESC, delta) = 1),
rk{x} AS (SELECT query_user, (row_number() OVER (PARTITION BY query_user ORDER BY w DESC, n DESC, user_id))::INT AS rank, user_id, n, w::DECIMAL(20,5)::DOUBLE AS score, delta FROM bs{x} QUALIFY rank <= 2)"""


def _match_sql(asked: str) -> str:
    return f"{_H}, {_match_ctes(asked)}"


def _adaptive_sql() -> str:
    """Users whose stage-one result has 8 hits at least and a margin of 0.4 keep it; the others take stage two's."""
    return f"""{_match_sql("ho")}, {_match_ctes("hb", "2")}, cf AS (SELECT query_user, max(n) FILTER (rank = 1) AS hits, max(score) FILTER (rank = 1) AS f, coalesce(max(score) FILTER (rank = 2), 0) AS s FROM rk GROUP BY 1),
sure AS (SELECT query_user FROM cf WHERE hits >= 8 AND f > 0 AND (f - s) / f >= 0.4::DOUBLE)
SELECT *, 'original' AS stage FROM rk WHERE query_user IN (FROM sure) UNION ALL
SELECT *, 'two_hop' AS stage FROM rk2 WHERE query_user IN (SELECT user_id FROM ho) AND query_user NOT IN (FROM sure)"""


_MAX = """SELECT user_id, f, t, score FROM {0} a WHERE NOT EXISTS (SELECT 1 FROM {0} b WHERE a.user_id = b.user_id AND abs(a.t - b.t) <= 3 AND abs(a.f - b.f) <= 2
  AND (b.score > a.score OR (b.score = a.score AND (b.t < a.t OR (b.t = a.t AND b.f < a.f)))))"""

QUERIES = {f.__name__: f for f in (
    event_landmarks, landmark_distinct, event_local_maxima, event_magnitude_maxima, top_fraction_mean, triangles_valid, triangle_rank, faces_empty_circle,
    two_hop_triples, descriptor_pack, descriptor_range_check, descriptor_multiprobe, face_hashes, stage_union, event_recognize_o, event_recognize_f, event_recognize_a, offset_seconds,
    pack_time_hash, target_region_pairs, event_density_greedy, target_region_greedy,
)}

ORACLE_SQL = {
    "event_landmarks": f"WITH {_E} SELECT user_id, f, t, score FROM lm WHERE score > 5.0 AND f < 350",
    "landmark_distinct": f"WITH {_E} SELECT user_id, i, f, t, score FROM pt",
    "event_local_maxima": f"WITH {_E} {_MAX.format('lm')}",
    "event_magnitude_maxima": f"WITH {_E}, hi AS (SELECT * FROM lm WHERE score > 10.0) {_MAX.format('hi')}",
    "top_fraction_mean": f"""WITH {_E}, k AS (SELECT t, score, row_number() OVER (PARTITION BY t ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY t) AS n FROM lm)
      SELECT t, (sum(score::DECIMAL(20,6)) / count(*))::DECIMAL(20,5)::DOUBLE AS mean, count(*) AS n FROM k WHERE k <= greatest(1, n // 20) GROUP BY t""",
    "triangles_valid": f"{_B} SELECT user_id, i1, i2, i3, crs AS \"cross\", span FROM tr",
    "triangle_rank": f"""{_B} SELECT user_id, i1, i2, i3, (row_number() OVER (PARTITION BY user_id, i1 ORDER BY crs::DOUBLE / (e1 + e2 + e3)::DOUBLE DESC, least(s1, s2, s3) DESC, sqrt((e1 * e2 * e3)::DOUBLE) / (crs * 2)::DOUBLE / 70, i2, i3))::INT AS rank,
      (2 * sqrt(3.0::DOUBLE) * crs / (e1 + e2 + e3))::DECIMAL(20,5)::DOUBLE AS quality, (sqrt((e1 * e2 * e3)::DOUBLE) / (crs * 2)::DOUBLE / 70)::DECIMAL(20,5)::DOUBLE AS radius FROM tr QUALIFY rank <= 5""",
    "faces_empty_circle": f"{_B} SELECT user_id, i1, i2, i3 FROM fc",
    "two_hop_triples": f"{_B} SELECT user_id, i1, i2, i3, rank FROM th",
    "descriptor_pack": f"{_B} SELECT user_id, i1, i2, i3, {_KEY} AS key, 'tri:' || array_to_string(v, ':') AS name, {_KEY} AS parsed FROM (SELECT user_id, i1, i2, i3, [{', '.join(_D)}] AS v FROM fc) WHERE {_OK}",
    "descriptor_range_check": f"{_B} SELECT count(*) AS faces, count(*) FILTER (NOT ({_OK})) AS out_of_range FROM (SELECT [{', '.join(_D)}] AS v FROM fc)",
    "descriptor_multiprobe": f"{_B}, {_probe_sql('o', 'fc', 1)} SELECT * FROM o",
    "face_hashes": f"{_B}, {_probe_sql('o', 'fc', 0)} SELECT * FROM o",
    "stage_union": f"{_H} SELECT user_id, count(*) AS two_hop, count(*) FILTER ((user_id, hash, \"offset\") IN (SELECT (user_id, hash, \"offset\") FROM ho)) AS original FROM hb GROUP BY user_id",
    "event_recognize_o": f"{_match_sql('ho')} SELECT * FROM rk",
    "event_recognize_f": f"{_match_sql('hb')} SELECT * FROM rk",
    "event_recognize_a": _adaptive_sql(),
    "offset_seconds": f"{_match_sql('ho')} SELECT query_user, user_id, (delta * 1280 / 40000.0::DOUBLE)::DECIMAL(20,5)::DOUBLE AS offset_seconds, delta + 24 AS difference FROM rk WHERE rank = 1",
    "pack_time_hash": f"WITH {_E} SELECT DISTINCT user_id, (t::BIGINT << 32) + f % 65536 AS key, t AS time, (f % 65536)::INT AS hash FROM lm WHERE t >= 0 UNION ALL SELECT DISTINCT user_id, t::BIGINT * 4294967296 + f % 65536, t, (f % 65536)::INT FROM lm WHERE t < 0",
    "target_region_pairs": f"WITH {_E} SELECT a.user_id, a.i AS i1, b.i AS i2, b.t - a.t AS dt, b.f - a.f AS df FROM pt a JOIN pt b ON a.user_id = b.user_id AND b.i > a.i AND b.t - a.t BETWEEN 1 AND 12 AND abs(b.f - a.f) BETWEEN 1 AND 128",
}
