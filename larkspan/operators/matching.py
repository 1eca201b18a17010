"""Probe, vote, smooth and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.config import Matching
from larkspan.functions.columns import exact, places5, small
from larkspan.operators.index import hash_stats, idf
from larkspan.scratch import materialize


def matches(queries: DataFrame, postings: DataFrame, tracks: int, m: Matching = Matching()) -> DataFrame:
    """(query, track, delta, idf): every meeting of a query hash and a posting. The index is read once: the postings that
    a query asks for are written, and statistics and meetings read those alone."""
    asked = materialize(queries.select("query", "hash", F.col("offset").alias("at")).distinct(), "asked")
    near = materialize(postings.join(small(asked.select("hash").distinct()), "hash", "left_semi"), "probed")
    weights = hash_stats(near).select("hash", exact(idf(F.col("df"), F.lit(tracks), m.smoothing, m.power)).alias("idf"))
    weighted = materialize(asked.join(weights, "hash"), "weighted")
    return near.join(small(weighted), "hash").select("query", "track", (F.col("offset") - F.col("at")).alias("delta"), "idf")


def votes(met: DataFrame) -> DataFrame:
    """(query, track, delta, n, w)."""
    return met.groupBy("query", "track", "delta").agg(F.count(F.lit(1)).alias("n"), F.sum("idf").cast("decimal(38,12)").alias("w"))


def smoothed(cells: DataFrame, m: Matching = Matching()) -> DataFrame:
    """Neighbouring offsets count in full for n and by neighbour_weight^distance for w."""
    own = Window.partitionBy("query", "track").orderBy("delta")
    n, w = F.col("n"), F.col("w").cast("decimal(38,12)")
    inner_n, inner_w = F.col("n"), F.col("w")
    for d in range(1, m.radius + 1):
        frame = own.rangeBetween(-d, d)
        all_n, all_w = F.sum("n").over(frame), F.sum("w").over(frame)
        n = n + all_n - inner_n
        w = w + (all_w - inner_w) * F.lit(m.neighbour_weight**d).cast("decimal(6,5)")
        inner_n, inner_w = all_n, all_w
    return cells.select("query", "track", "delta", n.cast("long").alias("n"), w.cast("decimal(38,12)").alias("w"))


def best_per_track(cells: DataFrame) -> DataFrame:
    """The cell with the highest (w, n, -delta) of every track."""
    best = F.max_by(F.struct("delta", "n", "w"), F.struct("w", "n", (-F.col("delta")).alias("d")))
    return cells.groupBy("query", "track").agg(best.alias("b")).select("query", "track", "b.delta", "b.n", "b.w")


def ranked(best: DataFrame, topn: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("w").desc(), F.col("n").desc(), "track")
    out = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= topn)
    return out.select("query", "rank", "track", "n", places5(F.col("w")).alias("score"), "delta")


def named(best: DataFrame, names: DataFrame, topn: int) -> DataFrame:
    """(query, rank, track, name, n, score, delta): as ``ranked``, with the dictionary's names, which decide ties. A track that the
    dictionary lacks is an error."""
    known = best.join(names, "track", "left")
    name = F.coalesce("name", F.raise_error(F.concat(F.lit("no name for track "), F.col("track").cast("string"))).cast("string"))
    order = Window.partitionBy("query").orderBy(F.col("w").desc(), F.col("n").desc(), "name")
    out = known.withColumn("name", name).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= topn)
    return out.select("query", "rank", "track", "name", "n", places5(F.col("w")).alias("score"), "delta")


def recognize(queries: DataFrame, postings: DataFrame, tracks: int, m: Matching = Matching()) -> DataFrame:
    """(query, rank, track, n, score, delta): the best tracks of every query."""
    return ranked(best_per_track(smoothed(votes(matches(queries, postings, tracks, m)), m)), m.topn)


def confidence(results: DataFrame, m: Matching = Matching()) -> DataFrame:
    """(query, hits, margin, confident) from results with two ranks at least."""
    top = results.groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("hits"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
    )
    margin = F.when(F.col("first") > 0, (F.col("first") - F.col("second")) / F.col("first")).otherwise(0.0)
    sure = (F.col("hits") >= m.min_hits) & (margin >= m.min_margin)
    return top.select("query", "hits", places5(margin).alias("margin"), sure.alias("confident"))


def adaptive(first: DataFrame, second: DataFrame, postings: DataFrame, tracks: int, m: Matching = Matching()) -> DataFrame:
    """Stage one for all queries; the queries that it leaves unsure vote again with the stage-two hashes added.

    Votes are additive: only hashes not seen before are probed in stage two.
    """
    wide = Matching(m.smoothing, m.power, m.radius, m.neighbour_weight, max(2, m.topn), m.min_hits, m.min_margin)
    met = matches(first, postings, tracks, wide)
    one = materialize(ranked(best_per_track(smoothed(votes(met), wide)), wide.topn), "one")
    unsure = materialize(first.select("query").distinct().join(confidence(one, m).where("confident"), "query", "left_anti"), "unsure")
    new = second.join(first.select("query", "hash", "offset"), ["query", "hash", "offset"], "left_anti").join(unsure, "query", "left_semi")
    more = matches(new, postings, tracks, wide).unionByName(met.join(unsure, "query", "left_semi"))
    two = ranked(best_per_track(smoothed(votes(more), wide)), wide.topn)
    out = one.join(unsure, "query", "left_anti").withColumn("stage", F.lit("original"))
    return out.unionByName(two.withColumn("stage", F.lit("two_hop"))).where(F.col("rank") <= m.topn)
