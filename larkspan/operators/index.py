"""The inverted index: postings, statistics, grouped form, incremental build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.columns import let, shingle_key
from larkspan.ranks import sorted_rank


def token_shingles(rows: DataFrame, id_col: str, text_col: str, name: str, width: int = 3) -> DataFrame:
    """(name, hash, offset): a key for every ``width`` adjacent tokens of a text."""

    def keys(tokens: Column) -> Column:
        last = F.size(tokens) - width
        grams = F.transform(F.sequence(F.lit(0), last), lambda i: shingle_key(F.array_join(F.slice(tokens, i + 1, width), " ")))
        return F.when(last >= 0, grams)

    tokens = F.split(F.lower(F.col(text_col)), r"\s+")
    return rows.select(F.col(id_col).alias(name), F.posexplode(let(tokens, keys)).alias("offset", "hash")).select(name, "hash", "offset")


def hash_stats(postings: DataFrame) -> DataFrame:
    """(hash, df, n): different tracks and postings of a hash."""
    # Two levels, so that a hash in a third of all postings is pre-aggregated before each shuffle.
    per_track = postings.groupBy("hash", "track").agg(F.count(F.lit(1)).alias("n"))
    return per_track.groupBy("hash").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))


def idf(df: Column, tracks: Column, smoothing: float = 1.0, power: float = 1.0) -> Column:
    """(1 + ln((max(N, df) + s) / (df + s)))^p."""
    ratio = (F.greatest(tracks, df) + smoothing) / (df + smoothing)
    base = 1 + F.log(ratio)
    return base if power == 1 else F.pow(base, F.lit(power))


def grouped(postings: DataFrame) -> DataFrame:
    """(hash, n, postings): the nested form, postings ordered by track and offset."""
    item = F.struct("track", "offset")
    return postings.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(item)).alias("postings"))


def faults(lines: DataFrame) -> DataFrame:
    """(fault, hash) of the grouped form: ``count`` for a row whose count differs from its list, ``repeated`` for a hash that has several rows."""
    wrong = lines.where(F.size("postings") != F.col("n")).select(F.lit("count").alias("fault"), "hash")
    twice = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return wrong.unionByName(twice.select(F.lit("repeated").alias("fault"), "hash"))


def prefix_starts(stats: DataFrame) -> DataFrame:
    """(hash, n, start): where a hash's postings begin in key order, by range partition totals."""
    dealt = stats.select("hash", "n", F.shiftright("hash", 48).alias("part"))
    totals = dealt.groupBy("part").agg(F.sum("n").alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 parts at most
    totals = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(F.broadcast(totals), "part").select("hash", "n", (F.col("base") + F.col("local")).alias("start"))


def index_statistics(postings: DataFrame) -> DataFrame:
    return postings.agg(F.max("track").alias("max_track"), F.max("offset").alias("max_offset"), F.count(F.lit(1)).alias("n_postings"))


def missing(candidates: DataFrame, tracks: DataFrame, key: str = "track") -> DataFrame:
    """Candidates that the index lacks."""
    return candidates.join(tracks.select(key), key, "left_anti")


def numbered(names: DataFrame, start: int, key: str = "track") -> DataFrame:
    """Consecutive ids, after ``start``, in name order."""
    return sorted_rank(names.select(key), [key], "track_id").withColumn("track_id", F.col("track_id") + start + 1)


def merge(existing: DataFrame, pending: DataFrame) -> DataFrame:
    """Bag union of two posting tables, ordered by hash within partitions."""
    return pending.unionByName(existing).repartition("hash").sortWithinPartitions("hash", "track", "offset")


def parse_postings(text: Column) -> Column:
    """``song:offset-song:offset`` to an array of (song, offset)."""
    return F.transform(
        F.split(text, "-"), lambda x: F.struct(F.split(x, ":")[0].cast("long").alias("song"), F.split(x, ":")[1].cast("int").alias("offset"))
    )


def format_postings(postings: Column) -> Column:
    return F.array_join(F.transform(postings, lambda x: F.concat_ws(":", x["track"], x["offset"])), "-")
