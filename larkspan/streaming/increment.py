"""Structured Streaming forms: incremental index build, incremental voting, fixed-hop windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.sources.store import IndexStore


def index_stream(fingerprints: DataFrame, store: IndexStore, checkpoint: str):
    """Add the tracks of a stream of (track, hash, offset) to a store. A batch that is replayed adds nothing: its tracks are known.

    A track must arrive whole in one batch, as a file does.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        store.add(batch)

    return fingerprints.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vote_stream(hashes: DataFrame, postings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Votes over a stream of (query, hash, offset, ts): a repeated hash counts once, counts add up."""
    once = hashes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["query", "hash", "offset"])
    met = once.join(postings.withColumnRenamed("offset", "at"), "hash")
    return met.groupBy("query", "track", (F.col("at") - F.col("offset")).alias("delta")).agg(F.count(F.lit(1)).alias("n"))


def hop_windows(events: DataFrame, size: str = "25 seconds", hop: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """Counts and sums per track and fixed-hop window. The extra window at a recording's end exists in batch form only."""
    w = F.window("ts", size, hop)
    out = events.withWatermark("ts", late).groupBy("track", w).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("track", F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "n", "total")
