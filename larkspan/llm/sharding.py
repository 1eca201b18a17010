"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts stay together. Sorted by size, each group enters the shard with the tightest
remaining room that holds it, found in a balanced tree (``bestfit``). With a fixed capacity that
minimises the number of shards; with a fixed number of shards the capacity is bisected down to the
smallest one that suffices, so that sizes come out near equal.

The tree works on counts of groups per size class: sizes below EXACT bytes are classes of their own,
larger ones are rounded up to PRECISION steps per power of two. That bounds the classes (about 200,000
for sizes up to 2^60) whatever the number of documents, and the driver holds nothing else. Each group
finds its rank within its class without a single-task window and looks it up in the plan.

A group larger than a shard's fair share (with a fixed capacity: than the capacity) cannot stay whole; it is dealt into the fewest parts that fit,
of sizes one row apart at most. There can be no more such groups than shards.

Cases: null text is the empty text; null ids and rows that repeat an id are placed like any other. An empty
table gives an empty result. A text of any length is one row of one group. Columns other than id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.bestfit import best_fit_decreasing, least_capacity
from larkspan.ranks import spread_rank
from larkspan.scratch import materialize

EXACT = 1 << 16
PRECISION = 1 << 12


def size_class(size: Column) -> Column:
    """The size, rounded up to PRECISION steps per power of two from EXACT on."""
    power = F.floor(F.log2(size.cast("double")))
    step = F.pow(F.lit(2.0), F.greatest(power - 12, F.lit(0))).cast("long")
    return F.when(size < EXACT, size).otherwise(F.ceil(size / step).cast("long") * step).cast("long")


def place(pieces: DataFrame, plan: list, size_col: str = "length", ranked: str = "rank") -> DataFrame:
    """Add sequence_id and offset to rows that have their rank within their size.

    plan: the intervals of ``best_fit_decreasing``; the number of sizes bounds them.
    """
    span = 1 << 44  # ranks stay below it, and the number of sizes below 2^19
    arrays = list(np.array(plan, np.int64).reshape(-1, 5).T)
    shared = pieces.sparkSession.sparkContext.broadcast(arrays)
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        length, first, begin, each, offset = shared.value
        sizes = np.unique(length)
        keys = np.searchsorted(sizes, length) * span + first
        for batch in batches:
            size = batch.column(batch.schema.get_field_index(size_col)).to_numpy()
            rank = batch.column(batch.schema.get_field_index(ranked)).to_numpy()
            k = np.searchsorted(keys, np.searchsorted(sizes, size) * span + rank, side="right") - 1
            i = rank - first[k]
            yield pa.record_batch(
                [*batch.columns, pa.array(begin[k] + i // each[k]), pa.array(offset[k] + i % each[k] * size)], names
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def best_fit_shards(
    docs: DataFrame,
    shards: int | None = None,
    capacity: int | None = None,
    overhead: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: (id, size, crc, digest, shard, slot).

    Give ``shards`` for a fixed number of near-equal shards, or ``capacity`` (bytes) for the fewest
    shards of that capacity; a single row larger than the capacity is an error.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"),
    )
    rows = materialize(rows, "rows")
    total, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    if capacity is not None and largest > capacity:
        raise ValueError(f"a row has {largest} bytes, the capacity is {capacity}")
    room = max(capacity or -(-total // shards), largest, 1)

    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    # Rows of a part: at most as many as fit; a group that fits is one part.
    groups = groups.withColumn("parts", F.ceil(F.col("n") / F.floor(F.lit(room) / F.col("size"))).cast("long"))
    groups = materialize(groups, "groups")
    items = groups.select(
        "digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "n", "size", "parts"
    )
    held = F.floor((F.col("n") + F.col("parts") - 1 - F.col("part")) / F.col("parts"))
    items = items.select("digest", "part", size_class(held * F.col("size")).alias("class"))
    if capacity is not None:  # rounding up must not make a part that fits look too large
        items = items.withColumn("class", F.least("class", F.lit(capacity)))

    counts = {r["class"]: r["n"] for r in items.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    if shards is not None:
        _, plan = least_capacity(counts, shards)
    else:
        plan, _ = best_fit_decreasing(counts, capacity)
    ranked = spread_rank(
        items.withColumn("key", F.struct("digest", "part")), "class", "key", "rank", bounded_groups=True
    ).drop("key")
    placed = place(ranked, plan, "class").select("digest", "part", F.col("sequence_id").cast("int").alias("shard"))
    placed = materialize(placed, "placed")

    split = groups.where("parts > 1").select("digest", "parts")  # fewer groups than shards' worth of bytes
    divided = rows.join(F.broadcast(split), "digest", "inner")
    divided = spread_rank(divided, "digest", "id", "rank", bounded_groups=True)
    divided = divided.select(*rows.columns, F.pmod("rank", F.col("parts")).alias("part"))
    whole = rows.join(F.broadcast(split), "digest", "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("part"))
    found = divided.unionByName(whole).join(placed, ["digest", "part"]).drop("part")
    found = materialize(found, "found")
    found = spread_rank(found, "shard", "id", "slot", bounded_groups=shards is not None)
    return found.withColumnRenamed("id", id_col)


def op6_best_fit_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes; equal texts stay together."""
    from larkspan.llm.common import load

    out = best_fit_shards(load(spark, sf_dir, "documents"), shards=24)
    return out.select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
