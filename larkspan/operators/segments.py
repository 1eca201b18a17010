"""Cutting sequences into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(rows: DataFrame, size: int, hop: int) -> DataFrame:
    """Add begin and end of every window over ``length``, and of a last one that ends with the sequence."""
    last = F.col("length") - size
    begins = F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(hop).cast("long")), F.array(last)))
    )
    out = rows.withColumn("begin", F.explode(begins))
    return out.withColumn("end", F.least(F.col("begin") + size, F.col("length")))


def fixed_segments(rows: DataFrame, size: int, hop: int) -> DataFrame:
    """Add segment and begin of every whole segment; a sequence shorter than one gives one, to be padded."""
    n = F.when(F.col("length") <= size, F.lit(1)).otherwise(F.floor((F.col("length") - size) / hop).cast("int") + 1)
    out = rows.withColumn("segment", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("begin", F.col("segment") * hop)
