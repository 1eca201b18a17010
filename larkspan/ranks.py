"""Row numbers and running sums within groups of any size, without a single-task window.

A plain ``row_number() over (partition by g)`` sends a group to one task. Here a group of n rows is
dealt over about sqrt(n) buckets by a hash of its rows; the window runs inside a bucket of about
sqrt(n) rows, and a second window adds up the sqrt(n) bucket totals. The numbering is gapless and
depends on the rows alone, not on partitions, so a recomputed task gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.scratch import materialize


def sorted_rank(df: DataFrame, order: list, out: str) -> DataFrame:
    """Add ``out``: the 0-based place of a row in the order of all rows.

    The rows are range-sorted and written; a place is the rows of the partitions before, and the row's place in its own. The second window
    has a row per partition.
    """
    rows = materialize(df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()), "sorted")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__low"))
    parts = parts.select("__p", "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    placed = rows.join(F.broadcast(parts), "__p").withColumn(out, (F.col("__base") + F.col("__m") - F.col("__low")).cast("long"))
    return placed.drop("__p", "__m", "__low", "__base")


def spread_rank(
    df: DataFrame,
    group: str,
    key: str,
    out: str,
    amount: str | None = None,
    bounded_groups: bool = False,
    order: list[str] | None = None,
) -> DataFrame:
    """Add ``out``: the 0-based position of a row in its group, or with ``amount`` the sum of
    ``amount`` over the rows before it.

    key: a column (no nulls expected; nulls sort first) that tells a group's rows apart; rows equal
    in group and key get different positions in an arbitrary order among themselves.
    order: columns that order the rows of a bucket, ``key`` alone by default.
    bounded_groups: the caller vouches that the number of groups is bounded, so the group sizes may
    be broadcast; otherwise they are joined by shuffle.
    """
    sizes = df.groupBy(F.col(group).alias("__g")).agg(
        F.ceil(F.sqrt(F.count(F.lit(1)).cast("double"))).alias("__buckets")
    )
    if bounded_groups:
        sizes = F.broadcast(sizes)
    dealt = (
        df.join(sizes, F.col(group).eqNullSafe(F.col("__g")), "left")
        .drop("__g")
        .withColumn("__b", F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.col("__buckets")))
        .drop("__buckets")
    )
    step: Column = F.col(amount) if amount else F.lit(1)
    totals = dealt.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__h")).agg(
        F.sum(step).alias("__n")
    )
    before = Window.partitionBy("__g").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "__g", "__h", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__base")
    )
    inside = Window.partitionBy(group, "__b").orderBy(*(order or [key]))
    if amount:
        local = F.coalesce(
            F.sum(step).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).cast("long")
    else:
        local = (F.row_number().over(inside) - 1).cast("long")
    ranked = dealt.withColumn("__local", local)
    return (
        ranked.join(
            totals,
            F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__h")),
            "left",
        )
        .withColumn(out, F.col("__local") + F.col("__base"))
        .drop("__g", "__h", "__b", "__local", "__base")
    )
