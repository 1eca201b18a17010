"""What several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\f\r"
#: The same as a Java and DuckDB character class.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; null or blank text gives an empty array."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words, as long."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^\\x20\\x09-\\x0D]+")).cast("long")


#: Bits of a bitmap filter; it never exceeds FILTER_BITS / 8 bytes.
FILTER_BITS = 1 << 24
#: Keys up to which a bitmap tells enough rows apart; beyond, callers join by shuffle.
FILTER_KEYS = FILTER_BITS // 8
#: Bits in one row of bitmap_construct_agg.
_PART = 32768


def fits(keys: DataFrame) -> bool:
    """Whether a bitmap of these rows' keys is worth while."""
    return keys.limit(FILTER_KEYS + 1).count() <= FILTER_KEYS


def bitmap(keys: DataFrame, bits: int = FILTER_BITS) -> Column:
    """A bitmap of ``keys.key`` (long) as an array of parts: a scalar subquery, computed once."""
    slot = F.pmod(F.xxhash64("key"), F.lit(bits))
    parts = keys.groupBy(F.floor(slot / _PART).cast("int").alias("b")).agg(
        F.bitmap_construct_agg(F.pmod(slot, F.lit(_PART))).alias("m")
    )
    found = parts.agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("found"))
    return found.select(
        F.transform(F.sequence(F.lit(0), F.lit(bits // _PART - 1)), lambda i: F.col("found")[i])
    ).scalar()


def maybe(key: Column, members: Column, bits: int = FILTER_BITS) -> Column:
    """Whether a key (long) may be in a bitmap: no member is missed, few others pass."""
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    part = F.get(members, F.floor(slot / _PART).cast("int"))
    at = F.pmod(slot, F.lit(_PART))
    byte = F.conv(F.hex(F.substring(part, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(1) == 1, F.lit(False))
