"""Validation of manifests and result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def require_columns(df: DataFrame, needed: set[str], exact: bool = False) -> None:
    """Raise if columns are missing, or with ``exact`` if there are others."""
    if lacking := sorted(needed - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    if exact and (more := sorted(set(df.columns) - needed)):
        raise ValueError(f"unexpected columns: {', '.join(more)}")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def blank(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""))


def not_functional(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with two values or more."""
    return df.select(key, value).distinct().groupBy(key).count().where("count > 1")


def stem(path):
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def gaps(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks."""
    return left.join(right.select(F.col(other).alias(key)).distinct(), key, "left_anti")


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one side has."""
    one = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    two = right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("right"))
    return one.unionByName(two)


def require_same_ids(found: DataFrame, expected: DataFrame, key: str) -> None:
    if differing := id_difference(found, expected, key).limit(5).collect():
        raise ValueError(f"result ids differ from the expected ones: {[tuple(r) for r in differing]}")


def rejected_cardinality(df: DataFrame, expected: int) -> bool:
    return df.limit(expected + 1).count() != expected
