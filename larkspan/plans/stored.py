"""Tables that are built once in a session and probed by many queries: postings, points, faces, probes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.scratch import materialize

_built: dict[tuple, tuple[tuple, DataFrame]] = {}


def _stamp(spark: SparkSession, sf: str, name: str) -> tuple:
    """What changes when a table's files do."""
    files = spark.read.parquet(f"{sf}/{name}.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count(F.lit(1)), F.sum("file_size"), F.max("file_modification_time"), F.bit_xor(F.xxhash64("file_path"))).first()
    return tuple(row)


def stored(spark: SparkSession, sf: str, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a table in the shared folder: built by the session's first query that needs it, and again when the files of ``source`` change."""
    key = (spark.sparkContext.applicationId, sf, name)
    stamp = _stamp(spark, sf, source)
    if key not in _built or _built[key][0] != stamp:
        _built[key] = (stamp, materialize(build(), name))
    return _built[key][1]
