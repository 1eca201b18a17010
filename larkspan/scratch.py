"""Intermediate tables in the folder that the whole cluster shares.

``spark.checkpoint.dir`` names that folder. Only a local session (unit tests, a laptop) may leave it unset; a temporary folder is made then. A
table written here cuts the lineage: a lost executor costs the tasks it was running, not the stages before the table.
Tables go when ``release`` is called, or with the interpreter.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
#: Share of the driver's heap in use from which finished queries are cleared away.
FULL = 0.4


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet (with a writer's ``options``, in a folder for each value of ``by``) under the shared folder and
    return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspan-{uuid.uuid4().hex}/{name}"
    if not _made:
        atexit.register(_sweep)
    _made.append(path)
    df.write.options(**(options or {})).parquet(path, partitionBy=by)
    tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def tidy(spark: SparkSession) -> bool:
    """Collect the driver's garbage if more than ``FULL`` of its heap is in use; whether it was.

    Spark drops the broadcasts and shuffles of finished queries when the driver's collector finds them unreachable, and the collector lets the heap
    grow to its limit before it looks at all of it. Operators of many short queries pile them up.
    """
    java = spark.sparkContext._jvm.java.lang
    runtime = java.Runtime.getRuntime()
    full = runtime.totalMemory() - runtime.freeMemory() > FULL * runtime.maxMemory()
    if full:
        java.System.gc()
    return full


def release(*tables: DataFrame | str) -> None:
    """Delete tables that ``materialize`` returned, or their paths. Nothing may read them any more."""
    paths = [t if isinstance(t, str) else t._scratch for t in tables]
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        folder = jvm.org.apache.hadoop.fs.Path(p).getParent()
        folder.getFileSystem(conf).delete(folder, True)
        if p in _made:
            _made.remove(p)


@contextlib.contextmanager
def kept_only() -> Iterator[list[DataFrame]]:
    """Release what is made inside, but for the tables that are put on the list."""
    first, keep = len(_made), []
    yield keep
    held = {t._scratch for t in keep}
    release(*[p for p in _made[first:] if p not in held])


def _sweep() -> None:
    try:
        release(*_made)
    except Exception:  # the session may be gone at interpreter exit
        pass
