"""Evaluation runs: gates over summaries and results, summary metrics, checkpoints that a later run resumes from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators.checks import require_columns

#: Bytes of a reference record and of a query record, by family; a family without query records has none.
FAMILIES = {"hash": (16, 12), "second": (20, None), "neural": (520, 516)}
MIB = 1048576.0


def gate(summaries: DataFrame, rows: DataFrame, schema: str, protocol: str) -> DataFrame:
    """(system, reason): why a system's results may not enter a report.

    summaries: (system, schema, protocol, expected, trials, errors), a row per system. rows: (system, status). Reasons: ``schema``, ``protocol``,
    ``trials`` (the summary's or the rows' number is not the expected one), ``errors`` (the summary counts any), ``rows`` (failed rows remain),
    ``unknown`` (rows of a system without a summary).
    """
    found = rows.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "error", 1)).alias("failed"))
    both = summaries.join(found, "system", "full_outer")
    n = F.coalesce("n", F.lit(0))
    reasons = {
        "unknown": F.col("expected").isNull(), "schema": F.col("schema") != schema, "protocol": F.col("protocol") != protocol,
        "trials": (n != F.col("expected")) | (F.coalesce("trials", F.lit(0)) != F.col("expected")), "errors": F.coalesce("errors", F.lit(0)) != 0, "rows": F.col("failed") > 0,
    }
    each = F.array(*[F.when(F.coalesce(bad, F.lit(name in ("schema", "protocol")) & F.col("expected").isNotNull()), F.lit(name)) for name, bad in reasons.items()])
    return both.select("system", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("reason"))


def require_report(summaries: DataFrame, rows: DataFrame, schema: str, protocol: str, columns: set[str]) -> None:
    """Raise if the rows have other columns, or any system is kept out by ``gate``."""
    require_columns(rows, columns | {"system", "status"}, exact=True)
    if bad := gate(summaries, rows, schema, protocol).limit(5).collect():
        raise ValueError(f"results may not be reported: {[tuple(r) for r in bad]}")


def finished(due: DataFrame, summaries: DataFrame) -> DataFrame:
    """(system, finished): which of the runs that are due need not run again.

    due: (system, schema, protocol, trials). summaries: (system, text), the text of a run's summary file if it has one. A summary that is no
    JSON object, belongs to another schema, protocol or system, counts other trials, or counts errors does not finish a run.
    """
    found = summaries.select("system", F.from_json("text", "schema string, protocol string, system string, trials long, errors long").alias("s"))
    own = F.struct("schema", "protocol", "system", "trials") == F.col("s").dropFields("errors")
    clean = F.coalesce(F.col("s.errors"), F.lit(0)) == 0
    return due.join(found, "system", "left").select("system", F.coalesce(own & clean & F.col("s").isNotNull(), F.lit(False)).alias("finished"))


def mean_present(value: Column) -> Column:
    """Mean of the numbers in a text column, over those that are neither null nor empty."""
    return F.avg(F.nullif(value, F.lit("")).cast("decimal(20,6)"))


def avoided_fraction(rows: DataFrame) -> DataFrame:
    """(trials, avoided): the share of queries that stage one settled, from a row per query with its stage."""
    return rows.agg(F.count(F.lit(1)).alias("trials"), F.avg((F.col("stage") == "original").cast("int")).alias("avoided"))


def payloads(records: Column, seconds: Column, mean_query_records: Column) -> Column:
    """An array of (family, reference MiB per hour, mean query MiB)."""
    return F.array(*[
        F.struct(
            F.lit(name).alias("family"), (records * reference / MIB / (seconds / 3600.0)).alias("mib_per_hour"),
            (mean_query_records * query / MIB if query else F.lit(None).cast("double")).alias("query_mib"),
        )
        for name, (reference, query) in FAMILIES.items()
    ])


def resumable(spark: SparkSession, trials: DataFrame, key: str, group: str, evaluate: Callable[[DataFrame], DataFrame], path: str, parts: int = 1, stop_after: int | None = None) -> DataFrame:
    """Evaluate the trials that ``path`` lacks, group by group, and return all results.

    Results are written as one commit for each of ``parts`` parts of the groups, so a run that is stopped keeps what it has committed; the next
    run takes up the groups of which any trial is missing or failed (status ``error``), and evaluates them whole. Each commit is a folder of
    its own; where a group was evaluated again, the later folder counts. ``stop_after`` ends a run after that many commits.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)

    def commits() -> list[int]:
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def results(done: list[int]) -> DataFrame:
        out = None
        for n in done:
            one = spark.read.parquet(f"{path}/{n:06d}").withColumn("__commit", F.lit(n))
            out = one if out is None else out.unionByName(one)
        latest = out.groupBy(F.col(group).alias("__g")).agg(F.max("__commit").alias("__c"))
        same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__commit") == F.col("__c"))
        return out.join(latest, same).drop("__g", "__c", "__commit")

    done = commits()
    todo = trials
    if done:
        good = results(done).where("status <> 'error'").select(key)
        todo = trials.join(trials.join(good, key, "left_anti").select(group).distinct(), group, "left_semi")
    if not todo.isEmpty():
        for k in range(parts):
            if stop_after is not None and k >= stop_after:
                break
            part = todo.where(F.pmod(F.xxhash64(group), F.lit(parts)) == k)
            number = (commits() or [-1])[-1] + 1
            evaluate(part).write.mode("overwrite").parquet(f"{path}/{number:06d}")
    return results(commits()) if commits() else evaluate(trials.limit(0))
