"""The index on disk: versioned, all-or-nothing commits of segments; atomic reports.

A store is a folder with segments and a pointer file that lists the current ones. A build writes the new tracks' segment beside the old ones and
then replaces the pointer in one rename, so a crash leaves either the old index or the new one, never a mixture, and a build that is
run again cannot add postings twice. Segments are never changed; when a level has FANOUT of them, they are merged into one of the next level, so
a posting is rewritten once per level and not at every build. A track lies in one segment, so the statistics of segments add up.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.ranks import sorted_rank
from larkspan.scratch import materialize

#: Segments of a level that are merged into one of the next.
FANOUT = 8
#: Rows of a report.
REPORT_ROWS = 1_000_000


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, config: dict | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)
        if config is not None:
            known = self._read("config.json")
            if known is None:
                self._write("config.json", json.dumps(config, sort_keys=True))
            elif json.loads(known) != json.loads(json.dumps(config)):
                raise ValueError("the index was built with another configuration")

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _read(self, name: str) -> str | None:
        at = self._at(f"{self.path}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        write_atomically(self.spark, f"{self.path}/{name}", text)

    def _state(self) -> dict:
        return json.loads(self._read("CURRENT") or '{"version": 0, "segments": []}')

    def version(self) -> int:
        """The current version; 0 if there is none."""
        return self._state()["version"]

    def exists(self) -> bool:
        return self.version() > 0

    def levels(self) -> list[int]:
        """The level of every current segment."""
        return [level for _, level in self._state()["segments"]]

    def _table(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{segment}/{name}" for segment, _ in self._state()["segments"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def tracks(self) -> DataFrame:
        return self._table("tracks", "track_id long, track string, total_hashes long")

    def postings(self) -> DataFrame:
        """(hash, track_id, offset), sorted by hash within the files of a segment."""
        return self._table("postings", "hash long, track_id long, offset int")

    def stats(self) -> DataFrame:
        """(hash, df, n) over all segments."""
        return self._table("stats", "hash long, df long, n long").groupBy("hash").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))

    def _write_segment(self, tracks: DataFrame, postings: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        base = f"{self.path}/{name}"
        tracks.write.parquet(f"{base}/tracks")
        postings.repartitionByRange("hash").sortWithinPartitions("hash", "track_id", "offset").write.parquet(f"{base}/postings")
        kept = self.spark.read.parquet(f"{base}/postings")
        per_track = kept.groupBy("hash", "track_id").agg(F.count(F.lit(1)).alias("n"))
        per_track.groupBy("hash").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n")).write.parquet(f"{base}/stats")
        return name

    def add(self, fingerprints: DataFrame) -> int:
        """Add (track, hash, offset) of tracks that the index lacks; returns how many were added. Nothing new, no version.

        One writer at a time. The rows are written once before they are numbered, so a stream's batch or a costly plan runs once.
        """
        state, known = self._state(), self.tracks()
        new = materialize(fingerprints.distinct().join(known.select("track"), "track", "left_anti"), "new")
        sizes = new.groupBy("track").agg(F.count(F.lit(1)).alias("total_hashes"))
        last = known.agg(F.coalesce(F.max("track_id"), F.lit(0))).first()[0]
        named = sorted_rank(sizes, ["track"], "track_id").select((F.col("track_id") + last + 1).alias("track_id"), "track", "total_hashes")
        named = materialize(named, "named")
        if not (added := named.count()):
            return 0
        postings = new.join(named.select("track", "track_id"), "track").select("hash", "track_id", F.col("offset").cast("int").alias("offset"))
        segments = [*state["segments"], [self._write_segment(named, postings), 0]]
        level = 0
        while len(full := [s for s, at in segments if at == level]) >= FANOUT:
            old = [f"{self.path}/{s}" for s in full]
            merged = self._write_segment(*(self.spark.read.parquet(*[f"{p}/{t}" for p in old]) for t in ("tracks", "postings")))
            segments = [[s, at] for s, at in segments if at != level] + [[merged, level + 1]]
            level += 1
        self._write("CURRENT", json.dumps({"version": state["version"] + 1, "segments": segments}))
        return added

    def clean(self) -> int:
        """Delete segments that the pointer does not list: merged ones, and what a build that did not reach its pointer left. No build may
        be running."""
        listed = {s for s, _ in self._state()["segments"]}
        gone = [x.getPath() for x in self._fs.listStatus(self._at(self.path)) if x.getPath().getName().startswith("segment-") and x.getPath().getName() not in listed]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def write_atomically(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then replace it by a rename; the temporary file goes if that fails."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    try:
        stream = fs.create(beside)
        stream.write(bytearray(text.encode()))
        stream.close()
        option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf).rename(beside, target, options)
    finally:
        if fs.exists(beside):
            fs.delete(beside, False)


def write_report(df: DataFrame, path: str, order: list[str], most: int = REPORT_ROWS) -> None:
    """A small table as one CSV file, sorted, replaced atomically. More than ``most`` rows are an error: they would have to pass the driver."""
    import csv
    import io

    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(rows)
    write_atomically(df.sparkSession, path, out.getvalue())


def write_summary(spark: SparkSession, value: dict, path: str) -> None:
    write_atomically(spark, path, json.dumps(value, indent=2, sort_keys=True) + "\n")
