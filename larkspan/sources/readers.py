"""Readers: PCM audio, track dictionaries, text postings, manifests, results, and the output of external matchers."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.columns import half_even
from larkspan.operators.checks import not_functional, require_columns, stem
from larkspan.operators.index import parse_postings


#: Zero crossings of the resampling kernel on each side.
CROSSINGS = 24


def resampled(x, own: int, rate: int):
    """Samples at another rate through a Hann-windowed sinc, whose cutoff is the lower of both rates; of n samples come round(n rate / own)."""
    import numpy as np

    if own == rate or not len(x):
        return x
    scale = min(1.0, rate / own)
    reach = int(np.ceil(CROSSINGS / scale))
    padded = np.pad(np.asarray(x, np.float64), reach + 1)
    out = np.empty(round(len(x) * rate / own))
    for low in range(0, len(out), 4096):
        at = np.arange(low, min(low + 4096, len(out))) * own / rate
        taps = np.floor(at).astype(np.int64)[:, None] + np.arange(-reach, reach + 2)
        away = (at[:, None] - taps) * scale
        kernel = np.sinc(away) * np.where(np.abs(away) < CROSSINGS, 0.5 + 0.5 * np.cos(np.pi * away / CROSSINGS), 0)
        out[low : low + 4096] = (padded[taps + reach + 1] * kernel).sum(axis=1) / kernel.sum(axis=1)
    return out


def decode_wav(content: bytes, rate: int | None = None):
    """16-bit mono samples of a PCM file of 8, 16, 24 or 32 bits, averaged over channels and resampled to ``rate``."""
    import numpy as np

    with wave.open(io.BytesIO(content)) as w:
        width, data = w.getsampwidth(), w.readframes(w.getnframes())
        channels, own = w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) * 256
    elif width == 3:  # the three bytes become the upper ones of four
        wide = np.zeros((len(data) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel() / 65536
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]) / {2: 1, 4: 65536}[width]
    x = x.reshape(-1, channels).mean(axis=1)
    if rate:
        x = resampled(x, own, rate)
    return np.clip(np.rint(x), -32768, 32767).astype(np.int16)


def read_audio(spark: SparkSession, path: str, rate: int = 40_000) -> DataFrame:
    """(track, sample_rate, samples) of the WAV files under ``path``; a file's stem names the track."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for track, content in zip(batch.column(0), batch.column(1), strict=True):  # one file at a time in memory
                samples = decode_wav(content.as_py(), rate)
                yield pa.record_batch([pa.array([track.as_py()]), pa.array([rate], pa.int32()), pa.array([samples], pa.list_(pa.int16()))], ["track", "sample_rate", "samples"])

    return files.select(stem(F.col("path")).alias("track"), "content").mapInArrow(run, "track string, sample_rate int, samples array<short>")


def segment(samples, begin, end, rate):
    """Samples of [begin, end) seconds, bounds rounded half to even and clamped; an empty cut is an error."""
    low = F.greatest(half_even(begin * rate), F.lit(0))
    high = F.least(half_even(end * rate), F.size(samples))
    return F.when(high > low, F.slice(samples, low + 1, F.greatest(high - low, F.lit(0)))).otherwise(F.raise_error(F.lit("empty segment")))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(track_id, track, total_hashes) of a dictionary whose names may hold commas."""
    line = F.col("value")
    parts = [F.regexp_extract(line, r"^(\d+),(.*),(\d+)$", k) for k in (1, 2, 3)]
    rows = spark.read.text(path).where(F.trim(line) != "")
    return rows.select(parts[0].cast("long").alias("track_id"), parts[1].alias("track"), parts[2].cast("long").alias("total_hashes"))


def read_text_index(spark: SparkSession, path: str) -> DataFrame:
    """(hash, track_id, offset) of lines ``hash,count,song:offset-song:offset``; a count that differs from the list is an error."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("hash"), parts[1].cast("int").alias("n"), parse_postings(parts[2]).alias("p"))
    checked = rows.withColumn("p", F.when(F.size("p") == F.col("n"), F.col("p")).otherwise(F.raise_error(F.lit("posting count differs from list"))))
    # Rows of one hash meet once here, as counts; a hash with two rows is an error.
    once = checked.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.first("p").alias("p"))
    checked = once.withColumn("p", F.when(F.col("m") == 1, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("repeated hash "), F.col("hash")))))
    return checked.select("hash", F.explode("p").alias("x")).select("hash", F.col("x.song").alias("track_id"), "x.offset")


def read_manifest(spark: SparkSession, path: str, schema: str, optional: dict[str, str] | None = None) -> DataFrame:
    """A CSV with header. Text columns come by name (a byte order mark is dropped), are checked against ``schema`` and cast.

    optional: columns that may be absent, with the value they then have.
    """
    raw = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    wanted = spark.createDataFrame([], schema).schema
    for name, value in (optional or {}).items():
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(value))
    require_columns(raw, {f.name for f in wanted})
    out = [F.col(f.name) if f.dataType.simpleString() == "string" else F.nullif(F.trim(f.name), F.lit("")).cast(f.dataType).alias(f.name) for f in wanted]
    return raw.select(*[c if f.dataType.simpleString() != "string" else F.coalesce(c, F.lit("")).alias(f.name) for c, f in zip(out, wanted, strict=True)])


TRIALS = "query_id string, reference_id string, query_path string, reference_path string, reference_begin_seconds double, query_duration_seconds double"
ANNOTATIONS = "reference_id string, query_id string, reference_begin int, reference_end int, query_begin int, query_end int, tempo string, pitch string"


def changed_files(spark: SparkSession, manifests: list[DataFrame], path: str) -> DataFrame:
    """(path, problem) of files under ``path`` against manifests of (path, sha256), in path order: ``missing``, ``differs``, ``unlisted``, or
    ``conflict`` where manifests disagree. Paths are relative; contents are read and digested by the executors."""
    listed = manifests[0].select("path", "sha256")
    for m in manifests[1:]:
        listed = listed.unionByName(m.select("path", "sha256"))
    listed = listed.groupBy("path").agg(F.min("sha256").alias("sha256"), F.max("sha256").alias("other"))
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.expr(f"substring(path, instr(path, '{root}') + {len(root) + 1})")
    held = files.select(name.alias("path"), F.sha2("content", 256).alias("found"))
    problem = (
        F.when(F.col("sha256") != F.col("other"), "conflict").when(F.col("sha256").isNull(), "unlisted").when(F.col("found").isNull(), "missing")
        .when(F.col("found") != F.lower("sha256"), "differs")
    )
    return listed.join(held, "path", "full_outer").select("path", problem.alias("problem")).where("problem is not null").orderBy("path")


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return read_manifest(spark, path, TRIALS)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return read_manifest(spark, path, ANNOTATIONS, {"tempo": "", "pitch": ""})


def _resolved(path, root: str):
    """An absolute path as it is, another one under ``root``."""
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    return F.regexp_replace(full, "/(\\./)+", "/")


def trial_faults(trials: DataFrame, files: DataFrame, root: str, seconds: float) -> DataFrame:
    """(fault, id) of trials against the audio files (path, track) that exist: ``empty`` or ``repeated`` query ids, ``missing`` audio, a ``stem`` that
    is not the id, a ``reference`` with several paths, a ``duration`` other than ``seconds``."""
    t = trials.select(
        F.trim("query_id").alias("id"), F.trim("reference_id").alias("ref"), _resolved(F.col("query_path"), root).alias("q"),
        _resolved(F.col("reference_path"), root).alias("r"), "query_duration_seconds",
    )
    held = files.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("held")).distinct()
    named = lambda name, df, key="id": df.select(F.lit(name).alias("fault"), F.col(key).alias("id"))
    asked = t.select("id", F.explode(F.array("q", "r")).alias("p"))
    found = [
        named("empty", t.where("id = ''")), named("repeated", t.groupBy("id").count().where("count > 1")),
        named("missing", asked.join(held, asked["p"] == held["held"], "left_anti")),
        named("stem", t.where((stem(F.col("q")) != F.col("id")) | (stem(F.col("r")) != F.col("ref")))),
        named("reference", not_functional(t, "ref", "r"), "ref"),
        named("duration", t.where(F.coalesce(F.abs(F.col("query_duration_seconds") - seconds) > 1e-6, F.lit(True)))),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def annotation_faults(annotations: DataFrame, references: DataFrame, queries: DataFrame) -> DataFrame:
    """(fault, id): ``stem`` for a name that several reference files share, ``missing`` for annotations without one of their files, ``interval`` for
    empty or unreadable query intervals."""
    a = annotations.withColumn("query_id", F.trim("query_id")).withColumn("reference_id", F.trim("reference_id"))
    shared = references.groupBy("track").count().where("count > 1").select(F.lit("stem").alias("fault"), F.col("track").alias("id"))
    one = a.join(references.select(F.col("track").alias("reference_id")).distinct(), "reference_id", "left_anti").select(F.lit("missing").alias("fault"), F.col("reference_id").alias("id"))
    two = a.join(queries.select(F.col("track").alias("query_id")).distinct(), "query_id", "left_anti").select(F.lit("missing").alias("fault"), F.col("query_id").alias("id"))
    empty = a.where(~F.coalesce(F.col("query_end") > F.col("query_begin"), F.lit(False))).select(F.lit("interval").alias("fault"), F.col("query_id").alias("id"))
    return shared.unionByName(one).unionByName(two).unionByName(empty).distinct()


def _sound(rows: DataFrame, faults: DataFrame) -> DataFrame:
    if bad := faults.orderBy("fault", "id").limit(5).collect():
        raise ValueError(f"faults: {[tuple(r) for r in bad]}")
    return rows


def load_trials(spark: SparkSession, root: str, trials: int | None = None, references: int | None = None, seconds: float = 10.0) -> DataFrame:
    """The trials of ``root``/manifest.csv, checked against the files under ``root`` and the expected numbers."""
    rows = read_trials(spark, f"{root}/manifest.csv")
    _sound(rows, trial_faults(rows, list_audio(spark, root, True), root, seconds))
    n = rows.agg(F.count(F.lit(1)), F.countDistinct(F.trim("reference_id"))).first()
    if (trials or n[0], references or n[1]) != tuple(n):
        raise ValueError(f"{references} references and {trials} trials are due, found {n[1]} and {n[0]}")
    return rows


def load_annotations(spark: SparkSession, root: str, references: int | None = None, queries: int | None = None) -> DataFrame:
    """The annotations of ``root``/annotations.csv, checked against the files in ``root``/references and ``root``/queries and their expected numbers."""
    rows, held, asked = read_annotations(spark, f"{root}/annotations.csv"), list_audio(spark, f"{root}/references", True), list_audio(spark, f"{root}/queries", False)
    _sound(rows, annotation_faults(rows, held, asked))
    n = held.count(), asked.count()
    if (references or n[0], queries or n[1]) != n:
        raise ValueError(f"{references} references and {queries} queries are due, found {n[0]} and {n[1]}")
    return rows


def list_audio(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """(path, track) of audio files; hidden files are skipped, contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path")
    return files.where(~F.regexp_like("path", F.lit(r"/\.[^/]*$"))).select("path", stem(F.col("path")).alias("track")).orderBy("path")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_manifest(spark, path, schema)


def read_completed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame | None:
    """Rows of an earlier run that did not fail; None if its columns differ."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.where("status <> 'error'") if rows.columns == columns else None


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_vectors(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Stored embeddings; a vector of another width, or none at all, is an error."""
    rows = spark.read.parquet(path)
    if rows.isEmpty() or not rows.where(F.size("embedding") != width).isEmpty():
        raise ValueError(f"no vectors, or vectors that do not have {width} dimensions")
    return rows


def parse_semicolon_matches(lines: DataFrame) -> DataFrame:
    """Lines of 13 fields to match rows; headers and ``null`` matches go, a bad number is an error."""
    f = F.split("value", r"\s*;\s*")
    rows = lines.where(F.size(f) == 13).select(f.alias("f")).where((F.col("f")[0] != "Index") & (F.col("f")[5] != "null"))
    g = lambda k: F.col("f")[k]
    return rows.select(g(2).alias("query_path"), g(3).cast("double").alias("query_start"), g(4).cast("double").alias("query_stop"), g(5).alias("match_path"), g(6).alias("reference_id"),
                       g(7).cast("double").alias("reference_start"), g(8).cast("double").alias("reference_stop"), g(9).cast("double").alias("score"), g(12).cast("double").alias("seconds_with_match"))


def split_json(text: str) -> list:
    """Documents of whitespace-separated JSON."""
    decoder, at, out = json.JSONDecoder(), 0, []
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        value, at = decoder.raw_decode(text, at)
        out.append(value)
    return out


def parse_store_records(lines: DataFrame, schema: str) -> DataFrame:
    """JSON log lines whose action is ``store``."""
    rows = lines.where(F.startswith(F.trim("value"), F.lit("{"))).select(F.from_json("value", schema).alias("x"))
    return rows.where("x.action = 'store'").select("x.*")


def parse_stats(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """One number per pattern, scraped from all lines; a pattern that finds none is an error."""
    found = [F.max(F.try_to_number(F.nullif(F.regexp_extract("value", p, 1), F.lit("")), F.lit("999999999999999"))).alias(k) for k, p in patterns.items()]
    out = lines.agg(*found)
    return out.select(*[F.coalesce(k, F.raise_error(F.lit(f"no value for {k}")).cast("decimal(15,0)")).cast("long").alias(k) for k in patterns])
