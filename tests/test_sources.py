import hashlib
import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan import scratch
from larkspan.operators import evaluation as E
from larkspan.sources import readers as R
from larkspan.sources.store import IndexStore, write_report, write_summary
from larkspan.streaming import increment
from tests.test_functions import tone


def wav(samples, rate=40_000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def test_audio_reader(spark, tmp_path):
    x = tone(0.1)
    (tmp_path / "one.wav").write_bytes(wav(x))
    (tmp_path / "two.wav").write_bytes(wav(np.repeat(x[:100], 2), channels=2))
    got = {r.track: r.samples for r in R.read_audio(spark, str(tmp_path)).collect()}
    assert got["one"] == x.tolist() and got["two"] == x[:100].tolist()
    assert len(R.decode_wav(wav(x, 20_000), 40_000)) == 2 * len(x)
    assert [r.track for r in R.list_audio(spark, str(tmp_path), True).collect()] == ["one", "two"]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_sample_widths(width):
    x = tone(0.05)[:200] // 256 * 256
    raw = {1: (x // 256 + 128).astype(np.uint8).tobytes(), 2: x.tobytes(), 4: (x.astype("<i4") << 16).tobytes()}
    raw[3] = (x.astype("<i4") << 8).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(width), w.setframerate(8000), w.writeframes(raw[width])
    assert R.decode_wav(out.getvalue()).tolist() == x.tolist()


def test_resampling_is_band_limited():
    t = np.arange(8000) / 8000
    low, high = np.sin(2 * np.pi * 300 * t), np.sin(2 * np.pi * 3300 * t)
    down = R.resampled(low + high, 8000, 4000)  # 3,300 Hz lies above the new limit and must not come back as 700 Hz
    assert len(down) == 4000 and np.abs(down[100:-100] - np.sin(2 * np.pi * 300 * np.arange(4000) / 4000)[100:-100]).max() < 0.02
    up = R.resampled(low, 8000, 44100)
    assert len(up) == 44100 and np.abs(up[500:-500] - np.sin(2 * np.pi * 300 * np.arange(44100) / 44100)[500:-500]).max() < 0.01


def test_trials_are_checked_on_load(spark, tmp_path):
    for name in ("q/q1.wav", "q/q2.wav", "r/r1.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    head = "query_id,reference_id,query_path,reference_path,reference_begin_seconds,query_duration_seconds\n"
    good = ["q1,r1,q/q1.wav,r/r1.wav,0,10.0", f"q2,r1,{tmp_path}/q/q2.wav,r/r1.wav,5,10"]
    write = lambda *rows: (tmp_path / "manifest.csv").write_text(head + "\n".join(rows) + "\n")
    write(*good)
    assert R.load_trials(spark, str(tmp_path), trials=2, references=1).count() == 2
    with pytest.raises(ValueError, match="496 references"):
        R.load_trials(spark, str(tmp_path), trials=1488, references=496)
    bad = {"repeated": good[0], "empty": " ,r1,q/q1.wav,r/r1.wav,0,10", "missing": "q3,r1,q/q3.wav,r/r1.wav,0,10", "stem": "q3,r1,q/q2.wav,r/r1.wav,0,10",
           "reference": f"q3,r1,q/q2.wav,{tmp_path}/q/q1.wav,0,10", "duration": "q3,r1,q/q2.wav,r/r1.wav,0,9"}
    for fault, row in bad.items():
        write(*good, row)
        files = R.list_audio(spark, str(tmp_path), True)
        found = R.trial_faults(R.read_trials(spark, str(tmp_path / "manifest.csv")), files, str(tmp_path), 10.0).collect()
        assert fault in {r.fault for r in found}, fault
    with pytest.raises(ValueError, match="faults"):
        R.load_trials(spark, str(tmp_path))


def test_annotations_are_checked_on_load(spark, tmp_path):
    for name in ("queries/q.wav", "references/a/r.wav", "references/s.wav"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    head = "reference_id,query_id,reference_begin,reference_end,query_begin,query_end,tempo\n"
    write = lambda row: (tmp_path / "annotations.csv").write_text(head + row + "\n")
    write("r,q,0,5,1,6,100")
    assert R.load_annotations(spark, str(tmp_path), references=2, queries=1).first().tempo == "100"
    for row, fault in (("x,q,0,5,1,6,", "missing"), ("r,y,0,5,1,6,", "missing"), ("r,q,0,5,6,6,", "interval")):
        write(row)
        with pytest.raises(ValueError, match=fault):
            R.load_annotations(spark, str(tmp_path))
    (tmp_path / "references" / "r.mp3").write_bytes(b"x")
    write("r,q,0,5,1,6,")
    with pytest.raises(ValueError, match="stem"):
        R.load_annotations(spark, str(tmp_path))


def test_segment(spark):
    df = spark.createDataFrame([([*range(10)],)], "s array<int>")
    assert df.select(R.segment(F.col("s"), F.lit(0.5), F.lit(2.5), 1)).first()[0] == [0, 1]  # halves go to even bounds
    with pytest.raises(Exception, match="empty segment"):
        df.select(R.segment(F.col("s"), F.lit(20.0), F.lit(30.0), 1)).collect()


def test_dictionary_and_text_index(spark, tmp_path):
    (tmp_path / "songs.csv").write_text("1,a,b, c,12\n2,plain,3\n")
    assert [tuple(r) for r in R.read_tracks(spark, str(tmp_path / "songs.csv")).orderBy("track_id").collect()] == [(1, "a,b, c", 12), (2, "plain", 3)]
    (tmp_path / "inv.csv").write_text("tri:1:2:3:4:5,2,1:7-2:9\n")
    assert sorted(map(tuple, R.read_text_index(spark, str(tmp_path / "inv.csv")).collect())) == [("tri:1:2:3:4:5", 1, 7), ("tri:1:2:3:4:5", 2, 9)]
    (tmp_path / "bad.csv").write_text("h,3,1:7-2:9\n")
    with pytest.raises(Exception, match="count differs"):
        R.read_text_index(spark, str(tmp_path / "bad.csv")).collect()


def test_manifests(spark, tmp_path):
    path = tmp_path / "annotations.csv"
    path.write_text("﻿reference_id,query_id,reference_begin,reference_end,query_begin,query_end\nr,q,1,2,3,\n", encoding="utf-8")
    assert tuple(R.read_annotations(spark, str(path)).first()) == ("r", "q", 1, 2, 3, None, "", "")
    with pytest.raises(ValueError, match="missing columns"):
        R.read_trials(spark, str(path))
    res = tmp_path / "results.csv"
    res.write_text("id,status\n1,matched\n2,error\n")
    assert R.read_completed(spark, str(res), ["id", "status"]).count() == 1 and R.read_completed(spark, str(res), ["id"]) is None
    (tmp_path / "s.json").write_text(json.dumps({"index": {"seconds": 123.5}}, indent=1))
    assert R.read_summary(spark, str(tmp_path / "s.json"), "index struct<seconds: double>").first()["index"].seconds == 123.5


def test_external_outputs(spark):
    line = "1 ; 1 ; q.wav ; 0.5 ; 9 ; m.wav ; 7 ; 1.0 ; 2.0 ; 12 ; 1 ; 1 ; 0.9"
    lines = spark.createDataFrame([("Index;" * 12 + "x",), (line,), ("noise",), (line.replace("m.wav", "null"),)], "value string")
    got = R.parse_semicolon_matches(lines).collect()
    assert len(got) == 1 and (got[0].reference_id, got[0].score, got[0].seconds_with_match) == ("7", 12.0, 0.9)
    assert R.split_json('{"a": 1}\n [2] ') == [{"a": 1}, [2]]
    logs = spark.createDataFrame([('{"action": "store", "id": 3}',), ('{"action": "x", "id": 4}',), ("text",)], "value string")
    assert [r.id for r in R.parse_store_records(logs, "action string, id int").collect()] == [3]
    stats = spark.createDataFrame([("songs = 12",), ("hashes = 99",)], "value string")
    assert tuple(R.parse_stats(stats, {"songs": r"songs = (\d+)", "hashes": r"hashes = (\d+)"}).first()) == (12, 99)
    with pytest.raises(Exception, match="no value"):
        R.parse_stats(stats, {"x": r"x = (\d+)"}).collect()


def test_stored_vectors(spark, tmp_path):
    spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>").write.parquet(str(tmp_path / "v"))
    assert R.read_vectors(spark, str(tmp_path / "v"), 2).count() == 1
    with pytest.raises(ValueError):
        R.read_vectors(spark, str(tmp_path / "v"), 3)


def rows(spark, *tracks):
    return spark.createDataFrame([(t, h, h % 3) for t in tracks for h in range(5)], "track string, hash long, offset int")


def test_store_is_versioned_and_idempotent(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index", {"a": 1})
    assert not store.exists() and store.tracks().count() == 0
    assert store.add(rows(spark, "b", "a")) == 2 and store.version() == 1
    assert store.add(rows(spark, "a", "b")) == 0 and store.version() == 1
    assert store.add(rows(spark, "c", "a")) == 1
    assert {r.track: r.track_id for r in store.tracks().collect()} == {"a": 1, "b": 2, "c": 3}
    assert store.postings().count() == 15 and store.stats().where("df <> 3 or n <> 3").isEmpty()
    (tmp_path / "index" / "segment-x").mkdir()  # what a crash before the pointer leaves
    assert store.add(rows(spark, "d")) == 1 and store.postings().count() == 20
    assert store.clean() == 1 and store.postings().count() == 20
    with pytest.raises(ValueError, match="configuration"):
        IndexStore(spark, f"file://{tmp_path}/index", {"a": 2})


def test_segments_are_merged_by_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("larkspan.sources.store.FANOUT", 2)
    store = IndexStore(spark, f"file://{tmp_path}/index")
    for n, name in enumerate("abcde", 1):
        assert store.add(rows(spark, name)) == 1 and store.version() == n
    assert sorted(store.levels()) == [0, 2]
    assert store.postings().count() == 25 and store.stats().where("df <> 5 or n <> 5").isEmpty()
    assert {r.track: r.track_id for r in store.tracks().collect()} == {t: k for k, t in enumerate("abcde", 1)}
    assert store.clean() == 6 and store.postings().count() == 25


def test_changed_files(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    for name in ("a", "b", "sub/c", "x"):
        (tmp_path / "d" / name).write_text(name)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    one = spark.createDataFrame([("a", sha("a")), ("b", sha("z")), ("sub/c", sha("sub/c"))], "path string, sha256 string")
    two = spark.createDataFrame([("gone", sha("g")), ("a", sha("a"))], "path string, sha256 string")
    three = spark.createDataFrame([("gone", sha("h"))], "path string, sha256 string")
    check = lambda *m: [tuple(r) for r in R.changed_files(spark, list(m), str(tmp_path / "d")).collect()]
    assert check(one, two) == [("b", "differs"), ("gone", "missing"), ("x", "unlisted")]
    assert check(one, two, three)[1] == ("gone", "conflict")


def test_repeated_hash_rows_are_rejected(spark, tmp_path):
    (tmp_path / "inv.csv").write_text("h,1,1:7\nh,1,2:9\n")
    with pytest.raises(Exception, match="repeated hash h"):
        R.read_text_index(spark, str(tmp_path / "inv.csv")).collect()


def test_gates(spark):
    summary = lambda **k: json.dumps({"schema": "s", "protocol": "p", "system": "x", "trials": 3} | k)
    due = spark.createDataFrame([("x", "s", "p", 3)], "system string, schema string, protocol string, trials long")

    def done(text):
        return E.finished(due, spark.createDataFrame([("x", text)], "system string, text string")).first().finished

    assert done(summary()) and done(summary(errors=0))
    assert not any(map(done, [None, "{", "[]", "3", summary(trials=2), summary(errors=1), summary(schema="t"), summary(system="y")]))
    assert not E.finished(due, spark.createDataFrame([], "system string, text string")).first().finished
    rows = spark.createDataFrame([("x", "matched", 1)] * 3, "system string, status string, v int")
    good = spark.createDataFrame([("x", "s", "p", 3, 3, 0)], "system string, schema string, protocol string, expected long, trials long, errors long")
    E.require_report(good, rows, "s", "p", {"v"})
    with pytest.raises(ValueError, match="schema"):
        E.require_report(good, rows, "t", "p", {"v"})
    with pytest.raises(ValueError, match="trials"):
        E.require_report(good, rows.limit(2), "s", "p", {"v"})
    with pytest.raises(ValueError, match="missing columns"):
        E.require_report(good, rows, "s", "p", {"w"})


def test_resumed_runs_take_up_what_is_missing_or_failed(spark, tmp_path):
    trials = spark.range(40).select("id", (F.col("id") % 8).alias("g"))
    ran = []

    def run(status):
        def evaluate(part):
            ran.append(part.count())
            return part.select("id", "g", F.lit(status).alias("status"))

        return evaluate

    path = f"file://{tmp_path}/results"
    first = E.resumable(spark, trials, "id", "g", run("matched"), path, parts=4, stop_after=2)
    assert 0 < first.count() == sum(ran) < 40
    E.resumable(spark, trials, "id", "g", run("error"), path, parts=2)
    assert sum(ran) == 40
    last = E.resumable(spark, trials, "id", "g", run("matched"), path)
    assert sum(ran) == 80 - first.count() and last.count() == 40 and last.where("status = 'error'").isEmpty()


def test_reports_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/out.csv"
    for n in (3, 2):
        write_report(spark.range(n).select("id", F.lit("a,b").alias("x")), path, ["id"])
    with pytest.raises(ValueError, match="2 rows at most"):
        write_report(spark.range(3), path, ["id"], most=2)
    assert (tmp_path / "out.csv").read_text() == 'id,x\n0,"a,b"\n1,"a,b"\n'
    write_summary(spark, {"b": 1}, f"file://{tmp_path}/s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == {"b": 1} and not [p for p in tmp_path.iterdir() if p.name.startswith(".out") and p.suffix != ".crc"]


def test_index_stream(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    for day, tracks in (("1", ("a", "b")), ("2", ("b", "c"))):
        rows(spark, *tracks).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("track string, hash long, offset int").parquet(str(tmp_path / "in"))
        increment.index_stream(stream, store, str(tmp_path / "check")).awaitTermination()
    assert store.tracks().count() == 3 and store.postings().count() == 15


def test_vote_and_window_streams(spark, tmp_path):
    spark.sql("SELECT 1 AS query, CAST(h AS BIGINT) AS hash, CAST(h AS INT) AS offset, TIMESTAMP '2024-01-01 00:00:00' AS ts FROM VALUES (1), (1), (2) AS t(h)").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("query int, hash long, offset int, ts timestamp").parquet(str(tmp_path / "q"))
    postings = spark.createDataFrame([(9, 1, 4), (9, 2, 5)], "track int, hash long, offset int")
    q = increment.vote_stream(stream, postings).writeStream.format("memory").queryName("votes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("votes").collect()] == [(1, 9, 3, 2)]
    spark.sql("SELECT 'a' AS track, CAST(v AS DOUBLE) AS value, timestamp_seconds(v) AS ts FROM VALUES (0), (21), (44) AS t(v)").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("track string, value double, ts timestamp").parquet(str(tmp_path / "e"))
    q = increment.hop_windows(stream).writeStream.format("memory").queryName("hops").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("hops").collect()) == 6


def test_scratch_tables_are_released(spark, tmp_path):
    with scratch.kept_only() as keep:
        one = scratch.materialize(spark.range(3), "one")
        two = scratch.materialize(one.selectExpr("id + 1 AS id"), "two")
        keep.append(two)
    assert two.count() == 3 and one._scratch not in scratch._made
    with pytest.raises(Exception):
        one.selectExpr("max(id)").collect()
    scratch.release(two)
    assert two._scratch not in scratch._made
