"""Queries for evaluation runs: gates, named results, payloads, run times, checkpoints, the streamed index, stub embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspan.functions.columns import places5
from larkspan.operators import evaluation, index, knn, matching
from larkspan.plans import text
from larkspan.plans.text import load
from larkspan.scratch import shared_dir
from larkspan.sources.store import IndexStore
from larkspan.streaming.increment import index_stream


def _summaries(spark, sf):
    """Order priorities as systems, their summaries with planted faults; status O is an error."""
    o = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("system"), F.when(F.col("o_orderstatus") == "O", "error").otherwise("matched").alias("status"))
    rows = o.where("status <> 'error' or system like '3%'")
    found = rows.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "error", 1)).alias("e"))
    number = F.substring("system", 1, 1)
    return found.where(number != "5").select(
        "system", F.when(number == "1", "results-v0").otherwise("results-v1").alias("schema"), F.when(number == "1", "p2").otherwise("p1").alias("protocol"),
        (F.col("n") + (number == "2").cast("int")).alias("expected"), F.col("n").alias("trials"), F.col("e").alias("errors"),
    ), rows


def report_gate(spark, sf):
    return evaluation.gate(*_summaries(spark, sf), schema="results-v1", protocol="p1")


def completion_gate(spark, sf):
    """Customers whose run is finished, by summaries of which some were cut off, miscounted, or never written."""
    o = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("trials"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("errors"))
    o = o.withColumn("system", F.col("k").cast("string"))
    due = o.select("system", F.lit("results-v1").alias("schema"), F.lit("p1").alias("protocol"), "trials")
    counted = F.col("trials") + (F.col("k") % 5 == 0).cast("int")
    text = F.to_json(F.struct(F.lit("results-v1").alias("schema"), F.lit("p1").alias("protocol"), "system", counted.alias("trials"), "errors"))
    text = F.when(F.col("k") % 7 == 0, F.substring(text, 1, 20)).otherwise(text)
    return evaluation.finished(due, o.where("k % 3 <> 0").select("system", text.alias("text"))).withColumnRenamed("system", "custkey")


def _names(spark, sf):
    d = load(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("track"), F.concat_ws("/", "lang", "source", F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("name"))


def named_results(spark, sf):
    """Results by the names of the tracks; ties go to the smaller name."""
    met = matching.matches(text.asked(spark, sf), text.postings(spark, sf), text.n_tracks(spark, sf))
    best = matching.best_per_track(matching.smoothed(matching.votes(met)))
    return matching.named(best, _names(spark, sf), 2).select(F.col("query").alias("item_id"), "rank", "name", "n", "score", "delta")


def avoided_fraction(spark, sf):
    """The share of benchmark items that the first stage settles, over all items with hashes."""
    stages = text.adaptive_stage2(spark, sf).groupBy("item_id").agg(F.min("stage").alias("stage"))
    every = text.asked(spark, sf).select(F.col("query").alias("item_id")).distinct().join(stages, "item_id", "left")
    return evaluation.avoided_fraction(every.withColumn("stage", F.coalesce("stage", F.lit("two_hop")))).select("trials", places5(F.col("avoided")).alias("avoided"))


def runtime_summary(spark, sf):
    """Mean run time over the rows that have one, by type; every seventh event has an empty one, and type ``view`` none at all."""
    e = load(spark, sf, "events")
    time = F.when((F.col("event_id") % 7 == 0) | (F.col("event_type") == "view"), "").otherwise(F.round(F.col("value"), 3).cast("string"))
    return e.withColumn("total_time", time).groupBy("event_type").agg(places5(evaluation.mean_present(F.col("total_time"))).alias("mean_seconds"), F.count(F.lit(1)).alias("n"))


def payload_families(spark, sf):
    """Reference payload an hour and mean query payload of the three record families, at 1,000 characters a second."""
    held = text.postings(spark, sf).agg(F.count(F.lit(1)).alias("records"))
    asked = text.asked(spark, sf).groupBy("query").count().agg(F.avg("count").alias("mean"))
    chars = load(spark, sf, "documents").agg((F.sum("n_chars") / 1000.0).alias("seconds"))
    row = held.withColumn("mean", asked.scalar()).withColumn("seconds", chars.scalar())
    each = row.select(F.explode(evaluation.payloads(F.col("records"), F.col("seconds"), F.col("mean"))).alias("x"))
    return each.select("x.family", places5(F.col("x.mib_per_hour")).alias("mib_per_hour"), places5(F.col("x.query_mib")).alias("query_mib"))


def duplicate_hash_check(spark, sf):
    """Faults of an inverted text index into which some were planted: repeated hash rows, and counts that differ from their lists."""
    lines = index.grouped(text.postings(spark, sf)).select("hash", (F.col("n") + (F.col("hash") % 97 == 0).cast("int")).alias("n"), "postings")
    lines = lines.unionByName(lines.where("hash % 101 = 0"))
    return index.faults(lines)


def resumable_results(spark, sf):
    """Orders evaluated by customer in four commits, stopped after two and resumed; failed ones are evaluated again."""
    path = f"{shared_dir(spark)}/larkspan-{uuid.uuid4().hex}/results"
    trials = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")

    def run(first: bool):
        failed = (F.col("o_orderstatus") == "P") & F.lit(first)
        return lambda part: part.select("o_orderkey", "o_custkey", F.when(failed, "error").otherwise("matched").alias("status"))

    evaluation.resumable(spark, trials, "o_orderkey", "o_custkey", run(True), path, parts=4, stop_after=2)
    return evaluation.resumable(spark, trials, "o_orderkey", "o_custkey", run(False), path, parts=4)


def stream_index_increment(spark, sf):
    """A user's day of events is a track; its cells go through a stream, a month a file, into an index store: (track, df of its hashes, postings)."""
    base = f"{shared_dir(spark)}/larkspan-{uuid.uuid4().hex}"
    e = load(spark, sf, "events").where("value is not null")
    rows = e.select(
        F.concat_ws("/", F.to_date("ts").cast("string"), F.col("user_id").cast("string")).alias("track"), F.floor("value").cast("long").alias("hash"),
        F.hour("ts").alias("offset"), F.date_format("ts", "yyyy-MM").alias("month"),
    )
    rows.repartition("month").write.partitionBy("month").parquet(f"{base}/in")
    files = spark.readStream.schema("track string, hash long, offset int, month string").option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    store = IndexStore(spark, f"{base}/index")
    index_stream(files.select("track", "hash", "offset"), store, f"{base}/checkpoint").awaitTermination()
    counts = store.postings().groupBy("track_id").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("hash").alias("hashes"))
    return store.tracks().join(counts, "track_id").select("track", "total_hashes", "postings", "hashes")


def stub_embeddings(spark, sf):
    """Segments embedded by a stub in the place of a model: length, digits and blanks of a text."""

    class Stub:
        width = 3

        def __call__(self, texts):
            import numpy as np

            return np.array([(len(t), sum(c in "0123456789" for c in t), t.count(" ")) for t in texts], np.float32).reshape(-1, 3)

    out = knn.embedded(load(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content")), Stub)
    return out.select(F.col("id").alias("item_id"), *[F.col("embedding")[k].cast("long").alias(n) for k, n in enumerate(("length", "digits", "blanks"))])


_S = """o AS (SELECT o_orderpriority AS system, substr(o_orderpriority, 1, 1) AS k, o_orderstatus = 'O' AS bad FROM orders),
r AS (SELECT * FROM o WHERE NOT bad OR k = '3'), f AS (SELECT system, any_value(k) AS k, count(*) AS n, count(*) FILTER (bad) AS e FROM r GROUP BY system)"""

QUERIES = {f.__name__: f for f in (
    report_gate, completion_gate, named_results, avoided_fraction, runtime_summary, payload_families, duplicate_hash_check, resumable_results,
    stream_index_increment, stub_embeddings,
)}
ORACLE_SQL = {
    "report_gate": f"""WITH {_S} SELECT system, unnest(['schema', 'protocol']) AS reason FROM f WHERE k = '1' UNION ALL SELECT system, 'trials' FROM f WHERE k = '2'
      UNION ALL SELECT system, unnest(['errors', 'rows']) FROM f WHERE k = '3' AND e > 0 UNION ALL SELECT system, 'unknown' FROM f WHERE k = '5'""",
    "completion_gate": """SELECT o_custkey::VARCHAR AS custkey, o_custkey % 3 <> 0 AND o_custkey % 5 <> 0 AND o_custkey % 7 <> 0 AND count(*) FILTER (o_orderstatus = 'O') = 0 AS finished
      FROM orders GROUP BY o_custkey""",
    "named_results": f"""{text.W} SELECT item_id, rank, name, n, score, delta FROM (SELECT item_id, name, n, w::DECIMAL(20,5)::DOUBLE AS score, delta,
        (row_number() OVER (PARTITION BY item_id ORDER BY w DESC, n DESC, name))::INT AS rank
        FROM best JOIN (SELECT doc_id, lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 6, '0') AS name FROM documents) USING (doc_id)) WHERE rank <= 2""",
    "avoided_fraction": f"""{text.W} SELECT count(*) AS trials, avg((hits >= 8 AND f > 0 AND (f - s) / f >= 0.4::DOUBLE AND hits IS NOT NULL)::INT)::DECIMAL(20,5)::DOUBLE AS avoided
        FROM (SELECT DISTINCT item_id FROM qpost) LEFT JOIN (SELECT item_id, coalesce(hits, 0) AS hits, coalesce(f, 0) AS f, s FROM conf) USING (item_id)""",
    "runtime_summary": """SELECT event_type, avg(CASE WHEN event_id % 7 <> 0 AND event_type <> 'view' THEN round(value, 3)::DECIMAL(20,6) END)::DECIMAL(20,5)::DOUBLE AS mean_seconds, count(*) AS n
        FROM events GROUP BY event_type""",
    "payload_families": f"""{text.W}, x AS (SELECT (SELECT count(*) FROM post) AS r, (SELECT avg(c) FROM (SELECT count(*) AS c FROM qpost GROUP BY item_id)) AS m, (SELECT sum(n_chars) / 1000.0::DOUBLE FROM documents) AS s)
        SELECT family, (r * a / 1048576.0::DOUBLE / (s / 3600.0::DOUBLE))::DECIMAL(20,5)::DOUBLE AS mib_per_hour, (m * b / 1048576.0::DOUBLE)::DECIMAL(20,5)::DOUBLE AS query_mib
        FROM x, (VALUES ('hash', 16, 12), ('second', 20, NULL), ('neural', 520, 516)) AS y(family, a, b)""",
    "duplicate_hash_check": f"""{text.W} SELECT 'count' AS fault, hash FROM stats WHERE hash % 97 = 0 UNION ALL SELECT 'count', hash FROM stats WHERE hash % 97 = 0 AND hash % 101 = 0
        UNION ALL SELECT 'repeated', hash FROM stats WHERE hash % 101 = 0""",
    "resumable_results": "SELECT o_orderkey, o_custkey, 'matched' AS status FROM orders",
    "stream_index_increment": """SELECT track, count(*) AS total_hashes, count(*) AS postings, count(DISTINCT hash) AS hashes FROM (
        SELECT DISTINCT ts::DATE::VARCHAR || '/' || user_id AS track, floor(value)::BIGINT AS hash, hour(ts) AS o FROM events WHERE value IS NOT NULL) GROUP BY track""",
    "stub_embeddings": """SELECT item_id, length(text)::BIGINT AS length, length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS digits, length(regexp_replace(text, '[^ ]', '', 'g'))::BIGINT AS blanks FROM benchmark""",
}
