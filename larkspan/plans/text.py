"""Queries over the text corpus: documents are tracks, benchmark items are queries, offsets are token positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.config import Matching
from larkspan.functions.columns import exact, places5, small
from larkspan.operators import index, matching
from larkspan.plans.stored import stored


#: Seconds of a frame; a token counts as one.
FRAME = 0.032


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def postings(spark, sf, width: int = 3) -> DataFrame:
    """The stored index of all documents."""
    return stored(spark, sf, "documents", f"postings-{width}", lambda: index.token_shingles(load(spark, sf, "documents"), "doc_id", "text", "track", width))


def asked(spark, sf, width: int = 3) -> DataFrame:
    return index.token_shingles(load(spark, sf, "benchmark"), "item_id", "text", "query", width)


def n_tracks(spark, sf) -> int:
    """Tracks with postings: documents of three tokens at least. Each has a posting at offset 0."""
    return stored(spark, sf, "documents", "tracks", lambda: postings(spark, sf).where("offset = 0").agg(F.count(F.lit(1)).alias("n"))).first()[0]


def _met(spark, sf):
    return matching.matches(asked(spark, sf), postings(spark, sf), n_tracks(spark, sf))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"query": "item_id", "track": "doc_id"})


def recognize_topn(spark, sf):
    return _named(matching.recognize(asked(spark, sf), postings(spark, sf), n_tracks(spark, sf)))


def topn_param(spark, sf):
    return _named(matching.recognize(asked(spark, sf), postings(spark, sf), n_tracks(spark, sf), Matching(topn=5)))


def index_postings(spark, sf):
    return postings(spark, sf).withColumnRenamed("track", "doc_id")


def index_grouped(spark, sf):
    out = index.grouped(postings(spark, sf))
    return out.select("hash", "n", index.format_postings(F.col("postings")).alias("postings"))


def posting_count_check(spark, sf):
    out = index.grouped(postings(spark, sf)).where(F.size("postings") != F.col("n"))
    return out.agg(F.count(F.lit(1)).alias("violations"))


def grouped_postings_prefix(spark, sf):
    return index.prefix_starts(index.hash_stats(postings(spark, sf)).select("hash", "n"))


def hash_stats(spark, sf):
    return index.hash_stats(postings(spark, sf))


def index_statistics(spark, sf):
    return index.index_statistics(postings(spark, sf))


def idf_weights(spark, sf):
    stats = index.hash_stats(postings(spark, sf))
    return stats.select("hash", "df", places5(exact(index.idf(F.col("df"), F.lit(n_tracks(spark, sf))))).alias("idf"))


def offset_votes(spark, sf):
    return _named(matching.votes(_met(spark, sf)).withColumn("w", places5(F.col("w"))))


def offset_smoothed(spark, sf):
    return _named(matching.smoothed(matching.votes(_met(spark, sf))).withColumn("w", places5(F.col("w"))))


def adaptive_confidence(spark, sf):
    return matching.confidence(matching.recognize(asked(spark, sf), postings(spark, sf), n_tracks(spark, sf))).withColumnRenamed("query", "item_id")


def _wide(spark, sf):
    """Stage two adds two-token shingles."""
    return (
        asked(spark, sf).unionByName(asked(spark, sf, 2)), postings(spark, sf).unionByName(postings(spark, sf, 2))
    )


def adaptive_stage2(spark, sf):
    second, both = _wide(spark, sf)
    return _named(matching.adaptive(asked(spark, sf), second, both, n_tracks(spark, sf)))


def _truth(spark, sf) -> DataFrame:
    """The smallest document that holds a benchmark text verbatim, and the token at which it does."""
    docs, items = load(spark, sf, "documents"), load(spark, sf, "benchmark")
    # A stated query set against all documents: items are matched on three inner tokens, then verbatim. The first and the
    # last token may be glued to other characters in a document; items without three tokens between them are looked for in all.
    size = F.size(F.split(F.lower("text"), r"\s+"))
    inner = index.token_shingles(items, "item_id", "text", "item_id").where("offset = 1").select("item_id", "hash")
    inner = inner.join(items.where(size >= 5), "item_id").withColumnRenamed("text", "passage")
    held = postings(spark, sf).withColumnRenamed("track", "doc_id").join(small(inner.select("hash").distinct()), "hash", "left_semi")
    pairs = held.select("doc_id", "hash").distinct().join(inner, "hash").drop("hash").join(docs.select("doc_id", "text"), "doc_id")
    short = items.where(size.between(3, 4)).select("item_id", F.col("text").alias("passage"))
    tried = pairs.unionByName(docs.select("doc_id", "text").join(small(short)))
    found = tried.where(F.contains("text", F.col("passage")))
    before = F.expr("left(text, instr(text, passage) - 1)")
    place = F.size(F.split(F.lower(before), r"\s+")) - 1
    return found.groupBy("item_id").agg(F.min("doc_id").alias("reference_id"), F.min_by(place, "doc_id").alias("place"))


def result_rows(spark, sf):
    """Per benchmark item: truth, prediction, status, correctness and offset error against the verbatim place."""
    items = load(spark, sf, "benchmark").select("item_id")
    best = recognize_topn(spark, sf).where("rank = 1").select("item_id", F.col("doc_id").alias("predicted_id"), "score", "delta")
    out = items.join(_truth(spark, sf), "item_id", "left").join(best, "item_id", "left")
    status = F.when(F.col("predicted_id").isNull(), "no_match").otherwise("matched")
    right = F.coalesce(F.col("predicted_id") == F.col("reference_id"), F.lit(False))
    error = F.when(right, F.abs(F.col("delta") - F.col("place")) * F.lit(FRAME))
    return out.select("item_id", "reference_id", "predicted_id", status.alias("status"), right.alias("correct"), error.alias("offset_error"))


def metrics_summary(spark, sf):
    right = F.col("correct").cast("int")
    close = F.coalesce(F.col("correct") & (F.col("offset_error") <= 0.1), F.lit(False)).cast("int")
    return result_rows(spark, sf).agg(
        F.count(F.lit(1)).alias("trials"), F.count(F.when(F.col("status") == "error", 1)).alias("errors"),
        places5(F.avg(right)).alias("top1"), places5(F.avg(close)).alias("top1_offset"),
        places5(F.avg((F.col("status") == "matched").cast("int"))).alias("answered"),
    )


def payload_report(spark, sf):
    """Index and query payloads: 16 bytes a posting, 12 a query record, bucket depth 4 for the depth-limited store."""
    stats = index.hash_stats(postings(spark, sf)).agg(
        F.sum("n").alias("postings"), F.sum(F.least(F.lit(4), F.col("n"))).cast("long").alias("stored")
    )
    records = asked(spark, sf).groupBy("query").count().agg(F.avg("count").alias("records"))
    chars = load(spark, sf, "documents").agg(F.sum("n_chars").alias("chars"))
    out = stats.join(F.broadcast(records)).join(F.broadcast(chars))
    hours = F.col("chars") / 1000.0 / 3600.0
    return out.select(
        "postings", "stored", places5(F.col("postings") * 16 / 1048576.0 / hours).alias("mib_per_hour"),
        places5(F.col("records") * 12 / 1048576.0).alias("query_mib"),
    )


def cluster_totals(spark, sf):
    """Totals of two systems' differences by cluster (the item's first letter)."""
    items = load(spark, sf, "benchmark")
    one = result_rows(spark, sf).select("item_id", F.col("correct").cast("int").alias("x"))
    five = topn_param(spark, sf).groupBy("item_id").agg(F.max(F.col("rank")).alias("k"))
    pair = one.join(five, "item_id", "full_outer").join(items, "item_id")
    diff = F.coalesce("x", F.lit(0)) - (F.coalesce("k", F.lit(0)) >= 3).cast("int")
    return pair.groupBy(F.substring("text", 1, 1).alias("cluster")).agg(F.sum(diff).cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


def paired_difference(spark, sf):
    return cluster_totals(spark, sf).agg(places5(F.sum("total") / F.sum("n")).alias("difference"), F.sum("n").alias("trials"))


def cluster_bootstrap(spark, sf):
    """Pooled mean with a 95 % interval over 5,000 replicates, from draws of a shared generator."""
    from larkspan.operators.stats import bootstrap

    return bootstrap(cluster_totals(spark, sf), seed=7)


def paired_permutation(spark, sf):
    from larkspan.operators.stats import permutation

    return permutation(cluster_totals(spark, sf).select("cluster", "total"), seed=7)


def segment_windows(spark, sf):
    """Windows of 250 characters at a hop of 200 over every document, with a last one at its end."""
    from larkspan.operators.segments import windows

    docs = load(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("length"))
    return windows(docs, 250, 200).select("doc_id", "begin", "end")


def segment_slices(spark, sf):
    """Fixed segments of 64 tokens at a hop of 32; what is left over is dropped, short texts give one padded segment."""
    from larkspan.operators.segments import fixed_segments

    docs = load(spark, sf, "documents").select("doc_id", F.split(F.lower("text"), r"\s+").alias("tokens"))
    out = fixed_segments(docs.withColumn("length", F.size("tokens")), 64, 32)
    piece = F.slice("tokens", F.col("begin") + 1, 64)
    return out.select("doc_id", "segment", "begin", F.md5(F.array_join(piece, " ")).alias("digest"), (F.lit(64) - F.size(piece)).alias("padded"))


def checksums(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


def string_normalise(spark, sf):
    """Trimmed, zero-filled to six digits (longer ids stay), joined."""
    s = F.trim(F.col("doc_id").cast("string"))
    filled = F.when(F.length(s) >= 6, s).otherwise(F.lpad(s, 6, "0"))
    docs = load(spark, sf, "documents")
    return docs.select("doc_id", filled.alias("padded"), F.concat_ws(":", filled, "lang", "source").alias("name"), F.startswith(F.col("text"), F.lit("The ")).alias("begins"))


_P = """
tok AS (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS t FROM documents),
qtok AS (SELECT item_id, string_split_regex(lower(text), '\\s+') AS t FROM benchmark),
post AS (SELECT doc_id, ('0x' || substr(md5(t[i] || ' ' || t[i+1] || ' ' || t[i+2]), 1, 15))::BIGINT AS hash, (i - 1)::INT AS "offset"
         FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM tok)),
qpost AS (SELECT item_id, ('0x' || substr(md5(t[i] || ' ' || t[i+1] || ' ' || t[i+2]), 1, 15))::BIGINT AS hash, (i - 1)::INT AS "offset"
          FROM (SELECT item_id, t, unnest(range(1, len(t) - 1)) AS i FROM qtok)),
nt AS (SELECT count(*) AS n FROM tok WHERE len(t) >= 3),
stats AS (SELECT hash, count(DISTINCT doc_id) AS df, count(*) AS n FROM post GROUP BY hash),
idf AS (SELECT hash, df, (1 + ln((greatest(nt.n, df) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)))::DECIMAL(28,12) AS idf FROM stats, nt),
votes AS (SELECT q.item_id, p.doc_id, p."offset" - q."offset" AS delta, count(*) AS n, sum(idf) AS w
          FROM (SELECT DISTINCT * FROM qpost) q JOIN post p USING (hash) JOIN idf USING (hash) GROUP BY ALL),
sm AS (SELECT item_id, doc_id, delta, (sum(n) OVER k)::BIGINT AS n, (w + (sum(w) OVER k - w) * 0.5)::DECIMAL(38,12) AS w
       FROM votes WINDOW k AS (PARTITION BY item_id, doc_id ORDER BY delta RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
best AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY w DESC, n DESC, delta) = 1),
rk AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY w DESC, n DESC, doc_id))::INT AS rank, doc_id, n,
       w::DECIMAL(20,5)::DOUBLE AS score, delta FROM best),
conf AS (SELECT item_id, max(n) FILTER (rank = 1) AS hits, max(score) FILTER (rank = 1) AS f, coalesce(max(score) FILTER (rank = 2), 0) AS s FROM rk WHERE rank <= 2 GROUP BY 1),
truth AS (SELECT item_id, min(doc_id) AS reference_id, arg_min(len(string_split_regex(lower(left(d.text, instr(d.text, b.text) - 1)), '\\s+')) - 1, doc_id) AS place FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND len(string_split_regex(b.text, '\\s+')) >= 3 GROUP BY 1),
res AS (SELECT b.item_id, reference_id, doc_id AS predicted_id, CASE WHEN doc_id IS NULL THEN 'no_match' ELSE 'matched' END AS status,
        coalesce(doc_id = reference_id, false) AS correct, CASE WHEN doc_id = reference_id THEN abs(delta - place) * 0.032::DOUBLE END AS offset_error
        FROM benchmark b LEFT JOIN truth USING (item_id) LEFT JOIN (SELECT * FROM rk WHERE rank = 1) r USING (item_id)),
clus AS (SELECT substr(b.text, 1, 1) AS cluster, sum(correct::INT - (coalesce(k, 0) >= 3)::INT)::BIGINT AS total, count(*) AS n
         FROM res JOIN benchmark b USING (item_id) LEFT JOIN (SELECT item_id, max(rank) AS k FROM rk WHERE rank <= 5 GROUP BY 1) USING (item_id) GROUP BY 1)
"""
W = f"WITH {_P}"

QUERIES = {f.__name__: f for f in (
    recognize_topn, topn_param, index_postings, index_grouped, posting_count_check, grouped_postings_prefix, hash_stats, index_statistics,
    idf_weights, offset_votes, offset_smoothed, adaptive_confidence, adaptive_stage2, result_rows, metrics_summary, payload_report,
    paired_difference, cluster_bootstrap, paired_permutation, segment_windows, segment_slices, checksums, string_normalise,
)}

ORACLE_SQL = {
    "recognize_topn": f"{W} SELECT * FROM rk WHERE rank <= 2",
    "topn_param": f"{W} SELECT * FROM rk WHERE rank <= 5",
    "index_postings": f"{W} SELECT * FROM post",
    "index_grouped": f"""{W} SELECT hash, count(*) AS n, string_agg(doc_id || ':' || "offset", '-' ORDER BY doc_id, "offset") AS postings FROM post GROUP BY hash""",
    "posting_count_check": "SELECT 0::BIGINT AS violations",
    "grouped_postings_prefix": f"{W} SELECT hash, n, coalesce(sum(n) OVER (ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM stats",
    "hash_stats": f"{W} SELECT * FROM stats",
    "index_statistics": f"""{W} SELECT max(doc_id) AS max_track, max("offset") AS max_offset, count(*) AS n_postings FROM post""",
    "idf_weights": f"{W} SELECT hash, df, idf::DECIMAL(20,5)::DOUBLE AS idf FROM idf",
    "offset_votes": f"{W} SELECT item_id, doc_id, delta, n, w::DECIMAL(20,5)::DOUBLE AS w FROM votes",
    "offset_smoothed": f"{W} SELECT item_id, doc_id, delta, n, w::DECIMAL(20,5)::DOUBLE AS w FROM sm",
    "adaptive_confidence": f"""{W} SELECT item_id, hits, (CASE WHEN f > 0 THEN (f - s) / f ELSE 0 END)::DECIMAL(20,5)::DOUBLE AS margin,
        hits >= 8 AND (CASE WHEN f > 0 THEN (f - s) / f ELSE 0 END) >= 0.4::DOUBLE AS confident FROM conf""",
    "adaptive_stage2": f"""{W}, unsure AS (SELECT DISTINCT item_id FROM qpost WHERE item_id NOT IN (
          SELECT item_id FROM conf WHERE hits >= 8 AND f > 0 AND (f - s) / f >= 0.4::DOUBLE)),
        post2 AS (SELECT * FROM post UNION ALL SELECT doc_id, ('0x' || substr(md5(t[i] || ' ' || t[i+1]), 1, 15))::BIGINT, (i - 1)::INT FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM tok)),
        q2 AS (SELECT * FROM qpost UNION ALL SELECT item_id, ('0x' || substr(md5(t[i] || ' ' || t[i+1]), 1, 15))::BIGINT, (i - 1)::INT FROM (SELECT item_id, t, unnest(range(1, len(t))) AS i FROM qtok)),
        idf2 AS (SELECT hash, (1 + ln((greatest(nt.n, count(DISTINCT doc_id)) + 1.0::DOUBLE) / (count(DISTINCT doc_id) + 1.0::DOUBLE)))::DECIMAL(28,12) AS idf FROM post2, nt GROUP BY hash, nt.n),
        v2 AS (SELECT q.item_id, p.doc_id, p."offset" - q."offset" AS delta, count(*) AS n, sum(idf) AS w
               FROM (SELECT DISTINCT * FROM q2 WHERE item_id IN (FROM unsure)) q JOIN post2 p USING (hash) JOIN idf2 USING (hash) GROUP BY ALL),
        s2 AS (SELECT item_id, doc_id, delta, (sum(n) OVER k)::BIGINT AS n, (w + (sum(w) OVER k - w) * 0.5)::DECIMAL(38,12) AS w
               FROM v2 WINDOW k AS (PARTITION BY item_id, doc_id ORDER BY delta RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
        b2 AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY w DESC, n DESC, delta) = 1)
        SELECT *, 'original' AS stage FROM rk WHERE rank <= 2 AND item_id NOT IN (FROM unsure) UNION ALL
        SELECT * FROM (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY w DESC, n DESC, doc_id))::INT AS rank, doc_id, n, w::DECIMAL(20,5)::DOUBLE AS score, delta, 'two_hop' AS stage FROM b2) WHERE rank <= 2""",
    "result_rows": f"{W} SELECT * FROM res",
    "metrics_summary": f"""{W} SELECT count(*) AS trials, 0::BIGINT AS errors, avg(correct::INT)::DECIMAL(20,5)::DOUBLE AS top1,
        avg(coalesce(correct AND offset_error <= 0.1, false)::INT)::DECIMAL(20,5)::DOUBLE AS top1_offset, avg((status = 'matched')::INT)::DECIMAL(20,5)::DOUBLE AS answered FROM res""",
    "payload_report": f"""{W} SELECT sum(n)::BIGINT AS postings, sum(least(4, n))::BIGINT AS stored,
        (sum(n) * 16 / 1048576.0::DOUBLE / ((SELECT sum(n_chars) FROM documents) / 1000.0::DOUBLE / 3600.0))::DECIMAL(20,5)::DOUBLE AS mib_per_hour,
        ((SELECT avg(c) FROM (SELECT count(*) AS c FROM qpost GROUP BY item_id)) * 12 / 1048576.0::DOUBLE)::DECIMAL(20,5)::DOUBLE AS query_mib FROM stats""",
    "paired_difference": f"{W} SELECT (sum(total) / sum(n))::DECIMAL(20,5)::DOUBLE AS difference, sum(n)::BIGINT AS trials FROM clus",
    "segment_windows": """SELECT doc_id, b::BIGINT AS begin, least(b + 250, n_chars)::BIGINT AS "end" FROM (
        SELECT doc_id, n_chars, unnest(CASE WHEN n_chars <= 250 THEN [0] ELSE list_distinct(list_concat(range(0, n_chars - 249, 200), [n_chars - 250])) END) AS b FROM documents)""",
    "segment_slices": """SELECT doc_id, (i)::INT AS segment, (i * 32)::INT AS begin, md5(array_to_string(t[i*32+1 : i*32+64], ' ')) AS digest, (64 - len(t[i*32+1 : i*32+64]))::INT AS padded
        FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN len(t) <= 64 THEN 1 ELSE (len(t) - 64) // 32 + 1 END)) AS i FROM (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS t FROM documents))""",
    "checksums": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents",
    "string_normalise": """SELECT doc_id, p AS padded, concat_ws(':', p, lang, source) AS name, starts_with(text, 'The ') AS begins
        FROM (SELECT *, CASE WHEN length(doc_id::VARCHAR) >= 6 THEN doc_id::VARCHAR ELSE lpad(doc_id::VARCHAR, 6, '0') END AS p FROM documents)""",
}
