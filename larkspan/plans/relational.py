"""Queries for validation, lifecycle, evaluation and external results over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspan.functions.columns import finite, half_even, places5, small
from larkspan.operators import checks, index
from larkspan.plans.text import load


def _annotations(spark, sf):
    """Orders as annotated trials: reference, query and interval, with tempo and pitch as optional text."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("reference_id"), k.cast("string").alias("query_id"), (k % 40).cast("int").alias("query_begin"),
        (k % 40 + 5 + k % 7).cast("int").alias("query_end"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, "").when(k % 5 == 2, "100").otherwise("90").alias("tempo"),
        F.when(k % 3 == 0, "0").when(k % 3 == 1, "").otherwise("2").alias("pitch"),
    )


def exact_scale_filter(spark, sf):
    keep = F.coalesce("tempo", F.lit("")).isin("", "100") & F.coalesce("pitch", F.lit("")).isin("", "0")
    return _annotations(spark, sf).where(keep).select("query_id", "reference_id")


def annotation_id(spark, sf):
    parts = ["reference_id", "query_id", "query_begin", "query_end"]
    key = F.concat_ws(":", *parts, F.coalesce("tempo", F.lit("")), F.coalesce("pitch", F.lit("")))
    return _annotations(spark, sf).select("query_id", key.alias("annotation_id"))


def segments_by_query(spark, sf):
    """Trials of a reference in order, their bounds as sample indices rounded half to even."""
    a = _annotations(spark, sf).where("query_end > query_begin")
    item = F.struct(F.col("query_id").cast("long").alias("q"), half_even(F.col("query_begin") * 12.5).alias("b"), half_even(F.col("query_end") * 12.5).alias("e"))
    grouped = a.groupBy("reference_id").agg(F.sort_array(F.collect_list(item)).alias("s"))
    return grouped.select("reference_id", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["q"], x["b"], x["e"])), ",").alias("segments"))


def manifest_violations(spark, sf):
    d, o, li = load(spark, sf, "documents"), load(spark, sf, "orders"), load(spark, sf, "lineitem")
    named = F.when(F.col("doc_id") % 50 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id"))  # some files are misnamed
    path = F.concat(F.lit("audio/"), named.cast("string"), F.lit(".wav"))
    found = [
        checks.violations("repeated_id", checks.repeated(d, "doc_id")),
        checks.violations("blank_source", checks.blank(d, "source")),
        checks.violations("stem", d.where(checks.stem(path) != F.col("doc_id").cast("string"))),
        checks.violations("source_lang", checks.not_functional(d, "source", "lang")),
        checks.violations("length", d.where(F.abs(F.length("text") - F.col("n_chars")) > 0)),
        checks.violations("interval", _annotations(spark, sf).where("query_end <= query_begin")),
        checks.violations("order_customer", checks.not_functional(o, "o_orderkey", "o_custkey")),
        checks.violations("part_supplier", checks.not_functional(li, "l_partkey", "l_suppkey")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def referential_gaps(spark, sf):
    o, li, c, p, s, lab, d = (load(spark, sf, t) for t in ("orders", "lineitem", "customer", "part", "supplier", "labels", "documents"))
    pairs = [("customer", o, "o_custkey", c, "c_custkey"), ("order", li, "l_orderkey", o, "o_orderkey"), ("part", li, "l_partkey", p, "p_partkey"),
             ("supplier", li, "l_suppkey", s, "s_suppkey"), ("document", lab, "doc_id", d, "doc_id"), ("label", d, "doc_id", lab, "doc_id"), ("buyer", c, "c_custkey", o, "o_custkey")]
    out = None
    for name, left, key, right, other in pairs:
        row = checks.violations(name, checks.gaps(left, right, key, other))
        out = row if out is None else out.unionByName(row)
    return out


def manifest_union(spark, sf):
    """Digests of two manifests, and paths for which they conflict."""
    d = load(spark, sf, "documents")
    one = d.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("digest"))
    two = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 9 == 0, F.col("lang")).otherwise(F.col("text")), 256).alias("digest"))
    both = one.unionByName(two)
    return both.groupBy("path").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("digest") > 1).alias("conflict"))


def resume_anti_join(spark, sf):
    """Orders still to do: groups (customers) of which any order is missing or failed run again as a whole."""
    o = load(spark, sf, "orders")
    done = o.where("o_orderstatus <> 'O'").select("o_orderkey")
    missing = o.join(done, "o_orderkey", "left_anti").select("o_custkey").distinct()
    return o.join(missing, "o_custkey", "left_semi").select("o_custkey", "o_orderkey")


def id_set_diff(spark, sf):
    return checks.id_difference(load(spark, sf, "documents"), load(spark, sf, "labels"), "doc_id")


def result_id_check(spark, sf):
    o, li = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    both = o.withColumn("a", F.lit(1)).join(li.withColumn("b", F.lit(1)), "id", "full_outer")
    return both.agg(F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("differing"), F.count(F.lit(1)).alias("ids"))


def _known(spark, sf):
    """Tracks of the index so far: the sources of labelled documents."""
    d, lab = load(spark, sf, "documents"), load(spark, sf, "labels")
    return d.where("lang = 'de'").join(lab, "doc_id", "left_semi").select(F.concat("source", F.lit("/"), "lang").alias("track")).distinct()


def index_missing_refs(spark, sf):
    d = load(spark, sf, "documents").select(F.concat("source", F.lit("/"), "lang").alias("track")).distinct()
    return index.missing(d, _known(spark, sf))


def index_append(spark, sf):
    """Ids for new tracks, after those of the index, in name order."""
    known = index.numbered(_known(spark, sf), 0)
    return known.unionByName(index.numbered(index_missing_refs(spark, sf), known.count()))


def index_merge(spark, sf):
    """Pending postings merged into an index: a bag union whose counts add up."""
    p = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("hash"), F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("offset"))
    merged = index.merge(p.where("track % 2 = 0"), p.where("track % 2 <> 0"))
    return merged.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("offset").alias("offsets"))


def numeric_id_map(spark, sf):
    """References numbered by the rank of their id, looked up for every document."""
    d = load(spark, sf, "documents")
    ids = index.numbered(d.select("source").where("source is not null").distinct(), 0, "source")
    return d.join(small(ids), "source", "left").select("doc_id", F.col("track_id").cast("int").alias("number"), F.col("track_id").isNull().alias("unknown"))


def window_lookup(spark, sf):
    """Window files to their query's data; paths that no query owns are marked."""
    li, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"], "left").select("l_orderkey", "l_linenumber", "o_custkey", o["o_orderkey"].isNull().alias("unknown"))


def reference_seconds(spark, sf):
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    out = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_custkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("seconds"))
    return out


def matrix_expand(spark, sf):
    """Systems by data sets, the controls on one of them only."""
    systems = load(spark, sf, "nation").select(F.col("n_name").alias("system"), "n_regionkey")
    sets = load(spark, sf, "region").select(F.col("r_name").alias("dataset"), "r_regionkey")
    return systems.join(F.broadcast(sets), (F.col("n_regionkey") != 0) | (F.col("r_regionkey") == 0)).select("system", "dataset")


def _external(spark, sf):
    """Events as rows of an external matcher: some scores and spans are not finite."""
    e = load(spark, sf, "events")
    score = F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(F.col("value"))
    return e.select("event_id", "user_id", "event_type", score.alias("score"), F.get_json_object("props", "$.k").cast("double").alias("seconds"))


def external_rank(spark, sf):
    """Best row per query and reference, then ranks: larger (score, seconds, id) first, what is not finite last."""
    e = _external(spark, sf).withColumn("score", finite(F.col("score"))).withColumn("seconds", finite(F.col("seconds")))
    key = F.struct("score", "seconds", "event_id")
    best = e.groupBy("user_id", "event_type").agg(F.max(key).alias("b")).select("user_id", "event_type", "b.score", "b.seconds", "b.event_id")
    order = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("seconds").desc(), F.col("event_type").desc())
    return best.withColumn("rank", F.row_number().over(order)).select("user_id", "event_type", "event_id", "rank")


def first_seen(spark, sf):
    """First row per reference in native order."""
    e = load(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


def first_seen_topk(spark, sf):
    """The first two different references of every query, in native order."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    return first_seen(spark, sf).withColumn("rank", F.row_number().over(order)).where("rank <= 2")


def json_docs(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


def stats_regex(spark, sf):
    """Key and value pairs scraped from text."""
    e = load(spark, sf, "events").select("event_id", F.concat(F.lit("Stats: hits = "), F.col("event_id").cast("string"), F.lit("; type: "), "event_type", F.lit(";")).alias("line"))
    return e.select("event_id", F.regexp_extract("line", r"hits = (\d+)", 1).cast("long").alias("hits"), F.regexp_extract("line", r"type: (\w+);", 1).alias("kind"))


def batch_time(spark, sf):
    """Elapsed time of a batch over its queries, by day."""
    e = load(spark, sf, "events")
    day = F.to_date("ts").cast("string")
    return e.groupBy(day.alias("day")).agg(places5(F.sum(F.col("value").cast("decimal(20,6)")) / F.count(F.lit(1))).alias("per_query"), F.count(F.lit(1)).alias("queries"))


_A = """a AS (SELECT o_custkey::VARCHAR AS reference_id, o_orderkey::VARCHAR AS query_id, (o_orderkey % 40)::INT AS query_begin, (o_orderkey % 40 + 5 + o_orderkey % 7)::INT AS query_end,
 CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '100' ELSE '90' END AS tempo, CASE o_orderkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE '2' END AS pitch FROM orders)"""
_KN = """kn AS (SELECT DISTINCT source || '/' || lang AS track FROM documents WHERE lang = 'de' AND doc_id IN (SELECT doc_id FROM labels)),
ms AS (SELECT DISTINCT source || '/' || lang AS track FROM documents WHERE source || '/' || lang NOT IN (FROM kn))"""

QUERIES = {f.__name__: f for f in (
    exact_scale_filter, annotation_id, segments_by_query, manifest_violations, referential_gaps, manifest_union, resume_anti_join, id_set_diff, result_id_check,
    index_missing_refs, index_append, index_merge, numeric_id_map, window_lookup, reference_seconds, matrix_expand, external_rank, first_seen, first_seen_topk, json_docs,
    stats_regex, batch_time,
)}
ORACLE_SQL = {
    "exact_scale_filter": f"WITH {_A} SELECT query_id, reference_id FROM a WHERE coalesce(tempo, '') IN ('', '100') AND coalesce(pitch, '') IN ('', '0')",
    "annotation_id": f"WITH {_A} SELECT query_id, concat_ws(':', reference_id, query_id, query_begin, query_end, coalesce(tempo, ''), coalesce(pitch, '')) AS annotation_id FROM a",
    "segments_by_query": f"WITH {_A} SELECT reference_id, string_agg(query_id || ':' || round_even(query_begin * 12.5::DOUBLE, 0)::INT || ':' || round_even(query_end * 12.5::DOUBLE, 0)::INT, ',' ORDER BY query_id::BIGINT) AS segments FROM a WHERE query_end > query_begin GROUP BY reference_id",
    "manifest_violations": f"""WITH {_A} SELECT 'repeated_id' AS "check", count(*) AS violations FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
      UNION ALL SELECT 'blank_source', count(*) FROM documents WHERE source IS NULL OR trim(source) = '' UNION ALL SELECT 'stem', count(*) FROM documents WHERE regexp_extract('audio/' || (doc_id + (doc_id % 50 = 0)::INT) || '.wav', '([^/.]*)\\.wav$', 1) <> doc_id::VARCHAR
      UNION ALL SELECT 'source_lang', count(*) FROM (SELECT source FROM documents GROUP BY 1 HAVING count(DISTINCT coalesce(lang, '?')) > 1)
      UNION ALL SELECT 'length', count(*) FROM documents WHERE length(text) <> n_chars UNION ALL SELECT 'interval', count(*) FROM a WHERE query_end <= query_begin
      UNION ALL SELECT 'order_customer', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1)
      UNION ALL SELECT 'part_supplier', count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1)""",
    "referential_gaps": """SELECT 'customer' AS "check", count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT 'order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
      UNION ALL SELECT 'supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
      UNION ALL SELECT 'label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'buyer', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "manifest_union": """SELECT path, count(*) AS n, count(DISTINCT digest) > 1 AS conflict FROM (SELECT doc_id AS path, sha256(text) AS digest FROM documents
      UNION ALL SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN lang ELSE text END) FROM documents WHERE doc_id % 3 = 0) GROUP BY path""",
    "resume_anti_join": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')",
    "id_set_diff": "SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "result_id_check": "SELECT count(*) FILTER (a.id IS NULL OR b.id IS NULL) AS differing, count(*) AS ids FROM (SELECT o_orderkey AS id FROM orders) a FULL JOIN (SELECT DISTINCT l_orderkey AS id FROM lineitem) b ON a.id = b.id",
    "index_missing_refs": f"WITH {_KN} SELECT track FROM ms",
    "index_append": f"WITH {_KN} SELECT track, row_number() OVER (ORDER BY track) AS track_id FROM kn UNION ALL SELECT track, row_number() OVER (ORDER BY track) + (SELECT count(*) FROM kn) FROM ms",
    "index_merge": "SELECT l_partkey AS hash, count(*) AS n, sum(l_linenumber)::BIGINT AS offsets FROM lineitem GROUP BY 1",
    "numeric_id_map": "SELECT doc_id, (dense_rank() OVER (ORDER BY source))::INT AS number, false AS unknown FROM documents",
    "window_lookup": "SELECT l_orderkey, l_linenumber, o_custkey, o_orderkey IS NULL AS unknown FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
    "reference_seconds": "SELECT o_custkey, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS seconds FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "matrix_expand": "SELECT n_name AS system, r_name AS dataset FROM nation, region WHERE n_regionkey <> 0 OR r_regionkey = 0",
    "external_rank": """WITH x AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR value IS NULL THEN '-inf'::DOUBLE ELSE value END AS s,
        coalesce(json_extract_string(props, '$.k')::DOUBLE, '-inf'::DOUBLE) AS k FROM events), b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY s DESC, k DESC, event_id DESC) = 1)
      SELECT user_id, event_type, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY s DESC, k DESC, event_type DESC))::INT AS rank FROM b""",
    "first_seen": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL",
    "first_seen_topk": "SELECT * FROM (SELECT user_id, event_type, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS rank FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL)) WHERE rank <= 2",
    "json_docs": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.missing') AS missing FROM events",
    "stats_regex": "SELECT event_id, event_id AS hits, event_type AS kind FROM events",
    "batch_time": "SELECT ts::DATE::VARCHAR AS day, (sum(value::DECIMAL(20,6)) / count(*))::DECIMAL(20,5)::DOUBLE AS per_query, count(*) AS queries FROM events GROUP BY 1",
}
