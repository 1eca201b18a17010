"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as sequences of words. Two lines are linked if they have the same words, or are one word
apart: one word replaced, added or left out, and at least MIN_WORDS words in the
longer one. Linked lines form groups, and the earliest line of a group (by id, then line number) is kept for all of them, so whatever a
line is dropped for is kept itself. The bound does not follow the length: from 10 words on, lines two words apart and more are
not linked though their similarity may be 0.8 or more.

1. *Exact classes.* Lines of equal words are one class (by digest), whose earliest line stands for it.
2. *Necessary halves.* Two lines one word apart share their first or their last half. Half keys are counted; lines
   whose halves occur nowhere else emit nothing.
3. *Deletion neighbourhood.* Each remaining line emits the hash of every variant with one word left out (of the
   sides that are shared), and of itself. The hash is a sum over words and places, so running sums give all variants at once.
   Keys that occur once are dropped by a fixed-size bitmap (a semi-join where the keys outgrow it) before variants are shuffled with their places.
4. *Join.* Variants meet on their key. Within a key no pairs are made: variants that left out the same
   place are all one replacement apart, so each meets the earliest of them; and each meets the line that has the key itself.
   Every line that has a neighbour is so linked into its group.
5. *Verification.* The words of both lines decide.
6. *Groups.* Connected components of the links between classes; the earliest line of each is kept.

Only DataFrame functions. Aggregates come before shuffles, so a line or template that a third of all lines share
moves as one row per task.

Cases: null text has no lines. Lines without a word are never duplicates and are kept. Null ids come first. Rows that
repeat id and text share their lines' places: neither is earlier than the other. An empty table gives an
empty result. Lines of any length are compared whole. Extra columns are ignored, and kept by
``without_duplicate_lines``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.columns import let
from larkspan.llm.common import SPACE, SPACE_CLASS, bitmap, fits, maybe
from larkspan.llm.components import connected_components
from larkspan.scratch import materialize

MIN_WORDS = 5
_MASK = (1 << 60) - 1


def _add(x: Column, y: Column) -> Column:
    return (x + y).bitwiseAND(_MASK)


def _before(numbers: Column) -> Column:
    """For every place, the sum (modulo 2^60) of the numbers before it. Chunks of about sqrt(n) keep the copying that a
    growing array costs below n sqrt(n)."""

    def running(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0).cast("long")), lambda a, v: F.concat(a, F.array(_add(F.element_at(a, -1), v))))

    def joined(x: Column) -> Column:
        n = F.size(x)
        width = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
        parts = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda k: running(F.slice(x, k * width + 1, width)))

        def placed(p: Column) -> Column:
            bases = running(F.transform(p, lambda own: F.element_at(own, -1)))
            inner = F.zip_with(
                F.slice(bases, F.lit(1), F.size(p)), p, lambda base, own: F.transform(F.slice(own, F.lit(1), F.size(own) - 1), lambda v: _add(base, v))
            )
            return F.flatten(inner)

        return let(parts, placed)

    return let(numbers, joined)


def _variants(w: Column) -> Column:
    """(itself, one): the hash of a line (two words at least), and for every word the hash of the line without it.

    A line's hash is the sum over its words of a hash of word and place; behind the word left out, places move up by one.
    """
    def made(x: Column) -> Column:
        def of(z: Column) -> Column:
            end = F.element_at(z, -1)
            sums = F.struct(_add(end["front"], end["here"]).alias("here"), _add(end["back"], end["moved"]).alias("moved"))
            return let(sums, lambda t: F.struct(
                t["here"].alias("itself"),
                F.transform(z, lambda v: _add(v["front"], t["moved"] - _add(v["back"], v["moved"]))).alias("one"),
            ))

        return let(F.arrays_zip(
            x["here"].alias("here"), x["moved"].alias("moved"), _before(x["here"]).alias("front"), _before(x["moved"]).alias("back")
        ), of)

    here = F.transform(w, lambda v, i: F.xxhash64(v, i).bitwiseAND(_MASK))
    moved = F.transform(w, lambda v, i: F.xxhash64(v, i - 1).bitwiseAND(_MASK))
    return let(F.struct(here.alias("here"), moved.alias("moved")), made)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, line, text) of lines with a word: doc tells apart texts that share an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("line", "text")
    )
    return rows.where(F.trim(F.col("text"), F.lit(SPACE)) != "")


def _norm(text: Column) -> Column:
    """The words of a line, joined by one blank."""
    return F.trim(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))


def _digest(joined: Column) -> Column:
    return F.substring(F.unhex(F.sha2(joined, 256)), 1, 16)


def _half_keys(w: Column, n: Column) -> Column:
    """Keys of the first and last half, for both roundings of a half."""
    def keys(m: Column) -> Column:
        return F.array(
            F.xxhash64(F.lit(0), m, F.slice(w, F.lit(1), m)), F.xxhash64(F.lit(1), m, F.slice(w, n - m + 1, m))
        )

    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(low == high, keys(low)).otherwise(F.concat(keys(low), keys(high)))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: (id, doc, line, kept, keep_id, keep_line, distance)."""
    kind = docs.schema[id_col].dataType
    source = _lines(docs, id_col, text_col)
    split = source.withColumn("norm", _norm(F.col("text"))).withColumn("words", F.split("norm", " ")).withColumn("n", F.size("words"))
    rows = split.select(
        "id", "doc", "line", "n", _digest(F.col("norm")).alias("digest"),
        F.when(F.col("n") >= MIN_WORDS - 1, _half_keys(F.col("words"), F.col("n"))).alias("halves"),
    )
    rows = materialize(rows, "lines")
    place = F.struct("id", "line", "doc")
    classes = rows.groupBy("digest").agg(F.min(place).alias("first"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("m"))
    classes = materialize(classes, "classes")

    shared = classes.select(F.explode("halves").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = materialize(shared.select("key"), "shared")
    flagged = classes.where("halves is not null")
    if fits(shared):
        seen = bitmap(shared)
        flagged = flagged.select("digest", "first", F.array(*[maybe(F.get("halves", F.lit(i)), seen) for i in range(4)]).alias("h"))
    else:
        halves = flagged.select("digest", F.posexplode("halves").alias("i", "key")).join(shared, "key", "left_semi")
        held = halves.groupBy("digest").agg(F.collect_set("i").alias("held"))
        flagged = flagged.join(held, "digest").select("digest", "first", F.array(*[F.array_contains("held", i) for i in range(4)]).alias("h"))
    flagged = flagged.select(
        "digest", "first", (F.get("h", F.lit(0)) | F.get("h", F.lit(2))).alias("front"),
        (F.get("h", F.lit(1)) | F.get("h", F.lit(3))).alias("back"),
    ).where("front or back")
    flagged = materialize(flagged, "flagged")

    # The second scan looks at places alone; only the lines found are split into words.
    own = flagged.select("digest", F.col("first.id").alias("i"), F.col("first.line").alias("l"), F.col("first.doc").alias("d"), "front", "back")
    near = source
    if fits(own):
        near = near.where(maybe(F.xxhash64("doc", "line"), bitmap(own.select(F.xxhash64("d", "l").alias("key")))))
    same_place = F.col("id").eqNullSafe(F.col("i")) & (F.col("line") == F.col("l")) & (F.col("doc") == F.col("d"))
    near = near.join(own, same_place).drop("i", "l", "d").dropDuplicates(["digest"])
    near = near.withColumn("norm", _norm(F.col("text"))).withColumn("words", F.split("norm", " ")).select(
        "digest", "id", "line", "doc", F.size("words").alias("n"), "norm", "front", "back", _variants(F.col("words")).alias("v")
    )
    near = materialize(near, "near")

    # A word outside a shared half may be the one that differs.
    hashes = near
    low = F.floor((F.col("n") - 1) / 2)
    variants = hashes.where(F.col("n") >= MIN_WORDS).select(
        "digest", "id", "line", "doc", "n", "front", "back", F.posexplode("v.one").alias("p", "h")
    )
    variants = variants.where((F.col("front") & (F.col("p") >= low)) | (F.col("back") & (F.col("p") < F.col("n") - low)))
    variants = variants.select("digest", "id", "line", "doc", F.xxhash64("h", F.col("n") - 1).alias("key"), "p")
    itself = hashes.select("digest", "id", "line", "doc", F.xxhash64("v.itself", "n").alias("key"), F.lit(-1).alias("p"))
    every = variants.unionByName(itself)
    twice = materialize(every.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "twice")
    met = every.where(maybe(F.col("key"), bitmap(twice))) if fits(twice) else every.join(twice, "key", "left_semi")
    met = materialize(met, "met")

    at = F.struct("id", "line", "doc", "digest")
    by_place = materialize(met.groupBy("key", "p").agg(F.min(at).alias("earliest"), F.count(F.lit(1)).alias("m")), "by_place")
    # Lines of equal words are one class, so a key has one line at most, and all who hold it as a variant are one word longer.
    by_line = by_place.where("p < 0").select("key", "earliest")
    met = met.where("p >= 0").withColumn("own", at)
    replaced = met.join(by_place.where("p >= 0 and m > 1").select("key", "p", "earliest"), ["key", "p"])
    longer = met.join(by_line, "key")
    pairs = replaced.select("own", "earliest").unionByName(longer.select("own", "earliest"))
    pairs = pairs.select(F.col("own.digest").alias("digest"), F.col("earliest.digest").alias("other")).where("digest <> other").distinct()
    texts = near.select("digest", F.split("norm", " ").alias("a"))
    both = pairs.join(texts, "digest").join(texts.select(F.col("digest").alias("other"), F.col("a").alias("b")), "other")
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    back = F.zip_with(F.reverse("a"), F.reverse("b"), lambda x, y: x.eqNullSafe(y))
    run = lambda z: F.coalesce(F.nullif(F.array_position(z, F.lit(False)), F.lit(0)) - 1, F.size(z).cast("long"))
    longest = F.greatest(F.size("a"), F.size("b"))
    apart = F.abs(F.size("a") - F.size("b"))
    sure = both.where((apart <= 1) & (longest >= MIN_WORDS) & (run(same) + run(back) >= longest - 1))
    own = near.select("digest", F.struct("id", "line", "doc").alias("u"))
    links = sure.select("digest", "other").join(own, "digest").join(own.select(F.col("digest").alias("other"), F.col("u").alias("v")), "other")
    groups = connected_components(links.select("u", "v")).where("node <> component")

    heads = classes.select("digest", F.col("first").alias("node"), "m")
    verdict = heads.join(groups, "node", "left").where("m > 1 or component is not null").select("digest", "node", "component")
    out = rows.drop("halves").join(verdict, "digest", "left")
    # A copy of its class's earliest line is at distance 0 from it, whatever line is kept for both.
    distance = F.when(F.col("component").isNotNull() & place.eqNullSafe(F.col("node")), 1).when(F.col("node").isNotNull() & ~place.eqNullSafe(F.col("node")), 0)
    head = F.coalesce("component", "node")
    keep_id = F.when(distance.isNull(), F.col("id")).otherwise(head["id"])
    keep_line = F.when(distance.isNull(), F.col("line")).otherwise(head["line"])
    return out.select(
        F.col("id").cast(kind).alias(id_col), "doc", "line", distance.isNull().alias("kept"), keep_id.alias("keep_id"),
        keep_line.alias("keep_line"), distance.alias("distance"),
    )


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without duplicate lines; a document of which no line with a word is left goes as well."""
    lines = duplicate_lines(docs, id_col, text_col)
    lines = materialize(lines.select(F.col(id_col).alias("__id"), F.col("doc").alias("__doc"), "line", "kept"), "verdicts")
    flags = lines.groupBy("__id", "__doc").agg(
        F.min("kept").alias("__clean"), F.max("kept").alias("__any"), F.sort_array(F.collect_set(F.when(~F.col("kept"), F.col("line")))).alias("__gone")
    )
    touched = materialize(flags.where("not __clean"), "touched")
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    rows = docs.select(F.struct("*").alias("doc")).withColumn("key", F.xxhash64(text))
    keys = touched.select(F.col("__doc").alias("key"))
    rows = rows.withColumn("suspect", maybe(F.col("key"), bitmap(keys)) if fits(keys) else F.lit(True))
    found = (F.col("key") == F.col("__doc")) & F.col("doc")[id_col].eqNullSafe(F.col("__id"))
    joined = rows.where("suspect").join(touched, found, "left")

    # The gone places become a flag for every line: for each gap between them, that many true and one false.
    def stay(lines: Column) -> Column:
        ends = F.concat(F.col("__gone"), F.array(F.size(lines)))
        begins = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda x: x + 1))
        gaps = F.zip_with(begins, ends, lambda b, e: F.concat(F.array_repeat(F.lit(True), e - b), F.array(F.lit(False))))
        return let(F.flatten(gaps), lambda flags: F.array_join(F.filter(lines, lambda x, i: F.get(flags, i)), "\n"))

    cut = F.when(F.col("__gone").isNotNull(), let(F.split(text, "\n", -1), stay))
    out = joined.where(F.col("__any").isNull() | F.col("__any")).withColumn("cut", cut)
    new = {text_col: F.coalesce("cut", F.col("doc")[text_col])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("cut"), F.col("doc")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    out = out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
    return rows.where("not suspect").select("doc.*").unionByName(out)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Duplicate lines of all documents: a row per line with a word."""
    from larkspan.llm.common import load

    return duplicate_lines(load(spark, sf_dir, "documents")).drop("doc")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, i - 1 AS line, list_filter(string_split_regex(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), a AS (
  SELECT doc_id, line, array_to_string(w, ' ') AS norm, w, len(w) AS n FROM l WHERE len(w) > 0
), c AS (
  SELECT norm, any_value(w) AS w, any_value(n) AS n, min({'id': doc_id, 'line': line}) AS first FROM a GROUP BY norm
), v AS (
  SELECT norm, first, n - 1 AS n, p, array_to_string(list_concat(w[:p - 1], w[p + 1:]), ' ') AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM c WHERE n >= 5)
), e AS MATERIALIZED (
  SELECT DISTINCT x, y FROM (
    SELECT first AS x, min(first) OVER (PARTITION BY rest, n, p) AS y FROM v
    UNION ALL SELECT v.first, c.first FROM v JOIN c ON c.norm = v.rest
  ) WHERE x <> y
), g AS MATERIALIZED (
  SELECT x, y FROM e UNION SELECT y, x FROM e
), r(node, head) AS (
  SELECT DISTINCT x, x FROM g
  UNION
  SELECT g.y, r.head FROM r JOIN g ON g.x = r.node WHERE r.head < g.y
), k AS (
  SELECT node, min(head) AS head FROM r GROUP BY node HAVING min(head) < node
), z AS (
  SELECT a.doc_id, a.line, c.first = {'id': a.doc_id, 'line': a.line} AS earliest, c.first, k.head FROM a JOIN c USING (norm) LEFT JOIN k ON k.node = c.first
)
SELECT doc_id, line::INT AS line, earliest AND head IS NULL AS kept, coalesce(head, first).id AS keep_id, coalesce(head, first).line::INT AS keep_line,
       CASE WHEN NOT earliest THEN 0 WHEN head IS NOT NULL THEN 1 END AS distance
FROM z
"""
