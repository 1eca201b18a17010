"""Mixing sources to target weights by drawing blocks.

* Targets. Sources in code point order (null last) have the weights 5, 2, 1, repeating, and share 150 %
  of all words. A target stops at twice its source's size; what is cut off is shared again by weight
  until none is above. The common level is found by iterating one aggregate over the table of sources:
  only sums reach the driver, however many sources there are.
* Blocks. A source's documents, in id order within hashed buckets, form one stream of words, packed
  into blocks of ``block`` words. The position of a document in the stream is a running sum that no
  single task computes (``spread_rank``).
* Counts. A source owes one slot per block: whole passes over its blocks, then a partial
  pass, the last slot cut to the word. Where the partial pass draws the source's short last block, later slots (one more if
  need be) owe the difference. How many slots of a source an output shard gets is drawn: a multinomial count over the shards, given the
  source's total (which the target fixes).
* Slots. The counts allot the slots: a shard gets a run of as many of its source's slots as its count says (``shard_counts``).
* Mapping. Slot k of a pass takes the block that a pseudorandom permutation of the source's block numbers
  sends k to: a modular multiplication followed by swap-or-not rounds, both one-to-one, so a
  pass takes no block twice and no document is taken more than twice.
* Join. Slots and blocks meet on (source, block number), a key that no hot source can skew.

Only DataFrame functions. Hashes and ids decide everything, so reruns agree.

Cases: null or blank text has size 0 and takes nothing. A null source is a source, the last one. Rows
that repeat an id are separate rows; null ids likewise; rows equal in id and text are interchangeable. An empty table gives an empty result. Long texts
are counted and cut whole. Columns other than id, source and text are read only by ``mixed_documents``, which returns them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.columns import let, small
from larkspan.llm.common import SPACE, SPACE_CLASS, word_count
from larkspan.ranks import spread_rank
from larkspan.scratch import materialize

#: Broadcast the table of sources up to this many rows; beyond, it is joined by shuffle.
SOURCES_BROADCAST = 100_000
#: Slots that one row expands to at a time.
CHUNK = 4096
#: Multipliers: primes of 2^61 and more, above any number of blocks.
PRIMES = (2305843009213693951, 4611686018427387847, 9223372036854775783)
ROUNDS = 6


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) to (source, source_id, source_size, target); source_id is the code point rank."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = totals.orderBy(F.col("source").asc_nulls_last()).select(
        "source", "source_size", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")
    )
    placed = materialize(placed, "sources")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = placed.groupBy("p").agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("low"))
    starts = starts.select(F.col("p").alias("q"), "low", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    ranked = placed.join(F.broadcast(starts), F.col("p") == F.col("q")).select(
        "source", "source_size", (F.col("base") + F.col("m") - F.col("low")).alias("source_id")
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights)).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * most)
    ranked = materialize(ranked, "ranked")

    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") <= F.col("weight") * level
        n, held, open_weight = ranked.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - held) / open_weight
    if capped >= 0 and not open_weight:  # every source gives all it may
        target = F.col("cap")
    else:
        target = F.least("cap", F.col("weight") * level)
    return ranked.select("source", "source_id", "source_size", target.cast("double").alias("target"))


def permuted(k: Column, n: Column, salt: Column) -> Column:
    """A pseudorandom one-to-one map of 0..n-1, for n below the smallest of PRIMES."""
    prime = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(salt, F.lit(len(PRIMES)))).cast("int") + 1)
    wide = lambda x: x.cast("decimal(19,0)")  # noqa: E731  products have 38 digits at most
    start = (((wide(k) * wide(prime % n)) % wide(n)).cast("long") + F.pmod(F.xxhash64(salt), n)) % n

    def swap(x: Column, r: Column) -> Column:
        partner = (F.pmod(F.xxhash64(salt, r), n) - x + n) % n
        chosen = F.xxhash64(salt, r, F.greatest(x, partner)).bitwiseAND(1) == 1
        return F.when(chosen, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, swap)


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join the table of sources to rows: broadcast when small, by (skew-splittable) shuffle when not."""
    if sources.limit(SOURCES_BROADCAST + 1).count() <= SOURCES_BROADCAST:
        sources = F.broadcast(sources)
    own = sources.withColumnRenamed("source", "__source")
    return rows.join(own, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mix(
    docs: DataFrame,
    weights=(5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 128,
    shard_words: int = 1 << 22,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(rows, drawn).

    rows: (row, id, hash, source, size, source_size, target), a row per document; hash is the text's.
    drawn: (row, pass, shard, slot, block, from, n): n words of the document from its word ``from`` on are
    part of the block that the slot holds.
    """
    sized = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sized = materialize(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    return _mix(sized, weights, share, most, block, shard_words)


def shard_counts(owed: DataFrame, shards: Column) -> DataFrame:
    """(source_id, slots) to (source_id, shard, n, first): the drawn number of a source's slots in every output shard that gets any, and
    the first slot of the shard's run. The counts of a source add up to its slots."""
    dealt = owed.select("source_id", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
    dealt = dealt.repartition(_partitions(owed), "source_id", "chunk")
    first = F.col("chunk") * CHUNK
    draws = dealt.select("source_id", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("slots")) - 1)).alias("draw"))
    counts = draws.groupBy("source_id", F.pmod(F.xxhash64("source_id", "draw", F.lit(11)), shards).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return spread_rank(materialize(counts, "counts"), "source_id", "shard", "first", amount="n")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _mix(sized: DataFrame, weights, share, most, block, shard_words) -> tuple[DataFrame, DataFrame]:
    sources = targets(sized, weights, share, most)
    sources = sources.withColumn("width", F.lit(block).cast("long")).withColumn(
        "blocks", F.ceil(F.col("source_size") / F.col("width")).cast("long")
    )
    sources = materialize(sources, "targets")
    rows = materialize(_with_sources(sized, sources), "rows")

    full = F.floor(F.round("target") / F.col("source_size")).cast("long")
    rest = F.round("target").cast("long") - full * F.col("source_size")
    owed = (
        sources.where("source_size > 0")
        .withColumn("full", full)
        .withColumn("rest", rest)
        .withColumn("short", F.col("blocks") * F.col("width") - F.col("source_size"))
        # One slot more than full blocks ask for: it makes up for a short block.
        .withColumn("partial", F.when(F.col("rest") > 0, F.least("blocks", F.ceil(F.col("rest") / F.col("width")).cast("long") + 1)).otherwise(0))
        .withColumn("slots", F.col("full") * F.col("blocks") + F.col("partial"))
        .where("slots > 0")
    )
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(_total(sources) * share / shard_words)).cast("long"))
    runs = shard_counts(owed, shards).join(small(owed.drop("source", "source_size", "target"), SOURCES_BROADCAST), "source_id")
    # A shard's run is expanded by one task: about shard_words / block slots.
    slots = runs.repartition(_partitions(sources), "source_id", "shard").withColumn(
        "slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    ).withColumn("pass", F.floor(F.col("slot") / F.col("blocks")).cast("int"))
    k = F.col("slot") % F.col("blocks")
    salt = F.xxhash64("source_id", "pass")
    slots = slots.withColumn("k", k).withColumn("block", permuted(k, F.col("blocks"), salt))
    # The partial pass takes what is owed after the blocks before a slot; ``at`` is the slot of the short block, one a source.
    cut = small(slots.where((F.col("pass") == F.col("full")) & (F.col("short") > 0) & (F.col("block") == F.col("blocks") - 1)).select("source_id", F.col("k").alias("at")), SOURCES_BROADCAST)
    slots = slots.join(cut, "source_id", "left")
    before = F.col("k") * F.col("width") - F.when(F.col("at") < F.col("k"), F.col("short")).otherwise(0)
    owed_here = F.when(F.col("pass") < F.col("full"), F.col("width")).otherwise(F.least(F.col("width"), F.col("rest") - before))
    slots = slots.withColumn("owed", owed_here).where("owed > 0").select(
        "source_id", "slot", "pass", "shard", "block", "owed"
    )

    stream = spread_rank(
        rows.where("size > 0").withColumn("own", F.struct("id", "hash")), "source_id", "own", "begin", amount="size", order=["id", "size", "hash"]
    )
    end = F.col("begin") + F.col("size")
    parts = stream.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("begin") / F.col("width")), F.floor((end - 1) / F.col("width"))))
    ).withColumn("low", F.greatest("begin", F.col("block") * F.col("width")))
    parts = parts.select(
        "row", "source_id", "block", (F.col("low") - F.col("begin")).alias("from"),
        (F.col("low") - F.col("block") * F.col("width")).alias("inside"),
        (F.least(end, (F.col("block") + 1) * F.col("width")) - F.col("low")).alias("length"),
    )
    # Before they are expanded the slots look small, so their join must not be left to the size estimate.
    drawn = parts.join(slots.hint("merge"), ["source_id", "block"]).withColumn(
        "n", F.least("length", F.col("owed") - F.col("inside"))
    )
    return rows, drawn.where("n > 0").select("row", "pass", "shard", "slot", "block", "from", "n")


def _total(sources: DataFrame) -> int:
    return sources.agg(F.sum("source_size")).first()[0] or 0


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the number of output shards that they go to."""
    from larkspan.llm.common import load

    rows, drawn = mix(load(spark, sf_dir, "documents"))
    taken = drawn.groupBy("row").agg(F.sum("n").alias("taken"), F.size(F.collect_set("shard")).alias("n_shards"))
    out = rows.join(taken, "row", "left")
    return out.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("n_shards", F.lit(0)).alias("n_shards"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row per document and pass that takes of it.

    A document taken whole keeps its text; of one taken in part the taken words remain, with the white space behind each but the last.
    """
    source_col = options.pop("source_col", "source")
    kept = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "documents")
    text = F.col("doc")[text_col]
    sized = kept.select(
        "row", F.col("doc")[id_col].alias("id"), F.xxhash64(text).alias("hash"), F.col("doc")[source_col].alias("source"), word_count(text).alias("size")
    )
    full = {"weights": (5, 2, 1), "share": 1.5, "most": 2.0, "block": 128, "shard_words": 1 << 22} | options
    rows, drawn = _mix(materialize(sized, "sized"), **full)
    # A document has at most size / block + 2 parts in a pass.
    spans = drawn.groupBy("row", "pass").agg(
        F.sum("n").alias("taken"), F.sort_array(F.collect_list(F.struct("from", "n"))).alias("spans")
    )
    spans = spans.join(rows.select("row", "size"), "row").select("row", F.when(F.col("taken") < F.col("size"), F.col("spans")).alias("spans"))
    pieces = F.regexp_extract_all(text, F.lit(f"[^\\x20\\x09-\\x0D]++{SPACE_CLASS}*+"), F.lit(0))

    def cut(each: Column) -> Column:
        own = F.transform("spans", lambda s: F.slice(each, (s["from"] + 1).cast("int"), s["n"].cast("int")))
        return F.rtrim(F.array_join(F.flatten(own), ""), F.lit(SPACE))

    out = kept.join(spans, "row").withColumn("cut", F.when(F.col("spans").isNotNull(), let(pieces, cut)).otherwise(text))
    new = {text_col: F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
