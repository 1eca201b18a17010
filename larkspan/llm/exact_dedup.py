"""Exact deduplication through a log-structured merge index of text digests.

* Memtable and flush: every task of the scan is a memtable; it sorts its (digest, id) rows and writes
  them as one immutable run (Parquet, with a Bloom filter on the digest in every row group). Runs of one ``add`` are level 0.
* Compaction (``DigestIndex``): when a level has FANOUT members they are merged into one of the next level, with a row per digest, which keeps
  the smallest identifier (``keep="min"``) or the largest (``keep="max"``) and the number of rows. So a row is rewritten once per level, and
  n adds leave about FANOUT log(n) members. Rows are
  pre-aggregated before the shuffle, so a text that a third of all rows share moves as one row per task.
* Look-up: a few given digests are pushed down to every member's scan, which skips the row groups whose filter lacks them; many are joined.
* Hits: a digest with two rows or more is a hit. A fixed-size bitmap of the hit digests (a semi-join where they outgrow it) lets the
  second scan skip the texts of all other documents; the hits' texts are compared byte for byte
  (smallest equals largest text of the digest, again pre-aggregated). Digests under which texts
  differ are resolved by grouping those rows by the text itself.

The query adds its table at once and merges it into one level, as every row gets a verdict.

Only DataFrame functions; nothing but one boolean (does any digest hold different texts) reaches
the driver.

Cases: a null text counts as the empty text. Null ids are ignored when a group has other ids; a
group of null ids has keep_id null and all its rows are kept. Rows that repeat id and text cannot be
told apart: they share keep_id and kept, and each counts in group_size. An empty table gives an
empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import bitmap, fits, maybe
from larkspan.scratch import materialize

#: Members of a level that are merged into one of the next.
FANOUT = 4
#: Digests that a look-up pushes down at a time: what Parquet's reader tests against its filters one by one.
PUSHED = 10
#: Parquet options of a run: filters sized to the digests of their row group. Where a dictionary holds all digests Parquet
#: writes no filter, so they have none.
BLOOM = {
    "parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.enable.dictionary#digest": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flush(docs: DataFrame, id_col: str, text_col: str, digest=sha256) -> DataFrame:
    """Write the sorted runs of ``docs``: (id, digest)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"))
    return materialize(rows.sortWithinPartitions("digest", "id"), "runs", BLOOM)


def compact(members: list[DataFrame], keep: str = "min") -> DataFrame:
    """Merge runs (id, digest) and members of levels (digest, keep_id, n) into one member with a row per digest."""
    pick = {"min": F.min, "max": F.max}[keep]
    rows = None
    for m in members:
        if "n" not in m.columns:
            m = m.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
        rows = m if rows is None else rows.unionByName(m)
    merged = rows.groupBy("digest").agg(pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return materialize(merged.sortWithinPartitions("digest"), "level", BLOOM)


class DigestIndex:
    """Levels of sorted members. Members are never changed; ``add`` puts one on level 0 and merges full levels."""

    def __init__(self, keep: str = "min", fanout: int = FANOUT):
        self.keep, self.fanout, self.levels = keep, fanout, [[]]

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
        """Flush the rows of ``docs``; returns their runs."""
        runs = flush(docs, id_col, text_col, digest)
        self.levels[0].append(runs)
        at = 0
        while len(self.levels[at]) >= self.fanout:
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(compact(self.levels[at], self.keep))
            self.levels[at] = []
            at += 1
        return runs

    def members(self) -> list[DataFrame]:
        return [m for level in self.levels for m in level]

    def merged(self) -> DataFrame:
        """All members as one: (digest, keep_id, n). The index is that member from now on."""
        members = self.members()
        if len(members) > 1 or (members and "n" not in members[0].columns):
            members = [compact(members, self.keep)]
            self.levels = [[], *[[] for _ in self.levels[1:-1]], members] if len(self.levels) > 1 else [[], members]
        return members[0]

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """(digest, keep_id, n) of those given digests that the index holds."""
        rows = None
        for m in self.members():
            if "n" not in m.columns:
                m = m.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
            for low in range(0, len(digests), PUSHED):
                found = m.where(F.col("digest").isin([bytearray(d) for d in digests[low : low + PUSHED]]))
                rows = found if rows is None else rows.unionByName(found)
        pick = {"min": F.min, "max": F.max}[self.keep]
        return rows.groupBy("digest").agg(pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest=sha256,
) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, digest)."""
    index = DigestIndex(keep)
    runs = index.add(docs, id_col, text_col, digest)
    level = index.merged()
    hits = level.where("n > 1").select("digest")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("digest"))
    if fits(hits):
        suspects = rows.where(maybe(F.xxhash64("digest"), bitmap(hits.select(F.xxhash64("digest").alias("key")))))
    else:
        suspects = rows.join(hits, "digest", "left_semi")
    differing = (
        suspects.groupBy("digest")
        .agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
        .where("lo <> hi")
        .select("digest")
    )
    differing = materialize(differing, "differing")

    found = runs.join(level, "digest", "left").select("id", "keep_id", F.col("n").alias("group_size"), "digest")
    if not differing.isEmpty():
        pick = {"min": F.min, "max": F.max}[keep]
        mixed = rows.join(differing, "digest", "left_semi")
        own = mixed.groupBy("digest", "text").agg(
            pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        resolved = mixed.join(own, ["digest", "text"]).select("id", "keep_id", "group_size", "digest")
        found = found.join(differing, "digest", "left_anti").unionByName(resolved)
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Equal texts of ``documents``; the row with the largest doc_id stays."""
    from larkspan.llm.common import load

    out = exact_dedup(load(spark, sf_dir, "documents"), keep="max")
    return out.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
