"""A training corpus from ``documents``: quality rules, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import load
from larkspan.llm.line_dedup import without_duplicate_lines
from larkspan.llm.mixing import mixed_documents
from larkspan.llm.near_dedup import without_near_duplicates
from larkspan.llm.packing import best_fit_packing, token_pieces
from larkspan.llm.quality import passing
from larkspan.scratch import kept_only, materialize, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and blank texts have no words and go; long texts are judged whole; a null source is a host. Rows that repeat an id are judged
    each. Columns may have any names. An empty table stays empty.
    """
    return passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or are one word apart from it, go, and documents of which no line is left.

    Earlier is by id, null ids first, then by line. Rows that repeat id and text share their lines, and keep or lose them together; of rows
    that share an id but not the text, a line that both have stays in the one of the lesser text hash. Texts without words stay as they are.
    Lines of any length are compared whole. Columns may have any names. An empty table stays empty.
    """
    return without_duplicate_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest id: similarity 0.8 on five-word shingles.

    Rows that share an id are one document, which stays or goes whole. Rows with null ids go where they are linked with a document that has
    an id; a group without ids stays, as nothing tells its rows apart. Texts without words link with nothing. Long texts are compared whole.
    Columns may have any names. An empty table stays empty.
    """
    return without_near_duplicates(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a row per document and pass that takes of it.

    Texts without words are never taken. A null source is the last source. Rows that repeat an id are separate; rows equal in id and text
    are interchangeable. Long texts are cut between words. Columns may have any names. An empty table stays empty.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens.

    A null or empty text is one piece, its end id. Rows that repeat an id are packed each. Long texts are cut into full pieces and a rest.
    Only id and text are read. An empty table gives an empty result.
    """
    packed = best_fit_packing(token_pieces(docs))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]

#: Token ids and MinHash are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's tables go when the next one's docs are written."""
    docs = last = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with kept_only() as keep:
            docs = materialize(stage(spark, last, sf_dir), name)
            keep.append(docs)
        if name != STAGES[0][0]:
            release(last)
        last = docs
    return docs
