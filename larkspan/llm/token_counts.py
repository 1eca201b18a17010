"""Token counts by byte-pair merging with a heap and a linked list.

The symbols of a text form a doubly linked list. A heap holds every adjacent pair that the
vocabulary can merge, by rank; the lowest rank (the leftmost among equals) is popped, merged if both
symbols are still there, and the two new pairs are pushed. The count is the number of initial
symbols minus the number of merges; identifiers are never made. A symbol that the vocabulary lacks
counts one token for each of its UTF-8 bytes.

Merging never crosses certain places, so a text is cut there and equal pieces are counted once:
before a white-space mark that follows another character (no entry holds a mark after another
character; checked when the model is read), and around line feeds (no entry of two characters or
more holds one; checked likewise). Counts of pieces are kept in a table of bounded size.

Cases: null text is empty and has 0 tokens and 0 bytes. Ids may be null or repeat; every row gives a
row. An empty table gives an empty result. Texts of any length take memory in proportion to their own
length. Columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Pieces whose counts a worker remembers before it starts anew.
REMEMBERED = 300_000


class MergeCounter:
    """Counts tokens as a byte-fallback BPE model of the sentencepiece library gives them."""

    def __init__(self, ranks: dict[str, int], single: set[str]):
        self.ranks, self.single = ranks, single
        long = [p for p in ranks if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):
            raise ValueError("an entry holds a white-space mark after another character")
        newline = "" if any("\n" in p for p in long) else "\n"
        self.cut = re.compile(f"{MARK}+[^{MARK}{newline}]*|[^{MARK}{newline}]+" + ("|\n" if newline else ""))
        self.known: dict[str, int] = {}

    @classmethod
    def from_model(cls, path: str) -> MergeCounter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks, single = {}, set()
        pieces = [
            (model.id_to_piece(i), model.get_score(i))
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        # Merging prefers the highest score; equal scores share a rank.
        order = {s: r for r, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        for piece, score in pieces:
            ranks[piece] = order[score]
            if len(piece) == 1:
                single.add(piece)
        return cls(ranks, single)

    def merge(self, piece: str) -> int:
        """Tokens of a piece: initial symbols (a byte each where unknown) minus merges."""
        ranks, n = self.ranks, len(piece)
        count = sum(1 if c in self.single else len(c.encode()) for c in piece)
        text = list(piece)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(text[i] + text[i + 1])) is not None:
                heap.append((r, i, i + 1, len(text[i]) + len(text[i + 1])))
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not text[i] or not text[j] or len(text[i]) + len(text[j]) != size or right[i] != j:
                continue
            text[i] += text[j]
            text[j] = ""
            count -= 1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := ranks.get(text[i] + text[k])) is not None:
                    heapq.heappush(heap, (r, i, k, len(text[i]) + len(text[k])))
            if (h := left[i]) >= 0 and (r := ranks.get(text[h] + text[i])) is not None:
                heapq.heappush(heap, (r, h, i, len(text[h]) + len(text[i])))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for piece in self.cut.findall(MARK + text.replace(" ", MARK)):
            n = known.get(piece)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = self.merge(piece)
                if len(piece) <= 200:
                    known[piece] = n
            total += n
        return total


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The counter of a model file, read once per worker."""
    if path not in _counters:
        _counters[path] = MergeCounter.from_model(path)
    return _counters[path]


def token_counts(
    docs: DataFrame,
    model_path: str | None = None,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: (id, n_bytes, n_tokens, over_limit).

    model_path: a model file that every executor can open; by default the public one's name is
    resolved on each executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import public_tokenizers

        own = counter(model_path or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            counts = [own.count(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n long")
    return out.select(F.col("id").alias(id_col), "n_bytes", F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k piece model."""
    from larkspan.llm.common import load

    return token_counts(load(spark, sf_dir, "documents"))
