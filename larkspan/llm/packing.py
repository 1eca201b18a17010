"""Best-fit packing of token pieces into sequences, in bulk-synchronous supersteps.

Documents become token ids and an end id; longer ones are cut into full pieces and a rest. Pieces are range-sorted once: a piece's
rank is the number of shorter pieces and its place among those of its length (``spread_rank``; no task sees a whole length).
Bands of lengths are packed from the longest to the shortest; the pieces of a band are more than BAND times as long
as its longest, U, but for the last band, which holds all of 1 / SHORT of the capacity and less. A superstep packs a band:

1. *Gaps.* A sequence with room g, if the band's shortest piece fits, offers floor(g / U) slots (one at least): all of size U but the
   last, which has the rest. Slots are range-sorted by size as pieces are by length; a slot's place is the number of smaller ones and its rank
   among its equals, from the counts per gap and the sequence's rank among those of the same gap.
2. *Successor sweep.* The successor of a piece is the first slot in that order which holds it (``sweep``). The sweep runs over the
   counts per length and gap, three rows for every size up to the capacity; its result goes through the driver as a broadcast does.
3. *Conflicts* are resolved by rank: pieces that want the same slot, or one that is taken, move on to the next ones, in the order of their
   ranks. The place of piece j is j + max(successor(i) - i) over all i up to j. Pieces and slots meet on that place, an equi-join whose
   keys occur once on each side.
4. *Update.* Pieces beyond the last slot are the band's longest; they open new sequences, floor(capacity / U) of them to each. What was
   placed is taken off the gaps, and the next superstep begins.

There are about log(SHORT) / log(1 / BAND) supersteps, whatever the number of documents and the capacity (13 or 14 for 4,096). All tables of pieces and
gaps stay distributed; the driver holds the bands and a superstep's sweep.

Cases: null text is the empty text (one piece with the end id alone). Rows that repeat an id are packed
each; null ids likewise. Pieces of equal length are ordered by a hash of id, piece and ids. An empty table gives an empty result.
A text of any length is cut whole. Columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions.columns import small
from larkspan.ranks import spread_rank
from larkspan.scratch import materialize

#: The shortest piece of a band over the longest, at least.
BAND = 0.7
#: Pieces of up to the capacity over SHORT are one band.
SHORT = 64
#: Pieces that one task writes; by the known counts, small bands and gaps are written by few tasks.
PIECES_A_TASK = 200_000
#: Rows of counts or slots that may be broadcast.
BROADCAST = 50_000
#: Units whose ids a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Bytes of text whose words are looked up together.
TOGETHER = 4 << 20


class WordIds:
    """Token ids of whole texts by a tokenizer whose pre-tokenizer drops white space.

    No token reaches over white space. Words of printable ASCII and Latin-1 letters are cut, in lower case, into the units that the pre-tokenizer
    makes of them: runs of letters, single digits, runs of other signs (NFC changes none of these characters). Other words are one unit: those that
    may hold an added token, or an apostrophe that may begin a suffix. Units of many texts are dictionary-encoded together, and the ids of the
    distinct ones remembered. New units that were cut go to the tokenizer's model as one line: each is one pre-token, whose last token
    carries the end-of-word mark. New whole words go to the tokenizer one by one.
    """

    SPACE, LETTER, DIGIT, SIGN, ODD = range(5)

    def __init__(self, path: str):
        import pyarrow as pa
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kinds = np.full(256, self.ODD, np.uint8)
        for i in range(33, 127):
            self.kinds[i] = self.LETTER if chr(i).isalpha() else self.DIGIT if chr(i).isdigit() else self.SIGN
        self.kinds[[9, 10, 11, 12, 13, 32]] = self.SPACE
        self.lower = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint8)
        self.none = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.known, self.ids, self.sizes = self.none  # units, their ids one after the other, the number of each one's

    def units(self, texts) -> tuple:
        """The units of all texts (an Arrow array of strings, no nulls), whether each is a whole word, and where each text's units end."""
        import pyarrow as pa

        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        text = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        kind, low = self.kinds[text], self.lower[text]
        lead = np.flatnonzero(text[:-1] == 0xC3)  # of U+00C0 to U+00FF
        second = text[lead + 1]
        lead, second = lead[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = self.LETTER
        low[lead + 1] = second | 0x20
        low[lead[second == 0x9F] + 1] = 0x9F  # sharp s
        first = np.zeros(len(text) + 1, bool)  # of a text
        first[bounds] = True
        word = kind != self.SPACE
        begins = word & first[:-1]
        begins[1:] |= word[1:] & ~word[:-1]
        starts = begins | (kind == self.DIGIT)
        starts[1:] |= word[1:] & (kind[1:] != kind[:-1])
        sign = np.flatnonzero((text[:-1] == 0x27) & np.isin(low[1:], np.frombuffer(b"strvmld", np.uint8)) | (text[:-1] == 0x3C) & (text[1:] == 0x7C))
        odd = np.concatenate([np.flatnonzero(kind == self.ODD), sign])
        at = np.flatnonzero(begins)
        is_odd, whole = np.zeros(len(at), bool), np.zeros(len(text), bool)
        is_odd[np.searchsorted(at, odd, "right") - 1] = True
        if len(odd):
            whole[at[0] :] = np.repeat(is_odd, np.diff(at, append=len(text)))
        low[whole] = text[whole]
        starts &= ~whole | begins
        places = np.flatnonzero(starts)
        offsets = np.append(np.flatnonzero(starts[word]), np.count_nonzero(word)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(low[word]))
        return found, whole[places], np.searchsorted(places, bounds[1:])

    def learn(self, cut, words: list[str]) -> None:
        """Remember the ids of units that were cut (an Arrow array) and of whole words."""
        import pyarrow as pa

        ids = np.array(self.bare.encode_batch_fast([" ".join(cut.to_numpy(zero_copy_only=False))], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(cut):
            words, cut, ids, ends = cut.to_pylist() + words, cut[:0], ids[:0], ends[:0]
        others = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        self.known = pa.concat_arrays([self.known, cut, pa.array(words, pa.string())])
        self.ids = np.concatenate([self.ids, ids, *[np.array(x, "<u4") for x in others]])
        self.sizes = np.concatenate([self.sizes, np.diff(ends, prepend=0), np.array([len(x) for x in others], np.int64)])

    def packed(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts as little-endian unsigned 32-bit, each text's followed by the end id, and where each text's end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found, whole, last = self.units(texts)
        coded = found.dictionary_encode()
        units, index = coded.dictionary, coded.indices.to_numpy()
        as_word = np.zeros(len(units), bool)
        as_word[index[whole]] = True
        new = pc.index_in(units, value_set=self.known).is_null().to_numpy(zero_copy_only=False)
        if len(self.known) + np.count_nonzero(new) > REMEMBERED:
            self.known, self.ids, self.sizes = self.none
            new[:] = True
        if new.any():
            self.learn(units.filter(pa.array(new & ~as_word)), units.filter(pa.array(new & as_word)).to_pylist())
        number = pc.index_in(units, value_set=self.known).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, ids = np.append(self.sizes, 1), np.append(self.ids, np.uint32(end_id)).astype("<u4")
        at = np.insert(number[index], last, len(self.known))  # the end id behind a text's last unit
        firsts, taken = (np.cumsum(sizes) - sizes)[at], sizes[at]
        after = np.cumsum(taken)
        places = np.arange(taken.sum()) + np.repeat(firsts - after + taken, taken)
        return ids[places], after[last + np.arange(len(last))]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The encoder of a tokenizer file, read once per worker."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def token_pieces(
    docs: DataFrame,
    capacity: int = 4096,
    end_id: int = 1,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """The pieces: (id, piece, start, length, ids_crc32) and with ``with_ids`` their ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        schema += ", ids binary"

    def run(batches: Iterator) -> Iterator:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        import pyarrow.compute as pc
        import public_tokenizers

        own = encoder(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
        width = capacity * 4
        names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            rows: list[tuple] = []
            take = []
            texts = batch.column(1)
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            share = (np.cumsum(sizes) - sizes) // TOGETHER  # texts looked at together begin within so many bytes
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(texts)] if len(texts) else []
            for low, high in zip(cuts, cuts[1:], strict=False):
                ids, ends = own.packed(texts.slice(low, high - low), end_id)
                packed, ends = memoryview(ids.tobytes()), (4 * ends).tolist()
                for at, (first, last) in enumerate(zip([0, *ends], ends, strict=False), low):
                    for n, begin in enumerate(range(first, last, width)):
                        part = packed[begin : min(begin + width, last)]
                        rows.append((n, (begin - first) // 4, len(part) // 4, zlib.crc32(part), *[bytes(part)] * with_ids))
                        take.append(at)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) - 1)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.record_batch([batch.column(0).take(pa.array(take, pa.int64())), *arrays], names)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def bands(lengths: list[int], ratio: float = BAND, short: int = 0) -> list[tuple[int, int]]:
    """(shortest, longest) of every band, longest first; together they hold all ``lengths``. Lengths up to ``short`` are one band."""
    out: list[tuple[int, int]] = []
    for n in sorted(set(lengths), reverse=True):
        if out and (n > ratio * out[-1][1] or out[-1][1] <= short):
            out[-1] = (n, out[-1][1])
        else:
            out.append((n, n))
    return out


def numbered(gaps: DataFrame, tasks: int) -> DataFrame:
    """(sequence_id, gap) written by ``tasks`` tasks, with part (the task) and nth: the rows of equal gap before a row in its part."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            gap = batch.column(1).to_numpy()
            order = np.argsort(gap, kind="stable")
            values, first, n = np.unique(gap[order], return_index=True, return_counts=True)
            base = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
            nth = np.empty(len(gap), np.int64)
            nth[order] = np.arange(len(gap)) - np.repeat(first, n) + np.repeat(base, n)
            seen.update(zip(values.tolist(), (base + n).tolist(), strict=True))
            yield pa.record_batch([*batch.columns, pa.array([part] * len(gap), pa.int32()), pa.array(nth)], ["sequence_id", "gap", "part", "nth"])

    return materialize(gaps.select("sequence_id", "gap").coalesce(tasks).mapInArrow(run, "sequence_id long, gap long, part int, nth long"), "gaps")


def sweep(slots: DataFrame, lengths: DataFrame) -> DataFrame:
    """Counts (size, gap, last, slots) and (size, pieces) to (size, gap, last, before, shift): a row for every row of either.

    before: the slots that are smaller, or equal and come first; so the place of a row's first slot, and of a length's successor.
    shift: what a piece of this length adds to its rank among the band's pieces to get its place.
    """
    none = F.lit(0).cast("long")
    asked = lengths.select("size", F.lit(-1).cast("long").alias("gap"), F.lit(False).alias("last"), none.alias("slots"), "pieces")
    both = slots.select("size", "gap", "last", "slots", none.alias("pieces")).unionByName(asked).coalesce(1)
    order = Window.orderBy("size", "gap", "last")  # three rows for every size up to the capacity
    less = order.rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("before", F.coalesce(F.sum("slots").over(less), F.lit(0)))
    found = found.withColumn("lead", F.when(F.col("gap") < 0, F.col("before") - F.coalesce(F.sum("pieces").over(less), F.lit(0))))
    return found.withColumn("shift", F.max("lead").over(order)).select("size", "gap", "last", "before", "shift")


def slots_of(spark: SparkSession, swept) -> tuple[DataFrame, DataFrame]:
    """The Arrow table of a ``sweep`` as (gap, inner, end), the places of a gap's first inner and first last slot, and (size, shift)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    asked = pc.less(swept["gap"], 0)
    shifts, offered = swept.filter(asked).select(["size", "shift"]), swept.filter(pc.invert(asked))
    inner, end = (offered.filter(m).select(["gap", "before"]) for m in (pc.invert(offered["last"]), offered["last"]))
    firsts = end.rename_columns(["gap", "end"]).join(inner.rename_columns(["gap", "inner"]), "gap", join_type="left outer")
    schema = pa.schema([("gap", pa.int64()), ("inner", pa.int64()), ("end", pa.int64())])
    return spark.createDataFrame(firsts.select(schema.names).cast(schema), "gap long, inner long, end long"), spark.createDataFrame(shifts, "size long, shift long")


def offers(gaps: DataFrame, shortest: int, longest: int, lengths: DataFrame, tasks: int = 1, capacity: int = 4096) -> tuple[DataFrame, DataFrame]:
    """``numbered`` gaps and the band's (size, pieces) to (slots, shifts): slots (sequence_id, slot, size, place), shifts (size, shift)."""
    open_gaps = gaps.where(F.col("gap") >= shortest)
    cells = open_gaps.groupBy("gap", "part").agg(F.count(F.lit(1)).alias("n")).coalesce(tasks)
    k = F.greatest(F.floor(F.col("gap") / longest), F.lit(1).cast("long"))
    per_gap = cells.groupBy("gap").agg(F.sum("n").alias("n")).coalesce(1).withColumn("k", k).withColumn("rest", F.col("gap") - (F.col("k") - 1) * longest)
    inner = per_gap.where("k > 1").select(F.lit(longest).cast("long").alias("size"), "gap", F.lit(False).alias("last"), (F.col("n") * (F.col("k") - 1)).alias("slots"))
    ends = per_gap.select(F.col("rest").alias("size"), "gap", F.lit(True).alias("last"), F.col("n").alias("slots"))
    swept = sweep(inner.unionByName(ends), lengths).toArrow()  # three rows for every size up to the capacity
    local = slots_of(gaps.sparkSession, swept)
    own = open_gaps.join(F.broadcast(local[0]), "gap").withColumn("k", k)
    if tasks > 1:  # else nth counts all gaps
        earlier = Window.partitionBy("gap").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
        bases = cells.select("gap", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).coalesce(tasks)
        if tasks * capacity <= BROADCAST:
            bases = F.broadcast(bases)
        own = own.join(bases, ["gap", "part"]).withColumn("nth", F.col("nth") + F.col("base"))
    own = own.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    ending = F.col("slot") == F.col("k") - 1
    place = F.when(ending, F.col("end") + F.col("nth")).otherwise(F.col("inner") + F.col("nth") * (F.col("k") - 1) + F.col("slot"))
    size = F.when(ending, F.col("gap") - F.col("slot") * longest).otherwise(F.lit(longest))
    return own.select("sequence_id", "slot", size.cast("long").alias("size"), place.alias("place")), local[1]


def best_fit_packing(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to the table of ``token_pieces``."""
    columns = pieces.columns
    kept = materialize(pieces, "pieces")
    order = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)  # a row per length
    lengths = kept.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    lengths = lengths.select("length", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("shorter"))
    lengths = materialize(lengths, "lengths")
    held = {r["length"]: (r["shorter"], r["shorter"] + r["n"]) for r in lengths.collect()}
    plan = bands(list(held), short=capacity // SHORT)
    keyed = kept.withColumn("key", F.struct("id", "piece", "ids_crc32"))
    ranked = spread_rank(keyed, "length", "key", "within", bounded_groups=True).drop("key")
    ranked = ranked.join(F.broadcast(lengths.select("length", "shorter")), "length").withColumn("rank", F.col("shorter") + F.col("within"))
    band_of = F.lit(0)
    for step, (shortest, _) in enumerate(plan):
        band_of = band_of + (F.col("length") < shortest).cast("int") if step < len(plan) - 1 else band_of
    ranked = materialize(ranked.select(*columns, "rank", band_of.alias("band")), "ranked", by="band")

    least, total = min(held, default=0), max((end for _, end in held.values()), default=0)
    gaps, placed = None, []
    for step, (shortest, longest) in enumerate(plan):
        base, end = held[shortest][0], held[longest][1]
        band = ranked.where(F.col("band") == step)
        tasks = 1 + held[longest][1] // PIECES_A_TASK - base // PIECES_A_TASK
        all_tasks = 1 + (total - base) // PIECES_A_TASK
        if gaps is None:
            asked = band.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("slot", F.lit(None).cast("long"))
        else:
            own = lengths.where(F.col("length").between(shortest, longest)).select(F.col("length").alias("size"), F.col("n").alias("pieces"))
            slots, shifts = offers(gaps, shortest, longest, own, all_tasks, capacity)
            slots = slots.select("sequence_id", "slot", "place")
            if all_tasks * PIECES_A_TASK <= BROADCAST:  # no more sequences than pieces, each with as many slots as the band's pieces fit at most
                slots = small(slots, BROADCAST)
            asked = band.join(F.broadcast(shifts), F.col("length") == F.col("size")).withColumn("place", F.col("rank") - base + F.col("shift"))
            asked = asked.drop("size", "shift").join(slots, "place", "left")
        # Pieces without a sequence are the longest of the band, so their ranks from the top have no holes.
        top, each = F.lit(end - 1) - F.col("rank"), capacity // longest
        new = F.col("sequence_id").isNull()
        found = asked.select(
            *columns, F.lit(step).alias("step"), new.alias("opens"),
            F.when(new, F.lit(step << 44) + F.floor(top / each)).otherwise(F.col("sequence_id")).alias("sequence_id"),
            F.when(new, top % each).otherwise(F.col("slot")).alias("slot"),
        )
        found = materialize(found.coalesce(tasks), "placed")
        placed.append(found)
        if step < len(plan) - 1:
            used = found.select("sequence_id", (-F.col("length")).alias("gap"), "opens")
            if gaps is not None:
                used = used.unionByName(gaps.select("sequence_id", "gap", F.lit(False).alias("opens")))
            used = used.groupBy("sequence_id").agg((F.sum("gap") + F.when(F.max("opens"), capacity).otherwise(0)).alias("gap"))
            gaps = numbered(used.where(F.col("gap") >= least), all_tasks)
    if not placed:
        return kept.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    # One scan over all of them, where a union would plan a scan for each.
    every = pieces.sparkSession.read.schema(placed[0].schema).parquet(*[p._scratch for p in placed])
    own = Window.partitionBy("sequence_id").orderBy("step", "slot").rowsBetween(Window.unboundedPreceding, -1)  # capacity pieces at most
    return every.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(own), F.lit(0)).cast("long").alias("offset"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    from larkspan.llm.common import load

    packed = best_fit_packing(token_pieces(load(spark, sf_dir, "documents")))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
