"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. *Classes.* Documents with the same normalised words are one class, known by the digest of its words. Classes that hold rows of one id
   are linked.
2. *Circulant MinHash.* One permutation scrambles a shingle's hash; a second one, circularly shifted by
   k, gives coordinate k: h_k = min over the set of pi(sigma(x) - k). Two permutations make all
   coordinates.
3. *Banding.* BANDS bands of ROWS coordinates. At a similarity of 0.85 no band agrees with
   probability (1 - 0.85^4)^24 = 2e-8.
4. *Stars.* In every bucket one member, the one with most bucket mates overall, is compared with all
   others; no bucket is expanded into its pairs.
5. *The rest, exactly.* Where the members of a bucket do not all end up in one component, pairs that were not
   compared may still be links. These open documents go through a prefix filter: shingles are put in
   one order (rare first, by a fixed-size table of counts), and two sets at the threshold must share a
   shingle within the first few of both, at places that leave enough room (the positional bound).
   Pairs of the same component are left out.
6. *Verification.* Every candidate pair is decided on the full sets of 64-bit shingle hashes.
7. *Components* of classes by alternating star steps over the links; a component's id is the smallest of its documents' ids.

Cases: null and blank texts have no shingles and link with nothing. A text of fewer than five words has one
shingle, its whole sequence. Rows that share an id are one document: their texts' components are joined. Rows with null ids link like any
other, but lend no id: a component without ids has the component_id null, and all its rows are kept, as nothing tells them apart.
An empty table gives an empty result. Texts of any length are compared whole. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions.columns import small
from larkspan.llm.common import bitmap, fits, maybe
from larkspan.llm.components import connected_components
from larkspan.scratch import materialize

BANDS = 24
ROWS = 4
#: Buckets whose pivots may be broadcast.
PIVOTS_BROADCAST = 200_000
#: Slots of the table of shingle counts that orders the prefixes.
SLOTS = 1 << 20


def _signatures(docs: DataFrame, kind: str) -> DataFrame:
    """(id, h, text) to (id, h, n, digest, bands)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from larkspan.llm import shingles as S

        U = np.uint64
        a, b = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
        terms = S.stream(BANDS * (ROWS + 1), 9)
        for batch in batches:
            norms = [S.normalized(x.as_py()) for x in batch.column(2)]
            n = np.zeros(len(norms), np.int64)
            bands = np.zeros((len(norms), BANDS), U)
            for low, high in S.chunks(norms):
                hashes, begins = S.shingle_hashes(norms[low:high])
                full = np.flatnonzero(np.diff(begins) > 0)
                if not len(full):
                    continue
                for i in full:
                    n[low + i] = len(np.unique(hashes[begins[i] : begins[i + 1]]))
                x = S.mix(hashes * a)
                t, s = np.empty_like(x), np.empty_like(x)
                for k in range(BANDS * ROWS):
                    np.subtract(x, U(k), out=t)
                    np.multiply(t, a, out=t)
                    np.right_shift(t, U(32), out=s)
                    np.bitwise_xor(t, s, out=t)
                    np.multiply(t, b, out=t)
                    least = np.minimum.reduceat(t, begins[full])
                    bands[low + full, k // ROWS] += S.mix(least) * terms[k]
                bands[low + full] = S.mix(bands[low + full] ^ terms[BANDS * ROWS :])
            flat = pa.array(bands.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(norms) + 1) * BANDS, pa.int32()), flat)
            digests = pa.array([S.digest(x) for x in norms], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n), digests, lists], ["id", "h", "n", "digest", "bands"])

    return docs.mapInArrow(run, f"id {kind}, h long, n long, digest binary, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(text) to (digest, set): the sorted distinct hashes as little-endian bytes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from larkspan.llm import shingles as S

        for batch in batches:
            norms = [S.normalized(x.as_py()) for x in batch.column(0)]
            out = []
            for low, high in S.chunks(norms):
                hashes, begins = S.shingle_hashes(norms[low:high])
                out += [np.unique(hashes[begins[i] : begins[i + 1]]).tobytes() for i in range(high - low)]
            digests = pa.array([S.digest(x) for x in norms], pa.binary())
            yield pa.record_batch([digests, pa.array(out, pa.binary())], ["digest", "set"])

    return docs.select("text").mapInArrow(run, "digest binary, set binary")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum()) if len(b) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    own = sets.select(F.col("digest").alias("u"), F.col("set").alias("a"))
    other = sets.select(F.col("digest").alias("v"), F.col("set").alias("b"))
    both = pairs.join(own, "u").join(other, "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u binary, v binary")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(digest, set) to (digest, n, shingle, place): the first shingles of a set in the common order.

    A set of n and one of m with a link share at least o = percent (n + m) / (100 + percent)
    shingles. o is percent n / 100 at least, so the first n - o + 1 places suffice.
    """

    def counted(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount((np.frombuffer(x.as_py(), np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        slots = np.flatnonzero(total)
        yield pa.record_batch([pa.array(slots), pa.array(total[slots])], ["slot", "c"])

    counts = sets.select("set").mapInArrow(counted, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c"))
    seen = counts.where("c > 1").toPandas()  # SLOTS rows at most
    import numpy as np

    table = np.zeros(SLOTS, np.int64)
    table[seen["slot"].to_numpy()] = seen["c"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        order = shared.value
        for batch in batches:
            ids, sizes, hashes, places = [], [], [], []
            for i, x in enumerate(batch.column(1)):
                own = np.frombuffer(x.as_py(), np.uint64)
                n = len(own)
                first = n - -(-percent * n // 100) + 1
                seen = order[(own & np.uint64(SLOTS - 1)).astype(np.int64)]
                take = np.lexsort((own, seen))[:first]
                ids.append(np.full(len(take), i))
                sizes.append(np.full(len(take), n))
                hashes.append(own[take].view(np.int64))
                places.append(np.arange(len(take)))
            if ids:
                columns = [np.concatenate(c) for c in (ids, sizes, hashes, places)]
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(columns[0])), *map(pa.array, columns[1:])], ["digest", "n", "shingle", "place"]
                )

    return sets.select("digest", "set").mapInArrow(run, "digest binary, n long, shingle long, place long")


def near_duplicates(
    docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: (id, n_shingles, component_id, kept)."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = classified(docs, percent, id_col, text_col)
    out = found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def classified(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n, component_id) of every row; h is a hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    signed = materialize(_signatures(texts, kind), "signatures")
    classes = signed.where("n > 0").groupBy("digest").agg(
        F.min("id").alias("rep"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    classes = materialize(classes, "classes")
    # Rows of one id with different words.
    ends = signed.where("n > 0 and id is not null").groupBy("id").agg(F.min("digest").alias("u"), F.max("digest").alias("w")).where("u <> w")
    shared = signed.where("n > 0").join(ends.select("id", "u"), "id").select("u", F.col("digest").alias("v")).where("u <> v").distinct()

    members = classes.select("digest", "n", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = materialize(members.join(sizes, "key"), "members")
    mates = members.groupBy("digest").agg(F.sum("m").alias("mates"))
    ranked = members.join(mates, "digest")
    pivots = ranked.groupBy("key").agg(
        F.max(F.struct("mates", (-F.xxhash64("digest")).alias("h"), F.col("digest").alias("pivot"), F.col("n").alias("k"))).alias("p")
    )
    pivots = materialize(pivots.select("key", "p.pivot", "p.k"), "pivots")
    stars = members.join(small(pivots, PIVOTS_BROADCAST), "key").where("digest <> pivot")
    stars = stars.where(F.least("n", "k") * 100 >= F.greatest("n", "k") * percent)
    pairs = materialize(stars.select(F.col("digest").alias("u"), F.col("pivot").alias("v")).distinct(), "pairs")

    wanted = materialize(members.select("digest").distinct().join(classes.select("digest", "h"), "digest"), "wanted")
    near = texts
    if fits(wanted):
        near = near.where(maybe(F.col("h"), bitmap(wanted.select(F.col("h").alias("key")))))
    else:
        near = near.join(wanted.select("h").distinct(), "h", "left_semi")
    sets = _sets(near).join(wanted, "digest", "left_semi").dropDuplicates(["digest"])
    sets = materialize(sets, "sets")

    links = materialize(_links(pairs, sets, percent).unionByName(shared), "links")
    found = materialize(connected_components(links), "components")

    placed = members.select("key", "digest").join(found.withColumnRenamed("node", "digest"), "digest", "left")
    placed = placed.select("key", "digest", F.coalesce("component", "digest").alias("component"))
    parted = placed.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")
    ).where("lo <> hi and m > 2")
    parted = materialize(parted.select("key"), "parted")
    open_docs = placed.join(small(parted, PIVOTS_BROADCAST), "key", "left_semi").select("digest", "component").distinct()
    open_docs = materialize(open_docs, "open")
    firsts = _prefixes(sets.join(open_docs, "digest", "left_semi"), percent).join(open_docs, "digest")
    firsts = materialize(firsts, "prefixes")
    x = firsts.select(F.col("digest").alias("u"), F.col("n").alias("nu"), "shingle", F.col("place").alias("pu"), F.col("component").alias("cu"))
    y = firsts.select(F.col("digest").alias("v"), F.col("n").alias("nv"), "shingle", F.col("place").alias("pv"), F.col("component").alias("cv"))
    overlap = (F.col("nu") + F.col("nv")) * percent
    room = F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) * (100 + percent)
    rest = x.join(y, "shingle").where("u < v and cu <> cv").where(room >= overlap)
    rest = materialize(rest.select("u", "v").distinct().join(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti"), "rest")
    more = materialize(_links(rest, sets, percent), "more")
    if not more.isEmpty():
        found = materialize(connected_components(links.unionByName(more)), "components")
    heads = found.join(classes.select(F.col("digest").alias("node"), "rep"), "node")
    heads = heads.join(heads.groupBy("component").agg(F.min("rep").alias("least")), "component").select(F.col("node").alias("digest"), "least", F.lit(True).alias("linked"))
    own = classes.select("digest", "rep").join(heads, "digest", "left")
    own = own.select("digest", F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    out = signed.drop("bands").join(own, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "h", "n", component.alias("component_id"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the rows that ``near_duplicates`` keeps, and their columns, whatever their names."""
    found = classified(docs, percent, id_col, text_col)
    gone = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", F.col("h").alias("key"))
    gone = materialize(gone.distinct(), "gone")
    rows = docs.select(F.struct("*").alias("doc")).withColumn("h", F.xxhash64(F.col("doc")[text_col]))
    rows = rows.withColumn("suspect", maybe(F.col("h"), bitmap(gone)) if fits(gone) else F.lit(True))  # only they are shuffled
    same = (F.col("h") == F.col("key")) & F.col("doc")[id_col].eqNullSafe(F.col("id"))
    stays = rows.where("suspect").join(gone, same, "left_anti")
    return rows.where("not suspect").unionByName(stays).select("doc.*")


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    from larkspan.llm.common import load

    return near_duplicates(load(spark, sf_dir, "documents"))
