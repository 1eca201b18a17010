"""Every operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larkspan import scratch
from larkspan.llm import (
    bestfit, common, components, exact_dedup, line_dedup, mixing, near_dedup, packing, pii, quality, sharding, token_counts, toxicity,
)

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, row long, kept boolean, size long, `pass` int, key string, line int, n int, words string"
)
WORD = r"[^\x20\x09-\x0D]+"
VOCABULARY = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra") for b in ("da", "fe", "go", "hi", "st", "nt")]


def table(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, 1, "x", 2, True, 3, 4, "k", 5, 6, "w") for i, t, s in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    rng = random.Random(11)
    rows = [(i, "\n".join(prose(rng, rng.randint(6, 20)) for _ in range(rng.randint(1, 5))), f"s{i % 4}") for i in range(40)]
    base = rows[3][1].split(" ")
    for i in range(40, 52):  # near copies, exact copies
        words = list(base)
        if i % 3:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), None if i % 4 == 0 else "s0"))
    rows += [(60, None, "s1"), (61, "", "s1"), (62, " \n\t ", None), (63, "one two", "s2"), (64, "one two", "s2"), (65, "x" * 50_000, "s3"), (66, prose(rng, 9000), "s3")]
    rows += [rows[5], rows[5], (None, "null id here with some words", "s1"), (None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def same(got, want):
    assert Counter(got) == Counter(want)


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_dedup(empty).collect() == []
    assert token_counts.token_counts(empty).collect() == []
    assert packing.best_fit_packing(packing.token_pieces(empty)).collect() == []
    assert sharding.best_fit_shards(empty, shards=3).collect() == []
    assert mixing.mix(empty)[0].collect() == [] and mixing.mix(empty)[1].collect() == [] and mixing.mixed_documents(empty).collect() == []
    assert near_dedup.near_duplicates(empty).collect() == []
    assert quality.quality_rules(empty).collect() == [] and quality.passing(empty).collect() == []
    assert line_dedup.duplicate_lines(empty).collect() == [] and line_dedup.without_duplicate_lines(empty).collect() == []
    assert pii.personal_data(empty).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(empty, toxicity.train(empty, labels)).collect() == []


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, rows, keep, weak):
    """With a digest of two bits, texts collide and are told apart by their bytes."""
    digest = (lambda t: F.unhex(F.lpad(F.hex(F.pmod(F.length(t), F.lit(4))), 2, "0"))) if weak else exact_dedup.sha256
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    best = {t: {"min": min, "max": max}[keep]([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, keep=keep, digest=digest).collect()]
    same(got, [(i, best[t or ""], len(groups[t or ""]), i == best[t or ""]) for i, t, _ in rows])


def test_exact_dedup_where_hits_outgrow_the_bitmap(docs, monkeypatch):
    want = sorted(map(repr, exact_dedup.exact_dedup(docs).collect()))
    monkeypatch.setattr(common, "FILTER_KEYS", 0)
    assert sorted(map(repr, exact_dedup.exact_dedup(docs).collect())) == want


def test_levels_of_the_digest_index(spark):
    index, held = exact_dedup.DigestIndex(fanout=2), defaultdict(list)
    for batch in range(7):
        rows = [(10 * batch + k, f"text {(batch * k) % 9}", "s") for k in range(6)]
        for i, t, _ in rows:
            held[hashlib.sha256(t.encode()).digest()].append(i)
        index.add(table(spark, rows))
    assert [len(level) for level in index.levels] == [1, 1, 1]  # 7 = 1 + 2 + 4 adds
    want = {d: (min(ids), len(ids)) for d, ids in held.items()}
    asked = [*held, b"0" * 32]
    found = index.lookup(asked)
    assert "PushedFilters: [In(digest" in found._jdf.queryExecution().toString() or "Or(" in found._jdf.queryExecution().toString()
    assert {bytes(r.digest): (r.keep_id, r.n) for r in found.collect()} == want
    assert {bytes(r.digest): (r.keep_id, r.n) for r in index.merged().collect()} == want
    assert len(index.members()) == 1 and {bytes(r.digest): (r.keep_id, r.n) for r in index.lookup(asked).collect()} == want


def test_runs_hold_bloom_filters(spark, docs):
    runs = exact_dedup.flush(docs, "doc_id", "text")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in runs.inputFiles():
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        for block in reader.getFooter().getBlocks():
            columns = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in block.getColumns()}
            assert columns["digest"] > 0 and columns["id"] < 0
        reader.close()


def test_token_counts_match_the_library(docs, rows):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect()]
    want = []
    for i, t, _ in rows:
        n = len(model.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    same(got, want)


def test_merge_counter_on_odd_texts():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.MergeCounter.from_model(path)
    rng = random.Random(2)
    odd = ["<s> a </s>", "<0x41>", "a  b   ", "\n\n x", "日本 😀é", " " * 300, "▁▁x", "\t\r\n"] + ["".join(rng.choice("abe \n\t▁éß日😀<>s/0x1.") for _ in range(40)) for _ in range(500)]
    assert [own.count(t) for t in odd] == [len(x) for x in model.encode(odd)]


def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.best_fit_packing(packing.token_pieces(docs, with_ids=True)).collect()
    texts = Counter()
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 4096 * r.piece
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        texts.update((i, k // 4096, struct.pack(f"<{len(ids[k : k + 4096])}I", *ids[k : k + 4096])) for k in range(0, len(ids), 4096))
    assert texts == Counter((r.id, r.piece, bytes(r.ids)) for r in got)
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096


def test_units_of_words_are_looked_up_once():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    own, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    own.packed(pa.array(["Foo, foo. FOO! (foo)\nfoo42", "", "  foo"]), 1)
    assert sorted(own.known.to_pylist()) == sorted(["foo", ",", ".", "!", "(", ")", "4", "2"])
    signs = [*"abeEZ09 \n\t\r\x0b\x0c.,'\"!<|>&#\x00\x1c\x7f\x85\xa0ÉÿßÀ×÷éµªİΣςſ½²日😀\u0301\u2003", "'s", "'re", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids, ends = own.packed(pa.array(["left out", *texts]).slice(1), 1)
    cut = [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]
    assert cut == [e.ids + [1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_superstep_writes_no_sweep_and_a_full_driver_is_tidied(spark, monkeypatch):
    gaps = packing.numbered(spark.createDataFrame([(0, 9), (1, 9), (2, 4)], "sequence_id long, gap long"), 1)
    made = len(scratch._made)
    slots, shifts = packing.offers(gaps, 3, 4, spark.createDataFrame([(3, 1), (4, 2)], "size long, pieces long"))
    assert len(scratch._made) == made and sorted(slots.select("size", "place").collect()) == [(4, 0), (4, 1), (4, 2), (5, 3), (5, 4)]
    assert dict(shifts.collect()) == {3: 0, 4: 0}
    monkeypatch.setattr(scratch, "FULL", 0)
    assert scratch.tidy(spark)
    monkeypatch.setattr(scratch, "FULL", 1)
    assert not scratch.tidy(spark)


def test_sweep_gives_each_piece_the_next_free_slot(spark):
    rng = random.Random(8)
    for _ in range(6):
        sizes, lengths = sorted(rng.randint(3, 12) for _ in range(rng.randint(1, 30))), sorted(rng.randint(3, 12) for _ in range(rng.randint(1, 30)))
        want, free = [], 0
        for n in lengths:  # the first slot that holds the piece and comes after all that are taken
            free = next((i for i in range(free, len(sizes)) if sizes[i] >= n), len(sizes) + free)
            want.append(free if free < len(sizes) else None)
            free += 1
        one = spark.createDataFrame([(s, 20, True, n) for s, n in Counter(sizes).items()], "size long, gap long, last boolean, slots long")
        two = spark.createDataFrame(list(Counter(lengths).items()), "size long, pieces long")
        rows = packing.sweep(one, two).collect()
        found = {r["size"]: r for r in rows if r.gap < 0}
        got = [j + found[n].shift for j, n in enumerate(lengths)]
        assert [p if p < len(sizes) else None for p in got] == want
        assert all(r.before == sum(x < r["size"] for x in sizes) for r in rows)


@pytest.mark.parametrize("capacity", [7, 4096])
def test_supersteps_pack_nearly_as_best_fit_does(spark, capacity):
    rng = random.Random(capacity)
    lengths = [min(capacity, 1 + int(rng.expovariate(8 / capacity))) for _ in range(3000)] + [capacity] * 5 + [capacity // 3] * 1000
    pieces = spark.createDataFrame([(i % 50, i, n, i) for i, n in enumerate(lengths)], "id long, piece int, length long, ids_crc32 long")
    got = packing.best_fit_packing(pieces, capacity).collect()
    assert sorted(r.length for r in got) == sorted(lengths)
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= capacity and len(ends) <= 1.02 * len(brute_best_fit(lengths, capacity)) + 2


def test_bands_and_slots(spark):
    assert packing.bands([100, 71, 70, 50, 49, 1]) == [(71, 100), (50, 70), (49, 49), (1, 1)]
    assert packing.bands([100, 71, 70, 50, 49, 1], short=50) == [(71, 100), (50, 70), (1, 49)]
    assert len(packing.bands(list(range(1, 4097)), short=64)) == 13
    rng = random.Random(6)
    rooms = [(i, rng.randint(1, 40)) for i in range(300)]
    gaps = packing.numbered(spark.createDataFrame(rooms, "sequence_id long, gap long").repartition(3), 3)
    assert gaps.select("part").distinct().count() == 3
    for shortest, longest in ((10, 12), (3, 4), (41, 50)):
        slots, _ = packing.offers(gaps, shortest, longest, spark.createDataFrame([(longest, 1)], "size long, pieces long"), 3)
        got = slots.orderBy("place").collect()
        want = Counter()
        for i, g in rooms:
            if g >= shortest:
                k = max(1, g // longest)
                want.update([(i, longest)] * (k - 1) + [(i, g - (k - 1) * longest)])
        assert Counter((r.sequence_id, r["size"]) for r in got) == want
        assert [r.place for r in got] == list(range(len(got))) and [r["size"] for r in got] == sorted(r["size"] for r in got)


def brute_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
    return rooms


def test_best_fit_equals_item_by_item():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(5, 60)
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 15))}
        plan, n = bestfit.best_fit_decreasing(counts, capacity)
        rooms = brute_best_fit([s for s, k in counts.items() for _ in range(k)], capacity)
        load = [0] * n
        for k in sorted(range(len(plan)), key=lambda k: (-plan[k][0], k)):
            size, rank, first, each, used = plan[k]
            stop = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == size else counts[size]
            for i in range(stop - rank):
                assert load[first + i // each] == used + i % each * size
                load[first + i // each] += size
        assert sorted(capacity - x for x in load) == sorted(rooms)
    assert bestfit.best_fit_decreasing({}, 5) == ([], 0)
    with pytest.raises(ValueError):
        bestfit.best_fit_decreasing({9: 1}, 5)


def test_shards(docs, rows):
    got = sharding.best_fit_shards(docs.where("doc_id < 60"), shards=3).collect()
    by_shard, of = defaultdict(list), defaultdict(set)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        by_shard[r.shard].append((r.slot, r.size))
        of[texts[r.doc_id]].add(r.shard)
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.crc == zlib.crc32(texts[r.doc_id].encode())
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in by_shard.values()) and max(map(len, of.values())) == 1
    sizes = [sum(b for _, b in x) for x in by_shard.values()]
    assert len(sizes) == 3 and max(sizes) <= 1.05 * min(sizes)


def test_shards_of_fixed_capacity_split_only_what_cannot_stay_whole(spark):
    df = table(spark, [(i, "z" * 92, "s") for i in range(50)] + [(100 + i, str(i) * 92, "s") for i in range(5)])
    got = sharding.best_fit_shards(df, capacity=1000).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 1000 and len(sizes) == 6 and len(got) == 55
    with pytest.raises(ValueError):
        sharding.best_fit_shards(df, capacity=50)


def brute_targets(size, share=1.5):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, capped = share * sum(size.values()), set()
    while True:
        free = sum(weights[s] for s in size if s not in capped)
        level = (total - sum(2 * size[s] for s in capped)) / free if free else 0
        more = {s for s in size if s not in capped and weights[s] * level >= 2 * size[s]}
        if not more:
            return {s: 2 * size[s] if s in capped else weights[s] * level for s in size}
        capped |= more


def test_mixing_meets_targets(docs, rows):
    n, drawn = mixing.mix(docs, block=8)
    size = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        size[s] += len(re.findall(WORD, t or ""))
    target = brute_targets(size)
    taken = {r.row: r.t for r in drawn.groupBy("row").agg(F.sum("n").alias("t")).collect()}
    by_source = Counter()
    for r in n.collect():
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert taken.get(r.row, 0) <= 2 * r.size
        by_source[r.source] += taken.get(r.row, 0)
    assert all(abs(by_source[s] - target[s]) <= 8.5 for s in target)
    again = {r.row: r.t for r in mixing.mix(docs, block=8)[1].groupBy("row").agg(F.sum("n").alias("t")).collect()}
    assert Counter(again.values()) == Counter(taken.values())


def test_mixing_meets_targets_to_the_word(spark):
    # Sources whose last block is short; some partial passes draw it, some last.
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 9)), f"s{i % 60:02d}") for i in range(600)]
    got, drawn = mixing.mix(table(spark, rows), block=16)
    want = {r.source_id: (r.target, r.source_size) for r in got.select("source_id", "target", "source_size").distinct().collect()}
    taken = {r.source_id: r.n for r in drawn.join(got.select("row", "source_id"), "row").groupBy("source_id").agg(F.sum("n").alias("n")).collect()}
    assert any(t % n for t, n in want.values())
    assert taken == {k: int(t + 0.5) for k, (t, n) in want.items()}
    assert drawn.groupBy("row", "pass", "from").count().where("count > 1").isEmpty()


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 100, 1023):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(n * 31).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mixed_documents_hold_what_was_drawn(docs):
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    words = sum(len(re.findall(WORD, r.text)) for r in out.collect())
    total = docs.select(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0]
    assert abs(words - 1.5 * total) <= 50


def shingles(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    rng = random.Random(7)
    data = [(i, t) for i, t, _ in corpus()[:52]] + [(60, None), (61, "a b c"), (62, "A b  C"), (63, "")]
    base = prose(rng, 120).split(" ")
    for i in range(100, 170):  # a family with up to four changes each, many of them not linked with the base
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"w{rng.randrange(3)}"
        data.append((i, " ".join(words)))
    sets = {i: shingles(t) for i, t in data}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(table(spark, [(i, t, "s") for i, t in data]), percent).collect()
    same([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], [(i, len(sets[i]), find(i), find(i) == i) for i in sets])


def test_links_pass_through_rows_without_ids_and_repeated_ids(spark):
    words = prose(random.Random(12), 200).split(" ")
    cut = lambda a, b: " ".join(words[a:b])
    # Similarities: 1 and the null one 0.9, the null one and 2 0.9, 1 and 2 0.81.
    data = [(1, cut(0, 100)), (None, cut(5, 105)), (2, cut(10, 110)), (3, "quite alone with these words here"), (None, "x y z"), (None, "X  y z"), (None, None)]
    data += [(7, cut(120, 160)), (7, "another text of the same document"), (8, "another text of the  same document"), (9, cut(120, 160)), (9, cut(120, 160))]
    docs = table(spark, [(i, t, "s") for i, t in data])
    got = near_dedup.near_duplicates(docs).collect()
    same([(r.doc_id, r.component_id, r.kept) for r in got], [
        (1, 1, True), (None, 1, False), (2, 1, False), (3, 3, True), (None, None, True), (None, None, True), (None, None, True),
        (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False), (9, 7, False),
    ])
    kept = near_dedup.without_near_duplicates(docs, 85)
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [(i, t) for i, t in data if i in (1, 3, 7) or (i is None and t != cut(5, 105))])


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200 + k, 201 + k) for k in range(30)]
    low = {x: x for e in edges for x in e}
    for _ in range(len(low)):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: low[x] for x in linked}


def test_host_verdict_is_strict_only_where_the_host_is_bad(spark):
    good = "plain words that say something in an ordinary way over a dozen words"
    odd = good + " $ $ ab"  # fails a soft rule
    data = [(i, good if i % 10 else odd, "fine") for i in range(60)] + [(100 + i, odd if i % 10 else good, "bad") for i in range(60)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(table(spark, data)).collect()}
    assert all(kept == (i < 100 or t == good) for i, t, s in data for kept in [got[i]])
    assert sorted(r.doc_id for r in quality.passing(table(spark, data)).collect()) == sorted(i for i, k in got.items() if k)


def test_quality_counts(docs, rows):
    want = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(WORD, t)
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        want.append((i, len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    got = [(r.doc_id, r.q.n_words, r.q.word_chars, r.q.n_dup_lines, r.q.n_repeat_words, r.q.base_failed) for r in quality.quality_rules(docs).collect()]
    same(got, want)
    assert quality.passing(docs).columns == docs.columns


def brute_lines(rows):
    lines = [(i, k, re.findall(WORD, x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if re.search(WORD, x)]
    first = {}
    for i, k, w in sorted(lines, key=lambda x: (x[0], x[1])):
        first.setdefault(tuple(w), (i, k))

    def close(a, b):
        if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < 5 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:p] + long[p + 1 :] == short for p in range(len(long)))

    head = {w: w for w in first}

    def find(w):
        while head[w] != w:
            w = head[w]
        return w

    for v in first:
        for w in first:
            if first[v] < first[w] and close(v, w):
                x, y = sorted((find(v), find(w)), key=first.get)
                head[y] = x
    out = []
    for i, k, w in lines:
        p, q = first[tuple(w)], first[find(tuple(w))]
        out.append((i, k, *((True, i, k, None) if (i, k) == q else (False, *q, 1 if (i, k) == p else 0))))
    return out


def line_rows():
    rng = random.Random(5)
    lines = [prose(rng, n) for n in (1, 1, 2, 3, 4, 5, 5, 6, 8, 9, 14, 20)]
    out = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(lines).split(" ")
            edit, p = rng.randrange(5), rng.randrange(len(w))
            if edit == 1:
                w[p] = rng.choice(["x", "y"])
            elif edit == 2:
                w.insert(p, rng.choice(["x", w[p]]))
            elif edit == 3 and len(w) > 1:
                del w[p]
            text.append("  ".join(w) if edit == 4 else " ".join(w))
        out.append((i, "\n".join(text)))
    return out + [(50, None), (51, ""), (52, "\n \n"), (53, prose(rng, 3000)), (54, "page 1 of the great long report"), *((60 + k, f"page {k + 2} of the great long report") for k in range(20))]


@pytest.mark.parametrize("keys", [None, 0])
def test_line_dedup(spark, monkeypatch, keys):
    """With 0 keys to a bitmap, semi-joins take its place."""
    if keys is not None:
        monkeypatch.setattr(common, "FILTER_KEYS", keys)
    data = line_rows()
    got = line_dedup.duplicate_lines(table(spark, [(i, t, "s") for i, t in data])).collect()
    want = brute_lines(data)
    same([(r.doc_id, r.line, r.kept, r.keep_id, r.keep_line, r.distance) for r in got], want)
    gone = {(i, k) for i, k, kept, *_ in want if not kept}
    texts = {}
    for i, t in data:
        lines = (t or "").split("\n")
        worded = [k for k, x in enumerate(lines) if re.search(WORD, x)]
        if not worded or any((i, k) not in gone for k in worded):
            texts[i] = "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone)
    out = line_dedup.without_duplicate_lines(table(spark, [(i, t, "s") for i, t in data]))
    assert out.columns == SCHEMA_COLUMNS and {r.doc_id: r.text or "" for r in out.collect()} == texts


SCHEMA_COLUMNS = [x.strip().split(" ")[0].strip("`") for x in SCHEMA.split(", ")]


def test_what_a_line_is_dropped_for_is_kept(spark):
    chain = ["a b c d e f", "a b c d e x", "a b c d y x", "a b c z y x", "quite another line of words", "a b c z y x"]
    data = [(i, t, "s") for i, t in enumerate(chain)] + [(10, "quite another line of words\nquite another line of wards", "s")]
    got = {(r.doc_id, r.line): r for r in line_dedup.duplicate_lines(table(spark, data)).collect()}
    assert {k for k, r in got.items() if r.kept} == {(0, 0), (4, 0)}
    assert all(got[r.keep_id, r.keep_line].kept for r in got.values())
    assert got[5, 0].distance == 0 and got[3, 0].distance == 1 and got[10, 1].keep_id == 4


def test_line_dedup_takes_repeated_rows_and_null_ids(docs):
    out = line_dedup.duplicate_lines(docs)
    assert out.count() == docs.select(F.explode(F.split("text", "\n")).alias("x")).where(F.regexp_count("x", F.lit(WORD)) > 0).count()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def test_personal_data_base(spark):
    rng = random.Random(3)
    data = [(i, "".join(rng.choice("a1.9@-+ (2)_%é😀\n0") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    data += [(500, None), (501, ""), (502, "a" * 20_000 + "@"), (503, "1 " * 5_000), (504, "a@b.c " * 300), (505, "+1 (555) 555-1234 4111 1111 1111 1111 10.0.0.255 10.0.0.256"), (506, "a@b.c@d.e_f@g.h")]
    for r in pii.personal_data(table(spark, [(i, t, "s") for i, t in data])).collect():
        text = dict(data)[r.doc_id] or ""
        want = []
        for k, (kind, p) in enumerate(PATTERNS.items()):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m[0])
                good = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
                want += [(m.start(), k, kind, m.end())] * good
        assert [(x.start, x.kind, x.end) for x in r.base] == [(a, k, b) for a, _, k, b in sorted(want)]


def test_contexts_find_unseen_identifiers(spark):
    data = [(i, f"please call me at +1 555 123 45{i:02d} soon", "s") for i in range(10)] + [(20, "please call me at ext-77x soon", "s"), (21, "there are 12 apples in the box", "s")]
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.all if x.kind == "context"] for r in pii.personal_data(table(spark, data)).collect()}
    assert got[20] == [("context", 18, 25)] and not got[21] and not got[0]


def test_contexts_reach_over_earlier_identifiers(spark):
    rng = random.Random(9)
    parts = ["a", "be,", "(jd42x)", "a@b.c", "a@b.c@d.e", "x1.2.3.4y", "4111 1111 1111 1111", "+1 555 555 1234,", "z9", "w" * 90]
    data = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n  "]) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    data = [(i, rng.choice(["", " "]) + t) for i, t in data]
    rows, spans = pii._spans(table(spark, [(i, t, "s") for i, t in data]), "doc_id", "text")
    got = spans.join(rows, "row").select("id", "kind", "start", pii._context(F.col("two")).alias("pattern")).collect()
    assert len(got) > 500

    def word(w):
        return "\t" if re.search(r"[0-9]", w) or re.search(PATTERNS["email"], w) else w.strip(".,;!?()").lower()

    for r in got:
        before = re.split(r"[\x20\x09-\x0D]+", dict(data)[r.id][: r.start])[:-1]
        two = [word(w) for w in before if w][-2:]
        assert r.pattern == (" ".join(two) if len(two) == 2 else None), r


def contexts(spark, data):
    return {dict(data)[r.doc_id][x.start : x.end] for r in pii.personal_data(table(spark, [(i, t, "s") for i, t in data])).collect() for x in r.all if x.kind == "context"}


def test_contexts_find_second_fields(spark):
    data = [(i, f"user name@b.org pin +1 555 123 45{i:02d}") for i in range(10)] + [(20, "user jd42x pin 99x1")]
    assert contexts(spark, data) == {"99x1"}


def test_contexts_go_on_until_nothing_is_accepted(spark):
    texts = [f"mail to a{i}@b.org" for i in range(10)] + [f"mail to v0q{j}" for j in range(3)]
    # Three values known from the step before teach five contexts of the next three.
    texts += [f"step{'abcdef'[k]} via{p} v{k + new}q{j}" for k in range(6) for p in "abcde" for new in (0, 1) for j in range(3)]
    assert contexts(spark, list(enumerate(texts))) == {f"v{k}q{j}" for k in range(7) for j in range(3)}


def test_repeated_shapes_of_high_entropy_are_seeds(spark):
    rng = random.Random(21)
    tokens = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(5)]
    data = [(i, f'some words then token = "{t}" and more') for i, t in enumerate(tokens)]
    data += [(10, "set token = pa55 here"), (11, "x " + "a1" * 20 + " y"), (12, "the only one of its kind: q8w7e6r5t4y3u2i1o0p9a"), (13, "chapter 12 of internationalisation2")]
    out = {r.doc_id: [(x.kind, x.start, x.end) for x in r.all] for r in pii.personal_data(table(spark, [(i, t, "s") for i, t in data])).collect()}
    assert all(out[i] == [("secret", 25, 65)] for i in range(5))
    assert out[10] == [("context", 12, 16)] and not out[11] and not out[12] and not out[13]


def brute_segments(scores):
    """Maximal scoring segments by their recursive definition."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i = -best[2]
    j = i - best[1]
    return [*brute_segments(scores[:i]), (round(best[0], 6), j - i), *brute_segments(scores[j:])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(4)
    scanner = toxicity.Scanner({"bad": (1.0, 1.0), "worse": (1.0, 2.5)})
    for _ in range(150):
        tokens = [rng.choice(["bad", "worse", *["fine"] * 25]) for _ in range(rng.randint(0, 40))]
        got = [(round(s, 6), e - f) for s, f, e in scanner.segments(" ".join(tokens))[1]]
        want = brute_segments([{"bad": 1.0, "worse": 2.5}.get(t, -toxicity.DRIFT) for t in tokens])
        assert got == want


def test_negative_scores_part_segments():
    scanner = toxicity.Scanner({"bad": (1.0, 1.0), "kind": (-2.0, -2.0), "ki*": (0.5, 0.5)})
    assert [x[1:] for x in scanner.segments("bad fine bad kind bad")[1]] == [(0, 3), (4, 5)]
    assert [x[1:] for x in scanner.segments("bad fine bad kit bad")[1]] == [(0, 5)]


def test_log_odds_of_every_feature(spark):
    texts = [(f"foul word{i}", 1) for i in range(20)] + [(f"mild word{i}", 0) for i in range(20, 120)] + [("mild word500", 1), ("mild word500", 0)]
    rows = spark.createDataFrame([(t, y, 0) for t, y in texts], "text string, toxic int, fold int")
    none, got, *_ = toxicity.lexicons(rows)
    assert none == {}  # without the one fold that has rows
    share, odds = 21 / 121, math.log((21 / 121) / (100 / 121))

    def want(y1, y0):
        a, b = y1 + share, y0 + 1 - share
        ratio, error = math.log(a / b) - odds, 2 * math.sqrt(1 / a + 1 / b)
        return pytest.approx((math.copysign(abs(ratio) - error, ratio), ratio))

    assert got["foul"] == want(20, 0) and got["foul"][0] > 1
    assert got["mild"] == want(1, 100) and got["mild"][0] < 0
    assert "word7" not in got and "word*" not in got


def test_gumbel_by_maximum_likelihood():
    import numpy as np

    rng = np.random.default_rng(3)
    n = rng.integers(20, 2000, 20_000)
    x = 0.4 + (np.log(n) - np.log(-np.log(rng.random(len(n))))) / 1.7 - 4
    rate, shift = toxicity.gumbel(n, np.maximum(x, 0))
    assert (x < 0).mean() > 0.2 and rate == pytest.approx(1.7, rel=0.03) and shift == pytest.approx(-3.6, abs=0.1)
    assert toxicity.gumbel([], [])[0] == 1.0
    model = toxicity.Model({"bad": (9.0, 9.0)}, 1.0, 0.0)
    score, passages = model.judge("bad " + "fine " * 9)
    assert passages == [(0, 1, pytest.approx(9 - math.log(10)))] and toxicity.LEVEL < 1 and model.judge("fine bad " + "fine " * 600)[1] == []


def test_conflicting_labels_and_repeated_rows(spark):
    rows = [(i, f"vile{'abcde'[i % 5]}x talk" if i % 2 else "plain talk", "s") for i in range(60)] + [(1, "plain talk", "s")] * 3
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 0) for i in range(0, 60, 3)], "doc_id long, toxic int")
    one, two = (toxicity.train(table(spark, x), labels) for x in (rows, rows[::-1]))
    assert one.scanner.lexicon == two.scanner.lexicon and one.curve == pytest.approx(two.curve)


def test_toxicity_finds_held_out_rows(spark):
    rng = random.Random(9)
    data = []
    for i in range(1200):
        words = prose(rng, 60).split(" ")
        for _ in range(3 if i % 6 == 0 else 0):
            words[rng.randrange(60)] = rng.choice(["vilefe", "vileda", "vilego", "horrid"])
        data.append((i, " ".join(words), "s"))
    df = table(spark, data + [(5000, None, None), (5001, "", "s")])
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(1200)] + [(9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, toxicity.train(df, labels)).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i].score >= 0.5) == (i % 6 == 0) for i in held)
    assert right >= 0.97 * len(held) and 0 <= got[5000].score < 0.5 and got[5001].passages == []


def test_digest_column(docs, rows):
    got = {(r.doc_id, bytes(r.digest).hex()) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}
