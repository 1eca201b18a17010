"""The pipeline's stages, each against brute force on what its predecessor kept."""

import re
from collections import defaultdict

import corpus_pipeline
from larkspan.scratch import materialize
from tests.llm.test_operators import WORD, brute_lines, corpus, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 5] + [(5, corpus()[5][1], "s1"), (70, "$$$ %%% " * 30, "s0"), (71, "same words again " * 40, "s0")]
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = materialize(documents(spark), "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = materialize(corpus_pipeline.quality(spark, docs, ""), "a")
    assert kept.columns == COLUMNS
    clean = {r.doc_id: r.text for r in kept.collect()}
    assert not {60, 61, 62, 63, 64, 65, 70, 71} & set(clean) and all(before[i] == t for i, t in clean.items())
    assert {i for i in range(40) if len(before[i].split()) >= 10} <= set(clean)

    lines = materialize(corpus_pipeline.lines(spark, kept, ""), "b")
    gone = {(i, k) for i, k, stays, *_ in brute_lines(list(clean.items())) if not stays}
    want = {}
    for i, t in clean.items():
        left = [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone]
        if any(re.search(WORD, x) for x in left):
            want[i] = "\n".join(left)
    assert lines.columns == COLUMNS and {r.doc_id: r.text for r in lines.collect()} == want

    near = materialize(corpus_pipeline.near(spark, lines, ""), "c")
    sets, linked = {i: shingles(t) for i, t in want.items()}, defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                linked[a].add(b)
    left = {r.doc_id for r in near.collect()}
    for a in sets:
        group, todo = {a}, [a]
        while todo:
            todo += [x for x in linked[todo.pop()] if x not in group and not group.add(x)]
        assert len(group & left) == 1 and min(group) in left

    mixed = materialize(corpus_pipeline.mix(spark, near, ""), "d")
    assert mixed.columns == COLUMNS and {r.doc_id for r in mixed.collect()} <= left
    words = lambda df: sum(len(re.findall(WORD, r.text)) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(near)) <= 128 * 5

    packed = corpus_pipeline.pack(spark, mixed, "").collect()
    ends = defaultdict(int)
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096 and sum(r.piece == 0 for r in packed) == mixed.count()


def test_run_on_empty_documents(spark, tmp_path):
    documents(spark).where("doc_id < 0").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
