"""The pipeline's stages: what they keep, and which columns."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from hourloom.llm import exact_dedup, mixing, ngram_join

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows(spark, documents):
    from hourloom.llm import common

    docs, names = documents, [n for n, _ in P.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixture", "tokens"]
    for name, step in P.STAGES[:-1]:
        out = common.stage(step(spark, docs, SMALL), f"test-{name}")
        assert out.columns == docs.columns
        before, after = (Counter(tuple(r) for r in x.collect()) for x in (docs, out))
        assert set(after) <= set(before)
        if name == "exact_dedup":
            kept = exact_dedup.exact_dedup(docs).where("kept")
            assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out.collect())
        if name == "near_dedup":
            assert {r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {r.doc_id for r in out.collect()}
        if name == "mixture":
            want = Counter()
            for r in mixing.mix(docs).collect():
                want[r.doc_id] += r.copies
            assert +want == Counter(r.doc_id for r in out.collect())
        docs = out
    assert P.run(spark, SMALL).count() == docs.count()


def test_the_mixture_of_repeated_rows_meets_its_budget(spark):
    rows = [(7, "a b c", "en", "x", 5)] * 4 + [(8, "d e f", "en", "x", 5)] * 3 + [(9, "g h", "en", "y", 3), (None, "i j k l", "en", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert +want == Counter(r.doc_id for r in P.mixed(spark, docs, SMALL).collect())


def test_stages_take_odd_rows(spark, odd, nothing):
    for name, step in P.STAGES:
        assert step(spark, nothing, SMALL).count() == 0, name
        out = step(spark, odd, SMALL)
        assert out.count() >= 0 and (name == "tokens" or out.columns == odd.columns), name
