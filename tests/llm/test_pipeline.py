"""The stages one by one against brute force, and the whole chain on the smallest tables."""

import os

import pytest

import corpus_pipeline
from leafworks.llm import mixing, quality, shingles, substring
from leafworks.llm._base import settle, table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")
def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "mixing", "packing"]
    docs = table(spark, DATA, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = settle(stage(spark, docs, DATA), f"test-{k}")
        if k < 4:
            assert docs.columns == table(spark, DATA, "documents").columns
        if name == "quality classifier":
            kept = {r.doc_id for r in quality.classify(before, table(spark, DATA, "labels")).filter("predicted = 1").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        elif name == "SimHash near-dedup":
            found = shingles.similar(before, words=5, similarity=0.8).collect()
            assert sorted(r.doc_id for r in docs.collect()) == sorted({r.component_id for r in found})
        elif name == "substring dedup":
            assert docs.count() == before.count()
            assert substring.without_repeats(docs, texts=False).filter("n_removed > 0").count() <= before.count() // 20
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "mixing":
            want = {s: t for s, t in mixing.mix(before).groupBy("source").sum("taken").collect()}
            got = {s: t for s, t in docs.withColumn("n", mixing.word_count(docs["text"])).groupBy("source").sum("n").collect()}
            assert got == {s: t for s, t in want.items() if t}
        else:
            assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()
