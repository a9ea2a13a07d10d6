import corpus_pipeline
from panelspark.llm import decontaminate, jaccard, language, packing, quality
from panelspark.llm.common import load, scratch


def test_stages_chain(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = load(spark, sf_dir, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = scratch(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns
        rows = docs.collect()
        assert all(before[r.doc_id] == r for r in rows) and len({r.doc_id for r in rows}) == len(rows)
        sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    links = jaccard.link_components(docs).collect()
    assert all(r.doc_id == r.component_id for r in links)
    assert not any(r.contaminated for r in decontaminate.hits(decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))).collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_decisions_are_the_operators(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = load(spark, sf_dir, "documents")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, sf_dir).collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, load(spark, sf_dir, "labels")).collect() if r.keep}
    unique = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()}
    assert unique == {r.component_id for r in jaccard.link_components(docs).collect()}


def test_odd_rows(spark, odd_docs, no_docs):
    sf_dir = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, sf_dir).collect()
        assert stage(spark, no_docs, sf_dir).collect() == []
    assert len(out) >= odd_docs.count()
    unique = corpus_pipeline.near_duplicate_stage(spark, odd_docs, sf_dir).collect()
    ids = [r.doc_id for r in unique]
    assert ids.count(5) == 1 and ids.count(8) == 1 and 9 not in ids and ids.count(None) == 2
    assert language.identify and packing.pack
