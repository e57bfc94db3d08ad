import corpus_pipeline
from oddsloom.llm.tables import read, written


def test_stages_work_on_what_the_last_one_kept(spark):
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    labels = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect()}
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), f"test-{name}")
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(kept) <= ids
        if name != "bpe":
            assert docs.columns == columns
        if name == "quality":
            assert not [d for d in ids - set(kept) if labels.get(d) == 1]
        if name in ("exact_dedup", "near_dedup"):
            assert len(kept) == len(set(kept))
        ids = set(kept)
    assert docs.filter("n_tokens <> size(ids)").isEmpty() and ids
