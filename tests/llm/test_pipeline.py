import corpus_pipeline
from tests.llm.conftest import prose, wide
from tidemark.shared import keep

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    sizes = [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "pieces"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.collect()}
        columns = docs.columns
        docs = keep(stage(spark, docs, DATA), name)
        after = {r.doc_id for r in docs.collect()}
        sizes.append(docs.count())
        assert after <= before
        if name != "pieces":
            assert docs.columns == columns
        if name in ("secrets", "pieces"):
            assert after == before
        if name in ("toxicity", "mixing"):
            good = {i for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0}
            assert len(good & after) >= 0.95 * len(good)
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) > 2
    assert set(docs.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = keep(stage(spark, docs, DATA), name)
            assert docs.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
    assert empty.count() == 0 and prose(1, 1) and wide
