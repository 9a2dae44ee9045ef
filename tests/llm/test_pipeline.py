import corpus_pipeline
from jobmargin.llm import queries
from tests.llm.conftest import rows_of
from tests.oracle_check import connect, differences


def test_stages_return_the_columns_of_documents(spark, documents, sf_dir):
    before = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == documents.columns, name
        assert set(rows_of(after.select("doc_id").distinct())) <= set(rows_of(before.select("doc_id").distinct())), name
        before = spark.createDataFrame(after.collect(), after.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.count() == before.count()
    assert rows_of(corpus_pipeline.run(spark, sf_dir), "doc_id", "shard") == rows_of(last, "doc_id", "shard")


def test_stages_on_edge_rows(spark, edge_docs, no_docs, sf_dir):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_sql(spark, sf_dir):
    for name in queries.ORACLES:
        assert differences(spark, connect(sf_dir), sf_dir, name) == []


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
