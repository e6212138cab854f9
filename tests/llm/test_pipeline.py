"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from conftest import SF
from tidemark.llm import langid, minhash


def test_stages_decide(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == documents.columns
        docs = spark.createDataFrame(after.toPandas().astype(object).where(lambda f: f.notna(), None).values.tolist(), documents.schema)
        kept[name] = docs
    assert kept["language"].count() < documents.count()
    assert kept["language"].where("text is null or text = ''").count() == 0
    near = kept["near_duplicates"]
    assert near.count() < kept["language"].count() and minhash.near_duplicates(near).where("not kept").count() == 0
    assert 0 < kept["decontaminate"].count() <= near.count()
    assert kept["mix"].select("doc_id").distinct().count() <= kept["decontaminate"].count() and kept["mix"].count() > 0


def test_pipeline_runs(spark):
    found = corpus_pipeline.run(spark, SF)
    rows = found.orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows))) and len(rows) > 0
    learned = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(learned.languages) >= 2
