"""The stages in order on the smallest tables, each against what it promises."""

import corpus_pipeline
from lorekeep.llm.common import written


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = written(docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars").limit(20)))
    odd = spark.createDataFrame([(900001, None, "en", "s", 0), (900002, "123", "en", "s", 3), (None, "lonely words of nobody here", None, None, None)], docs.schema)
    docs = written(docs.unionByName(odd))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, small))
        sizes.append(docs.count())
        if name != "mixing":
            assert docs.columns == before.columns
        if name == "language_id":
            assert not docs.where("doc_id in (900001, 900002)").count() and sizes[-1] == sizes[0] - 2
        if name == "simhash_near_dedup":
            assert not docs.where("doc_id between 100000 and 900000").count()
            assert docs.where("doc_id is null").count() == 1
        if name == "decontamination":
            for item in spark.read.parquet(f"{small}/benchmark.parquet").collect():
                assert not docs.where(docs.text.contains(item.text)).count()
    assert sizes[-1] < sizes[-2] <= sizes[-3] < sizes[-4] <= sizes[1] and {"topic", "probability"} <= set(docs.columns)
