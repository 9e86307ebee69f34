"""The corpus pipeline's stages, each on what its predecessor kept."""

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    last = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == seen[-1]
    assert all(r.round_trip for r in last)
