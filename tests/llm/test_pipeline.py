"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline


def test_stages(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.cut(stage(spark, d, sf_dir))
        assert d.columns == columns, name
        assert 0.5 * n < d.count() <= n
    assert d.select("doc_id").distinct().count() == d.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, d, sf_dir)
    assert packed.select("doc_id").distinct().count() == d.count()
