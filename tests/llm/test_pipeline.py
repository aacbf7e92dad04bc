"""The pipeline: every stage takes effect on what the one before kept."""

from collections import Counter

import corpus_pipeline
from tests.llm import cases


def test_stages(spark, tmp_path):
    cases.frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        kept[name] = Counter(r.doc_id for r in docs.collect())
    assert not {5, 6, 7, 10, 11, 12} & set(kept["quality_rules"])
    assert 3 in kept["exact_dedup"] and not {1, 2} & set(kept["exact_dedup"])
    assert 3 in kept["ngram_join"] and not {4, 9} & set(kept["ngram_join"])
    assert set(kept["mixing"]) <= set(kept["ngram_join"])
    assert kept["tree_bpe"] == kept["mixing"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in whole.collect()) == kept["tree_bpe"]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    cases.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
