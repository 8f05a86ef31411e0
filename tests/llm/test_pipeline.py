"""The pipeline's stages against the operators' own verdicts on whole tables."""

import corpus_pipeline as cp
from claimlens.llm import line_crf, packing, quality_rules
from claimlens.llm.queries import tokenizer_path

from .test_overlap import _survivors

SF = "/root/testdata/sf0.001"


def test_stages_follow_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = cp.apply_quality_rules(spark, docs, SF)
    verdicts = quality_rules.rate(docs, quality_rules.fit(docs, labels)).filter("kept")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert kept.columns == docs.columns and ids(kept) == ids(verdicts)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    long_enough = {r.doc_id for r in docs.collect() if len(r.text.split()) >= 50}
    assert good & long_enough <= set(ids(kept))
    better = cp.apply_quality_classifier(spark, kept, SF)
    scored = line_crf.score(kept, line_crf.fit(kept, labels)).filter("predicted = 1")
    assert better.columns == docs.columns and ids(better) == ids(scored)
    assert good & long_enough <= set(ids(better))
    single = cp.drop_near_duplicates(spark, better, SF)
    assert single.columns == docs.columns and ids(single) == _survivors([(r.doc_id, r.text, "x", 0) for r in better.collect()])  # five words, 0.8
    packed = cp.pack_sequences(spark, single, SF)
    whole = packing.pack(single, tokenizer_path("byte_bpe_50k.json"))
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, whole.collect()))


def test_run_is_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
