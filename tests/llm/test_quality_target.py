"""op4's target counts every good labelled document."""

from claimlens.llm import quality_rules


def test_target_has_all_good_documents(spark):
    docs = spark.range(20_050).selectExpr("id AS doc_id", "concat('word', id, ' and more') AS text")
    assert not quality_rules.fit(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")).any()  # target and raw counts are the same
