"""Similarity of turns reads them to their ends."""

from claimlens import catalog


def test_turns_that_differ_late_are_not_equal(spark, tmp_path):
    same = "a" * 1_000_000
    rows = [(1, 0, "user", same), (1, 1, "user", same + " tail")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = catalog.QUERIES["turn_lexical_similarity"](spark, str(tmp_path)).collect()
    assert row.similarity < 1
