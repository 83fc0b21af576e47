"""The pipeline's near-duplicates stage on rows whose ids repeat or are null."""

import corpus_pipeline


def test_rows_count_one_by_one(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (None, b), (None, b), (2, c), (2, a), (5, c), (None, None), (7, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, table, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (None, b), (2, c), (None, None), (7, "")], key=str)
