"""The numbers that the pipeline's stages give to rows."""

import corpus_pipeline
from panelweave.sources import stage


def test_numbers_come_without_moving_the_texts(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    # The documents are too large to be broadcast, the list of four files is not.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        numbered, row = corpus_pipeline._numbered(spark.read.parquet(str(tmp_path / "docs")))
        plan = numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted((r.doc_id, r.text) for r in numbered.collect()) == rows
    assert len({r[row] for r in numbered.collect()}) == len(rows)


def test_an_empty_table_has_no_numbers(spark, tmp_path):
    empty = stage(spark.createDataFrame([], "doc_id long, text string"), "empty")
    numbered, row = corpus_pipeline._numbered(empty)
    assert numbered.columns == ["doc_id", "text", row] and numbered.count() == 0
