import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from panelweave.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = con.sql(ORACLES[name]).df()[list(got.columns)]
    assert len(got) > 0
    assert plain(got) == plain(want)


def plain(frame):
    """Rows as texts; whole numbers that a missing value turned into floats are whole again."""
    whole = lambda x: "" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)
    return sorted([whole(x) for x in row] for row in frame.astype(object).values.tolist())


def test_native_operator_stays_in_the_jvm(spark, sf_dir):
    text = QUERIES["op9_secret_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


ROWS = [
    (0, "the cat and the dog and the bird sing a song of the old days in the woods by the sea " * 3, "en", "a"),
    (1, "the cat and the dog and the bird sing a song of the old days in the woods by the sea " * 3, "en", "b"),
    (2, "token=abcdefghijklmnop the and of the woods and of the sea", "en", "a"),
    (3, "le chat et le chien et l oiseau 4556123412341234 chantent une chanson des jours anciens dans les bois", "fr", None),
    (None, "12345 67890", None, "a"),
    (4, None, "en", "a"),
    (5, "question one two three four five six seven eight nine ten eleven twelve thirteen the", "en", "a"),
    (5, "the quick brown fox and the lazy dog are of the same mind in the end", "en", "a"),
]


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    docs = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, lang string, source string, _stage_row int, _stage_file int")
    left = []
    for at, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, str(tmp_path))
        assert step(spark, docs.limit(0), str(tmp_path)).count() == 0
        if at < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"stage{at}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{at}"))
            left.append(sorted(str(r["doc_id"]) for r in docs.collect()))
    assert left == [["0", "1", "2", "3", "5", "5"], ["0", "2", "3", "5", "5"], ["0", "2", "3", "5"], ["0", "3", "5"]]
    assert {"copy", "shard", "place", "text"} <= set(out.columns) and out.count() > 0


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    kept = out.select("doc_id").distinct().count()
    assert 0.7 * docs.count() < kept <= docs.count()
