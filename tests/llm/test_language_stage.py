import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelweave.llm import language_id as module
from panelweave.llm.language_id import language_id

FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki",
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心。",
    "asdkjh qwlekj zxmcnb qpwoei rtyfgh vbnmzx lkjhgf pqowie",
    "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler",
]
CLEAN = ["the cat and the dog", "of the", "der die und", "les enfants sont dans la maison", "que de la", "The", "und die in"]


def test_foreign_texts_and_junk_go_and_short_clean_ones_stay(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL")
    texts = [(-1 - i, text, None, "s", 1) for i, text in enumerate(FOREIGN + [t + " " + t for t in FOREIGN] + CLEAN)]
    docs = known.unionByName(spark.createDataFrame(texts, known.schema))
    kept = corpus_pipeline.known_language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    left = {r.text for r in kept.where("doc_id < 0").collect()}
    assert left == set(CLEAN)
    # All that is labelled and has a letter stays, as long as it is not letter junk itself.
    assert kept.where("doc_id >= 0").count() >= 0.995 * known.where("text RLIKE '\\\\p{L}'").count()


def test_strangeness_does_not_grow_with_length(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    line = "the woods by the sea and the old days of the song"
    asked = spark.createDataFrame([(i, " ".join([line] * n)) for i, n in enumerate((1, 10, 1000))] + [(9, "12 34"), (10, None)], "doc_id long, text string")
    found = {r.doc_id: r.strangeness for r in language_id(asked, docs).collect()}
    assert found[9] is found[10] is None
    assert max(found[i] for i in (0, 1, 2)) - min(found[i] for i in (0, 1, 2)) < 1e-6 and 0.5 < found[0] < 3


@pytest.fixture
def own_bound(spark):
    """Batches as a session has them that sets no bound."""
    before = spark.conf.get(module.ROWS_SETTING, None)
    spark.conf.unset(module.ROWS_SETTING)
    yield
    spark.conf.unset(module.ROWS_SETTING)
    if before is not None:
        spark.conf.set(module.ROWS_SETTING, before)


def test_texts_reach_python_in_batches_of_bounded_bytes(spark, monkeypatch, own_bound):
    def sized(model):
        def sizes(batches):
            for batch in batches:
                n = pc.sum(pc.binary_length(batch["_text"])).as_py()
                last = pa.array([float(n)] * batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch["_doc"], pa.array(["x"] * batch.num_rows), last, last], ["_doc", "lang_pred", "score", "strangeness"])

        return sizes

    monkeypatch.setattr(module, "_predict", sized)
    few = spark.createDataFrame([(1, "the cat and the dog", "en")], "doc_id long, text string, lang string")
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    found = language_id(docs, few).collect()
    assert len(found) == 3000
    assert max(r.score for r in found) <= module.ROWS_BATCH + 5000


def test_a_bound_of_the_session_stays(spark, own_bound):
    spark.conf.set(module.ROWS_SETTING, "123456")
    module._bound_batches(spark)
    assert spark.conf.get(module.ROWS_SETTING) == "123456"
