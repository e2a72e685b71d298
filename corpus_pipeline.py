"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``docs``. Stages
go by rows, not by ids, so missing or repeated ids do no harm.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.decontaminate import clean_documents
from panelweave.llm.jaccard_join import jaccard_join
from panelweave.llm.language_id import UNKNOWN, held_out, language_id
from panelweave.llm.mix_sources import mix_sources
from panelweave.llm.secret_scan import secret_scan
from panelweave.sources import stage

#: A document goes if its signs are less likely than this multiple of what they are in the labelled texts of
#: its best language: other languages and scripts, letter junk. See ``language_id`` for what is usual.
MOST_STRANGE = 3.0
#: Benchmark items with fewer words are common phrases; a document is not dropped for them.
LEAST_ITEM_WORDS = 4


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not use."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with numbers that any later read of the same files gives again, and the numbers' column.

    A row's number is made of its file's place in the list of files and its place in the file.
    Rows that come from no file are written first.
    """
    if not docs.inputFiles():
        docs = stage(docs, "rows")
    file, number, row = (_free(docs, f"_stage_{c}") for c in ("file", "number", "row"))
    place = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    # One row per input file, which the driver lists anyway. From Arrow Spark knows the list's size and, if it is
    # small, broadcasts it; a list of Python rows counts as endless, and the texts would be shuffled to meet it.
    paths = [r[0] for r in place.select(file).distinct().orderBy(file).collect()]
    files = docs.sparkSession.createDataFrame(
        pa.table({number: pa.array(range(len(paths)), pa.int64()), file: pa.array(paths, pa.string())})
    )
    numbered = place.join(files, file)
    return numbered.withColumn(row, F.shiftleft(number, 36) + F.col(row)).drop(file, number), row


def _without(rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The other rows. The join is the same for a short list and a long one: it never broadcasts."""
    return rows.join(dropped.select(row).hint("merge"), row, "left_anti").drop(row)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; texts without a letter go, and those that are strange to all of them.

    Rows go by themselves: missing or repeated ids, ties and extra columns of any name change nothing.
    """
    row = _free(docs, "_stage_row")
    whole = docs.select(F.struct("*").alias(row), "text")
    learned = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias(row), "text", "lang")
    judged = language_id(whole, learned, doc=row)
    # A text whose letters are no words for the operator is not judged strange.
    fits = F.coalesce(F.col("strangeness") <= MOST_STRANGE, F.lit(True))
    return judged.where((F.col("lang_pred") != UNKNOWN) & fits).select(f"{row}.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the smallest id.

    Of equal ids the first in the files stays, a missing id comes last; documents without words
    are in no group and stay; no documents give none.
    """
    rows, row = _numbered(docs)
    joined = jaccard_join(rows, doc=row).join(rows.select(row, "doc_id"), row)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    stays = joined.groupBy("component_id").agg(F.min(order)[row].alias("stays"))
    others = joined.select(row, "component_id").join(stays, "component_id").where(F.col(row) != F.col("stays"))
    return _without(rows, row, others)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item; without documents or items nothing goes."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=LEAST_ITEM_WORDS)


def no_live_secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a secret that looks live; those with copied examples, mere numbers or no text stay."""
    rows, row = _numbered(docs)
    found = secret_scan(rows, doc=row, repository=row)
    return _without(rows, row, found.where(F.exists("found", lambda r: r["live"] & ~r["number"])))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: sources at their target weights, dealt to shards and shuffled there; no documents, no mix."""
    return mix_sources(docs)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("secret scans", no_live_secret),
    ("mixing sources to target weights", mixed),
]

#: Language identification and spaced seeds have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
