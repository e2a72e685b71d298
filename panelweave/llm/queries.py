"""One query per operator over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import sql
from panelweave.llm.decontaminate import decontaminate
from panelweave.llm.jaccard_join import jaccard_join
from panelweave.llm.language_id import held_out, language_id
from panelweave.llm.mix_sources import mix_dealt
from panelweave.llm.phrase_graph import collocations
from panelweave.llm.piece_codec import encode_pieces
from panelweave.llm.pii import BASE, of_kind, pii_scan
from panelweave.llm.prefix_trie import conversation_marks, prefix_trie, with_shared_heads
from panelweave.llm.rlz_dedup import rlz_dedup
from panelweave.llm.secret_scan import secret_scan, span_text
from panelweave.llm.suffix_dedup import suffix_dedup
from panelweave.llm.topk_search import topk_search
from panelweave.llm.url_filter import url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rlz_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", done["n"].alias("n_words"), "n_removed", "kept_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = language_id(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "strangeness")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", done["n"].alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least_words=1)
    return done.select("doc_id", "item_id", "n_words")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix_dealt(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "source_size", "target", "taken")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secret_scan(_table(spark, sf_dir, "documents"))
    found = F.col("found")
    base = ("assign", "access", "hex")
    return done.select(
        "doc_id",
        *[F.size(of_kind(found, kind)).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(span_text(of_kind(found, *base)).cast("binary"), 256).alias("base_sha256"),
        span_text(found).alias("spans"),
        F.size(F.filter(found, lambda r: r["live"])).cast("long").alias("n_live"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii_scan(_table(spark, sf_dir, "documents"))
    found = F.col("found")
    return done.select(
        "doc_id",
        *[F.size(of_kind(found, kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(span_text(of_kind(found, *BASE)).cast("binary"), 256).alias("base_sha256"),
        span_text(found).alias("spans"),
        F.array_max(F.transform(found, lambda r: r["score"])).alias("top_score"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(conversation_marks(_table(spark, sf_dir, "conversations"))))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rlz_dedup": op1_rlz_dedup,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_topk_search": op5_topk_search,
    "op6_decontaminate": op6_decontaminate,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_mix_sources": op8_mix_sources,
    "op9_secret_scan": op9_secret_scan,
    "op10_pii": op10_pii,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_piece_codec": op12_piece_codec,
    "op13_phrase_graph": op13_phrase_graph,
}

ORACLES: dict[str, str] = {
    "op1_rlz_dedup": sql.RLZ_DEDUP,
    "op4_suffix_dedup": sql.SUFFIX_DEDUP,
    "op5_topk_search": sql.TOPK_SEARCH,
    "op7_jaccard_join": sql.JACCARD_JOIN,
    "op8_mix_sources": sql.MIX_SOURCES,
    "op9_secret_scan": sql.SECRET_SCAN,
    "op11_prefix_trie": sql.PREFIX_TRIE,
    "op13_phrase_graph": sql.PHRASE_GRAPH,
}
