"""The queries opN_<name> of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewpoint.llm import alignment, bpe, chat, divergence, embeddings, lines, minhash, mixing, passages, quality, suffix, token_counts, topk

#: Vocabulary files of op9, op11 and op13; parameters of the operators.
VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_passage_dedup(spark, sf_dir):
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_embedding_dedup(spark, sf_dir):
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_chat_format(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).drop("text")


def op7_suffix_dedup(spark, sf_dir):
    return suffix.dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels"))


def op9_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.tokenize(docs, public_tokenizers.path(VOCABULARY), with_ids=False, with_text=False)


def op10_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path(VOCABULARY))


def op12_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_token_alignment(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_tokenizers(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_passage_dedup": op2_passage_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_mix_sources": op6_mix_sources,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL = {
    "op1_minhash_dedup": minhash.ORACLE_SQL,
    "op3_embedding_dedup": embeddings.ORACLE_SQL,
    "op4_chat_format": chat.ORACLE_SQL,
    "op5_exact_top_k": topk.ORACLE_SQL,
    "op6_mix_sources": mixing.ORACLE_SQL,
    "op10_line_dedup": lines.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
