"""The operators' registered queries, opN_<name>, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import centroids, chat, compaction, hnsw, langid, matroska, minhash, mixing, packing, pii, quality, spelling, warc
from quillspan.llm.common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(read_table(spark, sf_dir, "documents"), mixing.read_labels(spark, sf_dir))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the operator also tells each row's file and version, which have no fixed names
    return compaction.shard_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "text_md5")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(read_table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def op13_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.stored_texts(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_mix_sources, op3_chat_format, op4_best_fit_packing, op5_language_id,
        op6_sharding, op7_warc, op8_embedding_dedup, op9_pii, op10_minhash_dedup,
        op11_spelling_variants, op12_centroid_clusters, op13_media_columns,
    )
}

SQL: dict[str, str] = {"op1_quality_rules": quality.SQL, "op3_chat_format": chat.SQL, "op6_sharding": compaction.SQL, "op7_warc": warc.SQL, "op11_spelling_variants": spelling.SQL, "op12_centroid_clusters": centroids.SQL}
