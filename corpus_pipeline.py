"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Rows with null or empty texts leave in the first stage. Near
duplicates are five-word shingle sets with a similarity of 0.8 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import langid, minhash, mixing, packing, pii
from quillspan.llm.common import delete, materialize, read_table, scratch_path, tables_inside


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go."""
    return langid.keep_known(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates. Rows that
    repeat a doc_id stay together; a null doc_id belongs to no group."""
    gone = minhash.near_duplicates(docs, size=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(materialize(gone, "gone"), "doc_id", "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says; toxic ones mostly go, good and
    plain ones stay at least once."""
    return mixing.mix(docs, mixing.read_labels(spark, sf_dir))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again, and what it no
    longer needs goes: its own intermediate tables, and the result of the stage before it."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}-{name}")
        with tables_inside(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


#: SQL can't run the vocabularies and models; tests/llm holds each stage against plain Python.
ORACLE_SQL = None
