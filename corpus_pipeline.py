"""The corpus pipeline: language ID, exact dedup, near dedup, personal data, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. Stages tell rows apart by numbers of their own, never
by doc_id, so repeated and missing ids neither lose nor save a row. Every stage takes an empty table to an empty one
and carries further columns along, whatever their names. SQL cannot express the stages' models and fingerprints, so
ORACLE_SQL is None and the stages are tested against brute force."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from facetry.llm import exact_dedup, langid, near_copies, packing, pii
from facetry.llm.common import cleanup, only_kept, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject. Null texts and texts without a letter are rejected; of repeated
    rows all stay or none; with no labelled row to learn from all are rejected."""
    model = langid.fit(docs.where(langid.learned_from()))
    return docs.where(~langid.rejects(spark, model)(docs["text"]))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (a null text counts as empty): the most code points, then the smallest
    doc_id, missing ids last, then one of those that repeat it."""
    return only_kept(docs, lambda rows, row: exact_dedup.exact_dedup(rows, row_col=row).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id (missing ids last), of each component of five-word similarity 0.8 or
    more. Texts without a word are one component; repeated rows are too."""
    return only_kept(docs, near_copies.kept_rows)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data replaced by its kind; null texts stay null, equal texts are treated alike."""
    return pii.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their sequences; a null text counts as empty and is its end id alone,
    repeated rows are packed each, only texts of more ids than a sequence holds are cut."""
    return packing.best_fit_packing(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("private", private), ("packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again; what a stage staged is deleted
    when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/facetry/{uuid.uuid4().hex}"
        with cleanup(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
