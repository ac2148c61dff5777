"""A training corpus from raw documents: toxicity filter, near-duplicates, benchmark decontamination, personal data, mixture.

Each stage works on what its predecessor kept. Stages take (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import decontaminate, mixing, neardup, pii, toxicity
from mosaiq.llm.common import passing, release, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. Null and empty texts get a score too; repeated rows stay repeated, an empty
    table stays empty."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), COLUMNS)
    return scored.where(F.col("out.score") < toxicity.THRESHOLD).select("row.*")


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, that of the smallest doc_id (null is largest). Rows count, not ids: a doc_id with several
    texts is several documents, equal rows are one. Rows without words have nothing to share and all stay; an empty table stays empty."""
    return neardup.unique(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate. Null and empty texts have no words and stay; repeated rows stay repeated; an
    empty benchmark contaminates nothing."""
    found = decontaminate.contaminated(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), COLUMNS))
    return found.where(~F.col("contaminated")).select("row.*")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced in their texts. Null texts stay null, empty ones empty; n_chars is
    counted anew where the text has changed; repeated rows stay repeated, an empty table stays empty."""
    found = pii.find(docs, COLUMNS)
    text = pii.sanitised(F.col("text"), F.concat("base", "terms"))
    new = F.when(F.col("row.text").isNull(), F.col("row.text")).otherwise(text)
    rows = found.select("row", new.alias("new"))
    n_chars = F.when(F.col("new") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.coalesce(F.length("new").cast("long"), F.col("row.n_chars")))
    return rows.select("row.doc_id", F.col("new").alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents with the number of copies that the target weights ask for. Null languages and sources are the leaf '';
    repeated rows count each; an empty table gives no rows."""
    return mixing.mix(docs)


STAGES = [("toxicity", clean), ("near_dedup", unique), ("decontamination", decontaminated), ("pii", private), ("mixing", mixed)]

#: SQL can't express the learnt, hashed and linked stages; tests hold stages and run() against expected documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what its predecessor wrote; a stage's intermediate files go as soon as its output is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with passing() as keep:
            docs, before = keep(stage(spark, docs, sf_dir), name), docs
        release(before)
    return docs
