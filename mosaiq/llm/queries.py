"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ann, decontaminate, html, licenses, maxent, mixing, neardup, pii, toxicity, warc
from .common import map_text, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all whole texts of ``documents``: doc_id, license, segments, dice; see licenses.scan(). Null and empty texts have none; repeated rows add up."""
    return licenses.scan(table(spark, sf_dir, "documents"), windows=True)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all whole texts of ``documents``. Null and empty texts have no words and aren't contaminated; repeated rows stay repeated; an empty benchmark hits nothing."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return decontaminate.contaminated(found).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of ``documents``: rows with at least one copy; see mixing.mix(). Null languages and sources are the leaf ''; an empty table gives no rows."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row of ``documents``. Null and empty texts score as a text without votes; repeated rows score alike; without labels the fixed lexicon decides."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        toxicity.held_out(F.col("row.doc_id")).alias("held_out"),
        F.col("out.score").alias("score"),
        (F.col("out.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector of ``embeddings``. Unusable vectors take no part; ties go to the smaller vec_id; fewer candidates are all returned."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all whole texts of ``documents``. Null and empty texts have none; repeated rows stay repeated."""
    found = pii.find(table(spark, sf_dir, "documents"), ["doc_id"])
    count = [pii.count_of(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *count,
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.array_sort(F.concat("base", "terms"))).alias("spans"),
    )


def op7_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each row of ``pages``. Null and empty pages give ''; repeated rows stay repeated; an empty table gives no rows."""
    out = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_text(table(spark, sf_dir, "pages"), "html", ["page_id", "url"], out, lambda: html.extract_batch).select("row.*", "out.*")


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of each row of ``documents``; see neardup.classes(). Rows without words are classes of their own; repeated rows share one."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts of ``documents``. A null or empty text is one end token; repeated rows score alike; an empty table gives no rows."""
    return maxent.score(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What archives of ``pages`` say of each page when read back. A null html is an empty payload; repeated rows are a record each; an empty table gives no rows."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_decontaminate": op2_decontaminate,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_rotated_codes": op5_rotated_codes,
    "op6_disclosure": op6_disclosure,
    "op7_tag_paths": op7_tag_paths,
    "op8_bagminhash": op8_bagminhash,
    "op9_maxent": op9_maxent,
    "op10_warc": op10_warc,
}

#: DuckDB SQL for those that SQL expresses and runs quickly over whole tables.
SQL: dict[str, str] = {"op1_licenses": licenses.sql(), "op2_decontaminate": decontaminate.sql(), "op3_mixing": mixing.sql(), "op8_bagminhash": neardup.sql(), "op10_warc": warc.sql()}
