"""Sinks: partitioned results, report tables, subset files, judge sidecars, Markdown (K-01 .. K-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_name


def results(df: DataFrame, path: str, keys: tuple[str, ...] = ("model", "dataset", "strategy", "category")) -> None:
    """K-01: JSON lines in a folder per model, dataset, strategy and category; slashes in names become underscores."""
    named = df.withColumns({k: safe_name(F.col(k)) for k in keys})
    named.write.partitionBy(*keys).mode("overwrite").json(path)


def report(df: DataFrame, path: str, line: Column) -> None:
    """K-02: formatted lines appended to a text table, each report in a file of its own that a blank line ends."""
    end = df.sparkSession.createDataFrame([("",)], "value string")
    df.select(line.alias("value")).union(end).coalesce(1).write.mode("append").text(path)  # a report's rows, few by nature


def request_log(df: DataFrame, path: str) -> None:
    """K-03: requests appended as JSON lines, without image data."""
    bare = F.transform("content", lambda c: F.struct(c["type"].alias("type"), F.when(c["type"] == "image", F.lit("<image>")).otherwise(c["body"]).alias("body")))
    df.withColumn("content", bare).write.mode("append").json(path)


def subset(df: DataFrame, path: str) -> None:
    """K-04: a subset of questions as JSON lines."""
    df.write.mode("overwrite").json(path)


def blocked(df: DataFrame, path: str) -> None:
    """K-04: questions left out, tab-separated with a header."""
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def lines(df: DataFrame, column: str, path: str) -> None:
    """K-04: one value a line."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def judge_sidecar(scores: DataFrame, path: str, model: str, mode: str) -> None:
    """K-05: a header row with the mean score, and a row per judged entry, in folders of their own."""
    head = scores.agg(F.lit(model).alias("judge_model"), F.lit(mode).alias("mode"), F.coalesce(F.avg("judge_score"), F.lit(0.0)).alias("mean_score"), F.count("*").alias("n"))
    head.write.mode("overwrite").json(f"{path}/header")
    scores.write.mode("overwrite").json(f"{path}/per_question")


def markdown_table(df: DataFrame, columns: list[str], order: list[str]) -> str:
    """K-06: a Markdown table of a report, with all its rows: the first column to the left, the others to the right."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    rows = [r["line"] for r in df.orderBy(*order).select(line.alias("line")).toLocalIterator()]  # all rows, a partition at a time
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "|".join([":--", *["--:"] * (len(columns) - 1)]) + "|", *rows])
