"""A live view over a folder of result logs. An extension: the batch operators read complete files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, method string, backend string, pass_idx int, task_type string, correct boolean, ts timestamp"


def result_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Result rows as files arrive, each (id, method, backend, pass_idx) once within the lateness."""
    rows = spark.readStream.schema(SCHEMA).json(path)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id", "method", "backend", "pass_idx"])


def accuracy_stream(rows: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Accuracy by method and time window."""
    right = F.count_if(F.coalesce(F.col("correct"), F.lit(False)))
    return rows.groupBy(F.window("ts", window), "method").agg(right.alias("n_correct"), F.count("*").alias("n"), (right / F.count("*")).alias("acc"))
