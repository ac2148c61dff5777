"""S and K operators as round trips through the shared or warehouse folder are covered by tests; here are scans over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.views import table


@query("s01_variant_scan", "SELECT user_id, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY user_id")
def s01(spark, d):
    """JSON text as VARIANT; a field that is missing or of another type is null."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("s06_tolerant_scan", "SELECT event_type, count(*) FILTER (WHERE event_id % 9 <> 0) AS parsed, count(*) FILTER (WHERE event_id % 9 = 0) AS skipped FROM events GROUP BY event_type")
def s06(spark, d):
    """Lines that don't parse are counted and skipped."""
    raw = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    ok = F.try_parse_json(raw).isNotNull()
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("skipped"))


@query("k06_markdown", "SELECT r_regionkey, '| ' || r_name || ' | ' || count(*) || ' |' AS line FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name")
def k06(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "region").join(n, "r_regionkey").select("r_regionkey", F.concat(F.lit("| "), "r_name", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))
