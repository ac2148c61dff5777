"""Evaluation-shaped views over the test tables: question slots, questions, results, responses, pools, calls, listings, verdicts.

The SQL is portable: Spark runs it over DataFrames, and query oracles take it as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "v_clip": """SELECT l_orderkey AS qid,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS slot,
  l_quantity AS duration_s, CAST(l_quantity * 30 AS BIGINT) AS n_frames,
  concat('videos/', l_returnflag, '/', CAST(l_partkey AS VARCHAR(20)), '.', CAST(l_linenumber AS VARCHAR(20)), '.mp4') AS path FROM lineitem""",
    "v_question": """SELECT o.o_orderkey AS id, o.o_orderpriority AS task_type,
  CASE o.o_orderstatus WHEN 'F' THEN 'meva' WHEN 'O' THEN 'ego-exo4d' ELSE 'agibot' END AS source,
  CAST(coalesce(c.k, 0) AS BIGINT) AS orig_num_cameras, CAST(greatest(coalesce(c.k, 0) - 4, 0) AS BIGINT) AS dropped_cameras,
  CASE WHEN o.o_orderkey % 7 = 0 THEN 2 ELSE 4 END AS n_options,
  CASE WHEN o.o_orderkey % 7 = 0 THEN CASE WHEN o.o_orderkey % 2 = 0 THEN 'Yes' ELSE 'No' END ELSE substr('ABCD', CAST(o.o_orderkey % 4 AS INT) + 1, 1) END AS answer
  FROM orders o LEFT JOIN (SELECT l_orderkey AS qid, count(*) AS k FROM lineitem GROUP BY l_orderkey) c ON c.qid = o.o_orderkey""",
    "v_result": """SELECT event_id AS row_id, user_id AS id, event_type AS method, CASE WHEN user_id % 2 = 0 THEN 'qwen' ELSE 'internvl' END AS backend,
  event_id % 4 AS pass_idx, event_id % 4 + 1 AS seed, concat('task_', CAST(user_id % 6 AS VARCHAR(4))) AS task_type,
  CASE user_id % 3 WHEN 0 THEN 'meva' WHEN 1 THEN 'ego-exo4d' ELSE 'agibot' END AS source,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE user_id % 13 + 1 END AS orig_num_cameras,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id % 3 = 0 END AS cap_answer_safe,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id * 7 + user_id) % 10 < 6 END AS correct, event_id % 17 = 0 AS abstained,
  CASE WHEN event_id % 101 = 0 THEN 'RuntimeError: oom' END AS error, CASE WHEN event_id % 101 = 0 THEN NULL ELSE value END AS latency_s,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 100 AS input_tokens, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS output_tokens, ts FROM events""",
    "v_runner": """SELECT event_id AS qkey, event_type AS category, event_id % 3 AS pass_idx,
  CASE user_id % 3 WHEN 0 THEN 'uniform' WHEN 1 THEN 'stitched' ELSE 'decentralized' END AS strategy,
  CASE WHEN event_type IN ('click', 'view', 'error') THEN (event_id * 7 + user_id) % 10 < 6 END AS is_correct,
  CASE WHEN event_type = 'purchase' THEN CAST((event_id * 3) % 5 AS DOUBLE) / 4 END AS partial_credit,
  CASE WHEN event_type = 'signup' THEN CAST((event_id * 11) % 101 AS DOUBLE) / 100 END AS rouge_l FROM events""",
    "v_response": """SELECT conv_id, turn, (conv_id % 7 = 0) AS is_yesno,
  CASE (conv_id + turn) % 6
    WHEN 0 THEN concat('<think>', text, '</think><answer> ', substr('abcd', CAST(conv_id % 4 AS INT) + 1, 1), ' </answer>')
    WHEN 1 THEN concat(text, ' the answer is A. Final answer: ', substr('ABCD', CAST(turn % 4 AS INT) + 1, 1), '.')
    WHEN 2 THEN concat('<think>', text)
    WHEN 3 THEN concat('<answer>', CASE WHEN turn % 2 = 0 THEN 'Yes.' ELSE 'NO' END, '</answer>')
    WHEN 4 THEN concat('trace</think><answer>(C) ', substr(text, 1, 10), '</answer>') ELSE text END AS response_text
  FROM conversations WHERE role = 'assistant'""",
    "v_pool": """SELECT l_orderkey AS qid,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS pos,
  CAST(l_returnflag AS VARCHAR(1)) AS clip, CAST(l_quantity AS BIGINT) AS score, CAST(8 AS BIGINT) AS budget, CAST(1 AS BIGINT) AS floor_n FROM lineitem""",
    "v_call": """SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'gpt-4o' WHEN 'view' THEN 'gpt-5.2' WHEN 'error' THEN 'o3' ELSE 'local-vlm' END AS model,
  event_id % 13 <> 0 AS ok, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 100 AS prompt_tokens, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS completion_tokens FROM events""",
    "v_tar": """SELECT CAST(n_nationkey AS BIGINT) AS listing_pos, concat('t', CAST(n_regionkey AS VARCHAR(4))) AS task,
  concat(CAST(n_nationkey * 10 AS VARCHAR(8)), '-', CAST(n_nationkey * 10 + 14 AS VARCHAR(8)), '.tar') AS tar_path,
  CAST(n_nationkey * 10 AS BIGINT) AS lo, CAST(n_nationkey * 10 + 14 AS BIGINT) AS hi, CAST((n_nationkey * 7919) % 97 + 2 AS BIGINT) AS size_gb FROM nation""",
    "v_verdict": """SELECT d.source AS pair_key, l.doc_id AS claim_id,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'YES' WHEN l.quality = 1 THEN 'PARTIAL' ELSE 'NO' END AS verdict FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the test tables and views by name; only what is named is read."""
    named: dict[str, DataFrame] = {}

    def put(m: re.Match) -> str:
        name = m[2]
        named[name] = view(spark, sf_dir, name) if name in VIEWS else table(spark, sf_dir, name)
        return f"{m[1]}{{{name}}}"

    return spark.sql(re.sub(r"(\b(?:FROM|JOIN)\s+)(" + "|".join([*VIEWS, *TABLES]) + r")\b", put, text), **named)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, VIEWS[name])


def oracle(text: str, *names: str) -> str:
    """SQL for the checking engine: the views a query names, as common table expressions."""
    used = names or [v for v in VIEWS if re.search(rf"\b{v}\b", text)]
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = text.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}" if head else body
    return f"WITH {head}\n{body}" if head else body
