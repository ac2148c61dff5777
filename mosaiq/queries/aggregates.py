"""A-01 .. A-37 over the evaluation views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import pystr
from ..operators import metrics
from ..registry import query
from ..sources.views import oracle, sql, table, view

FRAMES = {"signup": 8, "error": 16, "click": 32, "view": 64, "purchase": 128}
# Prices in USD for a million tokens of the models that have one: (model, input, output).
PRICES = [("gpt-4o", 2.5, 10.0), ("gpt-5.2", 1.75, 14.0), ("o3", 2.0, 8.0)]
KEYS = {"task_type": "coalesce(task_type, 'None')", "orig_num_cameras": "coalesce(CAST(orig_num_cameras AS VARCHAR), 'None')", "source": "coalesce(source, 'None')", "cap_answer_safe": "CASE WHEN cap_answer_safe IS NULL THEN 'None' WHEN cap_answer_safe THEN 'True' ELSE 'False' END"}


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


@query("a01_accuracy", oracle("SELECT count(*) FILTER (WHERE correct) AS n_correct, count(*) AS n, round(count(*) FILTER (WHERE correct) / count(*), 6) AS acc FROM v_result"))
def a01(spark: SparkSession, d: str) -> DataFrame:
    return r6(view(spark, d, "v_result").agg(*metrics.accuracy()), "acc")


_FAN = " UNION ALL ".join([f"SELECT *, '{k}' AS dim, {e} AS key FROM v_result" for k, e in KEYS.items()])


@query("a02_accuracy_by", oracle(f"SELECT dim, key, count(*) FILTER (WHERE correct) AS n_correct, count(*) AS n, round(count(*) FILTER (WHERE correct) / count(*), 6) AS acc FROM ({_FAN}) GROUP BY dim, key"))
def a02(spark, d):
    rows = metrics.by_strata(view(spark, d, "v_result")).where("dim != 'overall'")
    return r6(rows.groupBy("dim", "key").agg(*metrics.accuracy()), "acc")


_NEAREST = "list_sort(list(latency_s) FILTER (WHERE latency_s IS NOT NULL))[CAST(round_even({q} * (count(latency_s) - 1), 0) AS INT) + 1]"
_MEASURES = f"""count(*) FILTER (WHERE correct) AS n_correct, count(*) AS n, round(count(*) FILTER (WHERE correct) / count(*), 6) AS acc, round(avg(latency_s), 6) AS latency_mean,
 count(latency_s) AS latency_n, round(avg(input_tokens), 6) AS input_tokens_mean, round(avg(output_tokens), 6) AS output_tokens_mean, round(count(*) FILTER (WHERE abstained) / count(*), 6) AS abstain_rate,
 count(*) FILTER (WHERE coalesce(error, '') <> '') AS errors, {_NEAREST.format(q=0.5)} AS latency_p50, {_NEAREST.format(q=0.95)} AS latency_p95"""
_ALL = f"SELECT *, 'overall' AS dim, '' AS key FROM v_result UNION ALL {_FAN}"
_ROUNDED = ("acc", "latency_mean", "input_tokens_mean", "output_tokens_mean", "abstain_rate")


@query("a03_summary", oracle(f"SELECT dim, key, {_MEASURES} FROM ({_ALL}) GROUP BY dim, key"))
def a03(spark, d):
    return r6(metrics.summary(view(spark, d, "v_result")), *_ROUNDED)


@query("a04_summary_by_method", oracle(f"SELECT method, backend, dim, key, {_MEASURES} FROM ({_ALL}) GROUP BY method, backend, dim, key"))
def a04(spark, d):
    return r6(metrics.summary(view(spark, d, "v_result"), ["method", "backend"]), *_ROUNDED)


@query("a05_percentiles", oracle(f"SELECT method, {_NEAREST.format(q=0.5)} AS p50, {_NEAREST.format(q=0.95)} AS p95 FROM v_result GROUP BY method"))
def a05(spark, d):
    return metrics.percentiles(view(spark, d, "v_result"), ["method"], "latency_s", {"p50": 0.5, "p95": 0.95})


@query("a06_null_means", oracle("SELECT task_type, round(avg(latency_s), 6) AS latency_mean, count(*) FILTER (WHERE coalesce(error, '') <> '') AS errors, round(count(*) FILTER (WHERE abstained) / count(*), 6) AS abstain_rate FROM v_result GROUP BY task_type"))
def a06(spark, d):
    rows = view(spark, d, "v_result").groupBy("task_type")
    got = rows.agg(F.avg("latency_s").alias("latency_mean"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), (F.count_if(metrics.truthy(F.col("abstained"))) / F.count("*")).alias("abstain_rate"))
    return r6(got, "latency_mean", "abstain_rate")


_PASS = "SELECT {keys}, CAST(pass_idx AS VARCHAR) AS pass, count(*) FILTER (WHERE correct) AS n_correct, count(*) AS n, count(*) FILTER (WHERE correct) / count(*) AS acc FROM v_result GROUP BY ALL"


@query("a07_pass_lists", oracle(f"SELECT method, task_type, string_agg(n_correct || '/' || n, ',' ORDER BY pass) AS passes FROM ({_PASS.format(keys='method, task_type')}) GROUP BY method, task_type"))
def a07(spark, d):
    per = metrics.pass_accuracy(view(spark, d, "v_result"), ["method", "task_type"])
    listed = F.array_sort(F.collect_list(F.struct("pass", F.concat_ws("/", F.col("n_correct").cast("string"), F.col("n").cast("string")).alias("v"))))
    return per.groupBy("method", "task_type").agg(F.array_join(F.transform(listed, lambda x: x["v"]), ",").alias("passes"))


@query("a08_pass_spread", oracle(f"SELECT method, backend, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std, count(*) AS n_passes FROM ({_PASS.format(keys='method, backend')}) GROUP BY method, backend"))
def a08(spark, d):
    return r6(metrics.spread(metrics.pass_accuracy(view(spark, d, "v_result"), ["method", "backend"]), ["method", "backend"]), "mean", "std")


@query(
    "a09_cross_tab",
    oracle(f"""SELECT a.task_type, coalesce(CAST(b.orig_num_cameras AS VARCHAR), 'None') AS orig_num_cameras, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std, count(acc) AS n_passes
FROM (SELECT DISTINCT task_type FROM v_result) a CROSS JOIN (SELECT DISTINCT orig_num_cameras FROM v_result) b
LEFT JOIN ({_PASS.format(keys='task_type, orig_num_cameras')}) p ON p.task_type IS NOT DISTINCT FROM a.task_type AND p.orig_num_cameras IS NOT DISTINCT FROM b.orig_num_cameras GROUP BY ALL"""),
)
def a09(spark, d):
    got = metrics.cross_tab(view(spark, d, "v_result"), "task_type", "orig_num_cameras")
    return r6(got.withColumn("orig_num_cameras", pystr(F.col("orig_num_cameras"))), "mean", "std")


_SCALAR = "coalesce(avg(rouge_l), avg(partial_credit), count(*) FILTER (WHERE is_correct) / nullif(count(is_correct), 0), 0.0)"


@query("a10_category_scalar", oracle(f"SELECT category, strategy, round({_SCALAR}, 6) AS score FROM v_runner GROUP BY category, strategy"))
def a10(spark, d):
    return r6(view(spark, d, "v_runner").groupBy("category", "strategy").agg(metrics.category_scalar().alias("score")), "score")


@query(
    "a11_final_table",
    oracle(f"""SELECT category, CASE WHEN count(rouge_l) > 0 THEN 'summarization' WHEN count(partial_credit) > 0 THEN 'counting' ELSE 'mc' END AS kind,
CASE WHEN count(rouge_l) > 0 THEN count(rouge_l) WHEN count(partial_credit) > 0 THEN count(partial_credit) ELSE count(is_correct) END AS n, round({_SCALAR}, 6) AS score FROM v_runner GROUP BY category
UNION ALL SELECT 'overall_mc', 'mc', count(is_correct), round(count(*) FILTER (WHERE is_correct) / count(is_correct), 6) FROM v_runner WHERE category IN (SELECT category FROM v_runner GROUP BY category HAVING count(rouge_l) = 0 AND count(partial_credit) = 0)"""),
)
def a11(spark, d):
    return r6(metrics.final_table(view(spark, d, "v_runner")), "score")


@query("a12_category_averages", oracle("SELECT category, round(avg(rouge_l), 6) AS rouge_l, round(avg(partial_credit), 6) AS partial_credit, round(count(*) FILTER (WHERE is_correct) / nullif(count(is_correct), 0), 6) AS accuracy FROM v_runner GROUP BY category"))
def a12(spark, d):
    acc = F.try_divide(F.count_if(metrics.truthy(F.col("is_correct"))).cast("double"), F.count("is_correct"))
    return r6(view(spark, d, "v_runner").groupBy("category").agg(F.avg("rouge_l").alias("rouge_l"), F.avg("partial_credit").alias("partial_credit"), acc.alias("accuracy")), "rouge_l", "partial_credit", "accuracy")


@query(
    "a13_error_bars",
    oracle(f"""SELECT category, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0.0), 6) AS std, count(v) AS n_passes FROM (
SELECT category, pass_idx, {_SCALAR} AS v FROM v_runner GROUP BY category, pass_idx UNION ALL SELECT 'overall_mc', pass_idx, count(*) FILTER (WHERE is_correct) / count(is_correct) FROM v_runner GROUP BY pass_idx) GROUP BY category"""),
)
def a13(spark, d):
    rows = view(spark, d, "v_runner")
    per = rows.groupBy("category", "pass_idx").agg(metrics.category_scalar().alias("v"))
    pooled = rows.groupBy("pass_idx").agg(F.try_divide(F.count_if(metrics.truthy(F.col("is_correct"))).cast("double"), F.count("is_correct")).alias("v"))
    return r6(metrics.spread(per.unionByName(pooled.withColumn("category", F.lit("overall_mc"))), ["category"], "v", sample=True), "mean", "std")


@query(
    "a14_results_tree",
    oracle("""SELECT strategy, category, round(coalesce(CASE kind WHEN 'rouge' THEN avg(rouge_l) WHEN 'credit' THEN avg(partial_credit) ELSE count(*) FILTER (WHERE is_correct) / count(*) END, 0.0), 6) AS score
FROM v_runner JOIN (SELECT strategy, category, arg_min(CASE WHEN rouge_l IS NOT NULL THEN 'rouge' WHEN partial_credit IS NOT NULL THEN 'credit' ELSE 'mc' END, qkey) AS kind FROM v_runner GROUP BY ALL) USING (strategy, category)
GROUP BY strategy, category, kind"""),
)
def a14(spark, d):
    kind = F.when(F.col("rouge_l").isNotNull(), "rouge").when(F.col("partial_credit").isNotNull(), "credit").otherwise("mc")
    mc = F.count_if(metrics.truthy(F.col("is_correct"))) / F.count("*")
    got = view(spark, d, "v_runner").groupBy("strategy", "category").agg(F.min_by(kind, "qkey").alias("kind"), F.avg("rouge_l").alias("a"), F.avg("partial_credit").alias("b"), mc.alias("c"))
    score = F.when(F.col("kind") == "rouge", F.col("a")).when(F.col("kind") == "credit", F.col("b")).otherwise(F.col("c"))
    return r6(got.select("strategy", "category", F.coalesce(score, F.lit(0.0)).alias("score")), "score")


@query(
    "a15_strategy_pivot",
    oracle(f"""SELECT category, coalesce(max(s) FILTER (WHERE strategy = 'uniform'), 0.0) AS uniform, coalesce(max(s) FILTER (WHERE strategy = 'stitched'), 0.0) AS stitched,
coalesce(max(s) FILTER (WHERE strategy = 'decentralized'), 0.0) AS decentralized FROM (SELECT category, strategy, round({_SCALAR}, 6) AS s FROM v_runner GROUP BY ALL) GROUP BY category"""),
)
def a15(spark, d):
    per = view(spark, d, "v_runner").groupBy("category", "strategy").agg(F.round(metrics.category_scalar(), 6).alias("s"))
    return per.groupBy("category").pivot("strategy", ["uniform", "stitched", "decentralized"]).agg(F.first("s")).na.fill(0.0)


_LEG = "CASE method " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in FRAMES.items()) + " END"
_SWEEP = f"""SELECT category, CAST(budget AS INT) AS budget, avg(acc) * 100 AS mean, stddev_pop(acc) * 100 AS std, count(*) AS n_passes FROM (SELECT category, budget, pass_idx, count(*) FILTER (WHERE correct) / count(*) AS acc FROM
(SELECT 'Overall' AS category, {_LEG} AS budget, pass_idx, correct FROM v_result UNION ALL SELECT task_type, {_LEG}, pass_idx, correct FROM v_result) WHERE budget IS NOT NULL GROUP BY ALL) GROUP BY category, budget"""


@query("a16_frame_sweep", oracle(f"SELECT category, budget, round(mean, 6) AS mean, round(std, 6) AS std, n_passes FROM ({_SWEEP})"))
def a16(spark, d):
    return r6(metrics.sweep(view(spark, d, "v_result"), FRAMES), "mean", "std")


_CHANCE = "SELECT coalesce(task_type, 'pooled') AS category, count(*) AS n, 100.0::DOUBLE * avg(1.0::DOUBLE / n_options) AS chance FROM v_question GROUP BY GROUPING SETS ((task_type), ())"


@query(
    "a17_sweep_gains",
    oracle(f"""SELECT category, round(arg_max(mean, budget) - arg_min(mean, budget), 6) AS gain, arg_max(budget, mean * 1000 - budget * 1e-9) AS best_budget, round(max(mean), 6) AS best, round(coalesce(max(chance), 25.0), 6) AS chance,
round(max(mean) - coalesce(max(chance), 25.0), 6) AS margin, max(k.n)::BIGINT AS n FROM ({_SWEEP}) JOIN (SELECT category, sum(t) // count(*) AS n FROM (SELECT category, pass_idx, count(*) AS t
FROM (SELECT 'Overall' AS category, pass_idx, method FROM v_result UNION ALL SELECT task_type, pass_idx, method FROM v_result) WHERE method = 'signup' GROUP BY category, pass_idx) GROUP BY category) k USING (category) LEFT JOIN (SELECT 'task_' || (row_number() OVER (ORDER BY category) - 1) AS category, chance FROM ({_CHANCE}) WHERE category <> 'pooled') USING (category) GROUP BY category"""),
)
def a17(spark, d):
    base = metrics.chance(view(spark, d, "v_question")).where("category != 'pooled'")
    named = base.select(F.concat(F.lit("task_"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("category")) - 1).cast("string")).alias("category"), "chance")
    rows = view(spark, d, "v_result")
    got = metrics.gains(metrics.sweep(rows, FRAMES), named).join(metrics.panels(rows, FRAMES), "category")
    return r6(got, "gain", "best", "chance", "margin")


@query("a18_chance", oracle(f"SELECT category, n, round(chance, 6) AS chance FROM ({_CHANCE})"))
def a18(spark, d):
    return r6(metrics.chance(view(spark, d, "v_question")), "chance")


@query("a19_option_histogram", oracle("SELECT coalesce(task_type, 'pooled') AS category, n_options, count(*) AS n FROM v_question GROUP BY GROUPING SETS ((task_type, n_options), (n_options))"))
def a19(spark, d):
    rows = view(spark, d, "v_question")
    got = rows.groupingSets([[F.col("task_type"), F.col("n_options")], [F.col("n_options")]], "task_type", "n_options").agg(F.count("*").alias("n"), F.grouping("task_type").alias("g"))
    return got.select(F.when(F.col("g") == 1, "pooled").otherwise(F.col("task_type")).alias("category"), "n_options", "n")


@query("a20_above_chance", oracle(f"SELECT q.category, round(100 * s.acc - q.chance, 6) AS margin, round(100 * s.acc / q.chance, 6) AS ratio FROM ({_CHANCE}) q CROSS JOIN (SELECT count(*) FILTER (WHERE correct) / count(*) AS acc FROM v_result) s"))
def a20(spark, d):
    acc = F.broadcast(view(spark, d, "v_result").agg(*metrics.accuracy()).select("acc"))  # one row
    got = metrics.chance(view(spark, d, "v_question")).join(acc)
    return r6(got.select("category", (F.lit(100) * F.col("acc") - F.col("chance")).alias("margin"), (F.lit(100) * F.col("acc") / F.col("chance")).alias("ratio")), "margin", "ratio")


@query(
    "a21_type_cube",
    oracle("""SELECT coalesce(source, 'TOTAL') AS source, sum(n) FILTER (WHERE task_type = '1-URGENT')::BIGINT AS urgent, sum(n) FILTER (WHERE task_type = '2-HIGH')::BIGINT AS high, sum(n) FILTER (WHERE task_type IS NULL)::BIGINT AS total
FROM (SELECT source, task_type, count(*) AS n, grouping(source) AS g FROM v_question GROUP BY CUBE (source, task_type)) GROUP BY source, g"""),
)
def a21(spark, d):
    got = view(spark, d, "v_question").cube("source", "task_type").agg(F.count("*").alias("n"))
    pick = lambda t: F.sum(F.when(F.col("task_type") == t, F.col("n")))
    per = got.groupBy(F.coalesce("source", F.lit("TOTAL")).alias("source"))
    return per.agg(pick("1-URGENT").alias("urgent"), pick("2-HIGH").alias("high"), F.sum(F.when(F.col("task_type").isNull(), F.col("n"))).alias("total"))


@query(
    "a22_camera_stats",
    oracle("""SELECT source, min(k) AS least, max(k) AS most, CAST(floor(quantile_cont(k, 0.5)) AS INT) AS median, string_agg(k || ':' || n, ' ' ORDER BY k) AS histogram
FROM (SELECT source, orig_num_cameras AS k, count(*) OVER (PARTITION BY source, orig_num_cameras) AS n, row_number() OVER (PARTITION BY source, orig_num_cameras ORDER BY id) AS r FROM v_question) WHERE r = 1 GROUP BY source""".replace("quantile_cont(k, 0.5)", "(SELECT quantile_cont(q.orig_num_cameras, 0.5) FROM v_question q WHERE q.source = x.source)").replace("WHERE r = 1", "x WHERE r = 1")),
)
def a22(spark, d):
    rows = view(spark, d, "v_question")
    counts = rows.groupBy("source", "orig_num_cameras").agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("orig_num_cameras", "n"))), lambda x: F.concat_ws(":", x["orig_num_cameras"].cast("string"), x["n"].cast("string")))
    median = F.floor(F.percentile("orig_num_cameras", F.lit(0.5), F.col("n"))).cast("int")
    return counts.groupBy("source").agg(F.min("orig_num_cameras").alias("least"), F.max("orig_num_cameras").alias("most"), median.alias("median"), F.array_join(listed, " ").alias("histogram"))


_FLAGS = "CASE WHEN orig_num_cameras = 0 THEN 'no_video' END, CASE WHEN dropped_cameras > 0 THEN 'lossy' END, CASE WHEN n_options = 2 THEN 'yes_no' END"


@query("a23_flags", oracle(f"SELECT source, flag, count(*) AS n FROM (SELECT source, unnest([x FOR x IN [{_FLAGS}] IF x IS NOT NULL]) AS flag FROM v_question) GROUP BY source, flag"))
def a23(spark, d):
    flags = F.array_compact(F.array(*[F.expr(x) for x in _FLAGS.split(", CASE") for x in ["CASE" + x if not x.startswith("CASE") else x]]))
    return view(spark, d, "v_question").select("source", F.explode(flags).alias("flag")).groupBy("source", "flag").agg(F.count("*").alias("n"))


_DROP = "CASE WHEN task_type = '5-LOW' THEN 'drop_type' WHEN answer NOT IN ('A', 'B', 'C', 'D') THEN 'drop_answer' WHEN orig_num_cameras = 0 THEN 'drop_no_video' WHEN n_options < 3 THEN 'drop_options' ELSE 'kept' END"


@query("a24_conversion", oracle(f"SELECT source, {_DROP} AS reason, count(*) AS n FROM v_question GROUP BY ALL"))
def a24(spark, d):
    return view(spark, d, "v_question").groupBy("source", F.expr(_DROP).alias("reason")).agg(F.count("*").alias("n"))


_BUCKET = "CASE WHEN orig_num_cameras <= 1 THEN '1' WHEN orig_num_cameras <= 4 THEN '2-4' WHEN orig_num_cameras <= 7 THEN '5-7' ELSE '8+' END"


@query("a25_subset_report", oracle(f"SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(task_type) = 0 THEN 'task_type' ELSE 'bucket' END AS dim, coalesce(source, task_type, bucket) AS key, count(*) AS n, count(*) FILTER (WHERE dropped_cameras > 0) AS lossy FROM (SELECT *, {_BUCKET} AS bucket FROM v_question) GROUP BY GROUPING SETS ((source), (task_type), (bucket))"))
def a25(spark, d):
    from ..plans.planning import bucket

    rows = view(spark, d, "v_question").withColumn("bucket", bucket(F.col("orig_num_cameras")))
    sets = [[F.col(c)] for c in ("source", "task_type", "bucket")]
    got = rows.groupingSets(sets, "source", "task_type", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("dropped_cameras") > 0).alias("lossy"), F.grouping("source").alias("a"), F.grouping("task_type").alias("b"))
    return got.select(F.when(F.col("a") == 0, "source").when(F.col("b") == 0, "task_type").otherwise("bucket").alias("dim"), F.coalesce("source", "task_type", "bucket").alias("key"), "n", "lossy")


@query("a26_k_distribution", oracle("SELECT orig_num_cameras AS k, n_options = 2 AS yes_no, count(*) AS n FROM v_question GROUP BY ALL"))
def a26(spark, d):
    return view(spark, d, "v_question").groupBy(F.col("orig_num_cameras").alias("k"), (F.col("n_options") == 2).alias("yes_no")).agg(F.count("*").alias("n"))


@query("a27_distinct_videos", oracle("SELECT DISTINCT path FROM v_clip"))
def a27(spark, d):
    # the path needs no slot numbers, so the window of the view is left out
    return sql(spark, d, "SELECT DISTINCT concat('videos/', l_returnflag, '/', CAST(l_partkey AS STRING), '.', CAST(l_linenumber AS STRING), '.mp4') AS path FROM lineitem")


@query("a28_first_seen", oracle("SELECT path, qid, slot FROM (SELECT path, qid, slot, row_number() OVER (PARTITION BY path ORDER BY qid, slot) AS rn FROM v_clip) WHERE rn = 1"))
def a28(spark, d):
    first = view(spark, d, "v_clip").groupBy("path").agg(F.min(F.struct("qid", "slot")).alias("first"))
    return first.select("path", "first.qid", "first.slot")


@query("a29_paths_per_group", oracle("SELECT qid, string_agg(DISTINCT path, ';' ORDER BY path) AS paths FROM v_clip GROUP BY qid"))
def a29(spark, d):
    return view(spark, d, "v_clip").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("path")), ";").alias("paths"))


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, price_in double, price_out double")


_PRICES = "(VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in PRICES) + ") p(model, price_in, price_out)"
_USD = "coalesce(prompt_tokens / 1e6 * price_in + completion_tokens / 1e6 * price_out, 0.0)"


@query("a30_cost_totals", oracle(f"SELECT c.model, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(sum({_USD}), 6) AS usd FROM v_call c LEFT JOIN {_PRICES} ON c.model = p.model GROUP BY c.model"))
def a30(spark, d):
    got = metrics.costs(view(spark, d, "v_call"), prices(spark)).groupBy("model")
    return r6(got.agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("usd").alias("usd")), "usd")


_TOKENS = "SELECT *, CASE strategy WHEN 'decentralized' THEN 3 * (frames * 800 + 400) + 3 * 512 + 400 ELSE frames * 800 + 400 END AS in_tok, CASE strategy WHEN 'decentralized' THEN 3 * 512 + 16 ELSE 64 END AS out_tok"
_PLANS = "(VALUES ('uniform'), ('stitched'), ('decentralized')) s(strategy) CROSS JOIN (VALUES (8), (16), (64)) f(frames)"


@query("a31_cost_estimate", oracle(f"SELECT model, strategy, frames, n, CAST(n * (in_tok / 1e6 * price_in + out_tok / 1e6 * price_out) AS DECIMAL(18, 4)) AS usd FROM ({_TOKENS} FROM (SELECT m.model, n, price_in, price_out FROM (SELECT model, count(*) AS n FROM v_call GROUP BY model) m LEFT JOIN {_PRICES} ON m.model = p.model) c CROSS JOIN {_PLANS})"))
def a31(spark, d):
    plans = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(n).alias("frames")) for s in ("uniform", "stitched", "decentralized") for n in (8, 16, 64)])
    calls = view(spark, d, "v_call").groupBy("model").agg(F.count("*").alias("n")).join(prices(spark), "model", "left")
    rows = calls.withColumn("p", F.explode(plans)).select("*", "p.*")
    return rows.select("model", "strategy", "frames", "n", metrics.estimate(F.col("n"), F.col("strategy"), F.col("frames"), F.col("price_in"), F.col("price_out")).cast("decimal(18,4)").alias("usd"))


_CLAIM = "SELECT pair_key, (count(*) FILTER (WHERE verdict = 'YES') + 0.5::DOUBLE * count(*) FILTER (WHERE verdict = 'PARTIAL')) / count(*) AS score FROM v_verdict GROUP BY pair_key"


def claim_scores(spark, d):
    share = (F.count_if(F.col("verdict") == "YES") + F.lit(0.5) * F.count_if(F.col("verdict") == "PARTIAL")) / F.count("*")
    return view(spark, d, "v_verdict").groupBy("pair_key").agg(share.alias("score"))


@query("a32_judge_mean", oracle(f"SELECT round(coalesce(avg(score), 0.0), 6) AS mean_score, count(*) AS n FROM ({_CLAIM})"))
def a32(spark, d):
    return claim_scores(spark, d).agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("mean_score"), F.count("*").alias("n"))


@query("a33_claim_scores", oracle(f"SELECT pair_key, round(score, 6) AS score FROM ({_CLAIM})"))
def a33(spark, d):
    return r6(claim_scores(spark, d), "score")


@query("a34_latency", oracle("SELECT qid, sum(duration_s) + 1 AS serial_s, max(duration_s) + 1 AS parallel_s FROM v_clip GROUP BY qid"))
def a34(spark, d):
    return sql(spark, d, "SELECT l_orderkey AS qid, sum(l_quantity) + 1 AS serial_s, max(l_quantity) + 1 AS parallel_s FROM lineitem GROUP BY l_orderkey")


@query("a35_selector_cost", oracle("SELECT method, backend, sum(input_tokens)::BIGINT AS selector_tokens, count(*) AS questions FROM (SELECT id, method, backend, arg_min(input_tokens, row_id) AS input_tokens FROM v_result GROUP BY id, method, backend) GROUP BY method, backend"))
def a35(spark, d):
    once = view(spark, d, "v_result").groupBy("id", "method", "backend").agg(F.min_by("input_tokens", "row_id").alias("input_tokens"))
    return once.groupBy("method", "backend").agg(F.sum("input_tokens").alias("selector_tokens"), F.count("*").alias("questions"))


_RANK = "max(latency_s) FILTER (WHERE k = round_even({q} * (m - 1), 0) + 1)"


@query("a36_summary_lines", oracle(f"""WITH g AS (SELECT method, backend, count(*) AS total, count(*) FILTER (WHERE correct) AS right_, count(*) FILTER (WHERE abstained) AS gone, count(*) FILTER (WHERE error <> '') AS errors, avg(latency_s) AS lat, avg(input_tokens) AS tin, avg(output_tokens) AS tout FROM v_result GROUP BY ALL),
r AS (SELECT method, backend, latency_s, row_number() OVER (PARTITION BY method, backend ORDER BY latency_s) AS k, count(*) OVER (PARTITION BY method, backend) AS m FROM v_result WHERE latency_s IS NOT NULL),
p AS (SELECT method, backend, {_RANK.format(q=0.5)} AS p50, {_RANK.format(q=0.95)} AS p95 FROM r GROUP BY ALL),
t AS (SELECT method, backend, string_agg(task_type || ' ' || c || '/' || n, ', ' ORDER BY task_type) AS types FROM (SELECT method, backend, task_type, count(*) FILTER (WHERE correct) AS c, count(*) AS n FROM v_result GROUP BY ALL) GROUP BY ALL)
SELECT g.method || '/' || g.backend AS key, printf('%d/%d = %.1f%%   abstain=%.0f%%  errors=%d', right_, total, 100.0 * right_ / total, 100.0 * gone / total, errors) AS overall,
printf('p50=%.1f p95=%.1f mean=%.1f', p50, p95, lat) AS latency, printf('in~%.0f out~%.0f calls~1.0', tin, tout) AS tokens, types FROM g JOIN p USING (method, backend) JOIN t USING (method, backend)"""))
def a36(spark, d):
    rows = view(spark, d, "v_result")
    s = metrics.summary(rows, ["method", "backend"])
    listed = s.where("dim = 'task_type'").groupBy("method", "backend").agg(F.array_sort(F.collect_list(F.struct("key", "n_correct", "n"))).alias("l"))
    types = listed.select("method", "backend", F.array_join(F.transform("l", lambda x: F.format_string("%s %d/%d", x["key"], x["n_correct"], x["n"])), ", ").alias("types"))
    whole = s.where("dim = 'overall'").join(types, ["method", "backend"])
    return whole.select(F.concat_ws("/", "method", "backend").alias("key"), *metrics.summary_lines(), "types")


@query("a37_coverage", oracle("SELECT task, sum(size_gb)::BIGINT AS gb, count(*) FILTER (WHERE lo % 20 = 0) AS present, count(*) FILTER (WHERE lo % 20 <> 0) AS missing FROM v_tar GROUP BY task"))
def a37(spark, d):
    here = F.col("lo") % 20 == 0
    return view(spark, d, "v_tar").groupBy("task").agg(F.sum("size_gb").alias("gb"), F.count_if(here).alias("present"), F.count_if(~here).alias("missing"))
