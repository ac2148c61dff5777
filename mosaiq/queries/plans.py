"""J-01 .. J-12, W-01 .. W-11, T-01 .. T-07 and U-01 .. U-05."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sampling as N
from ..operators import metrics
from ..plans import planning
from ..registry import query
from ..sources.views import oracle, sql, table, view
from .aggregates import _BUCKET, _PRICES, _SCALAR, _SWEEP, FRAMES, prices, r6


@query("j01_levels", "SELECT o_orderkey AS id, coalesce(arg_max(l_linenumber, l_partkey * 1000000000 + l_suppkey * 1000 + l_linenumber), 0) AS level FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'F' GROUP BY o_orderkey")
def j01(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("level"), "l_partkey", "l_suppkey")
    last = planning.last_wins(rows.withColumn("place", F.col("l_partkey") * 1000000000 + F.col("l_suppkey") * 1000 + F.col("level")), "id", "place")
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return q.join(last.select("id", "level"), "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))


@query("j02_prices", oracle(f"SELECT seq, c.model, round(coalesce(prompt_tokens / 1e6 * price_in + completion_tokens / 1e6 * price_out, 0.0), 8) AS usd FROM v_call c LEFT JOIN {_PRICES} ON c.model = p.model"))
def j02(spark, d):
    return metrics.costs(view(spark, d, "v_call"), prices(spark)).select("seq", "model", F.round("usd", 8).alias("usd"))


_TAKES = "SELECT n_name AS take_name, n_nationkey AS take_uid FROM nation WHERE n_nationkey % 3 <> 0"


@query("j03_takes", f"SELECT n_name AS take_name, coalesce(take_uid, -1) AS take_uid, take_uid IS NULL AS unmatched FROM nation LEFT JOIN ({_TAKES}) t ON t.take_name = n_name")
def j03(spark, d):
    wanted = table(spark, d, "nation").select(F.col("n_name").alias("take_name"))
    takes = sql(spark, d, _TAKES)
    hit = wanted.join(takes, "take_name").withColumn("unmatched", F.lit(False))
    lost = wanted.join(takes, "take_name", "left_anti").select("take_name", F.lit(-1).alias("take_uid"), F.lit(True).alias("unmatched"))
    return hit.unionByName(lost)


@query("j04_listing", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 'cam' || (o_custkey % 20) AS stem, key, key IS NULL AS missing FROM orders
LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS day, 'cam' || (l_partkey % 20) AS stem, max(l_orderkey * 10 + l_linenumber) AS key FROM lineitem GROUP BY ALL) l ON l.day = CAST(o_orderdate AS DATE) AND l.stem = 'cam' || (o_custkey % 20)""")
def j04(spark, d):
    of = lambda c: F.concat(F.lit("cam"), (F.col(c) % 20).cast("string"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    listing = table(spark, d, "lineitem").select(day("l_shipdate").alias("day"), of("l_partkey").alias("stem"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))
    wanted = table(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("day"), of("o_custkey").alias("stem"))
    return planning.listed(wanted, listing, ["day", "stem"], "key")


_PRESENT = "contains(path, '/A/') OR contains(path, '/N/') OR contains(path, '.1.')"


@query("j05_complete", oracle(f"SELECT o_orderkey AS qid, arg_min(path, slot) FILTER (WHERE NOT ({_PRESENT})) AS first_missing, count(*) FILTER (WHERE path IS NOT NULL AND NOT ({_PRESENT})) = 0 AS complete FROM orders LEFT JOIN v_clip ON qid = o_orderkey GROUP BY o_orderkey"))
def j05(spark, d):
    clips = view(spark, d, "v_clip").select("qid", "slot", "path")
    path = F.concat(F.lit("videos/"), "l_returnflag", F.lit("/"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(".mp4"))
    present = table(spark, d, "lineitem").select(path.alias("path")).where(_PRESENT).distinct()
    ok, not_ok = planning.complete(table(spark, d, "orders").select(F.col("o_orderkey").alias("qid")), clips, present)
    return ok.withColumn("complete", F.lit(True)).unionByName(not_ok.withColumn("complete", F.lit(False)), allowMissingColumns=True)


@query("j06_bracketing", oracle("SELECT e.task, e.episode, arg_min(t.tar_path, t.listing_pos) AS tar_path FROM (SELECT DISTINCT 't' || (o_orderkey % 5) AS task, o_orderkey % 260 AS episode FROM orders) e LEFT JOIN v_tar t ON t.task = e.task AND e.episode BETWEEN t.lo AND t.hi GROUP BY e.task, e.episode"))
def j06(spark, d):
    key = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(F.concat(F.lit("t"), (key % 5).cast("string")).alias("task"), (key % 260).alias("episode")).distinct()
    return planning.bracketing(asked, view(spark, d, "v_tar"), 10)


@query("j07_summary_cache", oracle("SELECT qid, slot, CASE WHEN n_name IS NOT NULL THEN 'cache' WHEN slot % 5 = 0 THEN 'error' ELSE 'live' END AS summary_source FROM v_clip LEFT JOIN nation ON n_nationkey * 10 = n_frames"))
def j07(spark, d):
    cache = table(spark, d, "nation").select((F.col("n_nationkey") * 10).cast("long").alias("n_frames"), F.col("n_name").alias("summary"))
    got = view(spark, d, "v_clip").select("qid", "slot", "n_frames").join(cache, "n_frames", "left")
    return got.select("qid", "slot", F.when(F.col("summary").isNotNull(), "cache").when(F.col("slot") % 5 == 0, "error").otherwise("live").alias("summary_source"))


@query("j08_judged", oracle(f"""SELECT b.category, round(coalesce(r.s, c.s, b.s), 6) AS score FROM (SELECT category, {_SCALAR} AS s FROM v_runner GROUP BY category) b
LEFT JOIN (SELECT category, avg(rouge_l) AS s FROM v_runner WHERE category = 'signup' AND pass_idx = 1 GROUP BY category) r ON r.category = b.category
LEFT JOIN (SELECT category, avg(partial_credit) AS s FROM v_runner WHERE category = 'purchase' AND pass_idx = 2 GROUP BY category) c ON c.category = b.category"""))
def j08(spark, d):
    rows = view(spark, d, "v_runner")
    base = rows.groupBy("category").agg(metrics.category_scalar().alias("b"))
    rts = rows.where("category = 'signup' AND pass_idx = 1").groupBy("category").agg(F.avg("rouge_l").alias("r"))
    claims = rows.where("category = 'purchase' AND pass_idx = 2").groupBy("category").agg(F.avg("partial_credit").alias("c"))
    return r6(base.join(rts, "category", "left").join(claims, "category", "left").select("category", F.coalesce("r", "c", "b").alias("score")), "score")


@query("j09_default_chance", oracle(f"SELECT category, budget, round(mean - CASE category WHEN 'task_0' THEN 28.5 WHEN 'task_1' THEN 45.5 ELSE 25.0 END, 6) AS margin FROM ({_SWEEP})"))
def j09(spark, d):
    known = spark.createDataFrame([("task_0", 28.5), ("task_1", 45.5)], "category string, chance double")  # a configured list
    got = metrics.sweep(view(spark, d, "v_result"), FRAMES).join(F.broadcast(known), "category", "left")
    return r6(got.select("category", "budget", (F.col("mean") - F.coalesce("chance", F.lit(25.0))).alias("margin")), "margin")


_PAIR = "SELECT id, pass_idx, bool_or(coalesce(correct, false)) AS ok FROM v_result WHERE method = '{}' GROUP BY id, pass_idx"


@query("j10_flips", oracle(f"SELECT a.ok AS base_ok, b.ok AS variant_ok, count(*) AS n FROM ({_PAIR.format('click')}) a JOIN ({_PAIR.format('view')}) b USING (id, pass_idx) GROUP BY ALL"))
def j10(spark, d):
    # one aggregation of both methods in place of a self join
    side = lambda m: F.max(F.when(F.col("method") == m, metrics.truthy(F.col("correct"))))
    per = view(spark, d, "v_result").where("method IN ('click', 'view')").groupBy("id", "pass_idx").agg(side("click").alias("base_ok"), side("view").alias("variant_ok"))
    return per.dropna(subset=["base_ok", "variant_ok"]).groupBy("base_ok", "variant_ok").agg(F.count("*").alias("n"))


@query("j11_composed", oracle("SELECT CASE WHEN orig_num_cameras <= 4 THEN 'click' ELSE 'view' END AS leg, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct FROM v_result WHERE (orig_num_cameras <= 4 AND method = 'click') OR (orig_num_cameras > 4 AND method = 'view') GROUP BY ALL"))
def j11(spark, d):
    rows = view(spark, d, "v_result")
    both = rows.where("method = 'click' AND orig_num_cameras <= 4").unionByName(rows.where("method = 'view' AND orig_num_cameras > 4"))
    return both.groupBy(F.col("method").alias("leg")).agg(F.count("*").alias("n"), F.count_if(metrics.truthy(F.col("correct"))).alias("n_correct"))


@query("j12_camera_counts", oracle("SELECT q.id, q.orig_num_cameras AS needed, coalesce(count(c.path) FILTER (WHERE c.n_frames > 300), 0) AS summarized FROM v_question q LEFT JOIN v_clip c ON c.qid = q.id GROUP BY q.id, q.orig_num_cameras"))
def j12(spark, d):
    done = table(spark, d, "lineitem").where("CAST(l_quantity * 30 AS BIGINT) > 300").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("summarized"))
    return view(spark, d, "v_question").select("id", F.col("orig_num_cameras").alias("needed")).join(done, "id", "left").select("id", "needed", F.coalesce("summarized", F.lit(0)).alias("summarized"))


@query("w01_dense_ids", oracle("SELECT id, row_number() OVER (ORDER BY source, task_type, id) - 1 AS new_id FROM v_question"))
def w01(spark, d):
    """Dense ids by sort position: row numbers within blocks of ids, and the sizes of the blocks before."""
    q = view(spark, d, "v_question").select("id", "source", "task_type", F.floor(F.col("id") / 65536).alias("block"))
    blocks = q.groupBy("source", "task_type", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("source", "task_type", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = blocks.select("source", "task_type", "block", before.alias("start"))
    at = F.row_number().over(Window.partitionBy("source", "task_type", "block").orderBy("id"))
    return q.withColumn("at", at).join(start, ["source", "task_type", "block"]).select("id", (F.col("start") + F.col("at") - 1).cast("long").alias("new_id"))


@query("w02_modulo_shards", oracle("SELECT task_type, (row_number() OVER (PARTITION BY task_type ORDER BY id) - 1) % 8 AS shard, id FROM v_question"))
def w02(spark, d):
    q = planning.placed(view(spark, d, "v_question").select("task_type", "id"), ["task_type"], "id")
    return q.select("task_type", (F.col("place") % 8).alias("shard"), "id")


_CUT = """WITH c AS (SELECT seq, c.model, ok, CAST(coalesce(prompt_tokens / 1e6 * price_in + completion_tokens / 1e6 * price_out, 0.0) AS DECIMAL(20, 6)) AS usd FROM v_call c LEFT JOIN {p} ON c.model = p.model),
r AS (SELECT *, sum(usd) OVER (ORDER BY seq) AS cum FROM c), s AS (SELECT min(seq) AS stop FROM r WHERE ok AND cum >= 5) SELECT seq, model, CAST(cum AS DECIMAL(20, 6)) AS cum FROM r, s WHERE ok AND (stop IS NULL OR seq <= stop)"""


@query("w03_cost_cut", oracle(_CUT.format(p=_PRICES)))
def w03(spark, d):
    calls = metrics.costs(view(spark, d, "v_call"), prices(spark)).withColumn("usd", F.col("usd").cast("decimal(20,6)"))
    return planning.cost_cut(calls, 5).select("seq", "model", F.col("cum").cast("decimal(20,6)").alias("cum"))


@query("w04_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def w04(spark, d):
    return planning.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id").select("user_id", "event_type", "value")


_INTER = f"""SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY r, bucket) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY task_type, bucket ORDER BY id) AS r FROM (SELECT *, {_BUCKET} AS bucket FROM v_question))"""


@query("w05_interleaved", oracle(f"SELECT id, task_type, bucket, seq FROM ({_INTER})"))
def w05(spark, d):
    return planning.interleaved(view(spark, d, "v_question")).select("id", "task_type", "bucket", F.col("seq").cast("long").alias("seq"))


@query("w06_balanced", oracle(f"""WITH i AS ({_INTER}), c AS (SELECT id FROM i WHERE seq <= 40 ORDER BY seq, task_type LIMIT 500),
x AS (SELECT min(id) AS id FROM v_question WHERE source = 'ego-exo4d' AND dropped_cameras > 0 AND NOT EXISTS (SELECT 1 FROM v_question q JOIN c USING (id) WHERE q.source = 'ego-exo4d' AND q.dropped_cameras > 0)),
g AS (SELECT id FROM c UNION SELECT id FROM x WHERE id IS NOT NULL), f AS (SELECT id FROM v_question WHERE id NOT IN (SELECT id FROM g) ORDER BY id LIMIT (SELECT greatest(0, 500 - count(*)) FROM g))
SELECT id, task_type, orig_num_cameras FROM v_question WHERE id IN (SELECT id FROM g UNION ALL SELECT id FROM f) ORDER BY task_type, orig_num_cameras, id LIMIT 500"""))
def w06(spark, d):
    return planning.balanced(view(spark, d, "v_question"), 500, 40).select("id", "task_type", "orig_num_cameras")


@query("w07_seeds", "SELECT i::INT AS pass_idx, CASE WHEN i < 3 THEN [11, 22, 33][i + 1] ELSE 33 + (i - 3 + 1) END::INT AS seed FROM range(0, 6) t(i)")
def w07(spark, d):
    seeds = F.array(F.lit(11), F.lit(22), F.lit(33))
    i = F.col("pass_idx")
    return spark.range(6).select(F.col("id").cast("int").alias("pass_idx")).select(i, F.coalesce(F.get(seeds, i), F.element_at(seeds, -1) + i - F.size(seeds) + 1).alias("seed"))


@query("w08_greedy_tars", oracle("SELECT tar_path, size_gb, cum::BIGINT AS cum FROM (SELECT *, row_number() OVER (ORDER BY size_gb, listing_pos) AS rn, sum(size_gb) OVER (ORDER BY size_gb, listing_pos ROWS UNBOUNDED PRECEDING) AS cum FROM v_tar) WHERE (rn = 1 OR cum <= 200) AND rn <= 10"))
def w08(spark, d):
    return planning.greedy_prefix(view(spark, d, "v_tar"), "size_gb", "listing_pos", F.lit(200), 10).select("tar_path", "size_gb", "cum")


@query("w09_temporal_order", oracle("SELECT qid, clip, string_agg(pos, ',' ORDER BY t, pos) AS frames FROM (SELECT qid, clip, pos, CASE WHEN score % 9 = 0 THEN 0 ELSE score END AS t FROM v_pool) GROUP BY qid, clip"))
def w09(spark, d):
    t = F.when(F.col("score") % 9 == 0, F.lit(None)).otherwise(F.col("score"))
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce(t, F.lit(0)).alias("t"), "pos")))
    return view(spark, d, "v_pool").groupBy("qid", "clip").agg(F.array_join(F.transform(listed, lambda x: x["pos"].cast("string")), ",").alias("frames"))


_GAP, _LO, _HI = 4.0, 30.0, 62.0


@query("w10_label_places", oracle(f"""WITH t AS (SELECT method, task_type AS name, 100.0::DOUBLE * count(*) FILTER (WHERE correct) / count(*) AS y FROM v_result GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY y, name) AS i FROM t), f AS (SELECT *, i * {_GAP} + max(y - i * {_GAP}) OVER (PARTITION BY method ORDER BY i) AS u FROM a),
s AS (SELECT *, u - greatest(0.0, max(u) OVER (PARTITION BY method) - {_HI}) AS v FROM f),
b AS (SELECT *, i * {_GAP} + min(v - i * {_GAP}) OVER (PARTITION BY method ORDER BY i DESC) AS w FROM s) SELECT method, name, round(greatest(w, {_LO}), 6) AS y FROM b"""))
def w10(spark, d):
    """Label positions moved apart: accuracy of each task type, by method."""
    rows = view(spark, d, "v_result").groupBy("method", F.col("task_type").alias("name")).agg(*metrics.accuracy())
    listed = rows.groupBy("method").agg(F.array_sort(F.collect_list(F.struct((F.lit(100.0) * F.col("n_correct") / F.col("n")).alias("y"), "name"))).alias("l"))
    moved = N.apart(F.transform("l", lambda x: x["y"]), _GAP, _LO, _HI)
    out = listed.select("method", F.explode(F.arrays_zip(F.transform("l", lambda x: x["name"]).alias("name"), moved.alias("y"))).alias("x"))
    return out.select("method", "x.name", F.round("x.y", 6).alias("y"))


@query("w11_examples", oracle("SELECT task_type, id FROM (SELECT task_type, id, row_number() OVER (PARTITION BY task_type ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY task_type) AS n FROM v_question WHERE n_options = 4) WHERE place = 7 % n"))
def w11(spark, d):
    q = view(spark, d, "v_question").where("n_options = 4").select("task_type", "id")
    n = q.groupBy("task_type").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("task_type").orderBy("id"))
    few = q.withColumn("at", at).where("at <= 8")  # the eighth example at most is asked for
    return few.join(n, "task_type").where(F.col("at") - 1 == F.lit(7) % F.col("n")).select("task_type", "id")


@query("t01_top_clips", oracle("SELECT qid, string_agg(pos, ',' ORDER BY pos) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rn FROM v_pool) WHERE rn <= 3 GROUP BY qid"))
def t01(spark, d):
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pos"))
    kept = view(spark, d, "v_pool").withColumn("rn", best).where("rn <= 3")
    return kept.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda x: x.cast("string")), ",").alias("kept"))


@query("t02_top_with_floor", oracle("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS g, row_number() OVER (PARTITION BY qid, clip ORDER BY score DESC, pos) AS c FROM v_pool),
k AS (SELECT qid, count(DISTINCT clip) AS k FROM v_pool GROUP BY qid) SELECT qid, pos, clip FROM (SELECT r.*, row_number() OVER (PARTITION BY r.qid ORDER BY CASE WHEN c <= least(floor_n, budget // k) THEN 0 ELSE 1 END, g) AS p FROM r JOIN k ON k.qid = r.qid) WHERE p <= budget"""))
def t02(spark, d):
    return planning.top_with_floor(view(spark, d, "v_pool")).select("qid", "pos", "clip")


@query("t03_starved", oracle("SELECT qid, count(DISTINCT clip) AS n_clips, count(DISTINCT clip) - count(DISTINCT clip) FILTER (WHERE g <= budget) AS starved FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS g FROM v_pool) GROUP BY qid"))
def t03(spark, d):
    return planning.starved(view(spark, d, "v_pool"))


@query("t04_stride", oracle("SELECT qid, pos FROM (SELECT qid, pos, count(*) OVER (PARTITION BY qid) AS n FROM v_pool) WHERE (pos - 1) % greatest(1, n // 4) = 0"))
def t04(spark, d):
    n = F.count("*").over(Window.partitionBy("qid"))
    return view(spark, d, "v_pool").withColumn("n", n).where((F.col("pos") - 1) % F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 4)) == 0).select("qid", "pos")


@query("t05_report_order", oracle("SELECT category, row_number() OVER (ORDER BY n DESC, category) AS place, n FROM (SELECT category, count(*) AS n FROM v_runner GROUP BY category)"))
def t05(spark, d):
    per = view(spark, d, "v_runner").groupBy("category").agg(F.count("*").alias("n"))  # one row per category
    return per.select("category", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "category")).cast("long").alias("place"), "n")


@query("t06_first_missing", oracle("SELECT DISTINCT path FROM v_clip WHERE contains(path, '/R/') ORDER BY path LIMIT 25"))
def t06(spark, d):
    path = F.concat(F.lit("videos/"), "l_returnflag", F.lit("/"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(".mp4"))
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select(path.alias("path")).distinct().orderBy("path").limit(25)


@query("t07_best_budget", oracle(f"SELECT category, arg_max(budget, mean * 1000 - budget * 1e-9) AS best_budget FROM ({_SWEEP}) GROUP BY category"))
def t07(spark, d):
    return metrics.sweep(view(spark, d, "v_result"), FRAMES).groupBy("category").agg(F.max_by("budget", F.struct("mean", -F.col("budget"))).alias("best_budget"))


@query("u01_union", oracle("SELECT method, count(*) AS n FROM (SELECT method FROM v_result WHERE pass_idx = 0 UNION ALL SELECT method FROM v_result WHERE pass_idx = 2) GROUP BY method"))
def u01(spark, d):
    rows = view(spark, d, "v_result").select("method", "pass_idx")
    return rows.where("pass_idx = 0").unionByName(rows.where("pass_idx = 2")).groupBy("method").agg(F.count("*").alias("n"))


@query("u02_distinct", oracle("SELECT DISTINCT task_type, backend FROM v_result"))
def u02(spark, d):
    return view(spark, d, "v_result").select("task_type", "backend").distinct()


@query("u03_difference", "SELECT l_partkey AS part FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
def u03(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R') AND l_quantity > 45").groupBy(F.col("l_partkey").alias("part"))
    seen = rows.agg(F.max(F.col("l_returnflag") == "A").alias("a"), F.max(F.col("l_returnflag") == "R").alias("r"))
    return seen.where("a AND NOT r").select("part")


@query("u04_flag_overlap", oracle("SELECT id, (dropped_cameras > 0 OR n_options = 2) AS hit FROM v_question"))
def u04(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("dropped_cameras") > 0, "lossy"), F.when(F.col("n_options") == 2, "yes_no")))
    return view(spark, d, "v_question").select("id", (F.size(F.array_intersect(flags, F.array(F.lit("lossy"), F.lit("yes_no")))) > 0).alias("hit"))


@query("u05_number_sets", "SELECT n_nationkey, list_aggregate(list_sort(list_distinct(list_concat([n_regionkey], range(n_regionkey + 1, n_regionkey + 4)))), 'string_agg', ',') AS nums FROM nation")
def u05(spark, d):
    r = F.col("n_regionkey")
    nums = F.array_sort(F.array_union(F.array(r), F.sequence(r + 1, r + 3)))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(nums.cast("array<string>"), ",").alias("nums"))
