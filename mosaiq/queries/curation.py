"""F-01 .. F-17 and P-01 .. P-23: filters, record shaping and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import planning
from ..registry import query
from ..sources.views import oracle, sql, table, view
from .aggregates import _BUCKET, _DROP, FRAMES


@query("f01_required_keys", "SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.question') AS has_question FROM events")
def f01(spark: SparkSession, d: str) -> DataFrame:
    keys = F.json_object_keys("props")
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return table(spark, d, "events").select("event_id", has("k").alias("has_k"), has("question").alias("has_question"))


@query("f02_with_videos", oracle("SELECT id, orig_num_cameras FROM v_question WHERE orig_num_cameras > 0"))
def f02(spark, d):
    return view(spark, d, "v_question").where("orig_num_cameras > 0").select("id", "orig_num_cameras")


@query("f03_with_frames", "SELECT l_orderkey AS qid FROM lineitem GROUP BY l_orderkey HAVING max(CAST(l_quantity * 30 AS BIGINT)) > 300")
def f03(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"))
    usable = table(spark, d, "lineitem").where(F.col("l_quantity") * 30 > 300).select(F.col("l_orderkey").alias("qid"))
    return q.join(usable, "qid", "left_semi")


@query("f04_shard", oracle("SELECT id, task_type FROM (SELECT id, task_type, row_number() OVER (PARTITION BY task_type ORDER BY id) - 1 AS i FROM v_question) WHERE i % 4 = 1"))
def f04(spark, d):
    return planning.shard(view(spark, d, "v_question").select("id", "task_type"), "task_type", "id", 4, 1)


_MORE = "id % 11 = 0 AS open_ended, CASE WHEN id % 13 = 0 THEN 'missing_answer' WHEN id % 13 = 1 THEN 'unparseable_question_json' WHEN id % 13 = 2 THEN 'dict_answer' END AS flag"


@query("f05_drop_cascade", oracle(f"""SELECT id, CASE WHEN task_type NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN 'drop_type' WHEN open_ended THEN 'drop_open_ended' WHEN upper(answer) NOT IN ('A', 'B', 'C', 'D') THEN 'drop_bad_answer'
WHEN flag IN ('missing_answer', 'unparseable_question_json') THEN 'drop_flagged' WHEN orig_num_cameras = 0 THEN 'drop_no_video' WHEN n_options < 3 THEN 'drop_few_options' WHEN here < orig_num_cameras THEN 'drop_missing_local' ELSE 'kept' END AS reason
FROM (SELECT *, {_MORE}, coalesce((SELECT count(*) FROM lineitem WHERE l_orderkey = id AND l_quantity > 5), 0) AS here FROM v_question)"""))
def f05(spark, d):
    here = table(spark, d, "lineitem").where("l_quantity > 5").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("here"))
    q = view(spark, d, "v_question").selectExpr("*", _MORE.split(", CASE")[0], "CASE" + _MORE.split(", CASE")[1]).join(here, "id", "left")
    q = q.withColumn("flags", F.when(F.col("flag").isNull(), F.array().cast("array<string>")).otherwise(F.array("flag")))
    reason = planning.drop_reason(F.col("task_type").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), ~F.col("open_ended"), F.col("answer"), F.col("flags"), F.col("orig_num_cameras"), F.col("n_options"), F.coalesce("here", F.lit(0)), least=3)
    return q.select("id", reason.alias("reason"))


@query("f06_letter_answers", oracle("SELECT id, upper(trim(answer)) AS answer FROM v_question WHERE upper(trim(answer)) IN ('A', 'B', 'C', 'D')"))
def f06(spark, d):
    a = F.upper(X.pytrim(F.concat(F.lit("  "), F.lower("answer"), F.lit("\t"))))
    return view(spark, d, "v_question").select("id", a.alias("answer")).where(F.col("answer").isin("A", "B", "C", "D"))


@query("f07_flagged", oracle("SELECT id FROM v_question WHERE dropped_cameras > 2 OR n_options = 2"))
def f07(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("dropped_cameras") > 2, "lossy"), F.when(F.col("n_options") == 2, "yes_no"), F.when(F.col("orig_num_cameras") == 0, "no_video")))
    return view(spark, d, "v_question").where(F.arrays_overlap(flags, F.array(F.lit("lossy"), F.lit("yes_no")))).select("id")


@query("f08_k_filters", oracle("SELECT id, orig_num_cameras >= 3 AS k3, orig_num_cameras = 4 AS k4 FROM v_question WHERE orig_num_cameras >= 3"))
def f08(spark, d):
    k = F.col("orig_num_cameras")
    return view(spark, d, "v_question").where(k >= 3).select("id", (k >= 3).alias("k3"), (k == 4).alias("k4"))


@query("f09_temporal", "SELECT o_orderkey AS id, max(l_linenumber) AS level FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey HAVING max(l_linenumber) >= 1")
def f09(spark, d):
    levels = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linenumber").alias("level"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(levels, "id", "left")
    return q.withColumn("level", F.coalesce("level", F.lit(0))).where("level >= 1")


@query("f10_clean_null", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN event_type ELSE NULL END AS v FROM events")
def f10(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, " None ").when(F.col("event_id") % 5 == 1, "").when(F.col("event_id") % 5 == 2, "null").when(F.col("event_id") % 5 == 3, F.concat(F.lit(" "), "event_type"))
    return table(spark, d, "events").select("event_id", X.clean_null(raw).alias("v"))


@query("f11_cache_rows", "SELECT event_id FROM events WHERE event_type <> 'error' AND event_id % 101 <> 0 AND event_id % 7 NOT IN (1, 2)")
def f11(spark, d):
    i = F.col("event_id")
    summary = F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("")
    version = F.when(i % 7 == 1, F.lit(', "prompt_ver": "v2"')).when(i % 7 == 2, F.lit(', "prompt_ver": null')).when(i % 7 == 3, F.lit("")).otherwise(F.lit(', "prompt_ver": "v1"'))
    line = F.concat(F.lit('{"summary": "'), summary, F.when(i % 101 == 0, F.lit('", "error": "oom"')).otherwise(F.lit('"')), version, F.lit("}"))
    return table(spark, d, "events").select("event_id", line.alias("line")).where(X.current_summary(F.col("line"), "v1")).select("event_id")


@query("f12_sweep_legs", oracle("SELECT row_id, CASE method WHEN 'click' THEN 32 ELSE 64 END AS budget FROM v_result WHERE method IN ('click', 'view')"))
def f12(spark, d):
    legs = spark.createDataFrame([(m, n) for m, n in FRAMES.items() if m in ("click", "view")], "method string, budget int")  # a configured list
    return view(spark, d, "v_result").join(F.broadcast(legs), "method").select("row_id", "budget")


@query("f13_judge_pairs", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND text <> '' AND substr(text, 20) <> ''")
def f13(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'").withColumn("ref", F.substring("text", 20, 1 << 30))
    return c.where("text <> '' AND ref <> ''").select("conv_id", "turn")


@query("f14_still_images", oracle("SELECT id, CASE WHEN orig_num_cameras = 0 AND id % 3 = 0 THEN 'still images only' END AS error FROM v_question"))
def f14(spark, d):
    images = F.when(F.col("id") % 3 == 0, 2).otherwise(0)
    return view(spark, d, "v_question").select("id", F.when((F.col("orig_num_cameras") == 0) & (images > 0), "still images only").alias("error"))


@query("f15_yes_no", oracle("SELECT id, n_options = 2 OR id % 50 = 0 AS yes_no FROM v_question"))
def f15(spark, d):
    yes = F.array(F.lit(" Yes."), F.lit("No"))
    four = F.array(*[F.lit(f"{x}. text") for x in "ABCD"])
    options = F.when(F.col("id") % 50 == 0, F.array().cast("array<string>")).when(F.col("n_options") == 2, yes).otherwise(four)
    return view(spark, d, "v_question").select("id", X.is_yesno(options).alias("yes_no"))


@query("f16_strata", oracle("SELECT task_type, orig_num_cameras, count(*) AS n FROM v_question GROUP BY task_type, orig_num_cameras"))
def f16(spark, d):
    return view(spark, d, "v_question").groupBy("task_type", "orig_num_cameras").agg(F.count("*").alias("n"))


@query("f17_source_paths", oracle("SELECT path, count(*) AS n FROM v_clip WHERE contains(path, '/R/') GROUP BY path"))
def f17(spark, d):
    path = F.concat(F.lit("videos/"), "l_returnflag", F.lit("/"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(".mp4"))
    return table(spark, d, "lineitem").select(path.alias("path")).where(F.contains("path", F.lit("/R/"))).groupBy("path").agg(F.count("*").alias("n"))


@query("p01_keys", oracle("SELECT id, source || '_' || coalesce(nullif(task_type, '5-LOW'), 'default') || '_' || (id % 10) AS qkey FROM v_question"))
def p01(spark, d):
    qtype = F.coalesce(F.nullif("task_type", F.lit("5-LOW")), F.lit("default"))
    return view(spark, d, "v_question").select("id", F.concat_ws("_", F.coalesce("source", F.lit("scene")), qtype, (F.col("id") % 10).cast("string")).alias("qkey"))


@query("p02_options", "SELECT n_nationkey, 'A. ' || n_name || '|B. ' || lower(n_name) || '|C. ' || n_regionkey AS options FROM nation")
def p02(spark, d):
    m = F.create_map(F.lit("C"), F.col("n_regionkey").cast("string"), F.lit("A"), "n_name", F.lit("B"), F.lower("n_name"))
    listed = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(". "), e["value"]))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(listed, "|").alias("options"))


@query("p03_answer_case", oracle("SELECT id, CASE WHEN n_options = 4 THEN lower(answer) ELSE answer END AS answer FROM v_question"))
def p03(spark, d):
    return view(spark, d, "v_question").select("id", F.when(F.col("n_options") == 4, F.lower("answer")).otherwise(F.col("answer")).alias("answer"))


@query("p04_nested_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def p04(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


_Q5, _A5 = "event_id % 4", "event_id % 5"


@query("p05_double_encoded", f"""SELECT event_id, CASE {_Q5} WHEN 0 THEN 'Is "' || event_type || '" so?' WHEN 1 THEN '{{"question": broken' ELSE event_type END AS question,
CASE WHEN {_A5} = 0 THEN 'B' WHEN {_A5} = 3 THEN 'D' WHEN {_A5} = 4 THEN 'A' WHEN {_Q5} = 0 THEN 'C' END AS answer,
concat_ws(',', CASE {_Q5} WHEN 0 THEN 'double_encoded_question' WHEN 1 THEN 'unparseable_question_json' END, CASE WHEN {_A5} IN (0, 4) THEN 'dict_answer' END, CASE WHEN {_A5} IN (1, 2) AND {_Q5} <> 0 THEN 'missing_answer' END) AS flags FROM events""")
def p05(spark, d):
    encoded = F.concat(F.lit('{"question": "Is "'), F.col("event_type"), F.lit('" so?",\n "options": {"A": "x",\n "B": "y"\n },\n "correct_option": "C"}'))
    i = F.col("event_id")
    asked = F.when(i % 4 == 0, encoded).when(i % 4 == 1, F.lit('{"question": broken')).otherwise(F.col("event_type"))
    answer = F.when(i % 5 == 0, F.lit('{"correct_option": "B", "answer": "E"}')).when(i % 5 == 4, F.lit('{"answer": "A"}')).when(i % 5 == 1, F.lit('""')).when(i % 5 == 2, F.lit("null")).otherwise(F.lit('"D"'))
    got = X.normalized(asked, answer)
    return table(spark, d, "events").select("event_id", got["question"].alias("question"), got["answer"].alias("answer"), F.array_join(got["flags"], ",").alias("flags"))


def slots(spark, d):
    """Each question's clips as an array in slot order."""
    listed = F.array_sort(F.collect_list(F.struct("slot", "path", "n_frames", "duration_s")))
    return view(spark, d, "v_clip").groupBy("qid").agg(listed.alias("s"))


@query("p06_slots_to_array", oracle("SELECT qid, count(*) AS num_videos, string_agg(path, ',' ORDER BY slot) AS videos FROM v_clip WHERE slot <= 13 GROUP BY qid"))
def p06(spark, d):
    wide = slots(spark, d).select("qid", *[F.get(F.col("s"), F.lit(i))["path"].alias(f"video_{i + 1}") for i in range(13)])
    videos = F.filter(F.array(*[F.col(f"video_{i + 1}") for i in range(13)]), lambda v: F.coalesce(v, F.lit("")) != "")
    return wide.select("qid", F.size(videos).cast("long").alias("num_videos"), F.array_join(videos, ",").alias("videos"))


@query("p07_array_to_slots", oracle("SELECT qid, " + ", ".join(f"max(path) FILTER (WHERE slot = {i}) AS video_{i}" for i in range(1, 5)) + " FROM v_clip GROUP BY qid"))
def p07(spark, d):
    return slots(spark, d).select("qid", *[F.get(F.col("s"), F.lit(i))["path"].alias(f"video_{i + 1}") for i in range(4)])


@query("p08_path_join", oracle("SELECT DISTINCT 'data/' || path AS full_path FROM v_clip"))
def p08(spark, d):
    raw = F.concat(F.lit("data/raw//./x/../../"), F.regexp_replace("path", "^videos/", "videos/old/.././"))
    return view(spark, d, "v_clip").select(X.normpath(raw).alias("full_path")).distinct()


@query("p09_path_parts", oracle("SELECT DISTINCT path, regexp_extract(path, '([^/]+)[.][^./]*$', 1) AS stem, split_part(path, '/', 2) AS part FROM v_clip"))
def p09(spark, d):
    return view(spark, d, "v_clip").select("path", X.stem(F.col("path")).alias("stem"), F.get(F.split("path", "/"), F.lit(1)).alias("part")).distinct()


LABELS = {"1-URGENT": "Temporal", "2-HIGH": "Spatial", "3-MEDIUM": "Counting"}


@query("p10_type_labels", oracle("SELECT id, 'CrossView-' || source || '-' || CASE task_type WHEN '1-URGENT' THEN 'Temporal' WHEN '2-HIGH' THEN 'Spatial' WHEN '3-MEDIUM' THEN 'Counting' ELSE task_type END AS label FROM v_question"))
def p10(spark, d):
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return view(spark, d, "v_question").select("id", F.concat_ws("-", F.lit("CrossView"), "source", F.coalesce(F.try_element_at(names, F.col("task_type")), "task_type")).alias("label"))


@query("p11_camera_buckets", oracle(f"SELECT id, {_BUCKET} AS bucket FROM v_question"))
def p11(spark, d):
    return view(spark, d, "v_question").select("id", planning.bucket(F.col("orig_num_cameras")).alias("bucket"))


@query("p12_cap_fields", oracle("SELECT id, greatest(orig_num_cameras - 4, 0) AS dropped_cameras, orig_num_cameras <= 4 AS cap_answer_safe FROM v_question"))
def p12(spark, d):
    k = F.col("orig_num_cameras")
    return view(spark, d, "v_question").select("id", F.greatest(k - 4, F.lit(0)).alias("dropped_cameras"), (k <= 4).alias("cap_answer_safe"))


@query("p13_strata", oracle("SELECT id, coalesce(nullif(orig_num_cameras, 0), 2) AS num_views, nullif(CASE WHEN id % 4 = 0 THEN '' ELSE 'p' || (id % 4) END, '') AS pair_idx FROM v_question"))
def p13(spark, d):
    pair = F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("id") % 4).cast("string")))
    return view(spark, d, "v_question").select("id", F.coalesce(F.nullif("orig_num_cameras", F.lit(0)), F.lit(2).cast("long")).alias("num_views"), F.nullif(pair, F.lit("")).alias("pair_idx"))


_CAP = """WITH c AS (SELECT qid, path, min(slot) AS slot FROM v_clip GROUP BY qid, path),
r AS (SELECT *, CASE WHEN {flag} THEN 0 ELSE 1 END AS later FROM c) SELECT qid, string_agg(path, ',' ORDER BY later, slot) AS videos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY later, slot) AS rn FROM r) WHERE rn <= 4 GROUP BY qid"""


@query("p14_cap_required", oracle("""WITH c AS (SELECT qid, path, min(slot) AS slot FROM v_clip GROUP BY qid, path),
a AS (SELECT qid, min(slot) FILTER (WHERE contains(path, '.3.')) AS s3 FROM c GROUP BY qid), b AS (SELECT c.qid, min(slot) FILTER (WHERE contains(path, '.1.')) AS s1 FROM c GROUP BY c.qid),
r AS (SELECT c.qid, c.path, c.slot, CASE WHEN c.slot = s3 THEN 0 WHEN c.slot = s1 THEN 1 ELSE 2 END AS later FROM c JOIN a ON c.qid = a.qid JOIN b ON c.qid = b.qid)
SELECT qid, string_agg(path, ',' ORDER BY later, slot) AS videos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY later, slot) AS rn FROM r) WHERE rn <= 4 GROUP BY qid"""))
def p14(spark, d):
    paths = F.array_distinct(F.transform("s", lambda x: x["path"]))
    return slots(spark, d).select("qid", F.array_join(planning.cap_ordered(paths, F.array(F.lit("3"), F.lit("1"))), ",").alias("videos"))


@query("p15_cap_flagged", oracle(_CAP.format(flag="contains(lower(path), '/r/')")))
def p15(spark, d):
    paths = F.array_distinct(F.transform("s", lambda x: x["path"]))
    return slots(spark, d).select("qid", F.array_join(planning.cap_flagged(paths, lambda p: F.contains(F.lower(p), F.lit("/r/"))), ",").alias("videos"))


@query("p16_extension", oracle("SELECT DISTINCT CASE WHEN contains(path, '/A/') THEN replace(path, '.mp4', '.avi') ELSE path END AS path FROM v_clip"))
def p16(spark, d):
    new = F.when(F.contains("path", F.lit("/A/")), F.regexp_replace("path", "\\.mp4$", ".avi")).otherwise(F.col("path"))
    return view(spark, d, "v_clip").select(new.alias("path")).distinct()


# The prompt texts.
QUESTION_SCAFFOLD = (
    "\nPlease think about this question as if you were a human pondering deeply. Engage in an internal dialogue using expressions such as 'let me think', 'wait', 'Hmm', 'oh, I see', "
    "'let's break it down', etc, or other natural language thought expressions. It's encouraged to include self-reflection or verification in the reasoning process. Provide your detailed reasoning "
    "between the <think> and </think> tags, and then give your final answer between the <answer> and </answer> tags."
)
_LEAD = "Select the best answer to the following {} question based on all the listed videos."
_POST_YN = "Provide only the single word (Yes or No) within the <answer> </answer> tags."
_POST_MC = "Provide only the single option letter ({}) within the <answer> </answer> tags."


def prompt(question, options, yes_no, letters):
    """P-17: the whole prompt of a question."""
    lead = F.when(yes_no, _LEAD.format("yes-no")).otherwise(_LEAD.format("multiple-choice"))
    a, b = _POST_MC.split("{}")
    post = F.when(yes_no, _POST_YN).otherwise(F.concat(F.lit(a), X.letters_phrase(letters), F.lit(b)))
    return F.concat(lead, F.lit("\n"), question, F.lit("\n"), F.array_join(options, "\n"), F.lit(QUESTION_SCAFFOLD), F.lit("\n"), post)


_SCAFFOLD_SQL = "chr(10) || '" + QUESTION_SCAFFOLD.strip().replace("'", "''") + "'"


@query(
    "p17_prompts",
    oracle(f"""SELECT id, md5(CASE WHEN n_options = 2 THEN '{_LEAD.format("yes-no")}' ELSE '{_LEAD.format("multiple-choice")}' END || chr(10) || 'What is ' || id || '?' || chr(10)
|| CASE WHEN n_options = 2 THEN 'Yes' || chr(10) || 'No' ELSE 'A. one' || chr(10) || 'B. two' || chr(10) || 'C. three' || chr(10) || 'D. four' END || {_SCAFFOLD_SQL} || chr(10)
|| CASE WHEN n_options = 2 THEN '{_POST_YN}' ELSE '{_POST_MC.format("A, B, C, or D")}' END) AS prompt_md5 FROM v_question"""),
)
def p17(spark, d):
    yes = F.col("n_options") == 2
    options = F.when(yes, F.array(F.lit("Yes"), F.lit("No"))).otherwise(F.array(*map(F.lit, ("A. one", "B. two", "C. three", "D. four"))))
    q = F.concat(F.lit("What is "), F.col("id").cast("string"), F.lit("?"))
    return view(spark, d, "v_question").select("id", F.md5(prompt(q, options, yes, X.letters_of(F.col("n_options")))).alias("prompt_md5"))


@query("p18_letters", "SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 2 AND 13 THEN substr('ABCDEFGHIJKLM', 1, n_nationkey) ELSE 'ABCD' END AS letters FROM nation")
def p18(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.letters_of(F.col("n_nationkey")).alias("letters"))


@query("p19_label_fallback", "SELECT n_nationkey, coalesce(r_name, CAST(n_nationkey AS VARCHAR)) AS label FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def p19(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_nationkey"), "left").select("n_nationkey", F.coalesce("r_name", F.col("n_nationkey").cast("string")).alias("label"))


@query(
    "p20_context",
    oracle("""SELECT qid, string_agg('Camera ' || clip || ':' || chr(10) || last, chr(10) || chr(10) ORDER BY first) AS context
FROM (SELECT qid, clip, min(pos) AS first, CAST(arg_max(score, pos) AS VARCHAR) AS last FROM v_pool GROUP BY qid, clip) GROUP BY qid"""),
)
def p20(spark, d):
    per = view(spark, d, "v_pool").groupBy("qid", "clip").agg(F.min("pos").alias("first"), F.max_by("score", "pos").cast("string").alias("last"))
    line = F.concat(F.lit("Camera "), "clip", F.lit(":\n"), "last")
    return per.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


@query("p21_presented", oracle("SELECT qid, CASE WHEN count(*) FILTER (WHERE n_frames > 600) = count(*) THEN 'all' ELSE string_agg('Video ' || slot, ' ' ORDER BY slot) FILTER (WHERE n_frames > 600) END AS content FROM v_clip GROUP BY qid"))
def p21(spark, d):
    kept = F.filter("s", lambda x: x["n_frames"] > 600)
    named = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("Video "), x["slot"].cast("string"))), " ")
    return slots(spark, d).select("qid", F.when(F.size(kept) == F.size("s"), "all").when(F.size(kept) > 0, named).alias("content"))


@query("p22_truncated", "SELECT conv_id, turn, right(text, 120) AS tail, left(text, 20) AS head FROM conversations")
def p22(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.right("text", F.lit(120)).alias("tail"), F.left("text", F.lit(20)).alias("head"))


@query("p23_images_stripped", "SELECT conv_id, turn, 'text:' || role || ',image:<image>' AS logged FROM conversations")
def p23(spark, d):
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("role").alias("body")), F.struct(F.lit("image").alias("type"), F.col("text").alias("body")))
    bare = F.transform(content, lambda c: F.concat(c["type"], F.lit(":"), F.when(c["type"] == "image", "<image>").otherwise(c["body"])))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(bare, ",").alias("logged"))
