"""X-01 .. X-18 and N-01 .. N-20: answer parsing, sampling, apportionment and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sampling as N
from ..functions import text as X
from ..functions.udfs import allocate_frames, rouge_scores
from ..registry import query
from ..sources.views import oracle, sql, table, view

_BODY = "trim(regexp_extract(response_text, '(?s)<answer>(.*?)</answer>', 1), ' ' || chr(10) || chr(9))"


@query("x01_think", oracle("""SELECT conv_id, turn, md5(CASE WHEN regexp_matches(response_text, '(?s)<think>.*?</think>') THEN trim(regexp_extract(response_text, '(?s)<think>(.*?)</think>', 1), ' ' || chr(10))
WHEN contains(response_text, '</think>') THEN trim(split_part(response_text, '</think>', 1), ' ' || chr(10)) ELSE '' END) AS think FROM v_response"""))
def x01(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_response").select("conv_id", "turn", F.md5(X.extract_think(F.col("response_text"))).alias("think"))


@query("x02_answer", oracle(f"SELECT conv_id, turn, {_BODY} AS answer FROM v_response"))
def x02(spark, d):
    return view(spark, d, "v_response").select("conv_id", "turn", X.extract_answer(F.col("response_text")).alias("answer"))


_MC = "(?i)(?:final\\s+answer|best\\s+answer|correct\\s+answer|the\\s+answer|answer)\\s*(?:is|:|=|would\\s+be)?\\s*\\(?([ABCD])\\b"
_YN = "(?i)(?:final\\s+answer|the\\s+answer|answer)\\s*(?:is|:|=)?\\s*\\(?(yes|no)\\b"
_CHOICE = f"""CASE WHEN b <> '' AND is_yesno THEN CASE WHEN regexp_matches(b, '(?i)\\b(yes|no)\\b') THEN upper(left(regexp_extract(b, '(?i)\\b(yes|no)\\b', 1), 1)) || lower(substr(regexp_extract(b, '(?i)\\b(yes|no)\\b', 1), 2)) ELSE b END
WHEN b <> '' THEN CASE WHEN regexp_matches(b, '(?i)\\b[ABCD]\\b') THEN upper(regexp_extract(b, '(?i)\\b([ABCD])\\b', 1)) ELSE b END
WHEN is_yesno THEN coalesce(upper(left(list_extract(regexp_extract_all(response_text, '{_YN}', 1), -1), 1)) || lower(substr(list_extract(regexp_extract_all(response_text, '{_YN}', 1), -1), 2)), '')
ELSE coalesce(upper(list_extract(regexp_extract_all(response_text, '{_MC}', 1), -1)), '') END"""
_PARSED = f"SELECT conv_id, turn, is_yesno, {_CHOICE} AS pred FROM (SELECT *, {_BODY} AS b FROM v_response)"


@query("x03_choice", oracle(f"SELECT conv_id, turn, pred FROM ({_PARSED})"))
def x03(spark, d):
    return view(spark, d, "v_response").select("conv_id", "turn", X.parse_choice(F.col("response_text"), F.col("is_yesno"), F.lit("ABCD")).alias("pred"))


@query("x04_gold", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Yes' WHEN regexp_matches(r_name, '(?i)[ABCD]') THEN upper(regexp_extract(r_name, '(?i)([ABCD])', 1)) ELSE upper(r_name) END AS gold FROM nation JOIN region ON r_regionkey = n_regionkey")
def x04(spark, d):
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))  # the fixed table of regions
    yes = F.col("n_nationkey") % 2 == 0
    return rows.select("n_nationkey", X.gt_choice(F.when(yes, " yes").otherwise(F.lower("r_name")), yes, F.lit("ABCD")).alias("gold"))


@query("x05_correct", oracle(f"SELECT conv_id, turn, upper(trim(pred)) = CASE WHEN is_yesno THEN 'YES' ELSE substr('ABCD', CAST(conv_id % 4 AS INT) + 1, 1) END AS correct, pred = '' AS abstained FROM ({_PARSED})"))
def x05(spark, d):
    pred = X.parse_choice(F.col("response_text"), F.col("is_yesno"), F.lit("ABCD"))
    gold = F.when(F.col("is_yesno"), "Yes").otherwise(F.substring(F.lit("ABCD"), (F.col("conv_id") % 4 + 1).cast("int"), F.lit(1)))
    return view(spark, d, "v_response").select("conv_id", "turn", X.is_correct(pred, gold).alias("correct"), (pred == "").alias("abstained"))


_WIDE = "regexp_replace(lower(response_text), '([^\\pL\\pN_])', '\\1\\1', 'g')"  # each separator twice, so that neighbours don't share one
_LONE = f"regexp_extract_all({_WIDE}, '(?:^|[^\\pL\\pN_])([a-z])(?:$|[^\\pL\\pN_])', 1)"


@query("x06_letter", oracle(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(response_text), 'answer\\s*[:=]\\s*\\(?[a-z]') THEN regexp_extract(lower(response_text), 'answer\\s*[:=]\\s*\\(?([a-z])', 1)
WHEN len([x FOR x IN {_LONE} IF x IN ('a', 'b', 'c', 'd')]) > 0 THEN [x FOR x IN {_LONE} IF x IN ('a', 'b', 'c', 'd')][1] WHEN len({_LONE}) > 0 THEN {_LONE}[1] ELSE left(trim(lower(response_text)), 1) END AS letter FROM v_response"""))
def x06(spark, d):
    options = F.array(*[F.lit(f"{x}. text") for x in "ABCD"])
    return view(spark, d, "v_response").select("conv_id", "turn", X.extract_letter(F.col("response_text"), options).alias("letter"))


@query("x07_number", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN regexp_extract(props, '-?[0-9]+\\.?[0-9]*') WHEN event_id % 3 = 1 THEN '7.5' ELSE event_type END AS number FROM events")
def x07(spark, d):
    said = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("about 12; ANSWER: 7.5 "), "props")).otherwise(F.concat(F.lit(" "), "event_type"))
    return table(spark, d, "events").select("event_id", X.extract_number(said).alias("number"))


@query("x08_replies", oracle("SELECT seq, CASE WHEN model IN ('gpt-5.2', 'o3') THEN substr('abcd', CAST(seq % 4 AS INT) + 1, 1) ELSE substr('abcd', CAST(seq % 4 AS INT) + 1, 1) || '. text' END AS reply FROM v_call"))
def x08(spark, d):
    raw = F.concat(F.lit(" "), F.substring(F.lit("ABCD"), (F.col("seq") % 4 + 1).cast("int"), F.lit(1)), F.lit(". Text\n"))
    return view(spark, d, "v_call").select("seq", X.mc_reply(F.col("model"), raw).alias("reply"))


@query("x09_judge_score", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(1.0, event_id % 20 / 10.0)::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 1.0::DOUBLE END AS score, event_id % 4 = 3 AS parse_error FROM events")
def x09(spark, d):
    i = F.col("event_id")
    said = F.when(i % 4 == 0, F.concat(F.lit("so <score> "), F.format_number((i % 20) / 10, 1), F.lit(" </score>"))).when(i % 4 == 1, "first 0.2 then 0.85").when(i % 4 == 2, "0.4 or 1").otherwise("unclear 7")
    score = X.judge_score(said)
    return table(spark, d, "events").select("event_id", score.alias("score"), score.isNull().alias("parse_error"))


@query("x10_verdicts", oracle("SELECT claim_id, CASE claim_id % 3 WHEN 0 THEN verdict WHEN 1 THEN 'YES' ELSE 'NO' END AS verdict FROM v_verdict"))
def x10(spark, d):
    i = F.col("claim_id")
    said = F.when(i % 3 == 0, F.concat(F.lit("x <verdict> "), F.lower("verdict"), F.lit(" </verdict> YES"))).when(i % 3 == 1, "no... partial? yes").otherwise("cannot say")
    return view(spark, d, "v_verdict").select("claim_id", X.verdict(said).alias("verdict"))


@query("x11_claims", "SELECT event_id, i::INT AS pos, CASE i WHEN 0 THEN event_type ELSE 'value ' || (event_id % 7) END AS claim FROM events, range(2) t(i)")
def x11(spark, d):
    said = F.concat(F.lit("\n 1. "), "event_type", F.lit(" \n\n- value "), (F.col("event_id") % 7).cast("string"), F.lit("\n"))
    return table(spark, d, "events").select("event_id", F.posexplode(X.claims(said)).alias("pos", "claim"))


@query("x12_no_think", oracle("SELECT conv_id, turn, md5(regexp_replace(regexp_replace(response_text, '(?s)<think>.*?</think>', ' ', 'g'), '(?s)<think>.*', ' ')) AS bare FROM v_response"))
def x12(spark, d):
    return view(spark, d, "v_response").select("conv_id", "turn", F.md5(X.strip_think(F.col("response_text"))).alias("bare"))


@query("x13_numbers", "SELECT n_nationkey, list_aggregate([x FOR x IN range(1, 8) IF x BETWEEN n_regionkey AND n_regionkey + 2 OR x = n_nationkey % 9], 'string_agg', ',') AS nums FROM nation")
def x13(spark, d):
    r = F.col("n_regionkey")
    line = F.concat((r + 2).cast("string"), F.lit("–"), r.cast("string"), F.lit(", and "), (F.col("n_nationkey") % 9).cast("string"))
    nums = X.numbers(line, F.lit(7))
    return table(spark, d, "nation").select("n_nationkey", F.when(F.size(nums) > 0, F.array_join(nums.cast("array<string>"), ",")).alias("nums"))


@query("x14_selection", "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '1,2,4' WHEN 1 THEN '1,2,3,4' WHEN 2 THEN '2,3' ELSE '1,2,3,4' END AS ids, CASE WHEN n_nationkey % 5 IN (3, 4) THEN 'fallback:all' ELSE 'ok' END AS tag, CASE n_nationkey % 5 WHEN 3 THEN 3 ELSE 1 END::INT AS best FROM nation")
def x14(spark, d):
    k = F.col("n_nationkey") % 5
    said = F.when(k == 0, "<think>SELECTED: 3</think>SELECTED: 1, 2, and 4").when(k == 1, "selected: all of them").when(k == 2, "SELECTED: 9\nSELECTED : 2-3\n4 reasons").when(k == 3, "I like Video 3 best").otherwise("none")
    got, best = X.selection(said, F.lit(4)), X.selection(said, F.lit(4), top1=True)
    return table(spark, d, "nation").select("n_nationkey", F.array_join(got["ids"].cast("array<string>"), ",").alias("ids"), F.coalesce(got["tag"], F.lit("ok")).alias("tag"), F.get(best["ids"], F.lit(0)).alias("best"))


@query("x15_option_counts", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 2 END::INT AS n_options FROM nation")
def x15(spark, d):
    k = F.col("n_nationkey") % 3
    options = F.when(k == 0, F.array(F.lit("A. x, B. y; C. z, D. w"))).when(k == 1, F.array(F.lit("only A. here"))).otherwise(F.array(F.lit("A. x"), F.lit("B. y")))
    return table(spark, d, "nation").select("n_nationkey", X.option_count(options).alias("n_options"))


@query("x16_rouge")
def x16(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    ref = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("ref"))
    scored = docs.join(ref, "doc_id").withColumn("s", rouge_scores(F.col("ref"), F.col("text")))
    return scored.select("doc_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("rouge1", "rouge2", "rougeL")])


@query("x17_letters_phrase", "SELECT i::INT AS n, CASE WHEN i = 2 THEN 'A or B' WHEN i <= 6 THEN ['A, B, or C', 'A, B, C, or D', 'A, B, C, D, or E', 'A, B, C, D, E, or F'][i - 2] ELSE 'A, B, ..., or ' || substr('ABCDEFGHIJKLM', i, 1) END AS phrase FROM range(2, 14) t(i)")
def x17(spark, d):
    n = F.col("id").cast("int")
    return spark.range(2, 14).select(n.alias("n"), X.letters_phrase(X.letters_of(n)).alias("phrase"))


@query("x18_names", oracle("SELECT DISTINCT replace(path, '/', '_') AS safe, regexp_extract(path, '([^/]+)[.][^./]*$', 1) AS category FROM v_clip"))
def x18(spark, d):
    path = F.concat(F.lit("m_uniform_"), F.element_at(F.split("path", "/"), -1))
    return view(spark, d, "v_clip").select(X.safe_name(F.col("path")).alias("safe"), X.category_of(path, F.lit("uniform")).alias("category")).distinct()


@query("n01_partial_credit", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0.0 WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, 1 - abs(event_id % 3 - event_id % 5)::DOUBLE / (event_id % 5)) END::DOUBLE AS credit FROM events")
def n01(spark, d):
    i = F.col("event_id")
    gold = F.when(i % 5 == 4, "none").otherwise(F.concat(F.lit("about "), (i % 5).cast("string")))
    return table(spark, d, "events").select("event_id", N.partial_credit(F.concat((i % 3).cast("string"), F.lit(" cars")), gold).alias("credit"))


_N = "SELECT DISTINCT CAST(l_quantity * 30 AS BIGINT) AS n FROM lineitem"


def frames(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_quantity") * 30).cast("long").alias("n")).distinct()


def listed(c):
    return F.array_join(c.cast("array<string>"), ",")


@query("n02_uniform", f"SELECT n, k::INT AS k, CASE WHEN n < k THEN (SELECT string_agg(i, ',' ORDER BY i) FROM range(n) r(i)) WHEN k = 1 THEN '0' ELSE (SELECT string_agg(CASE WHEN i = k - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1)::DOUBLE / (k - 1))) AS BIGINT) END, ',' ORDER BY i) FROM range(k) r(i)) END AS idx FROM ({_N}), (VALUES (1), (8), (50)) v(k)")
def n02(spark, d):
    ks = F.explode(F.array(F.lit(1), F.lit(8), F.lit(50)))
    return frames(spark, d).withColumn("k", ks).select("n", "k", listed(N.uniform_indices(F.col("n"), F.col("k"))).alias("idx"))


@query("n03_synchronised", oracle("SELECT qid, m, (SELECT string_agg(CASE WHEN i = 3 THEN m - 1 ELSE CAST(floor(i * ((m - 1)::DOUBLE / 3)) AS BIGINT) END, ',' ORDER BY i) FROM range(4) r(i)) AS idx FROM (SELECT qid, min(n_frames) AS m FROM v_clip WHERE n_frames > 0 GROUP BY qid)"))
def n03(spark, d):
    least = sql(spark, d, "SELECT l_orderkey AS qid, min(CAST(l_quantity * 30 AS BIGINT)) AS m FROM lineitem WHERE CAST(l_quantity * 30 AS BIGINT) > 0 GROUP BY l_orderkey")
    return least.select("qid", "m", listed(N.uniform_indices(F.col("m"), F.lit(4))).alias("idx"))


@query("n04_rounded", f"SELECT n, (SELECT string_agg(CAST(round_even(i * (n - 1)::DOUBLE / 7, 0) AS BIGINT), ',' ORDER BY i) FROM range(8) r(i)) AS idx FROM ({_N})")
def n04(spark, d):
    return frames(spark, d).select("n", listed(N.rounded_indices(F.col("n"), F.lit(8))).alias("idx"))


@query("n05_midpoints", f"SELECT n, (SELECT string_agg(greatest(0, least(n - 1, CAST(floor((n - 1)::DOUBLE / 8 / 2 + round_even((n - 1)::DOUBLE / 8 * i, 0)) AS BIGINT))), ',' ORDER BY i) FROM range(8) r(i)) AS idx FROM ({_N})")
def n05(spark, d):
    return frames(spark, d).select("n", listed(N.segment_midpoints(F.col("n"), F.lit(8))).alias("idx"))


@query("n06_thumbnails", f"SELECT n, (SELECT string_agg(DISTINCT CAST(floor((i + 0.5::DOUBLE) * n / 5) AS BIGINT), ',' ORDER BY CAST(floor((i + 0.5::DOUBLE) * n / 5) AS BIGINT)) FROM range(5) r(i)) AS idx FROM ({_N})")
def n06(spark, d):
    return frames(spark, d).select("n", listed(N.thumbnails(F.col("n"), F.lit(5))).alias("idx"))


@query("n07_largest_remainder", oracle("""WITH q AS (SELECT qid, slot, duration_s, 64 * duration_s / sum(duration_s) OVER (PARTITION BY qid) AS quota FROM v_clip),
f AS (SELECT *, CAST(floor(quota) AS BIGINT) AS base, quota - floor(quota) AS frac FROM q), r AS (SELECT *, 64 - sum(base) OVER (PARTITION BY qid) AS residual, row_number() OVER (PARTITION BY qid ORDER BY frac DESC, slot) AS rn FROM f)
SELECT qid, slot, base + CASE WHEN rn <= residual THEN 1 ELSE 0 END AS frames FROM r"""))
def n07(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("qid")
    q = view(spark, d, "v_clip").withColumn("quota", F.lit(64) * F.col("duration_s") / F.sum("duration_s").over(by)).withColumn("base", F.floor("quota"))
    q = q.withColumn("residual", F.lit(64) - F.sum("base").over(by)).withColumn("rn", F.row_number().over(by.orderBy(F.desc(F.col("quota") - F.col("base")), "slot")))
    return q.select("qid", "slot", (F.col("base") + F.when(F.col("rn") <= F.col("residual"), 1).otherwise(0)).alias("frames"))


@query("n08_allocated")
def n08(spark, d):
    per = view(spark, d, "v_clip").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("slot", "duration_s", "n_frames"))).alias("s"))
    weights, caps = F.transform("s", lambda x: x["duration_s"]), F.transform("s", lambda x: x["n_frames"])
    return per.select("qid", listed(allocate_frames(weights, F.lit(64), F.lit(2), caps)).alias("frames"))


@query("n09_even_split", oracle("SELECT id, greatest(1, 64 // greatest(1, orig_num_cameras)) AS per_camera FROM v_question"))
def n09(spark, d):
    return view(spark, d, "v_question").select("id", N.even_split(F.lit(64), F.col("orig_num_cameras")).alias("per_camera"))


@query("n10_montage", oracle("SELECT id, greatest(1, CAST(round_even(64::DOUBLE / orig_num_cameras, 0) AS BIGINT)) AS t FROM v_question WHERE orig_num_cameras > 0"))
def n10(spark, d):
    return view(spark, d, "v_question").where("orig_num_cameras > 0").select("id", N.montage_frames(F.lit(64), F.col("orig_num_cameras")).alias("t"))


@query("n11_grid", oracle("SELECT qid, slot, CAST(ceil(k / ceil(sqrt(k))) AS BIGINT) AS n_rows, CAST(ceil(sqrt(k)) AS BIGINT) AS n_cols, (slot - 1) // CAST(ceil(sqrt(k)) AS BIGINT) AS r, (slot - 1) % CAST(ceil(sqrt(k)) AS BIGINT) AS c FROM (SELECT qid, slot, count(*) OVER (PARTITION BY qid) AS k FROM v_clip)"))
def n11(spark, d):
    from pyspark.sql import Window

    rows, cols = N.grid(F.col("k"))
    q = view(spark, d, "v_clip").withColumn("k", F.count("*").over(Window.partitionBy("qid"))).withColumn("n_rows", rows).withColumn("n_cols", cols)
    return q.select("qid", "slot", "n_rows", "n_cols", F.floor((F.col("slot") - 1) / F.col("n_cols")).alias("r"), ((F.col("slot") - 1) % F.col("n_cols")).alias("c"))


@query("n12_cells", oracle("SELECT id, k, n_cols * 448 AS width, n_rows * 470 AS height, (448 - 320) // 2 AS x0, (n_rows - 1) * 470 + (470 - h) // 2 AS y0 FROM (SELECT id, orig_num_cameras AS k, 200 + id % 7 AS h, CAST(ceil(sqrt(orig_num_cameras)) AS BIGINT) AS n_cols, CAST(ceil(orig_num_cameras / ceil(sqrt(orig_num_cameras))) AS BIGINT) AS n_rows FROM v_question WHERE orig_num_cameras > 0)"))
def n12(spark, d):
    """The canvas, and where a frame of 320 pixels by 200 to 206 stands in the first cell of the last row."""
    rows, cols = N.grid(F.col("k"))
    q = view(spark, d, "v_question").where("orig_num_cameras > 0").select("id", F.col("orig_num_cameras").alias("k"), (200 + F.col("id") % 7).alias("h"))
    return q.select("id", "k", (cols * 448).alias("width"), (rows * (448 + 22)).alias("height"), N.pasted(F.lit(0), F.lit(448), F.lit(320)).cast("int").alias("x0"), N.pasted(rows - 1, F.lit(470), F.col("h")).cast("long").alias("y0"))


@query("n13_tiling", """WITH s AS (SELECT i, j, row_number() OVER (ORDER BY i * j, i, j) AS o FROM range(1, 7) a(i), range(1, 7) b(j) WHERE i * j <= 6), p AS (SELECT DISTINCT p_size * 40 AS w, 480 AS h FROM part),
x AS (SELECT w, h, i, j, o, abs(w::DOUBLE / h - i::DOUBLE / j) AS diff FROM p, s), m AS (SELECT w, h, min(diff) AS best FROM x GROUP BY w, h),
t AS (SELECT x.w, x.h, i, j, o, row_number() OVER (PARTITION BY x.w, x.h ORDER BY o) AS rn FROM x JOIN m ON m.w = x.w AND m.h = x.h AND x.diff = m.best)
SELECT w, h, arg_max(i, o)::INT AS cols, arg_max(j, o)::INT AS n_rows FROM t WHERE rn = 1 OR w * h > 0.5 * 448 * 448 * i * j GROUP BY w, h""")
def n13(spark, d):
    sizes = table(spark, d, "part").select((F.col("p_size") * 40).alias("w"), F.lit(480).alias("h")).distinct()
    t = N.tiling(F.col("w"), F.col("h"))
    return sizes.select("w", "h", t["cols"].alias("cols"), t["rows"].alias("n_rows"))


@query("n14_resized", "SELECT DISTINCT p_size * 40 AS w, greatest(1, CAST(floor(p_size * 40 * least(1.0::DOUBLE, 448.0::DOUBLE / greatest(p_size * 40, 480))) AS BIGINT)) AS new_w, greatest(1, CAST(floor(480 * least(1.0::DOUBLE, 448.0::DOUBLE / greatest(p_size * 40, 480))) AS BIGINT)) AS new_h FROM part")
def n14(spark, d):
    w, h = N.cell_size(F.col("w"), F.lit(480), 448)
    return table(spark, d, "part").select((F.col("p_size") * 40).alias("w")).distinct().select("w", w.alias("new_w"), h.alias("new_h"))


@query("n15_cosine", "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def n15(spark, d):
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    return e.join(q).select("vec_id", F.round(N.cosine(F.col("embedding"), F.col("q")), 4).alias("sim"))


@query("n15_clip_scores", "SELECT label, round(max(sim), 4) AS best, round(avg(sim), 4) AS mean FROM (SELECT e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) GROUP BY label")
def n15b(spark, d):
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    sim = e.join(q).select("label", N.cosine(F.col("embedding"), F.col("q")).alias("sim"))
    return sim.groupBy("label").agg(F.round(F.max("sim"), 4).alias("best"), F.round(F.avg("sim"), 4).alias("mean"))


@query("n16_durations", "SELECT DISTINCT l_quantity AS n, l_linenumber % 3 * 10 AS fps, coalesce(CASE WHEN l_linenumber % 3 > 0 THEN l_quantity / (l_linenumber % 3 * 10) END, -1.0) AS seconds FROM lineitem")
def n16(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("n"), (F.col("l_linenumber") % 3 * 10).alias("fps")).distinct()
    return rows.select("n", "fps", F.coalesce(N.duration(F.col("n"), F.col("fps")), F.lit(-1.0)).alias("seconds"))


@query("n17_visual_tokens", oracle("SELECT id, orig_num_cameras * 256 + 120 AS input_tokens FROM v_question"))
def n17(spark, d):
    return view(spark, d, "v_question").select("id", N.visual_tokens(F.col("orig_num_cameras"), F.lit(120)).alias("input_tokens"))


@query("n18_half_even", "SELECT event_id, round_even(value, 2) AS r2 FROM events")
def n18(spark, d):
    return table(spark, d, "events").select("event_id", N.half_even(F.col("value"), 2).alias("r2"))


@query("n19_clamped", "SELECT event_id, greatest(0.0, least(1.0, value / 100 - 0.2))::DOUBLE AS v FROM events")
def n19(spark, d):
    return table(spark, d, "events").select("event_id", N.clamp01(F.col("value") / 100 - 0.2).alias("v"))


@query("n20_floors", oracle("SELECT id, greatest(0, least(2, 8 // orig_num_cameras)) AS floor_n FROM v_question WHERE orig_num_cameras > 0"))
def n20(spark, d):
    return view(spark, d, "v_question").where("orig_num_cameras > 0").select("id", N.floor_of(F.lit(2).cast("long"), F.lit(8), F.col("orig_num_cameras")).alias("floor_n"))


@query("v01_strategies", oracle("SELECT id, strategy, CASE strategy WHEN 'uniform' THEN 64 WHEN 'stitched' THEN greatest(1, CAST(round_even(64::DOUBLE / greatest(1, orig_num_cameras), 0) AS BIGINT)) ELSE greatest(1, 64 // greatest(1, orig_num_cameras)) END AS frames FROM (SELECT id, orig_num_cameras, ['uniform', 'stitched', 'decentralized'][id % 3 + 1] AS strategy FROM v_question)"))
def v01(spark, d):
    k = F.greatest(F.lit(1), F.col("orig_num_cameras"))
    name = F.get(F.array(*map(F.lit, ("uniform", "stitched", "decentralized"))), (F.col("id") % 3).cast("int"))
    q = view(spark, d, "v_question").select("id", "orig_num_cameras", name.alias("strategy"))
    n = F.when(F.col("strategy") == "uniform", F.lit(64).cast("long")).when(F.col("strategy") == "stitched", N.montage_frames(F.lit(64), k)).otherwise(N.even_split(F.lit(64), k))
    return q.select("id", "strategy", n.alias("frames"))


@query("v05_call_plan", oracle("SELECT id, i::BIGINT AS call, CASE WHEN i < orig_num_cameras THEN 'camera' ELSE 'aggregate' END AS role FROM v_question, range(0, 20) t(i) WHERE orig_num_cameras > 0 AND i <= orig_num_cameras"))
def v05(spark, d):
    q = view(spark, d, "v_question").where("orig_num_cameras > 0").select("id", "orig_num_cameras", F.explode(F.sequence(F.lit(0).cast("long"), F.col("orig_num_cameras"))).alias("call"))
    return q.select("id", "call", F.when(F.col("call") < F.col("orig_num_cameras"), "camera").otherwise("aggregate").alias("role"))
