import json

from pyspark.sql import functions as F

from mosaiq.sources import readers, writers
from mosaiq.streaming import results


def test_question_files(spark, tmp_path):
    items = [
        {"question": "q0", "answer": "A", "video_paths": ["a.mp4"], "options": {"B": "y", "A": "x"}, "scene_id": "s", "stsg_metadata": {"cameras": ["c1"], "num_cameras": 1}},
        {"question": "no answer", "video_paths": []},
        {"question": None, "answer": None, "video_paths": None},
        {"question": "q3", "answer": {"k": "V"}, "video_paths": [], "question_type": "open"},
    ]
    (tmp_path / "qa_spatial.json").write_text(json.dumps(items))
    (tmp_path / "qa_other.json").write_text("[]")
    got = readers.questions(spark, str(tmp_path), ["spatial", "absent"]).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [0, 2, 3]
    assert got[0]["key"] == "s_spatial_0" and got[0]["candidates"] == ["A. x", "B. y"] and got[0]["correct_answer"] == "a" and got[0]["needed_cameras"] == ["c1"]
    assert got[1]["key"] == "scene_spatial_2" and got[1]["video_paths"] is None
    assert got[2]["correct_answer"] == '{"k":"V"}' and got[2]["candidates"] is None and got[2]["key"] == "scene_open_3"


def test_summary_cache(spark, tmp_path):
    base = tmp_path / "clips.jsonl"
    base.write_text('{"video": "a", "summary": "old"}\n\n{broken\n{"video": "b", "summary": "x", "error": "oom"}\n')
    (tmp_path / "clips_shard1.jsonl").write_text('{"video": "a", "summary": "new", "prompt_ver": "v1"}\n{"video": "c", "summary": "s", "prompt_ver": "v2"}\n')
    files = readers.cache_files([str(base)], [str(p) for p in tmp_path.iterdir()])
    assert [f.rsplit("/", 1)[-1] for f in files] == ["clips.jsonl", "clips_shard1.jsonl"]
    assert readers.cache_files(["x_shard2.jsonl"], []) == ["x_shard2.jsonl"]
    assert {r["video"]: r["summary"] for r in readers.summary_cache(spark, files).collect()} == {"a": "new"}


def test_results_tree_and_sinks(spark, tmp_path):
    d = tmp_path / "m" / "ds" / "uniform"
    d.mkdir(parents=True)
    (d / "m_ds_uniform_spatial.json").write_text(json.dumps({"k1": {"is_correct": True}, "k2": {"is_correct": False}}))
    (d / "m_ds_uniform_spatial_judge_rts.json").write_text("{}")
    rows = readers.results_tree(spark, str(tmp_path)).select("model", "strategy", "category", "key", F.try_variant_get("entry", "$.is_correct", "boolean").alias("ok")).orderBy("key").collect()
    assert [tuple(r) for r in rows] == [("m", "uniform", "spatial", "k1", True), ("m", "uniform", "spatial", "k2", False)]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a/b", "ds", "uniform", "c", 1)], "model string, dataset string, strategy string, category string, x int")
    writers.results(df, out)
    back = spark.read.json(out).collect()
    assert [(r["model"], r["x"]) for r in back] == [("a_b", 1)]
    for _ in range(2):
        writers.report(df, str(tmp_path / "txt"), F.concat_ws(" ", "model", "x"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "txt")).collect()] == ["a/b 1", ""] * 2
    assert writers.markdown_table(df, ["model", "x"], ["x"]) == "| model | x |\n|:--|--:|\n| a/b | 1 |"
    writers.judge_sidecar(spark.createDataFrame([("k", 0.5)], "key string, judge_score double"), str(tmp_path / "judge"), "j", "rts")
    assert spark.read.json(str(tmp_path / "judge/header")).first()["mean_score"] == 0.5
    writers.lines(df, "x", str(tmp_path / "lines"))
    writers.blocked(df, str(tmp_path / "tsv"))
    writers.subset(df, str(tmp_path / "sub"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "tsv")).first()["model"] == "a/b"
    log = spark.createDataFrame([(1, [("text", "hi"), ("image", "data")])], "id int, content array<struct<type: string, body: string>>")
    writers.request_log(log, str(tmp_path / "log"))
    assert [c["body"] for c in spark.read.json(str(tmp_path / "log")).first()["content"]] == ["hi", "<image>"]


def test_prices_categories_and_sources(spark, tmp_path):
    text = "# prices\ngpt-x:\n  input: 1.5\n  output: 2\nlocal: {input: 0, output: 0, cached_input: 0.1}\nbad:\n  input: x\n"
    assert sorted(tuple(r) for r in readers.price_table(spark, text).collect()) == [("gpt-x", 1.5, 2.0, None), ("local", 0.0, 0.0, 0.1)]
    assert readers.price_table(spark, "::").count() == 0
    assert readers.price_table(spark, "a: {input: 1:2, output: 3}\nb: {input: 1, output: 2}").count() == 0
    assert [tuple(r) for r in readers.price_table(spark, "m: {input: 1, output: 2, cached_input: 0.5}  # now").collect()] == [("m", 1.0, 2.0, 0.5)]
    config = "categories:\n  meva: [spatial, 'counting']  # two\n  agibot:\n    - temporal\nother: 1\n"
    assert readers.category_config(config) == {"meva": ["spatial", "counting"], "agibot": ["temporal"]} and readers.category_config("categories:\n  meva: {") == {}
    rows = [tuple(r) for r in readers.categories(spark, readers.category_config(config)).orderBy("dataset", "pos").collect()]
    assert rows[:5] == [("agibot", 0, "temporal"), ("ego-exo4d", 0, "temporal"), ("ego-exo4d", 1, "event_ordering"), ("ego-exo4d", 2, "best_camera"), ("ego-exo4d", 3, "summarization")] and len(rows) == 12
    assert [tuple(r) for r in readers.categories(spark, {"a": ["y", "x"]}, {"a": ["z"], "b": ["w"]}).orderBy("dataset", "pos").collect()] == [("a", 0, "y"), ("a", 1, "x"), ("b", 0, "w")]
    (tmp_path / "one.json").write_text('[{"task_type": "t", "options": ["A", "B"]}, {"task_type": "t"}]')
    (tmp_path / "old.json").write_text('[{"a": 1}]')
    kept, counts = readers.by_source(spark, {"s": [str(tmp_path / "one.json"), str(tmp_path / "old.json")]}, ["old.json"])
    assert kept.count() == 2 and {r["name"]: r["items"] for r in counts.collect()} == {"one.json": 2, "old.json": 1}
    assert [len(r["options"]) for r in readers.chance_rows(spark, str(tmp_path / "one.json")).collect()] == [2, 0]


def test_result_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"id": "1", "method": "m", "backend": "b", "pass_idx": 0, "task_type": "t", "correct": True, "ts": "2024-01-01T00:00:00"}
    (src / "a.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"id": "2", "correct": None}) + "\n")
    (src / "b.json").write_text(json.dumps(row) + "\n")
    seen = results.result_stream(spark, str(src))
    q = seen.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.table("seen").collect()) == ["1", "2"]
    rows = spark.table("seen").withColumn("ts", F.col("ts").cast("timestamp"))
    got = results.accuracy_stream(rows).first()
    assert (got["n_correct"], got["n"], got["acc"]) == (1, 2, 0.5)


def test_markdown_table_holds_all_rows(spark):
    got = writers.markdown_table(spark.range(1500).selectExpr("id", "id * 2 AS x"), ["id", "x"], ["id"]).split("\n")
    assert got[2:] == [f"| {i} | {2 * i} |" for i in range(1500)]
