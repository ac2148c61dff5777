import random


from mosaiq.llm import mixing

import corpus_pipeline
from mosaiq.llm.common import cut


def corpus():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgo") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(0, say(30)), (1, say(40))]
    docs, kind = [], {}
    for i in range(120):
        docs.append((i, say(80), "en", f"s{i % 4}"))
        kind[i] = "clean"
    for i in range(200, 230):
        w = say(60).split()
        for _ in range(5):
            w.insert(rng.randrange(len(w)), rng.choice(["grumfl", "zorbiq"]))
        docs.append((i, " ".join(w), "en", "s0"))
        kind[i] = "toxic"
    for i in range(300, 310):  # near copies and exact copies of clean ones
        w = docs[i - 300][1].split()
        if i % 2:
            w[40] = "changed"
        docs.append((i, " ".join(w), "en", "s1"))
        kind[i] = "copy"
    for i in range(400, 406):
        docs.append((i, say(20) + " " + bench[i % 2][1] + " " + say(20), "en", "s2"))
        kind[i] = "contaminated"
    docs.append((500, say(30) + " someone@mail.example.com " + say(30), "de", "s3"))
    kind[500] = "private"
    docs += [(600, None, None, None), (601, "", "en", "s0"), (602, "", "en", "s0")]
    kind |= {600: "clean", 601: "clean", 602: "clean"}
    labels = [(i, 0, int(k == "toxic")) for i, k in kind.items() if i < 300]
    return docs, kind, bench, labels


def test_stages(spark, tmp_path):
    docs, kind, bench, labels = corpus()
    rows = [(*d, None if d[1] is None else len(d[1])) for d in docs]
    base = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    now, left = spark.read.parquet(f"{base}/documents.parquet"), set(kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, base), name)
        assert now.columns == corpus_pipeline.COLUMNS
        gone = {"toxicity": "toxic", "near_dedup": "copy", "decontamination": "contaminated"}.get(name)
        left -= {i for i in left if kind[i] == gone}
        assert sorted(r["doc_id"] for r in now.select("doc_id").collect()) == sorted(left), name
    text = {r["doc_id"]: r for r in now.collect()}
    assert "[EMAIL]" in text[500]["text"] and "someone" not in text[500]["text"] and text[500]["n_chars"] == len(text[500]["text"])
    assert all(text[i]["text"] == dict((d[0], d[1]) for d in docs)[i] for i in left if kind[i] == "clean")
    got = corpus_pipeline.run(spark, base)
    assert got.columns == ["doc_id", *mixing.LEVELS, "n_tokens", "copies"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(now).collect()))


def test_empty_tables(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    assert corpus_pipeline.run(spark, base).collect() == []
