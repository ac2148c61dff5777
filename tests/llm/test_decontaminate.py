import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = {}
    windows = []
    for i, t in items:
        w = words(t)
        if i is not None and w:
            windows += [(i, tuple(w[a : a + 13])) for a in range(max(1, len(w) - 12))]
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in windows:
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit |= set(range(a, a + len(x)))
                    found.add(str(i))
        ids = ",".join(sorted(found))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["é", "Ünï", "42"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(12)] + [(50, None), (51, "..."), (None, say(20)), (60, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1)
            parts += [say(rng.randint(0, 40)), "; ".join(w[a : a + rng.randint(0, 30)]).upper() if rng.random() < 0.5 else " ".join(w[: rng.randint(0, 30)])]
        docs.append((d, " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "w1 " * 40)], items


def run(spark, docs, items, **kw):
    found = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], **kw)
    got = D.contaminated(found).select("row.doc_id", "n_words", "n_hit", F.size("items").alias("k"), F.sha2(F.array_join("items", ","), 256).alias("h"), "contaminated")
    return {r[0]: tuple(r)[1:] for r in got.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    docs, items = made(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_a_hits_table_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "SMALL", -1)
    docs, items = made(4)
    assert run(spark, docs, items) == brute(docs, items)


def test_repeated_words_and_long_texts(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(5000)]
    long = [rng.choice(vocab) for _ in range(150_000)]
    items = [(1, "same " * 3000), (2, " ".join(long[70_000:70_400])), (3, " ".join(long[149_990:] + ["x"] * 20)), (4, " ".join(long[-13:]))]
    docs = [(1, "same " * 4000), (2, " ".join(long)), (3, "same " * 12)] + [(10 + i, " ".join(long[70_000:70_400])) for i in range(50)]
    got = run(spark, docs, items)
    digest = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert got[1] == (4000, 4000, 1, digest("1"), True) and got[3][1:3] == (0, 0)
    assert got[2] == (150_000, 413, 2, digest("2", "4"), False)
    assert {got[10 + i] for i in range(50)} == {(400, 400, 1, digest("2"), True)}


def test_edges(spark):
    docs = [(1, "one two three"), (1, "one two three"), (None, "one two three")]
    df = spark.createDataFrame([(*r, 5, "x") for r in docs], "doc_id long, text string, decon int, row string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in D.contaminated(D.decontaminate(df, none, ["doc_id", "row"])).collect()] == [0, 0, 0]
    some = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    assert [r["n_hit"] for r in D.contaminated(D.decontaminate(df, some, ["doc_id"])).collect()] == [2, 2, 2]
    assert D.decontaminate(df.limit(0), some, ["doc_id"]).collect() == []
