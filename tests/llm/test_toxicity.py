import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from mosaiq.llm import toxicity


def corpus(seed=1, n=1200):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeio") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["zuxq" + rng.choice(vocab), "grobl", "kakwy" + rng.choice(vocab)]))
        docs.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, toxic))
    truth = {i: any(x.startswith(("zuxq", "grobl", "kakwy")) for x in t.split()) for i, t in docs}
    return docs, labels, truth


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus()
    out = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), ["doc_id"])
    got = {r["row"]["doc_id"]: r["out"]["score"] for r in out.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(got) == len(docs) and len(held) > 200
    assert np.mean([(got[i] >= 0.3) == truth[i] for i in held]) > 0.98


def test_edges(spark):
    docs = [(1, None, 0.5), (2, "", 0.5), (None, "you idiot moron scum", 0.5), (4, "plain words", 0.5), (4, "plain words", 0.5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = [(r["row"]["doc_id"], r["out"]["score"]) for r in toxicity.score(df, none, ["doc_id", "score"]).collect()]
    assert len(got) == 5 and all(0 <= s <= 1 for _, s in got)
    assert [s >= 0.3 for _, s in got] == [False, False, True, False, False]
    assert toxicity.score(df.limit(0), none, ["doc_id"]).collect() == []


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    rate = np.array([[0.02, 0.7], [0.05, 0.5], [0.1, 0.4]])
    votes = np.stack([np.where(y, rng.random(6000) < b, rng.random(6000) < a) for a, b in rate] , axis=1).astype(np.uint8)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a copy of the first voter
    labels = np.where(rng.random(6000) < 0.03, ~y, y).astype(float)
    post, rates, groups = toxicity.label_model(votes, labels)
    assert groups[0] == groups[3] and len(set(groups)) == 3
    # abstentions carry no evidence, so rates come out somewhat low
    assert np.abs(rates[1][:3] - rate[:, 1]).max() < 0.1 and ((post > 0.5) == y).mean() > 0.96


def test_slices_do_not_change_features():
    a = pa.array(["Word other words " * 30, None, "ein Wörterbuch", ""])
    many, one = (sorted((r + i, int(f)) for i, _, _, parts in toxicity.features(a, limit) for rows, x in parts for r, f in zip(rows, x, strict=True)) for limit in (40, 1 << 20))
    assert many == one


def test_training_holds_no_dense_matrix_of_the_sample():
    rng = np.random.default_rng(3)
    n, k = 20_000, 400  # as many rows and voters as there can be
    at = np.concatenate([[0], np.cumsum(rng.integers(0, 12, n))])
    columns = np.concatenate([rng.choice(k, b - a, replace=False) for a, b in zip(at[:-1], at[1:], strict=True)])
    x = toxicity.Sparse(at, columns, np.ones(at[-1], np.float32), k)
    labels = (rng.random(n) < 0.1).astype(float)
    tracemalloc.start()
    toxicity.label_model(x, labels, rounds=4)
    toxicity.logistic(toxicity.Sparse(2 * at, np.stack([columns, k + columns], axis=1).ravel(), np.ones(2 * at[-1], np.float32), 2 * k), labels, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20  # such a matrix of float32 takes 64 MB


def test_sparse_rows_give_what_dense_ones_do():
    rng = np.random.default_rng(4)
    votes = (rng.random((2500, 30)) < 0.1).astype(np.uint8)  # three blocks, the last one short
    votes[:, 29] = votes[:, 28]
    votes[[0, 1023, 1024, 2499]] = 0
    labels = (rng.random(2500) < 0.1 + 0.6 * votes[:, 0]).astype(float)
    row, column = np.nonzero(votes)
    x = toxicity.Sparse(np.searchsorted(row, np.arange(2501)), column, np.ones(len(row), np.float32), 30)
    assert all(np.allclose(a, b) for a, b in zip(toxicity.label_model(x, labels), toxicity.label_model(votes, labels), strict=True))
    w = toxicity.logistic(x, labels)
    assert np.allclose(w, toxicity.logistic(votes, labels))
    p = 1 / (1 + np.exp(-(votes @ w[:-1] + w[-1])))
    assert np.abs(votes.T @ (p - labels) + w[:-1]).max() < 1e-2 and abs((p - labels).sum() + 1e-3 * w[-1]) < 1e-2  # the gradient is 0
    none = toxicity.Sparse(np.zeros(4, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), 0)
    assert len(toxicity.label_model(none, np.array([0.0, 1, 0]))[0]) == 3 and toxicity.logistic(none, np.zeros(3)).shape == (1,)
