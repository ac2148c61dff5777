import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mosaiq.llm import maxent


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def corpus(seed=1, n=500):
    rng = random.Random(seed)
    pairs = [("new", "york"), ("machine", "learning"), ("São", "Paulo")]
    vocab = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 60)):
            w += list(rng.choice(pairs)) if rng.random() < 0.3 else [rng.choice(vocab) if rng.random() < 0.9 else f"rare{rng.randrange(4000)}"]
        rows.append((i, " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (None, "null id"), (3, "twice"), (3, "twice")]


def test_base_scores_and_gain(spark, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 1000)
    rows = corpus()
    got = maxent.score(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")).collect()
    train = Counter(t for d, x in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1 for t in tokens(x))
    total, distinct = sum(train.values()), len(train)
    expected = sorted(
        (repr(d), d is not None and zlib.crc32(str(d).encode()) % 5 == 1, len(t), sum(x in train for x in t), total, round(sum(math.log10((train[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in t), 6))
        for d, x in rows
        for t in [tokens(x)]
    )
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)


def made(rng, n, tail=900):
    hashes = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
    counts = rng.integers(8, 90, len(hashes) + 1) * rng.choice([1, 50], len(hashes) + 1)
    return maxent.Vocabulary(np.append(hashes, maxent.END), counts, int(counts.sum()) + tail)


@pytest.mark.parametrize(("n", "tail"), [(0, 0), (1, 5), (14, 0), (15, 7), (16, 1), (50, 900), (700, 0)])
def test_probabilities_sum_to_one(n, tail):
    rng = np.random.default_rng(n)
    voc = made(rng, n, tail)
    weights = rng.normal(size=(1 << 12, maxent.BRANCH)).astype(np.float32)
    leaves = np.arange(len(voc.hashes) + 1)
    feature = np.repeat(np.array([[1], [2], [3]], np.uint64), len(leaves), axis=1)
    log_p = np.zeros(len(leaves))
    for token, node, branch, buckets in voc.choose(leaves, feature, 12):
        z = maxent.logits(weights, voc.prior, buckets, node).astype(np.float64)
        np.add.at(log_p, token, z[np.arange(len(branch)), branch] - np.log(np.exp(z).sum(axis=1)))
    assert abs(np.exp(log_p).sum() - 1) < 1e-5


def test_tree_follows_frequency():
    voc = made(np.random.default_rng(2), 300)
    depth = np.diff(voc.offsets)[:-1]
    order = np.argsort(-voc.counts)
    assert (np.diff(depth[order]) >= 0).all() and depth.min() < depth.max()


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    voc = made(rng, 40)
    leaves = rng.integers(0, 41, 300)
    features = rng.integers(0, 9, (3, 300)).astype(np.uint64)
    w = rng.normal(size=(1 << 12, maxent.BRANCH)).astype(np.float32)

    def loss(w):
        out = 0.0
        for _, node, branch, buckets in voc.choose(leaves, features, 12):
            z = maxent.logits(w.astype(np.float64), voc.prior, buckets, node)
            out -= (z[np.arange(len(branch)), branch] - np.log(np.exp(z).sum(axis=1))).sum()
        return out

    g, seen = np.zeros((1 << 12, maxent.BRANCH), np.int64), np.zeros(1 << 12, np.int64)
    maxent.gradient(voc, w, leaves, features, g, seen)
    assert seen.sum() == 3 * np.diff(voc.offsets)[leaves].sum()
    for b in rng.choice(np.flatnonzero(seen), 10):
        for k in (0, 3):
            up, down = w.astype(np.float64), w.astype(np.float64)
            up[b, k] += 1e-4
            down[b, k] -= 1e-4
            numeric = (loss(up) - loss(down)) / 2e-4
            assert abs(numeric - g[b, k] / maxent.UNIT) < 1e-3 * max(1, seen[b])


def test_scores_do_not_depend_on_partitions_and_use_context(spark, monkeypatch):
    monkeypatch.setattr(maxent, "LEAST", 2)
    rows = corpus(5, 800)
    got = []
    for parts in (3, 11):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got.append({(r["doc_id"], r["n_tokens"]): r["score"] for r in maxent.score(df).collect()})
    assert got[0].keys() == got[1].keys() and all(abs(got[0][k] - got[1][k]) < 1e-6 for k in got[0])
    probe = [(10_000 + i, f"{a} {b}") for i, (a, b) in enumerate([("new", "york"), ("machine", "york"), ("machine", "learning"), ("new", "learning")])]
    s = {r["doc_id"] - 10_000: r["score"] for r in maxent.score(spark.createDataFrame(rows + probe, "doc_id long, text string")).collect() if (r["doc_id"] or 0) >= 10_000}
    assert s[0] > s[1] + 0.3 and s[2] > s[3] + 0.3  # the second word is told by the first


def test_every_text_counts_whole(spark):
    rows = [(i, "a b " * 40) for i in range(30)] + [(100, "b a " * 300_000 + "odd")]
    got = {r["doc_id"]: r for r in maxent.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["n_tokens"] == 600_002 and got[100]["score"] < got[0]["score"] < 0


def test_tokens_do_not_depend_on_batches():
    texts = ["A b\tc", None, "", "x y z"]
    (_, _, t, off) = next(maxent.token_slices(pa.array(texts)))
    assert np.diff(off).tolist() == [len(tokens(x)) for x in texts] and (t[off[1:] - 1] == maxent.END).all()


def test_empty_table(spark):
    assert maxent.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
