import math

import numpy as np
import pytest

from mosaiq.llm import ann


def brute(rows, k):
    ok = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = {}
    for q in ok:
        if q % 20 == 0:
            ranked = sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q))[:k]
            out[q] = [i for _, i in ranked]
    return out, ok


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in (centres[i % 5] + rng.normal(size=8)).astype(np.float32)]) for i in range(900)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (1080, [float("inf")] + [1.0] * 7), (1100, [1.0]), (None, [1.0] * 8)]
    df = frame(spark, rows)
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), row_block=200, query_block=16).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    expected, ok = brute(rows, 20)
    assert set(got) == set(expected)
    recall = np.mean([len({v for v, _ in got[q].values()} & set(expected[q])) / 20 for q in expected])
    assert recall >= 0.98
    for q, ranked in got.items():
        assert sorted(ranked) == list(range(1, 21))
        assert all(abs(s - ok[q] @ ok[v]) < 1e-12 for v, s in ranked.values())


def test_hot_vector_ties_and_few_candidates(spark):
    same = [(i, [1.0] + [0.5] * 7) for i in range(400)]
    df = frame(spark, same)
    got = ann.search(df, df.where("vec_id % 20 = 0"), row_block=100).collect()
    per = {}
    for r in got:
        per.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q, ranked in per.items():
        assert [v for _, v in sorted(ranked)] == [i for i in range(22) if i != q][:20]
    few = frame(spark, [(0, [1.0] * 8), (1, [2.0] * 8), (1, [2.0] * 8), (2, [-1.0] * 8)])
    assert [(r["rank"], r["vec_id"]) for r in ann.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_edges(spark):
    df = frame(spark, [])
    assert ann.search(df, df).collect() == []
    clash = spark.createDataFrame([(0, [1.0, 2.0], 9), (5, [2.0, 1.0], 9)], "vec_id long, embedding array<float>, rank int")
    assert [tuple(r)[:3] for r in ann.search(clash, clash.where("vec_id = 0")).collect()] == [(0, 1, 5)]


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_error_bound_holds(dim):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(2000, dim)), rng.normal(size=(20, dim))
    centre, turn = v.mean(axis=0), ann.rotation(dim, 7)
    bits, scalars = ann.encode(v, centre, turn)
    assert bits.shape == (2000, -(-dim // 64)) and bits.dtype == np.uint64
    turned = q @ turn
    plane, low, step, total = ann.planes(turned)
    ones = np.bitwise_count(bits).sum(axis=1)
    held = []
    for i in range(len(q)):
        guess, bound = ann.estimate(q[i], plane[i], low[i], step[i], total[i], q[i] @ centre, bits, ones, scalars, 3.0)
        held.append(np.mean(np.abs(guess - v @ q[i]) <= bound))
        level = np.rint((turned[i] - low[i]) / step[i])  # the bit counts are the plain sums
        signs = np.where((v - centre) @ turn > 0, 1, -1) / np.sqrt(dim)
        assert np.allclose(guess, signs @ (low[i] + step[i] * level) * scalars[:, 0] / scalars[:, 1] + q[i] @ centre)
    assert np.mean(held) > 0.99


def test_recall_on_the_even_table(spark):
    """The test vectors are spread evenly over all directions, the hardest case for codes."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 64))
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), row_block=1000, query_block=64).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = v[::20] @ v.T
    s[np.arange(150), np.arange(150) * 20] = -9
    recall = np.mean([len(got[20 * i] & set(np.argsort(-x)[:20].tolist())) / 20 for i, x in enumerate(s)])
    assert recall >= 0.97
