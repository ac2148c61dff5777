import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaiq.functions import sampling as N
from mosaiq.functions.udfs import Porter, allocate, allocate_frames, largest_remainder, lcs, rouge


@pytest.mark.parametrize(
    ("weights", "floor", "caps", "expected"),
    [
        ([120, 240, 120], 2, None, [16, 32, 16]),
        ([146.6, 258.1], 2, None, [23, 41]),
        ([146.6, 52.1, 99.5], 2, None, [32, 11, 21]),
        ([52.1, 99.5, 58.3, 152.6], 2, None, [9, 18, 10, 27]),
        ([130, 3], 2, None, [62, 2]),
        ([111.18, 116.98, 9.95, 193.69], 2, [3332, 3506, 298, 5805], [17, 17, 2, 28]),
        ([1, 1, 1, 1], 2, [3332, 3506, 298, 5805], [16, 16, 16, 16]),
        ([None, float("nan"), -1], 0, None, [22, 21, 21]),
        ([], 2, None, []),
        ([1, 1], 2, [3, None], [3, 61]),
    ],
)
def test_allocate(weights, floor, caps, expected):
    assert allocate(weights, 64, floor, caps) == expected


@given(st.lists(st.tuples(st.floats(0, 1000), st.integers(0, 90)), min_size=1, max_size=8), st.integers(1, 200), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_allocate_properties(clips, budget, floor):
    caps = [c for _, c in clips]
    got = allocate([w for w, _ in clips], budget, floor, caps)
    real = [c or budget for c in caps]
    target = min(budget, sum(real))
    assert sum(got) == target and all(0 <= g <= c for g, c in zip(got, real, strict=True))
    least = max(0, min(floor, target // len(clips)))
    assert all(g >= min(least, c) for g, c in zip(got, real, strict=True))


def test_largest_remainder_ties_go_first():
    assert largest_remainder(np.array([1.0, 1.0, 1.0]), 4).tolist() == [2, 1, 1]


def test_allocation_in_spark(spark):
    df = spark.createDataFrame([([120.0, 240.0, 120.0], 64, 2, None), (None, 64, 2, None)], "w array<double>, b int, f int, c array<bigint>")
    assert [r[0] for r in df.select(allocate_frames("w", "b", "f", "c")).collect()] == [[16, 32, 16], None]


def test_indices(spark):
    rows = [(7328, 8), (5, 8), (100, 1), (64, 64), (9, 4)]
    df = spark.createDataFrame(rows, "n int, k int")
    got = df.select(N.uniform_indices(F.col("n"), F.col("k")), N.rounded_indices(F.col("n"), F.col("k")), N.segment_midpoints(F.col("n"), F.col("k"))).collect()
    assert got[0][1] == [0, 1047, 2093, 3140, 4187, 5234, 6280, 7327]
    assert got[0][2] == [457, 1373, 2289, 3205, 4121, 5036, 5952, 6868]
    for (n, k), r in zip(rows, got, strict=True):
        assert r[0] == (list(range(n)) if n < k else np.linspace(0, n - 1, k, dtype=int).tolist())
    assert spark.range(1).select(N.rounded_indices(F.lit(0), F.lit(3)), N.rounded_indices(F.lit(9), F.lit(1))).first()[:] == ([0, 0, 0], [0])


def test_geometry(spark):
    df = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 13)], "k int")
    rows, cols = N.grid(F.col("k"))
    assert [tuple(r) for r in df.select(rows, cols).collect()] == [(1, 1), (1, 2), (2, 2), (2, 2), (4, 4)]
    credit = [("8", "10", 0.8), ("0", "0", 1.0), ("1", "0", 0.0), ("none", "3", 0.0), ("25", "10", 0.0)]
    got = spark.createDataFrame(credit, "p string, g string, e double").select(N.partial_credit(F.col("p"), F.col("g")), "e").collect()
    assert all(abs(a - b) < 1e-12 for a, b in got)


def test_rouge():
    porter = Porter()
    words = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "adjustment": "adjust", "probate": "probat", "controll": "control", "sky": "sky"}
    assert {w: porter.stem(w) for w in words} == words
    assert rouge(["a", "b", "c"], ["a", "c", "d"]) == (2 / 3, 0.0, 2 / 3)
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert lcs(a, b) == table[-1, -1]
