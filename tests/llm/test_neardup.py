import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mosaiq.llm import neardup, textkit

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """{position: smallest doc_id of its class} by comparing all pairs."""
    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8:
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[root(i)].append(rows[i][0])
    return {i: min(least[root(i)]) for i in range(len(rows))}


def made(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ñu", "ß"]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [w[at], w[at]]])
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 20, 60, 150]))))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = made(seed, 150)
    rows += [(1000, None), (1001, ""), (1002, " .,;"), (1003, "one two"), (1004, "ONE, two!")]
    expected = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[i][0]: c for i, c in expected.items()}
    assert got[1004] == 1003 and got[1000] == 1000 and got[1001] == 1001


def test_hot_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(500)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 800 and {r["class_id"] for r in got} == {0} and {r["class_size"] for r in got} == {800}


def test_group_of_copies_with_many_edits(spark):
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(260):  # up to nine edits: some are linked to the base, some to each other only, some to none
        w = list(base)
        for _ in range(rng.randrange(10)):
            w[rng.randrange(120)] = f"x{i}" if rng.random() < 0.6 else f"y{rng.randrange(5)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + 10 * i + j, rows[i][1] + " end" * j) for i in range(0, 260, 9) for j in (1, 2)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[i][0]: c for i, c in brute(rows).items()}


def test_unique_keeps_one_row_of_each_class(spark):
    t1, t2 = "a b c d e f g h", "k l m n o p q r"
    keep = lambda rows: sorted(map(tuple, neardup.unique(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert keep([(3, t1), (5, t1), (5, t2)]) == [(3, t1), (5, t2)]
    assert keep([(1, t1), (2, t1), (2, t2), (1, t2)]) == [(1, t1), (1, t2)]
    assert keep([(None, t1), (None, t1), (7, t1), (None, t2), (None, t2)]) == [(7, t1), (None, t2)]
    assert keep([(1, ""), (1, ""), (2, None), (None, None)]) == sorted([(1, ""), (1, ""), (2, None), (None, None)], key=str)
    assert keep([]) == []


def test_edges(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    clash = spark.createDataFrame([(1, "a b c d e f", 9, 8), (1, "a b c d e f", 9, 8), (None, "a b c d e f", 9, 8)], "doc_id long, text string, node int, bands int")
    assert [r["class_id"] for r in neardup.classes(clash).collect()] == [1, 1, 1]


def test_signature_estimates_weighted_jaccard():
    rng = random.Random(3)
    a = [f"s{i}" for i in range(40) for _ in range(rng.choice([1, 1, 2, 3, 7]))]
    b = [x for x in a if rng.random() < 0.8] + [f"t{i}" for i in range(10)]
    exact = jaccard(Counter(a), Counter(b))
    m, got = 4096, []
    for side in (a, b):
        _, _, h, off = next(textkit.word_slices(pa.array([" ".join(side)])))
        shingles, docs, weight, _ = neardup.bags(h, off)
        got.append(neardup.bag_minhash(shingles, docs, weight, 1, m)[0])
    assert abs(np.mean(got[0] == got[1]) - exact) < 4 * (exact * (1 - exact) / m) ** 0.5


def test_hashing_does_not_depend_on_slices():
    texts = ["Ab cd, éf " * 50, "", None, "x" * 300 + " y", "12 ab"] * 7
    runs = [[(i, j, h, o) for i, j, h, o in textkit.word_slices(pa.array(texts), limit)] for limit in (64, 1 << 20)]
    flat = [np.concatenate([h for _, _, h, _ in r]) for r in runs]
    assert (flat[0] == flat[1]).all()
    assert len(flat[0]) == sum(len(words(t)) for t in texts)
