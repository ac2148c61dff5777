import hashlib
import random
from collections import defaultdict
from fractions import Fraction

from mosaiq.llm import mixing

WEIGHTS = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2}, "source": {}}


def share_out(given, caps, weights):
    """Budgets of children by repeated sharing: who can't use a share is filled, and the rest is shared again."""
    got, open_ = {}, set(caps)
    while open_:
        left = given - sum(got.values())
        total = sum(weights[c] for c in open_)
        full = {c for c in open_ if caps[c] <= Fraction(left * weights[c], total)}
        if not full:
            got |= {c: left * weights[c] // total for c in open_}
            break
        got |= {c: caps[c] for c in full}
        open_ -= full
    return got


def brute(rows, weights, share, epochs, seed):
    leaves = defaultdict(list)
    for d, t, lang, source, domain in rows:
        leaves[domain or "", lang or "", source or ""].append((d, len((t or "").split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    total = sum(tokens.values())
    given = {(): min(total * share[0] // share[1], total * epochs)}
    for depth, level in enumerate(mixing.LEVELS):
        new = {}
        for up, budget in given.items():
            caps = defaultdict(int)
            for k, n in tokens.items():
                if k[:depth] == up:
                    caps[k[: depth + 1]] += n * epochs
            new |= share_out(budget, caps, {c: weights.get(level, {}).get(c[-1], 1) for c in caps})
        given = new
    out = []
    for k, docs in leaves.items():
        full, rest = divmod(given[k], tokens[k]) if tokens[k] else (0, 0)
        order = sorted(docs, key=lambda x: (hashlib.md5(f"{seed}:{full}:{'null' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] is not None, x[0] or 0, x[1]))
        run = 0
        for d, n in order:
            run += n
            copies = full + (rest > 0 and run <= rest)
            if copies:
                out.append((d, *k, n, copies))
    return sorted(out, key=repr)


def made(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        words = rng.choice([0, 1, 5, 40])
        rows.append((i, None if rng.random() < 0.05 else " w\t" * words, "en" if hot else rng.choice(["en", "de", None]), "s0" if hot else f"s{rng.randrange(6)}", "a" if hot else rng.choice("ab")))
    return rows + [(7, "x y z", "en", "s0", "a"), (7, "x y z", "en", "s0", "a"), (None, "q r", "en", "s0", "a")]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    for seed, share, epochs in ((1, (3, 5), 3), (2, (9, 5), 2), (3, (50, 1), 2), (4, (1, 50), 3)):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, dom string")
        got = mixing.mix(df, domain="dom", weights=WEIGHTS, share=share, epochs=epochs, seed=seed)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, WEIGHTS, share, epochs, seed)


def test_shortage_goes_to_siblings_first():
    caps = {"a": 10, "b": 1000, "c": 1000}
    assert share_out(300, caps, {"a": 1, "b": 1, "c": 1}) == {"a": 10, "b": 145, "c": 145}


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, digest int, bucket int"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    nothing = spark.createDataFrame([(1, None, None, None, 1, 2), (2, "", "en", "s", 1, 2)], schema)
    assert mixing.mix(nothing).collect() == []
