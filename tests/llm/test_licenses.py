import random
import re
import textwrap
from collections import Counter

from mosaiq.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return Counter(zip(w, w[1:], strict=False)) or Counter((x,) for x in w)


def brute(rows, high=400):
    """Lines and whole texts against all templates, by multisets of bigrams; ``high``: any number of words beyond the largest template's bound."""
    out = {}
    known = [(name, grams(t)) for name, t in licenses.TEMPLATES]
    for d, t in rows:
        if t is None:
            continue
        lines = t.split("\n")
        if len(lines) > 1 and len(WORD.findall(t)) <= high:
            lines = [*lines, t]
        for line in lines:
            own = grams(line)
            dice = [(2 * (own & g).total() / (own.total() + g.total()), name) for name, g in known]
            best = max(dice)[0]
            if best >= 0.8:
                for name in {n for s, n in dice if s == best}:
                    k, b = out.get((d, name), (0, 0))
                    out[d, name] = (k + 1, max(b, round(best, 6)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "Released under the MIT License.\nreleased UNDER the mit license!\n" + "word " * 900), (5, "Licensed under the\nApache License, Version 2.0.")]
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["extra"], [w[at], w[at]]]) or ["x"]
            parts.append(" ".join(w) if rng.random() < 0.8 else "some words of text é")
        rows.append((100 + i, "\n".join(parts)))
    rows += [rows[3]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license int")
    got = {(r["doc_id"], r["license"]): (r["segments"], r["dice"]) for r in licenses.scan(df).collect()}
    assert got == brute(rows) and got[5, "Apache-2.0"][0] == 1 and got[4, "MIT"][0] == 4


def test_bounds_keep_all_that_can_reach():
    for m in range(1, 60):
        lo, hi = licenses.bounds(m, 0.8)
        for n in range(1, 120):
            if 2 * min(n, m) / (n + m) >= 0.8:
                assert lo <= n <= hi


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_windows_inside_and_across_lines(spark):
    wrapped = "# This program is free software: you can redistribute it and/or\n# modify it under the terms of the GNU General Public License as\n# published by the Free Software Foundation, either version 3 of the\n# License, or (at your option) any later version.\n"
    rows = [
        (1, "code before\n" * 60 + wrapped + "code after\n" * 60),
        (2, "This file is part of Foo and is licensed under the Apache License, Version 2.0."),
        (3, "A line.\nThis work is licensed under the GNU General Public License, version 3.\nAnother line " + "of words " * 60),
        (4, "Under the stars they read a license, then the free software terms, all of it, with rights."),
        (5, "Both: released under the MIT License. " + "x " * 60 + "Here all rights reserved; released under the MIT License, too."),
        (6, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (r["segments"], r["dice"]) for r in licenses.scan(df, windows=True).collect()}
    assert got == {(1, "GPL-3.0"): (1, 1.0), (2, "Apache-2.0"): (1, 1.0), (3, "GPL-3.0"): (1, 1.0), (5, "MIT"): (2, 1.0), (5, "proprietary"): (1, 1.0)}


def test_exact_copies_score_one(spark):
    rows = []
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        whole = " ".join(t.split())
        rows += [(i, whole), (100 + i, "a line\n" * 300 + "\n".join("# " + x for x in textwrap.wrap(whole, 76)) + "\nb line" * 300), (200 + i, "q r s " * 150 + whole + " u v" * 200)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), windows=True).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = r["dice"]
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert [got[k + i].get(name) for k in (0, 200)] == [1.0] * 2 and got[100 + i].get(name, 0) >= 0.8, name  # a wrapped one may have a line that counts by itself


def test_windows_equal_brute_force_on_one_template(spark):
    rng = random.Random(7)
    template = "to be or not to be that is the question"
    known = grams(template)
    rows = []
    for i in range(60):
        w = template.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["to", "be", "x", "question"])
        rows.append((i, " ".join(rng.choices("be x y to".split(), k=20)) + " " + " ".join(w) + " " + " ".join(rng.choices("is x y the".split(), k=30))))
    got = {r["doc_id"]: r["dice"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=(("H", template),), windows=True).collect()}
    for i, t in rows:
        w = t.split()
        best = max(2 * (own & known).total() / (own.total() + known.total()) for a in range(len(w)) for b in range(a + 2, min(len(w), a + 16) + 1) for own in [grams(" ".join(w[a:b]))])
        assert got.get(i) == (round(best, 6) if best >= 0.8 else None), (t, best)


def test_key_words_lose_no_window():
    keys = set(licenses.key_words(licenses.TEMPLATES, licenses.LEAST))
    for _, text in licenses.TEMPLATES:
        own = grams(text)
        m, left = own.total(), sum(c for g, c in own.items() if not keys & set(g))
        assert all(2 * min(left, n) / (n + m) < licenses.LEAST for n in range(1, 4 * m))
