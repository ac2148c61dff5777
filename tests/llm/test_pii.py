import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from mosaiq.llm import pii

# Patterns and rules as the contract states them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


TEXTS = [
    None,
    "",
    "é😀 bob.x@mail.example.com, a@b.c_d@e.f and x@y",
    "1.2.3.4 256.1.1.1 1.2.3.4.5 0001.2.3.255 999999999999999999999.1.1.1 1.1.1.00000000000000000000255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 49927398716000, 4111  1111",
    "+1 (743) 555-3824 +49.30.1234567 +1 23 +12345678901234567 ++1 2345678901",
    "+4111111111111111 4111111111111111.1.1.1",
    "a" * 3000 + "@b.c" + "1" * 3000 + " " + "1-" * 2000 + "." * 50,
    "x@a" + ".b" * 2000,
]


@pytest.mark.parametrize("seed", [1, 2])
def test_base_spans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = TEXTS + ["".join(rng.choice("aé😀019.-+@ ()_%4\n") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.find(df, ["doc_id"]).select("row.doc_id", pii.joined(F.col("base"))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_terms_that_disclose(spark):
    rng = random.Random(3)
    vocab = [f"{a}{b}{c}ord" for a in "abcdefgh" for b in "aeiou" for c in "klmnr"]
    say = lambda: " ".join(rng.choice(vocab) for _ in range(8))
    rows = [(i, "\n".join(say() for _ in range(5))) for i in range(200)]
    rows += [(1000 + i, f"{say()} Grandmaster {say()} boss@secret.example.com {say()}\n{say()}") for i in range(6)]
    rows += [(2000 + i, "copied line of zebrafish text with eve@copy.example.com inside") for i in range(50)]  # one surrounding only
    rows += [(3000, "Only the GRANDMASTER, nobody else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df, ["doc_id"]).select("row.doc_id", "text", "base", "terms", pii.sanitised(F.col("text"), F.concat("base", "terms")).alias("new")).collect()}
    terms = {r["text"][s["start"] : s["end"]].lower() for r in got.values() for s in r["terms"]}
    assert terms == {"grandmaster"}
    assert got[3000]["new"] in ("Only the , nobody else", "Only the [TERM], nobody else")
    assert "[EMAIL]" in got[1000]["new"] and "boss@" not in got[1000]["new"] and "randmaster" not in got[1000]["new"]
    assert got[5]["new"] == rows[5][1] and got[2000]["new"].startswith("copied line of zebrafish")


def test_overlapping_spans_become_one(spark):
    text = "call +378282246310005 now"  # a phone number and a card number
    df = spark.createDataFrame([(1, text, 2)], "doc_id long, text string, base int")
    r = pii.find(df, ["doc_id", "base"]).select(pii.sanitised(F.col("text"), F.col("base")).alias("new"), "row.base").first()
    assert r["new"] == "call [PHONE] now" and r["base"] == 2


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).collect() == []


def test_signatures_and_short_names(spark):
    rng = random.Random(4)
    vocab = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "klmnr"]
    say = lambda: " ".join(rng.choice(vocab) for _ in range(8))
    rows = [(i, "\n".join(say() for _ in range(5))) for i in range(400)]
    rows += [(1000 + i, f"{say()}\nContact Annegret Xu, +49 30 1234 5678\n{say()}") for i in range(20)]  # one line in different texts
    rows += [(2000 + i, "a page about zebrafish by eve@copy.example.com") for i in range(50)]  # copies of one text
    rows += [(3000, "Only Annegret and Xu wrote of zebrafish"), (3001, None)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).select("row.doc_id", "text", "terms").collect()
    terms = {r["text"][s["start"] : s["end"]].lower() for r in got for s in r["terms"]}
    assert terms == {"contact", "annegret", "xu"}


def pieces(line):
    """Lines of up to 64 words, and then up to 20 more that begin with a digit."""
    w, out, at = line.split(), [], 0
    while at < len(w):
        end = min(len(w), at + 64)
        while end < min(len(w), at + 84) and w[end][0] in "+(0123456789":
            end += 1
        out.append(w[at:end])
        at = end
    return [" ".join(x) for x in out]


def disclosing(texts):
    """The terms by definition, in plain loops."""
    lines = [(t, x) for t in texts if t is not None for line in t.split("\n") for x in pieces(line)]
    c_e, c_t, c_et, places = Counter(), Counter(), Counter(), defaultdict(set)
    for t, x in lines:
        entities = set()
        for part in filter(None, brute(x).split(",")):
            kind, a, b = part.split(":")
            value = x[int(a) : int(b)]
            entities.add(kind + ":" + (value.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", value)))
        bare = x
        for p in PATTERNS.values():
            bare = re.sub(p, " ", bare)
        words = lambda s: set(regex.findall(r"\p{L}+", s.lower()))
        c_t.update(words(x))
        for e in entities:
            c_e[e] += 1
            for w in words(bare):
                c_et[e, w] += 1
                places[e, w].add((t, x))
    total, out = max(2, len(lines)), {}
    for (e, w), n in c_et.items():
        d = len(places[e, w])
        t = max(c_t[w], n)
        share = (math.log(n) + math.log(total) - math.log(c_e[e]) - math.log(t)) / (math.log(total) - math.log(c_e[e]))
        chance = c_e[e] * t / total
        if d >= 3 and share >= 0.9 and d > chance and d * math.log(d / chance) - d + chance >= math.log(len(places) / 0.01):
            out[w] = max(out.get(w, 0), share)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_terms_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnr"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = ["\n".join(say(rng.choice([0, 3, 9, 150])) for _ in range(4)) for _ in range(300)]
    for k in range(12):
        entity = rng.choice(["+49 30 123456%02d", "u%02d@mail.example.com", "10.0.0.%d", "4111 1111 1111 1111 %02d"]) % k
        for _ in range(rng.choice([2, 4, 12])):
            texts.append(f"{say(rng.choice([2, 100]))} name{'abcdefghijkl'[k]} {entity} {say(3)}" + (f" sure{'abcdefghijkl'[k]}" if rng.random() < 0.9 else ""))
        texts += [f"only name{'abcdefghijkl'[k]} here"] * rng.choice([0, 0, 1, 9])
    texts += [None, "", texts[-1], texts[301], texts[301]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["term"]: r["share"] for r in pii.disclosing(df).collect()}
    expected = disclosing(texts)
    assert got.keys() == expected.keys() and all(abs(got[w] - expected[w]) < 1e-9 for w in got)
    assert len(got) > 2


def test_long_lines_and_many_matches(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
    long = " ".join(f"{words(6)} +49 30 {rng.randrange(10**7, 10**8)}" for _ in range(2000))  # one line of 80 kB
    rows = [(1, long), (2, "x"), (3, "1.1.1.1 " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    got = {r[0]: (r[1], r[2]) for r in pii.find(df, ["doc_id"]).select("row.doc_id", F.sha2(pii.joined(F.col("base")), 256), F.size("base")).collect()}
    assert time.perf_counter() - began < 60
    assert got[1][1] >= 2000 and got[3][1] == 5000
    assert got[3][0] == hashlib.sha256(brute(rows[2][1]).encode()).hexdigest() and got[1][0] == hashlib.sha256(brute(long).encode()).hexdigest()


def test_many_replacements(spark):
    text = "to a@b.example and 1.2.3.4, " * 500
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).select(pii.sanitised(F.col("text"), F.col("base"))).first()[0]
    assert r == "to [EMAIL] and [IP], " * 500
