"""The operators that built-in expressions can't state: capped frame allocation and ROUGE. Both are Arrow-batched."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def largest_remainder(weights: np.ndarray, budget: int) -> np.ndarray:
    """Whole shares of a budget in proportion to weights; what is left goes to the largest fractions, the first of equals first."""
    total = weights.sum()
    quota = budget * (weights / total if total > 0 else np.full(len(weights), 1 / max(1, len(weights))))
    share = np.floor(quota).astype(np.int64)
    order = np.argsort(-(quota - share), kind="stable")
    share[order[: budget - share.sum()]] += 1
    return share


def allocate(weights, budget: int, floor: int, caps=None) -> list[int]:
    """N-08: frames per clip, in proportion to weights, within caps, with a floor where a clip can hold it.

    Weights that aren't positive count as 0; if all are, the split is even. A cap that is null or 0 doesn't bind. What a capped clip can't
    take is shared out among the others until all is given. Clips below the floor then get single frames from the clip with most above it.
    """
    w = np.array([x if x is not None and x == x and x > 0 else 0.0 for x in weights], float)
    k = len(w)
    if not k:
        return []
    if not w.any():
        w[:] = 1
    cap = np.array([budget if not c else int(c) for c in (caps if caps is not None and len(caps) else [None] * k)], np.int64)
    target = int(min(budget, cap.sum()))
    got = np.zeros(k, np.int64)
    open_ = np.arange(k)
    while len(open_) and got.sum() < target:
        give = np.minimum(largest_remainder(w[open_], target - int(got.sum())), cap[open_] - got[open_])
        got[open_] += give
        open_ = open_[got[open_] < cap[open_]]
        if not give.any():
            got[open_[: target - int(got.sum())]] += 1
            break
    least = np.minimum(max(0, min(floor, target // k)), cap)
    for i in range(k):
        while got[i] < least[i]:
            spare = np.where(np.arange(k) == i, 0, got - least)
            if spare.max() <= 0:
                break
            got[int(np.argmax(spare))] -= 1
            got[i] += 1
    return got.tolist()


@F.pandas_udf(T.ArrayType(T.LongType()))
def allocate_frames(weights: pd.Series, budget: pd.Series, floor: pd.Series, caps: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else allocate(w, int(b), int(f), c) for w, b, f, c in zip(weights, budget, floor, caps, strict=True)])


class Porter:
    """Porter's stemmer with the extended rules that the usual ROUGE scorers apply; words of up to three letters stay as they are."""

    # Irregular words, and the suffix rules, (suffix, replacement), in the order in which they are tried.
    IRREGULAR = {
        "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
        "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
    }
    STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log")]
    STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

    @staticmethod
    def shape(w: str) -> str:
        """c and v for each letter."""
        out = ""
        for i, c in enumerate(w):
            out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
        return out

    def measure(self, w: str) -> int:
        return len(re.findall("v+c", self.shape(w)))

    def cvc(self, w: str) -> bool:
        """Whether a word ends like a short syllable; two letters, vowel and consonant, are one too."""
        shape = self.shape(w)
        return (shape[-3:] == "cvc" and w[-1] not in "wxy") or shape == "vc"

    def plural(self, w: str) -> str:
        if w.endswith("ies"):
            return w[:-1] if len(w) == 4 else w[:-2]
        if w.endswith("sses"):
            return w[:-2]
        return w if w.endswith("ss") or not w.endswith("s") else w[:-1]

    def past(self, w: str) -> str:
        if w.endswith("ied"):
            return w[:-1] if len(w) == 4 else w[:-2]
        if w.endswith("eed"):
            return w[:-1] if self.measure(w[:-3]) > 0 else w
        stem = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and "v" in self.shape(w[: -len(x)])), None)
        if stem is None:
            return w
        if stem.endswith(("at", "bl", "iz")):
            return stem + "e"
        if len(stem) > 1 and stem[-1] == stem[-2] and self.shape(stem)[-1] == "c":
            return stem if stem[-1] in "lsz" else stem[:-1]
        return stem + "e" if self.measure(stem) == 1 and self.cvc(stem) else stem

    def suffixed(self, w: str) -> str:
        if w.endswith("alli") and self.measure(w[:-4]) > 0:
            return self.suffixed(w[:-2])
        for suffix, new in self.STEP2:
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                base = w[:-3] if suffix == "logi" else stem  # its l counts as the stem's
                return stem + new if self.measure(base) > 0 else w
        return w

    def stem(self, w: str) -> str:
        if len(w) <= 3:
            return w
        if w in self.IRREGULAR:
            return self.IRREGULAR[w]
        w = self.past(self.plural(w))
        if w.endswith("y") and len(w) > 2 and self.shape(w[:-1])[-1] == "c":
            w = w[:-1] + "i"
        w = self.suffixed(w)
        for suffix, new in self.STEP3:
            if w.endswith(suffix):
                w = w[: -len(suffix)] + new if self.measure(w[: -len(suffix)]) > 0 else w
                break
        for suffix in self.STEP4:
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if suffix != "ion":
                    w = stem if self.measure(stem) > 1 else w
                    break
                if self.measure(stem) > 1 and stem[-1:] in ("s", "t"):
                    w = stem
                break
        if w.endswith("e") and (self.measure(w[:-1]) > 1 or (self.measure(w[:-1]) == 1 and not self.cvc(w[:-1]))):
            w = w[:-1]
        return w[:-1] if w.endswith("ll") and self.measure(w[:-1]) > 1 else w


def _tokens(text: str | None, porter: Porter, known: dict[str, str]) -> list[str]:
    out = []
    for w in re.findall("[a-z0-9]+", (text or "").lower()):
        if w not in known:
            known[w] = porter.stem(w)
        out.append(known[w])
    return out


def _f1(hits: int, n: int, m: int) -> float:
    return 2 * hits / (n + m) if hits else 0.0


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with bit vectors."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        match = row & where.get(y, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def rouge(reference: list[str], generated: list[str]) -> tuple[float, float, float]:
    """X-16: F1 of ROUGE-1, -2 and -L of two lists of stems."""
    out = []
    for n in (1, 2):
        a, b = (Counter(zip(*(x[i:] for i in range(n)), strict=False)) for x in (reference, generated))
        out.append(_f1((a & b).total(), a.total(), b.total()))
    return out[0], out[1], _f1(lcs(reference, generated), len(reference), len(generated))


#: Words whose stems a task remembers, at most.
REMEMBERED = 1 << 18


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("rouge1", "rouge2", "rougeL")]))
def rouge_scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    porter, known = Porter(), {}
    for reference, generated in batches:
        rows = []
        for a, b in zip(reference, generated, strict=True):
            if len(known) > REMEMBERED:
                known.clear()
            rows.append(rouge(_tokens(a, porter, known), _tokens(b, porter, known)))
        yield pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL"])
