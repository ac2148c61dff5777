"""Toxicity by weak supervision.

Lexicon voters are whole words, pattern voters are beginnings and ends of words;
a few are fixed, the others are mined from labelled training rows. A generative
model takes the voters and the annotators' label as noisy signs of a hidden
class: expectation maximisation estimates how often each votes in either class,
and voters that vote together within the toxic class more than independence
allows share one vote between them. Its posterior labels train a logistic
classifier on the voters' counts, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import cut, map_text

#: Labelled rows that are learnt from, at most; the ones with the smallest hashed doc_id.
SAMPLE = 20_000
#: Mined voters, at most, and training documents of the toxic class that one needs.
VOTERS, SUPPORT = 400, 3
THRESHOLD = 0.3
#: Rows of the sample that the driver holds as a dense matrix at a time.
BLOCK = 1024
#: Lexicon voters that need no labels.
LEXICON = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumb garbage filth vermin".split()
STARTS, ENDS = (3, 4, 5, 6, 7, 8), (4, 5, 6)
U64 = np.uint64


def _salt(kind: int) -> np.uint64:
    return textkit.mix(np.array([kind + 1], U64))[0]


def features(column: pa.Array, limit: int = textkit.LIMIT):
    """(first row, end row, words per row, [(row of each feature, feature)]) for slices: hashes of words, of their first and of their last bytes."""
    off, raw = textkit.utf8(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        rel = off[i : j + 1] - off[i]
        data = raw[off[i] : off[j]]
        parts, counts = [], np.zeros(j - i, np.int64)
        for a, b in _pieces(data, rel, limit):
            rows, words = _hash_features(textkit._table[data[a:b]], rel[(rel >= a) & (rel < b)] - a, a, rel)
            np.add.at(counts, rows, 1)
            parts += [(rows[keep], f) for keep, f in words]
        yield i, j, counts, parts
        i = j


def _pieces(data: np.ndarray, rel: np.ndarray, limit: int):
    """Ranges of about the limit that end between words; only one document beyond the limit has several."""
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        if end < len(data):
            later = np.flatnonzero(textkit._table[data[end : end + (1 << 16)]] == 32)
            while not len(later) and end < len(data):
                end = min(len(data), end + (1 << 16))
                later = np.flatnonzero(textkit._table[data[end : end + (1 << 16)]] == 32)
            end = end + int(later[0]) if len(later) else len(data)
        yield at, end
        at = end


def _hash_features(low: np.ndarray, breaks: np.ndarray, base: int, rel: np.ndarray):
    inside = low != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[breaks] = inside[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int64), []
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut_at = breaks[breaks > 0] - 1
    last[cut_at] = inside[cut_at]
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(rel, starts + base, "right") - 1
    powers, inverse = textkit._power_tables(len(low))
    sums = np.zeros(len(low) + 1, U64)
    np.cumsum((low.astype(U64) + U64(1)) * powers[: len(low)], dtype=U64, out=sums[1:])
    size = ends - starts
    out = [(np.arange(len(starts)), textkit.mix((sums[ends] - sums[starts]) * inverse[starts] ^ _salt(0)))]
    for n in STARTS:
        keep = np.flatnonzero(size >= n)
        s = starts[keep]
        out.append((keep, textkit.mix((sums[s + n] - sums[s]) * inverse[s] ^ _salt(n))))
    for n in ENDS:
        keep = np.flatnonzero(size > n)
        s = ends[keep] - n
        out.append((keep, textkit.mix((sums[s + n] - sums[s]) * inverse[s] ^ _salt(100 + n))))
    return rows, out


def lexicon_features(words: list[str]) -> np.ndarray:
    out = []
    for _, _, _, parts in features(pa.array(words, pa.string())):
        out.append(parts[0][1])
    return np.concatenate(out) if out else np.zeros(0, U64)


def count_matrix(column: pa.Array, voters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, voter, count) of all votes, and the number of words of each row; ``voters`` is sorted."""
    rows_, which_, counts_, words_ = [], [], [], []
    for i, j, n_words, parts in features(column):
        words_.append(n_words)
        r, v = [], []
        for rows, f in parts:
            at = np.searchsorted(voters, f)
            at[at == len(voters)] = 0
            hit = voters[at] == f if len(voters) else np.zeros(len(f), bool)
            r.append(rows[hit])
            v.append(at[hit])
        key, count = np.unique(np.concatenate(r or [np.zeros(0, np.int64)]) * max(1, len(voters)) + np.concatenate(v or [np.zeros(0, np.int64)]), return_counts=True)
        rows_.append(key // max(1, len(voters)) + i)
        which_.append(key % max(1, len(voters)))
        counts_.append(count)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(rows_), cat(which_), cat(counts_), cat(words_)


@dataclass
class Model:
    voters: np.ndarray  # sorted features
    weights: np.ndarray  # of log counts and of shares, then the bias
    accuracy: np.ndarray  # share of votes in either class, by voter
    groups: np.ndarray  # voters of one group share a vote

    def score(self, column: pa.Array) -> np.ndarray:
        rows, which, count, words = count_matrix(column, self.voters)
        k = len(self.voters)
        z = np.full(len(words), self.weights[-1])
        share = count / np.maximum(1, words[rows])
        np.add.at(z, rows, self.weights[which] * np.log1p(count) + self.weights[k + which] * np.sqrt(share))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def mined(sample: DataFrame, voters: int = VOTERS, support: int = SUPPORT) -> np.ndarray:
    """Features that training documents of the toxic class hold far more often than others, best first."""

    def tally(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for i, j, _, parts in features(batch.column("text")):
                if not parts:
                    continue
                rows = np.concatenate([r for r, _ in parts])
                f = np.concatenate([x for _, x in parts])
                order = np.lexsort((rows, f))
                rows, f = rows[order], f[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (rows[1:] != rows[:-1])  # once for each document
                rows, f = rows[new], f[new]
                names, back = np.unique(f, return_inverse=True)
                pos = np.bincount(back, toxic[i + rows], len(names))
                n = np.bincount(back, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(pos.astype(np.int64)), pa.array(n.astype(np.int64))], ["f", "pos", "n"])

    total = sample.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    if not total["p"] or total["p"] == total["n"]:
        return np.zeros(0, U64)
    p, n = float(total["p"]), float(total["n"])
    counts = sample.select("text", "toxic").mapInArrow(tally, "f long, pos long, n long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    a, b = (F.col("pos") + 0.5) / (p + 1), (F.col("n") - F.col("pos") + 0.5) / (n - p + 1)
    # signed log-likelihood ratio of the feature and the class
    expect = F.col("n") * p / n
    gain = F.col("pos") * F.log((F.col("pos") + 1e-9) / expect) + (F.col("n") - F.col("pos")) * F.log((F.col("n") - F.col("pos") + 1e-9) / (F.col("n") - expect))
    best = counts.where((F.col("pos") >= support) & (a > 4 * b)).withColumn("gain", gain).where("gain > 6").orderBy(F.desc("gain"), "f").limit(voters)
    return np.array([r["f"] for r in best.collect()], np.int64).astype(U64)


@dataclass
class Sparse:
    """Rows of a matrix as their entries: row ``i`` holds ``values[at[i]:at[i + 1]]`` in ``columns`` of the same places. Texts have few votes."""

    at: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.at) - 1, self.width


def blocks(x: np.ndarray | Sparse) -> Iterator[tuple[slice, np.ndarray]]:
    """All rows in dense blocks of float32, with their places; the driver holds one block at a time."""
    for i in range(0, x.shape[0], BLOCK):
        rows = slice(i, min(i + BLOCK, x.shape[0]))
        if isinstance(x, np.ndarray):
            yield rows, x[rows].astype(np.float32)
            continue
        a, b = x.at[rows.start], x.at[rows.stop]
        out = np.zeros((rows.stop - i, x.width), np.float32)
        out[np.repeat(np.arange(len(out)), np.diff(x.at[i : rows.stop + 1])), x.columns[a:b]] = x.values[a:b]
        yield rows, out


def label_model(votes: np.ndarray | Sparse, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each row, vote rates by class, and groups of correlated voters.

    votes: rows x voters, 0 or 1; 0 abstains. That all abstain is a sign of its own. The annotators' label is one more voter, held to be right more often than not.
    """
    n, k = votes.shape
    post = np.clip(labels.astype(np.float64), 0.02, 0.98)
    groups = np.arange(k)
    rates = np.zeros((2, k))
    silent = np.ones(n, bool)
    for at, x in blocks(votes):
        silent[at] = ~x.any(axis=1)
    for step in range(rounds):
        w1, w0 = post.sum(), (1 - post).sum()
        sums = np.zeros((2, k))
        for at, x in blocks(votes):
            sums += np.stack([1 - post[at], post[at]]) @ x
        rates = np.stack([(sums[0] + 0.05) / (w0 + 1), (sums[1] + 0.5) / (w1 + 1)])
        right = np.clip(np.array([((1 - post) @ (1 - labels) + 1) / (w0 + 2), (post @ labels + 1) / (w1 + 2)]), 0.95, 0.999)
        if step == 2 and k:  # correlations within the toxic class
            groups = _linked(_correlation(votes, post > 0.5) > 0.6)
        share = 1 / np.bincount(groups, minlength=k)[groups] if k else np.zeros(0)
        quiet = np.log(((post @ silent) + 0.5) / (w1 + 1)) - np.log((((1 - post) @ silent) + 0.5) / (w0 + 1))
        z = np.log((w1 + 1) / (w0 + 1)) + quiet * silent
        for at, x in blocks(votes):
            z[at] += x @ (np.log(rates[1] / rates[0]) * share)
        z += np.where(labels == 1, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            break
        post = new
    return post, rates, groups


def _correlation(votes: np.ndarray | Sparse, pick: np.ndarray) -> np.ndarray:
    """Absolute correlation of each two voters over the picked rows."""
    k = votes.shape[1]
    mean, product = np.zeros(k), np.zeros((k, k))
    for at, x in blocks(votes):
        mean += x[pick[at]].sum(axis=0, dtype=np.float64)
    mean /= max(1, pick.sum())
    for at, x in blocks(votes):
        z = (x[pick[at]] - mean).astype(np.float32)
        product += z.T @ z
    norm = np.sqrt(np.diagonal(product)) + 1e-6
    return np.abs(product / norm[:, None] / norm[None, :])


def _linked(near: np.ndarray) -> np.ndarray:
    """Group numbers of a symmetric relation's components."""
    group = np.arange(len(near))
    while True:
        low = np.where(near, group[None, :], len(near)).min(axis=1)
        new = np.minimum(group, low)
        new = new[new]
        if (new == group).all():
            return group
        group = new


def logistic(x: np.ndarray | Sparse, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton steps. Gradient and curvature are added up over blocks of rows."""
    k = x.shape[1]
    w = np.zeros(k + 1)
    w[-1] = np.log((y.sum() + 1) / ((1 - y).sum() + 1))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        gradient, curvature = penalty * w, np.diag(penalty)
        for at, rows in blocks(x):
            a = np.concatenate([rows, np.ones((len(rows), 1), rows.dtype)], axis=1)
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-4)
            gradient += a.T @ (p - y[at])
            curvature += (a * s[:, None].astype(a.dtype)).T @ a
        step = np.linalg.solve(curvature, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-3:
            break
    return w


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, voters: int = VOTERS) -> Model:
    """A model from a bounded sample of the labelled rows that aren't held out; a doc_id with several labels counts as toxic if one says so, and one with several texts is learnt from by the first of them in order of characters."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col("doc_id").alias("d"), F.col("text").cast("string").alias("text"))
    rows = cut(own.join(F.broadcast(known), F.col("d") == F.col("doc_id")).where("text is not null").groupBy("d").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    fixed = lexicon_features(LEXICON)
    names = np.unique(np.concatenate([fixed, mined(rows, voters)]))

    def votes(batches):
        for batch in batches:
            r, v, c, words = count_matrix(batch.column("text"), names)
            at = np.searchsorted(r, np.arange(len(words) + 1))
            which = [v[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            count = [c[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words), pa.array(which, pa.list_(pa.int64())), pa.array(count, pa.list_(pa.int64()))], ["toxic", "words", "which", "count"])

    got = rows.select("text", "toxic").mapInArrow(votes, "toxic long, words long, which array<long>, count array<long>").toArrow()  # the bounded sample, without texts
    y = got["toxic"].to_numpy().astype(np.float64)
    if not len(y):  # nothing to learn from: any word of the lexicon decides
        weights = np.concatenate([np.full(len(names), 6.0), np.zeros(len(names)), [-4.0]])
        return Model(names, weights, np.zeros((2, len(names))), np.arange(len(names)))
    words = got["words"].to_numpy()
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(got["which"]).to_numpy())])
    which = got["which"].combine_chunks().flatten().to_numpy()
    count = got["count"].combine_chunks().flatten().to_numpy()
    words = np.repeat(np.maximum(1, words), np.diff(at))
    post, rates, groups = label_model(Sparse(at, which, np.ones(len(which), np.float32), len(names)), y)
    both = np.stack([which, len(names) + which], axis=1).ravel()
    values = np.stack([np.log1p(count), np.sqrt(count / words)], axis=1).astype(np.float32).ravel()
    return Model(names, logistic(Sparse(2 * at, both, values, 2 * len(names)), post), rates, groups)


def score(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``row`` (the columns to keep) and ``out.score``: 0 to 1, higher where toxic is likelier.

    Null and empty texts get the score of a text without votes. Every whole text is scored, and equal texts get equal scores. Without
    labelled rows the fixed lexicon decides. An empty table gives no rows. doc_id is read only to find the labelled rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    out = T.StructType([T.StructField("score", T.DoubleType())])
    return map_text(docs, text, keep, out, lambda: lambda column: {"score": model.value.score(column)})
