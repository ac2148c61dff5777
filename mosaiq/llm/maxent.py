"""A hashed maximum-entropy language model with a class-factored softmax.

The frequent tokens, the end of a text and the tail (all other tokens) are the
leaves of a tree of classes, at most 16 below each, dealt out by frequency as in
Huffman's code. A token's probability is the product of the choices on its path:
P(token | history) = P(class | history) P(class | class, history) ... down to
the token itself. Every choice is a softmax of its own with hashed features of
the history: the last token, the last two, and the one before the last (a skip),
each together with the class in which the choice is made. So every token is told
apart by its context, not only its class. The tail keeps a discounted share for
the one outcome "unknown", so probabilities over all known tokens and the unknown
one sum to 1.

Weights are trained by rounds of gradient steps over all training documents. In
a round all tasks sum their gradients from the same weights, in integers, so that
the sums don't depend on how documents are dealt to tasks; a bucket then moves by
its gradient over the choices expected of it. The number of buckets grows with
the square root of the number of tokens, up to what a task may hold.

Tokens are known by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import bounded, cut, map_text

U64 = np.uint64
#: A token is frequent if it makes up 1 / FREQUENT of the training tokens, so at most FREQUENT tokens are; and occurs LEAST times.
FREQUENT, LEAST = 1 << 20, 8
#: Classes below a class, rounds, and choices that are computed at a time.
BRANCH, ROUNDS, CHUNK = 16, 2, 8192
#: Buckets of weights: this many per square root of the number of training tokens, a power of 2 between the bounds.
PER_ROOT, FEWEST, MOST = 8, 1 << 12, 1 << 20
#: Expected choices that a bucket is damped by, the longest step, and the unit of summed gradients.
DAMPING, LONGEST, UNIT = 2.0, 2.0, 1 << 12
#: Buckets that are summed in one place, and training tokens for each bucket that a task reads at least, as it sends all buckets on.
BLOCK, PER_TASK = 1 << 8, 42
#: The token that ends a text; no word has this hash by construction of a word, only by chance.
END = textkit.mix(np.array([0xE0D], U64))[0]
_KINDS = textkit.mix(np.arange(1, 4, dtype=U64))
_STEP, _TURN = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def token_slices(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Like word_slices, with white space between words and one end after each text."""
    for i, j, h, off in textkit.word_slices(column, table=textkit.SPACED):
        new = off + np.arange(j - i + 1)
        out = np.full(new[-1], END, U64)
        keep = np.ones(new[-1], bool)
        keep[new[1:] - 1] = False
        out[keep] = h
        yield i, j, out, new


def history(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(3, tokens) hashes of the history features of each position."""
    pos = np.arange(len(tokens)) - np.repeat(offsets[:-1], np.diff(offsets))
    last = np.zeros_like(tokens)
    last[1:] = tokens[:-1]
    last[pos < 1] = 1
    before = np.zeros_like(tokens)
    before[2:] = tokens[:-2]
    before[pos < 2] = 2
    pair = last * U64(0xFF51AFD7ED558CCD) + before
    return np.stack([textkit.mix(last ^ _KINDS[0]), textkit.mix(pair ^ _KINDS[1]), textkit.mix(before ^ _KINDS[2])])


def tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent node, branch) of all leaves and then of all inner nodes but the root, which is the last node; ties go by position."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, branch, made = [0] * n, [0] * n, 0
    take = (n - 2) % (BRANCH - 1) + 2 if n > 1 else 1  # so that the last merges are full
    while True:
        held = [heapq.heappop(heap) for _ in range(min(take, len(heap)))]
        for k, (_, i) in enumerate(held):
            parent[i], branch[i] = made, k
        if not heap:
            return np.array(parent), np.array(branch)
        heapq.heappush(heap, (sum(c for c, _ in held), n + made))
        parent.append(0)
        branch.append(0)
        made, take = made + 1, BRANCH


class Vocabulary:
    """The frequent tokens with counts, and every leaf's path of choices; the last leaf is the tail."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        leaves = np.append(self.counts, max(0, total - self.counts.sum())) + 0.5
        parent, branch = tree(np.append(self.counts, max(0, total - int(self.counts.sum()))))
        n, inner = len(leaves), len(parent) - len(leaves) + 1
        mass = np.zeros((inner, BRANCH))
        paths, choices, at, weight = [], [], np.arange(n), np.append(leaves, np.zeros(inner))
        for k in range(n + inner - 1):  # children come before their parents
            mass[parent[k], branch[k]] += weight[k]
            weight[n + parent[k]] += weight[k]
        live = np.arange(n)
        who = []
        while len(live):
            paths.append(parent[at])
            choices.append(branch[at])
            who.append(live)
            up = n + parent[at]
            stay = up < n + inner - 1
            live, at = live[stay], up[stay]
        who, paths, choices = (np.concatenate(x) for x in (who, paths, choices))
        order = np.argsort(who, kind="stable")
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))])
        self.nodes, self.choices = paths[order].astype(np.int32), choices[order].astype(np.int8)
        with np.errstate(divide="ignore"):
            self.prior = np.maximum(np.log(mass / mass.sum(axis=1, keepdims=True)), -1e9).astype(np.float32)
        self.base = np.log10(self.counts + 0.5)

    def place(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens, the leaf of each, and which one each token is."""
        names, back = np.unique(tokens, return_inverse=True)
        tail = len(self.hashes)
        if not tail:
            return names, np.zeros(len(names), np.int64), back
        at = np.minimum(np.searchsorted(self.hashes, names), tail - 1)
        return names, np.where(self.hashes[at] == names, at, tail), back

    def choose(self, leaves: np.ndarray, features: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(token, class, branch, (3, n) buckets) of the choices of a sequence of leaves, some at a time."""
        depth = np.diff(self.offsets)[leaves]
        ends = np.cumsum(depth)
        a = 0
        while a < len(leaves):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
            d = depth[a:b]
            token = np.repeat(np.arange(a, b), d)
            at = np.repeat(self.offsets[leaves[a:b]] - np.concatenate([[0], np.cumsum(d)[:-1]]), d) + np.arange(len(token))
            node = self.nodes[at]
            mixed = features[:, token] + node.astype(U64) * _STEP
            mixed ^= mixed >> U64(29)
            mixed *= _TURN
            yield token, node, self.choices[at], (mixed >> U64(64 - bits)).astype(np.int64)
            a = b


def logits(weights: np.ndarray, prior: np.ndarray, buckets: np.ndarray, node: np.ndarray) -> np.ndarray:
    z = weights.take(buckets[0], axis=0)
    z += weights.take(buckets[1], axis=0)
    z += weights.take(buckets[2], axis=0)
    z += prior.take(node, axis=0)
    z -= z.max(axis=1, keepdims=True)
    return z


def gradient(voc: Vocabulary, weights: np.ndarray, leaves: np.ndarray, features: np.ndarray, out: np.ndarray, seen: np.ndarray) -> None:
    """Adds to ``out`` expected minus observed choices of each bucket and branch, and to ``seen`` the number of choices, in units of 1 / UNIT."""
    bits = int(log2(len(weights)))
    part, within = np.zeros(out.size, np.int32), np.arange(BRANCH)  # 32 chunks' sums stay below the bounds of 32 bits
    for k, (_, node, branch, buckets) in enumerate(voc.choose(leaves, features, bits), 1):
        p = np.exp(logits(weights, voc.prior, buckets, node))
        p /= p.sum(axis=1, keepdims=True)
        p.reshape(-1)[np.arange(len(branch)) * BRANCH + branch] -= 1
        p *= UNIT
        whole = np.rint(p).astype(np.int32).ravel()
        for b in buckets:
            np.add.at(part, (b[:, None] * BRANCH + within).ravel(), whole)
            np.add.at(seen, b, 1)
        if k % 32 == 0:
            out += part.reshape(out.shape)
            part[:] = 0
    out += part.reshape(out.shape)


def counted(docs: DataFrame, text: str) -> DataFrame:
    """(h, c): how often each token occurs."""

    def tally(batches):
        for batch in batches:
            for _, _, tokens, _ in token_slices(batch.column("text")):
                names, n = np.unique(tokens, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(n.astype(np.int64))], ["h", "c"])

    bounded(docs.sparkSession)
    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(tally, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def buckets_for(total: int) -> int:
    return int(min(MOST, max(FEWEST, 1 << ceil(log2(max(1.0, PER_ROOT * total**0.5))))))


def trained(docs: DataFrame, text: str, vocabulary, total: int, rounds: int) -> np.ndarray:
    """Weights after some rounds; each round sums the gradient of another part of all documents."""
    sc = docs.sparkSession.sparkContext
    n = buckets_for(total)
    weights = np.zeros((n, BRANCH), np.float32)
    for k in range(rounds):
        shared = sc.broadcast(weights)
        part = docs.where(F.pmod(F.xxhash64("_row"), F.lit(rounds)) == k).select(F.col(f"`{text}`").cast("string").alias("text"))

        def run(batches, shared=shared):
            out, seen, any_ = np.zeros((n, BRANCH), np.int64), np.zeros((n, 1), np.int64), False
            voc = vocabulary.value
            for batch in batches:
                for _, _, tokens, off in token_slices(batch.column("text")):
                    _, leaf, back = voc.place(tokens)
                    gradient(voc, shared.value, leaf[back], history(tokens, off), out, seen[:, 0])
                    any_ = True
            for a in range(0, n if any_ else 0, BLOCK):
                if seen[a : a + BLOCK].any():
                    packed = np.concatenate([seen[a : a + BLOCK], out[a : a + BLOCK]], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([packed.tobytes()], pa.binary())], ["a", "g"])

        def add(batches):
            sums: dict[int, np.ndarray] = {}  # of the blocks dealt to this task, n / BLOCK at most
            for batch in batches:
                for a, g in zip(batch.column("a").to_pylist(), batch.column("g"), strict=True):
                    x = np.frombuffer(g.as_buffer(), np.int64)
                    sums[a] = sums[a] + x if a in sums else x.copy()
            for a, total in sums.items():
                g = total.reshape(-1, BRANCH + 1)
                share = g[:, 1:] / UNIT / (g[:, :1] / BRANCH + DAMPING) / 3
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([np.clip(share, -LONGEST, LONGEST).astype(np.float32).tobytes()], pa.binary())], ["a", "g"])

        tasks = max(1, min(part.rdd.getNumPartitions(), total // (PER_TASK * n)))
        given = part.coalesce(tasks).mapInArrow(run, "a long, g binary")
        sums = given.repartition(max(1, min(tasks, n // BLOCK)), "a").mapInArrow(add, "a long, g binary").toArrow()  # n buckets at most
        step = np.zeros_like(weights)
        for a, g in zip(sums["a"].to_pylist(), sums["g"].to_pylist(), strict=True):
            step[a : a + BLOCK] = np.frombuffer(g, np.float32).reshape(-1, BRANCH)
        weights = weights - step
        shared.unpersist()
    return weights


OUT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("model", T.DoubleType()),
        T.StructField("tail", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.IntegerType())),
    ]
)


def part_scores(column: pa.Array, voc: Vocabulary, weights: np.ndarray) -> dict[str, object]:
    """Scores of each text but for its tail tokens, and those tokens with how often they occur."""
    n_tokens, known, base, model, tails, times = [], [], [], [], [], []
    tail, bits = len(voc.hashes), int(log2(len(weights)))
    for i, j, tokens, off in token_slices(column):
        names, leaf, back = voc.place(tokens)
        frequent = leaf < tail
        rows = np.repeat(np.arange(j - i), np.diff(off))
        log_p = np.zeros(len(tokens))
        for token, node, branch, buckets in voc.choose(leaf[back], history(tokens, off), bits):
            z = logits(weights, voc.prior, buckets, node)
            own = z.ravel().take(np.arange(len(branch)) * BRANCH + branch) - np.log(np.exp(z).sum(axis=1))
            log_p[token[0] : token[-1] + 1] = np.bincount(token - token[0], own)
        add = lambda x: np.bincount(rows, x, j - i)
        n_tokens.append(np.diff(off))
        known.append(add(frequent[back]).astype(np.int64))
        base.append(add((np.where(frequent, voc.base[np.where(frequent, leaf, 0)], 0) if tail else np.zeros(len(names)))[back]))
        model.append(add(log_p) / np.log(10))
        rest = np.flatnonzero(~frequent[back])
        key, n = np.unique(rows[rest] * len(names) + back[rest], return_counts=True)
        cuts = np.searchsorted(key, np.arange(1, j - i) * len(names))
        tails += np.split(names[key % max(1, len(names))].astype(np.int64), cuts)
        times += np.split(n.astype(np.int32), cuts)
    cat = lambda x: np.concatenate(x) if x else []
    return {"n_tokens": cat(n_tokens), "known": cat(known), "base": cat(base), "model": cat(model), "tail": tails, "times": times}


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    A null or empty text is one end token. Rows with a null doc_id are training rows. Repeated rows count each. Texts are read whole. An
    empty table gives no rows; without training rows every probability is that of the unknown token. Frequent tokens, at most
    ``FREQUENT``, are held in memory by each task; all others meet their counts in a join, where no token has more than its small share
    of the training tokens.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), held_out(F.col(f"`{doc_id}`")).alias("held_out"))
    own = own.withColumn("_row", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    train = own.where(~F.col("held_out"))
    counts = cut(counted(train, "text"), "counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = int(sums[0]), int(sums[1])
    floor = max(LEAST, -(-total // FREQUENT))
    often = counts.where(F.col("c") >= floor).toArrow()  # at most FREQUENT rows of two numbers
    voc = Vocabulary(often["h"].to_numpy().astype(np.int64).astype(U64), often["c"].to_numpy().astype(np.int64), total)
    vocabulary = spark.sparkContext.broadcast(voc)
    rare = counts.where(F.col("c") < floor)
    one, two, tail_words, tail_tokens = rare.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    discount = min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
    weights = spark.sparkContext.broadcast(trained(train, "text", vocabulary, total, rounds))
    given = own.withColumn("row", F.monotonically_increasing_id())
    part = cut(map_text(given, "text", ["doc_id", "held_out", "row"], OUT, lambda: lambda column: part_scores(column, vocabulary.value, weights.value)).select("row.*", "out.*"), "scores")
    pairs = part.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("h"), F.col("x.times").alias("k"))
    met = pairs.join(rare, "h", "left")
    seen = F.col("c").isNotNull()
    unknown = float(np.log10(discount * tail_words / tail_tokens)) if tail_tokens else 0.0
    mass = float(np.log10(tail_tokens)) if tail_tokens else 0.0
    summed = met.groupBy("row").agg(
        F.sum(F.when(seen, F.col("k")).otherwise(0)).alias("n"),
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("b"),
        F.sum(F.col("k") * F.when(seen, F.log10(F.col("c") - discount) - mass).otherwise(F.lit(unknown))).alias("m"),
    )
    whole = float(np.log10(total + 0.5 * (distinct + 1)))
    zero = F.lit(0)
    return part.join(summed, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("n", zero)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + F.coalesce("m", zero)).alias("score"),
    )
