"""Benchmark decontamination by winnowing.

Each text gives the minimum 5-gram hash of every 9 consecutive 5-grams, so two
texts that share 13 words share a fingerprint of these. Fingerprints of documents
are joined to those of benchmark items, with the 8 words on either side, in which
all windows of 13 words around a fingerprint lie; a hit is extended as far as the
words are equal, and counts from 13 words on. Items of fewer than 13 words are one
window each, and meet the documents' runs of as many words. A bitmap of fixed size
keeps fingerprints that no item has out of the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import bounded, cut, map_text, node_filter

SPAN, GRAM = 13, 5
#: Bits of the filter of fingerprints.
FILTER_BITS = 26
#: Bytes of a table of hits that is broadcast, at most; a larger one is joined by a shuffle.
SMALL = 8 << 20
U64 = np.uint64

MARK = "key bigint, key2 bigint, mark bigint, pos bigint, size int, words binary"
OUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("key", T.LongType()), T.StructField("key2", T.LongType())])
HIT = "key bigint, key2 bigint, item string, start bigint, end bigint"


def winnow(hashes: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the fingerprints of all rows that have at least ``span`` words."""
    width = span - gram + 1
    g, go = textkit.grams(hashes, offsets, gram)
    sizes = np.diff(offsets)
    if len(g) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[: len(g) - width + 1].copy()
    for d in range(1, width):
        np.minimum(least, g[d : len(g) - width + 1 + d], out=least)
    rows = np.repeat(np.arange(len(sizes)), np.diff(go))
    whole = rows[: len(least)] == rows[width - 1 :]
    whole &= (sizes >= span)[rows[: len(least)]]
    at = np.flatnonzero(whole)
    return at, least[at]


def locate(hashes: np.ndarray, offsets: np.ndarray, windows: np.ndarray, values: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the chosen grams of some windows, each once, with the hashes."""
    width = span - gram + 1
    g, go = textkit.grams(hashes, offsets, gram)
    pos = windows + np.argmax(g[windows[:, None] + np.arange(width)] == values[:, None], axis=1)
    pos, first = np.unique(pos, return_index=True)
    rows = np.searchsorted(go, pos, "right") - 1
    return offsets[rows] + pos - go[rows], values[first]


def marks(hashes: np.ndarray, offsets: np.ndarray, short: list[int], span: int, gram: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, rows, positions in the row, marks, surrounding words) of the fingerprints, size 0, and of all runs of each short size."""
    out = []
    at, values = winnow(hashes, offsets, span, gram)
    if len(at):
        at, values = locate(hashes, offsets, at, values, span, gram)
        out.append((0, at, values, gram, span - gram))
    for n in short:
        g, go = textkit.grams(hashes, offsets, n)
        sizes = np.diff(offsets)
        rows = np.repeat(np.arange(len(sizes)), np.diff(go))
        whole = np.flatnonzero((sizes >= n)[rows])
        out.append((n, (offsets[rows] + np.arange(len(g)) - go[rows])[whole], g[whole], n, 0))
    made = []
    for n, at, values, width, wide in out:
        rows = np.searchsorted(offsets, at, "right") - 1
        made.append((n, rows, at, textkit.mix(values ^ U64(n)), width, wide))
    return made


def around(hashes: np.ndarray, offsets: np.ndarray, rows: np.ndarray, at: np.ndarray, width: int, wide: int, fill: int) -> np.ndarray:
    """The words of ``width`` and ``wide`` more on either side; ``fill`` beyond the text."""
    index = at[:, None] + np.arange(-wide, width + wide)
    inside = (index >= offsets[rows][:, None]) & (index < offsets[rows + 1][:, None])
    return np.where(inside, hashes[np.clip(index, 0, len(hashes) - 1)], U64(fill))


def keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each row's words."""
    return textkit.row_digest(hashes, offsets).astype(np.int64), textkit.row_digest(textkit.mix(hashes + U64(1)), offsets).astype(np.int64)


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: ``row`` (the columns to keep) and ``decon``: n_words, spans (flat word starts and ends of the hits) and items (ids, sorted as strings).

    A null or empty text has no words and no hits; equal rows give equal results; items with null id or no words match nothing; an empty
    benchmark hits nothing. Texts and items of any length are read whole, and neither table is gathered anywhere: hits are found once
    for all documents of the same words and joined back by two digests of these.
    """
    spark = docs.sparkSession
    bounded(spark)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")

    def item_marks(batches):
        for batch in batches:
            for i, j, h, off in textkit.word_slices(batch.column("text")):
                sizes = np.diff(off)
                for n, rows, at, values, width, wide in marks(h, off, sorted({int(x) for x in sizes if 0 < x < span}), span, gram):
                    if n:  # an item of n words is one window, longer ones have none of that size
                        own = sizes[rows] == n
                        rows, at, values = rows[own], at[own], values[own]
                    words = around(h, off, rows, at, width, wide, 1)
                    yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(i + rows)), pa.array(values.astype(np.int64)), pa.array([n] * len(at), pa.int32()), pa.array([x.tobytes() for x in words], pa.binary())], ["item", "mark", "size", "words"])

    known = cut(bench.mapInArrow(item_marks, "item string, mark bigint, size int, words binary").distinct(), "marks")
    held = spark.sparkContext.broadcast(node_filter(known.select(F.col("mark").alias("node")), FILTER_BITS))
    short = sorted(r[0] for r in known.where("size > 0").select("size").distinct().collect())  # below span

    def doc_marks(batches):
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for _, _, h, off in textkit.word_slices(batch.column("text")):
                first, second = (None, None)
                for n, rows, at, values, width, wide in marks(h, off, short, span, gram):
                    low = values & U64((1 << FILTER_BITS) - 1)
                    pick = np.flatnonzero((bits[(low >> U64(3)).astype(np.int64)] >> (low & U64(7)).astype(np.uint8)) & 1)
                    if not len(pick):
                        continue
                    if first is None:
                        first, second = keys(h, off)
                    rows, at = rows[pick], at[pick]
                    words = around(h, off, rows, at, width, wide, 0)
                    columns = [first[rows], second[rows], values[pick].astype(np.int64), at - off[rows]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([n] * len(at), pa.int32()), pa.array([x.tobytes() for x in words], pa.binary())], ["key", "key2", "mark", "pos", "size", "words"])

    found = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text is not null").mapInArrow(doc_marks, MARK).dropDuplicates(["key", "key2", "mark", "pos", "size"])
    met = found.join(known.select("item", "mark", "size", F.col("words").alias("theirs")), ["mark", "size"])

    def extend(batches):
        for batch in batches:
            size, pos = batch.column("size").to_numpy(), batch.column("pos").to_numpy()
            for n in np.unique(size):
                pick = np.flatnonzero(size == n)
                at = pa.array(pick)
                same = np.stack([np.frombuffer(x, U64) == np.frombuffer(y, U64) for x, y in zip(batch.column("words").take(at).to_pylist(), batch.column("theirs").take(at).to_pylist(), strict=True)])
                width, wide = (int(n), 0) if n else (gram, span - gram)
                back = np.cumprod(same[:, :wide][:, ::-1], axis=1).sum(axis=1)
                fore = np.cumprod(same[:, wide + width :], axis=1).sum(axis=1)
                hit = same[:, wide : wide + width].all(axis=1) & (back + width + fore >= (n or span))
                pick, start = pick[hit], (pos[pick] - back)[hit]
                end = start + (back + width + fore)[hit]
                take = pa.array(pick)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("key", "key2", "item")], pa.array(start), pa.array(end)], ["key", "key2", "item", "start", "end"])

    hits = met.select("key", "key2", "size", "pos", "item", "words", "theirs").mapInArrow(extend, HIT)
    texts = hits.groupBy("key", "key2").agg(F.collect_set(F.struct("start", "end")).alias("runs"), F.array_sort(F.collect_set("item")).alias("items"))

    def unite(batches):
        for batch in batches:
            spans = [union([(r["start"], r["end"]) for r in runs]) for runs in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("key2"), pa.array(spans, pa.list_(pa.int64())), batch.column("items")], ["key", "key2", "spans", "items"])

    texts = cut(texts.mapInArrow(unite, "key bigint, key2 bigint, spans array<bigint>, items array<string>"), "hits")
    size = texts.agg(F.coalesce(F.sum(F.lit(32) + 8 * F.size("spans") + F.octet_length(F.array_join("items", "")) + 16 * F.size("items")), F.lit(0))).first()[0]

    def make():
        def count(column: pa.Array) -> dict[str, object]:
            n, k1, k2 = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, h, off in textkit.word_slices(column):
                n.append(np.diff(off))
                first, second = keys(h, off)
                k1.append(first)
                k2.append(second)
            return {"n_words": np.concatenate(n), "key": np.concatenate(k1), "key2": np.concatenate(k2)}

        return count

    counted = map_text(docs, text, keep, OUT, make)
    right = texts.select(F.col("key").alias("_k1"), F.col("key2").alias("_k2"), "spans", "items")
    both = counted.join(F.broadcast(right) if size <= SMALL else right, (F.col("out.key") == F.col("_k1")) & (F.col("out.key2") == F.col("_k2")), "left")
    spans, items = F.coalesce("spans", F.array().cast("array<bigint>")), F.coalesce("items", F.array().cast("array<string>"))
    return both.select("row", F.struct(F.col("out.n_words").alias("n_words"), spans.alias("spans"), items.alias("items")).alias("decon"))


def union(spans: list[tuple[int, int]]) -> list[int]:
    """Flat, sorted, merged [start, end, start, end, ...]."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def n_hit(spans):
    """Words in a flat list of spans."""
    return F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), F.lit(0).cast("long"), lambda acc, i: acc + F.get(spans, i + 1) - F.get(spans, i))
    )


def contaminated(found: DataFrame) -> DataFrame:
    """``row`` with n_words, n_hit, items, and contaminated: some hit, and one word in twenty at least."""
    out = found.select("row", F.col("decon.n_words").alias("n_words"), n_hit(F.col("decon.spans")).alias("n_hit"), F.col("decon.items").alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def sql(span: int = SPAN) -> str:
    """The digests of the registered query in DuckDB SQL, by comparing all windows."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, n, w[i:i + n - 1] AS g FROM (SELECT item, w, least(len(w), {span}) AS n, unnest(range(1, greatest(len(w) - {span}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, w[i:i + n - 1] AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
k AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN k USING (rid) LEFT JOIN t USING (rid)"""
