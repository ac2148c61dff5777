"""Near-duplicate classes by BagMinHash over multisets of 5-word shingles.

Each shingle starts Poisson processes on the intervals (0,1], (1,2], (2,4],
(4,8], ... of its weight axis. A point counts in a document if its place on the
axis is within the shingle's weight there; every point goes to one of m
registers, which keeps its earliest point. Two documents agree in a register
with a probability of exactly their weighted Jaccard similarity. Times are
fixed-point integers, so equal points compare equal. Processes stop as soon as
no register can still be lowered, so long documents take about one point a
shingle. Registers are banded; texts that share a band are candidates, and the
multiset overlap of their shingles decides.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import cut, map_text, node_filter, release
from .components import components

K, LEAST, BANDS, ROWS = 5, 0.8, 30, 5
#: Bits of a parity sketch.
SKETCH = 1024
#: The column that tells rows apart in unique().
KEY = "_row_digest"
U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)

OUT = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
BAG = "node bigint, rep bigint, bag binary, sketch array<bigint>"
#: Bits of the filter that picks texts whose bags are made.
FILTER_BITS = 25


def bags(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with row and weight, and for every occurrence a key of its own (shingle and ordinal)."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((grams, rows))
    g = grams[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(g)))
    ordinal = np.arange(len(g)) - np.repeat(first, weight)
    return g[first], rows[first], weight, textkit.mix(g + ordinal.astype(U64) * GOLD)


def bag_minhash(shingles: np.ndarray, rows: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) earliest times; rows without shingles keep the largest number."""
    top = np.iinfo(np.int64).max
    reg = np.full(n_rows * m, top, np.int64)
    # one process for each interval of the weight axis that a shingle's weight reaches
    keys, docs, low, width, cap = [], [], [], [], []
    lo, size = 0, 1
    pick = np.arange(len(shingles))
    while len(pick):
        keys.append(textkit.mix(shingles[pick] ^ textkit.mix(np.full(len(pick), lo + 1, U64))))
        docs.append(rows[pick])
        low.append(np.full(len(pick), lo, np.int64))
        width.append(np.full(len(pick), size, np.int64))
        cap.append(weight[pick])
        lo, size = lo + size, max(1, lo + size)
        pick = pick[weight[pick] > lo]
    key, doc, lows, sizes, caps = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, docs, low, width, cap))
    key = key.astype(U64)
    now = np.zeros(len(key), np.int64)
    step, per = np.zeros(len(key), U64), 1
    while len(key):
        j = step[:, None] + np.arange(1, per + 1, dtype=U64)
        r = textkit.mix(key[:, None] + j * GOLD)
        dt = np.maximum(1, (-np.log(((r >> U64(32)).astype(np.float64) + 0.5) / 4294967296.0) * 4294967296.0 / sizes[:, None])).astype(np.int64)
        t = now[:, None] + np.cumsum(dt, axis=1)
        slot = ((r & U64(0xFFFFFFFF)) % U64(m)).astype(np.int64)
        ok = np.ones(t.shape, bool)
        wide = np.flatnonzero(sizes > 1)
        if len(wide):
            place = lows[wide, None] + 1 + (textkit.mix(r[wide] ^ GOLD) % sizes[wide, None].astype(U64)).astype(np.int64)
            ok[wide] = place <= caps[wide, None]
        flat = (doc[:, None] * m + slot)[ok]
        np.minimum.at(reg, flat, t[ok])
        now, step = t[:, -1], step + U64(per)
        live, back = np.unique(doc, return_inverse=True)
        worst = reg.reshape(n_rows, m)[live].max(axis=1)
        stay = now < worst[back]
        key, doc, lows, sizes, caps, now, step = (x[stay] for x in (key, doc, lows, sizes, caps, now, step))
        per = int(np.clip(200_000 // max(1, len(key)), 1, 64))
    return reg.reshape(n_rows, m)


def sign(column: pa.Array, k: int = K, bands: int = BANDS, rows: int = ROWS) -> dict[str, object]:
    """Identity of the word sequence, number of shingles and band hashes of each text."""
    node, count, band = [], [], []
    for i, j, h, off in textkit.word_slices(column):
        g, go = textkit.grams(h, off, k)
        shingles, docs, weight, _ = bags(g, go)
        sig = bag_minhash(shingles, docs, weight, j - i, bands * rows).astype(U64).reshape(j - i, bands, rows)
        hashed = np.broadcast_to(textkit.mix(np.arange(bands, dtype=U64)), (j - i, bands)).copy()
        for c in range(rows):
            hashed = textkit.mix(hashed ^ sig[:, :, c])
        n = np.diff(go)
        node.append(textkit.row_digest(h, off).astype(np.int64))
        count.append(n)
        for r in range(j - i):
            band.append(hashed[r].astype(np.int64) if n[r] else np.zeros(0, np.int64))
    return {"node": np.concatenate(node) if node else [], "n": np.concatenate(count) if count else [], "bands": band}


def bags_of(docs: DataFrame, doc_id: str, text: str, nodes: DataFrame, k: int) -> DataFrame:
    """(node, rep, bag, sketch) of the documents whose node the filter holds: at least those of ``nodes``, and by chance some others."""
    held = docs.sparkSession.sparkContext.broadcast(node_filter(nodes, FILTER_BITS))

    def make(batches):
        bits = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            for i, j, h, off in textkit.word_slices(batch.column("text")):
                node = textkit.row_digest(h, off)
                low = node & U64((1 << FILTER_BITS) - 1)
                pick = np.flatnonzero((bits[(low >> U64(3)).astype(np.int64)] >> (low & U64(7)).astype(np.uint8)) & 1)
                if not len(pick):
                    continue
                size = np.diff(off)[pick]
                words = np.concatenate([h[off[r] : off[r + 1]] for r in pick])
                g, go = textkit.grams(words, np.concatenate([[0], np.cumsum(size)]), k)
                each = bags(g, go)[3]
                sorted_ = [np.sort(each[go[r] : go[r + 1]]) for r in range(len(pick))]
                ids = batch.column("rep").take(pa.array(i + pick))
                columns = [pa.array(node[pick].astype(np.int64)), ids, pa.array([x.tobytes() for x in sorted_], pa.binary()), pa.array([odd_sketch(x) for x in sorted_], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "rep", "bag", "sketch"])

    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("rep"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    return given.mapInArrow(make, BAG)


def odd_sketch(keys: np.ndarray) -> np.ndarray:
    """Parities of a set in SKETCH buckets. Two sketches differ in no more bits than their sets differ in elements."""
    bits = np.bincount((keys >> U64(11)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Overlap of two bags: sorted keys, each once."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def edit_keys(bag: np.ndarray, centre: np.ndarray, p: int, q: int) -> tuple[bool, int, int, np.ndarray, np.ndarray]:
    """Whether a bag is similar to the centre, what it adds and lacks (counts), and the first keys of each that any partner must meet.

    Let A be what u adds to the centre c, D what it lacks, e = |A| + |D|. Texts u and v are similar if they differ in at most
    d(u, v) = p/q (n(u) + n(v)) shingles. They differ in e(u) + e(v) less twice the edits they share, so they must share
    (e(u) + e(v) - d(u, v)) / 2 edits. If one of them isn't similar to c, that is more than (e(u) + p/q (n(c) - n(u))) / 2 and
    at least (e(v) - d(v, c)) / 2: more than 0, so similar texts share an edit, always. Of the shared edits, those in D are no more than
    either text lacks; the rest must be in A. Without any shared addition all shared edits are in D, of which u then lacks as many,
    hence at least (e(v) - d(v, c)) / (1 - p/q). Prefixes of both lists, in one order, that leave out one element less than must be
    shared have an element in common.
    """
    added = np.setdiff1d(bag, centre, assume_unique=True)
    lacked = np.setdiff1d(centre, bag, assume_unique=True)
    a, d, n, c = len(added), len(lacked), len(bag), len(centre)
    beyond = q * (a + d) - p * (n + c)
    if beyond <= 0:
        least = alone = (q * (a + d) + p * (c - n)) // (2 * q) + 1
    else:
        least = -(-beyond // (2 * q))
        alone = max(least, -(-beyond // (q - p)))
    return beyond <= 0, a, d, added[: max(0, a - max(1, least - d) + 1)], lacked[: max(0, d - alone + 1)]


def stars(pairs: DataFrame, bag: DataFrame, p: int, q: int) -> DataFrame:
    """For each pair (node, c): similar or not, n and nc, and, where it is wanted (``wide``), the edits' counts and keys."""
    of = lambda name, as_: bag.select(F.col("node").alias(name), F.col("bag").alias(as_))
    joined = pairs.join(of("node", "x"), "node").join(of("c", "y"), "c")

    def test(batches):
        for batch in batches:
            rows = []
            centres = batch.column("c").to_numpy()
            for r, (x, y, wide) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("wide").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                if wide:
                    near, a, d, added, lacked = edit_keys(x, y, p, q)
                    salt = textkit.mix(centres[r : r + 1].astype(U64))
                    rows.append((near, a, d, textkit.mix(added ^ salt).astype(np.int64), textkit.mix(lacked ^ ~salt).astype(np.int64)))
                else:
                    rows.append((q * (len(x) + len(y) - 2 * shared(x, y)) <= p * (len(x) + len(y)), 0, 0, None, None))
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            made = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("node", "c", "n", "nc")] + made, ["node", "c", "n", "nc", "near", "added", "lacked", "akeys", "dkeys"])

    schema = "node bigint, c bigint, n bigint, nc bigint, near boolean, added bigint, lacked bigint, akeys array<bigint>, dkeys array<bigint>"
    return joined.select("node", "c", "n", "nc", "wide", "x", "y").mapInArrow(test, schema)


def edit_pairs(cluster: DataFrame, star: DataFrame, bag: DataFrame, p: int, q: int, keep) -> DataFrame:
    """(node, c): pairs of texts in different components of one cluster that can be similar, by the keys of edit_keys().

    cluster: (c, node, comp), the texts of bands around the centre c that hold several components.
    """
    rows = cluster.join(star.drop("nc"), ["c", "node"])
    of = lambda name, kind, count: F.transform(name, lambda x, i: F.struct(x.alias("k"), (F.col(count) - i).alias("rest"), F.lit(kind).alias("kind")))
    rows = rows.select("c", "node", "comp", "n", "near", "added", "lacked", F.explode(F.concat(of("akeys", 0, "added"), of("dkeys", 1, "lacked"))).alias("e"))
    rows = keep(rows.select("node", "comp", "n", "near", "added", "lacked", "e.*"), "edits")
    met = rows.groupBy("k").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("near").alias("all")).where("x != y and not all").select("k")
    rows = keep(rows.join(met, "k").join(bag.select("node", "sketch"), "node"), "met")
    u = rows.where("not near").alias("u")
    v = rows.select(*[F.col(x).alias(f"{x}2") for x in rows.columns]).alias("v")
    once = F.col("near2") | (F.col("node") < F.col("node2"))  # pairs that are both far from the centre meet twice
    total = F.col("n") + F.col("n2")
    need = F.lit(q) * (F.col("added") + F.col("lacked") + F.col("added2") + F.col("lacked2")) - F.lit(p) * total
    most = F.least("rest", "rest2") + F.when(F.col("kind") == 0, F.least("lacked", "lacked2")).otherwise(0)  # edits from this one on, in order
    apart = reduce(add, [F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(SKETCH // 64)])
    fits = once & (F.col("comp") != F.col("comp2")) & (2 * q * most >= need) & (apart * q <= p * total)
    return u.join(v, (F.col("k") == F.col("k2")) & fits).select("node", F.col("node2").alias("c"), "n", F.col("n2").alias("nc")).distinct()


def _linked(docs: DataFrame, doc_id: str, text: str, row: list[str], k: int, least: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The signed documents (row, doc_id, node, n), and (node, comp) of every text with words that is linked to others."""

    def make():
        return lambda column: sign(column, k, bands, rows)

    t = Fraction(str(least))
    p, q = ((1 - t) / (1 + t)).as_integer_ratio()
    signed = cut(map_text(docs, text, [doc_id, *row], OUT, make).select(F.col(f"row.`{doc_id}`").alias("doc_id"), *[F.col(f"row.`{c}`") for c in row], "out.*"), "signed")
    # texts with equal words are one text from here on
    texts = cut(signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "texts")
    written = [texts]

    def keep(df, name):
        written.append(cut(df, name))
        return written[-1]

    member = texts.select("node", "n", F.explode("bands").alias("band"))
    inside = keep(member.join(member.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "band"), "inside")
    # the text with most band mates is the likely centre of a group of near copies
    inside = keep(inside.join(inside.groupBy("node").agg(F.sum("size").alias("mates")), "node"), "inside")
    centre = inside.groupBy("band").agg(F.max(F.struct("mates", "node", "n")).alias("c")).select("band", F.col("c.node").alias("c"), F.col("c.n").alias("nc"))
    wanted = inside.select("node").distinct().join(texts.select("node", "rep"), "node")
    own = bags_of(docs, doc_id, text, wanted, k)
    same = (own["node"] == wanted["node"]) & (own["rep"].eqNullSafe(wanted["rep"]))
    bag = keep(own.join(wanted, same, "left_semi").groupBy("node").agg(F.first("bag").alias("bag"), F.first("sketch").alias("sketch")), "bags")
    # each band's texts against its centre
    named = keep(inside.join(centre, "band").where("node != c").select("band", "node", "n", "c", "nc", "size"), "named")
    pairs = named.groupBy("node", "c").agg(F.first("n").alias("n"), F.first("nc").alias("nc"), F.max(F.col("size") > 2).alias("wide"))
    star = keep(stars(pairs, bag, p, q), "stars")
    comp = components(star.where("near").select(F.col("node").alias("a"), F.col("c").alias("b")))
    # bands that still hold several components
    label = named.where("size > 2").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = label.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("band")
    cluster = keep(label.join(open_, "band").select("c", "node", "comp").distinct(), "cluster")
    late = edit_pairs(cluster, star, bag, p, q, keep).withColumn("wide", F.lit(False))
    links = stars(late, bag, p, q).where("near").select("node", "c")
    old = lambda x: comp.select(F.col("node").alias(x), F.col("comp").alias(f"{x}2"))
    bridges = links.join(old("node"), "node", "left").join(old("c"), "c", "left").select(F.coalesce("node2", "node").alias("a"), F.coalesce("c2", "c").alias("b"))
    bridge = components(keep(bridges.distinct(), "bridges"))
    over = bridge.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    both = comp.select("node", "comp").union(over.select(F.col("comp").alias("node"), "comp"))
    linked = cut(both.join(over, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")).groupBy("node").agg(F.min("comp").alias("comp")), "linked")
    release(*written, comp, bridge)
    return signed, linked


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row (doc_id, class_id, class_size) per document; class_id is the smallest doc_id of all documents linked directly or through others.

    Texts with equal words are one text from the start (a partial aggregate, so thousands of copies cost no more than one). In each band
    all texts are checked against the one with most band mates, the likely centre of its near copies. In bands that keep several components,
    two texts of different ones can be similar only if they share an edit of the centre (see edit_keys), so they meet by the rarest such
    edits they can do with; pairs are then told apart by their sizes, the edits' places and parity sketches, all of which are bounds, and
    what is left is compared exactly. So no link that a band offers between components is lost, and a band of near copies isn't expanded
    into all pairs. A text of 1 to 4 words is one shingle. Documents without words (null and empty texts too) are classes of their own, by
    doc_id; rows with a null doc_id get the class of their text. Repeated rows stay repeated. An empty table gives no rows; other columns
    are ignored.
    """
    signed, comp = _linked(docs, doc_id, text, [], k, least, bands, rows)
    full = signed.where("n > 0")
    label = full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of = label.groupBy("comp").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    named = cut(label.select("node", "comp").join(of, "comp").select("node", "class_id", "class_size"), "classes")
    alone = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return full.select("doc_id", "node").join(named, "node").select("doc_id", "class_id", "class_size").union(alone)


def unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` with one row of each class of near-duplicates: that of the smallest doc_id (null is largest), then of the smallest digest.

    Rows are told apart by a digest of all their columns, not by doc_id, so a doc_id with several texts is several documents. Of rows that
    are equal in all columns one stays. Rows without words have no shingle to share and all stay. An empty table gives no rows.
    """
    keyed = docs.withColumn(KEY, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    signed, comp = _linked(keyed, doc_id, text, [KEY], k, least, bands, rows)
    ident = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)
    full = signed.where("n > 0").groupBy("node", "doc_id", KEY).agg(F.count("*").alias("times"))
    least_ = full.groupBy("node").agg(F.min(F.struct(ident.alias("ident"), "times")).alias("r"))
    of = least_.join(comp, "node", "left").groupBy(F.coalesce("comp", "node").alias("comp")).agg(F.min("r").alias("r"))
    kept = of.select(F.col("r.ident.doc_id").alias("kept_id"), F.col(f"r.ident.{KEY}").alias("kept_key"), F.col("r.times").alias("kept_times"))
    bare = signed.where("n = 0").select(F.col("doc_id").alias("kept_id"), F.col(KEY).alias("kept_key"), F.lit(1).cast("long").alias("kept_times")).distinct()
    kept = cut(kept.union(bare), "kept")
    found = keyed.join(kept, (F.col(KEY) == F.col("kept_key")) & F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("kept_id")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = found.where("kept_times = 1").select(*columns)
    return once.union(found.where("kept_times > 1").dropDuplicates([KEY, "kept_id"]).select(*columns))


def sql() -> str:
    """The classes in DuckDB SQL, by comparing all texts that share a shingle."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, array_to_string(w, ' ') AS t, len(w) AS k FROM (SELECT doc_id, {words} AS w FROM documents)),
t AS (SELECT row_number() OVER () AS x, t, n, least_id, copies FROM (SELECT t, any_value(greatest(k - {K - 1}, 1)) AS n, min(doc_id) AS least_id, count(*) AS copies FROM d WHERE k > 0 GROUP BY t)),
g AS (SELECT x, array_to_string(w[i:i + {K - 1}], ' ') AS g FROM (SELECT x, w, unnest(range(1, n + 1)) AS i FROM (SELECT x, n, string_split(t, ' ') AS w FROM t))),
o AS (SELECT x, g, row_number() OVER (PARTITION BY x, g) AS k FROM g),
l AS (SELECT x, y FROM (SELECT a.x, b.x AS y, count(*) AS hits FROM o a JOIN o b ON a.g = b.g AND a.k = b.k AND a.x < b.x GROUP BY ALL) p JOIN t u USING (x) JOIN t v ON v.x = y WHERE 9 * hits >= 4 * (u.n + v.n)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, x AS y FROM t UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT r.x, min(t.least_id) AS class_id, sum(t.copies)::BIGINT AS class_size FROM r JOIN t ON t.x = r.y GROUP BY r.x)
SELECT doc_id, coalesce(class_id, CASE WHEN k > 0 THEN NULL ELSE doc_id END) AS class_id, coalesce(class_size, 1) AS class_size FROM d LEFT JOIN t ON t.t = d.t AND k > 0 LEFT JOIN c USING (x)"""
