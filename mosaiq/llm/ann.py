"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred on the mean of all rows, scaled to length one and rotated by
a seeded random orthogonal matrix. A code keeps one sign bit for each axis and
three correction scalars: the distance to the centre, the inner product of the
unit vector with its code, and the number of its ones. A turned query is rounded
to 4 bits an axis, kept as bit planes; the inner product with a code is then a few
ANDs and bit counts on packed words, from which the inner product with the row is
estimated, with an error bound. Rows whose upper bound reaches the query's running
k-th exact score are reranked in double precision on the original vectors.

Every row is coded once. Queries and rows meet in a grid of blocks: each task holds
one block of queries and one block of rows, whatever the size of the table, and
returns each query's best rows of its block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded

#: Width of the error bound in standard deviations of the estimate.
EPSILON = 3.0
#: Bits to which an axis of a query is rounded.
PLANES = 4
#: Rows and queries in a block.
ROW_BLOCK, QUERY_BLOCK = 16384, 1024


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, uniform among them."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words, zeros at the end."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits, and the scalars: distance to the centre and inner product of the unit vector with its own code."""
    away = vectors - centre
    norm = np.sqrt((away * away).sum(axis=1))
    unit = away / np.where(norm > 0, norm, 1)[:, None] @ turn
    return words(unit > 0), np.stack([norm, np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])], axis=1)


def planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Queries rounded to PLANES bits an axis: (query, plane, words), the value of 0, the step, and the sum of the rounded axes."""
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / ((1 << PLANES) - 1)
    level = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.int64)
    return np.stack([words(level >> j & 1) for j in range(PLANES)], axis=1), low, step, low * turned.shape[1] + step * level.sum(axis=1)


def estimate(query: np.ndarray, plane: np.ndarray, low: float, step: float, total: float, shift: float, bits: np.ndarray, ones: np.ndarray, scalars: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of a query with coded vectors, and bounds of their errors.

    total: the sum of the rounded query; shift: its inner product with the centre.
    """
    dim = len(query)
    level = np.zeros(len(bits))
    for j in range(PLANES):
        level += np.bitwise_count(bits & plane[j]).sum(axis=1, dtype=np.int64) << j
    norm, own = scalars[:, 0], np.where(scalars[:, 1] > 0, scalars[:, 1], 1)
    coded = (2 * (low * ones + step * level) - total) / np.sqrt(dim)
    spread = np.maximum(0, 1 - own * own) / max(1, dim - 1) * (query @ query) + step * step / 12  # of the code, and of the rounded query
    return coded / own * norm + shift, epsilon * norm / own * np.sqrt(spread)


def best_of_block(q_ids, queries, ids, vectors, bits, scalars, centre, turn, k: int, epsilon: float) -> pd.DataFrame:
    """Each query's best k rows of a block; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors, bits, scalars = ids[order], vectors[order], bits[order], scalars[order]
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    turned = queries @ turn
    plane, low, step, total = planes(turned)
    shift = queries @ centre
    out = []
    for i, q in enumerate(queries):
        g, bound = estimate(q, plane[i], low[i], step[i], total[i], shift[i], bits, ones, scalars, epsilon)
        g[ids == q_ids[i]] = -np.inf
        first = np.argpartition(-g, k)[: k + 1] if len(g) > k + 1 else np.arange(len(g))
        exact = vectors[first] @ q
        exact[np.isneginf(g[first])] = -np.inf
        floor = np.sort(exact)[::-1][min(k, len(exact)) - 1]
        pick = np.flatnonzero((g + bound >= floor - 1e-9 * max(1.0, abs(floor))) & ~np.isneginf(g))
        score = np.einsum("ij,j->i", vectors[pick], q)
        top = np.lexsort((ids[pick], -score))[:k]
        out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[pick][top], "score": score[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, a vector that isn't zero, and finite components only."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & ~F.coalesce(zero, F.lit(True))
    )


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    seed: int = 7,
    epsilon: float = EPSILON,
    row_block: int = ROW_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest inner product, its own id left out; ties to the smaller vec_id.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part, neither do vectors of another length than
    most. Repeated rows of one id and vector count once. A query with fewer than k candidates gets them all; empty tables give no rows.
    Other columns are ignored. The centre is the mean of all rows; every row is coded and searched.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding).distinct()
    asked = usable(queries, vec_id, embedding).distinct()
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    centre = np.array(rows.agg(*[F.avg(F.col("v")[i]) for i in range(dim)]).first(), np.float64)
    turn = rotation(dim, seed)
    n_q = asked.count()
    row_blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-n_q // query_block))
    shared = spark.sparkContext.broadcast((centre, turn))
    a = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    bounded(spark)

    def code(batches):
        centre, turn = shared.value
        for batch in batches:
            if batch.num_rows:
                bits, scalars = encode(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), centre, turn)
                columns = [batch.column("vec_id"), batch.column("v"), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(list(scalars), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "bits", "scalars"])

    coded = rows.select("vec_id", "v").mapInArrow(code, "vec_id long, v array<double>, bits binary, scalars array<double>")
    b = coded.withColumn("rb", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(row_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        centre, turn = shared.value
        bits = np.frombuffer(b"".join(right["bits"]), np.uint64).reshape(len(right), -1)
        return best_of_block(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()), right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()), bits, np.stack(right["scalars"].to_numpy()), centre, turn, k, epsilon)

    found = a.groupBy("qb", "rb").cogroup(b.groupBy("qb", "rb")).applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
