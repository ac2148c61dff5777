"""Column builders for frame sampling, budgets, geometry and token accounts. Halves round to even, as rint does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partial_credit(pred: Column, gold: Column) -> Column:
    """N-01: credit of a count: 0 without numbers; exact for a gold of 0; else 1 less the relative error, at least 0."""
    num = lambda s: F.regexp_extract(s, "-?[0-9]+\\.?[0-9]*", 0).try_cast("double")
    p, g = num(pred), num(gold)
    rel = F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(F.abs(p - g), F.abs(g)))
    return F.when(p.isNull() | g.isNull(), 0.0).when(g == 0, F.when(p == 0, 1.0).otherwise(0.0)).otherwise(rel)


def _range(k: Column) -> Column:
    return F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(k.cast("bigint"), F.lit(1).cast("bigint")) - 1))


def uniform_indices(n: Column, k: Column) -> Column:
    """N-02: all n indices if n < k, else k of them evenly from 0 to n-1, rounded down."""
    step = (n - 1) / F.greatest(k - 1, F.lit(1))
    picked = F.transform(_range(k), lambda i: F.when(k == 1, F.lit(0).cast("bigint")).when(i == k - 1, (n - 1).cast("bigint")).otherwise(F.floor(i * step).cast("bigint")))
    return F.when(n < k, _range(n)).otherwise(picked)


def rounded_indices(n: Column, k: Column) -> Column:
    """N-04: k indices evenly from 0 to n-1, halves to even; zeros without frames; one index is 0."""
    at = lambda i: F.rint(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("bigint")
    return F.transform(_range(F.greatest(k, F.lit(1))), lambda i: F.when((n <= 0) | (k <= 1), F.lit(0).cast("bigint")).otherwise(at(i)))


def segment_midpoints(n: Column, k: Column) -> Column:
    """N-05: the middle of each of k segments of 0..n-1, clamped."""
    seg = (n - 1).cast("double") / k
    return F.transform(_range(k), lambda i: F.greatest(F.lit(0).cast("bigint"), F.least((n - 1).cast("bigint"), F.floor(seg / 2 + F.rint(seg * i)).cast("bigint"))))


def thumbnails(n: Column, k: Column) -> Column:
    """N-06: half-offset indices, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(_range(k), lambda j: F.floor((j + 0.5) * n / k).cast("bigint"))))


def even_split(budget: Column, cams: Column) -> Column:
    """N-09."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(budget / F.greatest(F.lit(1), cams)).cast("bigint"))


def montage_frames(total: Column, k: Column) -> Column:
    """N-10."""
    return F.greatest(F.lit(1).cast("bigint"), F.rint(total / k).cast("bigint"))


def grid(k: Column) -> tuple[Column, Column]:
    """N-11: (rows, columns) of a near-square grid."""
    cols = F.ceil(F.sqrt(k.cast("double"))).cast("bigint")
    return F.ceil(k / cols).cast("bigint"), cols


def cell_size(w: Column, h: Column, cell: int) -> tuple[Column, Column]:
    """N-14: the largest size within a square cell with the same shape, whole pixels, at least 1; never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(cell)) / F.greatest(w, h))
    side = lambda x: F.greatest(F.lit(1).cast("bigint"), F.floor(x * scale).cast("bigint"))
    return side(w), side(h)


def tiling(w: Column, h: Column, most: int = 6, size: int = 448) -> Column:
    """N-13: struct(cols, rows): the tiling whose shape is closest; among equals a later (larger) one if the picture fills over half of it."""
    shapes = sorted({(i, j) for i in range(1, most + 1) for j in range(1, most + 1) if i * j <= most}, key=lambda x: (x[0] * x[1], x))
    aspect, area = w / h, w * h
    best, diff = F.named_struct(F.lit("cols"), F.lit(1), F.lit("rows"), F.lit(1)), F.lit(float("inf"))
    state = F.named_struct(F.lit("best"), best, F.lit("diff"), diff)
    listed = F.array(*[F.named_struct(F.lit("cols"), F.lit(i), F.lit("rows"), F.lit(j)) for i, j in shapes])

    def step(acc, r):
        d = F.abs(aspect - r["cols"] / r["rows"])
        take = (d < acc["diff"]) | ((d == acc["diff"]) & (area > F.lit(0.5 * size * size) * r["cols"] * r["rows"]))
        return F.when(take, F.named_struct(F.lit("best"), r, F.lit("diff"), F.least(d, acc["diff"]))).otherwise(acc)

    return F.aggregate(listed, state, step, lambda acc: acc["best"])


def cosine(a: Column, b: Column) -> Column:
    """N-15: cosine of two arrays, null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def duration(n: Column, fps: Column) -> Column:
    """N-16: null without a frame rate."""
    return F.when(fps > 0, n / fps)


def visual_tokens(tiles: Column, text_tokens: Column, per_tile: int = 256) -> Column:
    """N-17."""
    return tiles * per_tile + text_tokens


def half_even(x: Column, digits: int) -> Column:
    """N-18: rounding of stored values."""
    return F.bround(x, digits)


def clamp01(x: Column) -> Column:
    """N-19."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def floor_of(floor: Column, target: Column, k: Column) -> Column:
    """N-20: a per-clip floor that k clips can have within the target."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(floor, F.floor(target / k).cast("bigint")))


def apart(ys: Column, gap: float, lo: float, hi: float) -> Column:
    """W-10: sorted positions moved apart to a least gap: upwards; then all down by what passes the top; then downwards from the top; none below the bottom."""
    none = F.array().cast("array<double>")
    push = F.aggregate(ys, none, lambda acc, y: F.concat(acc, F.array(F.when(F.size(acc) == 0, y).otherwise(F.greatest(y, F.get(acc, F.size(acc) - 1) + gap)))))
    over = lambda x: F.greatest(F.lit(0.0), F.coalesce(F.get(x, F.size(x) - 1), F.lit(0.0)) - hi)
    slid = F.element_at(F.transform(F.array(push), lambda x: F.transform(x, lambda y: y - over(x))), 1)
    pull = F.aggregate(F.reverse(slid), none, lambda acc, y: F.concat(F.array(F.when(F.size(acc) == 0, y).otherwise(F.least(y, F.get(acc, F.lit(0)) - gap))), acc))
    return F.transform(pull, lambda y: F.greatest(F.lit(lo), y))


def pasted(cell: Column, size: Column, frame: Column) -> Column:
    """N-12: where a frame begins that stands in the middle of the cell of that number, along one axis."""
    return cell * size + F.floor((size - frame) / 2)
