"""Aggregations over result rows: accuracy, exact percentiles, means and spread over passes, cross-tabs, chance, costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed, pystr

STRATA = ("task_type", "orig_num_cameras", "source", "cap_answer_safe")


def truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def accuracy() -> list[Column]:
    """A-01: correct, total and acc (null without rows); null counts as wrong."""
    right = F.count_if(truthy(F.col("correct")))
    return [right.alias("n_correct"), F.count("*").alias("n"), F.try_divide(right.cast("double"), F.count("*")).alias("acc")]


def percentiles(df: DataFrame, keys: list[str], x: str, qs: dict[str, float]) -> DataFrame:
    """A-05 without collecting groups: a value's rank range comes from counts of equal values, so only distinct values are ordered."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("c"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum("c").over(by.orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("hi", upto).withColumn("n", F.sum("c").over(by))
    place = lambda q: F.rint(F.lit(q) * (F.col("n") - 1))
    hit = lambda q: (place(q) >= F.col("hi") - F.col("c")) & (place(q) < F.col("hi"))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(hit(q), F.col(x))).alias(name) for name, q in qs.items()])


def by_strata(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows fanned out to one per stratum they count in: (keys, dim, key). 'overall' holds all; null keys are 'None'."""
    dims = [F.struct(F.lit("overall").alias("dim"), F.lit("").alias("key"))]
    dims += [F.struct(F.lit(d).alias("dim"), pystr(F.col(d), d == "cap_answer_safe").alias("key")) for d in STRATA]
    return df.withColumn("_s", F.explode(F.array(*dims))).select("*", "_s.dim", "_s.key").drop("_s")


def summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A-03, A-04: per stratum n, accuracy, latency, token means, abstentions and errors, with one aggregation over grouping sets."""
    keys = keys or []
    shaped = df.select(*keys, "correct", "latency_s", "input_tokens", "output_tokens", "abstained", "error", *[pystr(F.col(d), d == "cap_answer_safe").alias(d) for d in STRATA])
    sets = [[F.col(k) for k in keys], *[[*[F.col(k) for k in keys], F.col(d)] for d in STRATA]]
    aggs = [
        *accuracy(),
        F.avg("latency_s").alias("latency_mean"),
        F.count("latency_s").alias("latency_n"),
        F.avg("input_tokens").alias("input_tokens_mean"),
        F.avg("output_tokens").alias("output_tokens_mean"),
        F.try_divide(F.count_if(truthy(F.col("abstained"))).cast("double"), F.count("*")).alias("abstain_rate"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"),
    ]
    marks = [F.grouping(d).alias(f"_{d}") for d in STRATA]
    got = shaped.groupingSets(sets, *[F.col(k) for k in keys], *[F.col(d) for d in STRATA]).agg(*aggs, *marks)
    dim, key = F.lit("overall"), F.lit("")
    for d in STRATA:
        dim, key = F.when(F.col(f"_{d}") == 0, d).otherwise(dim), F.when(F.col(f"_{d}") == 0, F.col(d)).otherwise(key)
    got = got.withColumn("dim", dim).withColumn("key", key).drop(*STRATA, *[f"_{d}" for d in STRATA])
    fanned = by_strata(df.select(*keys, "latency_s", *STRATA))
    lat = percentiles(fanned, [*keys, "dim", "key"], "latency_s", {"latency_p50": 0.5, "latency_p95": 0.95})
    same = reduce(lambda a, b: a & b, [got[k].eqNullSafe(lat[k]) for k in [*keys, "dim", "key"]])
    return got.join(lat, same, "left").select(*[got[c] for c in got.columns], "latency_p50", "latency_p95")


def summary_lines(calls: float = 1.0) -> list[Column]:
    """A-36: the lines of a text report on a row of summary(): overall, latency (null without latencies) and tokens (null without counts)."""
    percent = lambda c, places: fixed(F.col(c) * 100, places)
    overall = F.format_string("%d/%d = %s%%   abstain=%s%%  errors=%d", "n_correct", "n", percent("acc", 1), percent("abstain_rate", 0), "errors")
    latency = F.format_string("p50=%s p95=%s mean=%s", *[fixed(F.col(f"latency_{c}")) for c in ("p50", "p95", "mean")])
    tokens = F.format_string(f"in~%s out~%s calls~{calls:.1f}", fixed(F.col("input_tokens_mean"), 0), fixed(F.col("output_tokens_mean"), 0))
    return [
        F.when(F.col("n") > 0, overall).otherwise("(no rows)").alias("overall"),
        F.when(F.col("latency_p50").isNotNull(), latency).alias("latency"),
        F.when(F.col("input_tokens_mean").isNotNull(), tokens).alias("tokens"),
    ]


def pass_accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    """A-07: one accuracy per group and pass; the order of a list of passes is that of the pass as text."""
    return df.groupBy(*keys, pystr(F.col("pass_idx")).alias("pass")).agg(*accuracy())


def spread(df: DataFrame, keys: list[str], value: str = "acc", sample: bool = False) -> DataFrame:
    """A-08, A-13: mean and deviation over passes, of the population or the sample; one pass has a deviation of 0."""
    std = F.coalesce(F.stddev_samp(value), F.when(F.count(value) > 0, F.lit(0.0))) if sample else F.stddev_pop(value)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), std.alias("std"), F.count(value).alias("n_passes"))


def cross_tab(df: DataFrame, a: str, b: str) -> DataFrame:
    """A-09: spread over passes in every cell of two keys, cells without rows too."""
    cells = spread(pass_accuracy(df, [a, b]), [a, b])
    # the two lists of keys: one row per distinct key
    grid = df.select(a).distinct().withColumn("_", F.lit(1)).join(df.select(b).distinct().withColumn("_", F.lit(1)), "_").drop("_")
    same = grid[a].eqNullSafe(cells[a]) & grid[b].eqNullSafe(cells[b])
    return grid.join(cells, same, "left").select(grid[a], grid[b], "mean", "std", F.coalesce("n_passes", F.lit(0)).cast("long").alias("n_passes"))


def category_scalar() -> Column:
    """A-10: the mean of the first kind of score that a group has; 0 if none."""
    acc = F.try_divide(F.count_if(truthy(F.col("is_correct"))).cast("double"), F.count("is_correct"))
    return F.coalesce(F.avg("rouge_l"), F.avg("partial_credit"), acc, F.lit(0.0))


def final_table(df: DataFrame) -> DataFrame:
    """A-11: one row per category with its kind of score, and the pooled accuracy of the multiple-choice ones."""
    per = df.groupBy("category").agg(
        F.count("rouge_l").alias("n_rouge"),
        F.count("partial_credit").alias("n_credit"),
        F.count_if(truthy(F.col("is_correct"))).alias("n_correct"),
        F.count("is_correct").alias("n_choice"),
        category_scalar().alias("score"),
    )
    kind = F.when(F.col("n_rouge") > 0, "summarization").when(F.col("n_credit") > 0, "counting").otherwise("mc")
    per = per.withColumn("kind", kind).withColumn("n", F.when(kind == "summarization", F.col("n_rouge")).when(kind == "counting", F.col("n_credit")).otherwise(F.col("n_choice")))
    mc = per.where("kind = 'mc'").agg(
        F.lit("overall_mc").alias("category"), F.lit("mc").alias("kind"), F.sum("n").alias("n"), F.coalesce(F.try_divide(F.sum("n_correct").cast("double"), F.sum("n")), F.lit(0.0)).alias("score")
    )
    return per.select("category", "kind", "n", "score").union(mc.select("category", "kind", "n", "score"))


def sweep(df: DataFrame, frames: dict[str, int]) -> DataFrame:
    """A-16: mean and population deviation, in percent, of the passes' accuracy by category and frame budget, 'Overall' too; other methods are left out."""
    dim = df.sparkSession.createDataFrame(list(frames.items()), "method string, budget int")  # one row per configured method
    rows = df.join(F.broadcast(dim), "method")
    fanned = rows.withColumn("category", F.explode(F.array(F.lit("Overall"), F.col("task_type"))))
    got = spread(pass_accuracy(fanned, ["category", "budget"]), ["category", "budget"])
    return got.select("category", "budget", (F.col("mean") * 100).alias("mean"), (F.col("std") * 100).alias("std"), "n_passes")


def panels(df: DataFrame, frames: dict[str, int]) -> DataFrame:
    """A-17: (category, n) of the categories that the smallest budget's rows hold, 'Overall' too; n is the number of rows by that of passes, whole."""
    least = min(frames, key=frames.get)
    fanned = df.where(F.col("method") == least).withColumn("category", F.explode(F.array(F.lit("Overall"), F.col("task_type"))))
    per = fanned.groupBy("category", "pass_idx").agg(F.count("*").alias("t"))
    return per.groupBy("category").agg(F.expr("sum(t) div count(*)").alias("n"))


def gains(swept: DataFrame, chance: DataFrame, default: float = 25.0) -> DataFrame:
    """A-17, A-20, J-09: per category the gain from the smallest to the largest budget, the best budget (the smallest of equals), and its margin over chance."""
    first, last = F.min_by("mean", "budget"), F.max_by("mean", "budget")
    best = F.max_by("budget", F.struct("mean", -F.col("budget")))
    per = swept.groupBy("category").agg((last - first).alias("gain"), best.alias("best_budget"), F.max("mean").alias("best"))
    return per.join(chance, "category", "left").withColumn("chance", F.coalesce("chance", F.lit(default))).withColumn("margin", F.col("best") - F.col("chance"))


def chance(df: DataFrame, key: str = "task_type", options: str = "n_options") -> DataFrame:
    """A-18: the chance level in percent, per key and pooled; a question without options is an error."""
    share = F.lit(100.0) * F.avg(F.lit(1.0).cast("double") / F.col(options))
    return df.groupingSets([[F.col(key)], []], F.col(key)).agg(F.grouping(key).alias("pooled"), F.count("*").alias("n"), share.alias("chance")).select(
        F.when(F.col("pooled") == 1, "pooled").otherwise(F.col(key)).alias("category"), "n", "chance"
    )


def estimate(n: Column, strategy: Column, frames: Column, price_in: Column, price_out: Column) -> Column:
    """A-31: rough USD before a run; null without a price. 800 tokens a frame and 400 of text go in, 64 come out of one call a question;
    decentralised, three cameras send 512 tokens each to a last call that answers with 16."""
    frame, text, cameras, told = 800, 400, 3, 512
    apart = strategy == "decentralized"
    given = F.when(apart, cameras * (frames * frame + text) + (cameras * told + text)).otherwise(frames * frame + text)
    got = F.when(apart, F.lit(cameras * told + 16)).otherwise(F.lit(64))
    return n * (given / 1e6 * price_in + got / 1e6 * price_out)


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """J-02: calls with their cost in USD; models without a price cost nothing."""
    joined = calls.join(prices, "model", "left")
    usd = F.coalesce(F.col("prompt_tokens") / 1e6 * F.col("price_in") + F.col("completion_tokens") / 1e6 * F.col("price_out"), F.lit(0.0))
    return joined.withColumn("usd", usd)
