"""Mixing sources to target weights over a domain - language - source tree.

A token budget is dealt from the root down. At each node it is shared out by the
children's weights; a child that can't use its share (all its tokens, as often
as epochs allow) takes what it can, and the rest goes to its siblings by their
weights. A node never gets more than its whole subtree can use, so a shortage
reaches an ancestor only when no sibling below can take it. A leaf's budget is
some full epochs and a prefix of a seeded order of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEVELS = ("domain", "lang", "source")
#: Production parameters: integer weights by level (others: 1), the budget as a share of all tokens, and epochs.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 6, "de": 2}, "source": {}}
SHARE, EPOCHS, SEED = (3, 5), 3, 17
#: Documents in a bucket of a leaf's seeded order, about.
BUCKET = 1024
#: Leaves up to which their plan is broadcast; beyond, the join shuffles.
FEW = 50_000
TOKEN = "[^\\x09-\\x0D\\x20]+"


def domain_of(source: Column) -> Column:
    """The domain of a source where the table has none: thirds of the source's digest."""
    d = F.substring(F.md5(source), 1, 1)
    return F.when(d < "5", "d0").when(d < "a", "d1").otherwise("d2")


def _weight(level: str, name: Column, weights: dict) -> Column:
    out = F.lit(1).cast("long")
    for k, v in sorted(weights.get(level, {}).items()):
        out = F.when(name == k, F.lit(v).cast("long")).otherwise(out)
    return out


def plan(leaves: DataFrame, levels: tuple[str, ...], weights: dict, share: tuple[int, int], epochs: int) -> DataFrame:
    """Adds the budget of each leaf: levels, tokens, docs, budget."""
    known = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = known.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("cap"), F.lit(0)).alias("c"))
    at = total.select(F.least(F.floor(F.col("t") * share[0] / share[1]).cast("long"), "c").alias("given"))
    for depth, level in enumerate(levels):
        up = list(levels[:depth])
        node = known.groupBy(*up, level).agg(F.sum("cap").alias("cap"))
        node = node.join(at, up) if up else node.join(F.broadcast(at))  # one row
        node = node.withColumn("w", _weight(level, F.col(level), weights))
        by = Window.partitionBy(*up) if up else Window.partitionBy(F.lit(0))
        order = by.orderBy(F.col("cap") / F.col("w"), level)
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        node = node.withColumn("full", F.col("cap") * rest <= (F.col("given") - before) * F.col("w"))
        left = F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by)
        open_w = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(by)
        got = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("left * w div open_w"))
        at = node.withColumn("left", left).withColumn("open_w", open_w).select(*up, level, got.alias("given"))
    return leaves.join(at.withColumnRenamed("given", "budget"), list(levels))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    domain: str | None = None,
    weights: dict = WEIGHTS,
    share: tuple[int, int] = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies): documents with at least one copy in the mixture.

    Tokens are runs between ASCII white space. A null or empty text has none; it is in every epoch of its leaf, and in the prefix up to
    the document at which the prefix ends. A null lang or source is the leaf ''. The prefix takes documents while their running sum of
    tokens is within the budget. The order is that of the digest of seed, epoch and doc_id, so repeated rows of a doc_id lie side by
    side, and a null doc_id has the digest of 'null'. An empty table, or a budget of 0, gives no prefix. Other columns are ignored.
    """
    source, t = F.coalesce(F.col("source"), F.lit("")), F.col(f"`{text}`")
    of = F.col(f"`{domain}`") if domain else domain_of(source)
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(of, F.lit("")).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        source.alias("source"),
        F.coalesce(F.regexp_count(t, F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = cut(rows, "tokens")
    leaf = list(LEVELS)
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    planned = plan(leaves, LEVELS, weights, share, epochs)
    planned = planned.select(
        *leaf,
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long").alias("full"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("rest"),
        F.greatest(F.lit(1), F.expr(f"docs div {BUCKET}")).cast("long").alias("buckets"),
    )
    planned = cut(planned, "plan")
    small = planned.count() <= FEW
    wide = rows.join(F.broadcast(planned) if small else planned, leaf)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    wide = wide.withColumn("digest", digest).withColumn("bucket", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("buckets") / 4294967296).cast("long"))
    # running sums by bucket, then within a bucket: no task sees a whole leaf
    sums = wide.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = sums.select(*leaf, "bucket", before.alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy(*leaf, "bucket").orderBy("digest", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    done = wide.withColumn("inside", inside).join(start, [*leaf, "bucket"])
    extra = F.when((F.col("rest") > 0) & (F.col("before") + F.col("inside") <= F.col("rest")), 1).otherwise(0)
    return done.select("doc_id", *leaf, "n_tokens", (F.col("full") + extra).cast("long").alias("copies")).where("copies > 0")


def sql(weights: dict = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> str:
    """The same in DuckDB SQL."""

    def weight(level):
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(weights.get(level, {}).items()))
        return f"CASE {level} {cases} ELSE 1 END" if cases else "1"

    steps, up = [], []
    for level in LEVELS:
        keys = ", ".join([*up, level])
        join = f"JOIN at{len(up)} USING ({', '.join(up)})" if up else "CROSS JOIN at0"
        part = f"PARTITION BY {', '.join(up)}" if up else ""
        n = len(up)
        steps.append(
            f"""n{n} AS (SELECT k.*, given, {weight(level)} AS w FROM (SELECT {keys}, CAST(sum(tokens) * {epochs} AS BIGINT) AS cap FROM leaves GROUP BY {keys}) k {join}),
f{n} AS (SELECT *, cap * sum(w) OVER ({part} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (given - coalesce(sum(cap) OVER ({part} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM n{n}),
at{n + 1} AS (SELECT {keys}, CAST(CASE WHEN is_full THEN cap ELSE ((given - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part})) * w)
  // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) END AS BIGINT) AS given FROM f{n})"""
        )
        up.append(level)
    keys = ", ".join(LEVELS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '5' THEN 'd0' WHEN substr(md5(coalesce(source, '')), 1, 1) < 'a' THEN 'd1' ELSE 'd2' END AS domain,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT {keys}, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY {keys}),
at0 AS (SELECT least(CAST(sum(tokens) AS BIGINT) * {share[0]} // {share[1]}, CAST(sum(tokens) * {epochs} AS BIGINT)) AS given FROM leaves),
{", ".join(steps)},
p AS (SELECT {keys}, tokens, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS full_epochs, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM leaves JOIN at3 USING ({keys})),
r AS (SELECT doc_id, d.domain, d.lang, d.source, n_tokens, full_epochs, rest, sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source
  ORDER BY md5('{seed}:' || full_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS running
  FROM d JOIN p ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source)
SELECT doc_id, domain, lang, source, n_tokens, CAST(full_epochs + CASE WHEN rest > 0 AND running <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r
WHERE full_epochs + CASE WHEN rest > 0 AND running <= rest THEN 1 ELSE 0 END > 0"""
