"""Plans over questions and clips: top-k with floors, greedy prefixes, stratified round-robin, range joins, cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, group: list[str], key: str, name: str = "place", block: int = 1 << 16) -> DataFrame:
    """Adds the place, from 0, of each row among those of its group, in order of a unique whole number: places within blocks of numbers, and the sizes of the blocks before."""
    rows = df.withColumn("_b", F.floor(F.col(key) / block))
    sizes = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(key)) - 1
    wide = rows.withColumn("_at", at).join(sizes.select(*group, "_b", before.alias("_s")), [*group, "_b"])
    return wide.withColumn(name, (F.col("_s") + F.col("_at")).cast("long")).select(*df.columns, name)


def shard(df: DataFrame, group: str, key: str, n: int, i: int) -> DataFrame:
    """F-04, W-02: the i-th of n shards, by position of the sorted key within a group."""
    return placed(df, [group], key, "_at").where(F.col("_at") % n == i).drop("_at")


def drop_reason(kept_type: Column, is_mcq: Column, answer: Column, flags: Column, cameras: Column, options: Column, local: Column, least: int = 2) -> Column:
    """F-05: the first reason to leave a question out, or 'kept': type, open-ended, bad answer, flagged, no video, few options, missing local files."""
    letter = F.upper(F.trim(F.coalesce(answer, F.lit("")))).isin("A", "B", "C", "D")
    flagged = F.arrays_overlap(flags, F.array(F.lit("missing_answer"), F.lit("unparseable_question_json")))
    reasons = [
        (~kept_type, "drop_type"), (~is_mcq, "drop_open_ended"), (~letter, "drop_bad_answer"), (F.coalesce(flagged, F.lit(False)), "drop_flagged"),
        (cameras == 0, "drop_no_video"), (options < least, "drop_few_options"), (local < cameras, "drop_missing_local"),
    ]
    return F.coalesce(*[F.when(c, r) for c, r in reasons], F.lit("kept"))


def bucket(k: Column) -> Column:
    """P-11: buckets of camera counts."""
    return F.when(k <= 1, "1").when(k <= 4, "2-4").when(k <= 7, "5-7").otherwise("8+")


def top_with_floor(pool: DataFrame, q: str = "qid", clip: str = "clip") -> DataFrame:
    """T-02: the budget's best frames of each question, after each clip's best frames up to the floor; adds rank and whether a plain top would take it.

    The floor is at most the budget by the number of clips. Ties go to the earlier place in the pool.
    """
    order = [F.desc("score"), F.asc("pos")]
    overall = F.row_number().over(Window.partitionBy(q).orderBy(*order))
    own = F.row_number().over(Window.partitionBy(q, clip).orderBy(*order))
    first_of_clip = (F.row_number().over(Window.partitionBy(q, clip).orderBy("pos")) == 1).cast("long")
    ranked = pool.withColumn("g", overall).withColumn("c", own).withColumn("_new", first_of_clip)
    clips = F.sum("_new").over(Window.partitionBy(q))
    floor = F.greatest(F.lit(0), F.least(F.col("floor_n"), F.floor(F.col("budget") / clips)))
    ranked = ranked.withColumn("n_clips", clips).withColumn("held", (F.col("c") <= floor).cast("int"))
    place = F.row_number().over(Window.partitionBy(q).orderBy(F.desc("held"), "g"))
    return ranked.withColumn("place", place).where(F.col("place") <= F.col("budget")).withColumn("plain", F.col("g") <= F.col("budget")).drop("_new")


def starved(pool: DataFrame, q: str = "qid", clip: str = "clip") -> DataFrame:
    """T-03: clips of a question that the plain top of the budget leaves out."""
    overall = F.row_number().over(Window.partitionBy(q).orderBy(F.desc("score"), "pos"))
    ranked = pool.withColumn("g", overall)
    # one row per clip, then per question
    per = ranked.groupBy(q, clip).agg(F.max((F.col("g") <= F.col("budget")).cast("long")).alias("seen"))
    return per.groupBy(q).agg(F.count("*").alias("n_clips"), (F.count("*") - F.sum("seen")).alias("starved"))


def greedy_prefix(df: DataFrame, size: str, tie: str, budget: Column, most: int) -> DataFrame:
    """W-08: cheapest first while the running total is within the budget; the first is always taken; at most so many; a budget of 0 doesn't bind."""
    order = Window.partitionBy(F.lit(0)).orderBy(size, tie)
    ranked = df.orderBy(size, tie).limit(most).withColumn("rn", F.row_number().over(order)).withColumn("cum", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where(((F.col("rn") == 1) | (budget == 0) | (F.col("cum") <= budget)))


def cost_cut(calls: DataFrame, cap: float, seq: str = "seq", block: int = 1 << 16) -> DataFrame:
    """W-03: rows up to the first successful one at which the running cost reaches the cap; failed rows cost but are neither kept nor checked.

    Running sums go by blocks of the sequence first, so no task sorts all rows.
    """
    rows = calls.withColumn("_b", F.floor(F.col(seq) / block))
    sums = rows.groupBy("_b").agg(F.sum("usd").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums.select("_b", before.alias("_before")), "_b")
    inside = F.sum("usd").over(Window.partitionBy("_b").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("cum", F.col("_before") + inside)
    stop = rows.where(F.col("ok") & (F.col("cum") >= F.lit(cap).cast("decimal(20,6)"))).agg(F.min(seq).alias("_stop"))
    kept = rows.join(F.broadcast(stop)).where(F.col("ok") & (F.col("_stop").isNull() | (F.col(seq) <= F.col("_stop"))))  # one row
    return kept.drop("_b", "_before", "_stop")


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """W-04: the last row of each key in the given order; a partial aggregate, so no key is gathered."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def interleaved(q: DataFrame) -> DataFrame:
    """W-05: order of questions within a task type: the n-th of each camera bucket in turn."""
    rank = F.row_number().over(Window.partitionBy("task_type", "bucket").orderBy("id"))
    ranked = q.withColumn("bucket", bucket(F.col("orig_num_cameras"))).withColumn("r", rank)
    return ranked.withColumn("seq", F.row_number().over(Window.partitionBy("task_type").orderBy("r", "bucket"))).drop("r")


def balanced(q: DataFrame, n: int, cap: int) -> DataFrame:
    """W-06: round-robin over task types up to n and a cap per type; then one question with dropped cameras of ego-exo4d if none is chosen; then the smallest ids up to n; sorted and cut at n.

    Only each type's first ``cap`` questions and, for the back-fill, the n smallest other ids take part in the global order.
    """
    ordered = interleaved(q)
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("seq", "task_type"))
    chosen = ordered.where(F.col("seq") <= cap).orderBy("seq", "task_type").limit(n).withColumn("turn", turn).select("id", "turn")
    lossy = (F.col("source") == "ego-exo4d") & (F.col("dropped_cameras") > 0)
    marked = q.join(F.broadcast(chosen), "id", "left").withColumn("lossy", lossy)  # n rows
    stats = marked.agg(F.count("turn").alias("k"), F.max((F.col("lossy") & F.col("turn").isNotNull()).cast("int")).alias("has"), F.min(F.when(F.col("lossy"), F.col("id"))).alias("extra"))
    marked = marked.join(F.broadcast(stats))  # one row
    forced = F.col("turn").isNull() & (F.col("has") == 0) & (F.col("id") == F.col("extra"))
    marked = marked.withColumn("got", F.col("turn").isNotNull() | forced)
    filled = F.col("k") + F.when((F.col("has") == 0) & F.col("extra").isNotNull(), 1).otherwise(0)
    rest = marked.where(~F.col("got")).orderBy("id").limit(n)
    rest = rest.withColumn("fill", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id"))).where(F.col("fill") <= n - filled)
    both = marked.where("got").select(*q.columns).union(rest.select(*q.columns))
    return both.orderBy("task_type", "orig_num_cameras", "id").limit(n)


def bracketing(episodes: DataFrame, tars: DataFrame, width: int) -> DataFrame:
    """J-06: for each (task, episode) the first listed archive whose range holds it, or null.

    Ranges are cut into cells of ``width`` episodes, so the join is on equal (task, cell) with a residual test and no nested loop.
    """
    cells = tars.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    asked = episodes.withColumn("cell", F.floor(F.col("episode") / width))
    hit = asked.join(cells, ["task", "cell"]).where(F.col("episode").between(F.col("lo"), F.col("hi")))
    first = hit.groupBy("task", "episode").agg(F.min_by("tar_path", "listing_pos").alias("tar_path"))
    return episodes.join(first, ["task", "episode"], "left")


def listed(wanted: DataFrame, listing: DataFrame, keys: list[str], key: str) -> DataFrame:
    """J-04: what is wanted with the key listed for it, of several the last; what isn't listed is marked missing."""
    last = listing.groupBy(*keys).agg(F.max(key).alias(key))
    return wanted.join(last, keys, "left").withColumn("missing", F.col(key).isNull())


def complete(questions: DataFrame, clips: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-05: the questions all of whose clips are present, and the others with their first missing clip."""
    missing = clips.join(present, "path", "left_anti").groupBy("qid").agg(F.min_by("path", "slot").alias("first_missing"))
    return questions.join(missing.select("qid"), "qid", "left_anti"), questions.join(missing, "qid")


def cap_ordered(paths: Column, first: Column, most: int = 4) -> Column:
    """P-14: the first unseen path for each required camera, then the others in order, cut at the most."""
    base = lambda p: F.element_at(F.split(p, "/"), -1)

    def step(acc, cid):
        hit = F.get(F.filter(paths, lambda p: F.contains(base(p), F.concat(F.lit("."), cid, F.lit("."))) & ~F.array_contains(acc, p)), F.lit(0))
        return F.when(hit.isNull(), acc).otherwise(F.concat(acc, F.array(hit)))

    chosen = F.aggregate(first, F.array().cast("array<string>"), step)
    return F.slice(F.concat(chosen, F.array_except(paths, chosen)), 1, most)


def cap_flagged(paths: Column, flag, most: int = 4) -> Column:
    """P-15: flagged paths first, then the others, each in order, cut at the most."""
    return F.slice(F.concat(F.filter(paths, flag), F.filter(paths, lambda p: ~flag(p))), 1, most)
