import random

from pyspark.sql import functions as F

from mosaiq.operators import metrics
from mosaiq.plans import planning


def test_percentiles_are_nearest_rank_half_even(spark):
    rng = random.Random(2)
    rows = [("a", float(x)) for x in (1, 2, 3, 4)] + [("b", None)] + [("c", float(rng.randint(0, 9))) for _ in range(101)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["p50"], r["p95"]) for r in metrics.percentiles(df, ["g"], "x", {"p50": 0.5, "p95": 0.95}).collect()}
    c = sorted(x for g, x in rows if g == "c")
    assert got == {"a": (3.0, 4.0), "c": (c[round(0.5 * 100)], c[round(0.95 * 100)])}


def test_spread(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.7), ("b", 0.4), ("c", None)], "g string, acc double")
    pop = {r["g"]: (r["std"], r["n_passes"]) for r in metrics.spread(df, ["g"]).collect()}
    smp = {r["g"]: r["std"] for r in metrics.spread(df, ["g"], sample=True).collect()}
    assert abs(pop["a"][0] - 0.1) < 1e-12 and pop["b"] == (0.0, 1) and pop["c"] == (None, 0)
    assert abs(smp["a"] - 0.02**0.5) < 1e-12 and smp["b"] == 0.0 and smp["c"] is None


def test_cross_tab_has_empty_cells_and_null_keys(spark):
    df = spark.createDataFrame([("x", 1, 0, True), ("y", None, 0, None), ("x", 1, 1, False)], "task_type string, orig_num_cameras int, pass_idx int, correct boolean")
    got = {(r["task_type"], r["orig_num_cameras"]): (r["mean"], r["n_passes"]) for r in metrics.cross_tab(df, "task_type", "orig_num_cameras").collect()}
    assert got == {("x", 1): (0.5, 2), ("x", None): (None, 0), ("y", 1): (None, 0), ("y", None): (0.0, 1)}


def test_chance(spark):
    df = spark.createDataFrame([("t", 4)] * 861 + [("t", 2)] * 139, "task_type string, n_options int")
    got = {r["category"]: r["chance"] for r in metrics.chance(df).collect()}
    assert abs(got["pooled"] - 28.475) < 1e-9


def test_cost_cut(spark):
    calls = lambda ok: spark.createDataFrame([(i + 1, 4.0, o) for i, o in enumerate(ok)], "seq long, usd double, ok boolean").withColumn("usd", F.col("usd").cast("decimal(20,6)"))
    kept = lambda ok, cap, block=2: [r["seq"] for r in planning.cost_cut(calls(ok), cap, block=block).orderBy("seq").collect()]
    assert kept([True] * 4, 5) == [1, 2]
    assert kept([True, False, True, True], 5) == [1, 3]
    assert kept([True] * 4, 0) == [1]
    assert kept([True] * 4, 100) == [1, 2, 3, 4]


def test_greedy_prefix(spark):
    df = spark.createDataFrame([("c", 9, 2), ("a", 3, 0), ("b", 5, 1)], "t string, size long, pos long")
    take = lambda b, m=9: [r["t"] for r in planning.greedy_prefix(df, "size", "pos", F.lit(b), m).orderBy("pos").collect()]
    assert take(2) == ["a"] and take(10) == ["a", "b"] and take(0) == ["a", "b", "c"] and take(0, 1) == ["a"]


def test_top_with_floor_equals_a_loop(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for q in range(40):
        k, budget, floor = rng.randint(1, 4), rng.randint(1, 8), rng.randint(0, 3)
        pool = [(q, p, f"c{rng.randrange(k)}", rng.randint(0, 4), budget, floor) for p in range(rng.randint(1, 14))]
        rows += pool
        clips = {x[2] for x in pool}
        least = max(0, min(floor, budget // len(clips)))
        order = sorted(pool, key=lambda x: (-x[3], x[1]))
        got, seen = [], {}
        for x in order:
            seen[x[2]] = seen.get(x[2], 0) + 1
            if seen[x[2]] <= least:
                got.append(x[1])
        got += [x[1] for x in order if x[1] not in got]
        expected[q] = sorted(got[:budget])
    df = spark.createDataFrame(rows, "qid long, pos long, clip string, score long, budget long, floor_n long")
    out = {}
    for r in planning.top_with_floor(df).collect():
        out.setdefault(r["qid"], []).append(r["pos"])
    assert {q: sorted(x) for q, x in out.items()} == expected


def test_balanced_equals_a_loop(spark):
    rng = random.Random(6)
    for n, cap in ((7, 3), (20, 2), (4, 9)):
        rows = [(i, f"t{rng.randrange(3)}", rng.choice(["meva", "ego-exo4d"]), k := rng.randint(0, 9), max(0, k - 4)) for i in range(25)]
        by = {}
        for r in sorted(rows):
            by.setdefault(r[1], {}).setdefault("1" if r[3] <= 1 else "2-4" if r[3] <= 4 else "5-7" if r[3] <= 7 else "8+", []).append(r)
        turn = {t: [x for i in range(25) for b in sorted(bs) for x in bs[b][i : i + 1]] for t, bs in by.items()}
        got = [turn[t][i] for i in range(cap) for t in sorted(turn) if i < len(turn[t])][:n]
        lossy = [r for r in rows if r[2] == "ego-exo4d" and r[4] > 0]
        if lossy and not any(r in lossy for r in got):
            got.append(lossy[0])
        got += [r for r in rows if r not in got][: max(0, n - len(got))]
        expected = [r[0] for r in sorted(got, key=lambda r: (r[1], r[3], r[0]))[:n]]
        df = spark.createDataFrame(rows, "id long, task_type string, source string, orig_num_cameras long, dropped_cameras long")
        assert [r["id"] for r in planning.balanced(df, n, cap).orderBy("task_type", "orig_num_cameras", "id").collect()] == expected


def test_bracketing_takes_the_first_listed(spark):
    tars = spark.createDataFrame([(0, "t", "b", 5, 30), (1, "t", "a", 0, 14), (2, "u", "c", 0, 99)], "listing_pos long, task string, tar_path string, lo long, hi long")
    asked = spark.createDataFrame([("t", 3), ("t", 7), ("t", 40), ("u", 40)], "task string, episode long")
    got = {(r["task"], r["episode"]): r["tar_path"] for r in planning.bracketing(asked, tars, 10).collect()}
    assert got == {("t", 3): "a", ("t", 7): "b", ("t", 40): None, ("u", 40): "c"}
