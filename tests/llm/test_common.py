import os

from mosaiq.llm import common
from mosaiq.llm.components import components


def test_node_filter_sets_the_low_bits(spark):
    nodes = [0, 1, 32767, 32768, 65535, 65536, -1, (1 << 40) + 5]
    bits = common.node_filter(spark.createDataFrame([(n,) for n in nodes], "node long"), 20)
    held = {i for i in range(1 << 20) if bits[i // 8] >> (i % 8) & 1}
    assert len(bits) == 1 << 17 and held == {n & ((1 << 20) - 1) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 200), (300, 301), (301, 300)] + [(1000, 1000 + i) for i in range(1, 60)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 300: 300, 301: 300, **dict.fromkeys(range(1000, 1060), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_cut_and_release(spark):
    df = common.cut(spark.range(5), "x")
    path = df._scratch.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    common.release(df, spark.range(1))
    assert not os.path.isdir(path)
