import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.ids import id_key
from plumbline.operators.components import connected_components
from plumbline.plans import skew


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in parent}


def run(spark, edges):
    df = spark.createDataFrame(edges or [], "a string, b string")
    rows = connected_components(df.withColumn("component", F.lit(1)).withColumn("c", F.lit("x")), "a", "b").collect()
    out = {r["node"]: r["component"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_chain_star_and_dirt(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)] + [("hub", f"x{i}") for i in range(50)]
    edges += [("q", "q"), (None, "z"), ("y", None), ("n003", "n001"), ("n001", "n003"), ("é", "A")]
    assert run(spark, edges) == brute(edges)


def test_no_edges(spark):
    assert run(spark, []) == {}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_random_graphs(spark, pairs):
    edges = [(f"k{a}", f"k{b}") for a, b in pairs]
    assert run(spark, edges) == brute(edges)


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_LEAST_ROWS", 10)
    monkeypatch.setattr(skew, "HOT_SHARE", 20)
    random.seed(3)
    keys = ["hot"] * 300 + [f"k{random.randrange(200)}" for _ in range(300)] + [None] * 5
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(100)], "k string, v int")
    for how in ("left", "inner"):
        got = sorted(map(tuple, skew.lookup(rows, "k", table, how).select("k", "i", "v").collect()), key=str)
        want = sorted(map(tuple, rows.join(table, "k", how).select("k", "i", "v").collect()), key=str)
        assert got == want


def test_id_keys(spark):
    words = ["ab-1", " A.b 1\t", "n/a", "N.A.", "??", "", None, "null", "Unknown", "-", "é7", "none "]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(id_key("w")).collect()]
    assert got == ["AB1", "AB1", None, None, None, None, None, None, None, None, "É7", None]


def test_tables_of_a_session_can_be_dropped(spark):
    from pathlib import Path

    from plumbline.plans import lineage

    df = lineage.cut(spark.range(5))
    folder = Path(next(f for f, _ in lineage._kept if f in df.inputFiles()[0]).removeprefix("file:"))
    assert df.count() == 5 and folder.is_dir()
    lineage.drop_kept()
    assert not folder.exists() and not lineage._kept


def test_tables_of_a_scope_go_with_it(spark):
    from pathlib import Path

    from plumbline.plans import lineage

    kept = lineage.cut(spark.range(2))
    with lineage.scope():
        gone = lineage.cut(spark.range(5))
        folder = Path(gone.inputFiles()[0].removeprefix("file:")).parent
        assert gone.count() == 5
    assert not folder.exists() and kept.count() == 2
    assert lineage.cut_counting(spark.range(9), F.col("id") > 6)[1] == 2 and lineage.cut_counting(spark.range(0))[1] == 0


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    import pytest

    from plumbline.plans import lineage

    assert [lineage.is_local(m) for m in ("local", "local[8]", "local-cluster[2,1,1024]", "yarn", "spark://h:7077")] == [True, True, False, False, False]

    class Bare:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Bare(), {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Session())
