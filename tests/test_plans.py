"""Physical plans: pruning, broadcast only under a proven bound, partial aggregation,
no cartesian products, no Python in the join layout; skewed keys stay correct."""

import os
import random

import pytest

import __spark_entry__ as entry
from conftest import mat
from tessera import VectorFrame
from tessera.plans import physical_plan

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)


@pytest.mark.skipif(not HAVE, reason="driver tables not present")
def test_flagship_plan_prunes_broadcasts_and_combines(spark):
    plan = physical_plan(entry.entry(spark))
    assert "BroadcastHashJoin" in plan
    assert "partial_sum" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@pytest.mark.skipif(not HAVE, reason="driver tables not present")
def test_no_broadcast_above_the_bound(spark):
    old_rows = spark.conf.get("tessera.broadcast.maxRows", "4000000")
    old_auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    old_aqe = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    try:
        spark.conf.set("tessera.broadcast.maxRows", "10")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        df = entry.queries()["spmv"](spark, SF)
        plan = physical_plan(df)
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
        assert "SortMergeJoin" not in plan
        oracle = sorted(tuple(r) for r in entry.entry(spark).collect())
        assert sorted(tuple(r) for r in df.collect()) == oracle
    finally:
        spark.conf.set("tessera.broadcast.maxRows", old_rows)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old_auto)
        if old_aqe is None:
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        else:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old_aqe)


@pytest.mark.skipif(not HAVE, reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - {
    "mm_round_trip", "mm_sym_round_trip", "mm_array_round_trip", "mm_pattern_round_trip",
    "mm_info", "mm_check", "vector_round_trip", "vector_pairs_round_trip", "check_results"}))
def test_no_cartesian_products(spark, name):
    plan = physical_plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, name


def _skewed(spark, n=3000, seed=3):
    """A third of the entries in row 0, a third in column 0, the rest spread."""
    rnd = random.Random(seed)
    triples = [(0, rnd.randrange(200), 1.0) for _ in range(n)]
    triples += [(rnd.randrange(500), 0, 2.0) for _ in range(n)]
    triples += [(rnd.randrange(500), rnd.randrange(200), 0.5) for _ in range(n)]
    return triples


@pytest.mark.parametrize("layout", ["join", "packed", "blocked"])
@pytest.mark.parametrize("bcast", [True, False])
def test_hot_row_and_column(spark, layout, bcast):
    triples = _skewed(spark)
    a = mat(spark, triples, 500, 200)
    xs = [(k, float(k % 11) - 5) for k in range(200)]
    x = VectorFrame(spark.createDataFrame(xs, "i long, x double"), 200, True)
    want = {}
    for i, j, v in triples:
        want[i] = want.get(i, 0.0) + v * xs[j][1]
    got = {r.i: r.x for r in a.multiply(x, layout=layout, broadcast=bcast, width=32).df.collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)


def test_shuffled_join_splits_a_hot_column(spark):
    """Without a broadcast, a column holding a third of the entries is split by AQE."""
    from tessera import MatrixFrame

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(60000).selectExpr(
            "id % 3000 AS i", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 2003 END AS j", "1.0 AS v")
        a = MatrixFrame(df, 3000, 2003)
        x = VectorFrame(spark.range(2003).selectExpr("id AS i", "CAST(id AS DOUBLE) AS x"), 2003, True)
        y = a.multiply(x, broadcast=False)
        got = {r.i: r.x for r in y.df.collect()}
        assert "ShuffledHashJoin(skew=true)" in physical_plan(y.df)
        want = {}
        for k in range(60000):
            j = 0 if k % 3 == 0 else k % 2003
            want[k % 3000] = want.get(k % 3000, 0.0) + float(j)
        assert got == want
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_prepare_clusters_rows_so_partial_sums_shrink(spark):
    """On entries in random order, the product's shuffle carries one partial sum per
    (task, row); after prepare('join') it carries about one per row."""
    import re

    from pyspark.sql import functions as F

    from tessera import MatrixFrame

    df = spark.range(40000).selectExpr("id % 2000 AS i", "(id div 2000) * 25 AS j", "1.0 AS v")
    scrambled = df.repartition(8, F.xxhash64("i", "j")).cache()   # explicit count: not coalesced
    scrambled.count()
    a = MatrixFrame(scrambled, 2000, 500)
    x = VectorFrame(spark.range(500).selectExpr("id AS i", "1.0 AS x"), 500, True)

    def product_shuffle_rows(y):
        y.df.collect()
        stats = re.findall(r"ShuffleQueryStage \(\d+\), Statistics\(sizeInBytes=[^,]+, rowCount=([^)]+)\)",
                           physical_plan(y.df))
        return float(stats[0])

    before = product_shuffle_rows(a.multiply(x, broadcast=True))
    a.prepare("join")
    after = product_shuffle_rows(a.multiply(x, broadcast=True))
    assert after <= 2000 * 1.05 < before
