"""Equal partitions, positions, heavy keys, compressed blocks and the routed graph against brute force."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import mat, vec
from tessera import MatrixFrame, VectorFrame
from tessera.operators import blocks, partition, routing
from tessera.operators import structure as st
from tessera.plans import physical_plan


def skewed(n=400, seed=1):
    """A third of the entries in row 0, a third in column 0; duplicates among them."""
    rnd = random.Random(seed)
    out = [(0, rnd.randrange(90), rnd.randint(-5, 5)) for _ in range(n)]
    out += [(rnd.randrange(60), 0, rnd.randint(-5, 5)) for _ in range(n)]
    return out + [(rnd.randrange(60), rnd.randrange(90), rnd.randint(-5, 5)) for _ in range(n)]


def summed(triples):
    out = {}
    for i, j, v in triples:
        out[i, j] = out.get((i, j), 0) + v
    return out


@pytest.mark.parametrize("blocks_per_level", [1 << 16, 3])
@pytest.mark.parametrize("parts", [1, 2, 7, 64, 1000])
def test_parts_hold_equal_counts_in_order(spark, monkeypatch, parts, blocks_per_level):
    monkeypatch.setattr(partition, "BLOCKS", blocks_per_level)
    triples = skewed()
    a = mat(spark, triples, 60, 90)
    cells = sorted(summed(triples))
    cuts = a.nnz_cuts(parts)
    got = a.balanced_cells(parts, cuts).withColumn("at", F.spark_partition_id()).collect()
    assert cuts.total == len(cells) == len(got)
    assert all(r["part"] == r["at"] for r in got)
    assert {(r["i"], r["j"]): r["part"] for r in got} == {c: n * parts // len(cells) for n, c in enumerate(cells)}
    sizes = [sum(r["part"] == k for r in got) for k in range(parts)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("parts", [1, 5, 50])
def test_positions_from_one_scan_of_each_part(spark, parts):
    triples = skewed(seed=2)
    a = mat(spark, triples, 60, 90)
    cuts = a.nnz_cuts(parts)
    got = sorted(tuple(r) for r in partition.part_positions(a.balanced_cells(parts, cuts), cuts).collect())
    want, seen = [], {}
    for (i, j), v in sorted(summed(triples).items()):
        want.append((i, seen.setdefault(i, 0), j, float(v)))
        seen[i] += 1
    assert got == want
    assert got == sorted(tuple(r) for r in a.indexed_entries().collect())


def test_positions_of_long_rows_by_column_blocks(spark, monkeypatch):
    triples = skewed(seed=3)
    a = mat(spark, triples, 60, 90)
    whole = sorted(tuple(r) for r in a.indexed_entries().collect())
    monkeypatch.setattr(partition, "LONG_ROW", 1)       # every matrix has long rows now
    monkeypatch.setattr(partition, "LEAST_SHARE", 0.2)  # row 0 holds more than that
    assert sorted(tuple(r) for r in a.indexed_entries(width=7).collect()) == whole


def test_positions_need_two_exchanges_of_cells_and_no_second_scan(spark):
    a = MatrixFrame(spark.range(1000).selectExpr("id % 37 AS i", "id % 91 AS j", "1.0 AS v"), 37, 91)
    plan = physical_plan(a.indexed_entries())
    assert plan.count("Exchange") <= 2 * plan.count("Initial Plan") + 4 and "Join" not in plan
    assert physical_plan(a.indexed_entries(), "simple").count("Range (") == 1
    canonical = physical_plan(MatrixFrame(a.entries, 37, 91, canonical=True).indexed_entries(), "simple")
    assert canonical.count("Exchange") == 1


def test_an_empty_matrix_and_more_parts_than_cells(spark):
    empty = MatrixFrame(spark.createDataFrame([], "i long, j long, v double"), 5, 5)
    assert empty.nnz_cuts(4).total == 0 and empty.balanced_cells(4).collect() == []
    assert empty.grid_blocks().collect() == [] and empty.indexed_entries().collect() == []
    one = mat(spark, [(4, 4, 2.0)], 5, 5)
    assert [(r["part"], r["v"]) for r in one.balanced_cells(8).collect()] == [(0, 2.0)]
    with pytest.raises(ValueError, match="parts"):
        one.nnz_cuts(0)


def test_prepare_with_balance(spark):
    triples = skewed(seed=4)
    x = vec(spark, [float(k % 7) for k in range(90)])
    a = mat(spark, triples, 60, 90)
    want = sorted(tuple(r) for r in a.multiply(x).df.collect())
    a.prepare("join", balance="nnz")
    form = a._prepared["join", False, 0]
    sizes = [r["count"] for r in form.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) - min(sizes) <= 1
    assert sorted(tuple(r) for r in a.multiply(x).df.collect()) == want
    a.unprepare()
    with pytest.raises(ValueError, match="balance"):
        a.prepare("join", balance="rows")


def test_heavy_keys_are_all_found(spark):
    df = spark.range(60000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 100 = 1 THEN 9 ELSE id + 100 END AS k")
    hot, n = partition.heavy_keys(df, "k", 0.005)
    truth = {r["k"]: r["count"] for r in df.groupBy("k").count().where("count >= 300").collect()}
    assert n == 60000 and set(truth) <= set(hot) and set(truth) == {7, 9}
    assert partition.heavy_keys(df.where("k < 0"), "k", 0.01) == ({}, 0)
    assert partition.heavy_keys(df.select(F.lit(None).cast("long").alias("k")), "k", 0.01)[0] == {}
    with pytest.raises(ValueError, match="share"):
        partition.heavy_keys(df, "k", 1e-9)


def test_salted_join_spreads_a_hot_column_without_aqe(spark):
    from tessera.operators.spmv import salted

    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = spark.range(60000).selectExpr("id AS i", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 20011 END AS j", "CAST(id % 5 AS DOUBLE) AS v")
        a = MatrixFrame(df, 60000, 20011)
        x = VectorFrame(spark.range(20011).selectExpr("id AS i", "CAST(id % 13 + 1 AS DOUBLE) AS x"), 20011, True)
        y = a.multiply(x, broadcast=False, salt=True)
        plan = physical_plan(y.df, "simple")
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Adaptive" not in plan
        assert sorted(map(tuple, y.df.collect())) == sorted(map(tuple, a.multiply(x).df.collect()))
        hot, total = partition.heavy_keys(df, "j", 0.25 / 16)
        assert list(hot) == [0] and total == 60000
        dealt, copies = salted(df, hot, total, 16)
        sizes = sorted(r["count"] for r in dealt.repartition(16, "j", "s").groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        plain = sorted(r["count"] for r in df.repartition(16, "j").groupBy(F.spark_partition_id()).count().collect())
        assert plain[-1] > 5 * plain[len(plain) // 2]
        # copies of the hot column's one value, and of nothing else
        assert [r["j"] for r in copies.collect()] == [0]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_salt_without_a_hot_column(spark):
    triples = [(k % 10, k, 1.0) for k in range(5000)]
    x = vec(spark, [1.0] * 5000)
    a = mat(spark, triples, 10, 5000)
    assert sorted(map(tuple, a.multiply(x, broadcast=False, salt=True).df.collect())) == [(k, 500.0) for k in range(10)]


@pytest.mark.parametrize("height,width", [(1, 1), (4, 8), (64, 128)])
def test_compressed_blocks_hold_the_cells(spark, height, width):
    triples = skewed(seed=5)
    got = {}
    for b in mat(spark, triples, 60, 90).grid_blocks(height, width).collect():
        assert b["cols"] == sorted(set(b["cols"])) and b["ptr"][0] == 0 and b["ptr"][-1] == b["nnz"] == len(b["val"])
        for k, col in enumerate(b["cols"]):
            rows = b["idx"][b["ptr"][k]:b["ptr"][k + 1]]
            assert rows and rows == sorted(set(rows))
            for r, v in zip(rows, b["val"][b["ptr"][k]:b["ptr"][k + 1]]):
                assert 0 <= r < height and 0 <= col < width
                got[b["bi"] * height + r, b["bj"] * width + col] = v
    assert got == summed(triples)


def test_many_blocks_are_built_and_read_together(spark):
    """No group per block, and blocks that go on over several batches stay whole."""
    triples = skewed(seed=15)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = mat(spark, triples, 60, 90).grid_blocks(16, 32)
        assert "FlatMapGroupsInArrow" not in physical_plan(made, "simple")
        want = {}
        for (i, j), v in summed(triples).items():
            want.setdefault((i // 16, j // 32), {}).setdefault(j % 32, []).append((i % 16, v))
        rows = made.collect()
        assert len(rows) == len(want) and sum(r["nnz"] for r in rows) == len(summed(triples))
        columns = blocks.block_columns(made)
        assert "Generate" not in physical_plan(columns, "simple")
        got = {(r["bi"], r["bj"], r["col"]): r for r in columns.collect()}
        for (bi, bj), cols in want.items():
            first = 0
            for col in sorted(cols):
                r, cells = got.pop((bi, bj, col)), sorted(cols[col])
                assert (r["first"], r["last"], r["nnz"]) == (first, first + len(cells), len(cells))
                assert r["first_row"] == cells[0][0] and abs(r["total"] - sum(v for _, v in cells)) < 1e-9
                first += len(cells)
        assert not got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("bcast", [True, False])
def test_grid_product_moves_blocks_not_cells(spark, bcast):
    triples = skewed(seed=6)
    a = mat(spark, triples, 60, 90)
    x = VectorFrame(spark.createDataFrame([(k, float(k)) for k in range(0, 90, 2)], "i long, x double"), 90, True)
    want = sorted(map(tuple, a.multiply(x).df.collect()))
    assert sorted(map(tuple, a.multiply(x, layout="grid", broadcast=bcast, width=16).df.collect())) == want
    a.prepare("grid", width=16)
    y = a.multiply(x, layout="grid", broadcast=bcast, width=16)
    assert sorted(map(tuple, y.df.collect())) == want
    plan = physical_plan(y.df, "simple")
    assert "FlatMapGroupsInArrow" not in plan.split("InMemoryRelation")[0]
    a.unprepare()


def test_chunks_of_a_hot_column_of_blocks(spark):
    triples = [(i, i % 3, 1.0) for i in range(4000)] + [(i, 50, 2.0) for i in range(0, 4000, 7)]
    a = mat(spark, triples, 4000, 64)
    chunks = blocks.chunk_counts(a.entries, 8, chunk_cells=1000)
    assert sorted(map(tuple, chunks.collect())) == [(0, 4), (6, 1)]
    made = blocks.grid_blocks(a.entries, chunks, 100, 8)
    assert {r["c"] for r in made.where("bj = 0").collect()} == {0, 1, 2, 3}
    x = VectorFrame(spark.range(64).selectExpr("id AS i", "CAST(id AS DOUBLE) AS x"), 64, True)
    y = blocks.multiply_grid(made, chunks, x.df, 100, 8, broadcast=False)
    assert sorted(map(tuple, y.collect())) == sorted(map(tuple, a.multiply(x).df.collect()))


def graph(seed=7):
    rnd = random.Random(seed)
    hub = [(rnd.randrange(500), 3, rnd.randint(1, 5)) for _ in range(900)] + [(5, rnd.randrange(500), 1) for _ in range(600)]
    return hub + [(rnd.randrange(500), rnd.randrange(500), rnd.randint(1, 5)) for _ in range(900)]


@pytest.mark.parametrize("parts", [1, 9, 40])
def test_routed_graph(spark, parts):
    triples = graph()
    a = mat(spark, triples, 500, 500)
    made = a.edge_partitions(parts)
    rows = made.collect()
    edges = {}
    for p in rows:
        assert len(p["attr"]) == p["n_edges"] and p["dst"] == sorted(set(p["dst"])) and p["src"] == sorted(set(p["src"]))
        for s, d, v in zip(p["s"], p["d"], p["attr"]):
            assert (p["src"][s], p["dst"][d]) not in edges
            edges[p["src"][s], p["dst"][d]] = v
    assert edges == summed(triples)
    q = routing.side(parts)
    shipped = [(r["part"], r["id"]) for r in routing.routing_table(made).collect()]
    assert len(shipped) == len(set(shipped)) < len(edges)
    if parts > 1:
        hubs = routing.hubs(a.graph()[1], parts)
        assert {3, 5} <= set(hubs)
        copies = {}
        for _, v in shipped:
            copies[v] = copies.get(v, 0) + 1
        # a vertex without hub edges is needed in one column of the square, and in few more cells with them
        assert max(n for v, n in copies.items() if v not in hubs) <= q + len(hubs)
        sizes = [p["n_edges"] for p in rows]
        assert max(sizes) <= 3 * sum(sizes) / len(sizes)
    x = VectorFrame(spark.createDataFrame([(k, float(k)) for k in range(0, 500, 3)], "i long, x double"), 500, True)
    want = sorted(map(tuple, a.multiply(x).df.collect()))
    assert sorted(map(tuple, routing.multiply_routed(made, x.df).collect())) == want


def test_routed_layout_is_kept(spark):
    triples = graph(8)
    a = mat(spark, triples, 500, 500)
    x = vec(spark, [float(k % 5) for k in range(500)])
    want = sorted(map(tuple, a.multiply(x, trans=True).df.collect()))
    a.prepare("routed", trans=True)
    y = a.multiply(x, trans=True, layout="routed")
    assert sorted(map(tuple, y.df.collect())) == want
    assert "FlatMapGroupsInArrow" not in physical_plan(y.df, "simple").split("InMemoryRelation")[0]
    a.unprepare()
    wide = mat(spark, [(0, 1, 3.0), (0, 4, 1.0), (1, 4, 2.0)], 2, 5)   # rows and columns need not be the same vertices
    assert sorted(map(tuple, wide.multiply(vec(spark, [1, 2, 3, 4, 5]), layout="routed").df.collect())) == [(0, 11.0), (1, 10.0)]


def test_cells_are_not_summed_twice(spark):
    a = mat(spark, skewed(seed=9), 60, 90).canonicalize()
    assert a.cells() is a.entries
    s = mat(spark, [(1, 0, 2.0), (1, 1, 3.0)], 2, 2, "symmetric")
    assert sorted(map(tuple, s.canonicalize().cells().collect())) == [(0, 1, 2.0), (1, 0, 2.0), (1, 1, 3.0)]
    assert st.canonicalize(a.entries).count() == a.entries.count()


def test_blocks_take_only_the_values_of_their_columns(spark):
    """A wide grid of nearly empty blocks does not carry a whole vector block per block."""
    triples = [(k * 50, k * 700 % 40000, float(k % 9 + 1)) for k in range(2000)]
    a = mat(spark, triples, 100000, 40000)
    x = VectorFrame(spark.range(40000).selectExpr("id AS i", "CAST(id % 11 AS DOUBLE) AS x").where("i % 3 < 2"), 40000, True)
    want = sorted(map(tuple, a.multiply(x).df.collect()))
    for bcast in (True, False):
        y = a.multiply(x, layout="grid", broadcast=bcast)
        assert sorted(map(tuple, y.df.collect())) == want
        plan = physical_plan(y.df, "formatted").split("MapInArrow")
        assert all("xb" not in part.split("Input [", 1)[1].split("]", 1)[0] for part in plan[1:] if "Input [" in part)
    one = next(blocks._kernel(8)([pa.record_batch({
        "bi": pa.array([3, 5, 3]), "ptr": pa.array([[0, 1], [0, 2], [0, 1, 2]], pa.list_(pa.int32())), "idx": pa.array([[2], [0, 7], [2, 4]], pa.list_(pa.int32())),
        "val": pa.array([[2.0], [1.0, 3.0], [5.0, 1.0]]), "x": pa.array([[10.0], [4.0], [1.0, 0.0]])})]))
    assert dict(zip(*(c.to_pylist() for c in one.columns))) == {26: 25.0, 28: 0.0, 40: 4.0, 47: 12.0}


def test_a_large_partition_is_kept_in_pieces(spark):
    triples = graph(11)
    a = mat(spark, triples, 500, 500)
    edges = a.graph()[1]
    made = routing.edge_partitions(edges, 4, piece_edges=100)
    rows = made.collect()
    assert max(p["n_edges"] for p in rows) <= 300 and len(rows) > 12
    kept = [(p["src"][s], p["dst"][d]) for p in rows for s, d in zip(p["s"], p["d"])]
    assert sorted(kept) == sorted(summed(triples))
    whole = {p["part"]: p for p in routing.edge_partitions(edges, 4).collect()}
    sizes = {r["part"]: tuple(r)[1:] for r in routing.partition_sizes(made).collect()}
    assert sizes == {k: (p["n_edges"], len(p["dst"]), len(p["src"])) for k, p in whole.items()}
    x = VectorFrame(spark.createDataFrame([(k, float(k)) for k in range(0, 500, 3)], "i long, x double"), 500, True)
    want = sorted(map(tuple, a.multiply(x).df.collect()))
    assert sorted(map(tuple, routing.multiply_routed(made, x.df).collect())) == want
