"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors are one node with a count. Nodes are cut into tiles of bounded size,
near one pivot each; two tiles meet only if their angles to all pivots allow a pair
above the threshold (triangle inequality, so nothing is lost). For a pair of tiles
the int8 codes are multiplied exactly, and per-vector quantisation errors bound the
true cosine from both sides: only pairs whose bounds hold the threshold are
computed again in double precision. A pair of tiles returns link counts per node
and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forest, shuffle_partitions
from .components import components

TILE = 2048
PIVOTS = 32
SLACK = 1e-9  # above the rounding of double sums in the bounds


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error norm per vector: ``|unit - scale * codes| <= error``."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - scale[:, None] * codes) ** 2).sum(axis=1)) + SLACK
    return codes.astype(np.int8), scale, error


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 code rows; float32 sums are exact below 2**24."""
    out = None
    for s in range(0, a.shape[1], 1024):
        part = a[:, s:s + 1024].astype(np.float32) @ b[:, s:s + 1024].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def near_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows with a cosine of at least ``threshold``."""
    qa, sa, ea = quantise(left)
    qb, sb, eb = quantise(right)
    products = code_products(qa, qb)
    # |x - s q| <= e and |x| = 1, so |s q| <= 1 + e, and the true cosine differs from
    # sa sb (qa . qb) by at most ea (1 + eb) + eb (1 + ea) + ea eb
    slack = lambda x, y: x + y + 3 * x * y
    floor = (threshold - slack(ea.max(), eb)) / (sa.max() * sb)
    a, b = np.nonzero(products >= np.where(floor > 0, floor, -np.inf)[None, :].astype(np.float32) - 1)
    about, err = products[a, b].astype(np.float64) * sa[a] * sb[b], slack(ea[a], eb[b])
    sure = about - err >= threshold
    open_ = ~sure & (about + err >= threshold)
    keep = sure.copy()
    at = np.nonzero(open_)[0]
    for s in range(0, len(at), 1 << 15):
        k = at[s:s + (1 << 15)]
        keep[k] = (left[a[k]] * right[b[k]]).sum(axis=1) >= threshold
    return a[keep], b[keep]


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, vec binary, dim int)``; ``vec``: little-endian doubles, null where nothing can link."""

    def run(batches):
        for b in batches:
            col = b.column(1)
            vecs, dims = [], []
            for v in col.to_pylist():
                ok = v is not None and len(v) > 0 and None not in v
                x = np.array(v, "<f8") if ok else None
                with np.errstate(over="ignore"):
                    ok = ok and bool(np.isfinite(x).all()) and 0 < float((x * x).sum()) < math.inf
                vecs.append(x.tobytes() if ok else None)
                dims.append(len(v) if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())],
                                             ["vec_id", "vec", "dim"])

    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    return src.mapInArrow(run, "vec_id long, vec binary, dim int")


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    return unit_rows(np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim))


def _with_cells(nodes: DataFrame, pivots: list[bytes]) -> DataFrame:
    """Adds ``cell``, the nearest pivot of the same dimension, and the angles to all of them."""
    by_dim: dict[int, np.ndarray] = {}
    for p in pivots:
        x = np.frombuffer(p, "<f8")
        by_dim.setdefault(len(x), []).append(x)
    units = {d: unit_rows(np.array(v)) for d, v in by_dim.items()}

    def run(batches):
        for b in batches:
            vecs, dims = b.column(1).to_pylist(), b.column(2).to_pylist()
            cells, angles = [], []
            for v, d in zip(vecs, dims):
                x = np.frombuffer(v, "<f8")
                if d in units:
                    a = np.arccos(np.clip(units[d] @ (x / np.sqrt((x * x).sum())), -1, 1))
                    cells.append(int(a.argmin()))
                    angles.append(a.tolist())
                else:
                    cells.append(0)
                    angles.append([])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cells, pa.int32()), pa.array(angles, pa.list_(pa.float64()))],
                [*b.schema.names, "cell", "angles"])

    return nodes.mapInArrow(run, "node long, vec binary, dim int, mult long, low long, cell int, angles array<double>")


def _tiles(nodes: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with a gapless ``tile`` number, and one row per tile with its angle ranges."""
    sizes = nodes.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    before = Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cuts = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    cells = sizes.select("dim", "cell", cuts.alias("k"), F.coalesce(F.sum(cuts).over(before), F.lit(0)).alias("base"))
    placed = cut(nodes.join(cells, ["dim", "cell"]).withColumn(
        "tile", (F.col("base") + F.pmod(F.xxhash64("vec"), F.col("k"))).cast("int")).drop("k", "base", "cell"), "emb-nodes")
    spread = placed.select("tile", "dim", F.posexplode_outer("angles").alias("p", "a"))
    ranges = spread.groupBy("tile", "dim", "p").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    return placed.drop("angles"), ranges


def _tile_pairs(ranges: DataFrame, tiles: int, threshold: float) -> DataFrame:
    """``(a, b)``, a <= b: tiles of one dimension that may hold a pair above the threshold.

    A pair within the angle of the threshold has angles to any pivot that differ by
    no more than it, so ranges further apart than that exclude the pair of tiles.
    """
    apart = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    per = ranges.groupBy("tile", "dim").agg(F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))).alias("r"))
    left = per.select(F.col("tile").alias("a"), "dim", F.col("r").alias("ra"),
                      F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("b"))
    right = per.select(F.col("tile").alias("b"), F.col("dim").alias("dim_b"), F.col("r").alias("rb"))
    far = F.exists(F.arrays_zip("ra", "rb"), lambda z: (
        (z["ra"]["lo"] - z["rb"]["hi"] > apart) | (z["rb"]["lo"] - z["ra"]["hi"] > apart)))
    met = left.join(right, "b").where(F.col("dim") == F.col("dim_b"))
    return met.where(~F.coalesce(far, F.lit(False))).select("a", "b")


def _compare(threshold: float):
    """One group: both tiles of a pair; gives (node, links, root) rows."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        a, b = key[0].as_py(), key[1].as_py()
        dim = t.column("dim")[0].as_py()
        node, mult = t.column("node").to_numpy(), t.column("mult").to_numpy()
        unit, tile = _unit(t.column("vec"), dim), t.column("tile").to_numpy()
        left = np.nonzero(tile == a)[0]
        right = left if a == b else np.nonzero(tile == b)[0]
        us, vs = [], []
        links = np.zeros(len(node), np.int64)
        for s in range(0, len(left), 1024):
            rows = left[s:s + 1024]
            if len(right) == 0:
                break
            u, v = near_pairs(unit[rows], unit[right], threshold)
            u, v = rows[u], right[v]
            if a == b:
                other = u != v
                u, v = u[other], v[other]
            np.add.at(links, u, mult[v])
            if a != b:
                np.add.at(links, v, mult[u])
            root = forest(u, v, len(node))  # of this strip
            moved = np.nonzero(root != np.arange(len(node)))[0]
            us.append(moved)
            vs.append(root[moved])
        u = np.concatenate(us) if us else np.zeros(0, np.int64)
        v = np.concatenate(vs) if vs else np.zeros(0, np.int64)
        root = forest(u, v, len(node))
        hit = np.nonzero(links)[0]
        return pa.table({"node": node[hit], "links": links[hit], "root": node[root[hit]]})

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
                    tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """``(vec_id, n_links long, component_id long, kept boolean)`` for every row of ``df``.

    ``n_links`` counts the other rows with a cosine of at least ``threshold`` (equal
    vectors included). ``component_id`` is the smallest id reachable, ``kept`` marks
    rows that carry it. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, and vectors of different dimensions do
    not link; such a row is its own component. A row with a null id is counted as a
    link of others; its own component is named by the smallest other id, else null,
    and it is not kept. Repeated rows come back repeated. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = df.sparkSession
    vecs = cut(_vectors(df, id_col, vec_col), "emb-vectors")
    distinct = vecs.where("vec is not null").groupBy("vec", "dim").agg(
        F.count("*").alias("mult"), F.min("vec_id").alias("low"))
    nodes = cut(distinct.select(F.monotonically_increasing_id().alias("node"), "vec", "dim", "mult", "low"), "emb-distinct")
    chosen = [r.vec for r in nodes.orderBy(F.xxhash64("vec")).limit(pivots).select("vec").collect()]
    placed, ranges = _tiles(_with_cells(nodes, chosen), tile)
    tiles = (placed.agg(F.max("tile")).first()[0] or 0) + 1
    pairs = cut(_tile_pairs(ranges, tiles, threshold), "emb-pairs")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    met = sides.join(placed.select("node", "vec", "dim", "mult", "tile"), "tile")
    found = cut(met.repartition(shuffle_partitions(spark), "a", "b").groupBy("a", "b").applyInArrow(
        _compare(threshold), "node long, links long, root long"), "emb-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    rooted = nodes.select("node", "low", "mult", "vec").join(comp.hint("merge"), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    facts = rooted.join(names.hint("merge"), "root").join(counts.hint("merge"), "node", "left").select(
        F.col("vec").alias("__vec"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"))
    facts = cut(facts, "emb-facts")
    out = vecs.join(facts.hint("merge"), F.col("vec") == F.col("__vec"), "left")
    own = F.when(F.col("__vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                      F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
