"""The driver's parquet tables read as matrices and vectors.

Keys in the tables start at 0, so they are used as indices as they stand. Each
shape is declared from the dimension table (``max(key) + 1``), the way a Matrix
Market size line declares it, so empty rows and columns are kept (Q17).

=====  ==========================================================  ==========
name   entries / values                                            shape
=====  ==========================================================  ==========
LI     lineitem: i = l_orderkey, j = l_partkey, v = l_quantity      orders x parts, duplicates
PX     part: i = p_partkey, x = p_retailprice                      parts
OX     orders: i = o_orderkey, x = o_totalprice                    orders
NT     lineitem-orders-customer-supplier: i = customer nation,     nations x nations,
       j = supplier nation, v = l_quantity (integer sums stay      parallel edges
       exact in double at any scale)
SYM    NT folded onto its lower triangle (i >= j), stored as       nations, symmetric
       ``symmetric``: the full matrix is NT + NT' - diag(NT)
EM     embeddings: i = vec_id, j = position, v = element           vectors x dims, dense
PS     lineitem as a graph: part p -> supplier n_parts + s,          parts + suppliers,
       v = l_quantity                                               square, parallel edges
EV     events: distinct (user_id, event type code), pattern        users x types
=====  ==========================================================  ==========
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import MatrixFrame
from ..vector import VectorFrame

EXACT = "decimal(15,2)"   # the tables' prices and quantities have two decimals


class DriverTables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _max_plus_one(self, name: str, key: str) -> int:
        row = self.table(name).agg(F.max(key).alias("m")).first()
        return 0 if row["m"] is None else int(row["m"]) + 1

    @cached_property
    def n_orders(self) -> int:
        return self._max_plus_one("orders", "o_orderkey")

    @cached_property
    def n_parts(self) -> int:
        return self._max_plus_one("part", "p_partkey")

    @cached_property
    def n_nations(self) -> int:
        return self._max_plus_one("nation", "n_nationkey")

    # ----------------------------------------------------------- matrices
    def li(self, exact: bool = False) -> MatrixFrame:
        li = self.table("lineitem")
        v = F.col("l_quantity").cast(EXACT) if exact else F.col("l_quantity")
        df = li.select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), v.alias("v"))
        return MatrixFrame.from_df(df, n_rows=lambda: self.n_orders, n_cols=lambda: self.n_parts)

    def _trade(self, *values: str) -> DataFrame:
        """Lineitem rows with the customer's nation ``a`` and the supplier's nation ``b``.

        Join order for scale: orders x customer first (orders-sized), lineitem x
        supplier, then one join on the order key, so the lineitem-sized data is
        shuffled at most twice (three times in the order lineitem-orders-customer-
        supplier), and a dimension small enough is broadcast by Spark."""
        li = self.table("lineitem").select("l_orderkey", "l_suppkey", *values)
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        cust = self.table("customer").select("c_custkey", "c_nationkey")
        supp = self.table("supplier").select("s_suppkey", "s_nationkey")
        oc = (orders.join(cust, orders.o_custkey == cust.c_custkey)
              .select("o_orderkey", F.col("c_nationkey").cast("long").alias("a")))
        ls = (li.join(supp, li.l_suppkey == supp.s_suppkey)
              .select("l_orderkey", F.col("s_nationkey").cast("long").alias("b"), *values))
        return ls.join(oc, ls.l_orderkey == oc.o_orderkey).select("a", "b", *values)

    def li_hot(self, axis: str) -> MatrixFrame:
        """LI with skew from the data itself: every order's line 1 moved to row 0
        (``axis="row"``) or to column 0 (``axis="column"``), about a quarter of all
        entries on one key; no row is dropped. Exact DECIMAL values."""
        li = self.table("lineitem")
        first = F.col("l_linenumber") == 1
        i = F.when(first, F.lit(0)).otherwise(F.col("l_orderkey")) if axis == "row" else F.col("l_orderkey")
        j = F.when(first, F.lit(0)).otherwise(F.col("l_partkey")) if axis == "column" else F.col("l_partkey")
        df = li.select(i.cast("long").alias("i"), j.cast("long").alias("j"),
                       F.col("l_quantity").cast(EXACT).alias("v"))
        return MatrixFrame(df, lambda: self.n_orders, lambda: self.n_parts)

    def nation_trade_entries(self) -> DataFrame:
        t = self._trade("l_quantity")
        return t.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("l_quantity").alias("v"))

    def nt(self) -> MatrixFrame:
        return MatrixFrame(self.nation_trade_entries(), lambda: self.n_nations, lambda: self.n_nations)

    def sym(self, diagonal: bool = True) -> MatrixFrame:
        e = self.nation_trade_entries().select(
            F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "v")
        if not diagonal:
            e = e.where(F.col("i") != F.col("j"))
        return MatrixFrame(e, lambda: self.n_nations, lambda: self.n_nations, "symmetric")

    def skew(self) -> MatrixFrame:
        """The strictly lower part of SYM stored as skew-symmetric (``A - A'``)."""
        e = self.sym(diagonal=False).entries
        return MatrixFrame(e, lambda: self.n_nations, lambda: self.n_nations, "skew-symmetric")

    @cached_property
    def n_suppliers(self) -> int:
        return self._max_plus_one("supplier", "s_suppkey")

    def ps(self) -> MatrixFrame:
        li = self.table("lineitem").select(
            F.col("l_partkey").cast("long").alias("i"), (F.col("l_suppkey") + F.lit(self.n_parts)).cast("long").alias("j"),
            F.col("l_quantity").alias("v"))
        n = self.n_parts + self.n_suppliers
        return MatrixFrame(li, n, n)

    def part_supplier_values(self) -> VectorFrame:
        """A value per vertex of PS: the part's size, the supplier's nation + 1."""
        part = self.table("part").select(F.col("p_partkey").cast("long").alias("i"), F.col("p_size").cast("double").alias("x"))
        supp = self.table("supplier").select((F.col("s_suppkey") + F.lit(self.n_parts)).cast("long").alias("i"),
                                             (F.col("s_nationkey") + 1).cast("double").alias("x"))
        return VectorFrame(part.unionByName(supp), self.n_parts + self.n_suppliers, True)

    def em(self) -> MatrixFrame:
        emb = self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "val"))
        df = emb.select(F.col("vec_id").alias("i"), F.col("pos").cast("long").alias("j"),
                        F.col("val").cast("double").alias("v"))
        return MatrixFrame(df)

    def event_codes(self) -> DataFrame:
        """``(event_type, code)``: the distinct types of the table in alphabetical order,
        numbered from 0 (one row per type, whatever the number of events)."""
        types = self.table("events").select("event_type").where("event_type is not null").distinct()
        code = F.row_number().over(Window.orderBy("event_type")).cast("long") - 1
        return types.select("event_type", code.alias("code"))

    @cached_property
    def n_event_types(self) -> int:
        return self.table("events").agg(F.countDistinct("event_type")).first()[0]

    def ev(self) -> MatrixFrame:
        ev = self.table("events").select("user_id", "event_type").join(self.event_codes(), "event_type")
        pat = ev.select(F.col("user_id").alias("i"), F.col("code").alias("j")).distinct()
        return MatrixFrame.from_df(pat, v=None, n_cols=self.n_event_types)

    def li_complex(self) -> DataFrame:
        """Complex entries ``(i, j, v, im)``: lineitem quantity + i * (discount in percent)."""
        li = self.table("lineitem")
        return li.select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"),
                         F.col("l_quantity").alias("v"),
                         F.round(F.col("l_discount") * 100).alias("im"))

    def hermitian_trade(self) -> DataFrame:
        """Nation trade folded onto the lower triangle with an imaginary part
        (discount in percent, 0 on the diagonal): stored ``hermitian`` entries."""
        e = self._trade("l_quantity", "l_discount").select(
            "a", "b", F.col("l_quantity").alias("v"), F.round(F.col("l_discount") * 100).alias("d"))
        return e.select(F.greatest("a", "b").alias("i"), F.least("a", "b").alias("j"), "v",
                        F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(F.col("d")).alias("im"))

    # ----------------------------------------------------------- vectors
    def px(self, exact: bool = False) -> VectorFrame:
        p = self.table("part")
        x = F.col("p_retailprice").cast(EXACT) if exact else F.col("p_retailprice")
        return VectorFrame(p.select(F.col("p_partkey").alias("i"), x.alias("x")), lambda: self.n_parts, True)

    def px_complex(self) -> DataFrame:
        """Complex vector ``(i, x, xi)``: retail price + i * size."""
        p = self.table("part")
        return p.select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"),
                        F.col("p_size").cast("double").alias("xi"))

    def part_size(self) -> VectorFrame:
        p = self.table("part")
        return VectorFrame(p.select(F.col("p_partkey").alias("i"),
                                    F.col("p_size").cast("double").alias("x")), lambda: self.n_parts, True)

    def ox(self, exact: bool = False) -> VectorFrame:
        o = self.table("orders")
        x = F.col("o_totalprice").cast(EXACT) if exact else F.col("o_totalprice")
        return VectorFrame(o.select(F.col("o_orderkey").alias("i"), x.alias("x")), lambda: self.n_orders, True)

    def customers_per_nation(self) -> VectorFrame:
        c = self.table("customer")
        df = c.groupBy(F.col("c_nationkey").cast("long").alias("i")).agg(
            F.count(F.lit(1)).cast("double").alias("x"))
        return VectorFrame(df, lambda: self.n_nations, True)

    def events_per_type(self) -> VectorFrame:
        ev = self.table("events").join(self.event_codes(), "event_type")
        df = ev.groupBy(F.col("code").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("x"))
        return VectorFrame(df, self.n_event_types, True)

    def first_embedding(self) -> VectorFrame:
        """The embedding of the smallest vec_id, as a vector over positions."""
        emb = self.table("embeddings")
        first = emb.agg(F.min("vec_id").alias("m"))
        row = emb.join(first, emb.vec_id == first.m).select(F.posexplode("embedding").alias("i", "x"))
        return VectorFrame(row.select(F.col("i").cast("long").alias("i"),
                                      F.col("x").cast("double").alias("x")), None, True)
