"""``MatrixFrame``: a distributed sparse matrix as an entries DataFrame ``(i, j, v)``.

The wrapper adds only metadata: the shape (declared, or computed once as
max index + 1) and the storage symmetry (``general``, or ``symmetric`` /
``skew-symmetric`` / ``hermitian`` meaning only one triangle is stored). Every
method returns a new lazy DataFrame-backed object; only shapes and counts
(scalars) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import in_range, keep_or_double, not_null
from .operators import blocks as _blocks
from .operators import partition as _part
from .operators import routing as _routing
from .operators import spmv as _spmv
from .operators import structure as _st
from .plans import may_broadcast
from .session import default_parallelism
from .vector import VectorFrame

LAYOUTS = ("join", "packed", "blocked", "grid", "graph", "routed")
# the reference's layout names: coordinate entries and compressed-column blocks
LAYOUT_ALIASES = {"coo": "join", "csc": "blocked"}


def layout_name(layout: str) -> str:
    """Canonical layout name; ``COO`` / ``CSC`` accepted, anything else unknown fails."""
    name = LAYOUT_ALIASES.get(layout.lower(), layout.lower())
    if name not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; expected one of {LAYOUTS} "
                         f"or {tuple(k.upper() for k in LAYOUT_ALIASES)}")
    return name

DimLike = int | None | Callable[[], int]


def _dim(d: DimLike) -> DimLike:
    if d is None or callable(d):
        return d
    return None if d <= 0 else int(d)


class MatrixFrame:
    def __init__(self, entries: DataFrame, n_rows: DimLike = None, n_cols: DimLike = None,
                 symmetry: str = "general", canonical: bool = False):
        """``n_rows`` / ``n_cols``: a number, ``None`` (max index + 1, computed once
        when first needed), or a callable giving the number when first needed."""
        self.entries = entries
        self._n_rows = _dim(n_rows)
        self._n_cols = _dim(n_cols)
        self.symmetry = _st.check_symmetry(symmetry)
        self.canonical_entries = canonical
        self._prepared: dict[tuple, DataFrame] = {}
        self._prepared_counts: dict[tuple, DataFrame] = {}

    # ------------------------------------------------------------ building
    @classmethod
    def from_df(cls, df: DataFrame, i: str = "i", j: str = "j", v: str | None = "v",
                n_rows: int | None = None, n_cols: int | None = None,
                symmetry: str = "general") -> "MatrixFrame":
        """Any DataFrame with two index columns and a value column (``v=None``: pattern, 1.0).

        Indices are cast to LONG as they are. A null value or index fails the job that reads
        the value, in every layout alike; the guard sits in the value column, so that filters
        on ``i`` / ``j`` still reach a parquet scan (and drop null indices as filters do)."""
        vcol = F.lit(1.0) if v is None else keep_or_double(df, v)
        if v is not None and df.schema[v].nullable:
            kept = df.select(vcol.alias("v")).schema["v"].dataType.simpleString()
            vcol = not_null(vcol, kept, "matrix value")
        for name in (i, j):
            if df.schema[name].nullable:
                vcol = F.when(F.col(name).isNotNull(), vcol).otherwise(F.raise_error(F.lit("null matrix index")))
        entries = df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"),
                            vcol.alias("v"))
        return cls(entries, n_rows, n_cols, symmetry)

    @classmethod
    def from_entries(cls, spark: SparkSession, triples, n_rows: int | None = None,
                     n_cols: int | None = None, symmetry: str = "general") -> "MatrixFrame":
        """Small in-memory entry list (tests, examples)."""
        df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in triples],
                                   "i long, j long, v double")
        return cls(df, n_rows, n_cols, symmetry)

    def _like(self, entries: DataFrame, symmetry: str | None = None, transpose: bool = False,
              canonical: bool = False) -> "MatrixFrame":
        r, c = (self._n_cols, self._n_rows) if transpose else (self._n_rows, self._n_cols)
        return MatrixFrame(entries, r, c, symmetry or self.symmetry, canonical)

    # ------------------------------------------------------------ metadata
    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def _compute_shape(self) -> None:
        row = _st.shape_frame(self.entries).first()
        if row is None or row["n_rows"] is None:
            raise ValueError("empty matrix without a declared shape")
        r, c = int(row["n_rows"]), int(row["n_cols"])
        if self.symmetry != "general":
            r = c = max(r, c)
        self._n_rows = self._n_rows or r
        self._n_cols = self._n_cols or c

    @property
    def n_rows(self) -> int:
        if callable(self._n_rows):
            self._n_rows = _dim(self._n_rows())
        if self._n_rows is None:
            self._compute_shape()
        return self._n_rows

    @property
    def n_cols(self) -> int:
        if callable(self._n_cols):
            self._n_cols = _dim(self._n_cols())
        if self._n_cols is None:
            self._compute_shape()
        return self._n_cols

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_rows, self.n_cols

    def stored_count(self) -> int:
        """Entries as stored (one triangle for symmetric kinds, duplicates counted)."""
        return self.entries.count()

    def nnz(self) -> int:
        """Non-zero cells of the full matrix after duplicate summation."""
        row = _st.nonzero_count(self.full_entries()).first()
        return int(row["nnz"]) if row else 0

    # ------------------------------------------------------------ structure
    def full_entries(self) -> DataFrame:
        """Entries of the whole matrix (the stored triangle mirrored)."""
        return _st.expand(self.entries, self.symmetry)

    def expand(self) -> "MatrixFrame":
        return self._like(self.full_entries(), "general")

    def transpose(self) -> "MatrixFrame":
        if self.symmetry in ("symmetric", "hermitian"):
            return self
        if self.symmetry == "skew-symmetric":   # A' = -A, same stored positions
            return self._like(self.entries.select("i", "j", (-F.col("v")).alias("v")))
        return self._like(_st.transpose(self.entries), transpose=True)

    def canonicalize(self) -> "MatrixFrame":
        if self.canonical_entries:
            return self
        return self._like(_st.canonicalize(self.entries), canonical=True)

    def diagonal(self) -> VectorFrame:
        d = self.full_entries()
        return VectorFrame(_st.diagonal(d), lambda: min(self.n_rows, self.n_cols), unique=True)

    def lower(self, strict: bool = False) -> "MatrixFrame":
        return self._like(_st.lower_triangle(self.full_entries(), strict), "general")

    def upper(self, strict: bool = False) -> "MatrixFrame":
        return self._like(_st.upper_triangle(self.full_entries(), strict), "general")

    def symmetry_kind(self) -> DataFrame:
        """One row ``kind``: symmetric / skew-symmetric / general, from the values."""
        return _st.symmetry_kind(self.full_entries(), self.n_rows == self.n_cols)

    # ------------------------------------------------------------ layouts
    def indexed_rows(self, width: int = _spmv.DEFAULT_WIDTH) -> DataFrame:
        """Packed rows ``(i, s, idx, val, size)``: sorted segments of at most ``width``
        entries (one per row and column block), ``size`` = number of columns."""
        packed = _spmv.pack_rows(_st.canonicalize(self.full_entries()), width)
        return packed.withColumn("size", F.lit(self.n_cols).cast("long"))

    def indexed_entries(self, width: int = _spmv.DEFAULT_WIDTH) -> DataFrame:
        """``(i, pos, j, v)``: every cell with its 0-based place in its row, ordered by
        column (the indexed-row view, one row per cell, no unbounded array)."""
        # rows of at most LONG_ROW columns are numbered whole; else rows with a large share of the
        # entries are looked for, and numbered by blocks of ``width`` columns
        long_rows = None
        if self.n_cols > _part.LONG_ROW:
            long_rows, _ = _part.heavy_keys(self.full_entries(), "i", _part.LEAST_SHARE)
        return _spmv.cell_positions(self.cells(), long_rows, width)

    # ------------------------------------------------------------ partitions
    def cells(self) -> DataFrame:
        """The full matrix's cells, duplicates summed."""
        if self.canonical_entries and self.symmetry == "general":
            return self.entries
        return _st.canonicalize(self.full_entries())

    def nnz_cuts(self, parts: int) -> _part.Cuts:
        """Where the cells, in (row, column) order, split into ``parts`` runs of equal size (at
        most one cell apart); a row larger than a share is cut by column."""
        return _part.nnz_cuts(self.cells(), self.n_rows, self.n_cols, parts)

    def balanced_cells(self, parts: int, cuts: _part.Cuts | None = None) -> DataFrame:
        """``(i, j, v, part)``: partition k holds the k-th run of cells, sorted; see ``nnz_cuts``."""
        return _part.balanced(self.cells(), cuts or self.nnz_cuts(parts))

    def row_matrix(self, width: int = _spmv.DEFAULT_WIDTH) -> DataFrame:
        """Rows without an order: ``(row, s, idx, val, size)``. ``row`` only says which
        segments are of one row; a row wider than ``width`` columns has several."""
        return self.indexed_rows(width).withColumnRenamed("i", "row")

    def shape_frame(self) -> DataFrame:
        """One row ``(n_rows, n_cols, stored)``: the declared shape, or the one that the
        entries need where that is larger, and the stored entries."""
        n_rows, n_cols = F.lit(self.n_rows).cast("long"), F.lit(self.n_cols).cast("long")
        return _st.shape_frame(self.entries).select(
            F.greatest(n_rows, "n_rows").alias("n_rows"), F.greatest(n_cols, "n_cols").alias("n_cols"), "stored")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """``(vertices, edges)`` of a square matrix: vertex per row/column id, edge i -> j."""
        if self.n_rows != self.n_cols:
            raise ValueError(f"graph layout needs a square matrix, got {self.shape}")
        edges = _spmv.graph_edges(self.full_entries())
        return _spmv.graph_vertices(edges), edges

    def to_dense(self) -> DataFrame:
        """Every cell ``(i, j, v)`` of the full matrix, zeros included.

        The grid comes from one distributed ``range(n_rows * n_cols)``, not from
        a cross join; its size is the product of the shape by definition. An entry
        outside the shape fails the job.
        """
        r, c = self.n_rows, self.n_cols
        if r * c >= 1 << 63:
            raise ValueError(f"a dense {r} x {c} matrix has more than 2**63 cells")
        zero = F.lit(0).cast(self.entries.schema["v"].dataType)
        grid = self.spark.range(r * c).select(
            F.expr(f"id div {c}").alias("i"), F.expr(f"id % {c}").alias("j"))
        cells = self.checked_cells()
        return (grid.join(cells, on=["i", "j"], how="left")
                .select("i", "j", F.coalesce(F.col("v"), zero).alias("v")))

    def checked_cells(self) -> DataFrame:
        """Canonical cells of the full matrix; one outside the shape fails the job."""
        i, j, v = F.col("i"), F.col("j"), F.col("v")
        return _st.canonicalize(self.full_entries()).select(
            "i", "j", in_range(i, self.n_rows, in_range(j, self.n_cols, v)).alias("v"))

    def _inside(self) -> "MatrixFrame":
        """The matrix with guarded entries: one outside the declared shape fails the job. A dimension
        that is not declared is taken from the entries, so only its lower end counts. The guard
        is in the indices, which joins on them may drop when null, and in the values, which
        no plan prunes."""
        rows = self.n_rows if self._n_rows is not None else (1 << 63) - 1
        cols = self.n_cols if self._n_cols is not None else (1 << 63) - 1
        i, j = F.col("i"), F.col("j")
        return self._like(self.entries.select(
            in_range(i, rows, i).alias("i"), in_range(j, cols, j).alias("j"),
            in_range(j, cols, in_range(i, rows, F.col("v"))).alias("v")), canonical=self.canonical_entries)

    # ------------------------------------------------------------ products
    def multiply(self, x: VectorFrame, trans: bool = False, layout: str = "join",
                 broadcast: bool | None = None, width: int = _spmv.DEFAULT_WIDTH,
                 check: bool = True, salt: bool = False) -> VectorFrame:
        """``A x`` (or ``A' x`` with ``trans``) as a sparse ``VectorFrame``.

        ``broadcast=None`` broadcasts the operand only below a proven row bound
        (``tessera.broadcast.maxRows``); otherwise a shuffled hash join built on the
        vector side, whose skewed entry partitions AQE splits. ``prepare(layout)``
        first keeps the layout's form cached for repeated products. An entry outside the declared
        shape fails the job in every layout. ``salt`` (join layout):
        hot columns are looked for and dealt over partitions, where AQE is not at hand.
        """
        layout = layout_name(layout)
        n_in = self.n_rows if trans else self.n_cols
        n_out = (lambda: self.n_cols) if trans else (lambda: self.n_rows)
        if check and x.length != n_in:
            raise ValueError(f"vector length {x.length} does not match the matrix "
                             f"({'rows' if trans else 'columns'} = {n_in})")
        if layout == "graph" and self.n_rows != self.n_cols:
            raise ValueError(f"graph layout needs a square matrix, got {self.shape}")
        form = self._layout_form(layout, trans, width)
        spark = self.spark
        if layout == "join":
            bc = may_broadcast(spark, x.row_bound()) if broadcast is None else broadcast
            if salt and not bc:
                parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
                hot, total = _part.heavy_keys(form, "j", max(0.25 / parts, _part.LEAST_SHARE))
                y = _spmv.multiply_join_salted(form, x.canonical().df, hot, total, parts)
            else:
                y = _spmv.multiply_join(form, x.df, broadcast=bc)
        elif layout == "grid":
            bc = may_broadcast(spark, n_in) if broadcast is None else broadcast
            blocks, chunks = self._grid_form(form, trans, width)
            y = _blocks.multiply_grid(blocks, chunks, x.canonical().df, width=width, broadcast=bc)
        elif layout == "routed":
            y = _routing.multiply_routed(form, x.canonical().df)
        elif layout == "graph":
            bc = may_broadcast(spark, x.row_bound()) if broadcast is None else broadcast
            y = _spmv.multiply_graph(form, x.df, broadcast=bc)
        elif layout == "packed":
            blocks = _spmv.vector_blocks(x.to_dense().df, width)
            bc = may_broadcast(spark, n_in) if broadcast is None else broadcast
            y = _spmv.multiply_packed(form, blocks, width, broadcast=bc)
        else:
            ready = self._prepared_counts.get(("blocked", trans, width))
            tagged, counts = (form, ready) if ready is not None else _spmv.tile_entries(
                form, width, few_blocks=may_broadcast(spark, -(-n_in // width)))
            y = _spmv.multiply_blocked(tagged, counts, x.canonical().df, width=width)
        return VectorFrame(y, n_out, unique=True)

    def _layout_form(self, layout: str, trans: bool, width: int) -> DataFrame:
        """The layout's input: full entries (join, grid), edges (graph), packed row
        segments (packed), edge partitions (routed), of ``A`` or ``A'``; for blocked the full
        entries, or, once prepared, the tagged ones (see ``tile_entries``), for grid the blocks."""
        key = self._form_key(layout, trans, width)
        if key in self._prepared:
            return self._prepared[key]
        e = (self.transpose() if trans else self)._inside().full_entries()
        if layout in ("join", "blocked", "grid"):
            return e
        if layout == "graph":
            return _spmv.graph_edges(e)
        if layout == "routed":
            edges = _spmv.graph_edges(e)
            parts = max(default_parallelism(self.spark), -(-self.stored_count() // _routing.EDGES))
            return _routing.edge_partitions(edges, parts)
        return _spmv.pack_rows(_st.canonicalize(e), width)

    @staticmethod
    def _form_key(layout: str, trans: bool, width: int) -> tuple:
        return layout, trans, width if layout in ("packed", "blocked", "grid") else 0

    def _grid_form(self, entries: DataFrame, trans: bool, width: int) -> tuple[DataFrame, DataFrame]:
        """Blocks and the chunks per column of blocks; ``entries`` are the blocks once prepared."""
        ready = self._prepared_counts.get(("grid", trans, width))
        if ready is not None:
            return entries, ready
        chunks = _blocks.chunk_counts(entries, width)
        few = may_broadcast(self.spark, -(-(self.n_rows if trans else self.n_cols) // width))
        return _blocks.grid_blocks(entries, chunks, width=width, few_columns=few), chunks

    def grid_blocks(self, height: int = _blocks.HEIGHT, width: int = _blocks.WIDTH) -> DataFrame:
        """One row per non-empty block of the grid: compressed columns; see ``operators.blocks``."""
        entries = self.full_entries()
        return _blocks.grid_blocks(entries, _blocks.chunk_counts(entries, width), height, width)

    def edge_partitions(self, parts: int) -> DataFrame:
        """The square matrix's edges on a vertex cut, one row per piece of a partition; see ``operators.routing``."""
        return _routing.edge_partitions(self.graph()[1], parts)

    def prepare(self, layout: str = "join", trans: bool = False,
                width: int = _spmv.DEFAULT_WIDTH,
                entries_per_partition: int = 4_000_000, balance: str = "range") -> "MatrixFrame":
        """Build and cache the layout's form once for repeated products (the
        reference keeps its row and column forms persisted the same way).

        The join and graph forms are range-partitioned on (row, column) first: each
        task then covers a narrow row range, so the partial sums it sends through the
        product's shuffle number about one per row instead of one per entry, and a
        hot row is still split across tasks by column. ``balance="nnz"`` (join, graph) sums
        duplicates and cuts at exact counts instead of sampled bounds: partitions hold equal
        numbers of cells, at most one apart. Grid blocks and edge partitions are kept where
        they are multiplied, so later products move no cell."""
        layout = layout_name(layout)
        if balance not in ("range", "nnz"):
            raise ValueError(f"unknown balance {balance!r}; expected 'range' or 'nnz'")
        key = self._form_key(layout, trans, width)
        self._release(key)
        form, made = self._layout_form(layout, trans, width), None
        if layout in ("join", "graph") and balance == "nnz":
            n = max(1, -(-self.stored_count() // int(entries_per_partition)), default_parallelism(self.spark))
            form = self._balanced_form(layout, trans, n)
        elif layout in ("join", "graph"):
            rows, cols = ("i", "j") if layout == "join" else ("src", "dst")
            n = max(1, -(-self.stored_count() // int(entries_per_partition)),
                    default_parallelism(self.spark))
            form = form.repartitionByRange(n, rows, cols)
        elif layout == "blocked":
            # tiles are kept where they are multiplied: later products move no entry
            tile = int(min(_spmv.DEFAULT_TILE_ENTRIES,
                           max(1 << 16, self.stored_count() // (2 * default_parallelism(self.spark)))))
            n_in = self.n_rows if trans else self.n_cols
            form, counts = _spmv.tile_entries(form, width, tile, few_blocks=may_broadcast(self.spark, -(-n_in // width)))
            counts = counts.cache()
            form = form.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "s", "c")
            self._prepared_counts[key] = counts
        elif layout == "grid":
            form, chunks = self._grid_form(form, trans, width)
            self._prepared_counts[key] = chunks.cache()
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            if may_broadcast(self.spark, self.n_rows if trans else self.n_cols):
                # in row order: neighbours add up before anything is sent; sampled from kept blocks
                made = form.cache()
                form = made.repartitionByRange(n, "bi", "bj").sortWithinPartitions("bi", "bj")
            else:   # where the shuffled vector blocks will come to
                form = form.repartition(n, "bj", "c")
        elif layout == "routed":
            form = form.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "part", "piece")
        form = form.cache()
        form.count()
        if made is not None:
            made.unpersist()
        self._prepared[key] = form
        return self

    def _balanced_form(self, layout: str, trans: bool, parts: int) -> DataFrame:
        """Cells in partitions of equal counts; they are kept only while the cuts are found."""
        m = (self.transpose() if trans else self)._inside().canonicalize()
        cells = m.cells().cache()
        try:
            cuts = _part.nnz_cuts(cells, m.n_rows, m.n_cols, parts)
        finally:
            cells.unpersist()
        form = _part.balanced(m.cells(), cuts).drop("part")
        return form if layout == "join" else _spmv.graph_edges(form)

    def _release(self, key: tuple) -> None:
        for held in (self._prepared.pop(key, None), self._prepared_counts.pop(key, None)):
            if held is not None:
                held.unpersist()

    def is_prepared(self, layout: str = "join", trans: bool = False,
                    width: int = _spmv.DEFAULT_WIDTH) -> bool:
        layout = layout_name(layout)
        return self._form_key(layout, trans, width) in self._prepared

    def unprepare(self, layout: str | None = None, trans: bool = False,
                  width: int = _spmv.DEFAULT_WIDTH) -> "MatrixFrame":
        """Releases one prepared form, or all of them (``layout=None``)."""
        if layout is None:
            keys = list(self._prepared)
        else:
            name = layout_name(layout)
            keys = [self._form_key(name, trans, width)]
        for key in keys:
            self._release(key)
        return self

    def __matmul__(self, x: VectorFrame) -> VectorFrame:
        return self.multiply(x)

    def cache(self) -> "MatrixFrame":
        self.entries = self.entries.cache()
        return self

    def __repr__(self) -> str:
        return (f"MatrixFrame(n_rows={self._n_rows}, n_cols={self._n_cols}, "
                f"symmetry={self.symmetry!r})")
