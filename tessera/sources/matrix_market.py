"""Distributed Matrix Market reader (coordinate and array files) and vector reader.

A split text file has no line numbers, and the format is positional (banner,
size line, then entries; column-major order in ``array`` files). Positions are
rebuilt inside one Spark plan, without a shuffle of the lines:

1. every line gets ``f`` (file), ``b`` (split start, from ``_metadata``), and, after
   blank and ``%`` lines are dropped, ``m``: a per-partition counter
   (``monotonically_increasing_id``) that is consecutive over the kept lines of one split;
2. a small table with one row per split (``min(m)``, count) gets the number of kept
   lines before each split by a running sum ordered by split start (one
   window per file over its splits only, not over its lines);
3. the kept line's position in its matrix is ``offset(split) + m - min(m)``.
   Position 0 is the size line, 1.. are entries (or array values).

A single coordinate matrix needs no positions and is scanned once (``_scanned_once``).
Both scans of a file sit in the same plan, so a recomputed task sees the same
splits and counters; the split table also gives the number of kept lines per matrix.
One rule tells data lines from blank and comment lines everywhere (``SKIPPED_LINE``).
Only header facts reach the driver: one row per matrix, or for a single coordinate
matrix the first line and the first data line of its first file.

A *matrix key* is the file path, or the folder for a multi-part folder as the
writer of this package produces (parts in name order).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import to_double, to_long, tokens
from ..matrix import MatrixFrame
from ..operators.structure import SYMMETRIES
from ..plans import may_broadcast
from ..vector import VectorFrame

# Matrix Market banner words.
BANNER = "%%matrixmarket"
OBJECTS = ("matrix",)
REPRESENTATIONS = ("coordinate", "array")
FIELDS = ("real", "integer", "pattern", "complex")

SKIPPED_LINE = r"^\s*(%.*)?$"   # blank lines and comments: every other line is data


@dataclass(frozen=True)
class MatrixInfo:
    key: str
    matrix_id: str
    representation: str
    field: str
    symmetry: str
    n_rows: int
    n_cols: int
    nnz: int          # entries declared on the size line (array: rows * cols or triangle)
    data_lines: int | None   # kept lines after the size line (None: not counted)
    diagonal: bool = True    # array files of one triangle: the diagonal is listed
    size_line: str | None = None    # text of the size line, where it lies in the first split of
    first_file: str | None = None   # this file, the first of the matrix (None: not looked at)


def _list_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The input files of ``path`` (Spark's own listing); called once per read.
    Spark gives them as encoded URIs, which are decoded to be read again."""
    return [unquote(f) for f in spark.read.text(path).inputFiles()]


def resolve_by_folder(spark: SparkSession, path: str, by_folder: bool | None,
                      files: list[str] | None = None) -> bool:
    """``None``: a folder of Spark ``part-*`` files is one matrix (or vector) per
    folder, as the writers of this package produce; plain files are one each."""
    if by_folder is not None:
        return by_folder
    files = _list_files(spark, path) if files is None else files
    return bool(files) and all(f.rsplit("/", 1)[-1].startswith("part-") for f in files)


def _key_of(f: Column, by_folder: bool | None) -> Column:
    """The key of a file's matrix or vector; ``None``: the folder of a ``part-*`` file, else the file.
    Never null, so no test for null is derived from a join and done line by line."""
    folder = F.regexp_extract(f, r"^(.*)/[^/]*$", 1)
    if by_folder is None:
        key = F.when(f.rlike(r"/part-[^/]*$"), folder).otherwise(f)
    else:
        key = folder if by_folder else f
    return F.coalesce(key, F.lit(""))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines with their file ``f`` and split start ``b``; a file's key is made per split, not per line."""
    return spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("f"),
                                        F.col("_metadata.file_block_start").alias("b"))


def names(spark: SparkSession, path: str | list[str], by_folder: bool | None = None) -> DataFrame:
    """``(key, matrix_id)`` of every matrix or vector under ``path``, one row each: a table made
    from the file listing. No file is opened and no name comes to the caller."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("f"))
    return files.select(_key_of(F.col("f"), by_folder).alias("key")).distinct().withColumn("matrix_id", _matrix_id(F.col("key")))


def _split_bound(lines: DataFrame) -> int:
    """A proven bound on the file splits of a scan, from its plan: every file of a partition
    fills it by ``openCostInBytes`` at least."""
    conf = lines.sparkSession.conf
    size, least = (_bytes(conf.get(f"spark.sql.files.{k}")) for k in ("maxPartitionBytes", "openCostInBytes"))
    return lines.rdd.getNumPartitions() * (size // max(1, least) + 1)


def split_bound(spark: SparkSession, path: str | list[str]) -> int:
    """A proven bound on the file splits, and so on the files, under ``path``."""
    return _split_bound(spark.read.text(path))


def _bytes(text: str) -> int:
    """A size setting in bytes (``134217728``, ``134217728b``, ``128m``)."""
    m = re.fullmatch(r"(\d+)([bkmgtp]?)b?", text.strip().lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(m.group(1)) << 10 * "bkmgtp".index(m.group(2) or "b")


def _part_no(f: Column) -> Column:
    """Numeric part number of a ``part-NNNNN...`` file (0 otherwise): part files are
    ordered by it, as names stop sorting numerically past 99 999 parts."""
    digits = F.regexp_extract(f, r"/part-(\d+)[^/]*$", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def _file_order(path: str) -> tuple[int, str]:
    m = re.search(r"/part-(\d+)[^/]*$", path)
    return (int(m.group(1)) if m else 0, path)


def _is_data(value: Column) -> Column:
    return ~value.rlike(SKIPPED_LINE)


def _is_banner(value: Column) -> Column:
    return value.rlike(r"(?i)^\s*" + re.escape(BANNER))


def hint_small(spark: SparkSession, df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where ``rows``, a proven bound, allows it; Spark chooses beyond."""
    return F.broadcast(df) if may_broadcast(spark, rows) else df


def positioned(lines: DataFrame, by_folder: bool | None, n_splits: int | None = None,
               facts: DataFrame | None = None) -> DataFrame:
    """Kept (non-blank, non-comment) lines with ``key``, ``p``: 0-based position in their matrix,
    and ``n_lines``: the number of kept lines of the matrix. ``n_splits``: a bound on the file splits.
    ``facts``: one row per key; its columns come along, and keys without a row are left out. They
    meet the splits, so a line is joined once."""
    spark = lines.sparkSession
    kept = (lines.where(_is_data(F.col("value")))
            .withColumn("m", F.monotonically_increasing_id()).withColumn("fid", F.xxhash64("f")))
    splits = kept.groupBy("f", "fid", "b").agg(F.min("m").alias("m0"), F.count(F.lit(1)).alias("n")).withColumn(
        "key", _key_of(F.col("f"), by_folder))
    of_key = Window.partitionBy("key")
    before = (of_key.orderBy(_part_no(F.col("f")), "f", "b")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("key", "fid", "b", "m0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"),
                            F.sum("n").over(of_key).alias("n_lines"))
    # one row of few columns per file split: a partition holds whole splits, a small file is one
    if n_splits is None:
        n_splits = lines.rdd.getNumPartitions() + len(lines.inputFiles())
    more = []
    if facts is not None:
        more = [c for c in facts.columns if c != "key"]
        offsets = offsets.join(hint_small(spark, facts, n_splits), "key")
    return (kept.select("fid", "b", "m", "value").join(hint_small(spark, offsets, n_splits), on=["fid", "b"])
            .select("key", "value", (F.col("off") + F.col("m") - F.col("m0")).alias("p"), "n_lines", *more))


def _matrix_id(key: Column) -> Column:
    """The decoded last part of a key (keys are encoded URIs); never null, as the key."""
    return F.coalesce(F.url_decode(F.replace(F.regexp_extract(key, r"([^/]+)$", 1), F.lit("+"), F.lit("%2B"))), F.lit(""))


def _parse_header(key: str, banner: str, size_line: str | None,
                  data_lines: int | None) -> MatrixInfo:
    words = banner.lower().split()
    if len(words) < 5:
        raise ValueError(f"{key}: banner needs 5 words, got {words}")
    obj, rep, field, sym = words[1:5]
    if obj not in OBJECTS or rep not in REPRESENTATIONS or field not in FIELDS or sym not in SYMMETRIES:
        raise ValueError(f"{key}: unknown banner words {words[1:5]}")
    if rep == "array" and field == "pattern":
        raise ValueError(f"{key}: an array file cannot have pattern entries")
    if size_line is None:
        raise ValueError(f"{key}: no size line")
    size = size_line.split()
    if rep == "coordinate" and len(size) < 3 or rep == "array" and len(size) < 2:
        raise ValueError(f"{key}: bad size line {size}")
    n_rows, n_cols = int(size[0]), int(size[1])
    diagonal = True
    if rep == "coordinate":
        nnz = int(size[2])
    elif sym == "general":
        nnz = n_rows * n_cols
    elif sym == "skew-symmetric":
        # some writers list the zero diagonal as well; the counted lines tell which
        diagonal = data_lines == n_rows * (n_rows + 1) // 2 and n_rows > 0
        nnz = n_rows * (n_rows + 1) // 2 if diagonal else n_rows * (n_rows - 1) // 2
    else:
        nnz = n_rows * (n_rows + 1) // 2
    return MatrixInfo(key, unquote(key.rstrip("/").rsplit("/", 1)[-1]), rep, field, sym,
                      n_rows, n_cols, nnz, data_lines, diagonal)


def _head_info(spark: SparkSession, path: str, by_folder: bool,
               files: list[str]) -> list[MatrixInfo] | None:
    """Header of a single coordinate matrix from the start of its first file.

    Two jobs with a limit of one row, which run from the file's first split on: the
    first line, and the first line that is data by the one rule for it. A row from
    the split at byte 0 is the first of the file, so this equals the full route.
    ``None`` (use the full route) for several matrices, for array files, whose lines
    are counted, and where either line is not in the first split."""
    files = sorted(files, key=_file_order)
    if not files:
        return None
    keys = {f.rsplit("/", 1)[0] for f in files} if by_folder else set(files)
    if len(keys) != 1:
        return None
    lines = spark.read.text(files[0]).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    first, size = lines.limit(1).collect(), lines.where(_is_data(F.col("value"))).limit(1).collect()
    if not first or not size or first[0]["b"] != 0 or size[0]["b"] != 0:
        return None
    f = first[0]["f"]
    key = re.match(r"^(.*)/[^/]*$", f).group(1) if by_folder else f
    banner = first[0]["value"]
    if not banner.lstrip().lower().startswith(BANNER):
        raise ValueError(f"{key}: first line is not a %%MatrixMarket banner")
    info = _parse_header(key, banner, size[0]["value"], None)
    if info.representation != "coordinate":
        return None
    return [replace(info, size_line=size[0]["value"], first_file=files[0])]


def _heads(lines: DataFrame, by_folder: bool | None, n_splits: int) -> DataFrame:
    """Per key the first line, the first banner line and the first kept line with their places,
    and the kept lines.

    Lines are aggregated per split on long counters alone, by hashing; a text in the aggregate would
    sort them all. The counters of a key's first places then fetch the two texts from the same scan."""
    spark = lines.sparkSession
    v, m = F.col("value"), F.col("m")
    lines = lines.withColumn("m", F.monotonically_increasing_id())
    per_split = lines.groupBy("f", "b").agg(
        F.min(m).alias("m_first"), F.min(F.when(_is_banner(v), m)).alias("m_banner"),
        F.min(F.when(_is_data(v), m)).alias("m_size"), F.count(F.when(_is_data(v), 1)).alias("kept"))
    place = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("pn", "f", "b", F.col(c).alias("m_first"))))
    per_key = per_split.withColumn("key", _key_of(F.col("f"), by_folder)).withColumn("pn", _part_no(F.col("f"))).groupBy("key").agg(
        place("m_first").alias("first"), place("m_banner").alias("banner"), place("m_size").alias("size"),
        F.sum("kept").alias("kept_lines"))
    # at most two places a key, and a key has a split of its own
    wanted = per_key.select("key", F.explode(F.array("banner", "size")).alias("at")).where("at is not null").select(
        "key", F.col("at.m_first").alias("m")).distinct()
    texts = lines.select("m", "value").join(hint_small(spark, wanted, 2 * n_splits), "m").groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("m", "value"))).alias("text"))
    text = lambda c: F.try_element_at("text", F.col(f"{c}.m_first"))
    return per_key.join(texts, "key", "left").select(
        "key", "first", F.when(F.col("banner").isNotNull(), F.struct("banner.*", text("banner").alias("banner"))).alias("banner"),
        F.when(F.col("size").isNotNull(), F.struct(text("size").alias("size"))).alias("size"), "kept_lines")


def _parsed_heads(heads: DataFrame) -> DataFrame:
    """The columns of ``info_frame`` from ``_heads``, by the rules of ``_parse_header``: a wrong
    banner or size line fails the job that reads the row."""
    word = lambda k: F.get(F.col("words"), k)
    size = lambda k: to_long(F.get(F.col("sizes"), k))
    more = [c for c in heads.columns if c == "wanted"]
    h = heads.select("key", "kept_lines", "first", "banner", *more, F.col("size.size").alias("size")).withColumn(
        "words", tokens(F.lower("banner.banner"))).withColumn("sizes", tokens(F.col("size")))
    at = F.struct("banner.pn", "banner.f", "banner.b", "banner.m_first")
    rep, field, sym = word(2), word(3), word(4)
    n_rows, n_cols = size(0), size(1)
    coord = rep == "coordinate"
    faults = [(F.col("banner").isNull() | (F.col("first") != at), "first line is not a %%MatrixMarket banner"),
              (F.size("words") < 5, "banner needs 5 words"),
              (~(word(1).isin(*OBJECTS) & rep.isin(*REPRESENTATIONS) & field.isin(*FIELDS) & sym.isin(*SYMMETRIES)),
               "unknown banner words"),
              ((rep == "array") & (field == "pattern"), "an array file cannot have pattern entries"),
              (F.col("size").isNull(), "no size line"),
              (n_rows.isNull() | n_cols.isNull() | (coord & size(2).isNull()), "bad size line")]
    fine = F.lit(True)
    for bad, text in reversed(faults):
        fail = F.raise_error(F.concat(F.col("key"), F.lit(f": {text}"))).cast("boolean")
        fine = F.when(bad, fail).otherwise(fine)
    if more:   # a test of both sides is not moved below their join, where other files are met
        fine = F.when(F.col("wanted") < 1, F.lit(False)).otherwise(fine)
    lines = F.col("kept_lines") - 1
    h = h.where(fine).select(
        "key", _matrix_id(F.col("key")).alias("matrix_id"), rep.alias("representation"), field.alias("field"),
        sym.alias("symmetry"), n_rows.alias("n_rows"), n_cols.alias("n_cols"), size(2).alias("declared"),
        lines.cast("long").alias("data_lines"))
    half = F.expr("n_rows * (n_rows - 1) div 2")   # cells of one triangle without its diagonal
    with_diagonal = half + F.col("n_rows")
    diagonal = ((F.col("representation") != "array") | (F.col("symmetry") != "skew-symmetric")
                | ((F.col("data_lines") == with_diagonal) & (F.col("n_rows") > 0)))
    nnz = (F.when(F.col("representation") == "coordinate", F.col("declared"))
           .when(F.col("symmetry") == "general", F.col("n_rows") * F.col("n_cols"))
           .when(F.col("diagonal"), with_diagonal).otherwise(half))
    return h.withColumn("diagonal", diagonal).select(
        "key", "matrix_id", "representation", "field", "symmetry", "n_rows", "n_cols", nnz.alias("nnz"),
        "data_lines", "diagonal")


def header_frame(spark: SparkSession, path: str | list[str], by_folder: bool | None = None,
                 keys: DataFrame | None = None) -> DataFrame:
    """Header facts of all matrices under ``path`` as a lazy table, one row per matrix:
    ``key, matrix_id, representation, field, symmetry, n_rows, n_cols, nnz, data_lines, diagonal``.

    Nothing is run or collected here: headers are parsed by column expressions, and a wrong
    one fails the job that uses it. ``keys``: only these matrices (others may be anything).
    ``by_folder=None``: a ``part-*`` file belongs to its folder's matrix, any other is one itself."""
    lines = _lines(spark, path)
    bound = _split_bound(lines)
    heads = _heads(lines, by_folder, bound)
    if keys is not None:
        # an inner join stays above the counters; a semi join would be moved below, to the lines
        wanted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("wanted"))
        heads = heads.join(hint_small(spark, wanted, bound), "key")
    return _parsed_heads(heads)


def read_all(spark: SparkSession, path: str | list[str], by_folder: bool | None = None,
             keys: DataFrame | None = None, strict_count: bool = False,
             facts: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``(entries, headers)`` of all matrices under ``path``, both lazy: the columns of
    ``read_entries`` with ``im`` (null but for complex fields) and the header's ``facts``, and ``header_frame``.

    The headers are joined to the lines inside the plan, so the driver holds no name and no
    row per file, however many there are; the text is scanned for headers, positions and entries."""
    heads = header_frame(spark, path, by_folder, keys)
    lines = _lines(spark, path)
    t = _entry_lines(positioned(lines, by_folder, _split_bound(lines), heads), strict_count)
    return _entries(t, F.col("representation") == "coordinate", F.col("field"), arrays=True, complexes=True, facts=facts), heads


def read_info(spark: SparkSession, path: str, by_folder: bool | None = None,
              full: bool = False, files: list[str] | None = None) -> list[MatrixInfo]:
    """Header facts of every matrix under ``path`` (a file, folder or glob), one
    row per matrix to the driver. Banner words are matched case-insensitively.

    A single coordinate matrix is read from its first lines (see ``_head_info``).
    Otherwise, or with ``full=True`` (which also counts the data lines), one job
    aggregates all lines: per split on long counters only (first line, first banner
    line, first kept line, kept count), then per matrix over the split rows.
    """
    if files is None and (not full or by_folder is None):
        files = _list_files(spark, path)
    by_folder = resolve_by_folder(spark, path, by_folder, files)
    if not full:
        head = _head_info(spark, path, by_folder, files)
        if head is not None:
            return head
    lines = _lines(spark, path)
    rows = _heads(lines, by_folder, _split_bound(lines)).collect()
    out = []
    for r in rows:
        first, banner = r["first"], r["banner"]
        if banner is None or tuple(first) != tuple(banner)[:4]:
            raise ValueError(f"{r['key']}: first line is not a %%MatrixMarket banner")
        size = r["size"]["size"] if r["size"] is not None else None
        out.append(_parse_header(r["key"], banner["banner"], size, int(r["kept_lines"]) - 1))
    return sorted(out, key=lambda m: m.key)


def info_frame(spark: SparkSession, infos: list[MatrixInfo]) -> DataFrame:
    return spark.createDataFrame(
        [(m.key, m.matrix_id, m.representation, m.field, m.symmetry, m.n_rows, m.n_cols, m.nnz,
          m.data_lines, m.diagonal) for m in infos],
        "key string, matrix_id string, representation string, field string, symmetry string, "
        "n_rows long, n_cols long, nnz long, data_lines long, diagonal boolean")


def read_info_frame(spark: SparkSession, path: str, by_folder: bool | None = None,
                    full: bool = False) -> DataFrame:
    """``read_info`` as a DataFrame, one row per matrix (``matrix_id, representation,
    field, symmetry, n_rows, n_cols, nnz, data_lines``); with ``full`` it is ``header_frame``."""
    if full:
        return header_frame(spark, path, by_folder).drop("key", "diagonal")
    return info_frame(spark, read_info(spark, path, by_folder, full)).drop("key", "diagonal")


def _with_array_position(t: DataFrame) -> DataFrame:
    """Column-major position ``k`` -> ``(ai, aj)``; triangle kinds list each column from
    the diagonal (symmetric) or below it (skew-symmetric) down. One projection per
    step, so that no expression is inlined twice."""
    k, n = F.col("k"), F.col("n_rows")
    skew = (F.col("symmetry") == "skew-symmetric") & ~F.col("diagonal")
    # values in column j before it: j*n - j(j-1)/2 (with diagonal), j*(n-1) - j(j-1)/2 (without)
    d = F.when(skew, n - 1).otherwise(n).cast("double")
    t = t.withColumn("_a", F.lit(2.0) * d + F.lit(1.0))
    t = t.withColumn("_j", F.floor((F.col("_a") - F.sqrt(F.col("_a") * F.col("_a")
                                                          - F.lit(8.0) * k.cast("double"))) / 2.0)
                     .cast("long"))
    dl = F.when(skew, n - 1).otherwise(n)

    def start(j):
        return j * dl - F.floor(j * (j - 1) / 2).cast("long")

    t = t.withColumn("_j", F.when(start(F.col("_j") + 1) <= k, F.col("_j") + 1)
                     .when(start(F.col("_j")) > k, F.col("_j") - 1).otherwise(F.col("_j")))
    tri_i = (k - start(F.col("_j")) + F.col("_j") + F.when(skew, 1).otherwise(0)).cast("long")
    gen = F.col("symmetry") == "general"
    return (t.withColumn("ai", F.when(gen, F.pmod(k, n)).otherwise(tri_i))
            .withColumn("aj", F.when(gen, F.floor(k / n)).otherwise(F.col("_j")).cast("long"))
            .drop("_a", "_j"))


def _positioned_entries(spark: SparkSession, path: str | list[str], by_folder: bool, infos: list[MatrixInfo],
                        strict_count: bool) -> DataFrame:
    """The lines after each matrix's size line with their positions and the matrix's header."""
    return _entry_lines(positioned(_lines(spark, path), by_folder, facts=info_frame(spark, infos)), strict_count)


def _entry_lines(t: DataFrame, strict_count: bool) -> DataFrame:
    """Positioned lines with their header, without the size lines."""
    entry = F.col("p") >= 1
    if strict_count:   # the size line itself carries the check, once per matrix
        short = F.raise_error(F.concat(F.col("key"), F.lit(": the size line declares "), F.col("nnz").cast("string"),
                                       F.lit(" entries, the file holds "), (F.col("n_lines") - 1).cast("string")))
        entry = F.when(F.col("p") >= 1, F.lit(True)).when(F.col("n_lines") - 1 == F.col("nnz"), F.lit(False)) \
            .otherwise(short.cast("boolean"))
    return t.where(entry).withColumn("head", F.col("p") < 1)


def _scanned_once(spark: SparkSession, files: list[str], m: MatrixInfo, strict_count: bool) -> DataFrame:
    """The entry lines of a single coordinate matrix from one scan of its text, with the header as literals.

    Entries need no position, only the size line has to go: the first kept line of the split at
    byte 0 of the first file. That file is scanned apart from the others: its splits, all
    of one size but the last, are then one to a partition from byte 0 on, so the line is
    the one with counter 0 at block start 0. It is compared with the text that the header was
    read from, so another cut of the file fails and nothing is dropped in its place.
    ``strict_count``: the size line also compares the declared entries with a scalar subquery
    that counts the kept lines, the only second look at the text."""
    def kept(some: list[str]) -> DataFrame:
        return spark.read.text(some).select("value", F.col("_metadata.file_block_start").alias("b")).where(_is_data(F.col("value")))

    def fail(text: Column) -> Column:
        return F.raise_error(F.concat(F.lit(m.key), text)).cast("boolean")

    rest = [f for f in files if f != m.first_file]
    counter = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    first = kept([m.first_file]).withColumn("is_size", (F.col("b") == 0) & (counter == 0))
    entry = F.lit(False)
    if strict_count:
        counted = kept(files).agg((F.count(F.lit(1)) - 1).alias("n")).scalar()
        entry = F.when(counted == F.lit(m.nnz), F.lit(False)).otherwise(
            fail(F.concat(F.lit(f": the size line declares {m.nnz} entries, the file holds "), counted.cast("string"))))
    entry = F.when(~F.col("is_size"), F.lit(True)).when(F.col("value") == F.lit(m.size_line), entry).otherwise(
        fail(F.lit(": the size line is not the first data line any more")))
    lines = first.where(entry).select("value", F.col("is_size").alias("head"))
    if rest:
        lines = lines.unionByName(kept(rest).select("value", F.lit(False).alias("head")))
    return lines.select(F.lit(m.key).alias("key"), F.lit(m.matrix_id).alias("matrix_id"), "value", "head",
                        F.lit(m.n_rows).cast("long").alias("n_rows"), F.lit(m.n_cols).cast("long").alias("n_cols"))


def read_entries(spark: SparkSession, path: str | list[str], by_folder: bool | None = None,
                 infos: list[MatrixInfo] | None = None,
                 strict_count: bool = False) -> tuple[DataFrame, list[MatrixInfo]]:
    """Stored entries of every matrix under ``path`` as
    ``(key, matrix_id, i, j, v[, im], ok, inside, line)``.

    0-based indices; ``pattern`` gives 1.0; ``complex`` gives ``v`` = real part and
    ``im``; ``array`` files give their values at column-major positions. ``ok`` is
    false for a malformed line, ``inside`` for an entry outside the declared shape
    (both kept, so that the checker can report them). ``key`` names a matrix: its path;
    ``matrix_id``, its last part, may repeat across folders. ``strict_count``: a
    matrix whose data lines are not as many as its size line says fails the job.
    """
    files = _list_files(spark, path) if infos is None or by_folder is None else None
    by_folder = resolve_by_folder(spark, path, by_folder, files)
    infos = infos if infos is not None else read_info(spark, path, by_folder, files=files)
    if len(infos) == 1 and infos[0].size_line is not None:
        t = _scanned_once(spark, files or _list_files(spark, path), infos[0], strict_count)
    else:
        t = _positioned_entries(spark, path, by_folder, infos, strict_count)
    kinds = {(m.representation, m.field) for m in infos}
    # per-row choice only when the files differ; otherwise plain expressions
    if len(kinds) == 1:
        ((rep, fld),) = kinds
        coord = F.lit(rep == "coordinate")
        field = F.lit(fld)
    else:
        coord = F.col("representation") == "coordinate"
        field = F.col("field")
    return _entries(t, coord, field, any(m.representation == "array" for m in infos),
                    any(m.field == "complex" for m in infos)), infos


def _entries(t: DataFrame, coord: Column, field: Column, arrays: bool, complexes: bool, facts: tuple[str, ...] = ()) -> DataFrame:
    """Parsed entry lines; ``coord`` and ``field``: the kind of a row's file."""
    t = t.withColumn("tok", tokens(F.col("value")))
    tok = lambda k: F.get(F.col("tok"), k)
    if arrays:
        t = _with_array_position(t.withColumn("k", F.col("p") - 1))
        ai, aj = F.col("ai"), F.col("aj")
    else:
        ai = aj = F.lit(None).cast("long")
    vtext = F.when(coord, tok(2)).otherwise(tok(0))
    v = F.when(coord & (field == "pattern"), F.lit(1.0)).otherwise(to_double(vtext))
    im = F.when(field == "complex", to_double(F.when(coord, tok(3)).otherwise(tok(1))))
    i = F.when(coord, to_long(tok(0)) - 1).otherwise(ai)
    j = F.when(coord, to_long(tok(1)) - 1).otherwise(aj)
    want = F.when(coord, F.when(field == "pattern", 2).when(field == "complex", 4).otherwise(3)) \
        .otherwise(F.when(field == "complex", 2).otherwise(1))
    ok = (i.isNotNull() & j.isNotNull() & v.isNotNull() & (F.size("tok") == want)
          & ((field != "complex") | im.isNotNull()))
    inside = (i >= 0) & (j >= 0) & (i < F.col("n_rows")) & (j < F.col("n_cols"))
    # the size line is filtered out above, but a filter that Spark derives may look at it
    # first, and must not take it for a malformed entry
    ok, inside = F.col("head") | ok, F.col("head") | inside
    cols = [F.col("key"), F.col("matrix_id"), i.alias("i"), j.alias("j"), v.alias("v")]
    if complexes:
        cols.append(im.alias("im"))
    return t.select(*cols, *facts, ok.alias("ok"), F.coalesce(inside, F.lit(False)).alias("inside"),
                    F.col("value").alias("line"))


def valid_entries(entries: DataFrame, strict: bool = True) -> DataFrame:
    """Entries without the check columns. ``strict``: a malformed line, or an entry
    outside the declared shape, fails the job when the scan reaches it
    (``raise_error``, no extra pass over the data); otherwise malformed lines are left
    out, as the caller asked, and entries outside the shape are kept."""
    keep = [c for c in entries.columns if c not in ("ok", "inside", "line", "key")]
    if not strict:
        return entries.where("ok").select(*keep)

    def fail(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(what + " in "), F.col("matrix_id"), F.lit(": "), F.col("line")))

    return entries.select(*[F.when(F.col("ok") & F.col("inside"), F.col(c))
                            .when(~F.col("ok"), fail("malformed Matrix Market line"))
                            .otherwise(fail("entry outside the declared shape")).alias(c)
                            if c in ("i", "j", "v") else F.col(c) for c in keep])


def read_matrix(spark: SparkSession, path: str, by_folder: bool | None = None,
                partitions: int | None = None, strict: bool = True) -> MatrixFrame:
    """One Matrix Market matrix as a ``MatrixFrame`` with the declared shape and
    storage symmetry (only the stored triangle is kept; products expand it).
    A malformed line, an entry outside the declared shape and a wrong number of entries
    fail the job (``strict``); with ``strict=False`` malformed lines are left out and the
    rest is taken as it stands. ``check_entries`` reports all violations without failing."""
    entries, infos = read_entries(spark, path, by_folder, strict_count=strict)
    if len(infos) != 1:
        raise ValueError(f"{path}: expected one matrix, found {len(infos)}; use read_entries")
    m = infos[0]
    if m.field == "complex":
        raise ValueError(f"{path}: complex values are read by read_entries (v, im), "
                         "not as a real MatrixFrame")
    e = valid_entries(entries, strict).select("i", "j", "v")
    if partitions:   # hash on the cell, so a hot row or column is spread too
        e = e.repartition(int(partitions), "i", "j")
    return MatrixFrame(e, m.n_rows, m.n_cols, m.symmetry)


def _number(value: Column, strict: bool) -> Column:
    x = to_double(F.trim(value))
    if not strict:
        return x
    return F.when(x.isNotNull(), x).otherwise(
        F.raise_error(F.concat(F.lit("malformed vector line: "), value)))


def read_vector(spark: SparkSession, path: str, length: int | None = None,
                strict: bool = True) -> VectorFrame:
    """Dense vector text, one number per line, line order = index (blank lines skipped).
    A line that is not a number, or a number of lines other than ``length``, fails the
    job (``strict``); otherwise such a line reads as null. One file, or one folder of
    ``part-*`` files; several vectors are refused."""
    files = _list_files(spark, path)
    by_folder = resolve_by_folder(spark, path, None, files)
    keys = {f.rsplit("/", 1)[0] for f in files} if by_folder else set(files)
    if len(keys) > 1:
        raise ValueError(f"{path}: expected one vector, found {len(keys)}; use read_vectors")
    pos = positioned(_lines(spark, path), by_folder)
    x = _number(F.col("value"), strict)
    if strict and length is not None:
        x = F.when(F.col("n_lines") == int(length), x).otherwise(F.raise_error(F.concat(
            F.lit(f"vector of declared length {int(length)} has "), F.col("n_lines").cast("string"), F.lit(" lines"))))
    return VectorFrame(pos.select(F.col("p").alias("i"), x.alias("x")), length, unique=True)


def read_vectors(spark: SparkSession, path: str, by_folder: bool | None = None,
                 strict: bool = True, ids: DataFrame | None = None) -> DataFrame:
    """Many vector files at once: ``(vector_id, i, x)``, ``vector_id`` = file (or folder) name.
    ``by_folder=None``: a ``part-*`` file belongs to its folder's vector, any other is one itself.
    ``ids (key, vector_id)``: only these vectors, under these names."""
    lines = _lines(spark, path)
    if ids is None:
        ids = names(spark, path, by_folder).withColumnRenamed("matrix_id", "vector_id")
    pos = positioned(lines, by_folder, _split_bound(lines), ids)
    return pos.select("vector_id", F.col("p").alias("i"), _number(F.col("value"), strict).alias("x"))


def check_entries(entries: DataFrame, infos: list[MatrixInfo], spark: SparkSession) -> DataFrame:
    """Violations per matrix as ``(matrix_id, check, n)``, only checks with n > 0:
    ``malformed`` lines, entries ``out_of_shape``, ``count`` = data lines minus the
    declared number, ``upper_triangle`` entries in a triangle-stored file."""
    info = hint_small(spark, info_frame(spark, infos).select("key", "matrix_id", "symmetry", "nnz"), len(infos))
    e = entries.drop("matrix_id").join(info, on="key")
    bad_shape = F.col("ok") & ~F.col("inside")
    upper = F.col("ok") & (F.col("symmetry") != "general") & (F.col("i") < F.col("j"))
    agg = e.groupBy("key").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count(F.when(~F.col("ok"), 1)).alias("malformed"),
        F.count(F.when(bad_shape, 1)).alias("out_of_shape"),
        F.count(F.when(upper, 1)).alias("upper_triangle"))
    full = (info.select("key", "matrix_id", "nnz").join(agg, on="key", how="left").fillna(0)
            .withColumn("count", F.col("lines") - F.col("nnz")))
    stacked = full.select("matrix_id", F.expr(
        "stack(4, 'count', `count`, 'malformed', malformed, 'out_of_shape', out_of_shape, "
        "'upper_triangle', upper_triangle) AS (check, n)"))
    return stacked.where(F.col("n") != 0).select("matrix_id", "check", F.col("n").cast("long").alias("n"))
