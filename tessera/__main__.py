"""Command line: repeated products of a Matrix Market (or parquet) matrix.

    python -m tessera multiply PATH [--runs 20] [--layout join] [--trans]
                                    [--partitions N] [--seed 0] [--parquet]

Reads the matrix, draws a random normal operand (deterministic per index and
seed), prepares the layout once and times ``runs`` products; prints one JSON
line with the first run apart from the mean of the others. Works under
``spark-submit`` too: the session (master, memory, checkpoint folder) comes
from the submit command when one is active.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import LAYOUTS, VectorFrame, read_matrix, read_matrix_parquet, repeat_multiply
from .matrix import layout_name


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m tessera")
    sub = parser.add_subparsers(dest="command", required=True)
    mul = sub.add_parser("multiply", help="time repeated products A x (or A' x)")
    mul.add_argument("path")
    mul.add_argument("--runs", type=int, default=20)
    mul.add_argument("--layout", type=layout_name, default="join",
                     help=f"one of {LAYOUTS}, or COO / CSC")
    mul.add_argument("--trans", action="store_true")
    mul.add_argument("--partitions", type=int, default=None)
    mul.add_argument("--seed", type=int, default=0)
    mul.add_argument("--parquet", action="store_true", help="PATH was written by the parquet sink")
    mul.add_argument("--folder", action="store_true", help="PATH is a folder of part files")
    args = parser.parse_args(argv)

    spark = SparkSession.getActiveSession()
    if spark is None:
        from .session import local_session

        spark = local_session()
    if args.parquet:
        a = read_matrix_parquet(spark, args.path)
    else:
        a = read_matrix(spark, args.path, by_folder=args.folder, partitions=args.partitions)
    n = a.n_rows if args.trans else a.n_cols
    x = VectorFrame.random_normal(spark, n, seed=args.seed)
    out = repeat_multiply(a, x, runs=args.runs, layout=args.layout, trans=args.trans)
    print(json.dumps({"matrix": args.path, "shape": list(a.shape), "symmetry": a.symmetry,
                      "layout": args.layout, "trans": args.trans, "runs": args.runs,
                      "first_sec": round(out["first"], 4),
                      "mean_rest_sec": None if out["mean_rest"] is None else round(out["mean_rest"], 4)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
