"""Bench: sparse matrix x vector on the driver tables, per layout, warm medians.

As in the reference's timing loop, a matrix is read once and kept in memory,
then multiplied repeatedly by one vector: one first run (reported apart under
``first_run``), then the median of ``BENCH_RUNS`` timed runs (``queries``),
each forced to completion with the ``noop`` sink.
Also timed: the end-to-end query from parquet (no cache) and reading a Matrix
Market file of the lineitem matrix followed by a product.

Prints one JSON line. Env: BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default 8), BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.session import local_session  # noqa: E402


def _force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _timed(fn, runs: int) -> tuple[float, float]:
    """(first run, median of the next ``runs``) in seconds; the first run is the
    warm-up, reported apart as the reference reports its first product."""
    t0 = time.perf_counter()
    fn()
    first = time.perf_counter() - t0
    times = []
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return first, statistics.median(times)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=cpus, driver_memory="16g")
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-bench-"))

    from tessera.plans.named import spmv as spmv_query
    from tessera.sinks.matrix_market import write_matrix_market
    from tessera.session import scratch_path
    from tessera.sources.matrix_market import read_matrix
    from tessera.sources.tables import DriverTables

    t = DriverTables(spark, sf_dir)
    li = t.li().cache()
    nt = t.nt().cache()
    sym = t.sym().cache()
    for m in (li, nt, sym):
        m.entries.count()
    # kept matrices, as the reference persists its forms: each layout built once
    li.prepare("join").prepare("packed").prepare("blocked")
    sym.prepare("join")
    px, ox, cpn = t.px(), t.ox(), t.customers_per_nation()

    cases = {
        "spmv_join": lambda: _force(li.multiply(px).df),
        "spmv_join_shuffled": lambda: _force(li.multiply(px, broadcast=False).df),
        "spmv_trans": lambda: _force(li.multiply(ox, trans=True).df),
        "spmv_packed": lambda: _force(li.multiply(px, layout="packed").df),
        "spmv_blocked": lambda: _force(li.multiply(px, layout="blocked").df),
        "spmv_graph": lambda: _force(nt.multiply(cpn, layout="graph").df),
        "spmv_sym": lambda: _force(sym.multiply(cpn).df),
        "spmv_dense": lambda: _force(li.multiply(px).to_dense().df),
        "spmv_parquet": lambda: _force(spmv_query(spark, sf_dir)),
    }
    from tessera.operators.power import power_iteration
    from tessera.vector import VectorFrame

    y_li = li.multiply(px)
    ones = VectorFrame(spark.range(sym.n_rows).selectExpr("id AS i", "1.0 AS x"), sym.n_rows, True)
    cases.update({
        "dot": lambda: y_li.dot_value(li.multiply(px, layout="packed")),
        "power_5": lambda: power_iteration(sym, ones, 5, checkpoint_every=None),
        "indexed_rows": lambda: _force(li.indexed_entries()),
        "symmetry_kind": lambda: sym.symmetry_kind().collect(),
    })
    mm_path = scratch_path(spark, "bench_li.mtx")
    write_matrix_market(li, mm_path)  # setup: written once, read in every timed run

    def mm_read_multiply():
        a = read_matrix(spark, mm_path, by_folder=True)
        _force(a.multiply(px, check=False).df)

    cases["mm_read_spmv"] = mm_read_multiply

    timed, errors = {}, {}
    for name, fn in cases.items():
        try:
            timed[name] = _timed(fn, runs)
        except Exception as e:  # noqa: BLE001 - one failing case must not hide the others
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    results = {name: round(t[1], 4) for name, t in timed.items()}
    first = {name: round(t[0], 4) for name, t in timed.items()}
    total = round(sum(results.values()), 4)
    sf_text = os.path.basename(sf_dir).replace("sf", "")
    try:
        sf = float(sf_text)
    except ValueError:
        sf = sf_text
    print(json.dumps({
        "metric": "spmv_suite_sum_of_warm_medians",
        "value": total,
        "unit": "sec",
        "queries": results,
        "sf": sf,
        "first_run": first,
        "entries": li.stored_count(),
        "cpus": cpus,
        "runs": runs,
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
