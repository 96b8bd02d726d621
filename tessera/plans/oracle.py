"""DuckDB oracle SQL for the named queries (same column names and types).

Written directly against the driver's tables, independent of the Spark code:
each matrix or vector is a CTE, each operator a plain SQL formula for it.
"""

from __future__ import annotations

CTE = {
    "li": "SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, "
          "l_quantity AS v FROM lineitem",
    "px": "SELECT CAST(p_partkey AS BIGINT) AS i, p_retailprice AS x FROM part",
    "ox": "SELECT CAST(o_orderkey AS BIGINT) AS i, o_totalprice AS x FROM orders",
    "nt": "SELECT CAST(c.c_nationkey AS BIGINT) AS i, CAST(s.s_nationkey AS BIGINT) AS j, "
          "l.l_quantity AS v FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
          "JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey",
    "syms": "SELECT greatest(i, j) AS i, least(i, j) AS j, v FROM nt",
    "symf": "SELECT i, j, v FROM syms UNION ALL SELECT j AS i, i AS j, v FROM syms WHERE i <> j",
    "nodiag": "SELECT i, j, v FROM syms WHERE i <> j UNION ALL SELECT j AS i, i AS j, v FROM syms WHERE i <> j",
    "skewf": "SELECT i, j, v FROM syms WHERE i <> j UNION ALL SELECT j AS i, i AS j, -v AS v FROM syms WHERE i <> j",
    "cpn": "SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(count(*) AS DOUBLE) AS x FROM customer GROUP BY 1",
    "codes": "SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS code "
             "FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)",
    "ev": "SELECT DISTINCT CAST(user_id AS BIGINT) AS i, code AS j, 1.0 AS v FROM events JOIN codes USING (event_type)",
    "ept": "SELECT code AS i, CAST(count(*) AS DOUBLE) AS x FROM events JOIN codes USING (event_type) GROUP BY 1",
    "em": "SELECT CAST(vec_id AS BIGINT) AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, "
          "CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "fe": "SELECT CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i, "
          "CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings "
          "WHERE vec_id = (SELECT min(vec_id) FROM embeddings)",
    "canon": "SELECT i, j, SUM(v) AS v FROM li GROUP BY i, j",
    "hotrow": "SELECT CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_orderkey END AS BIGINT) AS i, "
              "CAST(l_partkey AS BIGINT) AS j, CAST(l_quantity AS DECIMAL(15,2)) AS v FROM lineitem",
    "hotcells": "SELECT i, j, CAST(SUM(v) AS DOUBLE) AS v, row_number() OVER (ORDER BY i, j) - 1 AS r, "
                "count(*) OVER () AS total FROM hotrow GROUP BY i, j",
    "grid": "SELECT i // 1024 AS bi, j // 256 AS bj, CAST(j % 256 AS INTEGER) AS col, CAST(i % 1024 AS INTEGER) AS r, v FROM canon",
    "gcols": "SELECT bi, bj, col, count(*) AS n, min(r) AS first_row, sum(v) AS total FROM grid GROUP BY bi, bj, col",
    "ps": "SELECT CAST(l_partkey AS BIGINT) AS i, CAST(l_suppkey + (SELECT max(p_partkey) + 1 FROM part) AS BIGINT) AS j, "
          "l_quantity AS v FROM lineitem",
    "psx": "SELECT CAST(p_partkey AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS x FROM part UNION ALL "
           "SELECT CAST(s_suppkey + (SELECT max(p_partkey) + 1 FROM part) AS BIGINT), CAST(s_nationkey + 1 AS DOUBLE) FROM supplier",
    # 16 edge partitions, a square of side 4; an end with a sixteenth of all edges is a hub
    "psh": "SELECT i AS id FROM ps GROUP BY i HAVING count(*) >= (SELECT count(*) FROM ps) / 16.0 UNION "
           "SELECT j FROM ps GROUP BY j HAVING count(*) >= (SELECT count(*) FROM ps) / 16.0",
    "pse": "SELECT i, j, CAST(CASE WHEN i IN (SELECT id FROM psh) OR j IN (SELECT id FROM psh) "
           "THEN (i % 2147483647 * 48271 % 2147483647 + j % 2147483647 * 48271 % 2147483647 * 3) % 16 "
           "ELSE i % 2147483647 * 48271 % 2147483647 % 4 * 4 + j % 2147483647 * 48271 % 2147483647 % 4 END AS INTEGER) AS part "
           "FROM (SELECT DISTINCT i, j FROM ps)",
}

# which CTEs each CTE needs
_DEPS = {"ev": ["codes"], "ept": ["codes"], "syms": ["nt"], "symf": ["syms"], "nodiag": ["syms"], "skewf": ["syms"], "canon": ["li"],
         "hotcells": ["hotrow"], "grid": ["canon"], "gcols": ["grid"], "psh": ["ps"], "pse": ["ps", "psh"]}

N_ORDERS = "(SELECT max(o_orderkey) + 1 FROM orders)"
N_PARTS = "(SELECT max(p_partkey) + 1 FROM part)"
N_NATIONS = "(SELECT max(n_nationkey) + 1 FROM nation)"


def _with(*names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " "


def spmv_sql(matrix: str, vector: str, digits: int, trans: bool = False, exact: bool = False) -> str:
    ri, cj = ("j", "i") if trans else ("i", "j")
    if exact:   # two-decimal inputs multiplied and summed as DECIMAL, one rounding at the end
        prod = "CAST(e.v AS DECIMAL(15,2)) * CAST(COALESCE(x.x, 0) AS DECIMAL(15,2))"
        total = f"CAST(SUM({prod}) AS DOUBLE)"
    else:
        total = "SUM(e.v * COALESCE(x.x, 0))"
    return (_with(matrix, vector)
            + f"SELECT e.{ri} AS i, ROUND({total}, {digits}) AS x "
              f"FROM {matrix} e LEFT JOIN {vector} x ON e.{cj} = x.i GROUP BY e.{ri}")


def _dense_range(n: str) -> str:
    return f"SELECT CAST(unnest(range(0, {n})) AS BIGINT) AS i"


def _power_sql(steps: int, digits: int) -> str:
    parts = [f"x0 AS (SELECT CAST(unnest(range(0, {N_NATIONS})) AS BIGINT) AS i, 1.0 AS x)"]
    for k in range(1, steps + 1):
        parts.append(f"y{k} AS (SELECT e.i AS i, SUM(e.v * COALESCE(x.x, 0)) AS x FROM symf e "
                     f"LEFT JOIN x{k - 1} x ON e.j = x.i GROUP BY e.i)")
        parts.append(f"x{k} AS (SELECT i, x / (SELECT sqrt(SUM(x * x)) FROM y{k}) AS x FROM y{k})")
    return (_with("symf")[:-1] + ", " + ", ".join(parts)
            + f" SELECT i, ROUND(x, {digits}) AS x FROM x{steps}")


def _converged_sql(tolerance: float, steps: int) -> str:
    """``steps`` rounds written out; the first whose residual is within the tolerance is taken."""
    n = N_NATIONS
    parts = ["a AS MATERIALIZED (SELECT i, j, SUM(v) AS v FROM symf GROUP BY i, j)",
             f"x1 AS MATERIALIZED (SELECT CAST(unnest(range(0, {n})) AS BIGINT) AS i, 1.0 / sqrt({n}) AS x)"]
    found = []
    for k in range(1, steps + 1):
        parts.append(f"b{k} AS MATERIALIZED (SELECT x.i AS i, x.x AS x, COALESCE(y.y, 0) AS y FROM x{k} x LEFT JOIN "
                     f"(SELECT a.i AS i, SUM(a.v * z.x) AS y FROM a JOIN x{k} z ON a.j = z.i GROUP BY a.i) y ON x.i = y.i)")
        parts.append(f"e{k} AS MATERIALIZED (SELECT SUM(x * y) / SUM(x * x) AS e, sqrt(SUM(y * y)) AS n FROM b{k})")
        found.append(f"SELECT {k} AS steps, e, sqrt(SUM((y - e * x) * (y - e * x))) / abs(e) AS residual, "
                     f"max(abs(x)) AS largest FROM b{k}, e{k} GROUP BY e")
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT i, y / n AS x FROM b{k}, e{k})")
    return (_with("symf")[:-1] + ", " + ", ".join(parts) + ", found AS (" + " UNION ALL ".join(found)
            + ") SELECT ROUND(e, 3) AS eigenvalue, CAST(steps AS BIGINT) AS steps, ROUND(residual, 9) AS residual, "
            f"ROUND(largest, 8) AS largest FROM found WHERE residual <= {tolerance} ORDER BY steps LIMIT 1")


_KIND = """
SELECT m.matrix_id, CASE WHEN NOT sq THEN 'general'
  WHEN coalesce(is_sym, true) THEN 'symmetric'
  WHEN coalesce(is_skew, true) THEN 'skew-symmetric' ELSE 'general' END AS kind
FROM (SELECT 'nt' AS matrix_id, true AS sq UNION ALL SELECT 'sym', true UNION ALL SELECT 'skew', true) m
LEFT JOIN (
  SELECT a.matrix_id, bool_and(a.v = coalesce(b.v, 0)) AS is_sym, bool_and(a.v = -coalesce(b.v, 0)) AS is_skew
  FROM nz a LEFT JOIN nz b ON a.matrix_id = b.matrix_id AND a.i = b.j AND a.j = b.i
  GROUP BY a.matrix_id) f ON m.matrix_id = f.matrix_id
"""

_NZ = ("nz AS (SELECT matrix_id, i, j, SUM(v) AS v FROM ("
       "SELECT 'nt' AS matrix_id, i, j, v FROM nt UNION ALL SELECT 'sym', i, j, v FROM symf "
       "UNION ALL SELECT 'skew', i, j, v FROM skewf) GROUP BY matrix_id, i, j HAVING SUM(v) <> 0)")


_HERM = ("WITH cpn AS (" + CTE["cpn"] + "), h0 AS (SELECT CAST(c.c_nationkey AS BIGINT) AS a, "
         "CAST(s.s_nationkey AS BIGINT) AS b, l.l_quantity AS v, round(l.l_discount * 100) AS d "
         "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c "
         "ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey), "
         "hs AS (SELECT greatest(a, b) AS i, least(a, b) AS j, v, CASE WHEN a = b THEN 0.0 ELSE d END AS im "
         "FROM h0), hf AS (SELECT i, j, v, im FROM hs UNION ALL SELECT j AS i, i AS j, v, -im AS im "
         "FROM hs WHERE i <> j) ")

ORACLE: dict[str, str] = {
    "spmv": spmv_sql("li", "px", 4),
    "spmv_dense": _with("li", "px") + f", r AS ({_dense_range(N_ORDERS)}), "
                  "y AS (SELECT e.i AS i, ROUND(SUM(e.v * COALESCE(x.x, 0)), 4) AS x "
                  "FROM li e LEFT JOIN px x ON e.j = x.i GROUP BY e.i) "
                  "SELECT r.i AS i, COALESCE(y.x, 0.0) AS x FROM r LEFT JOIN y ON r.i = y.i",
    "spmv_trans": spmv_sql("li", "ox", 4, trans=True, exact=True),
    "spmv_pattern": spmv_sql("ev", "ept", 4),
    "spmv_embedding": spmv_sql("em", "fe", 4),
    "spmv_sym": spmv_sql("symf", "cpn", 2),
    "spmv_sym_trans": spmv_sql("symf", "cpn", 2, trans=True),
    "spmv_sym_nodiag": spmv_sql("nodiag", "cpn", 2),
    "spmv_skew": spmv_sql("skewf", "cpn", 2),
    "spmv_hot_row": "WITH e AS (SELECT CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_orderkey END AS BIGINT) AS i, "
                    "CAST(l_partkey AS BIGINT) AS j, l_quantity AS v FROM lineitem), x AS (" + CTE["px"] + ") "
                    "SELECT e.i AS i, ROUND(CAST(SUM(CAST(e.v AS DECIMAL(15,2)) * CAST(COALESCE(x.x, 0) AS "
                    "DECIMAL(15,2))) AS DOUBLE), 4) AS x FROM e LEFT JOIN x ON e.j = x.i GROUP BY e.i",
    "spmv_hot_column_shuffled": "WITH e AS (SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(CASE WHEN l_linenumber = 1 "
                                "THEN 0 ELSE l_partkey END AS BIGINT) AS j, l_quantity AS v FROM lineitem), "
                                "x AS (" + CTE["px"] + ") SELECT e.i AS i, ROUND(CAST(SUM(CAST(e.v AS DECIMAL(15,2)) * "
                                "CAST(COALESCE(x.x, 0) AS DECIMAL(15,2))) AS DOUBLE), 4) AS x FROM e LEFT JOIN x "
                                "ON e.j = x.i GROUP BY e.i",
    "spmv_packed": spmv_sql("li", "px", 4),
    "spmv_packed_trans": spmv_sql("li", "ox", 4, trans=True),
    "spmv_packed_sym": spmv_sql("symf", "cpn", 2),
    "spmv_blocked": spmv_sql("li", "px", 4),
    "spmv_blocked_trans": spmv_sql("li", "ox", 4, trans=True),
    "spmv_blocked_sym": spmv_sql("symf", "cpn", 2),
    "spmv_hot_column_salted": "WITH e AS (SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(CASE WHEN l_linenumber = 1 "
                              "THEN 0 ELSE l_partkey END AS BIGINT) AS j, l_quantity AS v FROM lineitem), "
                              "x AS (" + CTE["px"] + ") SELECT e.i AS i, ROUND(CAST(SUM(CAST(e.v AS DECIMAL(15,2)) * "
                              "CAST(COALESCE(x.x, 0) AS DECIMAL(15,2))) AS DOUBLE), 4) AS x FROM e LEFT JOIN x "
                              "ON e.j = x.i GROUP BY e.i",
    "spmv_grid": spmv_sql("li", "px", 4),
    "spmv_grid_trans": spmv_sql("li", "ox", 4, trans=True),
    "spmv_grid_sym": spmv_sql("symf", "cpn", 2),
    "spmv_grid_shuffled": spmv_sql("li", "px", 4),
    "spmv_balanced": spmv_sql("li", "px", 4),
    "spmv_graph_routed": spmv_sql("ps", "psx", 2),
    "spmv_graph_routed_trans": spmv_sql("ps", "psx", 2, trans=True),
    "nnz_partitions": _with("hotcells") + "SELECT CAST(r * 16 // total AS INTEGER) AS part, count(DISTINCT i) AS rows, "
                                          "count(*) AS nnz FROM hotcells GROUP BY 1",
    "balanced_positions": _with("hotcells") + "SELECT i, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS pos, j, v FROM hotcells",
    "grid_blocks": _with("grid") + "SELECT bi, bj, count(*) AS nnz, CAST(count(DISTINCT col) AS INTEGER) AS n_cols, "
                                   "CAST(count(DISTINCT r) AS INTEGER) AS n_rows, CAST(count(*) AS INTEGER) AS \"end\" "
                                   "FROM grid GROUP BY bi, bj",
    "csc_blocks": _with("gcols") + "SELECT bi, bj, col, CAST(sum(n) OVER w - n AS INTEGER) AS first, CAST(sum(n) OVER w AS INTEGER) AS last, "
                                   "CAST(n AS INTEGER) AS nnz, first_row, ROUND(total, 2) AS total FROM gcols "
                                   "WINDOW w AS (PARTITION BY bi, bj ORDER BY col)",
    "graph_routing": _with("pse") + "SELECT part, count(*) AS n_edges, CAST(count(DISTINCT j) AS INTEGER) AS n_in, "
                                    "CAST(count(DISTINCT i) AS INTEGER) AS n_out FROM pse GROUP BY part",
    "spmv_graph": spmv_sql("nt", "cpn", 2),
    "spmv_graph_trans": spmv_sql("nt", "cpn", 2, trans=True),
    "spmv_graph_sym": spmv_sql("symf", "cpn", 2),
    "spmv_repeat": spmv_sql("nt", "cpn", 2),
    "random_vector": "SELECT count(*) AS n, count(DISTINCT p_partkey) AS n_distinct, true AS mean_near, "
                     "true AS deviation_near FROM part",
    "transpose": _with("li") + "SELECT j AS i, i AS j, v FROM li",
    "diagonal": _with("nt") + "SELECT i, ROUND(SUM(v), 2) AS x FROM nt WHERE i = j GROUP BY i",
    "lower_triangle": _with("nt") + "SELECT i, j, v FROM nt WHERE i >= j",
    "sym_expand": _with("symf") + "SELECT i, j, v FROM symf",
    "skew_expand": _with("skewf") + "SELECT i, j, v FROM skewf",
    "canonicalize": _with("canon") + "SELECT i, j, v FROM canon",
    "shape": _with("li") + f"SELECT greatest({N_ORDERS}, max(i) + 1) AS n_rows, "
                           f"greatest({N_PARTS}, max(j) + 1) AS n_cols, count(*) AS stored FROM li",
    "nnz": _with("canon") + "SELECT count(*) AS nnz FROM canon WHERE v <> 0",
    "active_size": _with("li") + "SELECT count(DISTINCT i) AS active_size FROM li",
    "indexed_rows": _with("canon") + "SELECT i, row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS pos, "
                                     "j, v FROM canon",
    "row_matrix": _with("canon") + "SELECT count(*) AS nnz, sqrt(SUM(v * v)) AS norm FROM canon GROUP BY i",
    "to_dense": _with("symf") + f", c AS (SELECT i, j, SUM(v) AS v FROM symf GROUP BY i, j), "
                f"g AS (SELECT CAST(unnest(range(0, {N_NATIONS} * {N_NATIONS})) AS BIGINT) AS id) "
                f"SELECT g.id // {N_NATIONS} AS i, g.id % {N_NATIONS} AS j, ROUND(COALESCE(c.v, 0), 2) AS v "
                f"FROM g LEFT JOIN c ON c.i = g.id // {N_NATIONS} AND c.j = g.id % {N_NATIONS}",
    "scatter_add": f"WITH r AS ({_dense_range(N_PARTS)}), s AS (SELECT CAST(l_partkey AS BIGINT) AS i, "
                   "SUM(l_quantity) AS x FROM lineitem GROUP BY 1) "
                   "SELECT r.i AS i, ROUND(COALESCE(s.x, 0), 4) AS x FROM r LEFT JOIN s ON r.i = s.i",
    "symmetry_kind": _with("symf", "skewf")[:-1] + ", " + _NZ + _KIND,
    "graph_vertices": _with("nt") + "SELECT id, CAST(0.0 AS DOUBLE) AS attr FROM (SELECT i AS id FROM nt UNION "
                                    "SELECT j AS id FROM nt)",
    "vec_dot": "SELECT CAST(SUM(CAST(p_retailprice AS DECIMAL(15,2)) * CAST(p_retailprice AS DECIMAL(15,2))) "
               "AS DOUBLE) AS dot FROM part",
    "vec_div": _with("ox") + "SELECT i, x / 7.0 AS x FROM ox",
    "vec_norm": "SELECT sqrt(CAST(SUM(d * d) AS DOUBLE)) AS norm FROM "
                "(SELECT CAST(p_retailprice AS DECIMAL(15,2)) AS d FROM part)",
    "vec_add": "SELECT CAST(p_partkey AS BIGINT) AS i, ROUND(p_retailprice + CAST(p_size AS DOUBLE), 4) AS x "
               "FROM part",
    "vec_sub": "SELECT CAST(p_partkey AS BIGINT) AS i, ROUND(p_retailprice - CAST(p_size AS DOUBLE), 4) AS x "
               "FROM part",
    "vec_mul": "SELECT CAST(p_partkey AS BIGINT) AS i, ROUND(p_retailprice * CAST(p_size AS DOUBLE), 4) AS x "
               "FROM part",
    "residual": _with("li", "px", "ox") + ", y AS (SELECT e.i AS i, SUM(e.v * COALESCE(x.x, 0)) AS x "
                "FROM li e LEFT JOIN px x ON e.j = x.i GROUP BY e.i), "
                "d AS (SELECT i, SUM(x) AS x FROM (SELECT i, x FROM y UNION ALL SELECT i, -x AS x FROM ox) "
                "GROUP BY i) SELECT ROUND(COALESCE(max(abs(x)), 0), 2) AS max_abs, "
                "ROUND(sqrt(COALESCE(SUM(x * x), 0)), 2) AS norm2 FROM d",
    "power_step_3": _power_sql(3, 8),
    "power_converged": _converged_sql(1e-6, 30),
    "complex_spmv": "WITH e AS (SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, "
                    "l_quantity AS v, round(l_discount * 100) AS im FROM lineitem), "
                    "x AS (SELECT CAST(p_partkey AS BIGINT) AS i, p_retailprice AS xr, "
                    "CAST(p_size AS DOUBLE) AS xi FROM part) "
                    "SELECT e.i AS i, ROUND(SUM(e.v * COALESCE(x.xr, 0) - e.im * COALESCE(x.xi, 0)), 4) AS x, "
                    "ROUND(SUM(e.v * COALESCE(x.xi, 0) + e.im * COALESCE(x.xr, 0)), 4) AS xi "
                    "FROM e LEFT JOIN x ON e.j = x.i GROUP BY e.i",
    "hermitian_spmv": _HERM + "SELECT e.i AS i, ROUND(SUM(e.v * COALESCE(c.x, 0)), 2) AS x, "
                      "ROUND(SUM(e.im * COALESCE(c.x, 0)), 2) AS xi FROM hf e LEFT JOIN cpn c ON e.j = c.i "
                      "GROUP BY e.i",
    "complex_kind": _HERM + ", nz AS (SELECT i, j, SUM(v) AS v, SUM(im) AS im FROM hf GROUP BY i, j "
                    "HAVING SUM(v) <> 0 OR SUM(im) <> 0), f AS (SELECT bool_and(a.v = coalesce(b.v, 0) "
                    "AND a.im = coalesce(b.im, 0)) AS sym, bool_and(a.v = -coalesce(b.v, 0) AND "
                    "a.im = -coalesce(b.im, 0)) AS skew, bool_and(a.v = coalesce(b.v, 0) AND "
                    "a.im = -coalesce(b.im, 0)) AS herm, max(abs(a.im)) AS max_im FROM nz a LEFT JOIN nz b "
                    "ON a.i = b.j AND a.j = b.i) SELECT CASE WHEN coalesce(sym, true) THEN 'symmetric' "
                    "WHEN coalesce(skew, true) THEN 'skew-symmetric' WHEN coalesce(max_im, 0) > 0 THEN "
                    "(CASE WHEN coalesce(herm, true) THEN 'hermitian' ELSE 'general' END) ELSE 'general' END "
                    "AS kind, (SELECT CASE WHEN coalesce(max(abs(im)), 0) > 0 THEN 'complex' ELSE 'real' END "
                    "FROM hf) AS field FROM f",
}
