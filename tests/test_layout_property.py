"""Property test: every layout equals a brute-force dense product, for arbitrary
small matrices (duplicates, any storage symmetry, sparse operands, both sides)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import mat
from tessera import LAYOUTS, VectorFrame


@st.composite
def problem(draw):
    n = draw(st.integers(1, 12))
    m = draw(st.integers(1, 12))
    sym = draw(st.sampled_from(["general", "symmetric", "skew-symmetric"]))
    if sym != "general":
        m = n
    cells = draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, m - 1),
                                    st.integers(-9, 9)), max_size=40))
    if sym != "general":
        cells = [(max(i, j), min(i, j), v) for i, j, v in cells]
    trans = draw(st.booleans())
    length = n if trans else m
    xs = draw(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=length, max_size=length))
    width = draw(st.sampled_from([1, 2, 3, 8]))
    return n, m, sym, cells, trans, xs, width


def _dense(n, m, sym, cells):
    a = [[0.0] * m for _ in range(n)]
    for i, j, v in cells:
        if sym == "skew-symmetric" and i == j:
            continue
        a[i][j] += v
        if sym == "symmetric" and i != j:
            a[j][i] += v
        if sym == "skew-symmetric":
            a[j][i] -= v
    return a


@settings(max_examples=10, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(problem())
def test_layouts_match_brute_force(spark, case):
    n, m, sym, cells, trans, xs, width = case
    a = mat(spark, cells, n, m, sym)
    rows = [(k, float(x)) for k, x in enumerate(xs) if x is not None]
    x = VectorFrame(spark.createDataFrame(rows, "i long, x double"), len(xs), unique=True)
    d = _dense(n, m, sym, cells)
    xv = [0.0 if v is None else float(v) for v in xs]
    if trans:
        want = [sum(d[r][c] * xv[r] for r in range(n)) for c in range(m)]
    else:
        want = [sum(d[r][c] * xv[c] for c in range(m)) for r in range(n)]
    for layout in LAYOUTS:
        if layout == "graph" and n != m:
            continue
        y = a.multiply(x, trans=trans, layout=layout, width=width)
        got = [r.x for r in y.to_dense().df.orderBy("i").collect()]
        assert got == want, (layout, sym, trans)
