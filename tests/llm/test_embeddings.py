import math
import random

import numpy as np

from tessera.llm import embeddings


def brute(rows, t=0.95):
    ok = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) for _, v in rows]
    n = len(rows)
    adj = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= t:
                    adj[i].append(j)
                    adj[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in adj[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(adj[i]), low, rows[i][0] is not None and rows[i][0] == low))
    return sorted(out, key=repr)


def sample(seed=1):
    rnd = random.Random(seed)
    base = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(25)]
    rows = []
    for i in range(220):
        b, s = rnd.choice(base), rnd.choice([0, 0.05, 0.2, 0.3])
        rows.append(((i * 7) % 223, [x + rnd.gauss(0, s) for x in b]))
    rows += [(900, None), (901, [0.0] * 16), (902, [1.0, None] * 8), (903, [math.nan] * 16), (904, []),
             (905, [math.inf] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, base[0]), (3, base[0]), (3, base[0])]
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_brute_force_over_small_tiles(spark):
    rows = sample()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(embeddings.near_duplicates(df, tile=17, pivots=5)) == brute(rows)


def test_one_tile_extra_columns_and_empty_table(spark):
    rows = sample(2)[:60]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows],
                               "vec_id long, embedding array<double>, node int, vec string, tile int")
    assert rows_of(embeddings.near_duplicates(df)) == brute(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(1)
    x = embeddings.unit_rows(rng.normal(size=(300, 40)))
    y = embeddings.unit_rows(x + rng.normal(size=x.shape) * rng.choice([0.01, 0.05, 0.2], (300, 1)))
    for t in (0.95, 0.9, 0.3, -0.2):
        a, b = embeddings.near_pairs(x, y, t)
        want = set(zip(*map(lambda v: v.tolist(), np.nonzero((x[:, None, :] * y[None, :, :]).sum(axis=2) >= t))))
        assert set(zip(a.tolist(), b.tolist())) == want
