import math
import random
from itertools import combinations

import numpy as np

from tessera.llm import toxicity as tox


def brute_features(word):
    s = f"\0{word}\1"
    out = {}
    for i, j, k in combinations(range(len(s)), 3):
        if j - i <= tox.GAP and k - j <= tox.GAP:
            u = (s[i], s[j], s[k])
            out[u] = out.get(u, 0.0) + tox.DECAY ** (k - i - 2)
    return out


def brute_kernel(a, b):
    x, y = brute_features(a), brute_features(b)
    dot = lambda p, q: sum(v * q.get(u, 0.0) for u, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def test_kernel_equals_enumerated_subsequences():
    words = ["idiot", "idxiot", "banana", "a", "moron", "oronm" * 4]
    got = tox.kernel(words, words[:4])
    want = np.array([[brute_kernel(a, b) for b in words[:4]] for a in words])
    assert np.allclose(got, want)


def test_folded_table_equals_the_kernel_expansion():
    pos, neg = ["idiot", "moron", "loser"], ["the", "that", "shine", "thinner", "idea", "more"]
    weights, bias = tox.fit_svm(pos, neg, np.ones(9), n_landmarks=6)
    margins = tox.Model(weights, bias, np.ones(3), 0.0).margins(pos + neg)
    assert (margins[:3] > 0).all() and (margins[3:] < 0).all()
    k = tox.kernel(["idxiot", "loozer"], pos + neg[:3])
    solved = np.linalg.lstsq(tox.kernel(pos + neg, pos + neg[:3]), margins - bias, rcond=None)[0]
    assert np.allclose(k @ solved + bias, tox.Model(weights, bias, np.ones(3), 0.0).margins(["idxiot", "loozer"]))


def make(n=500, seed=1):
    rnd = random.Random(seed)
    clean = ["the", "and", "of", "thinner", "garden", "window", "table", "silver", "morning", "river", "idea", "stone"]
    bad = ["idiot", "moron", "scumbag", "pathetic"]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(clean) for _ in range(rnd.randint(3, 60))]
        t = int(rnd.random() < 0.25)
        if t:
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, t))
    return docs, labels


def test_learns_and_tolerates_gaps_and_inserted_characters(spark):
    docs, labels = make()
    odd = [(1000, "the id-iot of the river"), (1001, "a stone i d i o t and"), (1002, "the idxiot window"),
           (1003, "the garden of silver"), (1004, None), (1005, ""), (1006, "12 34 !!"), (1003, "the garden of silver"),
           (None, "PATHETIC table"), (1007, "river " * 20000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs + odd], "doc_id long, text string, score int, toxic string")
    lab = spark.createDataFrame(labels + [(1, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    rows = tox.toxicity(df, lab).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = dict(labels)
    right = [r.predicted == truth[r.doc_id] for r in rows if r.doc_id in truth and r.held_out]
    assert sum(right) >= 0.97 * len(right) > 50
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.predicted)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert [by[k] for k in (1000, 1001, 1002, None)] == [[1]] * 4
    assert [by[k] for k in (1003, 1004, 1005, 1006, 1007)] == [[0, 0], [0], [0], [0], [0]]


def test_empty_tables_and_no_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in tox.toxicity(df, none).collect()] == [0, 0]
    assert tox.toxicity(df.limit(0), none).count() == 0


def test_query_holds_out_a_fold(spark, sf):
    from tessera.llm.queries import QUERIES
    import zlib

    rows = QUERIES["op3_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
