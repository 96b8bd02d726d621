import random

import numpy as np

from tessera.llm import tiling


def brute_tiles(doc, item, least):
    """Greedy string tiling by comparing every pair of places."""
    dm, im, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and not dm[p + n] and not im[q + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            dm[best[0] + k] = im[best[1] + k] = True


def test_tiles_equal_brute_force():
    rnd = random.Random(1)
    for trial in range(60):
        vocab = [f"w{i}" for i in range(rnd.choice([3, 8, 40]))]
        item = [rnd.choice(vocab) for _ in range(rnd.randint(4, 18))]
        doc = [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))]
        for _ in range(2):
            a = rnd.randrange(len(item))
            doc[rnd.randint(0, len(doc)):0] = item[a:a + rnd.randint(2, 12)]
        bench = tiling.Benchmark([(1, " ".join(item))], 3)
        _, p, q = bench.seeds(bench.numbers(" ".join(doc)))
        assert tiling.tile(p, q, 3) == brute_tiles(doc, item, 3)


def cases():
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    w = item.split()
    noise = "one two three four five six"
    docs = [
        (1, f"{noise} {item} {noise}", True),
        (2, f"{noise} {' '.join(w[8:])} {noise} {' '.join(w[:8])}", True),  # reordered halves
        (3, f"{noise}, {item.upper().replace(' ', ', ')}! {noise}", True),  # case and marks
        (4, " ".join(w[:8]) + " " + noise, False),  # half of the item
        (5, noise * 30, False), (6, None, False), (7, "", False), (8, " ".join(reversed(w)), False),
        (9, "filler " * 30000 + item, True), (10, item, True), (10, item, True), (None, item, True),
    ]
    return docs, [(100, item), (101, "too short"), (102, None), (103, ""), (100, item)]


def test_catches_reordered_passages_and_leaves_clean_documents(spark, monkeypatch):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in docs], "doc_id long, text string, item_id int, tiles string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([i for i, _, bad in docs if bad for _ in range(2)], key=repr)
    for size in (tiling.BLOCK_BYTES, 100):
        monkeypatch.setattr(tiling, "BLOCK_BYTES", size)
        found = tiling.contaminated(df, bench).collect()
        assert sorted([r.doc_id for r in found], key=repr) == want and {r.item_id for r in found} == {100}
        assert all(r.coverage == sum(t.words for t in r.tiles) / 16 >= 0.7 for r in found)
        kept = tiling.drop_contaminated(df, bench)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, bad in docs if not bad]
    assert tiling.contaminated(df.limit(0), bench).count() == 0
    assert tiling.contaminated(df, bench.limit(0)).count() == 0
    assert tiling.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_query_against_brute_force(spark, sf):
    from tessera.llm.queries import QUERIES

    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, tiling.words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for d in docs:
        words = tiling.words_of(d.text or "")
        grams = {tuple(words[k:k + 4]) for k in range(len(words))}
        for i, item in items:
            if sum(tuple(item[k:k + 4]) in grams for k in range(len(item) - 3)) * 4 < 0.7 * len(item):
                continue  # that few seeds cannot cover enough
            at = [k for k in range(len(words)) if words[k] in set(item)]
            near = words[max(0, at[0] - 1):at[-1] + 2]
            if len(near) < 3000 and sum(t[2] for t in brute_tiles(near, item, 4)) >= 0.7 * len(item):
                want.add((d.doc_id, i))
            elif len(near) >= 3000:
                want |= {(d.doc_id, i)} & got
    assert got == want


def test_whole_items_equal_greedy_tiles():
    rnd = random.Random(4)
    for trial in range(200):
        vocab = [f"w{i}" for i in range(rnd.choice([1, 2, 3, 20]))]
        items = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 12))) for _ in range(3)]
        doc = [rnd.choice(vocab) for _ in range(rnd.randint(0, 25))]
        if trial % 2:
            doc[len(doc) // 2:0] = items[0].split()
        bench = tiling.Benchmark(list(enumerate(items)), 3)
        want = []
        for i, item in enumerate(items):
            tiles = brute_tiles(doc, item.split(), 3)
            if sum(t[2] for t in tiles) >= 0.7 * len(item.split()):
                want.append((i, tiles))
        assert tiling.covered(bench, " ".join(doc), 0.7) == want


def test_short_items_are_found_whole():
    bench = tiling.Benchmark([(1, "What is pi"), (2, "pi"), (3, "..."), (4, "is what")], 4)
    assert tiling.covered(bench, "So, what is PI?", 0.7) == [(0, [(1, 0, 3)]), (1, [(3, 0, 1)])]
    assert tiling.covered(bench, "what pi", 0.7) == [(1, [(1, 0, 1)])] and tiling.covered(bench, "", 0.7) == []


def test_repetitive_texts_take_no_time_of_their_square():
    import time

    bench = tiling.Benchmark([(1, "no " * 300)], 4)
    begin = time.process_time()
    assert tiling.covered(bench, "no " * 32000, 0.7) == [(0, [(0, 0, 300)])]
    assert time.process_time() - begin < 1
    assert tiling.covered(bench, ("no " * 250 + "yes ") * 40, 0.7) == [(0, [(0, 0, 250), (251, 250, 50)])]
