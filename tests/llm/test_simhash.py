"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.common import forest


def brute_fp(text):
    b = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words, cur = [], b""
    for c in low + b" ":
        if c == 32 or 9 <= c <= 13:
            if cur:
                words.append(cur)
            cur = b""
        else:
            cur += bytes([c])
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_groups(rows, radius=2):
    fps = [brute_fp(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                group[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], fps[i], min(ids) if ids else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()), key=repr)


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    rows = []
    for i in range(160):
        t = rnd.choice(base).split()
        if rnd.random() < 0.6:
            t[rnd.randrange(len(t))] = "Edit"
        rows.append((i * 3 % 161, " \t".join(t)))
    return rows + [(500, None), (501, ""), (502, " \n "), (7, "one"), (7, "one"), (None, "one"), (503, "x " * 5000),
                   (504, "ÄBÇ d e f")]


def test_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(simhash.simhash_groups(df, tile=3)) == brute_groups(rows)


def test_extra_columns_with_clashing_names_and_empty_table(spark):
    rows = [(1, "a b c d", 5, "x"), (2, "a b c d", 6, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")
    assert [r[2] for r in rows_of(simhash.simhash_groups(df))] == [1, 1]
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_rows_of_one_id_in_two_groups_are_kept_in_both(spark):
    rows = [(1, "a b c d e f g h", "x"), (1, "k l m n o p q r", "y"), (2, "k l m n o p q r", "z"), (3, "a b c d e f g h", "w"),
            (1, "a b c d e f g h", "v"), (4, "s t u v w x y z", "u"), (None, "a b c d e f g h", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.keep_one_per_group(df).collect()), key=repr)
    assert got == sorted([rows[1], rows[4], rows[5], rows[6]], key=repr)


def test_bit_slices_find_every_pair_within_any_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 6, dtype=np.uint64)
    words = np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))
                      for b in base for _ in range(23)], np.uint64)
    for radius in range(4):
        a, b = simhash.BitSlices(words).within(words[:50], radius)
        want = {(i, j) for i in range(50) for j in range(len(words))
                if bin(int(words[i]) ^ int(words[j])).count("1") <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want


def test_links_of_a_hot_bucket_span_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2 ** 62))
    words = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (120, 2))})
    df = spark.createDataFrame([(w,) for w in words], "fp long")
    got = simhash.links(df, tile=8).collect()
    at = {w: i for i, w in enumerate(words)}
    label = forest(np.array([at[r.u] for r in got]), np.array([at[r.v] for r in got]), len(words))
    pairs = [(i, j) for i in range(len(words)) for j in range(i) if bin(words[i] ^ words[j]).count("1") <= 2]
    want = forest(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), len(words))
    assert label.tolist() == want.tolist()
    u, v = simhash._tile_links(np.array(words, np.uint64), None, 2)
    assert len(u) < len(words) <= len(pairs)
