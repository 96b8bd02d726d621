import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import suffix_trees


def brute(rows, length):
    order = [(i if i is not None else suffix_trees.NO_ID, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = {}
    for i, w in order:
        for p in range(len(w) - length + 1):
            g = tuple(w[p:p + length])
            seen[g] = min(seen.get(g, i), i)
    out = []
    for (i, w), (raw, _) in zip(order, rows):
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p:p + length])] < i:
                gone[p:p + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((raw, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "the", "The", "é", "日本", "x" * 40, *(f"w{k}" for k in range(60))]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared = [text(rnd.randint(10, 60)) for _ in range(8)]
    blank = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c "]
    rows = []
    for _ in range(150):
        w = text(rnd.randint(0, 40))
        for _ in range(rnd.randint(0, 3)):
            s = list(rnd.choice(shared))
            s = s[rnd.randint(0, len(s) // 2):]
            if rnd.random() < 0.4:
                s[rnd.randrange(len(s))] = "changed"
            at = rnd.randint(0, len(w))
            w[at:at] = s
        rows.append((rnd.randint(-5, 10 ** 6), "".join(x + rnd.choice(blank) for x in w)))
    hot = " ".join(shared[0] + shared[1])
    rows += [(5000 + k, f"{k} {hot} {k}") for k in range(60)]
    rows += [(400, None), (401, ""), (402, " \t "), (403, "x " * 12), (404, "x " * 13), (405, "x " * 700), (406, "x " * 650),
             (407, "u v " * 300), (408, "v u " * 200), (None, hot), (None, hot), (5001, f"1 {hot} 1"),
             (409, "no break space " * 20), (410, "no break space " * 15)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, owner string")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("group_runs", [suffix_trees.GROUP_RUNS, 2])
@pytest.mark.parametrize("parts", [2, 17])
def test_digests_equal_brute_force(spark, parts, group_runs):
    rows = corpus(parts)
    df = frame(spark, rows).repartition(parts)
    assert rows_of(suffix_trees.dedup_digests(df, group_runs=group_runs)) == brute(rows, 13)


def test_other_lengths_and_prefixes(spark):
    rows = corpus(3)
    df = frame(spark, rows).repartition(5)
    for length, prefix in ((5, 5), (7, 1), (30, 4)):
        assert rows_of(suffix_trees.dedup_digests(df, length=length, prefix=prefix, group_runs=5)) == brute(rows, length)


def test_slices_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = np.frombuffer(" ".join(rng.choice(["ab", "cde", "f", "g" * 50], 4000)).encode(), np.uint8)
    off = np.array([0, 300, 300, 5000, len(data)])
    hashes, text = suffix_trees.word_spans(data, off)
    monkeypatch.setattr(suffix_trees, "SLICE", 64)
    again, same = suffix_trees.word_spans(data, off)
    # hashes depend on the word alone, so slices give the same ones
    assert np.array_equal(text, same) and np.array_equal(hashes, again)
    whole = suffix_trees.prefix_runs(hashes, text, 13, 4)
    monkeypatch.setattr(suffix_trees, "WORDS", 100)
    suffix_trees._powers.cache_clear()
    parts = suffix_trees.prefix_runs(hashes, text, 13, 4)
    suffix_trees._powers.cache_clear()
    windows = [sorted((s, h) for f, z, h in zip(*r[:3]) for s in range(f, z + 1)) for r in (whole, parts)]
    assert windows[0] == windows[1]


def test_deep_nodes_are_equal_prefixes():
    rng = np.random.default_rng(2)
    for top in (3, 1 << 22):
        words = rng.integers(0, top, 400).astype(np.int64)
        words[200:300] = words[50:150]
        start = np.arange(400 - 13 + 1)
        order, node = suffix_trees.deep_nodes(words, start, 13)
        sorted_runs = [tuple(words[s:s + 13]) for s in start[order]]
        assert sorted_runs == sorted(sorted_runs)
        assert [a == b for a, b in zip(sorted_runs, sorted_runs[1:])] == (np.diff(node) == 0).tolist()


def test_texts_keep_other_columns_and_untouched_white_space(spark):
    hot = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"a\tb {hot}", 7), (2, f"c {hot}  d", 8), (3, None, 9), (4, "  plain \n text ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, owner int")
    got = {r["doc_id"]: (r["text"], r["owner"]) for r in suffix_trees.dedup_words(df).collect()}
    assert got == {1: (f"a\tb {hot}", 7), 2: ("c d", 8), 3: (None, 9), 4: ("  plain \n text ", None)}
    assert suffix_trees.dedup_words(df).columns == df.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_trees.dedup_digests(df).collect() == []
    assert suffix_trees.dedup_words(df).collect() == []
