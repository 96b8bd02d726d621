import random
import re
from itertools import permutations

import numpy as np
import pytest

from tessera.llm import filter_audit


def mask_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return ((len(w) < 100) + 2 * (100 * len(set(w)) < 80 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
            + 8 * bool(re.search("[#$%&*|]", text)))


def flags(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    return [(i, p or "", mask_of(t or "") + 16 * (i is not None and i > first[t or ""])) for i, t, p in rows]


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    each, out = flags(rows), []
    for part in {p for _, p, _ in each}:
        mine = [(i, m) for i, p, m in each if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            before = 0
            for step, letter in enumerate(order, 1):
                own = 1 << "ABCDE".index(letter)
                here = [i for i, m in mine if not m & before and m & own]
                shapley[letter] += len(here)
                found.append((part, "".join(order), step, sum(not m & (before | own) for _, m in mine), len(here),
                              sum(bool(m & before and m & own) for _, m in mine), sum(m == own for _, m in mine),
                              sum(i in good for i in here), sum(i in toxic for i in here), letter))
                before |= own
        out += [(*f[:-1], shapley[f[-1]]) for f in found]
    return sorted(out)


def corpus():
    rnd = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "é", "日本", "x#y", "50%", *(f"w{k}" for k in range(300))]
    rows = []
    for k in range(300):
        t = " ".join(rnd.choice(words) if rnd.random() < 0.3 else f"n{rnd.randrange(10 ** 6)}" for _ in range(rnd.choice((5, 99, 100, 130))))
        rows.append((k, t, rnd.choice(["en", "de", None, ""])))
    rows += [(1000 + k, rows[k % 7][1], rnd.choice(["en", "fr"])) for k in range(120)]      # copies
    rows += [(2000 + k, "one hot text", "en") for k in range(200)]
    rows += [(500, None, "en"), (501, "", "en"), (502, " \t\n", None), (503, "A" * 10 + "b" * 90, "en"), (504, "A" * 11 + "b" * 89, "en"),
             (505, " ".join(["w"] * 120), "en"), (None, "one hot text", "en"), (None, "only null ids", "en"), (None, "only null ids", "de"),
             (2000, "one hot text", "en"), (1, "one hot text", "de"), (506, "z " * 50000 + "|", "en")]
    rnd.shuffle(rows)
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for k in range(0, 1100, 3)] + [(2000, 1, 0), (2000, 0, 1), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("parts", [1, 13])
def test_audit_equals_brute_force(spark, parts):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, mask int").repartition(parts)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    assert sorted((r["doc_id"] is None, r["doc_id"], r["part"], r["mask"]) for r in filter_audit.flag_documents(docs).collect()) == sorted(
        (i is None, i, p, m) for i, p, m in flags(rows))
    assert sorted(tuple(r) for r in filter_audit.audit(docs, marks).collect()) == brute(rows, labels)


def test_the_sketch_clears_unique_texts_only(spark, monkeypatch):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    want = filter_audit.flag_documents(docs).collect()
    from tessera.llm import exchange

    sent = {}
    monkeypatch.setattr(filter_audit, "cut", lambda df, name: sent.setdefault(name, exchange.cut(df, name)))
    got = filter_audit.flag_documents(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    facts = sent["audit-facts"]
    # the sketch clears unique texts, and never one that repeats
    texts = [t or "" for _, t, _ in rows]
    repeated = sum(texts.count(t) > 1 for t in texts)
    assert repeated <= facts.where("possible").count() <= repeated + 0.05 * len(rows)
    # whole texts are carried once per chunk
    assert facts.where("text = 'one hot text'").count() <= 5


def test_sketch_collisions_only_add_candidates():
    rng = np.random.default_rng(0)
    h1, h2 = (rng.integers(-2 ** 63, 2 ** 63, 50, dtype=np.int64) for _ in range(2))
    h1[40:], h2[40:] = h1[:10], h2[:10]
    slots = filter_audit._Slots(h1, h2, 3)
    more = (slots.count > 1)[slots.at].all(axis=0)
    assert more[:10].all() and more[40:].all() and not more[10:40].any()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a", None)], docs.schema)
    got = filter_audit.audit(one, labels).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""} and sum(r["removed"] for r in got) == 120
