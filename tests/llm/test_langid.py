import random
import zlib

import numpy as np

from tessera.llm import langid


def brute_vector(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    out = np.zeros(langid.DIM)
    for word in low.split():
        w = f" {word} "
        for i in range(len(w) - 2):
            v = np.ones(langid.DIM)
            for k in range(3):
                v = v * np.roll(langid.letter_vectors(np.array([ord(w[i + k])]))[0], 2 - k)
            out += v
    return out


def test_counts_times_bound_vectors_equal_the_bundle():
    texts = ["Hello, World 42 abc", "", "x", "ÄÖ ß naïve\nline\r\nwo-rd", "1 2 3", "a b", "日本語 текст"]
    (s, e, counts, grams), = langid.profile_counts(texts)
    got = counts @ langid.gram_vectors(grams).astype(float)
    assert np.allclose(got, np.array([brute_vector(t) for t in texts]))


def test_long_texts_in_pieces_equal_the_whole(monkeypatch):
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(400))
    whole = brute_vector(text)
    monkeypatch.setattr(langid, "CHUNK_CHARS", 97)
    total = np.zeros(langid.DIM)
    for _, _, counts, grams in langid.profile_counts([text]):
        total += (counts @ langid.gram_vectors(grams).astype(float))[0]
    assert np.allclose(total, whole)


def corpus():
    rnd = random.Random(3)
    parts = {"aa": ["the", "ing", "and", "er"], "bb": ["que", "cion", "el", "os"], "cc": ["sch", "ung", "ein", "ö"]}
    return [(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3)))
                         for _ in range(rnd.randint(3, 40))), lang)
            for i in range(300) for lang in [rnd.choice("aa bb cc".split())]]


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus()
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !", "cc"), (None, "the and ing", None), (5, "THE AND", "aa")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd],
                               "doc_id long, text string, lang string, lang_pred string, score int")
    got = langid.identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held if r.doc_id != 5]) > 0.97
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0) and by[None][0] == "aa"
    assert all(0 <= r.score <= 1 for r in got)


def test_equals_brute_cosine_and_blocks(spark, monkeypatch):
    rows = corpus()[:80]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    protos = langid.prototypes(df)
    vec = {}
    for _, text, lang in rows:
        (_, _, counts, grams), = langid.profile_counts([text])
        unit = np.rint(counts * (langid.UNIT / np.sqrt((counts ** 2).sum())))
        vec[lang] = vec.get(lang, 0) + (unit.astype(float) @ langid.gram_vectors(grams).astype(float))[0]
    assert all(np.allclose(r.vec, vec[r.lang]) for r in protos.collect())
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    want = [max((cos(brute_vector(t), vec[k]), k) for k in vec) for _, t, _ in rows]
    got = sorted(langid.predict(df, protos).collect())
    assert [r.lang_pred for r in got] == [k for _, k in want]
    assert np.allclose([r.score for r in got], [max(0, c) for c, _ in want], atol=1e-5)
    monkeypatch.setattr(langid, "BLOCK_LANGS", 2)
    again = sorted(langid.predict(df, protos).collect())
    assert [(r.lang_pred, round(r.score, 5)) for r in again] == [(r.lang_pred, round(r.score, 5)) for r in got]


def test_nothing_learnt_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).count() == 0
