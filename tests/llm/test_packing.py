import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(packing.default_tokenizer())


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def corpus():
    rnd = random.Random(5)
    vocab = ["the", "River's", "isn't", "Straße", "éa", "ΟΔΟΣ", "42nd", "<|endoftext|>", "a b", "x\x1cy", "!?", "ﬁ"]
    rows = [(i, rnd.choice([" ", "\n\n", "\t"]).join(rnd.choices(vocab, k=rnd.randint(0, 200)))) for i in range(90)]
    rows += [(200 + i, "copy of the same text " * 30) for i in range(40)]
    return rows + [(300, None), (301, ""), (302, " \n"), (400, "twice"), (400, "twice"), (None, "no id"), (303, "long " * 9000)]


def check(rows, want, window=2048):
    """Every id in exactly one piece, sequences gapless and full or a power of two long."""
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or at & (at - 1) == 0
    assert set(docs) == set(want)
    for i, ids in want.items():
        at = defaultdict(int)
        for r in docs[i]:
            assert r.doc_tokens == len(ids)
            part = np.array(ids[r.start:r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at[r.start] += r.length
        copies = sum(r.length for r in docs[i]) // len(ids)
        assert sum(r.length for r in docs[i]) == copies * len(ids)


def test_word_cache_equals_whole_texts(tokenizer):
    texts = [t or "" for _, t in corpus()]
    enc = packing.Encoder(packing.default_tokenizer())
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    for _ in range(2):  # the second time all words are known
        assert [x.tolist() for x in enc(data, off)] == [whole(tokenizer, t) for t in texts]


def test_exact_round_trip(spark, tokenizer):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, key string").repartition(3)
    got = packing.pack_pieces(df).collect()
    check(got, {i: whole(tokenizer, t) for i, t in rows})
    assert sum(r.length for r in got) == sum(len(whole(tokenizer, t)) for _, t in rows)
    small = packing.pack(df, shard_tokens=3000).collect()
    assert sum(r.length for r in small) == sum(r.length for r in got)
    assert packing.pack_pieces(df.limit(0)).count() == 0


def test_neighbours_come_by_bm25():
    a, b = np.arange(100, 140), np.arange(500, 540)
    docs = [a, b, np.r_[a, 7], np.r_[b, 9], np.r_[a[:30], 8], b]
    order = [p[0] for p in sorted(packing.fill(docs, 1 << 20), key=lambda p: (p[3], p[4]))]
    assert order[0] == 0 and set(order[:3]) == {0, 2, 4}
    index = packing.Index(docs)
    df = {t: sum(t in d for d in docs) for d in docs for t in d.tolist()}
    mean = np.mean([len(d) for d in docs])
    for i, d in enumerate(docs):
        want = 0.0
        for t in set(docs[0].tolist()) & set(d.tolist()):
            tf, idf = (d == t).sum(), np.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5))
            want += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        assert index.scores(0)[i] == pytest.approx(want)


def test_postings_of_used_documents_go_without_effect_on_the_rest():
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 90, rng.integers(1, 60)) for _ in range(50)]
    index, less, held = packing.Index(docs), packing.Index(docs), np.ones(50, bool)
    for gone in rng.permutation(50).reshape(5, 10):
        held[gone] = False
        less.keep(held)
        for seed in range(50):
            assert less.scores(seed).tolist() == np.where(held, index.scores(seed), 0).tolist()


def test_neighbours_without_a_common_min_hash_meet_in_a_million_ids(spark, tokenizer):
    rng = np.random.default_rng(11)
    words = [w for w in sorted(tokenizer.get_vocab()) if w.isascii() and w.isalpha() and w.islower()]
    words = [w for w in words if len(tokenizer.encode(w, add_special_tokens=False).ids) == 1]
    rows = []
    for i in range(200):  # two documents of the same 50 words, in orders with few common triples
        shared = words[50 * i:50 * i + 50]
        rows += [(2 * i + side, " ".join(rng.permutation(shared * 36))) for side in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(df).collect()
    total = sum(r.length for r in pieces)
    assert 1 << 19 < total < 1 << 20
    shard = {}
    for r in pieces:
        shard.setdefault(r.doc_id, set()).add(r.sequence_id >> 40)
    assert all(shard[2 * i] == shard[2 * i + 1] for i in range(200))


def test_query_on_whole_table(spark, sf, tokenizer):
    from tessera.llm.queries import QUERIES

    got = QUERIES["op9_packing"](spark, sf).collect()
    src = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(got, {r.doc_id: whole(tokenizer, r.text) for r in src})


def test_min_hashes_of_many_texts_at_once():
    from tessera.llm.common import mix64
    from tessera.llm.packing import _minhashes

    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 49000, n).astype("<u2") for n in (5, 1, 2, 3, 700, 1, 4, 2, 3)]

    def one(ids):
        x = ids.astype(np.uint64)
        grams = x[:-2] << np.uint64(40) | x[1:-1] << np.uint64(20) | x[2:] if len(x) > 2 else x
        return int(mix64(grams).min() >> np.uint64(1))

    for some in (texts, texts[1:3], texts[3:4], texts[::-1]):
        got = _minhashes(np.concatenate(some), np.array([len(t) for t in some]))
        assert got.tolist() == [one(t) for t in some]
