import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import exchange, suffix_dedup, windows


def brute(rows, length=50):
    seen = {}
    order = [(i if i is not None else suffix_dedup.NO_ID, (t or "").encode()) for i, t in rows]
    for i, b in order:
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            seen[w] = min(seen.get(w, i), i)
    out = []
    for (i, b), (raw, _) in zip(order, rows):
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] < i:
                gone[p:p + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((raw, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefé") for _ in range(rnd.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rnd.randint(12, 40)) for _ in range(8)]
    rows = []
    for i in range(120):
        t = text(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 3)
            s = s[a:a + rnd.randint(40, 200)]
            if rnd.random() < 0.4 and s:
                k = rnd.randrange(len(s))
                s = s[:k] + "#" + s[k + 1:]
            at = rnd.randint(0, len(t))
            t = t[:at] + s + t[at:]
        rows.append((rnd.randint(-5, 10 ** 6), t))
    rows += [(300 + i, "copy " + shared[0]) for i in range(12)]
    rows += [(400, None), (401, ""), (402, "x" * 49), (403, "x" * 50), (404, "x" * 51), (405, "y" * 700), (406, "y" * 650),
             (407, "ab" * 300), (408, "ba" * 200), (None, shared[1]), (None, shared[1]), (300, "copy " + shared[0])]
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [2, 23])
def test_digests_equal_brute_force(spark, parts):
    rows = corpus(parts)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, blob string")
    assert rows_of(suffix_dedup.dedup_digests(df.repartition(parts))) == brute(rows)


def test_slices_of_a_long_text_lose_no_window(monkeypatch):
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 100, 5000).astype(np.uint8)
    off = np.array([0, 30, 30, 4000, 4060, 5000])
    want = {(p, t) for t in range(5) for p in range(off[t], off[t + 1] - 49)}
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    got = []
    for part, o, text, base in suffix_dedup.slices(data, off, 50):
        a = windows.anchors(part, o, 50)
        for t, f, e in zip(a.text + text, a.first + base, a.last + base):
            got += [(p, t) for p in range(f, e + 1)]
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_windows_share_an_anchor():
    rnd = random.Random(4)
    piece = "".join(rnd.choice("abc") for _ in range(120))
    texts = [("q" * k + piece + "r" * (9 - k)).encode() for k in range(9)]
    off = np.cumsum([0] + [len(t) for t in texts])
    a = windows.anchors(np.frombuffer(b"".join(texts), np.uint8), off, 50)
    run, start = a.windows(np.arange(len(a.first)))
    seen = {}
    for h, s in zip(a.hash[run].tolist(), start.tolist()):
        assert seen.setdefault(a.data[s:s + 50].tobytes(), h) == h


def test_anchors_equal_brute_force():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab") for _ in range(n)).encode() for n in (0, 49, 0, 50, 51, 10, 300, 76, 0, 2000, 3, 0)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    grams = windows.mix64(windows.hash_spans(data, np.arange(len(data) - 23), np.arange(24, len(data) + 1)))
    low = [(int(g) >> 24, p) for p, g in enumerate(grams)]
    want, before = [], None
    for t in range(len(texts)):
        for s in range(off[t], off[t + 1] - 49):
            at = min(low[s:s + 27])[1]
            if before == (t, at):
                want[-1][2] = s
            else:
                want.append([t, s, s, int(grams[at])])
            before = t, at
    a = windows.anchors(data, off, 50)
    assert [list(x) for x in zip(a.text, a.first, a.last, a.hash)] == want
    places = [min(low[s:s + 27])[1] - s for s in a.first]
    with np.errstate(over="ignore"):
        content = windows.mix64(windows.hash_spans(data, a.first, a.last + 50)
                                + np.array(places, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    assert a.content.tolist() == content.tolist()


def test_collections_hold_texts_of_like_length(monkeypatch):
    """A collection takes as many rounds as its longest text has bytes, so short texts lie apart from long ones."""
    rows = corpus(5)
    batch = pa.RecordBatch.from_pydict({"__id": [suffix_dedup.NO_ID if i is None else i for i, _ in rows],
                                        "text": pa.array([t for _, t in rows], pa.string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    c = suffix_dedup.Chunk(sink.getvalue().to_pybytes(), "text", 50)
    repeated = suffix_dedup._merge_anchors(suffix_dedup._send_anchors(c, 0, 1))
    contents = suffix_dedup._merge_contents(suffix_dedup._send_contents(c, 0, repeated, 1))
    whole = suffix_dedup._send_windows(c, 0, contents, 1)
    sizes, real = [], suffix_dedup.windows_of_pieces

    def spy(data, first, size, doc, length):
        sizes.append((int(size.min()), int(size.max())))
        return real(data, first, size, doc, length)

    monkeypatch.setattr(suffix_dedup, "windows_of_pieces", spy)
    monkeypatch.setattr(suffix_dedup, "PIECES", 16)
    assert suffix_dedup._send_windows(c, 0, contents, 1).equals(whole)
    assert len(sizes) > 2 and sizes[0][1] < sizes[-1][0]
    assert all(a[1] <= b[0] for a, b in zip(sizes, sizes[1:]))


def chunk_of(rows):
    batch = pa.RecordBatch.from_pydict({"__id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return suffix_dedup.Chunk(sink.getvalue().to_pybytes(), "text", 50)


def test_only_the_smallest_document_of_a_content_lists_windows():
    """A run that a smaller document has as a whole goes by its content's hash, also where its anchor has others."""
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdef ") for _ in range(90))
    chunks = [chunk_of([(i, passage[:60] + "1" * 30 if i == 1 else "xx" + passage)]) for i in (1, 2, 3, 4)]
    anchors = suffix_dedup._merge_anchors(pa.concat_tables([suffix_dedup._send_anchors(c, n, 1) for n, c in enumerate(chunks)]))

    def to(rows, n):
        return rows.filter(pa.array([k == n for k in rows.column("chunk").to_pylist()]))

    contents = suffix_dedup._merge_contents(pa.concat_tables(
        [suffix_dedup._send_contents(c, n, to(anchors, n), 1) for n, c in enumerate(chunks)]))
    sent = [suffix_dedup._send_windows(c, n, to(contents, n), 1) for n, c in enumerate(chunks)]
    listed = [sum(len(k) // 8 for k in t.column("keys").to_pylist()) for t in sent]
    assert listed[0] > 0 and listed[1] > 0 and listed[2:] == [0, 0]
    windows_ = suffix_dedup._merge_windows(pa.concat_tables(sent))
    gone = [int(suffix_dedup._removed(c, to(contents, n), to(windows_, n), 1).sum()) for n, c in enumerate(chunks)]
    assert gone == [r[2] for r in brute([(int(c.ids[0]), c.data.tobytes().decode()) for c in chunks])] == [0, 60, 92, 92]


def test_texts_keep_columns_and_nulls(spark):
    base = "the first sentence of fifty bytes or more, as it goes on é and on"
    rows = [(1, base, "en", 5), (2, "new " + base + " end", "fr", 6), (3, None, None, None), (4, "", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    out = suffix_dedup.dedup_texts(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: base, 2: "new  end", 3: None, 4: ""}
    assert suffix_dedup.dedup_texts(df.limit(0)).count() == 0
    assert suffix_dedup.dedup_digests(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf):
    from tessera.llm.queries import QUERIES

    src = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(QUERIES["op7_suffix_dedup"](spark, sf)) == brute([tuple(r) for r in src])


def test_numbers_travel_byte_by_byte():
    import zlib

    ids = np.array([5, -7, suffix_dedup.NO_ID, 0, -(1 << 63), 1 << 40], np.int64)
    assert exchange.from_planes(exchange.planes(ids), "<i8").tolist() == ids.tolist()
    assert exchange.from_planes(exchange.planes(ids[:0]), "<i8").tolist() == []
    key = np.sort(np.random.default_rng(2).integers(0, 1 << 56, 1400).astype(np.uint64))
    assert exchange.from_planes(exchange.planes(key), "<u8").tolist() == key.tolist()
    rows = suffix_dedup.packed_rows(0, [(0, exchange.planes(key), exchange.planes(np.arange(1400)), b"")])
    assert suffix_dedup._merge_windows(rows).num_rows == 0
    assert len(zlib.compress(exchange.planes(key), 1)) < 0.9 * key.nbytes
