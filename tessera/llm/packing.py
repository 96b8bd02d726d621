"""Lexical retrieval packing: documents fill windows next to their BM25 neighbours.

Texts become ids of a public tokenizer, one end id after each. Documents are dealt
into shards by a range exchange on a min-hash of their id triples, so documents that
share wording meet in a shard; the id of a document breaks ties, so a group of
copies spreads over as many shards as it fills. A task reads its range in order and
closes a shard at ``SHARD_TOKENS`` ids, so memory does not depend on the range.

Every shard has an inverted index with BM25 weights per posting. The first unused
document seeds a window; the unused documents that score best against the seed
fill it, and the one that crosses its end is cut there and seeds the next. Only a
shard's last window may stay short: it is cut into lengths that are powers of two,
which need no padding.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept, mix64, utf8_column
from .tokens import LOWER, chunks, hash_spans, words

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1 << 20
CACHE_WORDS = 2_200_000  # about 60 MB
K1, B = 1.2, 0.75


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTable:
    """Ids of words by 64-bit hash: sorted hashes with the place and number of their ids.

    Arrays take about 25 bytes a word. New words go to a small second part, which is
    merged into the first when it has grown.
    """

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.parts = [none, none]
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, number)`` of each word's ids; -1 ids for an unknown word."""
        place, number = np.zeros(len(key), np.int64), np.full(len(key), -1, np.int64)
        for keys, places, numbers in self.parts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                place[hit], number[hit] = places[at[hit]], numbers[at[hit]]
        return place, number

    def add(self, key: np.ndarray, ids: list[np.ndarray]) -> None:
        number = np.array([len(x) for x in ids], np.int32)
        total = int(number.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        if total:
            self.ids[self.used:self.used + total] = np.concatenate(ids)
        new = (key, self.used + np.cumsum(number) - number, number)
        self.used += total
        self.parts[1] = self._merged(self.parts[1], new)
        if len(self.parts[1][0]) > max(100_000, len(self.parts[0][0]) // 8):
            self.parts = [self._merged(*self.parts), (key[:0], new[1][:0], number[:0])]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)

    def gather(self, place: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The ids of words end to end."""
        return self.ids[np.repeat(place - (np.cumsum(number) - number), number) + np.arange(number.sum())]


class Encoder:
    """Ids of UTF-8 texts; words between ASCII white space are encoded once and kept.

    The tokenizer drops white space and none of its steps looks across it, so the
    ids of a text are those of its words end to end. It folds case itself, so words are
    told apart by the hash of their bytes with A-Z folded; a text that may hold special
    tokens, which are found before that, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.table = WordTable(self.dtype)
        self.marks = {m: self._encode([m.decode()])[0] for m in (b".", b",", b";", b":", b"!", b"?")}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Adds new words; the letters before a final mark are looked up, or learnt, on their own."""
        words = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())]
        marked = np.array([len(w) > 1 and w[-1:] in self.marks and w[:-1].isalpha() for w in words], bool)
        core = np.where(marked, hash_spans(LOWER[data], start, end - marked), key)
        every, first = np.unique(core, return_index=True)
        unknown = np.nonzero(self.table.find(every)[1] < 0)[0]
        for s in range(0, len(unknown), 4096):
            part = unknown[s:s + 4096]
            texts = [(words[i][:-1] if marked[i] else words[i]).decode("utf-8", "replace") for i in first[part].tolist()]
            self.table.add(every[part], self._encode(texts))
        some = np.nonzero(marked)[0]
        if len(some):
            place, number = self.table.find(core[some])
            whole = [np.concatenate([self.table.ids[p:p + n], self.marks[words[i][-1:]]])
                     for i, p, n in zip(some.tolist(), place.tolist(), number.tolist())]
            self.table.add(key[some], whole)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids of each text that lies in ``data``, the end id after them."""
        if len(self.table) > CACHE_WORDS:
            self.table.clear()
        h, start, end, text = words(data, off)
        key, first, at = np.unique(h, return_index=True, return_inverse=True)
        place, number = self.table.find(key)
        new = np.nonzero(number < 0)[0]
        if len(new):
            self._learn(data, key[new], start[first[new]], end[first[new]])
            place, number = self.table.find(key)
        size = number[at]
        ids = self.table.gather(place[at], size)
        edge = np.r_[0, np.cumsum(np.bincount(text, size, minlength=len(off) - 1).astype(np.int64))]
        last = np.array([END_ID], self.dtype)
        out = [np.concatenate([ids[a:b], last]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        if b"<|" in data.tobytes():
            for i in range(len(off) - 1):
                raw = data[off[i]:off[i + 1]].tobytes()
                if b"<|" in raw:
                    out[i] = np.concatenate([self._encode([raw.decode("utf-8", "replace")])[0], last])
        return out


def encoder(path: str) -> Encoder:
    """One per worker process, so its words live on from task to task of one stage."""
    return kept(("encoder", path), lambda: Encoder(path))


def _minhashes(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per text the smallest hash of three neighbouring ids (fewer: of all), not negative; texts lie end to end."""
    x, first = flat.astype(np.uint64), np.cumsum(size) - size
    out = np.zeros(len(size), np.uint64)
    some = np.nonzero(size > 2)[0]
    if len(some):
        grams = mix64(x[:-2] << np.uint64(40) | x[1:-1] << np.uint64(20) | x[2:])
        edge = np.column_stack([first[some], first[some] + size[some] - 2]).ravel()
        out[some] = np.minimum.reduceat(np.r_[grams, np.uint64(0)], edge)[::2]   # every other run crosses texts
    for k in np.nonzero(size <= 2)[0].tolist():
        out[k] = mix64(x[first[k]:first[k] + size[k]]).min()
    return (out >> np.uint64(1)).astype(np.int64)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, n, ids binary)``: a document's ids with the end id, little-endian, and its min-hash."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for s, e, data, off in chunks(*utf8_column(b, "text")):
                ids = enc(data, off)
                size, flat = np.array([len(x) for x in ids], np.int64), np.concatenate(ids)
                edge = np.r_[0, np.cumsum(size * flat.itemsize)].astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(edge), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s, e - s), pa.array(_minhashes(flat, size), pa.int64()), pa.array(size, pa.int64()), packed],
                    ["doc_id", "key", "n", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, key long, n long, ids binary")


class Index:
    """Inverted index of a shard: per term, its documents and their BM25 weights."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        size = np.array([len(d) for d in docs], np.float64)
        uniq = [np.unique(d, return_counts=True) for d in docs]
        self.terms_of = [u[0] for u in uniq]
        term = np.concatenate(self.terms_of)
        tf = np.concatenate([u[1] for u in uniq]).astype(np.float64)
        doc = np.repeat(np.arange(n), [len(u[0]) for u in uniq])
        order = np.argsort(term, kind="stable")
        term, tf, self.doc = term[order], tf[order], doc[order]
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.first, self.left = first, df
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size[self.doc] / size.mean())
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm)
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard against the seed's distinct terms."""
        at = np.searchsorted(self.terms, self.terms_of[seed])
        size = self.left[at]
        # the places of these terms' postings, list after list
        posting = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.doc[posting], self.weight[posting], minlength=self.n)

    def keep(self, docs: np.ndarray) -> None:
        """Leaves only the postings of the marked documents, with their weights; the others score 0."""
        held = docs[self.doc]
        before = np.r_[0, np.cumsum(held)]
        self.first, self.left = before[self.first], before[self.first + self.left] - before[self.first]
        self.doc, self.weight = self.doc[held], self.weight[held]


def fill(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` for every piece of a shard's documents."""
    index = Index(docs)
    unused = np.ones(len(docs), bool)
    out: list[tuple[int, int, int, int, int]] = []
    sequence, room = 0, window
    ranked: list[int] = []
    held = len(docs)  # documents whose postings are in the index
    later = 0  # no document before this one is unused

    def place(doc: int) -> bool:
        """Appends a document; True if it crosses or meets the end of a window (and seeds the next)."""
        nonlocal sequence, room
        unused[doc] = False
        at, crossed = 0, False
        while at < len(docs[doc]):
            take = min(room, len(docs[doc]) - at)
            out.append((doc, at, take, sequence, window - room))
            at, room = at + take, room - take
            if room == 0:
                sequence, room, crossed = sequence + 1, window, True
        return crossed

    seed = None
    while True:
        if seed is None:
            while later < len(docs) and not unused[later]:
                later += 1
            if later == len(docs):
                break
            seed = later
            place(seed)
            ranked = []
        if not ranked:
            if unused.sum() < 0.8 * held:
                index.keep(unused)
                held = unused.sum()
            score = np.where(unused, index.scores(seed), -1.0)
            some = min(len(docs), 64)
            best = np.argpartition(-score, some - 1)[:some]
            best = best[np.lexsort((best, -score[best]))]
            ranked = [int(i) for i in best[score[best] >= 0]][::-1]
            if not ranked:
                break
        nearest = ranked.pop()
        if place(nearest):
            seed, ranked = nearest, []
    return _powers_of_two(out, sequence, window - room)


def _powers_of_two(pieces: list, sequence: int, used: int) -> list:
    """The pieces with the last, short sequence cut into lengths that are powers of two."""
    if used == 0:
        return pieces
    ends = np.cumsum([1 << k for k in range(used.bit_length() - 1, -1, -1) if used >> k & 1])
    out = []
    for doc, start, length, seq, offset in pieces:
        while seq == sequence and length:
            k = int(np.searchsorted(ends, offset, side="right"))
            take = min(length, int(ends[k]) - offset)
            out.append((doc, start, take, sequence + k, offset - (int(ends[k - 1]) if k else 0)))
            start, length, offset = start + take, length - take, offset + take
        if seq != sequence:
            out.append((doc, start, length, seq, offset))
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: one row per piece.

    ``ids``: the piece's ids as little-endian unsigned 32-bit integers. Every id of
    every document (its end id included) lies in exactly one piece; sequences hold
    ``window`` ids or a power of two. Null and empty texts are one end id; repeated
    rows and rows with a null id are documents like any other. Other columns are
    ignored; an empty table gives an empty result.
    """
    path = tokenizer or default_tokenizer()
    encoded = cut(encode(docs, path, id_col, text_col), "pack-ids")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // shard_tokens))

    def run(batches):
        base, local = TaskContext.get().partitionId() << 40, 0
        held, size, width = [], 0, None

        def out():
            nonlocal local
            texts = [np.frombuffer(ids, width) for _, ids in held]
            pieces = fill(texts, window)
            for s in range(0, len(pieces), 4096):
                part = pieces[s:s + 4096]
                yield pa.RecordBatch.from_arrays([
                    pa.array([held[p[0]][0] for p in part], pa.int64()),
                    pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                    pa.array([texts[p[0]][p[1]:p[1] + p[2]].astype("<u4").tobytes() for p in part], pa.binary()),
                    pa.array([len(texts[p[0]]) for p in part], pa.int64()),
                    pa.array([base + local + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            local += max(p[3] for p in pieces) + 1

        for b in batches:
            for i, n, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2))):
                width = np.dtype(f"<u{len(ids) // n}")
                held.append((i, ids))
                size += n
                if size >= shard_tokens:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    near = encoded.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id", "n")
    return near.select("doc_id", "n", "ids").mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces of ``pack`` with a checksum in place of the ids."""
    return pack(docs, tokenizer).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
