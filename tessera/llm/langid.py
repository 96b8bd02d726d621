"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point and a seed.
A letter n-gram is the product (binding) of its letters' vectors, the k-th rotated
(permuted) k times; a text is the sum (bundle) of its n-grams' vectors, a language
the sum of its texts at equal weight. A text gets the language whose prototype has
the largest cosine with it. N-grams stay within words, which have a blank at each
end.

Bundling is linear, so a batch counts n-grams first and multiplies the counts with
the n-gram vectors in one product; training adds up counts per language and bundles
once per partition. Prototype sums are integers, so they do not depend on the order
of rows or the layout of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, cut, mix64

DIM = 1024
N = 3
SEED = 20
UNIT = 1 << 16  # weight of one text in a prototype
CHUNK_DOCS = 256
CHUNK_CHARS = 1 << 21
BLOCK_LANGS = 4096  # prototypes compared in one pass: 16 MB
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _alpha() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def letter_vectors(points: np.ndarray, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """One row of +1 and -1 per code point."""
    words = -(-dim // 64)
    with np.errstate(over="ignore"):
        at = (points.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(words, dtype=np.uint64)) * np.uint64(64)
        bits = np.unpackbits(mix64(at + mix64(np.array([seed], np.uint64))).astype("<u8").view(np.uint8), axis=1)
    return np.where(bits[:, :dim] == 1, 1, -1).astype(np.int8)


def gram_vectors(grams: np.ndarray, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """Bound vectors of n-grams given as rows of code points (the blank included)."""
    points, at = np.unique(grams, return_inverse=True)
    letters, at = letter_vectors(points, dim, seed), at.reshape(grams.shape)
    out = np.ones((len(grams), dim), np.int8)
    for k in range(grams.shape[1]):
        out *= np.roll(letters, grams.shape[1] - 1 - k, axis=1)[at[:, k]]
    return out


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that end between words (a word longer than a part is cut)."""
    while len(text) > CHUNK_CHARS:
        end = CHUNK_CHARS
        while end > 1 and text[end - 1].isalpha():
            end -= 1
        end = end if end > 1 else CHUNK_CHARS
        yield text[:end]
        text = text[end:]
    yield text


def count_grams(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """``(counts[text, gram], grams[gram, n])`` over the n-grams of lower-cased texts."""
    joined = "\n".join(["", *(t.lower() for t in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    # texts may hold line ends themselves, so their limits come from their lengths
    limits = np.cumsum([1] + [len(t.lower()) + 1 for t in texts])
    letter = _alpha()[points]
    keep = letter | np.r_[False, letter[:-1]]
    keep[0] = True
    seq = np.where(letter, points, 32)[keep]
    owner = (np.searchsorted(limits, np.nonzero(keep)[0], side="right") - 1)
    alphabet = np.nonzero(np.bincount(seq, minlength=33))[0]
    dense = np.zeros(alphabet[-1] + 1, np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    ids, size = dense[seq], len(alphabet)
    blank = dense[32]
    count = len(ids) - n + 1
    if count <= 0:
        return np.zeros((len(texts), 0), np.float32), np.zeros((0, n), np.int64)
    code = np.zeros(count, np.int64)
    inner = np.ones(count, bool)
    for k in range(n):
        part = ids[k:k + count]
        code = code * size + part
        if 0 < k < n - 1:
            inner &= part != blank
    code, text = code[inner], np.clip(owner[1:count + 1][inner], 0, len(texts) - 1)
    if size ** n <= 1 << 24:
        seen = np.zeros(size ** n, bool)
        seen[code] = True
        grams = np.nonzero(seen)[0]
        place = np.cumsum(seen) - 1
        at = place[code]
    else:
        grams, at = np.unique(code, return_inverse=True)
    counts = np.bincount(text * max(1, len(grams)) + at, minlength=len(texts) * len(grams))
    points_of = np.stack([alphabet[grams // size ** (n - 1 - k) % size] for k in range(n)], axis=1)
    return counts.reshape(len(texts), len(grams)).astype(np.float32), points_of


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= CHUNK_DOCS or size + len(t or "") > CHUNK_CHARS):
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def profile_counts(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks ``(start, end, counts, grams)`` of a batch of texts, of bounded size each."""
    for s, e in _chunks(texts):
        if e - s == 1 and len(texts[s] or "") > CHUNK_CHARS:
            total: dict[tuple, float] = {}
            for piece in _pieces(texts[s]):
                c, g = count_grams([piece])
                for gram, v in zip(map(tuple, g.tolist()), c[0].tolist()):
                    total[gram] = total.get(gram, 0.0) + v
            grams = sorted(total)
            yield s, e, np.array([[total[g] for g in grams]], np.float32), np.array(grams, np.int64).reshape(-1, N)
        else:
            yield s, e, *count_grams([t or "" for t in texts[s:e]])


def prototypes(docs: DataFrame, dim: int = DIM, seed: int = SEED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang string, vec array<long>)``: bundles of the texts of each non-null language, equal weight per text."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), object)
            for s, e, counts, grams in profile_counts(texts):
                if len(grams) == 0:
                    continue
                norm = np.sqrt((counts * counts).sum(axis=1))
                unit = np.rint(counts * (UNIT / np.maximum(norm, 1e-9))[:, None])
                vecs = gram_vectors(grams, dim, seed).astype(np.float64)
                for lang in set(langs[s:e].tolist()):
                    weight = unit[langs[s:e] == lang].astype(np.float64).sum(axis=0)
                    sums[lang] = sums.get(lang, 0) + (weight @ vecs).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "d", "v"])

    src = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    sums = src.mapInArrow(run, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("vec"))


def predict(docs: DataFrame, protos: DataFrame, dim: int = DIM, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred string`` and ``score double`` (replaced if present).

    ``score`` is the cosine with the winning prototype, cut to [0, 1]; ties go to the
    first language by name. Null and letterless texts, and all texts where nothing
    was learnt, get ``und`` and 0. Prototypes reach the workers in blocks of bounded
    size, one pass each, and each row carries its best language so far.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(UNKNOWN).alias("lang_pred"), F.lit(-2.0).alias("score"))
    count = protos.count()
    named = protos.orderBy("lang") if count <= BLOCK_LANGS else cut(
        protos.select(F.pmod(F.xxhash64("lang"), F.lit(-(-count // (BLOCK_LANGS // 2)))).alias("block"), "lang", "vec"), "lang-blocks")
    blocks = [named] if count <= BLOCK_LANGS else [
        named.where(F.col("block") == k) for k in range(-(-count // (BLOCK_LANGS // 2)))]
    for k, block in enumerate(blocks if count else []):
        rows = sorted(block.select("lang", "vec").collect(), key=lambda r: r.lang)  # at most about BLOCK_LANGS
        if not rows:
            continue
        matrix = np.array([r.vec for r in rows], np.float64)
        matrix /= np.maximum(np.sqrt((matrix * matrix).sum(axis=1)), 1e-12)[:, None]
        held = spark.sparkContext.broadcast(([r.lang for r in rows], matrix.astype(np.float32)))
        out = _best(out, held, dim, seed, text_col)
        if k < len(blocks) - 1:
            out = cut(out, "lang-best")
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))


def _best(df: DataFrame, held, dim: int, seed: int, text_col: str) -> DataFrame:
    def run(batches):
        names, matrix = held.value
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            lang, score = b.column(at["lang_pred"]).to_pylist(), b.column(at["score"]).to_pylist()
            for s, e, counts, grams in profile_counts(b.column(at[text_col]).to_pylist()):
                if len(grams) == 0:
                    continue
                docs = counts @ gram_vectors(grams, dim, seed).astype(np.float32)
                norm = np.sqrt((docs * docs).sum(axis=1))
                cos = (docs @ matrix.T) / np.maximum(norm, 1e-9)[:, None]
                some = counts.any(axis=1)
                for i, j in enumerate(cos.argmax(axis=1).tolist()):
                    if some[i] and cos[i, j] > score[s + i]:
                        lang[s + i], score[s + i] = names[j], float(cos[i, j])
            cols = [c for i, c in enumerate(b.columns) if i not in (at["lang_pred"], at["score"])]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                [*(n for n in b.schema.names if n not in ("lang_pred", "score")), "lang_pred", "score"])

    return df.mapInArrow(run, df.schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5,
             held_fold: int = 0, learn: Column | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, learnt from rows that are not held out.

    A row is held out if ``crc32(id) mod folds`` is ``held_fold``; rows with a null id
    are neither held out nor learnt from. Repeated rows are predicted alike, other
    columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    own = crc_fold("doc_id", folds) != held_fold
    protos = cut(prototypes(rows.where(own if learn is None else own & learn)), "lang-protos")
    out = predict(rows.select("doc_id", "text"), protos)
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"),
                      "lang_pred", "score")
