"""Toxicity scores from a subsequence string-kernel SVM with Nyström landmarks.

The strings are the words of a text, lower-cased, letters only, between two end
marks; a run of single letters ("i d i o t") is one word more. The kernel compares
two words by their common subsequences of three letters: each occurrence weighs
``DECAY`` to the power of its span, and neighbouring letters may be up to ``GAP``
places apart, so inserted characters cost weight, not the match. Words are
normalised to length 1 in that space.

Labels belong to whole documents (bags of words). Training counts, over a bounded
sample of labelled documents, in how many distinct contexts of either label a word
occurs; words that occur in toxic contexts alone are the positives, common and
hash-chosen words of clean documents the negatives. Landmark words span the
Nyström space, where a squared-hinge SVM is solved exactly; the clean words nearest
to the boundary join the negatives in two further rounds. A document's score is a
fitted sigmoid of the margins of its three most toxic words.

Landmarks enter the decision linearly, so the model folds into one table of
weights per three-letter subsequence, and scoring a word is a sum over its
subsequences: the same value as the kernel expansion, at the cost of its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_rows, crc_fold, cut, give_back, kept, mix64

GAP = 3
DECAY = 0.6
ALPHABET = 64  # letter classes, the last two of which are the end marks
THRESHOLD = 0.3
SAMPLE_ROWS = 6000  # labelled documents of each class that training may read
WORD_CHARS = 48  # longest word offered as a training word (scoring takes any)
CACHE_WORDS = 400_000

_CONTINUATION = bytes(range(0x80, 0xC0))
_SHAPE = bytes(32 if b == 32 else 120 for b in range(256))
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def letters(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalpha())


def words_of(text: bytes) -> tuple[set[bytes], list[str]]:
    """The distinct raw words of a text, and the words spelt with spaces between letters."""
    words = text.split()
    if len(words) < 3:
        return set(words), []
    line = b" " + b" ".join(words) + b" "
    if b" x x x " not in line.translate(_SHAPE, _CONTINUATION):
        return set(words), []
    spelt = _SPACED.findall(line.decode("utf-8", "replace"))
    return set(words), [s.replace(" ", "") for s in spelt]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all words end to end with end marks, and the word of each."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    points = np.frombuffer("".join(f"\0{w}\1" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
    az = (points >= 97) & (points <= 122)
    with np.errstate(over="ignore"):
        other = 26 + (mix64(points.astype(np.uint64)) % np.uint64(ALPHABET - 28)).astype(np.int64)
    out = np.where(az, points - 97, other)
    out[points == 0], out[points == 1] = ALPHABET - 2, ALPHABET - 1
    return out, np.repeat(np.arange(len(words)), lengths)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse kernel features ``(word, subsequence, value)``, merged and of length 1 per word."""
    c, w = codes(words)
    at, keys, vals = [], [], []
    for g1 in range(1, GAP + 1):
        for g2 in range(1, GAP + 1):
            n = len(c) - g1 - g2
            if n <= 0:
                continue
            same = w[:n] == w[g1 + g2:]
            keys.append(((c[:n] * ALPHABET + c[g1:g1 + n]) * ALPHABET + c[g1 + g2:])[same])
            at.append(w[:n][same])
            vals.append(np.full(len(at[-1]), DECAY ** (g1 + g2 - 2)))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    both = np.concatenate(at) * ALPHABET ** 3 + np.concatenate(keys)
    order = np.argsort(both, kind="stable")
    both, v = both[order], np.concatenate(vals)[order]
    first = np.nonzero(np.diff(both, prepend=-1))[0]
    v = np.add.reduceat(v, first) if len(first) else v
    both = both[first]
    word, key = both // ALPHABET ** 3, both % ALPHABET ** 3
    norm = np.sqrt(np.bincount(word, v * v, minlength=len(words)))
    return word, key, v / norm[word]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of every word with every landmark."""
    lw, lk, lv = subsequences(landmarks)
    used = np.unique(lk)
    base = np.zeros((len(landmarks), len(used)))
    base[lw, np.searchsorted(used, lk)] = lv
    out = np.zeros((len(words), len(landmarks)))
    for s in range(0, len(words), 512):
        w, k, v = subsequences(words[s:s + 512])
        pos = np.searchsorted(used, k)
        hit = (pos < len(used)) & (used[np.minimum(pos, len(used) - 1)] == k)
        rows = np.zeros((len(words[s:s + 512]), len(used)))
        rows[w[hit], pos[hit]] = v[hit]
        out[s:s + 512] = rows @ base.T
    return out


@dataclass(frozen=True)
class Model:
    """Weights per three-letter subsequence, the SVM's bias, and the sigmoid of a document's top margins."""

    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def margins(self, words: list[str]) -> np.ndarray:
        w, k, v = subsequences(words)
        return np.bincount(w, v * self.weights[k], minlength=len(words)) + self.bias

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(np.maximum(top, LOW) @ self.slopes + self.shift, -40, 40)))


LOW = -1.0  # the margin of a clean word; a document with fewer than TOP words is filled up with it
TOP = 3


def fit_svm(positives: list[str], negatives: list[str], weights: np.ndarray, n_landmarks: int = 256,
            cost: float = 20.0) -> tuple[np.ndarray, float]:
    """Subsequence weights and bias of the SVM in the Nyström space of the landmarks."""
    half = n_landmarks // 2
    landmarks = positives[:half] + negatives[:n_landmarks - min(half, len(positives))]
    words = positives + negatives
    y = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.c_[kernel(words, landmarks) @ root, np.full(len(words), 1.0)]
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(z.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(50):
        za = z[active] * (cost * weights[active])[:, None]
        w = np.linalg.solve(ridge + za.T @ z[active], za.T @ y[active])
        now = y * (z @ w) < 1
        if np.array_equal(now, active):
            break
        active = now
    lw, lk, lv = subsequences(landmarks)
    beta = root @ w[:-1]
    return np.bincount(lk, lv * beta[lw], minlength=ALPHABET ** 3), float(w[-1])


def fit_sigmoid(top: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of the probability of label 1 given the top margins (damped Newton, small ridge)."""
    x = np.c_[np.maximum(top, LOW), np.ones(len(top))]
    p = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        hess = x.T @ (x * (q * (1 - q))[:, None]) + 1e-2 * np.eye(len(p))
        step = np.linalg.solve(hess, x.T @ (q - y) + 1e-2 * p)
        p = p - step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return np.maximum(p[:-1], 0.0), float(p[-1])


def _sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``(text, toxic)`` of at most ``rows`` labelled training documents of each class, chosen by a hash of the id."""
    pick = None
    for label in (0, 1):
        part = labels.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(rows)
        pick = part if pick is None else pick.unionByName(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(pick), "id").where("text is not null").select("text", "toxic")  # at most 2 * rows ids


def _known(labels: DataFrame, learn: Column | None) -> DataFrame:
    """``(id, toxic)``: one row per id with a label of 0 or 1 (repeated labels: the larger)."""
    known = labels.where("toxic in (0, 1) and doc_id is not null")
    if learn is not None:
        known = known.where(learn)
    return known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))


def _context(text: bytes) -> int:
    """Smallest hash of five neighbouring words: near copies of a text mostly share it."""
    words = text.lower().split()
    grams = zip(*(words[i:] for i in range(5))) if len(words) > 4 else [words]
    return min(xxhash.xxh64_intdigest(b" ".join(g)) for g in grams) >> 1


def _bags(sample: DataFrame) -> DataFrame:
    """``(context, toxic, word)``: distinct words per document; copies of a text share a context."""

    def run(batches):
        for b in batches:
            context, toxic, word = [], [], []
            for text, label in zip(byte_rows(b, "text"), b.column(1).to_pylist()):
                raw, spelt = words_of(text)
                bag = {letters(r.decode("utf-8", "replace")) for r in raw} | {letters(s) for s in spelt}
                bag = sorted(w for w in bag if 0 < len(w) <= WORD_CHARS)
                if bag:
                    context += [_context(text)] * len(bag)
                    toxic += [label] * len(bag)
                    word += bag
            yield pa.RecordBatch.from_arrays(
                [pa.array(context, pa.int64()), pa.array(toxic, pa.int32()), pa.array(word, pa.string())],
                ["context", "toxic", "word"])

    return sample.mapInArrow(run, "context long, toxic int, word string")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None,
          sample_rows: int = SAMPLE_ROWS, max_positives: int = 400, max_negatives: int = 3000, rounds: int = 3) -> Model:
    """Model of ``labels.toxic`` (0 or 1; other values are ignored) from the texts of ``docs``.

    ``learn``: a condition on the column ``doc_id`` that limits the labelled rows
    used. At most ``sample_rows`` documents of each class are read; at most
    ``max_positives`` and, each round, ``max_negatives`` words reach the driver, and
    three margins per sampled document. Without labelled
    texts of both classes, the model gives every text the share of label 1 (none: 0).
    """
    known = cut(_known(labels.select("doc_id", "toxic"), learn), "toxic-known")
    all_rows = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = cut(_sample(docs, known, sample_rows, id_col, text_col), "toxic-sample")
    rows = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    seen = _bags(sample).distinct()
    stats = cut(seen.groupBy("word").agg(
        F.sum(F.col("toxic")).cast("long").alias("pos"), F.sum(1 - F.col("toxic")).cast("long").alias("neg")), "toxic-words")
    strong = stats.where("pos >= 20 * neg")
    least = 3 if strong.where("pos >= 3").limit(1).count() else 1
    pos = strong.where(F.col("pos") >= least).orderBy(F.desc("pos"), "word").limit(max_positives).collect()
    clean = stats.where("neg >= 1 and neg >= 2 * pos")
    third = max_negatives // 3
    neg = {r.word: r.neg for r in clean.orderBy(F.desc("neg"), "word").limit(third).collect()}
    neg |= {r.word: r.neg for r in clean.orderBy(F.xxhash64("word"), "word").limit(max_negatives - third).collect()}
    if not pos or not neg:
        share = min(max(all_rows.get(1, 0) / max(1, sum(all_rows.values())), 1e-6), 1 - 1e-6)
        return Model(np.zeros(ALPHABET ** 3), 0.0, np.zeros(TOP), float(np.log(share / (1 - share))))
    words, weight = [r.word for r in pos], [min(r.pos, 50) / 5.0 for r in pos]
    hard: dict[str, int] = {}
    model = None
    for k in range(rounds):
        order = [*reversed(hard), *sorted(neg.keys() - hard.keys(), key=lambda w: (-len(w) % 7, w))]
        every = neg | hard
        weights, bias = fit_svm(words, order, np.array(weight + [min(every[w], 50) / 2.0 if k else 1.0 for w in order]))
        model = Model(weights, bias, np.ones(TOP), 0.0)
        if k < rounds - 1:
            scored = score_rows(clean.select("word", "neg"), model, "top", "word", top=True)
            near = scored.select("word", "neg", F.col("top")[0].alias("m")).orderBy(F.desc("m"), "word").limit(third).collect()
            hard = {w: n for w, n in hard.items() if w not in {r.word for r in near}} | {r.word: r.neg for r in reversed(near)}
    got = score_rows(sample, model, "top", top=True).select("top", "toxic").toPandas()
    slopes, shift = fit_sigmoid(np.array(got["top"].tolist()), got["toxic"].to_numpy())
    # the sample may hold another share of label 1 than the labelled rows
    odds = [np.log((c.get(1, 0) + 1) / (c.get(0, 0) + 1)) for c in (all_rows, rows)]
    return Model(model.weights, model.bias, slopes, shift + float(odds[0] - odds[1]))


def score_rows(df: DataFrame, model: Model, out: str = "score", text_col: str = "text", top: bool = False) -> DataFrame:
    """All rows and columns of ``df`` with ``out double`` (an input column of that name is replaced).

    ``top``: the largest margins of the words instead, as an array of ``TOP`` doubles.

    Null, empty and letterless texts get the margin of a clean word. Work per batch
    is bounded; words are scored once per worker and kept in a bounded cache.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)  # one table of 64**3 doubles: 2 MB
    src = df.select(*[F.col(f"`{c}`") for c in df.columns if c != out])
    target = T.StructType([*src.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()) if top else T.DoubleType())])

    def run(batches):
        m = held.value
        kept("margins", lambda: None)  # what another stage has kept in this worker goes first
        cache: dict[bytes, float] = {}

        def fill(words: list[bytes]) -> None:
            text = [letters(w.decode("utf-8", "replace")) for w in words]
            some = [i for i, t in enumerate(text) if t]
            for w in words:
                cache[w] = LOW
            for s in range(0, len(some), 20_000):
                part = some[s:s + 20_000]
                for i, v in zip(part, m.margins([text[i] for i in part]).tolist()):
                    cache[words[i]] = v

        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                bags = [words_of(t) for t in byte_rows(part, text_col)]
                raw = [r | {x.encode() for x in spelt} for r, spelt in bags]
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                fill([w for w in set().union(*raw) if w not in cache])
                best = [nlargest(TOP, map(cache.__getitem__, r)) for r in raw]
                best = np.array([m_ + [LOW] * (TOP - len(m_)) for m_ in best]).reshape(-1, TOP)
                got = pa.array(best.tolist(), pa.list_(pa.float64())) if top else pa.array(m.probability(best), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, got], [*part.schema.names, out])
        cache.clear()
        give_back()

    return src.mapInArrow(run, target)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4,
             held_fold: int = 2) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Rows whose ``crc32(id) mod folds`` is ``held_fold`` are never learnt from (a
    null id is not held out, and no label belongs to it). Repeated rows are scored
    alike; other columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, learn=crc_fold("doc_id", folds) != held_fold)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = score_rows(rows, model)
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
