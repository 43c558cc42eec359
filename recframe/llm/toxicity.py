"""Operator 6: toxicity by a subsequence string-kernel support vector machine
with Nyström landmarks.

Kernel of two words: the gap-weighted subsequence kernel of length 3 (Lodhi et
al. 2002).  A word, with a start mark, is mapped to its triples of characters
i < j < k with k - i < SPAN, each weighted DECAY ** (k - i + 1); the kernel is
the inner product divided by both norms, so an inserted or dropped character
lowers it only a little.  A word of more than MAX_WORD bytes (joined chains, text
without white space) is taken as its overlapping windows of 6, 12 and 24 bytes.

Landmarks z are words and word beginnings that mark toxic sentences in a bounded
sample of labelled rows (SAMPLE_PER_CLASS documents of each class).  A sentence
x is the set of its words; its value at a landmark is the largest k(w, z) **
SHARP over them, values of k under FLOOR counting as 0.  Nyström: phi(x) = k(x,
Z) K_ZZ ** -1/2, and the SVM is linear in phi.  Sentences are not labelled one
by one, so the machine is trained in two rounds: first on whole labelled
documents, then on the sentence of each toxic document that the first machine
rates highest against the highest-rated ones of clean documents.  A document
scores as its worst sentence, through a logistic curve fitted to the margins.

Defined cases: null and empty texts score as an empty sentence; repeated rows
score alike; labels that are null or belong to held-out ids are not used; with
no usable label of one class every score is 0; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import ALNUM_WORD, LOWER, SPACE_WORD, frugal, slices, text_bytes, written_small

SAMPLE_PER_CLASS = 1500
#: Documents with longer texts are left out of the training sample, which bounds its bytes.
SAMPLE_TEXT_BYTES = 32 << 10
N_LANDMARKS = 48
SPAN, DECAY = 5, 0.6
SHARP, FLOOR = 2, 0.5
#: Longer words are taken as their windows of these (bytes, step).
MAX_WORD = 24
WINDOWS = ((6, 1), (12, 3), (MAX_WORD, 8))

#: 32 character classes: word start, a-z, digit, and four for other bytes.
_CLASS = np.full(256, 27, np.int64)
_CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[0x80:] = 28 + np.arange(128) % 4
_SENTENCE = re.compile(rb"[.!?]+[\x20\x09-\x0D]+|[\n\r]+")
#: ASCII bytes that are not in words: they are dropped, so that "i.d-iot" is one word.
_MARKS = bytes(i for i in range(128) if not ALNUM_WORD[LOWER[i]] and SPACE_WORD[i])


#: (j, k, weight) of the triples i, i + j, i + k.
_STEPS = [(j, k, DECAY ** (k + 1)) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]
_NO_TRIPLE = 1 << 15


def _codes(words: list[bytes]) -> list[tuple[np.ndarray, float]]:
    """For each step: triple codes (word by start; _NO_TRIPLE beyond the end) and weight."""
    n = len(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    width = int(lens.max(initial=0)) + 1
    chars = np.full((n, width + SPAN), -1, np.int32)
    chars[:, 0] = 0
    data = np.frombuffer(b"".join(words), np.uint8)
    at = np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens) + 1
    chars[np.repeat(np.arange(n), lens), at] = _CLASS[data]
    out = []
    for j, k, weight in _STEPS:
        c = chars[:, k:k + width]
        code = (chars[:, :width] << 10) | (chars[:, j:j + width] << 5) | c
        out.append((np.where(c >= 0, code, _NO_TRIPLE), weight))
    return out


def _norms(codes: list[tuple[np.ndarray, float]], n: int) -> np.ndarray:
    code = np.concatenate([c for c, _ in codes], axis=1)
    weight = np.concatenate([np.full(c.shape[1], w) for c, w in codes])
    order = np.argsort(code, axis=1, kind="stable")
    code, weight = np.take_along_axis(code, order, axis=1).ravel(), weight[order].ravel()
    heads = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (np.arange(1, len(code)) % order.shape[1] == 0)))
    sums = np.where(code[heads] == _NO_TRIPLE, 0.0, np.add.reduceat(weight, heads))
    got = np.sqrt(np.bincount(heads // order.shape[1], sums * sums, n))
    return np.where(got > 0, got, 1.0)


@dataclass
class Landmarks:
    """Landmark strings, their unit feature vectors as a table over triples (the
    last row, for no triple, is zero) and the largest value of each row."""

    words: list[bytes]
    table: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Landmarks:
        table = np.zeros((_NO_TRIPLE + 1, len(words)))
        for code, weight in _codes(words):
            np.add.at(table, (code, np.arange(len(words))[:, None]), weight)
        table[_NO_TRIPLE] = 0
        table = (table / np.maximum(np.sqrt((table ** 2).sum(0)), 1e-12)).astype(np.float32)
        return cls(words, table, table.max(axis=1))

    def kernel(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(indices of words with a value above the floor, their sharpened kernel
        values at all landmarks)."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        found, values = [np.zeros(0, np.int64)], [np.zeros((0, len(self.words)))]
        for lo in range(0, len(order), 8192):  # words of like length together
            part = order[lo:lo + 8192]
            codes = _codes([words[i] for i in part])
            # repeated triples only add to a norm, so this bounds every kernel value from above
            size = lens[part] + 1
            norm = np.sqrt(sum(w * w * np.maximum(size - k, 0) for _, k, w in _STEPS))
            bound = sum(w * self.most[c].sum(axis=1) for c, w in codes)
            near = np.flatnonzero(bound >= FLOOR * np.maximum(norm, 1e-9))
            if not len(near):
                continue
            codes = [(c[near], w) for c, w in codes]
            raw = np.zeros((len(near), len(self.words)))
            for c, w in codes:
                for i in range(c.shape[1]):
                    raw += w * self.table[c[:, i]]
            k = raw / _norms(codes, len(near))[:, None]
            k[k < FLOOR] = 0
            keep = np.flatnonzero(k.any(axis=1))
            found.append(part[near[keep]])
            values.append(k[keep] ** SHARP)
        return np.concatenate(found), np.concatenate(values)


def sentences(text: bytes) -> list[list[bytes]]:
    """Words of each sentence of a lower-cased text; an empty text has one empty sentence."""
    got = [words_of(s) for s in _SENTENCE.split(text)]
    return [s for s in got if s] or [[]]


def words_of(text: bytes) -> list[bytes]:
    """Words at white space, A-Z lower-cased, without marks inside or around."""
    return text.translate(bytes(LOWER), _MARKS).split()


def windows(word: bytes, width: int, step: int) -> list[bytes]:
    """Overlapping windows that hold every byte of a word, shorter at its end (4 bytes at least)."""
    return [word[i:i + width] for i in range(0, max(1, len(word) - 3), step)]


def pieces(words: list[bytes]) -> list[bytes]:
    """The words, longer ones than MAX_WORD as their windows: a landmark anywhere
    in them has a window that holds little else."""
    if max(map(len, words), default=0) <= MAX_WORD:
        return words
    return [p for w in words for p in ([w] if len(w) <= MAX_WORD else [p for width, step in WINDOWS for p in windows(w, width, step)])]


class WordCache:
    """Kernel values of the words met so far; emptied when it holds LIMIT words."""

    LIMIT = 100_000

    def __init__(self, marks: Landmarks):
        self.marks = marks
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.row = np.zeros(0, np.int64)
        self.values = np.zeros((0, len(self.marks.words)))

    def add_new(self) -> None:
        """Compute the words that have an id but no row yet."""
        new = list(itertools.islice(self.ids, len(self.row), None))
        keep, values = self.marks.kernel(new)
        row = np.full(len(new), -1, np.int64)
        row[keep] = len(self.values) + np.arange(len(keep))
        self.row, self.values = np.concatenate([self.row, row]), np.concatenate([self.values, values])


def sentence_values(cache: WordCache, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document of each sentence with a non-zero value, its values at the
    landmarks); sentences without one are left out: their values are all 0."""
    if len(cache.ids) > cache.LIMIT:
        cache.clear()
    ids = cache.ids
    word_ids, lens, doc_of = [], [], []
    for d, t in enumerate(texts):
        for s in map(pieces, sentences(t)):
            word_ids.extend([ids.setdefault(w, len(ids)) for w in s])
            lens.append(len(s))
            doc_of.append(d)
    cache.add_new()
    at = cache.row[np.array(word_ids, np.int64)] if word_ids else np.zeros(0, np.int64)
    has = at >= 0
    at, sent = at[has], np.repeat(np.arange(len(lens)), lens)[has]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, len(cache.marks.words)))
    heads = np.flatnonzero(np.append(True, sent[1:] != sent[:-1]))
    return np.array(doc_of, np.int64)[sent[heads]], np.maximum.reduceat(cache.values[at], heads, axis=0)


def document_values(doc_of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]))
    np.maximum.at(out, doc_of, values)
    return out


def pick_landmarks(texts: list[bytes], toxic: np.ndarray, n: int = N_LANDMARKS) -> list[bytes]:
    """Greedy cover: strings (words and word beginnings of 4 to 6 bytes) with the
    best log odds, preferring ones that mark toxic documents not yet marked."""
    number: dict[bytes, int] = {}  # each string once; a text is an array of numbers
    found = []
    for t in texts:
        words = {p for w in words_of(t) for p in ([w] if len(w) <= MAX_WORD else windows(w, *WINDOWS[-1]))}
        every = words | {w[:k] for w in words for k in (4, 5, 6) if len(w) >= k}
        found.append(np.fromiter((number.setdefault(s, len(number)) for s in every), np.int32, len(every)))
    names = list(number)
    count = [np.bincount(np.concatenate([np.zeros(0, np.int32), *(f for f, y in zip(found, toxic, strict=True) if y == c)]), minlength=len(names)) for c in (0, 1)]
    n_pos, n_neg = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds, pos = {}, {}
    for i in np.flatnonzero(count[1] >= 3).tolist():
        s = names[i]
        if len(s) >= 3:
            odds[s], pos[s] = math.log((count[1][i] + 0.5) / n_pos / ((count[0][i] + 0.5) / n_neg)), int(count[1][i])
    good = sorted((s for s, o in odds.items() if o > 1), key=lambda s: (-odds[s] * math.log1p(pos[s]), -len(s), s))[:4000]
    where: dict[bytes, set[int]] = {s: set() for s in good}
    for d, (f, y) in enumerate(zip(found, toxic, strict=True)):
        if y:
            for i in f.tolist():
                if names[i] in where:
                    where[names[i]].add(d)
    del found, names, number
    times, chosen = Counter(), []
    while good and len(chosen) < n:
        # a document marked m times already counts 4 ** -m, so that every toxic document gets a few marks
        best = max(good, key=lambda s: (odds[s] * sum(0.25 ** times[d] for d in where[s]), len(s), s))
        chosen.append(best)
        times.update(where[best])
        good.remove(best)
        if len(chosen) >= 12 and odds[best] * sum(0.25 ** times[d] for d in where[best]) < 0.01:
            break
    return chosen


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM (hinge loss) by dual coordinate descent, classes weighted alike."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    limit = np.where(y > 0, c * len(y) / (2 * max(1, y.sum())), c * len(y) / (2 * max(1, (1 - y).sum())))
    square = np.maximum((x1 ** 2).sum(1), 1e-12)
    alpha, w = np.zeros(len(y)), np.zeros(x1.shape[1])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (sign[i] * (x1[i] @ w) - 1) / square[i], 0.0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x1[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def fit_logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(toxic | margin) by damped Newton steps (Platt), with
    smoothed targets; classes weighted alike so that 0.5 is the SVM's own cut."""
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(weight * (p - target) * margin).sum() + 1e-4 * a, (weight * (p - target)).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
    return max(float(a), 1e-3), float(b)


@dataclass
class Model:
    marks: Landmarks | None
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def forget(self) -> None:
        """Drop the words met: the worker that holds the model is kept for other tasks."""
        self.__dict__.pop("cache", None)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.marks is None:
            return np.zeros(len(texts))
        if not hasattr(self, "cache"):
            self.cache = WordCache(self.marks)
        margin = np.full(len(texts), self.bias)  # an all-zero sentence
        offs = np.cumsum([0, *map(len, texts)])
        for lo, hi in slices(offs):
            doc_of, values = sentence_values(self.cache, texts[lo:hi])
            np.maximum.at(margin, doc_of + lo, values @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    """Landmarks, Nyström map and machine from labelled texts."""
    toxic = np.asarray(toxic, np.int64)
    words = pick_landmarks(texts, toxic) if 0 < toxic.sum() < len(toxic) else []
    if not words:
        return Model(None, np.zeros(0), 0.0, 1.0, 0.0)
    marks = Landmarks.of(words)
    table = marks.table.astype(np.float64)
    kzz = table.T @ table
    kzz = np.where(kzz < FLOOR, 0, kzz) ** SHARP
    value, vector = np.linalg.eigh(kzz)
    root = vector @ np.diag(np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)) @ vector.T
    doc_of, sent = sentence_values(WordCache(marks), texts)
    w, b = train_svm(document_values(doc_of, sent, len(texts)) @ root, toxic)
    # second round: the sentence that speaks most for toxicity, from every document
    best = np.zeros((len(texts), len(words)))
    margin = np.full(len(texts), -np.inf)
    for d, m, v in zip(doc_of, sent @ (root @ w) + b, sent, strict=True):
        if m > margin[d]:
            margin[d], best[d] = m, v
    w, b = train_svm(best @ root, toxic)
    top = np.full(len(texts), b)
    np.maximum.at(top, doc_of, sent @ (root @ w) + b)
    slope, offset = fit_logistic(top, toxic)
    return Model(marks, root @ w, b, slope, offset)


def held_out(col: str = "doc_id") -> Column:
    """Ids kept out of training: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class, the ones
    with the smallest id hashes, but for texts over SAMPLE_TEXT_BYTES; only those
    texts come to the driver."""
    short = docs.where(F.octet_length(text_bytes()) <= SAMPLE_TEXT_BYTES)
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = None
    for y in (0, 1):
        part = one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = part if sample is None else sample.union(part)
    # 2 * per_class ids: a fixed bound
    sample = sample.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y"))
    rows = (short.select("doc_id", text_bytes().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
            .orderBy(F.xxhash64("_id"), "text").select("_id", "_y", "text").dropDuplicates(["_id"]).limit(2 * per_class).collect())
    rows.sort(key=lambda r: r["_id"])
    return fit([bytes(r["text"]) for r in rows], np.array([r["_y"] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """doc_id and score of every document; with ``keep`` = "clean", instead all
    columns of the documents whose score is under 0.5."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # landmarks: at most N_LANDMARKS * 2**15 floats

    def texts_of(b: pa.RecordBatch) -> list[bytes]:
        return [x or b"" for x in b.column(b.num_columns - 1).to_pylist()]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(texts_of(b)), pa.float64())], ["doc_id", "score"])
        shared.value.forget()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array(shared.value.scores(texts_of(b)) < 0.5)
            yield pa.RecordBatch.from_struct_array(b.filter(ok).column(0))
        shared.value.forget()

    if keep == "clean":
        return written_small(docs.select(F.struct("*").alias("row"), text_bytes().alias("raw")).mapInArrow(frugal(clean), docs.schema))
    d = docs.select("doc_id", text_bytes().alias("raw"))
    return written_small(d.mapInArrow(frugal(rate), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
