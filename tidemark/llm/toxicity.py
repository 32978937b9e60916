"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Words are compared by their common subsequences of three letters; every letter skipped lowers a
subsequence's weight, so an insult with gaps or inserted characters still resembles its plain
form. Characters that aren't letters are skipped, and letters spelled out one by one are read as a
word. The cosine of two words' subsequence vectors is the kernel; similarities below `FLOOR`
count as 0 and the rest is squared. A text is described by its best similarity to each landmark
word, whitened by the landmarks' own kernel matrix, and by its best similarity to any; a linear
machine and a logistic curve turn that into a score. Toxic texts of the sample are also learnt with
a character put into, or taken out of, their landmark words.

Scale: landmarks and machine are learnt from a bounded sample of labelled rows (`per_class` of
each label, by a hash of doc_id, one text for each; the landmark words are counted by Spark). Scoring is one pass
inside tasks, without a shuffle. Each distinct word of a batch is screened once with an upper bound
of its similarity to any landmark, so the kernel is computed for few words only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from . import linear_svm
from .common import at_most, held_out, mix64, texts_of, thinned, written

LETTERS, SPAN, DECAY, FLOOR, POWER = 32, 6, 0.85, 0.55, 2
#: Weight of the similarity to the nearest landmark beside the whitened ones.
NEAREST = 2.0
#: Offsets of the second and third letter of a subsequence, and its weight.
SHAPES = [(j, k, DECAY ** (k - 2)) for k in range(2, SPAN + 1) for j in range(1, k)]
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point: 1 + letter class (a-z, then others by code point), 0 for what is
    skipped, 255 for white space."""
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            t[c] = 1 + (c - 97 if 97 <= c <= 122 else 26 + c % 6)
        elif ch.isspace() or c == 0:
            t[c] = 255
    return t


@lru_cache(maxsize=1)
def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, _INVERSE):
        step = np.full(n, b, np.uint64)
        step[0] = 1
        out.append(np.cumprod(step, dtype=np.uint64))
    return out[0], out[1]


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """letters, start, end, doc: the letter classes of all words of a batch, where each word
    starts and ends among them, and the text it is from."""
    joined = "\0".join((t or "").lower().replace("\0", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points]
    is_letter = (kind > 0) & (kind < 255)
    spaces, docs = np.cumsum(kind == 255), np.cumsum(points == 0)
    letters = kind[is_letter] - 1
    if not len(letters):
        none = np.zeros(0, np.int64)
        return letters, none, none, none
    space, doc = spaces[is_letter], docs[is_letter]
    start = np.flatnonzero(np.concatenate(([True], space[1:] != space[:-1])))
    end = np.concatenate((start[1:], [len(letters)]))
    alone = end - start == 1
    goes_on = np.concatenate(([False], alone[1:] & alone[:-1] & (doc[start[1:]] == doc[start[:-1]])))
    start = start[~goes_on]
    end = np.concatenate((start[1:], [len(letters)]))
    return letters, start, end, doc[start]


def distinct(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of each distinct word, and for each word which of these it is."""
    power, inverse = _power_tables(1 << max(16, int(len(letters) + 1).bit_length()))
    total = np.concatenate(([np.uint64(0)], np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * power[: len(letters)], dtype=np.uint64)))
    h = mix64(((total[end] - total[start]) * inverse[start]) ^ (end - start).astype(np.uint64))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    return first, which


def _gather(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of chosen words one after the other, and each letter's word."""
    n = end - start
    word = np.repeat(np.arange(len(n)), n)
    return letters[np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())], word


def subsequences(letters: np.ndarray, word: np.ndarray):
    """(index of the subsequence, word, weight) for each shape."""
    x = letters.astype(np.int32)
    for j, k, weight in SHAPES:
        if len(x) > k:
            same = word[k:] == word[:-k]
            yield (x[:-k] * (LETTERS * LETTERS) + x[j : len(x) - k + j] * LETTERS + x[k:])[same], word[k:][same], weight


def norms(letters: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Length of each word's subsequence vector, repeated subsequences added up."""
    parts = list(subsequences(letters, word))
    if not parts:
        return np.zeros(n)
    key = np.concatenate([w.astype(np.int64) * LETTERS**3 + i for i, w, _ in parts])
    weight = np.concatenate([np.full(len(i), v) for i, _, v in parts])
    u, at = np.unique(key, return_inverse=True)
    total = np.bincount(at, weight)
    return np.sqrt(np.bincount(u // LETTERS**3, total * total, n))


def table_of(words: list[str]) -> np.ndarray:
    """Unit subsequence vectors [LETTERS**3, words]."""
    letters, start, end, doc = words_of(words)
    table = np.zeros((LETTERS**3, len(words)), np.float32)
    if len(start):
        flat, word = _gather(letters, start, end)
        for i, w, weight in subsequences(flat, word):
            np.add.at(table, (i, doc[w]), weight)
    length = np.linalg.norm(table, axis=0)
    return table / np.where(length > 0, length, 1)


def sharpen(similarity: np.ndarray) -> np.ndarray:
    return np.where(similarity >= FLOOR, similarity, 0) ** POWER


def best_similarities(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """For each text and landmark, the sharpened similarity of the text's most similar word."""
    out = np.zeros((len(texts), table.shape[1]), np.float32)
    letters, start, end, doc = words_of(texts)
    if not len(start) or not table.shape[1]:
        return out
    first, which = distinct(letters, start, end)
    long = np.flatnonzero(end[first] - start[first] >= 3)
    if not len(long):
        return out
    flat, word = _gather(letters, start[first[long]], end[first[long]])
    # a word's product with the largest weight of any landmark bounds its product with each; its
    # vector is no shorter than if no subsequence repeated
    most = table.max(axis=1)
    bound, square = np.zeros(len(long)), np.zeros(len(long))
    for i, w, weight in subsequences(flat, word):
        bound += np.bincount(w, most[i] * weight, len(long))
        square += np.bincount(w, minlength=len(long)) * weight**2
    near = np.flatnonzero(bound >= FLOOR * np.sqrt(square) - 1e-6)
    near = near[square[near] > 0]
    if not len(near):
        return out
    chosen = first[long[near]]
    flat, word = _gather(letters, start[chosen], end[chosen])
    product = np.zeros((len(near), table.shape[1]), np.float32)
    for i, w, weight in subsequences(flat, word):
        if len(w):  # words ascend
            head = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            product[w[head]] += np.add.reduceat(table[i], head, axis=0) * np.float32(weight)
    value = sharpen(product / norms(flat, word, len(near))[:, None])
    live = np.flatnonzero(value.any(axis=1))
    place = np.full(len(first), -1)
    place[long[near[live]]] = live
    at = place[which]
    hit = np.flatnonzero(at >= 0)
    pairs = np.unique(np.stack([doc[hit], at[hit]], axis=1), axis=0)
    np.maximum.at(out, pairs[:, 0], value[pairs[:, 1]])
    return out


def embed(similarities: np.ndarray, whiten: np.ndarray) -> np.ndarray:
    """Whitened similarities and the weighted largest one."""
    return np.hstack([similarities @ whiten, NEAREST * similarities.max(axis=1, keepdims=True)])


def disguise(text: str | None, landmarks: frozenset[str], seed: int) -> str | None:
    """The text with one character put into (or, of long words sometimes, taken out of) each of
    its landmark words; null if it has none. The same seed gives the same text."""
    rng, changed, words = np.random.default_rng(seed), False, (text or "").split(" ")
    for i, w in enumerate(words):
        if w.lower() in landmarks:
            k = int(rng.integers(1, len(w)))
            out = len(w) >= 5 and rng.random() < 0.3
            words[i] = w[:k] + w[k + 1 :] if out else w[:k] + "abcdefghijklmnopqrstuvwxyz*.-"[int(rng.integers(29))] + w[k:]
            changed = True
    return " ".join(words) if changed else None


@dataclass
class Model:
    """landmarks, their subsequence table, the whitening matrix, machine weights (bias last) and
    the logistic curve; base is the score where nothing was learnt."""

    landmarks: list[str]
    table: np.ndarray
    whiten: np.ndarray
    weights: np.ndarray
    curve: tuple[float, float]
    base: float = 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(texts), self.base)
        x = embed(best_similarities(texts, self.table), self.whiten)
        return linear_svm.sigmoid(self.curve[0] * linear_svm.margin(x, self.weights) + self.curve[1]).astype(np.float64)


def choose_landmarks(sample: DataFrame, count: int = 96, tried: int = 600, least: float = 24.0) -> list[str]:
    """Words of 3 letters or more that tell the labels apart best, no two nearly alike: more
    frequent in toxic texts of the sample, with a chi-square of at least `least` (chance reaches
    24 once in a million words)."""
    cleaned = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\s]+", "")
    words = sample.select(F.col("toxic").cast("int").alias("y"), F.explode(F.array_distinct(F.split(cleaned, r"\s+"))).alias("word")).where(F.length("word") >= 3)
    n1, n = (sample.where("toxic = 1").count(), sample.count())
    n0 = n - n1
    c = words.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a >= 2")
    a, b = F.col("a"), F.col("b")
    chi = F.pow((a * (n0 - b) - b * (n1 - a)).cast("double"), F.lit(2.0)) * n / ((a + b) * F.greatest(n - a - b, F.lit(1)) * F.lit(float(n1)) * n0)
    top = c.where((a * n0 > b * n1) & (chi >= least)).orderBy(chi.desc(), "word").limit(tried).select("word").collect()
    found = [r[0] for r in top]
    if not found:
        return []
    vectors = table_of(found)
    alike = vectors.T @ vectors
    kept: list[int] = []
    for i in range(len(found)):
        if alike[i, i] > 0 and all(alike[i, j] < 0.9 for j in kept):
            kept.append(i)
        if len(kept) == count:
            break
    return [found[i] for i in kept]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, c: float = 1.0) -> Model:
    """Model learnt from docs (doc_id, text) and labels (doc_id, toxic), held-out rows and null
    labels left out. At most 2 * per_class rows are used, about as many of each label. A doc_id of
    several texts or labels counts once for each label, with the text of the least hash."""
    spark = docs.sparkSession
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out())
    chosen = written(at_most(thinned(known, "toxic", ["doc_id"], 2 * per_class)[0], ["toxic", "doc_id"], 2 * per_class), "toxicity-chosen")
    # the broadcast is bounded by 2 * per_class rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    sample = written(texts.groupBy("doc_id", "toxic").agg(one.alias("text")), "toxicity-sample")
    size = sample.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic")), F.lit(0))).first()
    empty = Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), (1.0, 0.0), size[1] / size[0] if size[0] else 0.0)
    if not size[0] or size[1] in (0, size[0]):
        return empty
    words = choose_landmarks(sample)
    if not words:
        return empty
    table = table_of(words)
    known_words = frozenset(words)
    sent = spark.sparkContext.broadcast(table)

    @F.arrow_udf(ArrayType(FloatType()))
    def describe(text: pa.Array) -> pa.Array:
        return pa.array([x for part in texts_of(text) for x in best_similarities(part, sent.value)], pa.list_(pa.float32()))

    @F.arrow_udf(StringType())
    def disguised(text: pa.Array, seed: pa.Array) -> pa.Array:
        every = (t for part in texts_of(text) for t in part)
        return pa.array([disguise(t, known_words, abs(h)) for t, h in zip(every, seed.to_pylist(), strict=True)], pa.string())

    plain = sample.select("toxic", "text", F.xxhash64("doc_id").alias("h"))
    hidden = plain.where("toxic = 1").withColumn("text", disguised(F.col("text"), F.col("h"))).where("text IS NOT NULL")
    rows = plain.unionByName(hidden).select("toxic", describe(F.col("text")).alias("x"), "h").toArrow()
    rows = rows.sort_by([("h", "ascending"), ("toxic", "ascending")])
    if not rows.num_rows:
        return empty
    x = np.array(rows["x"].to_pylist(), np.float32)
    y = np.array(rows["toxic"].to_pylist()) == 1
    kernel = sharpen(table.T @ table)
    value, vector = np.linalg.eigh(kernel.astype(np.float64))
    whiten = (vector / np.sqrt(np.maximum(value, 0.05))).astype(np.float32)
    x = embed(x, whiten)
    fold = rows["h"].to_numpy() % 4 == 0  # the curve is fitted to rows that the machine hasn't seen
    if min(y[fold].sum(), (~y[fold]).sum(), y[~fold].sum(), (~y[~fold]).sum()) < 3:
        fold = np.zeros(len(y), bool)
    weights = linear_svm.fit(x[~fold], np.where(y[~fold], 1, -1), c)
    seen = fold if fold.any() else ~fold
    curve = linear_svm.platt(linear_svm.margin(x[seen], weights), y[seen])
    return Model(words, table, whiten, weights, curve)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold), which replace columns of
    those names. Null and empty texts get the score of a text without words, very long ones are taken
    whole. Rows are judged one by one, so repeated rows repeat; only the text counts. An empty table
    gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(sent.value.score(part) for part in texts_of(text))]), pa.float64())

    return docs.withColumn("score", scored(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
