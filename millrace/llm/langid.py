"""Language identification with a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: how many distinct character n-grams (1 to 3, within
words and their edges) both hold, divided by the root of the product of their own counts, over the n-grams that any
landmark holds. A bounded sample of labelled texts is the training set; a part of it, spread over the languages, are
Nystroem landmarks. A text's features are its kernel values against the landmarks times the inverse root of the
landmarks' kernel matrix; one-versus-rest kernel ridge regression fits a weight column a language. Prediction is batched: n-gram presence rows of a block of texts times
the landmarks' presence matrix, then times the fitted matrix.

The sample: for each language and each of BUCKETS hash buckets, the labelled text of the smallest hash, so at most
BUCKETS texts a language, exact copies counting once. Everything else covers whole texts of all rows.

Defined results: a null text or one without a letter is "und" with score 0; null labels teach nothing; without
any labelled text with a letter every text is "und"; repeated rows are predicted alike; an empty table gives an
empty result. The label, source and id are never inputs of a prediction. Nothing is shuffled but the sample.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Recent, hand_back_memory, map_texts, written

UND = "und"
#: Longest n-gram; 21 bits a character let three stand in 63 bits.
SPECTRUM = 3
#: Training texts a language at most, and how many of them are landmarks.
BUCKETS, LANDMARKS = 96, 24
#: Rows of the sample's keys up to which they are broadcast.
FEW = 100_000
#: Lengths, in characters, of texts that the sample prefers.
LENGTHS = (150, 12_000)
#: Ridge of the regression, and how sharply margins become scores.
RIDGE, SHARPNESS = 1e-2, 6.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between blanks, and the word that each belongs to; signs and digits are blanks."""
    found = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return np.where(found < 65, np.uint32(32), found).astype(np.int64), np.repeat(np.arange(len(words)), lengths)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Exact keys of all n-grams of 1 to SPECTRUM characters within words, repeats included, and their words."""
    at, word = codes(words)
    out, keys = [(at, word)], at
    for n in range(1, SPECTRUM):
        keys = (keys[:-1] << 21) | at[n:]
        inside = word[:-n] == word[n:]
        out.append((keys[inside], word[:-n][inside]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


class Vocabulary:
    """The kernel's n-grams: a hashed table from their exact keys to columns, and what is known of words."""

    def __init__(self, keys: np.ndarray):
        self.size = len(keys)
        bits = max(12, int(8 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.columns = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slots[left]] < 0
            tried, first = np.unique(slots[left][free], return_index=True)
            put = left[free][first]
            self.keys[tried], self.columns[tried] = keys[put], put
            left = np.setdiff1d(left, put, assume_unique=True)
            slots[left] = (slots[left] + 1) & self.mask
        self.words = Recent(200_000)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """The columns of keys, -1 for those that are in none."""
        out, open_ = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        slots = self._slot(keys)
        while len(open_):
            there = self.keys[slots]
            hit = there == keys
            out[open_[hit]] = self.columns[slots[hit]]
            on = ~hit & (there >= 0)
            open_, keys, slots = open_[on], keys[on], (slots[on] + 1) & self.mask
        return out

    def _columns_of(self, words: list[str]) -> list[bytes]:
        """The columns of each word's n-grams as little-endian 32-bit bytes."""
        out = []
        for k in range(0, len(words), 20_000):
            some = words[k : k + 20_000]
            keys, word = grams(some)
            columns = self.look(keys)
            known = columns >= 0
            columns, word = columns[known], word[known]
            order = np.argsort(word, kind="stable")
            raw, ends = columns[order].astype("<u4").tobytes(), np.searchsorted(word[order], np.arange(len(some) + 1)) * 4
            out += [raw[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())]
        return out

    def presence(self, texts: list[str]) -> np.ndarray:
        """A row of 0 and 1 over the columns for each text."""
        rows = np.zeros((len(texts), self.size), np.float32)
        cuts = [words_of(t) for t in texts]
        get = self.words.resolve(set().union(*cuts), self._columns_of).__getitem__
        for row, cut in zip(rows, cuts, strict=True):
            row[np.frombuffer(b"".join(map(get, cut)), "<u4")] = 1
        return rows


@dataclass
class Model:
    """What prediction needs: the vocabulary, landmarks' presence over it, and the fitted matrix."""

    languages: list[str]
    keys: np.ndarray
    landmarks: np.ndarray  # n-grams x landmarks, scaled by the root of each landmark's count
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def __post_init__(self):
        self.vocabulary = Vocabulary(self.keys)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "vocabulary"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.vocabulary = Vocabulary(self.keys)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalised kernel values of texts against the landmarks."""
        out = np.empty((len(texts), self.landmarks.shape[1]), np.float32)
        for k in range(0, len(texts), 64):
            rows = self.vocabulary.presence(texts[k : k + 64])
            out[k : k + 64] = rows @ self.landmarks / np.sqrt(np.maximum(1, rows.sum(1)))[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language and a score from 0 to 1 for each text."""
        real = [k for k, t in enumerate(texts) if self.languages and has_letter(t)]
        labels, scores = [UND] * len(texts), [0.0] * len(texts)
        if real:
            margins = (self.kernel([texts[k] for k in real]) @ self.weights + self.bias).astype(np.float64) * SHARPNESS
            odds = np.exp(margins - margins.max(1, keepdims=True))
            odds /= odds.sum(1, keepdims=True)
            best = odds.argmax(1)
            for k, row, j in zip(real, odds, best, strict=True):
                labels[k], scores[k] = self.languages[j], float(row[j])
        return labels, scores


def fit(texts: list[str], labels: list[str]) -> Model:
    """One-versus-rest kernel ridge regression on Nystroem features; LANDMARKS texts of each language are landmarks."""
    known = [(t, y) for t, y in zip(texts, labels, strict=True) if has_letter(t)]
    languages = sorted({y for _, y in known})
    if not known:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros(0, np.float32))
    taken: dict[str, int] = {}
    marks = []
    for t, y in known:
        if taken.get(y, 0) < LANDMARKS:
            taken[y] = taken.get(y, 0) + 1
            marks.append(t)
    sets = [np.unique(grams(words_of(t))[0]) for t in marks]
    keys = np.unique(np.concatenate(sets))
    model = Model(languages, keys, np.zeros((len(keys), len(marks)), np.float32), np.zeros((len(marks), len(languages)), np.float32), np.zeros(len(languages), np.float32))
    for j, found in enumerate(sets):
        column = np.isin(keys, found, assume_unique=True)
        model.landmarks[:, j] = column / np.sqrt(max(1, column.sum()))
    gram = (model.landmarks.T @ model.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = model.kernel([t for t, _ in known]).astype(np.float64) @ root
    targets = np.array([[1.0 if y == lang else -1.0 for lang in languages] for _, y in known])
    weight = 1 / np.array([sum(z == y for _, z in known) for _, y in known], np.float64)
    weight *= len(known) / weight.sum()
    mean, middle = np.average(features, 0, weight), np.average(targets, 0, weight)
    x, y = features - mean, targets - middle
    fitted = np.linalg.solve((x * weight[:, None]).T @ x + RIDGE * len(known) / len(languages) * np.eye(x.shape[1]), (x * weight[:, None]).T @ y)
    model.weights = (root @ fitted).astype(np.float32)
    model.bias = (middle - mean @ fitted).astype(np.float32)
    return model


def sample(docs: DataFrame, teaches: Column, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """label and text of the training sample: the least hash of each language and bucket, preferring LENGTHS."""
    length = F.length(text_col)
    odd = F.when(length.between(*LENGTHS), F.lit(0)).otherwise(F.lit(1)).cast("long")
    key = F.shiftleft(odd, 61) + F.shiftrightunsigned(F.xxhash64(text_col), 3)
    slim = docs.where(teaches & F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    slim = slim.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), key.alias("key"))
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS))
    least = written(slim.groupBy("label", bucket.alias("bucket")).agg(F.min("key").alias("key")).select("label", "key"), "langid-sample")
    found = slim.join(F.broadcast(least) if least.count() <= FEW else least, ["label", "key"])  # BUCKETS rows a language
    return found.groupBy("label", "key").agg(F.min("text").alias("text"))


def fit_on(docs: DataFrame, teaches: Column, text_col: str = "text", label_col: str = "lang") -> Model:
    rows = sorted((r.label, r.key, r.text) for r in sample(docs, teaches, text_col, label_col).collect())
    return fit([r[2] for r in rows], [r[0] for r in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each text."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make(block: pa.RecordBatch) -> list[pa.Array]:
        labels, scores = _model(shared).predict(block.column("text").to_pylist())
        return [block.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())]

    return map_texts(slim, make, "doc_id long, lang_pred string, score double")


_models: dict[int, Model] = {}


def _model(shared) -> Model:
    """The model of a broadcast, built once a worker; one is kept."""
    key = hash(shared.value)
    if key not in _models:
        _models.clear()
        _models[key] = pickle.loads(shared.value)
    return _models[key]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, by a model of those not held out."""
    model = fit_on(docs, ~held_out())
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def kept_documents(docs: DataFrame, least_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """The documents whose language is told with some certainty, with all their columns.

    Texts that are null or have no letter go; without labelled texts all documents go. Ids aren't read, repeated rows
    are judged alike, and an empty table stays empty. The model is fitted on the labelled texts of docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit_on(docs, F.lit(True), text_col)))

    def run(batches):
        for batch in batches:
            labels, scores = _model(shared).predict(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([y != UND and s >= least_score for y, s in zip(labels, scores, strict=True)], pa.bool_()))
        hand_back_memory()

    return docs.mapInArrow(run, docs.schema)
