"""Hierarchical language identification (operator 4).

First the family of a text is predicted, then one-versus-one linear support vector machines separate the languages of that family. Both levels see the same
features: the square roots of the relative frequencies of hashed byte trigrams of the lower-cased letters of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _kind
from .runtime import release, smallest, steps

#: Labelled rows of each language that the machines are fitted on at most (those of the smallest hashes), and the characters of each at most.
TRAIN_ROWS = 500
TRAIN_CHARS = 500_000
FEATURE_BITS = 13
UNDETERMINED = "und"
#: Families of languages by ISO 639-1 code; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "sinitic": ("yue", "zh"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_SIZE = 1 << FEATURE_BITS
#: ASCII other than lower-case letters counts as a blank.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is divisible by 5 (a null id counts as empty text: held out)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def features(texts: list[str]) -> np.ndarray:
    """A row of 2**FEATURE_BITS numbers per text, of length 1, or 0 for a text without trigrams."""
    out = np.zeros((len(texts), _SIZE), np.float32)
    for row, text in enumerate(texts):
        data = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b"  ", np.uint8)
        wide = data.astype(np.uint32)
        codes = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(32 - FEATURE_BITS)
        codes = codes[data[1:-1] != 32]
        if len(codes):
            out[row] = np.sqrt(np.bincount(codes, minlength=_SIZE) / len(codes))
    return out


def support_vectors(x: np.ndarray, positive: np.ndarray, cost: float = 20.0, epochs: int = 60, rows: np.ndarray | None = None, products: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with hinge loss, by dual coordinate descent on the Gram matrix; both classes weigh the same.

    rows: the rows of x (positive is of them) that are learned from, all if not given; products: x @ x.T, if it is there already. x is not copied."""
    rows = np.arange(len(x)) if rows is None else rows
    y = np.where(positive, 1.0, -1.0)
    gram = (x @ x.T if products is None else products)[np.ix_(rows, rows)].astype(np.float64)
    gram += 1.0  # the bias is a constant feature
    most = cost * len(y) / (2 * np.where(positive, max(1, positive.sum()), max(1, (~positive).sum())))
    alpha, margin, rng = np.zeros(len(y)), np.zeros(len(y)), np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] + (1 - y[i] * margin[i]) / gram[i, i], 0.0), most[i])
            step = new - alpha[i]
            if step:
                margin += step * y[i] * gram[i]
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    weights = np.zeros(len(x), x.dtype)
    weights[rows] = alpha * y
    return (weights @ x).astype(np.float32), float(alpha @ y)


class Duels:
    """One-versus-one machines among some names; with a single name it always wins."""

    def __init__(self, names: list[str], x: np.ndarray, labels: np.ndarray, products: np.ndarray):
        self.names, self.pairs = names, list(combinations(range(len(names)), 2))
        fitted = []
        for a, b in self.pairs:
            rows = np.flatnonzero((labels == names[a]) | (labels == names[b]))
            fitted.append(support_vectors(x, labels[rows] == names[a], rows=rows, products=products))
        self.weights = np.array([w for w, _ in fitted], np.float32).reshape(-1, _SIZE)
        self.bias = np.array([b for _, b in fitted], np.float32)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the winner (most duels won, then the largest sum of margins) and its confidence, from its closest duel."""
        n = len(x)
        if not self.pairs:
            return np.zeros(n, np.int64), np.ones(n)
        margins = x @ self.weights.T + self.bias
        wins, total, worst = np.zeros((n, len(self.names))), np.zeros((n, len(self.names))), np.full((n, len(self.names)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            for name, margin in ((a, margins[:, k]), (b, -margins[:, k])):
                wins[:, name] += margin > 0
                total[:, name] += margin
                worst[:, name] = np.minimum(worst[:, name], margin)
        best = np.argmax(wins + 0.5 * np.tanh(total) / np.pi, axis=1)
        return best, 1 / (1 + np.exp(-3 * worst[np.arange(n), best]))


class Model:
    """Families, then the languages of each."""

    def __init__(self, texts: list[str], languages: list[str]):
        labels = np.array(languages, object)
        x = features(texts)
        family = np.array([_FAMILY.get(code, code) for code in languages], object)
        names = sorted(set(family))
        products = x @ x.T
        self.families = Duels(names, x, family, products)
        self.within = [Duels(sorted(set(labels[family == f])), x, labels, products) for f in names]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a confidence from 0 to 1. A text without letters is undetermined, with 0."""
        names = np.full(len(texts), UNDETERMINED, object)
        scores = np.zeros(len(texts))
        some = np.flatnonzero([any(map(str.isalpha, text)) for text in texts])
        if len(some) and self.within:
            x = features([texts[i] for i in some])
            family, sure = self.families.decide(x)
            for f, duels in enumerate(self.within):
                rows = np.flatnonzero(family == f)
                if len(rows):
                    best, own = duels.decide(x[rows])
                    names[some[rows]] = np.array(duels.names, object)[best]
                    scores[some[rows]] = sure[rows] * own
        return names.tolist(), scores


def fit(df: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_chars: int = TRAIN_CHARS) -> Model:
    """A model of the rows with a language that aren't held out: of each language the train_rows (all, if fewer) with the smallest hashes of id and text.

    Whole texts of train_chars at most are learned from; longer ones, null ones and those without letters teach nothing, and repeated rows once. So the driver gets
    train_rows texts a language at any size of the table. Without any such row the model says undetermined for all."""
    text = F.col(text_col).cast("string")
    known = df.where(F.col(lang_col).isNotNull() & ~held_out(id_col) & (F.char_length(text) <= train_chars) & text.rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text).alias("turn"), text.alias("text"))
    chosen = smallest(known, "lang", "turn", train_rows)
    rows = known.join(F.broadcast(chosen), ["lang", "turn"]).dropDuplicates(["lang", "turn"])  # chosen: train_rows a language
    taken = sorted((r.lang, r.turn, r.text) for r in rows.collect())
    return Model([t for _, _, t in taken], [lang for lang, _, _ in taken])


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, lang_pred string, score double (0 to 1).

    Only the text is looked at, all of it. A text that is null, empty or without any letter is `und` with score 0. Repeated rows stay. Without shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = shared.value
        for part, texts in steps(batches, "text"):
            names, scores = own.predict(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    columns = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, f"id {_kind(df, id_col)}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(df: DataFrame, model: Model, least_score: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows of df whose language is determined, with a score of least_score or more; all columns stay as they are."""
    shared, schema = df.sparkSession.sparkContext.broadcast(model), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = shared.value
        for part, texts in steps(batches, text_col):
            names, scores = own.predict(texts)
            yield part.filter(pa.array([n != UNDETERMINED and s >= least_score for n, s in zip(names, scores, strict=True)]))

    return df.mapInArrow(run, schema)
