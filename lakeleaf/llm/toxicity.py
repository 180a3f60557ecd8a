"""Toxicity by a bag of subword embeddings (operator 10).

A word is the bag of its character n-grams and itself; each hashes to an embedding. A text is the mean of the embeddings of all its subwords, each
weighted down as it is frequent, which a linear softmax classifies. Embeddings and softmax are trained together in numpy. A misspelling shares most of its n-grams with the word it is made from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _kind
from .language import held_out
from .runtime import cut, held, smallest, steps

#: Labelled toxic rows that the model is fitted on at most (those of the smallest hashes), clean ones for each of them, and the characters of each at most.
TRAIN_ROWS = 1200
CLEAN_ROWS = 3
TRAIN_CHARS = 500_000
BUCKET_BITS = 17
DIMENSIONS = 8
ORDERS = (3, 4, 5)
THRESHOLD = 0.5
#: Neutral words that a mean is taken over besides a text's distinct ones, each as frequent as those: a few words, however often repeated, say little.
PRIOR = 20
#: Words whose sums one worker keeps; the store is emptied when it is full.
KEPT_WORDS = 250_000
KEPT_CHARS = 64
#: A subword's embedding counts RARE / (RARE + its share of all subwords).
RARE = 3e-5
#: Texts that a step of training multiplies at once.
_TEXTS = 500
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bucket of each subword of the words: n-grams of the characters between < and >, and the word as a whole."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = ["<" + word + ">" for word in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    number = np.repeat(np.arange(len(words)), sizes)
    shift = np.uint64(64 - BUCKET_BITS)
    owners, buckets = [], []
    mixed = codes.copy()
    for n in range(2, max(ORDERS) + 1):
        mixed = mixed[:-1] * np.uint64(1_000_003) + codes[n - 1 :]
        if n in ORDERS:
            inside = number[: len(mixed)] == number[n - 1 :]
            owners.append(number[: len(mixed)][inside])
            buckets.append(((mixed[inside] + np.uint64(n)) * _SPREAD) >> shift)
    # A word as a whole: a sum over its characters, each weighted by its place.
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weighted = (codes + np.uint64(1)) * _SPREAD * (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1))
    weighted ^= weighted >> np.uint64(29)
    whole = np.add.reduceat(weighted, np.cumsum(sizes) - sizes)
    owners.append(np.arange(len(words)))
    buckets.append((whole * _SPREAD) >> shift)
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def _tokens(text: str) -> list[str]:
    return text.lower().split()


def _widened(tokens: list[str]) -> float:
    """What the neutral words make of the number of words that a mean is taken over."""
    return 1 + PRIOR / max(1, len(set(tokens)))


def _letters(token: str) -> str:
    """A token without what isn't a letter at its ends and within, so that marks can't hide a word."""
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a sparse matrix: starts, buckets and shares of each text's subwords."""
    starts, columns, values = [0], [], []
    for text in texts:
        tokens = _tokens(text)
        found = Counter(filter(None, map(_letters, tokens)))
        owner, bucket = subwords(list(found))
        often = np.fromiter(found.values(), np.float64, len(found))
        if len(bucket):
            distinct, place = np.unique(bucket, return_inverse=True)
            total = np.bincount(place, weights=often[owner])
            columns.append(distinct.astype(np.int32))
            values.append((total / (total.sum() * _widened(tokens))).astype(np.float32))
            starts.append(starts[-1] + len(distinct))
        else:
            columns.append(np.zeros(1, np.int32))
            values.append(np.zeros(1, np.float32))
            starts.append(starts[-1] + 1)
    return np.array(starts), np.concatenate(columns), np.concatenate(values)


class Model:
    """What scoring needs: for each bucket its embedding's part in the difference of the two logits, and the bias."""

    def __init__(self, texts: list[str], toxic: list[int], rounds: int = 70, rate: float = 0.1, seed: int = 11):
        size, y = 1 << BUCKET_BITS, np.array(toxic, np.float64)
        self.part, self.bias = np.zeros(size, np.float32), 0.0
        if not len(y) or y.min() == y.max():
            self.bias = -4.0 if not len(y) or not y.max() else 4.0
            return
        starts, columns, values = _counts(texts)
        shares = np.bincount(columns, weights=values, minlength=size) / len(y)
        frequent = (RARE / (RARE + shares)).astype(np.float32)
        values *= frequent[columns]
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (size, DIMENSIONS))
        softmax = rng.normal(0, 0.1, (DIMENSIONS, 2))
        bias = np.zeros(2)
        speeds = [np.zeros_like(x) for x in (table, softmax, bias)]
        for step in range(rounds):
            # The mean of a text's embeddings times the softmax: the sparse matrix is applied to one number a bucket.
            lean = (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
            pull, error = np.zeros(size), np.zeros(len(y))  # pull: the loss by each bucket's part of a logit
            for i in range(0, len(y), _TEXTS):
                j = min(i + _TEXTS, len(y))
                own, share = columns[starts[i] : starts[j]], values[starts[i] : starts[j]]
                logit = np.add.reduceat(share * lean[own], starts[i:j] - starts[i]) + bias[1] - bias[0]
                error[i:j] = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[i:j]) * weight[i:j]
                pull += np.bincount(own, weights=share * np.repeat(error[i:j].astype(np.float32), np.diff(starts[i : j + 1])), minlength=size)
            slope = pull @ table
            gradients = np.outer(pull, softmax[:, 1] - softmax[:, 0]), np.stack([-slope, slope], 1), np.array([-error.sum(), error.sum()])
            for x, g, speed in zip((table, softmax, bias), gradients, speeds, strict=True):
                # One step size for a whole tensor: rare subwords, of which a single text could be learned by heart, move as little as they count.
                speed *= 0.9
                speed += g / (np.abs(g).max() + 1e-12)
                x -= rate * (1 - step / rounds) * speed
        self.part = (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32) * frequent
        self.bias = float(bias[1] - bias[0])


class Scorer:
    """Scores whole texts; keeps the sum and number of subwords of frequent words."""

    def __init__(self, model: Model):
        self.model, self.kept = model, {}

    def _learn(self, tokens: set[str]) -> None:
        tokens = list(tokens)
        words = list(map(_letters, tokens))
        some = [i for i, word in enumerate(words) if word]
        owner, bucket = subwords([words[i] for i in some])
        sums = np.bincount(owner, weights=self.model.part[bucket], minlength=len(some))
        numbers = np.bincount(owner, minlength=len(some))
        self.kept.update(dict.fromkeys(tokens, 0j))
        self.kept.update(zip([tokens[i] for i in some], (sums + 1j * numbers).tolist(), strict=True))

    def score(self, texts: list[str]) -> np.ndarray:
        found = [_tokens(text) for text in texts]
        new = set().union(*found) - self.kept.keys()
        if new:
            if len(self.kept) + len(new) > KEPT_WORDS:
                self.kept.clear()
                new = set().union(*found)
            self._learn(new)
        get = self.kept.__getitem__
        total = np.array([sum(map(get, tokens)) for tokens in found], np.complex128)  # sums and numbers at once
        for token in new:
            if len(token) > KEPT_CHARS:
                del self.kept[token]
        wide = np.array([_widened(tokens) for tokens in found])
        logit = total.real / np.maximum(total.imag * wide, 1) + self.model.bias
        logit = np.where(total.imag > 0, logit, min(self.model.bias, -4.0))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_chars: int = TRAIN_CHARS
) -> Model:
    """A model of the labelled rows that aren't held out: train_rows toxic and CLEAN_ROWS as many clean ones (all, if fewer), those of the smallest hashes.

    Of several labels of an id the largest counts; null ids and labels teach nothing. Whole texts of train_chars at most are learned from, longer and null ones
    are not; rows of the same id and text teach once. First ids are chosen by class and then texts, so the driver gets so many texts at any size of the tables,
    also where one id has very many. With labels of one class only, or none, every text gets one same score."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("turn")).where(F.char_length("text") <= train_chars)
    most = F.when(F.col("y") == 1, train_rows).otherwise(train_rows * CLEAN_ROWS)
    ids = known.select("y", F.xxhash64(F.col("label_id").cast("string")).alias("turn"), "label_id")
    ids = ids.join(F.broadcast(smallest(ids, "y", "turn", 2 * most)), ["y", "turn"]).select("label_id", "y")  # some ids have no text, so twice as many
    rows = texts.join(F.broadcast(cut(ids)), F.col("id") == F.col("label_id")).select("y", "turn", "text")
    rows = rows.join(F.broadcast(smallest(rows, "y", "turn", most)), ["y", "turn"]).dropDuplicates(["turn"])
    taken = sorted((r.y, r.turn, r.text) for r in rows.collect())
    return Model([t for _, _, t in taken], [y for y, _, _ in taken])


class _Shared:
    """A broadcast model with a number that tells it from others in a reused worker."""

    def __init__(self, df: DataFrame, model: Model):
        import uuid

        self.held, self.id = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @property
    def value(self) -> Model:
        return self.held.value


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, score double (0 to 1), predicted int (1 if score >= 0.5).

    Only the text is looked at, all of it. A text that is null, empty or without letters has a low score and is never predicted toxic. Repeated rows stay. Without shuffle."""
    shared = _Shared(df, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("toxicity", shared.id), lambda: Scorer(shared.value))
        for part, texts in steps(batches, "text"):
            found = scorer.score(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    columns = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, f"id {_kind(df, id_col)}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of df that score below the threshold; all columns stay as they are."""
    shared, schema = _Shared(df, model), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("toxicity", shared.id), lambda: Scorer(shared.value))
        for part, texts in steps(batches, text_col):
            yield part.filter(pa.array(scorer.score(texts) < threshold))

    return df.mapInArrow(run, schema)
