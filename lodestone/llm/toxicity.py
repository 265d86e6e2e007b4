"""Toxicity by a classifier chain of linear models over hashed word features."""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import ship, text_or_empty

#: Bound of the fit: labelled rows.  Folds of the out-of-fold predictions.
MAX_ROWS, FOLDS = 10_000, 5
#: Besides words, features are words' beginnings of this length: endings vary more than stems.
STEM = 5
#: Features are hashed into so many places; nothing is left out.
PLACES = 1 << 18
#: Weight decay of the fit, its steps at most, and the probability at which a document is rejected.
DECAY, STEPS, THRESHOLD = 3e-3, 60, 0.2
#: The chain: each label is predicted with the probabilities of those before it.
LABELS = ("quality", "toxic")
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Chain:
    """Linear models in chain order; each sees the words and the probabilities before it."""

    names: list[str]
    weights: np.ndarray  # (places, labels)
    links: np.ndarray  # (labels, labels), below the diagonal
    bias: np.ndarray

    def probabilities(self, linear: np.ndarray) -> np.ndarray:
        """From the word part of every label, (rows, labels)."""
        out = np.zeros_like(linear)
        for c in range(linear.shape[1]):
            out[:, c] = _sigmoid(linear[:, c] + out[:, :c] @ self.links[c, :c] + self.bias[c])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Rows of counts, as the places that each row counts once for each time it is named."""

    def __init__(self, places: list[np.ndarray], width: int):
        self.width = width
        # a place of its own without weight in each row, so that no row is empty
        self.lengths = np.array([len(p) + 1 for p in places], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if places else np.zeros(0, np.int64)
        self.places = np.concatenate([np.append(p, width) for p in places]).astype(np.int32) if places else np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.lengths)

    def take(self, which: np.ndarray) -> "Rows":
        out = Rows([], self.width)
        out.lengths = self.lengths[which]
        out.at = np.concatenate([[0], np.cumsum(out.lengths)[:-1]]).astype(np.int64) if len(out.lengths) else np.zeros(0, np.int64)
        out.places = self.places[np.repeat(which, self.lengths)]
        return out

    def times(self, weights: np.ndarray) -> np.ndarray:
        if not len(self):
            return np.zeros(0)
        return np.add.reduceat(np.append(weights, 0.0)[self.places], self.at)

    def gathered(self, values: np.ndarray) -> np.ndarray:
        """The values of the rows, summed up at each place."""
        return np.bincount(self.places, weights=np.repeat(values, self.lengths), minlength=self.width + 1)[:-1]


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """In the same order of sums each time, which threaded products do not promise."""
    return float((a * b).sum())


def minimised(f, x: np.ndarray, steps: int = STEPS, memory: int = 8, least: float = 1e-5) -> np.ndarray:
    """Where ``f`` (value and gradient, smooth and convex) is least: limited-memory BFGS with step
    halving, until a step gains less than ``least`` of the value."""
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, shares = slope.copy(), []
        for s, y, sy in reversed(moves):
            shares.append(_dot(s, way) / sy)
            way -= shares[-1] * y
        if moves:
            way *= moves[-1][2] / _dot(moves[-1][1], moves[-1][1])
        for (s, y, sy), share in zip(moves, reversed(shares)):
            way += s * (share - _dot(y, way) / sy)
        size = 1.0 if moves else min(1.0, 1 / max(np.abs(slope).sum(), 1e-12))
        down = _dot(slope, way)
        while True:
            new = x - size * way
            new_value, new_slope = f(new)
            if new_value <= value - 1e-4 * size * down or size < 1e-10:
                break
            size /= 2
        if new_value >= value:
            break
        s, y = new - x, new_slope - slope
        if (sy := _dot(s, y)) > 1e-12:
            moves = [*moves, (s, y, sy)][-memory:]
        gained, x, slope, value = value - new_value, new, new_slope, new_value
        if gained < least * abs(value):
            break
    return x


def fit_linear(rows: Rows, before: np.ndarray, y: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Logistic regression with weight decay on counts and ``before``, the probabilities before this
    label; the parameters: a weight a place, a link each, the bias."""
    n, k, width = len(rows), before.shape[1], rows.width

    def loss(w):
        margin = rows.times(w[:width]) + (before * w[width:-1]).sum(axis=1) + w[-1]
        off = (_sigmoid(margin) - y) / n
        value = (np.logaddexp(0, margin) - y * margin).mean() + decay * _dot(w[:-1], w[:-1]) / 2
        return value, np.concatenate([rows.gathered(off) + decay * w[:width], (before * off[:, None]).sum(axis=0) + decay * w[width:-1], [off.sum()]])

    return minimised(loss, np.zeros(width + k + 1))


def fit_chain(rows: Rows, y: np.ndarray, names: list[str], folds: int = FOLDS, decay: float = DECAY, groups: np.ndarray | None = None) -> Chain:
    """Fits the chain: a later model learns from out-of-fold predictions of the earlier ones.

    Predictions that a model makes on its own training rows look surer than they will be, so each
    label's probabilities for a fold come from a model that has not seen the fold.  Rows of one
    group (``groups``: integers, say a hash of the text) are in one fold; without, rows take turns.
    """
    n, c = y.shape
    fold = (np.arange(n) if groups is None else np.unique(groups, return_inverse=True)[1]) % folds
    seen = np.zeros((n, c))
    weights, links, bias = np.zeros((rows.width, c)), np.zeros((c, c)), np.zeros(c)
    for k in range(c):
        whole = fit_linear(rows, seen[:, :k], y[:, k], decay)
        weights[:, k], links[k, :k], bias[k] = whole[: rows.width], whole[rows.width : -1], whole[-1]
        if k + 1 < c:
            for f in range(folds):
                inside, outside = fold != f, fold == f
                if outside.any() and inside.any():
                    w = fit_linear(rows.take(inside), seen[inside, :k], y[inside, k], decay)
                    seen[outside, k] = _sigmoid(rows.take(outside).times(w[: rows.width]) + (seen[outside, :k] * w[rows.width : -1]).sum(axis=1) + w[-1])
    return Chain(names, weights, links, bias)


def _places(text: Column) -> Column:
    """The places of a text's distinct words, and of their beginnings marked with an asterisk."""
    words = F.filter(F.array_distinct(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), _SPLIT)), lambda w: w != "")
    stems = F.transform(F.filter(words, lambda w: F.char_length(w) >= STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    return F.transform(F.concat(words, stems), lambda w: F.pmod(F.xxhash64(w), F.lit(PLACES)).cast("int"))


def _place(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode(), seed=42) % PLACES


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.translate(_LOWER)))


def train(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = LABELS, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fits the chain on at most ``max_rows`` labelled rows, in the order of a hash of their id.

    ``names`` are columns of ``labels`` in chain order; the last one is what documents are
    rejected for.  Features are the words of a text and the words' beginnings, hashed into a fixed
    number of places; all words of all sampled texts count.  Equal texts are in one fold.  Rows with a null label
    and labels without a document are left out; repeated label rows and documents that share an id count
    once for each pair that joins; an empty sample gives a chain that rejects nothing.
    """
    given = [F.col(n).cast("double").alias(f"y{i}") for i, n in enumerate(names)]
    sample = labels.dropna(subset=[id_col, *names]).select(F.col(id_col).cast("long").alias("id"), *given)
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # at most max_rows short rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample), "id")
    ys = [f"y{i}" for i in range(len(names))]
    found = texts.select("id", *ys, F.xxhash64("text").alias("same"), _places(F.col("text")).alias("places"))
    table = found.toArrow().sort_by([("id", "ascending"), ("same", "ascending")])  # at most max_rows
    if not table.num_rows:
        return Chain(list(names), np.zeros((PLACES, len(names))), np.zeros((len(names), len(names))), np.full(len(names), -10.0))
    rows = Rows([p.values.to_numpy() for p in table.column("places")], PLACES)
    y = np.stack([table.column(c).to_numpy() for c in ys], axis=1)
    return fit_chain(rows, y, list(names), groups=table.column("same").to_numpy())


#: A word's place, and that of its beginning, in one number.
_SHIFT = PLACES.bit_length()


def _code(word: str) -> int:
    return _place(word) << _SHIFT | (_place(word[:STEM] + "*") if len(word) >= STEM else PLACES)


class Weights:
    """What texts' words add to each label; the places of a bounded number of short words are kept."""

    def __init__(self, chain: Chain, most: int = 100_000, longest: int = 64):
        self.chain, self.most, self.longest, self.known = chain, most, longest, {}
        self.weights = np.vstack([chain.weights, np.zeros((1, chain.weights.shape[1]))])

    def linear(self, text: str) -> np.ndarray:
        known, codes = self.known, []
        for word in _words(text):
            code = known.get(word)
            if code is None:
                code = _code(word)
                if len(word) <= self.longest and len(known) < self.most:
                    known[word] = code
            codes.append(code)
        at = np.sort(np.array(codes, np.int64))  # sums in the same order each time
        return self.weights[at >> _SHIFT].sum(axis=0) + self.weights[at & ((1 << _SHIFT) - 1)].sum(axis=0)


def _probabilities(weights: Weights, texts) -> np.ndarray:
    return weights.chain.probabilities(np.array([weights.linear(t) for t in texts]).reshape(len(texts), -1))


def _score(chain: Chain):
    def run(batches):
        weights = Weights(chain)
        for batch in batches:
            p = _probabilities(weights, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c]) for c in range(len(chain.names)))], ["doc_id", *(f"p_{c}" for c in chain.names)])

    return run


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, p_<category> in chain order, ``rejected``.

    Whole texts are scored.  Null texts count as empty and have no words; null ids and repeated
    rows are kept; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    scored = rows.mapInArrow(_score(chain), "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.names))
    return scored.withColumn("rejected", F.col(f"p_{chain.names[-1]}") >= threshold)


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the chain does not reject, with their columns as they were.

    Only texts go to Python; rows wait in the JVM.
    """
    ship(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def last(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = Weights(chain)
        for texts in batches:
            yield pd.Series(_probabilities(weights, texts)[:, -1], dtype="float64")

    return docs.where(last(text_or_empty(text_col)) < threshold)
