"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is computed in
time linear in the features as half of the sum over factors of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2.

Labels are learned only from rows outside the held-out fold (crc32 of the id as text, mod 4, is 2),
and from at most SAMPLE of them, those of the least id hash; the bound is a parameter. Inputs of a
score come from the text alone: its words, hashed; ratios of its structure; and, as metadata, the
size class of the text. Labels, lang, source and doc_id are never inputs. All rows are scored.

Defined results: a null or empty text has the features of zero words and gets a score like any other;
very long texts are read whole; without usable labels every score is 0.5; an empty table gives an
empty table; repeated rows and rows with a null id are scored alike (a null id is not held out).
"""

from __future__ import annotations

import math
import zlib
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonoteca.llm import common

BITS, FACTORS, SAMPLE, EPOCHS, SEED = 14, 6, 6000, 24, 11
FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7
SYMBOLS = b"#*$%&|<>!=+@~^_{}[]\\/"
#: Slots of the structure statistics and of the size class, after those of the hashed words.
STATS, SIZES = 10, 16
SLOTS = (1 << BITS) + STATS + SIZES
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"


def structure(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    n, size = max(1, len(words)), max(1, len(text))
    lines = text.split(b"\n")
    return [
        min(1.0, 2 * (size - len(text.translate(None, SYMBOLS))) / n),
        (size - len(text.translate(None, UPPER))) / size * 3,
        (size - len(text.translate(None, DIGITS))) / size * 5,
        sum(a == b for a, b in pairwise(words)) / n,
        distinct / n,
        distinct / n**0.85 / 2,
        min(2.0, len(text) / n / 8),
        1 - len(set(lines)) / len(lines),
        min(1.0, len(lines) / n * 5),
        min(1.0, text.count(b".") / n * 5),
    ]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values; the words' part has unit length, so that long texts do not weigh more."""
    words = text.split()
    counts: dict[int, int] = {}
    distinct = set(words)
    mask = (1 << BITS) - 1
    for word in distinct:
        slot = zlib.crc32(word.lower()) & mask
        counts[slot] = counts.get(slot, 0) + 1
    stats = structure(text, words, len(distinct))
    slots = [*counts, *range(mask + 1, mask + 1 + STATS), mask + 1 + STATS + min(SIZES - 1, int(math.log2(len(text) + 1)))]
    values = np.array([*counts.values(), *stats, 1.0])
    head = len(counts)
    if head:
        values[:head] /= np.sqrt((values[:head] ** 2).sum())
    return np.array(slots, dtype=np.int64), values


class FactorisationMachine:
    #: Whether there was something to learn from.
    knows = True

    def __init__(self, slots: int = SLOTS, factors: int = FACTORS, seed: int = SEED):
        self.bias, self.linear = 0.0, np.zeros(slots)
        self.factors = np.random.default_rng(seed).normal(0, 0.01, (slots, factors))

    def raw(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One value a row; rows lie one after another in slots and values, each with a feature or more."""
        weighted = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(weighted, starts)
        squares = np.add.reduceat((weighted**2).sum(1), starts)
        return self.bias + np.add.reduceat(self.linear[slots] * values, starts) + 0.5 * ((sums**2).sum(1) - squares)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(s) for s, _ in rows[:-1])])
        raw = self.raw(np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = SEED) -> FactorisationMachine:
        """AdaGrad over small batches; the classes weigh alike by half."""
        rng = np.random.default_rng(seed)
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 + 0.25 / share, 0.5 + 0.25 / (1 - share))
        g_bias, g_linear, g_factors = 1e-6, np.full(len(self.linear), 1e-6), np.full(self.factors.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for own in np.array_split(order, max(1, len(order) // batch)):
                slots, values = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                lengths = np.array([len(rows[i][0]) for i in own])
                starts, of = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.repeat(np.arange(len(own)), lengths)
                error = (1 / (1 + np.exp(-np.clip(self.raw(slots, values, starts), -30, 30))) - labels[own]) * weight[own] / len(own)
                weighted = self.factors[slots] * values[:, None]
                sums = np.add.reduceat(weighted, starts)
                slope = (error[of] * values)[:, None] * (sums[of] - weighted)
                touched, at = np.unique(slots, return_inverse=True)
                d_linear = np.bincount(at, error[of] * values, len(touched)) + decay * self.linear[touched]
                d_factors = np.stack([np.bincount(at, slope[:, f], len(touched)) for f in range(slope.shape[1])], 1) + decay * self.factors[touched]
                g_bias += error.sum() ** 2
                g_linear[touched] += d_linear**2
                g_factors[touched] += d_factors**2
                self.bias -= rate * error.sum() / math.sqrt(g_bias)
                self.linear[touched] -= rate * d_linear / np.sqrt(g_linear[touched])
                self.factors[touched] -= rate * d_factors / np.sqrt(g_factors[touched])
        return self


def featurised(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    def make():
        def of(texts: list[bytes]) -> list[list]:
            rows = [features(t) for t in texts]
            return [[s for s, _ in rows], [v for _, v in rows]]

        return of

    return common.map_texts(docs, text_col, keep, "slots array<long>, vals array<double>", make)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> FactorisationMachine:
    """Train on the driver, from a sample of at most `sample` labelled rows outside the held-out fold."""
    marks = (
        labels.where(F.col("quality").isin(0, 1) & (common.doc_crc(F.col("doc_id")) % FOLDS != HELD_OUT))
        .groupBy(F.col("doc_id").alias(id_col))
        .agg(F.min("quality").cast("int").alias("__label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(sample)
    )
    chosen = docs.select(id_col, text_col).join(F.broadcast(marks), id_col).groupBy(id_col, "__label").agg(F.min(text_col).alias(text_col))  # at most `sample` ids
    got = featurised(chosen, [id_col, "__label"], text_col).toPandas().sort_values(id_col)
    labels_of = got["__label"].to_numpy(dtype=float) if len(got) else np.zeros(0)
    if not len(got) or labels_of.min() == labels_of.max():
        return untrained()
    rows = [(np.asarray(s, dtype=np.int64), np.asarray(v)) for s, v in zip(got["slots"], got["vals"])]
    return FactorisationMachine().fit(rows, labels_of)


def untrained() -> FactorisationMachine:
    """Without labels of both kinds: 0.5 for every text."""
    model = FactorisationMachine(factors=1)
    model.factors[:] = 0
    model.knows = False
    return model


def score(
    docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", model: FactorisationMachine | None = None, names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """Columns keep (the id alone if not given), score and predicted, under these names, of every row."""
    model = model or fit(docs, labels, id_col, text_col)

    def make():
        def of(texts: list[bytes]) -> list[list]:
            scores: list[float] = []
            for i in range(0, len(texts), 256):
                scores += model.score([features(t) for t in texts[i : i + 256]]).tolist()
            return [scores, [int(s >= ACCEPT) for s in scores]]

        return of

    return common.map_texts(docs, text_col, keep or [id_col], f"`{names[0]}` double, `{names[1]}` int", make)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(common.doc_crc(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False))
    return score(docs, labels).select("doc_id", held.alias("held_out"), "score", "predicted")


@common.apart
def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier does not reject, with the columns of docs, whatever their names.

    Without labels of both kinds it has learned nothing: then all rows stay, though each scores 0.5."""
    model = fit(docs, labels)
    if not model.knows:
        return docs
    return score(docs, labels, model=model, keep=docs.columns, names=("__score", "__predicted")).where("__predicted = 1").select(*docs.columns)
