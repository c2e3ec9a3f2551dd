r"""Quality rules: an isolation forest on rule statistics, its threshold calibrated on labelled rows.

Statistics of a text's words [^\x20\x09-\x0D]+ are computed for every whole text. Each tree grows on
SUBSAMPLE rows of its own, as the method is defined, drawn from all documents: those of the least hashes
of tree and id. All rows are scored, and the threshold comes from the counts of
all labelled rows by score: the score from which a row is anomalous is chosen for the largest share of
rejected rows of label 0 less WEIGHT times the share of rejected rows of label 1.

Defined results: null and empty texts have zero statistics and fail the base rules (fewer than 50
words); no labels at all: only the base rules decide; an empty table gives an empty table; a null id
is kept; repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fonoteca.llm import common

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
TREES, SUBSAMPLE, WEIGHT = 100, 256, 10.0
#: So many times the rows that trees need are expected to be told apart by their hashes before they are ranked.
DRAWN = 4
#: Scores from 0 to 1 are told apart in so many steps where they are counted.
LEVELS = 10_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"


def counts_of(text: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    words = common.words_of(text)
    points = len(text) - len(text.translate(None, CONTINUATION)) if not text.isascii() else 0
    chars = len(text) - points - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeated = len(lines) - len(set(lines))
    return len(words), chars, symbols, repeated, repeat_words(words), words


CONTINUATION = bytes(range(0x80, 0xC0))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def features_of(text: bytes, counted: tuple) -> list[float]:
    """Ratios that do not grow with the text: what the forest sees."""
    n, chars, symbols, dup, repeat, words = counted
    if not n:
        return [0.0] * 7
    distinct = len(set(words))
    upper = sum(map(text.count, UPPER))
    lines = text.count(b"\n") + 1
    same = sum(a == b for a, b in pairwise(words))
    return [
        math.log1p(symbols / n * 100),
        math.log1p(dup / lines * 100),
        math.log1p(repeat / n * 100),
        upper / max(1, chars),
        math.log1p(same / n * 100),
        distinct / n ** 0.85,
        chars / n,
    ]


UPPER = [bytes([c]) for c in range(65, 91)]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make():
        def of(texts: list[bytes]) -> list[list]:
            columns: list[list] = [[] for _ in range(len(COUNTS) + 1)]
            for text in texts:
                counted = counts_of(text)
                for column, value in zip(columns, (*counted[:5], features_of(text, counted))):
                    column.append(value)
            return columns

        return of

    return common.map_texts(docs, text_col, [id_col], FIELDS, make)


class IsolationForest:
    """Random axis-parallel splits; the mean path length to a row, scaled to the usual score."""

    def __init__(self, samples: list[np.ndarray], seed: int = 7):
        """samples: the rows of each tree."""
        rng = np.random.default_rng(seed)
        self.size = max(map(len, samples))
        self.depth = max(1, math.ceil(math.log2(max(2, self.size))))
        self.trees = [self._grow(rows, rng) for rows in samples]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """A complete binary tree in arrays: feature (-1: leaf), split and path length of each node."""
        nodes = 2 ** (self.depth + 1)
        feature, split, length = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        waiting = [(1, 0, rows)]
        while waiting:
            node, depth, own = waiting.pop()
            spread = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 else []
            if depth == self.depth or not len(spread):
                length[node] = depth + usual_length(len(own))
                continue
            feature[node] = f = rng.choice(spread)
            split[node] = rng.uniform(own[:, f].min(), own[:, f].max())
            left = own[:, f] < split[node]
            waiting += [(2 * node, depth + 1, own[left]), (2 * node + 1, depth + 1, own[~left])]
        return feature, split, length

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, length in self.trees:
            node = np.ones(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                go = f >= 0
                node = np.where(go, 2 * node + (rows[each, f] >= split[node]), node)
            total += length[node]
        return 2.0 ** -(total / len(self.trees) / max(usual_length(self.size), 1e-9))


def usual_length(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def drawn(docs: DataFrame, id_col: str = "doc_id", trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """tree, id: for each tree `subsample` ids of all documents (all, if fewer), those of the least hashes of tree and id.

    Hashes above what DRAWN times as many rows are expected below are left out first, so few rows are ranked.
    """
    ids = docs.select(F.col(id_col).alias("id")).dropna().distinct()
    share = min(1.0, DRAWN * subsample / max(ids.count(), 1))
    below = F.lit(int(share * (1 << 31)))
    hashed = lambda t: F.pmod(F.xxhash64(t, "id"), F.lit(1 << 31))
    of = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hashed(t) < below)
    rows = ids.select("id", F.explode(of).alias("tree")).withColumn("h", hashed(F.col("tree")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("h", "id"))
    return rows.withColumn("place", place).where(F.col("place") <= subsample).select("tree", "id")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, subsample: int = SUBSAMPLE) -> IsolationForest | None:
    """A forest each of whose trees grows on its own rows of all documents; of texts of one id the first in order.

    At most `trees` times `subsample` ids are sent to tasks, and their statistics to the driver.
    """
    chosen = common.materialise(drawn(docs, id_col, trees, subsample))
    ids = chosen.select(F.col("id").alias(id_col)).distinct()
    texts = docs.select(id_col, text_col).join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.min(text_col).alias(text_col))
    rows = {r[id_col]: r["features"] for r in statistics(texts, id_col, text_col).select(id_col, "features").collect()}
    own: dict[int, list] = {}
    for r in chosen.orderBy("tree", "id").collect():
        own.setdefault(r["tree"], []).append(rows[r["id"]])
    return IsolationForest([np.array(own[t]) for t in sorted(own)]) if own else None


def threshold(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", weight: float = WEIGHT) -> float:
    """The score below which rows are kept, from all labelled rows that the base rules keep; without both labels there is none.

    Scores are counted in LEVELS steps, so that what comes to the driver does not grow with the labels.
    """
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias(id_col)).agg(F.min("quality").alias("__q"))
    level = F.least(F.floor(F.col("anomaly") * LEVELS), F.lit(LEVELS - 1)).alias("level")
    rows = scored.where("not base_failed").join(marks, id_col).groupBy(level, "__q").count().collect()  # 2 * LEVELS at most
    counts = np.zeros((2, LEVELS), dtype=np.int64)
    for at, quality, n in rows:
        counts[quality, at] += n
    return calibrated(counts[0], counts[1], weight) if counts.sum(1).all() else math.inf


def calibrated(bad: np.ndarray, good: np.ndarray, weight: float) -> float:
    """The upper end of the level at which most bad rows are above, less the weighted share of good ones above."""
    rejected_bad = 1 - np.cumsum(bad) / bad.sum()
    rejected_good = 1 - np.cumsum(good) / good.sum()
    held = np.flatnonzero(bad + good)
    return float(held[np.argmax((rejected_bad - weight * rejected_good)[held])] + 1) / len(bad)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, anomaly (0 to 1) and kept of every row."""
    forest = fit(docs, id_col, text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = np.array(batch.column("features").to_pylist()).reshape(batch.num_rows, -1)
            scores = forest.score(rows) if forest and len(rows) else np.zeros(len(rows))
            n, repeat = (batch.column(c).to_numpy() for c in ("n_words", "n_repeat_words"))
            failed = base_failed(n, repeat)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(scores), pa.array(failed)],
                names=[*batch.schema.names[:-1], "anomaly", "base_failed"],
            )

    stats = statistics(docs, id_col, text_col)
    kind = stats.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    scored = common.materialise(stats.mapInArrow(run, f"`{id_col}` {kind}, {counts}, anomaly double, base_failed boolean"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold(scored, labels, id_col)))
