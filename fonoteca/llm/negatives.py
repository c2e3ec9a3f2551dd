"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

A vector gets one component more, such that all have one norm and anchors have 0 there: the larger an inner
product, the nearer the two then are, and distances have bounds. Pivots are taken from the vectors; an anchor
belongs to the pivot nearest to it, and the anchors of a pivot, in blocks, are a group that knows how near and
how far from its pivot they are. A row's distance to a pivot thus bounds its distances to a group's anchors,
and the row is sent only to the groups that it might serve, where the join is exact.

First come the positives: of the anchor's label, within the distance in which some block of rows is known to
have enough of them. These give each anchor the band of scores that negatives may have, and the second join
sends rows to the groups whose bands they can reach. A group's rows are dealt out over salts, so that no task
gets a group whole, and each task keeps the best few of an anchor only.

Rows without a label, id or vector, or with a component that is null or not finite, take no part. An id names
one row: of several rows with it the least by label and components is read. A shorter vector is one that ends
in zeros. Equal scores go by the smaller id. Scores must fit a long; components may be of any size that allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fonoteca.llm.common import give_up, materialise

#: Pivots, taken by the hash of their ids from all rows; a row has this many distances at most.
PIVOTS = 16
#: Groups at most, which is what is sent to tasks, and anchors of a group while they are fewer.
GROUPS, ANCHORS = 4096, 4096
#: Rows that a group gets in a task, on average at most.
ROWS = 1 << 16
#: Rows and anchors whose scores are held at a time.
BLOCK = 1024
#: What rounding may change a distance by, as a share of it and of the norm.
SLACK = 1e-6
FIRST = 5


def taken(vectors: DataFrame, every: int, shift: int, labels: int) -> DataFrame:
    """vec_id, label, q (components as longs), anchor: the rows that take part, with the labels that are shifted."""
    v = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(finite)
    label = F.when(F.col("vec_id") % shift == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))
    rows = v.select("vec_id", label.alias("label"), F.transform("x", lambda x: F.floor(x * 256)).alias("q"), (F.col("vec_id") % every == 0).alias("anchor"))
    if rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q", "anchor")).alias("r")).select("vec_id", "r.*")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A row a list, filled up with zeros."""
    lists = column if isinstance(column, pa.ListArray) else pa.array(column)
    offsets = lists.offsets.to_numpy()
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(offsets)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Space:
    """Pivots with the extra component, and the norm that all rows get by theirs."""

    def __init__(self, pivots: np.ndarray, norm2: float):
        self.norm2 = norm2
        self.pivots = np.column_stack((pivots, self.extra(pivots)))

    def extra(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(float)
        return np.sqrt(np.maximum(self.norm2 - np.einsum("ij,ij->i", rows, rows), 0))

    def distances(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """To each pivot; an anchor's extra component is 0."""
        x = np.column_stack((rows.astype(float), np.where(anchor, 0.0, self.extra(rows))))
        squares = (x**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(squares, 0))


def _long_list(rows: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def _reach(space: Space, width: int, need: int):
    """For each label of a run of rows and each pivot, the distance within which `need` of them are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in batches:
            label = batch.column(0).to_numpy()
            d = space.distances(matrix(batch.column(1), width), np.zeros(len(label), bool))
            order = np.argsort(label, kind="stable")
            begins = np.flatnonzero(np.append(True, np.diff(label[order]) != 0)) if len(label) else []
            for b, e in zip(begins, [*begins[1:], len(order)]):
                if e - b >= need:
                    yield pa.RecordBatch.from_pydict({"label": pa.array(np.full(len(space.pivots), label[order[b]])), "cell": pa.array(np.arange(len(space.pivots), dtype=np.int32)), "reach": pa.array(np.partition(d[order[b:e]], need - 1, axis=0)[need - 1])})

    return run


def _celled(space: Space, width: int):
    """vec_id, label, q, cell, d: each anchor's nearest pivot and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in batches:
            d = space.distances(matrix(batch.column(2), width), np.ones(batch.num_rows, bool))
            cell = d.argmin(1) if len(d) else np.zeros(0, int)
            arrays = [*batch.columns[:3], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "q", "cell", "d"])

    return run


def _distances(space: Space, width: int):
    """vec_id, label, q, ds: each row's distances to all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in batches:
            d = space.distances(matrix(batch.column(2), width), np.zeros(batch.num_rows, bool))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _long_list(d)], names=["vec_id", "label", "q", "ds"])

    return run


def _serving(space: Space, width: int, groups: np.ndarray, salts: int):
    """grp, salt, vec_id, label, q: the rows, once for each group whose band they can reach.

    groups: grp, cell, nearest and farthest anchor, least and largest distance that counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for batch in batches:
            d = space.distances(matrix(batch.column(2), width), np.zeros(batch.num_rows, bool))
            salt = pa.array((batch.column(0).to_numpy() % salts).astype(np.int32))
            slack = SLACK * np.sqrt(space.norm2)
            for grp, cell, near, far, least, most in groups:
                to = d[:, int(cell)]
                lower, upper = np.maximum(np.maximum(to - far, near - to), 0), to + far
                rows = np.flatnonzero((lower <= most * (1 + SLACK) + slack) & (upper >= least * (1 - SLACK) - slack))
                if len(rows):
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), int(grp), np.int32)), salt.take(at), *(c.take(at) for c in batch.columns[:3])], names=["grp", "salt", "vec_id", "label", "q"])

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: by floats while all sums are below 2**53, by integers beyond."""
    most = lambda x: int(np.abs(x).max(initial=0)) if x.size and x.min() > np.iinfo(np.int64).min else 1 << 63
    bound = most(a) * most(b) * max(a.shape[1], 1)
    if bound < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 1 << 63:
        raise OverflowError("a score does not fit a long")
    return exact.astype(np.int64)


def _best(key: np.ndarray, score: np.ndarray, ids: np.ndarray, first: int) -> np.ndarray:
    """Places of the first rows of each key, by score and id."""
    order = np.lexsort((ids, -score, key))
    k = key[order]
    begins = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
    nth = np.arange(len(k)) - np.repeat(begins, np.diff(np.append(begins, len(k))))
    return order[nth < first]


def _positives(width: int, first: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """anchor_id, id, score: the best of the anchor's label, of one task."""
        held = [np.zeros(0, np.int64)] * 3
        a_id, a_label = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        a_q = matrix(anchors["q"].combine_chunks(), width)
        for x, label, q in _blocks(rows, width):
            for b in range(0, len(a_id), BLOCK):
                s = products(a_q[b : b + BLOCK], q)
                i, j = np.nonzero((a_label[b : b + BLOCK, None] == label) & (a_id[b : b + BLOCK, None] != x))
                new = [np.concatenate(p) for p in zip(held, (i + b, s[i, j], x[j]))]
                held = [c[best] for best in [_best(*new, first)] for c in new]
        return pa.table({"anchor_id": a_id[held[0]], "id": held[2], "score": held[1]})

    return run


def _blocks(rows: pa.Table, width: int):
    for b in range(0, len(rows), BLOCK):
        part = rows.slice(b, BLOCK)
        yield part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part["q"].combine_chunks(), width)


def _negatives(width: int, first: int, low: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """anchor_id, positive_id, positive_score, id, score: the best of other labels in each positive's band, of one task."""
        # A row a positive of an anchor; an anchor's own row is used for all of its positives.
        p_id, p_score = (np.concatenate([v.values.to_numpy() for v in anchors[c]] or [np.zeros(0, np.int64)]) for c in ("ids", "scores"))
        owner = np.repeat(np.arange(len(anchors)), [len(v) for v in anchors["ids"]])
        held = [np.zeros(0, np.int64)] * 3
        a_id, a_label = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        a_q = matrix(anchors["q"].combine_chunks(), width)
        least = np.array([_ceiling(low, int(x)) for x in p_score], np.int64)
        a_low, a_high = np.full(len(a_id), np.iinfo(np.int64).max), np.full(len(a_id), np.iinfo(np.int64).min)
        np.minimum.at(a_low, owner, least)
        np.maximum.at(a_high, owner, p_score)
        ends = np.searchsorted(owner, np.arange(len(a_id) + 1))
        most = int(np.diff(ends).max(initial=0))
        for x, label, q in _blocks(rows, width):
            for b in range(0, len(a_id), BLOCK):
                s = products(a_q[b : b + BLOCK], q)
                at = slice(b, b + BLOCK)
                i, j = np.nonzero((a_label[at, None] != label) & (s >= a_low[at, None]) & (s <= a_high[at, None]))
                score = s[i, j]
                for k in range(most):
                    p = ends[i + b] + k
                    fits = np.flatnonzero(p < ends[i + b + 1])
                    p = p[fits]
                    fits = fits[(score[fits] >= least[p]) & (score[fits] <= p_score[p])]
                    new = [np.concatenate(c) for c in zip(held, (ends[i[fits] + b] + k, score[fits], x[j[fits]]))]
                    held = [c[best] for best in [_best(*new, first)] for c in new]
        p = held[0]
        return pa.table({"anchor_id": a_id[owner[p]], "positive_id": p_id[p], "positive_score": p_score[p], "id": held[2], "score": held[1]})

    return run


def _ceiling(low: int, score: int) -> int:
    """The least score s with low * score <= 100 * s."""
    return -((-low * score) // 100)


def mined(vectors: DataFrame, every: int = 100, shift: int = 7, labels: int = 10, first: int = FIRST, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`; for each and each of its `first` positives, the
    `first` rows of other labels with scores from `low` percent of the positive's up to it.
    """
    rows = materialise(taken(vectors, every, shift, labels))
    spark = rows.sparkSession
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, n_anchors, norm2, width = rows.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], out)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("q").collect()
    pivots = np.array([[*r["q"], *[0] * (width - len(r["q"]))] for r in chosen], np.int64).reshape(len(chosen), width)
    space = Space(pivots, norm2)
    salts = max(1, -(-n // ROWS))

    # Anchors in groups: of a cell, in blocks of a size that keeps groups few.
    celled = rows.where("anchor").select("vec_id", "label", "q").mapInArrow(_celled(space, width), "vec_id long, label long, q array<long>, cell int, d double")
    size = max(ANCHORS, -(-n_anchors // (GROUPS - PIVOTS)))
    blocks = celled.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("n_blocks"))
    anchors = materialise(celled.join(F.broadcast(blocks), "cell").withColumn("grp", (F.col("cell") + PIVOTS * F.pmod(F.xxhash64("vec_id"), F.col("n_blocks"))).cast("int")).drop("n_blocks"))

    # Positives: rows of the label that are near enough to a group for one of its anchors.
    need = first + 1
    near = rows.select("label", "q").mapInArrow(_reach(space, width, need), "label long, cell int, reach double").groupBy("label", "cell").agg(F.min("reach").alias("reach"))
    wanted = anchors.groupBy("label", "cell", "grp").agg(F.min("d").alias("near"), F.max("d").alias("far")).join(near, ["label", "cell"], "left")
    reach = F.coalesce(F.col("reach") + F.col("far"), F.lit(float("inf"))) * (1 + SLACK) + SLACK * float(np.sqrt(norm2))
    wanted = materialise(wanted.select("label", "cell", "grp", "near", "far", reach.alias("most")))
    placed = rows.select("vec_id", "label", "q").mapInArrow(_distances(space, width), "vec_id long, label long, q array<long>, ds array<double>")
    to = F.col("ds")[F.col("cell")]
    served = placed.join(wanted, "label").where((to - F.col("far") <= F.col("most")) & (F.col("near") - to <= F.col("most")))
    served = served.select("grp", F.pmod("vec_id", F.lit(salts)).cast("int").alias("salt"), "vec_id", "label", "q")
    spread = lambda a: a.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = spread(anchors.select("grp", "vec_id", "label", "q"))
    found = asked.groupBy("grp", "salt").cogroup(served.groupBy("grp", "salt")).applyInArrow(_positives(width, first), "anchor_id long, id long, score long")
    best = _ranked(found, ["anchor_id"], first)
    positives = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))

    # Negatives: rows whose scores can be in a group's bands. A band below zero is empty.
    bands = anchors.join(positives.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("p", F.filter("p", lambda x: x["score"] >= 0)).where(F.size("p") > 0)
    bands = materialise(bands.select("grp", "cell", "d", "vec_id", "label", "q", F.col("p.id").alias("ids"), F.col("p.score").alias("scores")))
    own = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # The squared distance of a score s is the anchor's square, the norm's square, less 2 s.
    away = lambda s: F.sqrt(F.greatest(own + F.lit(norm2) - 2 * s, F.lit(0.0)))
    bounds = bands.groupBy("grp", "cell").agg(
        F.min("d"), F.max("d"), F.min(away(F.array_max("scores"))), F.max(away(F.array_min("scores") * (low / 100)))
    )
    groups = np.array(bounds.collect(), float).reshape(-1, 6)
    if not len(groups):
        return spark.createDataFrame([], out)
    sent = rows.select("vec_id", "label", "q").mapInArrow(_serving(space, width, groups, salts), "grp int, salt int, vec_id long, label long, q array<long>")
    asked = spread(bands.select("grp", "vec_id", "label", "q", "ids", "scores"))
    hits = asked.groupBy("grp", "salt").cogroup(sent.groupBy("grp", "salt")).applyInArrow(
        _negatives(width, first, low), "anchor_id long, positive_id long, positive_score long, id long, score long"
    )
    return _ranked(hits, ["anchor_id", "positive_id"], first).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _ranked(rows: DataFrame, keys: list[str], first: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= first)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, cast(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS i FROM s WHERE same) WHERE i <= 5
), r AS (
  SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
) SELECT anchor_id, positive_id, cast(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""
