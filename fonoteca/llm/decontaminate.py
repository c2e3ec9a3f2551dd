r"""Benchmark decontamination by spaced seeds.

Tokens are runs of \w, lower-cased. Fixed masks of care and ignore places are slid over both sides; a
window's hash takes the care places only, so that a substitution at an ignored place does not hide a
match. The documents are read once, whatever the size of the benchmark: a filter of the test hashes, whose
bits grow with their number (48 a hash, from 2 MB up to 64 MB for 11 million), leaves the windows of a
document that may be hits, and these hashes are joined with those of the test items; a fuller filter only
leaves more to the join. What meets is grouped by document, CHUNK items a row, so that a text goes to its
verification once for so many items and is cut into tokens once there; items are kept ready by the worker.
Around every hit the whole aligned item is compared, in three ways: its equal tokens as a share of the item,
those of every window of MIN_RUN tokens of it as a share of the window, and a segment, which is the
best run of the alignment with +1 for an equal and -3 for another token and counts if 80 % of its
tokens are equal.

A document is contaminated by an item if 80 % of the item, or of a window of it, is equal, if a
segment has MIN_RUN tokens (or the whole item, if that is shorter), or if windows and segments
together cover 80 % of the item, as after an insertion. Items of fewer tokens than the lightest mask
spans (7) are found where all their tokens stand in a row, and not otherwise. Defined results: null
and empty texts on either side match nothing; very long texts are read whole; a null id stays null;
repeated documents are judged alike, repeated items (of one id and text) count once; an empty benchmark
or table gives no hits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fonoteca.llm import common

#: 1 is a care place, 0 is ignored.
MASKS = ("1111111", "11101001011", "1101010010111", "101100111001")
MIN_RUN, SHARE, MISS = 20, 0.8, 3
WORD = re.compile(r"\w+")
_rng = np.random.default_rng(5)
PLACES = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of the filter that documents pass, least and most, as powers of two, and how many of them a hash
#: sets and has to itself. Its first bits name the first one, those before its last SECOND bits the step to
#: the next. PIECE: bits of a piece of the filter.
LEAST_BITS, MOST_BITS, SET, EACH, SECOND, PIECE = 24, 29, 6, 48, 10, 16
#: About so many items go with a text to its verification.
CHUNK = 8
#: A worker keeps the last KEPT items of up to KEPT_TOKENS tokens.
KEPT, KEPT_TOKENS = 1024, 2000


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the care places of each window; 0 where one of their tokens is 0, which stands for none."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, known = np.full(n, len(mask), dtype=np.uint64), np.ones(n, dtype=bool)
    for i, care in enumerate(mask):
        if care == "1":
            part = ids[i : i + n]
            total = (total ^ part.astype(np.uint64)) * PLACES[i]
            total ^= total >> np.uint64(29)
            known &= part != 0
    return np.where(known, total | np.uint64(1), np.uint64(0))


def seeds_of(texts: list[str], short: tuple[int, ...]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each mask, and for the masks of short lengths: the windows' hashes, and each one's text."""
    import xxhash

    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    flat: list[int] = [numbers[""]]  # no token is empty: it parts the texts
    ends = []
    for text in texts:
        flat += map(numbers.__getitem__, tokens(text))
        flat.append(0)
        ends.append(len(flat))
    of_word = np.array([0, *(xxhash.xxh3_64_intdigest(w) | 1 for w in list(numbers)[1:])], dtype=np.uint64)
    ids = of_word[np.array(flat)]
    for mask in (*MASKS, *("1" * n for n in short)):
        hashes = window_hashes(ids, mask)
        inside = np.flatnonzero(hashes)
        yield mask, hashes[inside], np.searchsorted(np.array(ends), inside, side="right")


def ids_of(text: str) -> np.ndarray:
    """The hashes of a text's tokens, never 0."""
    import xxhash

    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    flat = [numbers[w] for w in tokens(text)]
    return np.array([xxhash.xxh3_64_intdigest(w) | 1 for w in numbers], dtype=np.uint64)[np.array(flat, dtype=np.int64)]


class Item:
    """An item's tokens, and the hashes of its windows by mask; one too short for any mask is a window by itself."""

    def __init__(self, text: str):
        self.ids = ids_of(text)
        n = len(self.ids)
        self.windows = {mask: window_hashes(self.ids, mask) for mask in (MASKS if n >= len(MASKS[0]) else ("1" * n,) if n else ())}


class Text:
    """A document's tokens, and its windows by mask in order of their hashes, made when first asked for."""

    def __init__(self, text: str):
        self.ids = ids_of(text)
        self.sorted: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def met(self, mask: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place here, place there) of the windows of equal hashes."""
        if mask not in self.sorted:
            own = window_hashes(self.ids, mask)
            order = np.argsort(own, kind="stable")
            self.sorted[mask] = own[order], order
        own, order = self.sorted[mask]
        low, high = np.searchsorted(own, hashes, "left"), np.searchsorted(own, hashes, "right")
        sizes = high - low
        there = np.repeat(np.arange(len(hashes)), sizes)
        return order[np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(len(there))], there

    def hit(self, item: Item) -> tuple[int, int, float] | None:
        """(at_token, longest, covered) if the item contaminates the text."""
        n = len(item.ids)
        met = [self.met(mask, hashes) for mask, hashes in item.windows.items()]
        if 0 < n < len(MASKS[0]):
            at = next((int(here) for here in np.sort(met[0][0]) if (self.ids[here : here + n] == item.ids).all()), None)
            return None if at is None else (at, n, 1.0)
        shifts = np.unique(np.concatenate([here - there for here, there in met])) if met else ()
        covered, longest, first, enough = np.zeros(n, dtype=bool), 0, None, False
        for shift in map(int, shifts):
            begin, end = max(0, -shift), min(n, len(self.ids) - shift)
            spans, whole = segments(item.ids[begin:end] == self.ids[begin + shift : end + shift], n)
            enough |= whole
            for a, b in spans:
                covered[begin + a : begin + b] = True
                longest = max(longest, b - a)
                first = begin + a + shift if first is None else min(first, begin + a + shift)
        return (first, longest, float(covered.mean())) if longest and (enough or covered.sum() >= SHARE * n) else None


class Block:
    """A few items, for texts that are not in a table."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.names = [name for name, _ in items]
        self.items = [Item(text) for _, text in items]

    def find(self, text: str) -> list[dict]:
        """The items that contaminate a text."""
        own = Text(text)
        found = ((name, own.hit(item)) for name, item in zip(self.names, self.items))
        return [{"item": name, "at_token": hit[0], "longest": hit[1], "covered": hit[2]} for name, hit in found if hit]


def segments(same: np.ndarray, n: int) -> tuple[list[tuple[int, int]], bool]:
    """What is alike on one alignment with an item of n tokens, as (begin, end), and whether it is enough by itself."""
    spans, enough = [], False
    a, b, equal = best_run(same.tolist())
    if b - a >= len(MASKS[0]) and equal >= SHARE * (b - a):
        spans.append((a, b))
        enough = b - a >= min(MIN_RUN, n)
    hits = np.flatnonzero(same)
    if len(hits) >= SHARE * n:
        spans.append((int(hits[0]), int(hits[-1]) + 1))
        enough = True
    if len(same) >= MIN_RUN:
        sums = np.concatenate([[0], np.cumsum(same)])
        begins = np.flatnonzero(sums[MIN_RUN:] - sums[:-MIN_RUN] >= SHARE * MIN_RUN)
        if len(begins):
            cuts = np.flatnonzero(np.diff(begins) > MIN_RUN)  # windows that touch are one span
            spans += zip(begins[np.append(0, cuts + 1)].tolist(), (begins[np.append(cuts, len(begins) - 1)] + MIN_RUN).tolist())
            enough = True
    return spans, enough


def best_run(same: list[bool]) -> tuple[int, int, int]:
    """(begin, end, equal tokens) of the run of the highest score."""
    best, now, begin, found = 0, 0, 0, (0, 0)
    for i, equal in enumerate(same):
        if now <= 0:
            now, begin = 0, i
        now += 1 if equal else -MISS
        if now > best:
            best, found = now, (begin, i + 1)
    return *found, sum(same[slice(*found)])


def bench_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, item_text) of the distinct items; item is a hash of the other two."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("item_text")).where("item_text IS NOT NULL").distinct()
    return rows.select(F.xxhash64("item_id", "item_text").alias("item"), "item_id", "item_text")


def bench_seeds(items: DataFrame) -> DataFrame:
    """(h, item, n): the hashes of the items' windows; n is 0, or the tokens of an item that no mask fits."""
    most = len(MASKS[0]) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            sizes = np.array([len(tokens(t)) for t in texts])
            for mask, hashes, owner in seeds_of(texts, tuple(range(1, most + 1))):
                n = 0 if mask in MASKS else len(mask)
                fits = sizes[owner] == n if n else np.ones(len(owner), dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[fits].view(np.int64)), pa.array(names[owner[fits]]), pa.array(np.full(fits.sum(), n))], names=["h", "item", "n"])

    return items.select("item", "item_text").mapInArrow(run, "h long, item long, n long").distinct()


def filter_of(seeds: DataFrame, size: int) -> np.ndarray:
    """The filter of 2 ** size bits, as bytes, lowest bit first; its pieces are made in tasks."""
    first, step = F.shiftrightunsigned("h", 64 - size), (F.shiftrightunsigned("h", SECOND) % (1 << size)).bitwiseOR(F.lit(1))
    places = F.array(*((first + step * k) % (1 << size) for k in range(SET)))
    place = seeds.select(F.explode(places).alias("place")).distinct().select(F.shiftright("place", PIECE).alias("piece"), (F.col("place") % (1 << PIECE)).alias("bit"))

    def piece(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PIECE, dtype=bool)
        bits[table.column("bit").to_numpy()] = True
        return pa.table({"piece": table.column("piece")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    held = np.zeros(1 << (size - 3), dtype=np.uint8)
    wide = 1 << (PIECE - 3)
    for row in place.groupBy("piece").applyInArrow(piece, "piece long, bits binary").collect():  # 64 MB at most
        held[row["piece"] * wide : (row["piece"] + 1) * wide] = np.frombuffer(row["bits"], dtype=np.uint8)
    return held


def is_set(held: np.ndarray, hashes: np.ndarray, k: int, size: int) -> np.ndarray:
    """Whether the filter has the k-th bit of each hash."""
    step = (hashes >> np.uint64(SECOND)) & np.uint64((1 << size) - 1) | np.uint64(1)
    at = ((hashes >> np.uint64(64 - size)) + step * np.uint64(k)) & np.uint64((1 << size) - 1)
    return (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def suspects(docs: DataFrame, id_col: str, text_col: str, seeds: DataFrame) -> DataFrame:
    """(id, uid, k1, k2, text, seeds) of the documents with windows that pass the filter of the seeds."""
    short = tuple(r["n"] for r in seeds.where("n > 0").select("n").distinct().collect())  # 6 at most
    size = max(LEAST_BITS, min(MOST_BITS, (EACH * seeds.count()).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(seeds, size))
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.coalesce(text, F.lit("")).cast("binary").alias(common.TEXT))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common.give_up()
        uid, held = TaskContext.get().partitionId() << 33, sent.value
        for batch in batches:
            for part in common.runs(batch, most=1 << 20):
                texts = [t.decode("utf-8", "replace") for t in part.column(3).to_pylist()]
                found = []
                for _, hashes, owner in seeds_of(texts, short):
                    passed = np.arange(len(hashes))
                    for k in range(SET):
                        passed = passed[is_set(held, hashes[passed], k, size)]
                    found.append(np.stack([owner[passed], hashes[passed].view(np.int64)]))
                owner, hashes = np.unique(np.concatenate(found, axis=1), axis=1)
                rows, sizes = np.unique(owner, return_counts=True)
                if len(rows):
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(hashes))
                    own = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(uid + np.arange(len(rows))), own.column(1), own.column(2), own.column(3), lists], names=["id", "uid", "k1", "k2", "text", "seeds"])
                    uid += len(rows)

    return rows.mapInArrow(run, f"id {kind}, uid long, k1 long, k2 long, text binary, seeds array<long>")


def item_of(text: str) -> Item:
    """The item, made ready once by a Python worker as long as it keeps it."""
    items = common.kept("items", dict)
    if (item := items.get(text)) is None:
        item = Item(text)
        if len(item.ids) <= KEPT_TOKENS:
            if len(items) >= KEPT:
                items.clear()
            items[text] = item
    return item


def verified(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, k1, k2, item_id, at_token, longest, covered): documents, by the hashes of their texts, and the items that contaminate them."""
    items = common.materialise(bench_items(benchmark, item_col, item_text_col))
    seeds = common.materialise(bench_seeds(items))
    rows = common.materialise(suspects(docs, id_col, text_col, seeds))
    pairs = rows.select("uid", F.explode("seeds").alias("h")).join(seeds, "h").select("uid", "item").distinct()
    of_text = Window.partitionBy("uid")
    dealt = pairs.withColumn("chunk", F.pmod("item", F.ceil(F.count("*").over(of_text) / CHUNK)))
    lists = dealt.join(items, "item").groupBy("uid", "chunk").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    met = rows.drop("seeds").join(lists, "uid").select("id", "k1", "k2", "text", "items")
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, k1 long, k2 long, item_id long, at_token long, longest long, covered double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.runs(whole, "text", 1 << 20):
                at, found = [], []
                for i in range(batch.num_rows):
                    text = Text(batch.column("text")[i].as_py().decode("utf-8", "replace"))
                    for item in batch.column("items")[i].as_py():
                        if hit := text.hit(item_of(item["item_text"])):
                            at.append(i)
                            found.append((item["item_id"], *hit))
                own = batch.take(pa.array(at, pa.int64()))
                columns = zip(*found) if found else ((), (), (), ())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("id", "k1", "k2")), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "k1", "k2", "item_id", "at_token", "longest", "covered"])

    return met.mapInArrow(run, out)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and each item that contaminates it."""
    return verified(docs, benchmark, id_col, text_col).drop("k1", "k2").withColumnRenamed("id", id_col)


@common.apart
def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows; copies of a contaminated text are contaminated."""
    found = verified(docs, benchmark, id_col, text_col).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    text = F.col(text_col)
    keyed = docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(1), text)})
    return keyed.join(found, ["__k1", "__k2"], "left_anti").select(*docs.columns)
