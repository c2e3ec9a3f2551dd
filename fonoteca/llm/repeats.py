r"""Repeated passages: interval expansion on a Burrows-Wheeler transform, bounded by a length threshold.

A start is a place of a text's UTF-8 bytes where NOTICE bytes are left. It is noticed if the NOTICE
bytes there also start anywhere else, and repeated if LENGTH bytes are left and these also start
anywhere else. Every byte that a repeated start covers is removed; those that a noticed start covers
are only counted, as passages of some fifty words are shorter than what is removed.

1. Each start belongs to one anchor: of the GRAM-byte windows in its NOTICE bytes, the one of the
   least hash (the leftmost of equals). This depends on the NOTICE bytes alone, so equal strings have
   anchors of one hash at one distance, and starts that share an anchor are neighbours. A row for each
   anchor holds its hash and a hash of its context, all LENGTH bytes of its starts, with PAD where a
   text ends before: about one row for 113 bytes.
2. A context found twice makes all its starts repeated; an anchor hash found once makes none of its
   starts repeated. Copies end here, in counts that are combined before they are shuffled.
3. What is left are anchors of one hash in different contexts, as around edits and at the edges of
   shared passages. One copy of each such context is fetched, and the contexts of an anchor go to one
   task, in blocks of bounded bytes. There they are strings over 8-byte symbols, counted from the
   anchor: the transform of all of them is taken and, from the interval of the empty string, intervals
   are extended backward breadth-first; those of n symbols yield the places where the common prefix of
   neighbouring suffixes is n - 1. Places without a value after 31 symbols part no class of 248 common
   bytes, and those without one after 49, where expansion stops, none of 392. The 8 bytes left of a
   start's 256 or 400, before and after these, are compared exactly.
4. An anchor hash with more than GROUP contexts does not fit a block, which one task holds: its starts
   are counted one by one, by hashes of all their bytes, in a distributed aggregation. This is exact,
   too, and has no bound.

Defined results: a null or empty text has 0 bytes and nothing removed; texts below LENGTH bytes are
kept; a text found twice is removed whole if it has LENGTH bytes; overlapping repeats in one text
(runs of one character) count; rows with a null id take part; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonoteca.llm import common
from fonoteca.llm.common import TEXT

LENGTH, NOTICE, GRAM, SYMBOL = 400, 256, 32, 8
WINDOW = NOTICE - GRAM + 1
LEVELS = (NOTICE, LENGTH)
#: What stands after each text; UTF-8 never has this byte.
PAD = b"\xff" * (LENGTH - NOTICE)
#: Contexts of one anchor hash beyond which its starts are counted one by one; bytes of a block.
GROUP, BLOCK_BYTES = 3000, 3 << 20
#: Places are told apart by so many bits; anchors of longer texts are found in pieces.
PLACE_BITS = 28
PIECE = (1 << PLACE_BITS) - (1 << 20)
_rng = np.random.default_rng(9)
BASES = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place, by doubling."""
    now, width = (data.astype(np.uint64) + np.uint64(1)) * BASES[0], 1
    while width < GRAM:
        now = mixed(now[:-width] * BASES[width.bit_length()] + now[width:])
        width *= 2
    return now


def least_of_window(values: np.ndarray) -> np.ndarray:
    """The minimum of each WINDOW values, by doubling."""
    now, width = values, 1
    while width * 2 <= WINDOW:
        now, width = np.minimum(now[:-width], now[width:]), width * 2
    rest = WINDOW - width
    return np.minimum(now[:-rest], now[rest:]) if rest else now


def anchors_of(texts: list[bytes], piece: int = PIECE) -> list[tuple[int, int, int, int, int, int]]:
    """(text's number, first start, starts, anchor's place after the first start, hash, context's hash)."""
    if len(texts) == 1 and len(texts[0]) > piece:
        found = []
        for begin in range(0, len(texts[0]) - NOTICE + 1, piece):  # the starts of a piece need what follows it
            end = begin + piece + LENGTH - 1
            whole = texts[0][begin:end] + PAD[: max(0, end - len(texts[0]))]
            found += [(0, begin + first, *rest) for _, first, *rest in anchors_in([whole], [min(piece, len(texts[0]) - NOTICE + 1 - begin)])]
        return found
    return anchors_in([t + PAD for t in texts], [max(0, len(t) - NOTICE + 1) for t in texts])


def anchors_in(texts: list[bytes], counts: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """The same of texts that go on, or are padded, after their last start; counts are of starts."""
    import xxhash

    sizes, counts = np.array([len(t) for t in texts], dtype=np.int64), np.array(counts, dtype=np.int64)
    whole = b"".join(texts)
    if not counts.sum():
        return []
    grams = gram_hashes(np.frombuffer(whole, dtype=np.uint8))
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64(PLACE_BITS)
    anchor = (least_of_window(((grams >> low) << low) | place) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(len(owner)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    key = anchor[inside]
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
    first, starts = inside[edge], np.diff(np.append(edge, len(inside)))
    view, digest = memoryview(whole), xxhash.xxh3_64_intdigest
    context = np.array([digest(view[a : a + c + LENGTH - 1]) for a, c in zip(first.tolist(), starts.tolist())], dtype=np.uint64).view(np.int64)
    hashes = grams[key[edge]].view(np.int64)
    return list(zip(owner[edge].tolist(), (first - begins[owner[edge]]).tolist(), starts.tolist(), (key[edge] - first).tolist(), hashes.tolist(), context.tolist()))


ANCHOR = "k1 long, k2 long, first int, starts int, rel int, h long, ctx long"


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, two hashes of the text (what is found out about a text holds for its copies) and the bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.cast("binary").alias(TEXT))


def anchors(keyed: DataFrame) -> DataFrame:
    kind = keyed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.runs(batch, most=1 << 20):
                found = anchors_of(part.column(3).to_pylist())
                if not found:
                    continue
                at, *columns = zip(*found)
                rows = pa.array(at, pa.int64())
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(rows) for i in range(3)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "k1", "k2", "first", "starts", "rel", "h", "ctx"])

    return keyed.mapInArrow(run, f"id {kind}, {ANCHOR}")


def contexts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts: rows of wanted, grouped by text, with data."""
    asked = wanted.groupBy("id", "k1", "k2").agg(F.collect_list(F.struct("h", "first", "starts", "rel", "times", "hot")).alias("asked"))
    asked = asked.withColumnRenamed("id", "asked_id")
    met = keyed.join(asked, (keyed["k1"] == asked["k1"]) & (keyed["k2"] == asked["k2"]) & keyed["id"].eqNullSafe(asked["asked_id"]))
    met = met.select(keyed["k1"], keyed["k2"], "asked", TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("k1", "k2", "h", "first", "starts", "rel", "times", "hot", "data")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        for batch in batches:
            for part in common.runs(batch, most=1 << 20):
                rows = [
                    (k1, k2, a["h"], a["first"], a["starts"], a["rel"], a["times"], a["hot"], (text[a["first"] : a["first"] + a["starts"] + LENGTH - 1] + PAD)[: a["starts"] + LENGTH - 1])
                    for k1, k2, asked, text in zip(*(c.to_pylist() for c in part.columns))
                    for a in asked
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return met.mapInArrow(run, "k1 long, k2 long, h long, first int, starts int, rel int, times long, hot boolean, data binary")


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes in the order of their first 64 symbols or more, by doubling."""
    rank, width = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    n = len(rank)
    while True:
        next_rank = np.zeros(n, dtype=np.int64)
        next_rank[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + next_rank
        order = np.argsort(key, kind="stable")
        if width >= 32:
            return order
        step = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = step
        width *= 2
        if step[-1] == n - 1:
            return order


def prefix_classes(symbols: np.ndarray, cores: tuple[int, ...]) -> list[np.ndarray]:
    """For each of cores, in rising order, the class of each suffix: those of a class share so many first symbols.

    Breadth-first backward extension. The queue holds the intervals of strings of one length; the
    images of an interval under the last-to-first map, parted by symbol, are the intervals of the
    strings one symbol longer. Where an interval ends, the common prefix of its last suffix with the
    next is shorter than the string; the first, and so the least, value found for a place is final, and
    an interval whose end has a value already is not followed.
    """
    n = len(symbols)
    order = suffix_order(symbols)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    transform = symbols[order - 1]
    to_first = place[order - 1]
    open_end = np.ones(n + 1, dtype=bool)
    open_end[n] = False
    left, right = np.array([0]), np.array([n - 1])
    parts = []
    for size in range(1, cores[-1] + 1):
        lengths = right - left + 1
        of = np.repeat(np.arange(len(left)), lengths)
        within = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = left[of] + within
        image, symbol = to_first[at], transform[at]
        sorting = np.argsort(of * np.int64(n) + image, kind="stable")
        of, image, symbol = of[sorting], image[sorting], symbol[sorting]
        starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1])]))
        ends = np.append(starts[1:], len(of)) - 1
        left, right = image[starts], image[ends]
        fresh = open_end[right + 1] | (right + 1 == n)
        open_end[right + 1] = False
        # The rightmost interval of a length ends at the last suffix, which has no next one.
        left, right = left[fresh], right[fresh]
        if size in cores:
            parts.append(np.cumsum(~open_end[:n]))
        if not len(left):
            break
    parts += [np.cumsum(~open_end[:n])] * (len(cores) - len(parts))
    return [part[place] for part in parts]


def repeated_starts(data: list[bytes], rel: list[int], starts: list[int]) -> list[list[np.ndarray]]:
    """For each of LEVELS and each context, the starts (0 is its first) whose bytes, so many, occur twice in all contexts."""
    shift = [r % SYMBOL for r in rel]
    strings = [np.frombuffer(d, dtype="<u8", offset=s, count=(len(d) - s) // SYMBOL) for d, s in zip(data, shift)]
    sizes = np.array([len(s) + 1 for s in strings])
    begins = np.cumsum(sizes) - sizes
    known = np.unique(np.concatenate(strings), return_inverse=True)[1]
    symbols = np.empty(int(sizes.sum()), dtype=np.int64)
    last = begins + sizes - 1
    body = np.ones(len(symbols), dtype=bool)
    body[last] = False
    symbols[body] = known + len(strings)
    symbols[last] = np.arange(len(strings))  # a separator of its own after each string
    classes = prefix_classes(symbols, tuple(level // SYMBOL - 1 for level in LEVELS))

    offsets = np.cumsum([0, *(len(d) for d in data[:-1])])
    whole = np.frombuffer(b"".join(data) + bytes(SYMBOL), dtype=np.uint8).astype(np.uint64)
    eight = whole[:-1] | (whole[1:] << np.uint64(8))
    eight = eight[:-2] | (eight[2:] << np.uint64(16))
    eight = eight[:-4] | (eight[4:] << np.uint64(32))
    counts = np.array(starts)
    of = np.repeat(np.arange(len(data)), counts)
    s = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    head = (np.array(shift)[of] - s) % SYMBOL
    symbol_at = begins[of] + (s + head - np.array(shift)[of]) // SYMBOL
    byte = offsets[of] + s
    bits = (np.uint64(8) * head.astype(np.uint64))
    kept = np.where(head > 0, eight[byte] & ((np.uint64(1) << bits) - np.uint64(1)), np.uint64(0))
    out = []
    for level, classes_at in zip(LEVELS, classes):
        rest = kept | (eight[byte + head + (level // SYMBOL - 1) * SYMBOL] << bits)
        group = classes_at[symbol_at] * SYMBOL + head
        order = np.lexsort((rest, group))
        same = (rest[order][1:] == rest[order][:-1]) & (group[order][1:] == group[order][:-1])
        twice = np.zeros(len(of), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out.append([s[a:b][twice[a:b]] for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts))])
    return out


def joined_up(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring starts, both ends included."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist())) if len(starts) else []


RUNS = "k1 long, k2 long, level int, lo int, hi int"


def in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Runs of repeated starts of the contexts that occur once, from the transforms of blocks."""

    def expand(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["h", "k1", "k2", "first"]).reset_index(drop=True)
        out, begin, size = [], 0, 0
        h, lengths = pdf["h"].tolist(), pdf["data"].map(len).tolist()
        cuts = [0]
        for i in range(len(h)):  # blocks end where an anchor's contexts end
            if i > begin and size >= BLOCK_BYTES and h[i] != h[i - 1]:
                cuts.append(i)
                begin, size = i, 0
            size += lengths[i]
        for a, b in zip(cuts, [*cuts[1:], len(h)]):
            own = pdf.iloc[a:b]
            found = repeated_starts(own["data"].tolist(), own["rel"].tolist(), own["starts"].tolist())
            for level, of_level in zip(LEVELS, found):
                for k1, k2, first, times, s in zip(own["k1"], own["k2"], own["first"], own["times"], of_level):
                    if times == 1:
                        out += [(k1, k2, level, first + lo, first + hi) for lo, hi in joined_up(s)]
        return pd.DataFrame(out, columns=["k1", "k2", "level", "lo", "hi"]).astype({"k1": "int64", "k2": "int64", "level": "int32", "lo": "int32", "hi": "int32"})

    placed = rows.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)))
    return placed.groupBy("block").applyInPandas(expand, RUNS)


def one_by_one(rows: DataFrame) -> DataFrame:
    """The same for contexts of hot anchors: all starts are counted by hashes of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                part, out = whole.slice(i, 200), []
                for k1, k2, first, starts, times, data in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "first", "starts", "times", "data"))):
                    view = memoryview(data)
                    for level in LEVELS:
                        for s in range(starts):
                            t = np.frombuffer(xxhash.xxh3_128_digest(view[s : s + level]), dtype="<i8")
                            out.append((int(t[0]), int(t[1]), k1, k2, level, first + s, times))
                kinds = (*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["t1", "t2", "k1", "k2", "level", "lo", "times"])

    each = rows.mapInArrow(run, "t1 long, t2 long, k1 long, k2 long, level int, lo int, times long")
    # Written first: a join of two plain shuffles, whose large partitions adaptive execution can split.
    twice = common.materialise(each.groupBy("t1", "t2").agg(F.sum("times").alias("n")).where("n > 1").drop("n"))
    return common.materialise(each.where("times = 1").join(twice, ["t1", "t2"], "left_semi").select("k1", "k2", "level", "lo", F.col("lo").alias("hi")))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, runs): for each text with repeats, by its hashes, the runs of its noticed and its repeated starts.

    Level 0 stands for both; of these, starts with less than LENGTH bytes left are only noticed.
    """
    keyed = with_keys(docs, id_col, text_col)
    rows = common.materialise(anchors(keyed))
    by_context = rows.groupBy("h", "ctx").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "id", "first", "starts", "rel")).alias("one"))
    by_anchor = by_context.groupBy("h").agg(F.sum("times").alias("all"), F.count("*").alias("kinds")).where(F.col("all") > 1)
    shared = common.materialise(by_context.join(by_anchor, "h"))
    # Copies of a text are one row; dealing them out first also lets a hot context's partition be split.
    once = rows.select("h", "ctx", "k1", "k2", "first", "starts").distinct()
    copied = once.join(shared.where("times > 1").select("h", "ctx"), ["h", "ctx"], "left_semi").select("k1", "k2", F.lit(0).alias("level"), F.col("first").alias("lo"), (F.col("first") + F.col("starts") - 1).alias("hi"))

    wanted = shared.where("kinds > 1").select("h", "times", (F.col("kinds") > GROUP).alias("hot"), "one.*")
    found = common.materialise(contexts(keyed, wanted))
    size = found.where("not hot").agg(F.sum(F.length("data"))).first()[0] or 0
    runs = copied.unionByName(in_blocks(found.where("not hot"), size // BLOCK_BYTES + 1)).unionByName(one_by_one(found.where("hot")))
    return runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("level", "lo", "hi")).alias("runs"))


def spans_of(runs: list[tuple[int, int]], level: int, size: int) -> list[list[int]]:
    """The maximal stretches that runs of starts (first, last) cover with level bytes each, in a text of that size."""
    spans: list[list[int]] = []
    for lo, hi in sorted(runs):
        end = min(hi + level, size)
        if end - lo < level:
            continue
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([lo, end])
    return spans


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the bytes that are left) and n_noticed (bytes in noticed starts) of every row."""
    keyed = with_keys(docs, id_col, text_col)
    found = common.materialise(repeats(docs, id_col, text_col))
    met = keyed.join(found, ["k1", "k2"], "left").select("id", "runs", TEXT)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.runs(batch):
                columns: list[list] = [[] for _ in range(5)]
                for text, runs in zip(part.column(2).to_pylist(), part.column(1).to_pylist()):
                    spans, noticed = (spans_of([(r["lo"], r["hi"]) for r in runs or () if r["level"] in (0, level)], level, len(text)) for level in (LENGTH, NOTICE))
                    kept, at = [], 0
                    for lo, end in spans:
                        kept.append(text[at:lo])
                        at = end
                    kept.append(text[at:])
                    for column, value in zip(columns, (len(text), sum(b - a for a, b in spans), len(spans), b"".join(kept), sum(b - a for a, b in noticed))):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "n_noticed"])

    return met.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_noticed long").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return cleaned(docs, id_col, text_col).select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_noticed")
