r"""Language-model scores from Brown classes: p(text) = product of p(class | last class) p(word | class).

Tokens are words [^\x20\x09-\x0D]+ with A-Z lower-cased, and one end a text. Every count is taken over
all rows outside the held-out fold (crc32 of the id as text, mod 5, is 1). Every training word has one
of CLASSES classes, by exchange:

1. Texts are read twice: words are counted, then each text is written as numbers of the HEAD commonest
   words, with its rarer words beside them. All later steps read these numbers.
2. Pairs of neighbours are counted, and each word's neighbours are brought together, in blocks of whole
   words. A word has at most 2 (HEAD + 2) of them, whatever the corpus. What tasks hand to each other
   here and in the last step is packed in arrays, a row for each part that it is dealt to.
3. The SEEDS commonest words are exchanged one after another, from their own table, which the driver
   holds: the classes to begin with.
4. All words of the head are exchanged in rounds. A round is one pass over the blocks: half of the words
   move to the class that makes their neighbours' classes likeliest, and the class table is counted anew.
   It ends when two rounds in a row do not raise the likelihood by a part of TOLERANCE; the best round
   counts. The driver holds the classes of the head and the class table.
5. Rarer words are placed once, in Spark, by the classes to their left and right. A pair of two such
   words, whose classes no task can look up, is shared out by the marginals of such pairs.

The end is a class of its own, and so is the unseen word. Transitions and emissions are smoothed by
adding 0.5, and each class emits its own words alone, so that probabilities add up to one.

A text's common words are scored where the text is read, with a table of at most HEAD words (those of
the highest counts; words that tie at the cut stay out), which may be sent to each worker. Rarer words
are joined with the full table of counts and classes. Defined results: a null or empty text is the end
alone; a null id is in the training fold; repeated rows count and are scored each; without training
rows all counts are zero and each word is unseen; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonoteca.llm import common

FOLDS, HELD_OUT = 5, 1
HEAD, SEEDS, CLASSES, PASSES, TOLERANCE = 200_000, 800, 40, 8, 1e-3
#: The end token; no word holds a blank.
END = b" "
#: Words of runs that a task counts together.
FLUSH = 1_000_000
#: Bytes of text whose tokens are numbered together.
RUN = 8 << 20
#: Entries of a block of neighbours, about, and the parts that they are dealt to at most.
BLOCK, PARTS = 1 << 20, 4096
#: Rare words that are placed together, and what a task holds of them, about.
STEP, RARE = 1 << 14, 1 << 18


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts as bytes, the numbers of all their words, and where each text's begin and the last one's end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    coded, offsets = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
    numbers, words = coded.indices.to_numpy(), coded.dictionary.view(pa.binary())
    blank = pc.index(words, b"").as_py()  # stands beside white space at the ends of a text
    real = numbers != blank
    return words, numbers[real], np.append(0, np.cumsum(real))[offsets - offsets[0]]


def rare_words(texts: pa.Array) -> pa.Array:
    """All words of the rare words of texts, which have one at least each."""
    return pc.split_pattern(texts.view(pa.string()), " ").flatten().view(pa.binary())


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The parts that numbers are dealt to."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.uint16)


def pieces(parts: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each of the parts, which are in order, with what columns have for it as bytes."""
    begins = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else np.zeros(0, dtype=int)
    cuts = [*begins.tolist(), len(parts)]
    packed = [pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(parts[begins].astype(np.int64)), *packed], names=["part", *columns])


def together(pieces: DataFrame, parts: int) -> DataFrame:
    """Pieces by part, a task for each, so that none gets several where another gets none; the rows of a part one after another."""
    return pieces.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part")


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    """The columns of each part, after together; each is a list of its pieces."""
    at, rows = None, []
    for batch in batches:
        for part, *columns in zip(*(c.to_pylist() for c in batch.columns)):
            if part != at and rows:
                yield [list(c) for c in zip(*rows)]
                rows = []
            at = part
            rows.append(columns)
    if rows:
        yield [list(c) for c in zip(*rows)]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, h, n) over all texts, h a hash of the word; counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ends, total = [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            summed = pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("n", "sum")])
            yield from summed.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

        for batch in batches:
            for part in common.runs(batch, most=RUN):
                words, numbers, _ = split(part.column(0))
                n = np.bincount(numbers, minlength=len(words))
                found.append(pa.table({"word": words, "n": n}).filter(pa.array(n > 0)))
                ends, total = ends + part.num_rows, total + len(words)
                if total > FLUSH:
                    yield from out()
                    found, total = [], 0
        if ends:
            found.append(pa.table({"word": pa.array([END], pa.binary()), "n": np.array([ends])}))
            yield from out()

    counts = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.select("word", F.xxhash64("word").alias("h"), "n")


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, most at most; a count of counts finds the cut. If the first level alone has more, it is cut by counts and, of equal ones, by hashes."""
    level = F.floor(F.log2("n") * 64)
    words = counts.where(F.col("word") != F.lit(END))
    cut, total = None, 0
    for row in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few thousand levels
        total += row["count"]
        if total > most:
            break
        cut = row["level"]
    if cut is not None or not total:
        return words.where(level >= cut) if cut is not None else words.where("false")
    words = words.where(level == row["level"])
    order, total, last = F.struct((-F.col("n")).alias("less"), F.shiftrightunsigned("h", 48).alias("bucket")), 0, None
    for row in words.groupBy(order.alias("order")).count().orderBy("order").collect():  # 65,536 buckets a count at most
        total += row["count"]
        if total > most:
            break
        last = row["order"]
    return words.where((-F.col("n") < last["less"]) | (-F.col("n") == last["less"]) & (F.shiftrightunsigned("h", 48) <= last["bucket"])) if last is not None else words.where("false")


def encoded(rows: DataFrame, words: list[bytes]) -> DataFrame:
    """id, held_out, uid, ids and rare of rows (id, held_out, text as bytes).

    ids are the places of a text's tokens in words (at most HEAD), as 32-bit numbers; len(words) stands
    for a word that is not there, which rare has, with a blank between two, and len(words) + 1 for the end.
    """
    kind, beyond = rows.schema["id"].dataType.simpleString(), len(words)
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, uid = pa.array(sent.value, pa.binary()), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in common.runs(batch, most=RUN):
                names, numbers, bounds = split(part.column(2))
                of, n = pc.fill_null(pc.index_in(names, known), beyond).to_numpy()[numbers], part.num_rows
                ids, stops, rare = np.full(len(of) + n, beyond + 1, dtype="<i4"), bounds[1:] + np.arange(n), of == beyond
                ids[np.delete(np.arange(len(ids)), stops)] = of
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rare))[bounds].astype(np.int32)), names.take(pa.array(numbers[rare])))
                arrays = (
                    pa.array(np.arange(uid, uid + n)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, 4 * (stops + 1)).astype(np.int32)), pa.py_buffer(ids)]),
                    pc.binary_join(lists, b" "),
                )
                uid += n
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["id", "held_out", "uid", "ids", "rare"])

    return rows.mapInArrow(run, f"id {kind}, held_out boolean, uid long, ids binary, rare binary")


def flat(column: pa.Array, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def paths(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of encoded texts, with their tokens after an end."""
    for batch in batches:
        for part in common.runs(batch, "ids", RUN):
            yield part, np.append(np.int32(end), flat(part.column("ids")))


def neighbours(seen: DataFrame, head: int, tokens: int) -> DataFrame:
    """(w, at, n) as packed arrays, in blocks of whole words: how often at stands by w.

    at is a token that stands left of w, or head + 2 and a token that stands right of it. Pairs are
    dealt and summed by pair before they are brought together by word, so a common word is no hot key.
    """
    size = head + 2
    parts = min(max(1, -(-2 * tokens // (2 * BLOCK))), PARTS)
    fields = "w binary, at binary, n binary"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, path in paths(batches, head + 1):
            keys, n = np.unique(path[:-1].astype(np.int64) * size + path[1:], return_counts=True)
            part = part_of(keys, parts)
            order = np.argsort(part, kind="stable")
            left, right = np.divmod(keys[order], size)
            yield pieces(part[order], {"w": left.astype("<i4"), "at": right.astype("<i4"), "n": n[order].astype("<i4")})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in by_part(batches):
            left, right, n = (np.frombuffer(b"".join(c), "<i4") for c in columns)
            keys = left.astype(np.int64) * size + right
            order = np.argsort(keys)
            keys, n = keys[order], n[order].astype("<i8")
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            (left, right), n = np.divmod(keys[first], size), np.add.reduceat(n, first)
            w, at, n = np.append(left, right).astype("<i4"), np.append(right + size, left).astype("<i4"), np.append(n, n)
            part = (w % parts).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            yield pieces(part[order], {"w": w[order], "at": at[order], "n": n[order]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(flat(b.column("w")), flat(b.column("at")), flat(b.column("n"), "<i8")) for b in batches if b.num_rows]
        if not got:
            return
        w, at, n = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(w, kind="stable")
        w, at, n = w[order], at[order], n[order]
        ends = np.append(np.flatnonzero(np.diff(w)) + 1, len(w))
        begin = 0
        while begin < len(w):
            end = int(ends[min(np.searchsorted(ends, begin + BLOCK), len(ends) - 1)])
            yield pa.RecordBatch.from_arrays([pa.array([x[begin:end].tobytes()], pa.binary()) for x in (w, at, n)], names=["w", "at", "n"])
            begin = end

    summed = together(seen.select("ids").mapInArrow(pairs, f"part long, {fields}"), parts)
    return summed.mapInArrow(dealt, f"part long, {fields}").repartitionById(parts, F.col("part").cast("int")).mapInArrow(merged, fields)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield flat(one.column(0)), flat(one.column(1)), flat(one.column(2), "<i8")


def seed_bigrams(near: DataFrame, head: int, seeds: int, tokens: int) -> np.ndarray:
    """How often a symbol follows a symbol: the seeds, the rest, the end."""
    rest, end, size = seeds, seeds + 1, seeds + 2
    symbol = np.append(np.minimum(np.arange(head + 1), rest), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, at, n in blocks(batches):
            own, other, after = symbol[w], symbol[at % (head + 2)], at >= head + 2
            # What follows a symbol of one word is in its block; what follows the rest is in that of the next.
            taken = (own != rest) & (after | (other == rest))
            cells = np.where(after, own * size + other, other * size + own)[taken]
            counts = np.bincount(cells, n[taken], size * size) if len(cells) else np.zeros(0)
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])

    got = near.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most (seeds + 2) squared rows
    table = np.zeros(size * size)
    table[got["cell"].to_numpy()] = got["n"].to_numpy()
    table[rest * size + rest] = tokens - table.sum()
    return table.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each symbol; the last two symbols keep the last two classes, which are theirs alone."""
    words = len(bigrams) - 2
    classes = max(1, min(classes, words))
    of = np.append(np.arange(words) % classes, [classes, classes + 1])
    member = np.eye(classes + 2)[of]
    table = member.T @ bigrams @ member
    for _ in range(passes):
        moved = 0
        for w in range(words):
            own, same = of[w], bigrams[w, w]
            right = np.bincount(of, bigrams[w], classes + 2)
            left = np.bincount(of, bigrams[:, w], classes + 2)
            right[own] -= same
            left[own] -= same
            table[own] -= right
            table[:, own] -= left
            table[own, own] -= same
            before = xlogx(table)
            diagonal = np.arange(classes + 2)
            rows = xlogx(table + right) - before
            columns = xlogx(table + left[:, None]) - before
            gain = rows.sum(1) - rows[diagonal, diagonal] + columns.sum(0) - columns[diagonal, diagonal]
            middle = np.diag(table)
            gain += xlogx(middle + right + left + same) - xlogx(middle)
            out, into = table.sum(1), table.sum(0)
            gain -= xlogx(out + right.sum() + same) - xlogx(out) + xlogx(into + left.sum() + same) - xlogx(into)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            of[w] = best
            table[best] += right
            table[:, best] += left
            table[best, best] += same
        if not moved:
            break
    return of


def gains_of(table: np.ndarray) -> np.ndarray:
    """A row for each class left (the first half) or right of a word, what it speaks for each class, as a log."""
    classes, size = len(table) - 2, len(table)
    to_right = np.log((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * size))[:classes]
    to_left = np.log((table + 0.5) / (table.sum(0, keepdims=True) + 0.5 * size)).T[:classes]
    return np.concatenate([to_left, to_right], axis=1).T


def likelihood(table: np.ndarray) -> float:
    """The log likelihood of the class bigrams, without what no exchange changes."""
    return float(xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum())


def round_of(near: DataFrame, of: np.ndarray, table: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """The class table under of, the classes of all tokens, and their next classes by an earlier table.

    Words without a class all move; of the others, those that have their turn.
    """
    head, size, gains = len(of) - 2, len(table), gains_of(table)
    sent = near.sparkSession.sparkContext.broadcast(of)  # at most HEAD + 2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pairs = sent.value, np.zeros((size, size))
        for w, at, n in blocks(batches):
            first = np.append(True, w[1:] != w[:-1])
            words, rows = w[first], np.cumsum(first) - 1
            kinds = of[at % (head + 2)] + size * (at >= head + 2)
            seen = np.bincount(rows * 2 * size + kinds, n, len(words) * 2 * size).reshape(-1, 2 * size)
            own = of[words]
            pairs += np.eye(size)[own].T @ seen[:, size:]
            best = np.argmax(seen @ gains, axis=1)
            moving = np.flatnonzero((words < head) & (best != own) & ((own == size - 2) | ((words + turn) % 2 == 0)))
            yield pa.RecordBatch.from_arrays([pa.array(words[moving], pa.int64()), pa.array(best[moving].astype(float))], names=["at", "value"])
        cells = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(head + cells), pa.array(pairs.ravel()[cells])], names=["at", "value"])

    got = near.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # words that move, and the class table
    at, value = got["at"].to_numpy(), got["value"].to_numpy()
    sent.unpersist()
    now, then, is_word = np.zeros(size * size), of.copy(), at < head
    now[at[~is_word] - head] = value[~is_word]
    then[at[is_word]] = value[is_word].astype(of.dtype)
    return now.reshape(size, size), then


def exchanged(near: DataFrame, of: np.ndarray, table: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the head, the rest and the end, and the class table under them, from classes of the seeds and their table."""
    _, of = round_of(near, of, table, 0)
    best, least, turn, idle = None, -np.inf, 0, 0
    while idle < 2:
        turn += 1
        now, then = round_of(near, of, table, turn)
        gained = likelihood(now)
        idle = 0 if gained > least + tolerance * abs(least) or best is None else idle + 1
        if gained > least:
            best, least = (of, now), gained
        if (then == of).all():
            break
        of, table = then, now
    return best


def placed(seen: DataFrame, of: np.ndarray, table: np.ndarray, tokens: int) -> DataFrame:
    """(word, n, class, at): each word beyond the head, with its count and the best class that the class table gives it.

    Rows without a word have how often a class stands left (at < size) or right of such words of a class.
    tokens is how many of all tokens they are.
    """
    head, size, gains = len(of) - 2, len(table), gains_of(table)
    classes, parts = size - 2, min(max(1, -(-2 * tokens // RARE)), PARTS)
    sent = seen.sparkSession.sparkContext.broadcast(of)  # at most HEAD + 2 numbers
    fields = "words binary, owner binary, at binary, n binary"

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, path in paths(batches, head + 1):
            at, kinds = np.flatnonzero(path == head), sent.value[path]
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            words = np.array([numbers[w] for w in b" ".join(part.column("rare").to_pylist()).split(b" ")])
            names, dealt = list(numbers), np.array([zlib.crc32(w) % parts for w in numbers])
            order = np.argsort(dealt, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            words = place[words] * 2 * size
            keys, n = np.unique(np.concatenate([words + kinds[at - 1], words + size + kinds[at + 1]]), return_counts=True)
            owners, places = np.divmod(keys, 2 * size)
            # Words are in the order of their parts, each part's with numbers of its own; each word has an entry.
            begins = np.searchsorted(dealt[order], np.arange(parts))
            part_of_entry = dealt[order][owners]
            rows = pieces(part_of_entry, {"owner": (owners - begins[part_of_entry]).astype("<i4"), "at": places.astype("<i4"), "n": n.astype("<i4")})
            ends, names = np.append(begins[1:], len(order)), [names[i] for i in order.tolist()]
            blobs = pa.array([b" ".join(names[begins[p] : ends[p]]) for p in rows.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), blobs, *rows.columns[1:]], names=["part", "words", "owner", "at", "n"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, names = np.zeros((classes, 2 * size)), ["word", "n", "class", "at"]
        for blobs, *columns in by_part(batches):
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            own, at, n = ([np.frombuffer(x, "<i4") for x in c] for c in columns)
            owner = np.concatenate([np.array([numbers[w] for w in b.split(b" ")])[o] for b, o in zip(blobs, own)])
            at, n, words = np.concatenate(at), np.concatenate(n), list(numbers)
            order = np.argsort(owner, kind="stable")
            owner, at, n = owner[order], at[order], n[order]
            for begin in range(0, len(words), STEP):
                some, here = words[begin : begin + STEP], slice(*np.searchsorted(owner, [begin, begin + STEP]))
                seen = np.bincount((owner[here] - begin) * 2 * size + at[here], n[here], len(some) * 2 * size).reshape(-1, 2 * size)
                kinds = np.argmax(seen @ gains, axis=1)
                sums += np.eye(classes)[kinds].T @ seen
                # A token beyond the head has one neighbour to its left.
                arrays = pa.array(some, pa.binary()), pa.array(seen[:, :size].sum(1).astype(np.int64)), pa.array(kinds, pa.int64()), pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([*arrays], names=names)
        kinds, at = np.nonzero(sums)
        arrays = pa.nulls(len(at), pa.binary()), pa.array(sums[kinds, at].astype(np.int64)), pa.array(kinds, pa.int64()), pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*arrays], names=names)

    found = seen.where(F.length("rare") > 0).select("ids", "rare").mapInArrow(contexts, f"part long, {fields}")
    return together(found, parts).mapInArrow(best, "word binary, n long, class long, at long")


@dataclass
class Model:
    """Classes 0 to classes - 1, then the end and the unseen word; logs are to base 10."""

    classes: int
    all_tokens: int
    distinct: int
    ends: int
    #: word, n and class of every training word but the end.
    vocabulary: DataFrame
    #: The same of the words beyond the head.
    beyond: DataFrame
    #: word: (n, class) of the commonest.
    head: dict[bytes, tuple[int, int]]
    transition: np.ndarray
    #: What a class's emissions are divided by.
    scale: np.ndarray

    def emission(self, n: np.ndarray, class_of: np.ndarray) -> np.ndarray:
        return np.where(class_of >= self.classes, 0.0, np.log10(n + 0.5) - np.log10(self.scale)[class_of])


def counted(texts: DataFrame, head: int) -> tuple[DataFrame, pd.DataFrame]:
    """The counts of all words, and the commonest: word, h and n, the commonest first."""
    counts = common.materialise(word_counts(texts))
    top = commonest(counts, head).select("word", "h", "n").toArrow().to_pandas()  # at most head rows
    return counts, top.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def fitted(counts: DataFrame, top: pd.DataFrame, seen: DataFrame, seeds: int, classes: int) -> Model:
    """The model of encoded training texts."""
    all_tokens, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
    head, seeds = len(top), min(seeds, len(top))
    near = common.materialise(neighbours(seen, head, int(all_tokens)))
    bigrams = seed_bigrams(near, head, seeds, int(all_tokens))
    class_of = exchange(bigrams, classes) if seeds else np.array([1, 2])
    classes = int(class_of[-2])
    member = np.eye(classes + 2)[class_of]
    of = np.append(class_of[:seeds], [classes] * (head - seeds) + [classes, classes + 1]).astype(np.int32)
    of, pairs = exchanged(near, of, member.T @ bigrams @ member)

    found = common.materialise(placed(seen, of, pairs, int(all_tokens) - ends - int(top["n"].sum())))
    beyond = found.where("word IS NOT NULL").select("word", "n", "class")
    known = counts.sparkSession.createDataFrame(pa.table({"word": pa.array(top["word"], pa.binary()), "n": pa.array(top["n"], pa.int64()), "class": pa.array(of[:head], pa.int64())}))
    met = found.where("word IS NULL").groupBy("class", "at").agg(F.sum("n").alias("n")).collect()  # at most 2 (classes + 2) squared rows
    transition = class_table(met, pairs)
    scale = np.bincount(of[:head], top["n"] + 0.5, classes).astype(float)
    for k, n, size in beyond.groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        scale[k] += n + 0.5 * size
    scale[scale == 0] = 0.5
    kinds = classes + 2
    logs = np.log10((transition + 0.5) / (transition.sum(1, keepdims=True) + 0.5 * kinds))
    table = dict(zip(top["word"], zip(top["n"].tolist(), of[:head].tolist())))
    return Model(classes, int(all_tokens), int(distinct), int(ends), beyond.unionByName(known), beyond, table, logs, np.append(scale, [1.0, 1.0]))


def class_table(rows: list, pairs: np.ndarray) -> np.ndarray:
    """How often a class follows a class, from the pairs of the head and the end and the contexts of the other words."""
    rest, size = len(pairs) - 2, len(pairs)
    classes = rest
    left, right = np.zeros((classes, size)), np.zeros((classes, size))
    for k, at, n in rows:
        (left if at < size else right)[k, at % size] += n
    table = np.zeros((size, size))
    known = [*range(classes), classes + 1]  # the end is the last in contexts and the last but one here
    table[: classes + 1, : classes + 1] = pairs[np.ix_(known, known)]
    table[: classes + 1, :classes] += left[:, known].T
    table[:classes, : classes + 1] += right[:, known]
    if both := right[:, rest].sum():
        table[:classes, :classes] += np.outer(right[:, rest], left[:, rest]) / both
    return table


def train(texts: DataFrame, head: int = HEAD, seeds: int = SEEDS, classes: int = CLASSES) -> Model:
    counts, top = counted(texts, head)
    rows = texts.select(F.lit(None).cast("long").alias("id"), F.lit(False).alias("held_out"), common.TEXT)
    return fitted(counts, top, common.materialise(encoded(rows, top["word"].tolist())), seeds, classes)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, seeds: int = SEEDS, classes: int = CLASSES) -> DataFrame:
    fold = F.coalesce(common.doc_crc(F.col(id_col)) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), fold.alias("held_out"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(common.TEXT))
    counts, top = counted(rows.where("not held_out").select(common.TEXT), head)
    seen = common.materialise(encoded(rows, top["word"].tolist()))
    model = fitted(counts, top, seen.where("not held_out"), seeds, classes)
    return scored_ids(seen, model).withColumnRenamed("id", id_col)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """The scores of rows (id, held_out, text as bytes)."""
    return scored_ids(common.materialise(encoded(rows, list(model.head))), model)


def scored_ids(seen: DataFrame, model: Model) -> DataFrame:
    """The scores of texts that were encoded with the model's head."""
    head, end, unseen, transition = len(model.head), model.classes, model.classes + 1, model.transition
    base_scale = -float(np.log10(model.all_tokens + 0.5 * (model.distinct + 1)))
    n, class_of = np.array(list(model.head.values()), dtype=np.int64).reshape(-1, 2).T
    # Words beyond the head have the last place but one; they are joined later.
    base = np.append(np.log10(n + 0.5) + base_scale, [base_scale, np.log10(model.ends + 0.5) + base_scale])
    emission = np.append(model.emission(n, class_of), [0.0, 0.0])
    sent = seen.sparkSession.sparkContext.broadcast((base, emission, np.append(class_of, [-1, end])))
    end_known = int(model.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, emission, class_of = sent.value
        for part, path in paths(batches, head + 1):
            sizes = np.array([len(x) // 4 for x in part.column("ids").to_pylist()], dtype=np.int64)
            of_text = lambda values, begins=np.cumsum(sizes) - sizes: np.add.reduceat(values, begins)
            kinds, ids = class_of[path], path[1:]
            # A text's pairs begin at the end before it, and each text has an end.
            both = (kinds[:-1] >= 0) & (kinds[1:] >= 0)
            pairs = np.where(both, transition[kinds[:-1], kinds[1:]], 0.0)
            known = of_text((ids < head).astype(np.int64)) + end_known
            arrays = pa.array(sizes), pa.array(known), pa.array(of_text(base[ids])), pa.array(of_text(pairs + emission[ids]))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *arrays], names=["id", "held_out", "uid", "n_tokens", "known", "base", "local"])

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of = sent.value[2].astype(np.int16)
        for part, path in paths(batches, head + 1):
            kinds, at = class_of[path], np.flatnonzero(path == head)
            stops = np.cumsum([len(x) // 4 for x in part.column("ids").to_pylist()])  # the ends, in path
            uid = part.column("uid").to_numpy()[np.searchsorted(stops, at)]
            arrays = pa.array(uid), pa.array(at.astype(np.int32)), rare_words(part.column("rare")), pa.array(kinds[at - 1]), pa.array(kinds[at + 1])
            yield pa.RecordBatch.from_arrays([*arrays], names=["uid", "place", "word", "before", "after"])

    kind = seen.schema["id"].dataType.simpleString()
    local = seen.select("id", "held_out", "uid", "ids").mapInArrow(run, f"id {kind}, held_out boolean, uid long, n_tokens long, known long, base double, local double")
    rare = seen.where(F.length("rare") > 0)
    size = rare.agg(F.coalesce(F.sum(F.length("rare")), F.lit(0))).first()[0]
    parts = min(max(1, -(-size // (8 * RARE))), PARTS)
    tail = rare.select("uid", "ids", "rare").mapInArrow(beyond, "uid long, place int, word binary, before short, after short")
    met = tail.join(model.beyond, "word", "left").select("uid", "place", "before", "after", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(unseen)).cast("short").alias("class"))
    fields = {"uid": "<i8", "place": "<i4", "before": "<i2", "after": "<i2", "n": "<i8", "class": "<i2"}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def out() -> pa.RecordBatch:
            columns = {c: np.concatenate([b.column(c).to_numpy() for b in held]) for c in fields}
            part = part_of(columns["uid"], parts)
            order = np.argsort(part, kind="stable")
            return pieces(part[order], {c: x[order].astype(fields[c]) for c, x in columns.items()})

        for batch in batches:
            held.append(batch)
            total += batch.num_rows
            if total >= RARE:
                yield out()
                held, total = [], 0
        if total:
            yield out()

    model_emission = Model(model.classes, 0, 0, 0, None, None, {}, transition, model.scale).emission  # without the tables

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in by_part(batches):
            uid, place, before, after, n, k = (np.frombuffer(b"".join(x), kind) for x, kind in zip(columns, fields.values()))
            order = np.lexsort((place, uid))
            uid, before, after, n, k = (x[order] for x in (uid, before, after, n, k))
            # What stands before a rare word and is rare too is the one before it in the text.
            before = np.where(before >= 0, before, np.append(k[:1], k[:-1]))
            own = model_emission(n, k) + transition[before, k] + np.where(after >= 0, transition[k, np.maximum(after, 0)], 0.0)
            first = np.flatnonzero(np.append(True, uid[1:] != uid[:-1]))
            sums = (pa.array(np.add.reduceat(x, first)) for x in (np.log10(n + 0.5), own, (n > 0).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(uid[first]), *sums], names=["uid", "base_more", "more", "known_more"])

    sums = together(met.mapInArrow(dealt, "part long, " + ", ".join(f"{c} binary" for c in fields)), parts)
    sums = sums.mapInArrow(logs, "uid long, base_more double, more double, known_more long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return local.join(sums, "uid", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("known_more")).alias("n_known"),
        F.lit(model.all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_more")).alias("base_score"),
        (F.col("local") + zero("more")).alias("score"),
    )
