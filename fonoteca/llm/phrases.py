"""Phrases whose words stick together: suffix arrays over word ids, one a shard, merged by key.

A shard is a run of texts of one language, cut into pieces and words and written as an array of word ids.
Passes over the shards count what may still be part of a common phrase: words, pairs of common words, and
phrases of common pairs; each pass drops what is too rare in all shards together, so that the last, which
spells phrases out, has little left. A suffix array, made by prefix doubling, puts equal phrases of a shard
side by side, and the intervals of its common prefixes are their counts.

The passes before the last count by hashes of 40 bits: two words of one hash are counted together, so that a
word may be kept that is too rare, and none is lost. What is returned comes from counts by the phrases.
Keys and their counts go from shards to merging tasks in packed runs, one a shard and range of hashes, so a
key has a row a shard at most, whatever its count; ranges are as many as keep a merging task small.

Nulls and ties: a null text is an empty one, and has no words; a null language is `und`. Rows repeated, or
with one id, all count. Equal scores are told apart by the count and then by the bytes of the phrase.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fonoteca.llm.common import give_up, materialise

LONGEST = 5
#: Bytes of text in the shards that a task makes at a time; a longer text is a shard of its own, cut between pieces.
SHARD_BYTES = 16 << 20
#: Keys that a merging task gets, about, and the most ranges of keys.
MERGED, RANGES = 1 << 20, 1 << 20
#: Bits of the keys by which a pass counts. What shares a key with something common is kept for nothing.
KEY_BITS = 40
#: Totals of at most so many languages are broadcast.
LANGUAGES = 10_000
#: Text that ends a piece, and text that ends a word. Fixed values.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_ENDS = b" \t"

_KIND = np.zeros(256, np.uint8)
_KIND[list(WORD_ENDS)] = 1
_KIND[list(PIECE_ENDS)] = 2


def split(text: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of a text in lower case, by their place in a list of words, and the number of each one's piece."""
    data = np.frombuffer(text.lower(), np.uint8)
    kind = _KIND[data]
    letters = kind == 0
    begins = np.flatnonzero(letters & np.concatenate(([True], ~letters[:-1])))
    ends = np.flatnonzero(letters & np.concatenate((~letters[1:], [True]))) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - begins))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[letters])])
    breaks = np.flatnonzero(kind == 2)
    return words.dictionary_encode(), np.searchsorted(breaks, begins)


def laid_out(ids: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Ids from 1, with a 0 after each piece."""
    ends = np.flatnonzero(np.diff(pieces)) + 1
    return np.append(np.insert(ids.astype(np.int32) + 1, ends, 0), np.int32(0))


def suffixes(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes that begin with a word, in order of their first `longest` words or more; how many words each
    shares with the one before it, up to `longest`; and how many each has to the end of its piece (a 0)."""
    starts = np.flatnonzero(tokens)
    left = room(tokens)[starts]
    rank = tokens.astype(np.int64)
    order, width, most = np.argsort(rank[starts], kind="stable"), 1, int(tokens.max(initial=0)) + 1
    while width < longest:
        inside = left > width
        key = rank[starts] * most
        key[inside] += rank[starts[inside] + width]
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[starts[order]] = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))[: len(order)])
        most, width = len(order) + 1, width * 2
    sa = starts[order]
    shared = np.zeros(len(sa), np.int8)
    same = np.ones(max(len(sa) - 1, 0), bool)
    padded = np.concatenate((tokens, np.zeros(longest, tokens.dtype)))
    for k in range(longest):
        here = padded[sa + k]
        same &= (here[1:] == here[:-1]) & (here[1:] != 0)
        shared[1:] += same
    return sa, shared, left[order]


def room(tokens: np.ndarray) -> np.ndarray:
    """For each place, the words from it to the end of its piece."""
    end = tokens == 0
    return np.append(np.flatnonzero(end), len(tokens))[np.cumsum(end) - end] - np.arange(len(tokens))


def intervals(sa: np.ndarray, shared: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the count of each phrase of n words: runs of suffixes that share n words or more.

    What stands between two suffixes that share n words shares these, and so is long enough too.
    """
    rows = np.flatnonzero(left >= n)
    heads = np.flatnonzero(shared[rows] < n)
    return sa[rows[heads]], np.diff(np.append(heads, len(rows)))


def hashed(words: list[bytes], lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ np.uint64(0xD1B54A32D192ED03))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_of(hashes: np.ndarray, tokens: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the phrases of n words at the given places, by those of their words."""
    out = hashes[tokens[where] - 1]
    for k in range(1, n):
        out = joined(out, hashes[tokens[where + k] - 1])
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, as planes of their bytes, compressed."""
    planes = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays))
    return len(arrays[0]).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    n, sizes = int.from_bytes(data[:8], "little"), [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(pa.decompress(data[8:], n * sum(sizes), "zstd", asbytes=True), np.uint8).reshape(sum(sizes), n)
    ends = np.cumsum([0, *sizes])
    return [np.ascontiguousarray(planes[b:e].T).reshape(-1).view(k) for b, e, k in zip(ends, ends[1:], kinds)]


def texts_packed(texts: list[bytes]) -> bytes:
    """Texts without line ends, compressed."""
    data = b"\n".join(texts)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def texts_of(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, "zstd", asbytes=True).split(b"\n") if n else []


def shortened(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS)


def key_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys in order, as their differences, and their counts."""
    order = np.argsort(keys)
    return packed(np.diff(keys[order], prepend=np.uint64(0)), counts[order].astype(np.uint32))


def keys_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpacked(data, np.uint64, np.uint32)
    return np.cumsum(steps, dtype=np.uint64), counts


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """Runs of whole pieces of about `most` bytes; a longer piece is a run of its own."""
    begin = 0
    while len(text) - begin > most:
        window = max(text.rfind(bytes([c]), begin, begin + most) for c in PIECE_ENDS)
        if window < begin:
            window = min((x for x in (text.find(bytes([c]), begin) for c in PIECE_ENDS) if x >= 0), default=len(text))
        yield text[begin : window + 1]
        begin = window + 1
    yield text[begin:]


_SHARD = "shard long, lang string, n_words long, words binary, tokens binary, n_keys long, keys binary"


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _arrow(fields: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _row(values: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def shards(docs: DataFrame) -> DataFrame:
    """Shards of all texts: their words, hashes and counts of these, and the ids of the words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_up()
        schema, at, held, size = _arrow(_SHARD), TaskContext.get().partitionId() << 32, {}, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal at
            for lang, texts in held.items():
                words, pieces = split(b"\n".join(texts))
                if not len(words):
                    continue
                ids = words.indices.to_numpy(zero_copy_only=False)
                counts = np.bincount(ids, minlength=len(words.dictionary))
                order = np.argsort(-counts, kind="stable")  # commonest first: their ids are small
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                distinct = words.dictionary.take(pa.array(order))
                distinct = distinct.to_pylist()
                keys = shortened(hashed(distinct, lang))
                yield _row((at, lang, len(ids), texts_packed(distinct), packed(laid_out(place[ids], pieces)), len(keys), key_run(keys, counts[order])), schema)
                at += 1
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                for part in _cut(text.as_py(), SHARD_BYTES):
                    if size and size + len(part) > SHARD_BYTES:
                        yield from flushed()
                        size = 0
                    held.setdefault(lang.as_py(), []).append(part)
                    size += len(part)
        yield from flushed()

    source = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.coalesce(F.col("lang"), F.lit("und")))
    return source.mapInArrow(run, _SHARD)


_PART = "part int, shard long, run binary"


def _ranged(bits: int):
    """The keys of each shard in 2**bits ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_PART)
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = keys_of(data.as_py())
                part = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
                ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(keys))
                rows = [(part[b], key_run(keys[b:e], counts[b:e])) for b, e in zip([0, *ends], ends) if e > b]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([shard] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    return run


def _merging(least: int):
    def run(table: pa.Table) -> pa.Table:
        """shard, run: of each shard's keys of a range those that all shards together have often enough."""
        runs = [keys_of(x) for x in table["run"].to_pylist()]
        keys, counts = (np.concatenate(c) for c in zip(*runs))
        distinct, at = np.unique(keys, return_inverse=True)
        often = (np.bincount(at, counts, len(distinct)) >= least)[at]
        ends = np.cumsum([0, *(len(k) for k, _ in runs)])
        stay = [(shard, key_run(keys[b:e][often[b:e]], counts[b:e][often[b:e]])) for shard, b, e in zip(table["shard"].to_pylist(), ends, ends[1:]) if often[b:e].any()]
        return pa.table({"shard": pa.array([s for s, _ in stay], pa.int64()), "run": pa.array([r for _, r in stay], pa.binary())})

    return run


def _bits(n: int) -> int:
    """Of so many ranges that each has about MERGED of n keys."""
    return max(0, min(RANGES, -(-n // MERGED)) - 1).bit_length()


def _left(counted: DataFrame, least: int) -> DataFrame:
    """shard, runs: of each shard's keys those that all shards together have `least` times."""
    bits = _bits(counted.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0])
    parts = counted.select("shard", "keys").mapInArrow(_ranged(bits), _PART)
    merged = parts.groupBy("part").applyInArrow(_merging(least), "shard long, run binary")
    return merged.groupBy("shard").agg(F.collect_list("run").alias("runs"))


def _kept(runs: list[bytes] | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(keys_of(r)[0] for r in runs or [])])


_LESS = "shard long, lang string, n_words long, words binary, f binary, tokens binary, n_keys long, keys binary"


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of common words alone, and the keys of their pairs; runs of one word are left out."""
    give_up()
    schema = _arrow(_LESS)
    for batch in batches:
        for i in range(batch.num_rows):
            shard, lang, words, tokens, runs = (batch.column(c)[i] for c in range(5))
            lang, words = lang.as_py(), texts_of(words.as_py())
            keys = hashed(words, lang)
            (tokens,) = unpacked(tokens.as_py(), np.int32)
            stay = np.flatnonzero(np.isin(shortened(keys), _kept(runs.as_py())))
            new = np.zeros(len(keys) + 1, np.int32)
            new[stay + 1] = np.arange(1, len(stay) + 1)
            tokens = new[tokens]
            f = np.bincount(tokens, minlength=len(stay) + 1)[1:]
            tokens = _runs(tokens)
            where, n = intervals(*suffixes(tokens, 2), 2)
            pairs = shortened(hash_of(keys[stay], tokens, where, 2))
            yield _row((shard.as_py(), lang, len(stay), texts_packed([words[x] for x in stay]), packed(f), packed(tokens), len(pairs), key_run(pairs, n)), schema)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of common pairs alone, and the keys of their longer phrases."""
    give_up()
    schema = _arrow(_LESS)
    for batch in batches:
        for i in range(batch.num_rows):
            shard, lang, words, f, tokens, runs = (batch.column(c)[i] for c in range(6))
            hashes = hashed(texts_of(words.as_py()), lang.as_py())
            (tokens,) = unpacked(tokens.as_py(), np.int32)
            places = np.flatnonzero((tokens[:-1] != 0) & (tokens[1:] != 0))
            rare = places[~np.isin(shortened(hash_of(hashes, tokens, places, 2)), _kept(runs.as_py()))]
            tokens = _runs(np.insert(tokens, rare + 1, 0))
            array = suffixes(tokens, LONGEST)
            found = [(shortened(hash_of(hashes, tokens, where, n)), c) for n in range(3, LONGEST + 1) for where, c in [intervals(*array, n)]]
            keys, counts = (np.concatenate(c) for c in zip(*found))
            yield _row((shard.as_py(), lang.as_py(), len(hashes), words.as_py(), f.as_py(), packed(tokens), len(keys), key_run(keys, counts)), schema)


def _runs(tokens: np.ndarray) -> np.ndarray:
    """The runs of two words or more, a 0 after each."""
    word = tokens != 0
    stays = word & (np.append(word[1:], False) | np.insert(word[:-1], 0, False)[: len(word)])
    return tokens[stays | (~word & np.insert(stays[:-1], 0, False)[: len(word)])]


_SPELLED = "part int, lang string, phrases binary, counts binary"


def _spelled(parts: int):
    """The words and the common phrases of each shard with their counts, in parts by the hash of the phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        schema = _arrow(_SPELLED)
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words, f, tokens, runs = (batch.column(c)[i] for c in range(5))
                words, left = texts_of(words.as_py()), _kept(runs.as_py())
                hashes = hashed(words, lang.as_py())
                (f,), (tokens,) = unpacked(f.as_py(), np.int64), unpacked(tokens.as_py(), np.int32)
                phrases, counts, keys = list(words), [f], [hashes]
                array = suffixes(tokens, LONGEST)
                for n in range(2, LONGEST + 1):
                    where, c = intervals(*array, n)
                    key = hash_of(hashes, tokens, where, n)
                    if n > 2:
                        stay = np.isin(shortened(key), left)
                        where, c, key = where[stay], c[stay], key[stay]
                    phrases += [b" ".join([words[x] for x in row]) for row in (tokens[where[:, None] + np.arange(n)] - 1).tolist()]
                    counts, keys = [*counts, c], [*keys, key]
                part = (np.concatenate(keys) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                ends = np.append(np.flatnonzero(np.diff(part[order])) + 1, len(order))
                counts = np.concatenate(counts)
                for b, e in zip([0, *ends], ends):
                    if e > b:
                        at = order[b:e]
                        yield _row((int(part[at[0]]), lang.as_py(), texts_packed([phrases[x] for x in at]), packed(counts[at])), schema)

    return run


_FOUND = "lang string, phrase string, size int, f long"


def _summed(least: int):
    def run(table: pa.Table) -> pa.Table:
        """The phrases of a part that are common, by their words."""
        lists = [texts_of(x) for x in table["phrases"].to_pylist()]
        langs = [lang for lang, texts in zip(table["lang"].to_pylist(), lists) for _ in texts]
        phrases = pa.array([t for texts in lists for t in texts], pa.binary()).cast(pa.string())
        f = np.concatenate([unpacked(x, np.int64)[0] for x in table["counts"].to_pylist()])
        rows = pa.table({"lang": langs, "phrase": phrases, "size": pc.add(pc.count_substring(phrases, " "), 1), "f": f})
        sums = rows.group_by(["lang", "phrase", "size"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "size", "f"])
        return sums.filter(pc.greater_equal(sums["f"], least)).cast(_arrow(_FOUND))

    return run


def counts(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all words and phrases of up to five words found `least` times, and (lang, n)."""
    whole = materialise(shards(docs))
    pairs = materialise(whole.select("shard", "lang", "words", "tokens").join(_left(whole, least), "shard").select("shard", "lang", "words", "tokens", "runs").mapInArrow(_common, _LESS))
    longer = materialise(pairs.drop("n_keys", "keys").join(_left(pairs, least), "shard", "left").select("shard", "lang", "words", "f", "tokens", "runs").mapInArrow(_paired, _LESS))
    n = pairs.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    last = longer.drop("n_keys", "keys").join(_left(longer, least), "shard", "left").select("lang", "words", "f", "tokens", "runs")
    found = last.mapInArrow(_spelled(1 << _bits(n)), _SPELLED).groupBy("part").applyInArrow(_summed(least), _FOUND)
    return materialise(found), materialise(whole.groupBy("lang").agg(F.sum("n_words").alias("n")))


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase of two words or more, by its lowest-scoring cut."""
    phrases = found.where("size > 1").withColumnRenamed("f", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")})
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    # Few languages, which is looked at, are sent to the tasks: dealt out by language, a common one's phrases would meet in one.
    totals = F.broadcast(totals) if totals.count() <= LANGUAGES else totals
    met = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    met = met.withColumn("above", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n"))).withColumn("below", wide("l") * wide("r"))
    met = met.withColumn("score", F.expr("above div below"))
    least = met.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
    return least.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def longest(found: DataFrame) -> DataFrame:
    """lang, phrase, a of the phrases that are in a longer one as often as that is: to be dropped.

    What is in between two such phrases is as common as they are, so one word more is enough to look at.
    """
    longer = found.where("size > 2")
    inner = F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))
    return longer.select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("a")).distinct()


def collocations(docs: DataFrame, least: int = 100, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `most` phrases of each language."""
    found, totals = counts(docs, least)
    rows = scored(found, totals).join(longest(found), ["lang", "phrase", "a"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents
), lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, cast(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
sized AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM places),
found AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM sized GROUP BY 1, 2, 3 HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM found WHERE k > 1),
parts AS (SELECT x.lang, x.phrase, x.k, a, c, y.f AS l, z.f AS r, n, (1000::HUGEINT * a * n) // (y.f::HUGEINT * z.f) AS score FROM cuts x
  JOIN found y ON y.lang = x.lang AND y.phrase = array_to_string(x.w[1:c], ' ') JOIN found z ON z.lang = x.lang AND z.phrase = array_to_string(x.w[c + 1:x.k], ' ') JOIN totals t ON t.lang = x.lang),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS i FROM parts) WHERE i = 1),
kept AS (SELECT * FROM lowest p WHERE NOT EXISTS (SELECT 1 FROM found q WHERE q.lang = p.lang AND q.k > p.k AND 100 * q.f >= 100 * p.a AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, cast(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
