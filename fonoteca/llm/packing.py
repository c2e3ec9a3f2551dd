"""Packing with a controlled mixture: deficit round-robin over source queues.

Every source has a queue, in which its documents stand in the order in which they were tokenized, and
a target share of all tokens: the one given for it, or a part, by size, of what the given shares leave
to the sources without one. A queue is served units: pieces of QUANTUM tokens, the last of a document
shorter, so that every window holds each source's share but for a quantum or two. The next unit comes from the queue whose deficit, what its share of all tokens served so
far exceeds what it was served itself, is largest. A unit is never cut to fit; its queue overdraws,
and the deficit is carried into the next windows, over partitions alike. A queue that has run dry
leaves its share to the others; with the natural shares all run dry together.

The turn of a unit needs no simulation. A queue of share w is at its turn once the round-robin has
come to the tokens before the unit divided by w, so units are dealt out by that time, in buckets of
about BUCKET tokens whose bounds follow from the shares and sizes of the queues alone. The tokens
before a bucket are running sums, in two levels. What a document has in a bucket goes there as one row;
there one task parts it into units, puts all units in order, joins those that follow each other in their
document, and cuts at the ends of the windows, the sequences of SEQUENCE tokens. Only the last is short.
Queues start at times that differ by a hash, so that many small ones don't meet in one bucket.

Tokens are written once, as a table in the shared folder: 16-bit ids of each document. Defined
results: a null or empty text is the end id alone; a text of any length is cut; a null source is a
source of its own, and without a source column all rows are; repeated rows and rows with a null id are
packed as rows; no rows give no pieces; sources of equal turn go by a hash and name. A tokenizer of more than
65,536 ids, or one whose ids of a text are not those of its blank-separated words, is refused.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fonoteca.llm import common

SEQUENCE, QUANTUM, END = 4096, 128, 2
BUCKET = 1 << 20
#: Words whose ids a Python worker remembers over its tasks, about.
REMEMBERED = 700_000
#: Bytes of texts whose words are looked up together; the more, the fewer look-ups of common words.
RUN = 8 << 20
CHUNK = 1000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Marks that end words. Where a tokenizer parts them from letters and digits (of ASCII, which stay what they are), a word with some at its end is not encoded itself.
ENDS = ".,;:!?"
#: Words on which a tokenizer shows whether it joins what blanks part.
PROBE = "The the end. 12 345 it's , and e\u0301 \u00e9t\u00e9 -- x\u00df _a 'll \u4e2d\u6587 \U0001f600"


#: Words of small letters of Latin-1, and what a tokenizer does with texts that leaves each of them as it is, and whole.
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
KEEPS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
WHOLE = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def plain(tokenizer):
    """A tokenizer with the same ids for blank-separated words of LETTERS, but without the steps that do nothing to them; the same one if it has others."""
    spec = json.loads(tokenizer.to_str())
    steps = [(spec[k] or {}).get(f"{k}s" if k == "normalizer" else "pretokenizers", []) for k in ("normalizer", "pre_tokenizer")]
    if not steps[0] or any(step not in KEEPS for step in steps[0]) or [step if step == WHOLE else step["type"] for step in steps[1]] != [WHOLE, "ByteLevel"] or steps[1][1]["use_regex"]:
        return tokenizer
    if any(all(LETTERS(c) or c in f" {MARK}" for c in token["content"]) for token in spec["added_tokens"]):
        return tokenizer
    steps[1][0] = {"type": "WhitespaceSplit"}
    return type(tokenizer).from_str(json.dumps(spec | {"normalizer": None}))


def loaded(path: str):
    """The tokenizer, the marks that it parts from the words before them, the ids of the words that it has met, and the plain one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids_of = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    words = PROBE.split(" ")
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError(f"{path}: over 65536 ids")
    if any(ids_of(mark.join(words)) != [i for word in words for i in ids_of(word)] for mark in (" ", "\n", "  ")):
        raise ValueError(f"{path}: joins words, or has ids for blanks")
    pieces = lambda text: [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    parted = lambda mark: all(pieces(end + mark) == pieces(end) + pieces(mark) for end in ("a", "end", "z9", "1", "A", "\u00e9z"))
    return tokenizer, "".join(filter(parted, ENDS)) if tokenizer.pre_tokenizer else "", {}, plain(tokenizer)


def encode(texts: list[str], path: str) -> list[bytes]:
    """16-bit ids of each text. The tokenizer drops white space and never joins what it parts, so a
    text's ids are those of its blank-separated words, and a distinct word is encoded once; of words
    that differ in the marks at their end, what is before these. Words are looked up once a run of texts."""
    tokenizer, ends, known, of_letters = common.kept(("tokenizer", path), lambda: loaded(path))
    split = pc.split_pattern(pa.array([lowered(text).replace("\n", " ") for text in texts], pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if len(known) > REMEMBERED:
        known.clear()
    found = list(map(known.get, words))
    at_new = [i for i, own in enumerate(found) if own is None]
    new = {words[i] for i in at_new}
    ended = [(word, core, word[len(core) :]) for word in new if (core := word.rstrip(ends)) != word and core and core[-1].isascii() and core[-1].isalnum()]
    new.difference_update(word for word, _, _ in ended)
    new.update(part for _, *parts in ended for part in parts if part not in known)
    letters = set(filter(LETTERS, new))
    for by, some in ((of_letters, list(letters)), (tokenizer, list(new - letters))):
        for i in range(0, len(some), TOGETHER):
            known.update(encoded(by, some[i : i + TOGETHER]))
    known.update((word, known[core] + known[end]) for word, core, end in ended)
    for i in at_new:
        found[i] = known[words[i]]
    ids = pa.array(found, pa.large_binary()).take(coded.indices)
    # The ids of all words follow each other in one buffer; a text ends where its last word does.
    raw, at = ids.buffers()[2], np.frombuffer(ids.buffers()[1], dtype=np.int64)[split.offsets.to_numpy()].tolist()
    return [raw[begin:end].to_pybytes() for begin, end in zip(at, at[1:])]


def lowered(text: str) -> str:
    """Lower case, as the tokenizer makes it itself, where that is sure to be the same: in Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


#: Words encoded in one call, and the mark between them, which is one id.
TOGETHER, MARK = 500, "\x01"


def encoded(tokenizer, words: list[str]) -> Iterator[tuple[str, bytes]]:
    # Without offsets, which nothing here asks for.
    ids_of = lambda text: np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")
    ids, mark = ids_of(f" {MARK} ".join(words)), ids_of(MARK)[0]
    ends = np.flatnonzero(ids == mark).tolist()
    if len(ends) != len(words) - 1:  # a word holds the mark
        yield from ((word, ids_of(word).tobytes()) for word in words)
        return
    raw = ids.tobytes()
    for word, begin, end in zip(words, [0, *(e + 1 for e in ends)], [*ends, len(ids)]):
        yield word, raw[2 * begin : 2 * end]


def tokenized(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str) -> DataFrame:
    """A row of docs: its ids with the end id, the task that made it and the tokens of its source before it there."""
    # A source is its name after a mark; the mark of a null has no name.
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")) if source_col in docs.columns else F.lit("")
    source = docs.select(F.col(id_col).alias("id"), name.alias("source"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(common.TEXT))
    out = T.StructType([source.schema["id"], *T._parse_datatype_string("source string, ids binary, n long, task long, before long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, so_far, end = TaskContext.get().partitionId(), {}, np.array([END], dtype="<u2").tobytes()
        for batch in batches:
            for part in common.runs(batch, most=RUN):
                texts = [t.decode("utf-8", "replace") for t in part.column(2).to_pylist()]
                ids = [i + end for i in encode(texts, path)]
                before = []
                for name, own in zip(part.column(1).to_pylist(), ids):
                    before.append(so_far.get(name, 0))
                    so_far[name] = before[-1] + len(own) // 2
                n = [len(own) // 2 for own in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array([task] * len(n), pa.int64()), pa.array(before, pa.int64())],
                    names=out.names,
                )

    return source.mapInArrow(run, out)


def shares(queues: DataFrame, targets: dict[str | None, float] | None, every: int) -> tuple[F.Column, Callable[[F.Column], F.Column]]:
    """The round-robin's time after one token of a queue's row (source, queue_tokens), and, of a time, all tokens served."""
    targets = {"" if name is None else f"={name}": float(share) for name, share in (targets or {}).items()}
    if any(share <= 0 for share in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target shares are positive and add up to 1 at most")
    sizes = {r["source"]: r["queue_tokens"] for r in queues.where(F.col("source").isin(list(targets))).collect()} if targets else {}  # a row a target
    left = max(1 - sum(targets.values()), 1e-9)
    others = every - sum(sizes.values())
    pace = F.lit(others / left) / F.col("queue_tokens")
    for name in sizes:
        pace = F.when(F.col("source") == name, F.lit(1 / targets[name])).otherwise(pace)

    def served(time: F.Column) -> F.Column:
        out = F.least(F.lit(float(others)), time * left)
        for name, size in sizes.items():
            out = out + F.least(F.lit(float(size)), time * targets[name])
        return out

    return pace, served


def before(rows: DataFrame, keys: list[str], order: str, n: str) -> DataFrame:
    """rows with base, the sum of n over the rows of equal keys before them, summed in two levels."""
    rows = rows.withColumn("chunk", F.floor(F.col(order) / CHUNK))
    chunks = rows.groupBy(*keys, "chunk").agg(F.sum(n).alias("m"))
    over = Window.partitionBy(*keys).orderBy("chunk")
    chunks = chunks.select(*keys, "chunk", (F.sum("m").over(over) - F.col("m")).alias("base0"))
    within = Window.partitionBy(*keys, "chunk").orderBy(order)
    return rows.withColumn("base1", F.sum(n).over(within) - F.col(n)).join(chunks, [*keys, "chunk"]).withColumn("base", F.col("base0") + F.col("base1")).drop("chunk", "base0", "base1")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokenizer_path: str | None = None,
    targets: dict[str | None, float] | None = None,
) -> DataFrame:
    """The pieces of all rows: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    tokens = common.materialise(tokenized(docs, id_col, text_col, source_col, tokenizer_path or default_tokenizer()))
    sums = common.materialise(tokens.groupBy("task", "source").agg(F.sum("n").alias("m")))
    queues = sums.groupBy("source").agg(F.sum("m").alias("queue_tokens"))
    every = sums.agg(F.sum("m")).first()[0] or 0
    pace, served = shares(queues, targets, every)

    places = before(sums, ["source"], "task", "m").join(queues.withColumn("pace", pace), "source").select("task", "source", "base", "pace")
    rows = tokens.join(places, ["task", "source"]).withColumn("place", F.col("base") + F.col("before"))
    rows = rows.withColumn("phase", F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / F.lit(float(1 << 20)))

    def bucket_at(start: F.Column) -> F.Column:
        time = (F.col("place") + start + F.col("phase") * F.least(F.lit(QUANTUM), F.col("n") - start)) * F.col("pace")
        return F.floor(served(time) / BUCKET)

    # Most documents are in one bucket; of others, the units at which a new one begins are looked for.
    zero, last = F.lit(0).cast("long"), F.floor((F.col("n") - 1) / QUANTUM) * QUANTUM
    units = F.sequence(zero, last, F.lit(QUANTUM).cast("long"))
    heads = F.when(bucket_at(zero) == bucket_at(last), F.array(zero)).otherwise(F.filter(units, lambda s: (s == 0) | (bucket_at(s) != bucket_at(F.greatest(s - QUANTUM, zero)))))
    parts = rows.withColumn("heads", heads).select("*", F.posexplode("heads").alias("i", "start"))
    parts = parts.withColumn("length", F.coalesce(F.get("heads", F.col("i") + 1), F.col("n")) - F.col("start")).withColumn("bucket", bucket_at(F.col("start")))
    starts = before(parts.groupBy("bucket").agg(F.sum("length").alias("m")).withColumn("all", F.lit(0)), ["all"], "bucket", "m").select("bucket", F.col("base").alias("bucket_base"))
    cut = F.expr("substring(ids, cast(2 * start + 1 as int), cast(2 * length as int))")
    dealt = parts.select("bucket", "source", "place", "pace", "phase", "id", "start", "length", F.col("n").alias("doc_tokens"), cut.alias("ids")).join(starts, "bucket")
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string").fields])
    names = out.names

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("source", "ascending"), ("place", "ascending"), ("start", "ascending")])
        begins, lengths, tokens, place, pace, phase = (table.column(c).to_numpy() for c in ("start", "length", "doc_tokens", "place", "pace", "phase"))
        # Units of each row; a row begins at a unit's beginning.
        many = -(-lengths // QUANTUM)
        row = np.repeat(np.arange(len(many)), many)
        skip = QUANTUM * (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
        size = np.minimum(QUANTUM, lengths[row] - skip)
        at = begins[row] + skip
        time = (place[row] + at + phase[row] * np.minimum(QUANTUM, tokens[row] - at)) * pace[row]
        order = np.argsort(time, kind="stable")  # of equal times by source and place
        row, skip, size = row[order], skip[order], size[order]
        # Units that go on where the one before ends are one run; runs are cut at the ends of windows.
        fresh = np.append(True, (row[1:] != row[:-1]) | (skip[1:] != skip[:-1] + size[:-1]))
        first = np.flatnonzero(fresh)
        run_at = (np.cumsum(size) - size)[first]
        total, base = int(size.sum()), table.column("bucket_base")[0].as_py()
        cuts = np.union1d(run_at, np.arange(-base % SEQUENCE, total, SEQUENCE))
        of = np.searchsorted(run_at, cuts, side="right") - 1
        of_row, skip = row[first][of], skip[first][of] + cuts - run_at[of]
        size = np.diff(np.append(cuts, total))
        ids = memoryview(np.frombuffer(b"".join(table.column("ids").to_pylist()), dtype="<u2").astype("<u4").tobytes())
        begin = 4 * ((np.cumsum(lengths) - lengths)[of_row] + skip)
        crc = [zlib.crc32(ids[a : a + 4 * n]) for a, n in zip(begin.tolist(), size.tolist())]
        whole = table.select(["id", "source"]).take(pa.array(of_row))
        columns = (begins[of_row] + skip, size, crc, tokens[of_row], (base + cuts) // SEQUENCE, (base + cuts) % SEQUENCE)
        return pa.Table.from_arrays([whole.column("id"), *(pa.array(c, pa.int64()) for c in columns), whole.column("source")], names=names)

    pieces = dealt.groupBy("bucket").applyInArrow(run, out)
    return pieces.withColumn("source", F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)))
