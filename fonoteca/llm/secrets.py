r"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regex gives a Boolean query over trigrams: alternatives, each a set of trigrams that all
must occur (Russ Cox, "Regular Expression Matching with a Trigram Index", 2012). The index holds a
posting (trigram, row key) for each trigram that any query asks for and that occurs in a lower-cased
text; the key is a hash of the text, so that copies are indexed once. Postings are intersected for
each alternative by counting them, and texts whose key is left are verified with the regex. A rule
whose regex demands no trigram (hex) scans every text.

Kinds: assign, access and hex (found as the contract says), and github, slack, google, jwt and pem,
which only this operator adds. Spans are code points, end exclusive. Defined results: a null or empty
text has no spans; very long texts are scanned whole; a null id stays null; repeated rows are each
scanned; an empty table gives an empty table; all columns but id and text are left alone.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonoteca.llm import common


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The capture group that must have `least` characters; matches that have fewer are dropped.
    group: int = 0
    least: int = 0


#: {14,} and {16,} find what + and a later check of the length find: a run that is too short is too
#: short from any later start as well.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: A piece of a pattern with more literal readings than this counts as unknown.
READINGS = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The alternatives of the trigrams that a match must hold, lower-cased; None if there are none."""
    exact, needed = readings(parser.parse(pattern))
    found = joined(needed, exact) if exact is not None else needed
    least = [part for part in found if not any(other < part for other in found)]
    return sorted(least, key=sorted) if least and all(least) else None


Query = list[frozenset[str]]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def joined(needed: Query, exact: set[str]) -> Query:
    """needed, and one of the literal readings."""
    return list({a | trigrams(b) for a in needed for b in exact})


def readings(tree) -> tuple[set[str] | None, Query]:
    """All strings that a piece of the pattern can match, if they are few, and the trigrams it needs."""
    current: set[str] = {""}
    needed: Query = [frozenset()]
    whole = True
    for kind, value in tree:
        exact, own = reading(kind, value)
        if exact is None or len(exact) * len(current) > READINGS:
            needed, current, whole = joined(needed, current), {""}, False
            if exact is not None:
                current = exact
        else:
            current = {a + b for a in current for b in exact}
        both = list({a | b for a in needed for b in own})
        needed = both if len(both) <= READINGS else needed
    if whole:
        return current, needed
    return None, joined(needed, current)


def reading(kind, value) -> tuple[set[str] | None, Query]:
    free: Query = [frozenset()]
    if kind is op.LITERAL:
        return {chr(value).lower()}, free
    if kind is op.IN:
        chars = {chr(v).lower() for k, v in value if k is op.LITERAL}
        return (chars if len(chars) <= 6 and all(k is op.LITERAL for k, _ in value) else None), free
    if kind is op.SUBPATTERN:
        return readings(value[-1])
    if kind is op.BRANCH:
        parts = [readings(branch) for branch in value[1]]
        if all(exact is not None for exact, _ in parts):
            return {s for exact, _ in parts for s in exact}, free
        return None, [q for exact, own in parts for q in (joined(own, exact) if exact is not None else own)]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        exact, own = readings(inner)
        if least == 0:
            return ({"", *exact} if most == 1 and exact is not None else None), free
        if least == most and exact is not None and len(exact) == 1:
            return {next(iter(exact)) * least}, free
        return None, joined(own, exact) if exact is not None else own
    return None, free


QUERIES = {rule.kind: trigram_query(rule.pattern) for rule in RULES}
ASKED = sorted({t for query in QUERIES.values() for part in query or () for t in part})


def postings(docs: DataFrame, text: str) -> DataFrame:
    """The inverted index: (trigram, key), for the trigrams that the rules' queries ask for."""
    lowered = docs.select(F.xxhash64(text).alias("key"), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in ASKED)))
    return lowered.select("key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame) -> DataFrame:
    """(key, kinds): the rules for which some alternative has all its trigrams among the postings of a key.

    The count of the postings of an alternative under a key, against its size, is the intersection of
    its posting lists; the lists themselves, which grow with the corpus, are never gathered.
    """
    asks = [(t, kind, n, len(part)) for kind, query in QUERIES.items() for n, part in enumerate(query or ()) for t in part]
    table = index.sparkSession.createDataFrame(asks, "trigram string, kind string, part int, size int")  # as large as RULES
    met = index.join(F.broadcast(table), "trigram").groupBy("key", "kind", "part").agg(F.countDistinct("trigram").alias("n"), F.first("size").alias("size"))
    return met.where("n = size").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind's place in RULES, end, kind>>: leftmost non-overlapping matches.

    The pieces between the matches and the matches' own lengths add up to their places.
    """
    place = [r.kind for r in RULES].index(rule.kind)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), found.alias("match"), group.alias("group"))
    empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,ok:boolean>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        ok = x["match"].isNotNull() & (F.length(x["group"]) >= rule.least)
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"), ok.alias("ok"))
        return F.struct(end.alias("at"), F.when(F.coalesce(ok, F.lit(False)), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    every = F.aggregate(zipped, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.pattern), every).otherwise(empty)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column __spans, in the order of starts and kinds."""
    docs = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    hits = candidates(postings(docs, "__text")).withColumnRenamed("key", "__key").withColumnRenamed("kinds", "__kinds")
    marked = docs.withColumn("__key", F.xxhash64("__text")).join(hits, "__key", "left")
    empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,ok:boolean>>")
    text = F.col("__text")
    scans = [
        matches(text, rule) if QUERIES[rule.kind] is None else F.when(F.array_contains("__kinds", rule.kind), matches(text, rule)).otherwise(empty)
        for rule in RULES
    ]
    return marked.withColumn("__spans", F.array_sort(F.concat(*scans))).drop("__text", "__key", "__kinds")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = find(docs.select(id_col, text_col), text_col)
    of = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("__spans", lambda s: s["kind"].isin(*BASE))
    return found.select(id_col, *map(of, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("__spans")).alias("spans"))


@common.apart
def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret replaced; overlapping spans become one mask."""
    found = find(docs, text_col)
    text, zero = F.col(text_col), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(apart, F.concat(acc["out"], kept, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("__spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    masked = found.withColumn(text_col, F.when(F.size("__spans") > 0, done).otherwise(text))
    counted = {"n_chars": F.when(F.size("__spans") > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return masked.withColumns(counted).select(*docs.columns)
