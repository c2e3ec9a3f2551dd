"""Exact dedup: rows are combined by their whole text, locally, then by salted digest, then over the salts.

Built of DataFrame functions only. Each of the three steps compares whole texts, so a digest only says
where a row is dealt to; texts that share one are told apart. A text that very many rows have is combined
by the tasks that read it, by its salts after that, and once more over at most SALTS rows; all other texts
are done after the first shuffle, which moves each text once a task at most.

Nulls and ties: a null text is an empty one, and empty texts are equal to each other. Of equal texts the
row of the largest doc_id stays. A null doc_id is less than all others; where no row of a text has an id,
all its rows stay, and so do rows repeated with their id, as nothing tells them apart. `unique` keeps one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonoteca.llm.common import materialise

#: Partial groups of a hot digest after the first merge.
SALTS = 32
#: A digest is hot if more than one row in so many has it: at most so many digests are, and they are broadcast.
HOT_SHARE = 10_000
#: Fewer rows than this are never hot.
HOT_ROWS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _by_digest(texts: DataFrame) -> DataFrame:
    """digest, keep_id, group_size, n_texts; the first two count only where a digest stands for one text."""
    return texts.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("n_texts"))


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept: a row for each row of docs, those that go included."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("digest", digest(F.col("text")))
    ids = materialise(keyed.select("doc_id", "digest"))
    n = ids.count()
    often = (F.col("n") >= HOT_ROWS) & (F.col("n") * HOT_SHARE > n)
    hot = F.broadcast(materialise(ids.groupBy("digest").agg(F.count("*").alias("n")).where(often).select("digest", F.lit(1).alias("hot"))))

    salt = F.when(F.col("hot") == 1, F.pmod(F.spark_partition_id(), F.lit(SALTS)) + 1).otherwise(0)
    local = keyed.join(hot, "digest", "left").withColumn("salt", salt).withColumnsRenamed({"doc_id": "keep_id"}).withColumn("group_size", F.lit(1).cast("long"))
    salted = _merged(local, "digest", "salt", "text")
    first = materialise(salted.withColumn("text", F.when(F.col("salt") > 0, F.col("text"))))
    last = _by_digest(_merged(first.where("salt > 0"), "digest", "text"))
    cold = _by_digest(first.where("salt = 0"))

    marked = ids.join(hot, "digest", "left")
    found = marked.where("hot = 1").drop("hot").join(F.broadcast(last), "digest").unionByName(marked.where("hot IS NULL").drop("hot").join(cold, "digest"))
    found = materialise(found)
    if not found.where("n_texts > 1").isEmpty():
        shared = found.where("n_texts > 1").select("digest").distinct()
        again = keyed.join(shared, "digest", "left_semi")
        exact = _merged(again.select(F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest", "text"), "digest", "text")
        found = found.where("n_texts = 1").drop("n_texts").unionByName(again.join(exact, ["digest", "text"]).drop("text"))
    return found.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def unique(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each text, with all their columns."""
    stays = groups(docs).where("kept").select(F.col("doc_id").alias("i"), F.col("digest").alias("d")).distinct()
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("i0"), text.alias("t"), sha256(text).alias("d0"))
    met = rows.join(stays, F.col("i0").eqNullSafe(F.col("i")) & (F.col("d0") == F.col("d")), "left_semi")
    return met.dropDuplicates(["t"]).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    return groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = (
    "SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 "
    "FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)"
)
