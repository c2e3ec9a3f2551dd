"""Names that do not collide: targets wanted twice, or taken already, get the next free number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonoteca.functions.text import suffix
from fonoteca.operators.scans import ranked, running_sum
from fonoteca.tables import written

#: Rows of a target, and numbers, in a bucket.
BUCKET = 1 << 16
#: 'stem (number)suffix', the number written as it would be given.
NUMBERED = r"(?s)^(.*) \(([2-9]|[1-9][0-9]{1,17})\)(\.[^./]*)?$"


def taken_numbers(names: DataFrame, name: str = "name") -> DataFrame:
    """name, number: which numbers of which names are taken by names of the form 'stem (number)suffix'."""
    part = lambda i: F.regexp_extract(name, NUMBERED, i)
    hits = names.where(F.col(name).rlike(NUMBERED)).select(F.concat(part(1), part(3)).alias("name"), part(2).cast("long").alias("number"))
    return hits.distinct()


def numbered(plan: DataFrame, target: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """plan, whose targets no two rows share and that none of existing (one column, names) has.

    A row whose `order` column (its present name) is its target stays as it is. Of the others that want a name
    the first has it, if it does not exist; the rest get ' (2)', ' (3)' ... before the suffix, in order, leaving
    out numbers whose names exist or are what some row wants. Names in existing count as taken even if their
    files are to be moved, so the plan can be carried out in any order. Rows without a target stay without one.

    A target that very many rows want is ordered by the hash of their names first, in buckets of about BUCKET
    rows. The k-th free number is k + 1 and as many more as are taken below it: numbers that are taken and rows
    that want one meet in order of k, in buckets too, and no target is one task.
    """
    # What works the targets out runs once.
    rows = written(plan).select(F.struct(*plan.columns).alias("row"), F.col(target).alias("name"), F.col(order).alias("own"))
    moves = F.col("name").isNotNull() & ~F.col("name").eqNullSafe(F.col("own"))
    wanted = rows.where(moves)
    sizes = wanted.groupBy("name").agg(F.count("*").alias("n"))
    # What a row that stays has exists as well.
    there = rows.where(~moves & F.col("name").isNotNull()).select("name")
    if existing is not None:
        there = there.union(existing.select(F.col(existing.columns[0]).alias("name")).where("name IS NOT NULL"))
    there = there.distinct().withColumn("there", F.lit(1))
    contested = sizes.join(there, "name", "left").where("n > 1 OR there = 1").select("name", "n", F.coalesce("there", F.lit(0)).alias("there"))

    met = wanted.join(contested, "name", "left")
    bucket = F.pmod(F.xxhash64("own"), F.ceil(F.col("n") / BUCKET))
    queue = written(ranked(met.where("n IS NOT NULL"), ["name"], bucket, ["own"], "k").select("row", "name", (F.col("k") - 1 + F.col("there")).alias("k")))

    taken = taken_numbers(there.select("name").union(sizes.select("name"))).join(contested.select("name"), "name", "left_semi")
    taken = ranked(taken, ["name"], F.expr(f"number div {BUCKET}"), ["number"], "j")
    # So many numbers are free below a taken one: those that are given a place beyond them jump over it.
    jumps = taken.groupBy("name", (F.col("number") - 1 - F.col("j")).alias("k")).agg(F.count("*").alias("weight"))
    none = F.lit(None).cast(queue.schema["row"].dataType).alias("row")
    both = queue.where("k > 0").select("name", "k", F.lit(0).cast("long").alias("weight"), F.lit(0).alias("kind"), "row").union(jumps.select("name", "k", "weight", F.lit(1), none))
    placed = running_sum(both, ["name"], F.expr(f"k div {BUCKET}"), F.col("weight"), ["k", "kind"], "jumped").where("kind = 0")

    number = (F.col("k") + 1 + F.col("jumped")).cast("string")
    ext = suffix("name")
    base = F.substring(F.col("name"), F.lit(1), F.length("name") - F.length(ext))
    given = placed.select("row", F.concat(base, F.lit(" ("), number, F.lit(")"), ext).alias("name"))
    given = given.union(queue.where("k = 0").select("row", "name")).union(met.where("n IS NULL").select("row", "name")).union(rows.where(~moves).select("row", "name"))
    return given.select(*(F.col("name").alias(c) if c == target else F.col(f"row.{c}").alias(c) for c in plan.columns))
