"""Running sums, ranks and moving averages over ordered rows of a key, in two levels, so that a key is no task.

A key's rows are dealt to buckets that follow their order. Each bucket is scanned by itself, and what the
buckets before it hold is added: a bucket's sum is one row, so that only these rows of a key meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An average forgets what is older than this many time constants: e to the power of less is 0 as a double.
FORGOTTEN = 750.0
#: Time constants in a bucket of an average.
SPAN = 50.0


def running_sum(rows: DataFrame, keys: list[str], bucket: Column, weight: Column, order: list[Column | str], name: str) -> DataFrame:
    """rows with the sum of weights up to and with each row, by bucket and then by order; buckets must follow the order.

    Rows that are equal in order are told apart by chance alone, so order should end in what is unique.
    """
    packed = rows.select(F.struct(*rows.columns).alias("row"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), bucket.alias("bucket"), weight.alias("weight"), *(_ordered(o, i) for i, o in enumerate(order)))
    k = [f"k{i}" for i in range(len(keys))]
    local = Window.partitionBy(*k, "bucket").orderBy(*(f"o{i}" for i in range(len(order)))).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*k).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = packed.groupBy(*k, "bucket").agg(F.sum("weight").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    met = packed.withColumn("here", F.sum("weight").over(local)).join(sums, [*k, "bucket"])
    return met.select("row.*", (F.col("here") + F.col("before")).alias(name))


def _ordered(o: Column | str, i: int) -> Column:
    return (F.col(o) if isinstance(o, str) else o).alias(f"o{i}")


def ranked(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], name: str = "rank") -> DataFrame:
    """rows with their place, from 1, among those of their key."""
    return running_sum(rows, keys, bucket, F.lit(1).cast("long"), order, name)


def decayed(rows: DataFrame, key: str, time: str, value: str, tau: float, order: str | None = None) -> DataFrame:
    """rows with `smoothed`: the average whose step towards each value is 1 - exp(-dt / tau), dt the seconds since the row before.

    The first row of a key is its own average. A row's average is a sum of what the rows before it brought in,
    each worth exp(-age / tau): the steps compose, as an associative scan, so a bucket of SPAN time constants
    is summed by itself and hands what it ends with on to the buckets that are not older than FORGOTTEN. Rows
    of one time are ordered by `order`; all but the first have dt = 0 and change nothing. Rows without key,
    time or value take no part and have no average. Times are seconds.
    """
    width = SPAN * tau
    reach = int(FORGOTTEN // SPAN) + 1
    t, x = F.col("t"), F.col("x")
    packed = rows.select(F.struct(*rows.columns).alias("row"), F.col(key).alias("k"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("x"), (F.col(order) if order else F.lit(0)).alias("o"))
    known = F.col("k").isNotNull() & t.isNotNull() & x.isNotNull()
    live = packed.where(known).withColumn("bucket", F.floor(t / width).cast("long"))
    w = Window.partitionBy("k", "bucket").orderBy("t", "o")

    def handed_on(sums: DataFrame, *columns: Column) -> DataFrame:
        """Each bucket's row once for each bucket after it that still feels it."""
        return sums.withColumn("to", F.explode(F.sequence(F.col("bucket") + 1, F.col("bucket") + reach))).groupBy("k", F.col("to").alias("bucket")).agg(*columns)

    # The time of the row before, in the bucket or the last of the buckets before.
    last = handed_on(live.groupBy("k", "bucket").agg(F.max("t").alias("t")), F.max("t").alias("t_before"))
    stepped = live.join(last, ["k", "bucket"], "left").withColumn("t_before", F.coalesce(F.lag("t").over(w), "t_before"))
    stays = F.coalesce(F.exp((F.col("t_before") - t) / tau), F.lit(0.0))
    stepped = stepped.withColumn("b", (1 - stays) * x)
    # Within a bucket all is measured from its beginning: exp(SPAN) is far from overflow.
    since = (t - F.col("bucket") * width) / tau
    ends = stepped.groupBy("k", "bucket").agg(F.sum(F.col("b") * F.exp(since - SPAN)).alias("end"))
    carried = handed_on(ends, F.sum(F.col("end") * F.exp(-SPAN * (F.col("to") - F.col("bucket") - 1))).alias("carry"))
    summed = stepped.withColumn("here", F.sum(F.col("b") * F.exp(since)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    done = summed.join(carried, ["k", "bucket"], "left").withColumn("smoothed", (F.col("here") + F.coalesce("carry", F.lit(0.0))) * F.exp(-since))
    return done.select("row.*", "smoothed").unionByName(packed.where(~known).select("row.*", F.lit(None).cast("double").alias("smoothed")))
