"""Look-ups of many keys in a table laid out for them: sorted by key, with bloom filters and small pages."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fonoteca.tables import written

#: So many keys are pushed down to the scan as a list; more are joined.
PUSHED = 10_000
#: So many values make one list. The scan nests a list as deep as it is long, so a long one would overflow its stack.
PIECE = 128


def lay_out(df: DataFrame, path: str, key: str, n_files: int = 8, rows_a_page: int = 1000, group_bytes: int = 8 << 20) -> None:
    """Writes df in files that are ranges of key and sorted by it, so that ranges, pages and bloom filters tell what to skip.

    A key that many rows have may fill several files, as ranges end within it only at its end; the salt of the
    range keys lets it be split.
    """
    salted = df.repartitionByRange(n_files, F.col(key), F.xxhash64(*df.columns)).sortWithinPartitions(key)
    options = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.page.row.count.limit": str(rows_a_page), "parquet.page.size.row.check.min": str(min(100, rows_a_page)), "parquet.block.size": str(group_bytes)}
    salted.write.options(**options).mode("overwrite").parquet(path)


def among(column: str, values: list) -> Column:
    """Whether a column has one of the values: short lists of neighbours, joined in a tree that is as deep as their number has digits."""
    values = sorted(values)
    lists = [F.col(column).isin(values[i : i + PIECE]) for i in range(0, max(len(values), 1), PIECE)]
    while len(lists) > 1:
        lists = [a | b for a, b in zip(lists[::2], lists[1::2])] + lists[len(lists) & ~1 :]
    return lists[0]


@contextmanager
def _pushed_lists(spark: SparkSession, most: int):
    """Lists of up to `most` values reach the scan as lists, not as the range around them."""
    name = "spark.sql.parquet.pushdown.inFilterThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def wanted(table: DataFrame, key: str, keys: DataFrame, most: int = PUSHED) -> DataFrame:
    """The rows of a table whose key is among keys; null is no key. Few keys become a list, more a semi join."""
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in distinct.limit(most + 1).collect()]
    return table.where(among(key, few)) if len(few) <= most else table.join(distinct, key, "left_semi")


def look_up(spark: SparkSession, path: str, key: str, keys: DataFrame, columns: list[str] | None = None, most: int = PUSHED) -> DataFrame:
    """The rows of a laid-out table with one of the keys, read now, so that what is skipped is skipped by this list."""
    table = spark.read.parquet(path)
    with _pushed_lists(spark, PIECE):
        return written(wanted(table, key, keys, most).select(*(columns or table.columns)))
