"""Keyed changes of a catalogue table: upsert, delete, new keys, commit, changes on disk.

Spark keeps no primary key, so each of these is a join by key that yields the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SET_ONCE = ("original_path", "original_filename")


def upsert(current: DataFrame, changes: DataFrame, key: str, now: str | None = None, set_once: tuple[str, ...] = SET_ONCE) -> DataFrame:
    """current with the columns of changes put in, also where they are null; set-once columns keep what they have.

    Columns that changes lacks stay; `now` is the new last_seen of the rows put in.
    """
    old, new = current.withColumn("__old", F.lit(True)).alias("o"), changes.withColumn("__new", F.lit(True)).alias("n")
    met = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    given = F.col("n.__new").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"n.{c}", f"o.{c}")
        if c == "last_seen" and now is not None:
            return F.when(given, F.lit(now)).otherwise(F.col(f"o.{c}") if c in current.columns else F.lit(None))
        if c not in changes.columns:
            return F.col(f"o.{c}")
        was = F.col(f"o.{c}") if c in current.columns else F.lit(None)
        return F.coalesce(was, F.col(f"n.{c}")) if c in set_once else F.when(given, F.col(f"n.{c}")).otherwise(was)

    columns = [*current.columns, *(c for c in changes.columns if c not in current.columns)]
    if now is not None and "last_seen" not in columns:
        columns.append("last_seen")
    return met.select(*(value(c).alias(c) for c in columns))


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_anti")


def commit(library: DataFrame, session: DataFrame, key: str) -> DataFrame:
    """Whole rows of session replace those of library, matched by name."""
    return library.join(session.select(key), key, "left_anti").unionByName(session, allowMissingColumns=True)


def commit_counts(library: DataFrame, session: DataFrame, key: str) -> DataFrame:
    before, after = library.agg(F.count("*").alias("before")), commit(library, session, key).agg(F.count("*").alias("after"))
    return before.join(after, F.lit(True)).withColumn("delta", F.col("after") - F.col("before"))


def rekey(current: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Rows under new keys; moves has (old_key, new_key). A moved row replaces the row that had its new key."""
    named = moves.select(F.col("old_key").alias(key), "new_key")
    moved = current.join(named, key).withColumn(key, F.col("new_key")).drop("new_key").select(*current.columns)
    gone = named.select(key).union(named.select(F.col("new_key").alias(key))).distinct()
    return current.join(gone, key, "left_anti").unionByName(moved)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the last by order; an aggregate, so that a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def changes(catalogue: DataFrame, listing: DataFrame, key: str = "path", drift: float = 1.0) -> DataFrame:
    """key, change: new, refreshed or unchanged (equal size, times less than `drift` apart) of each listed file."""
    old = catalogue.select(key, F.col("size_bytes").alias("old_size"), *(F.col(c).alias(f"old_{c}") for c in ("mtime",) if c in catalogue.columns))
    met = listing.join(old, key, "left")
    same = F.col("old_size") == F.col("size_bytes")
    if "mtime" in catalogue.columns and "mtime" in listing.columns:
        same = same & (F.abs(F.col("mtime") - F.col("old_mtime")) < drift)
    kind = F.when(F.col("old_size").isNull(), "new").when(same, "unchanged").otherwise("refreshed")
    return met.select(key, kind.alias("change"))


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def due(files: DataFrame) -> DataFrame:
    """Files that were seen after they were organised, by the text of both times."""
    done = (F.coalesce("organised_at", F.lit("")) != "") & (F.coalesce("last_seen", F.lit("")) != "") & (F.col("organised_at") >= F.col("last_seen"))
    return files.where(~done)


def compacted(df: DataFrame, path: str, n_files: int) -> None:
    """Rewrites a table in n_files files."""
    df.repartition(n_files).write.mode("overwrite").parquet(path)


def analysed(spark: SparkSession, table: str, *columns: str) -> None:
    """Statistics of a catalogue's table, its row count and its columns' histograms, and plans that use them."""
    spark.conf.set("spark.sql.statistics.histogram.enabled", "true")
    for name in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled", "spark.sql.cbo.planStats.enabled"):
        spark.conf.set(name, "true")
    what = "FOR COLUMNS " + ", ".join(f"`{c}`" for c in columns) if columns else "FOR ALL COLUMNS"
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS {what}")
