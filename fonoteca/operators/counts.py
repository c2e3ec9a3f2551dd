"""Counts that are kept: only roots whose time moved, or whose entry is old, are counted again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonoteca.functions.text import suffix
from fonoteca.operators.groups import AUDIO
from fonoteca.sources.lookups import wanted
from fonoteca.tables import written

#: What a time may differ by, and seconds that an entry is good for. Fixed values.
DRIFT, GOOD_FOR = 0.1, 7 * 24 * 3600


def counted(listing: DataFrame) -> DataFrame:
    """root, file_count, folder_count: audio files and folders of each root; listing has root, folder, name."""
    audio = F.lower(suffix("name")).isin(AUDIO)
    folders = listing.groupBy("root", "folder").agg(F.count_if(audio).alias("n"))
    return folders.groupBy("root").agg(F.sum("n").alias("file_count"), F.count("*").alias("folder_count"))


def stale(cache: DataFrame, roots: DataFrame, now: float) -> DataFrame:
    """root, mtime of the roots to be counted: without entry, with another time, or with an old entry."""
    entry = cache.select("root", F.col("mtime").alias("was"), "cached_at")
    met = roots.select("root", "mtime").join(entry, "root", "left")
    good = (F.abs(F.col("was") - F.col("mtime")) <= DRIFT) & (F.lit(now) - F.col("cached_at") <= GOOD_FOR)
    return met.where(~F.coalesce(good, F.lit(False))).select("root", "mtime")


def refreshed(cache: DataFrame, roots: DataFrame, listing: DataFrame, now: float) -> DataFrame:
    """root, mtime, cached_at, file_count, folder_count: the new cache, of the roots that there are.

    listing is best partitioned by root: then the scan reads the folders of stale roots alone, as long as these
    are few enough to be named to it.
    """
    again = written(stale(cache, roots, now))
    counts = counted(wanted(listing, "root", again))
    new = again.join(counts, "root", "left").select("root", "mtime", F.lit(float(now)).alias("cached_at"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("file_count", "folder_count")))
    kept = cache.join(roots.select("root"), "root", "left_semi").join(again.select("root"), "root", "left_anti")
    return kept.select(*new.columns).unionByName(new)
