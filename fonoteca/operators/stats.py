"""Counts and histograms of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonoteca.functions.text import blank_to_null, parent
from fonoteca.operators.predicates import preferred_path


def total(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n"))


def by(files: DataFrame, column: str) -> DataFrame:
    """A count a value, null a value of its own."""
    return files.groupBy(column).agg(F.count("*").alias("n"))


def status_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def size(files: DataFrame) -> DataFrame:
    total_bytes = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return files.agg(total_bytes.alias("total_bytes"), F.bround(total_bytes / 1e9, 6).alias("gb"))


def distinct_counts(files: DataFrame, *columns: str) -> DataFrame:
    """Exact numbers of distinct values; nulls are none."""
    return files.agg(*(F.countDistinct(c).alias(f"n_{c}") for c in columns))


def effective_artists(files: DataFrame) -> DataFrame:
    name = F.coalesce(blank_to_null("albumartist"), blank_to_null("artist"), F.lit("Unknown"))
    return files.agg(F.countDistinct(name).alias("n_artists"))


def labels(files: DataFrame) -> DataFrame:
    return files.agg(F.countDistinct(blank_to_null("label")).alias("n_labels"))


def distinct_folders(files: DataFrame) -> DataFrame:
    return files.agg(F.countDistinct(parent(preferred_path())).alias("n_folders"))


def album_pairs(files: DataFrame) -> DataFrame:
    pairs = files.where(blank_to_null("artist").isNotNull() & blank_to_null("album").isNotNull())
    return pairs.select("artist", "album").distinct().agg(F.count("*").alias("n_pairs"))


def preferred_paths(files: DataFrame) -> DataFrame:
    return files.select(preferred_path().alias("path")).distinct()
