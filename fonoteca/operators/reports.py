"""Reports and exports: audits as CSV, JSON or text, playlists and album sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonoteca.functions.text import duration_text, size_text
from fonoteca.operators.audits import audit_all, summary
from fonoteca.operators.groups import track_order
from fonoteca.operators.predicates import any_bad, preferred_path

FORMATS = ("csv", "json", "txt")


def dump(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Writes rows; text has two lines a row, the reason as a comment and the path."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        rows.write.mode("overwrite").json(path)
    else:
        lines = rows.select(F.concat(F.lit("# "), F.coalesce("reason", F.lit("")), F.lit("\n"), F.col("path")).alias("value"))
        lines.write.mode("overwrite").text(path)


def dump_all(files: DataFrame, path: str) -> DataFrame:
    """Every audit's rows below a folder of its own; returns the counts."""
    audit_all(files).write.mode("overwrite").partitionBy("audit_key").option("header", True).csv(path)
    return summary(files)


def playlist(files: DataFrame) -> DataFrame:
    """path and its M3U lines, of all rows with a defect."""
    name = F.concat_ws(" - ", F.coalesce("artist", F.lit("")), F.coalesce("title", F.lit("")))
    entry = F.concat(F.lit("#EXTINF:"), F.floor(F.coalesce("duration_seconds", F.lit(0.0))).cast("long").cast("string"), F.lit(","), name, F.lit("\n"), preferred_path())
    return files.where(any_bad()).select("path", entry.alias("entry"))


def album_sheet(tracks: DataFrame, key: str) -> DataFrame:
    """key, sheet: a header of totals and the tracks in order. An album's tracks are bounded by its discs."""
    line = F.concat(F.format_string("%02d. ", "track"), F.coalesce("title", F.lit("")), F.lit(" ("), duration_text("duration_seconds"), F.lit(")"))
    rows = tracks.withColumn("line", line).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("track", "line"))).alias("lines"), F.sum("duration_seconds").alias("seconds"), F.sum(F.col("size_bytes").cast("long")).alias("size"), F.count("*").alias("n")
    )
    head = F.concat(F.col("n").cast("string"), F.lit(" tracks, "), duration_text("seconds"), F.lit(", "), size_text("size"))
    return rows.select(key, F.concat_ws("\n", head, F.array_join("lines.line", "\n")).alias("sheet"))


def signature(files: DataFrame, date: str) -> DataFrame:
    """path and a line of where its data come from."""
    parts = F.concat_ws(" | ", F.lit(f"catalogued {date}"), F.upper("codec"), F.nullif("catalog_number", F.lit("")), F.nullif("label", F.lit("")))
    return files.select("path", parts.alias("signature"))


def tracklist(files: DataFrame) -> DataFrame:
    return files.select("path", "title", track_order("track_number").alias("track"))
