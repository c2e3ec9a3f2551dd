"""The registered audits: each a predicate, an order and a reason; all of them in one scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fonoteca import schema
from fonoteca.functions.text import parent
from fonoteca.operators import predicates as P

#: Years after this one are odd; a parameter of the catalogue, so that results do not depend on the day.
LAST_YEAR = 2027
BY_LABEL = ("label", "artist", "album")


@dataclass(frozen=True)
class Audit:
    where: Callable[[], Column]
    reason: Callable[[], Column]
    order: tuple[str, ...] = BY_LABEL


def _quoted(before: str, column: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(before), F.lit("'"), F.col(column), F.lit("'"))


def _missing(column: str) -> Audit:
    return Audit(lambda: P.missing_tag(column) & P.not_broken(), lambda: F.lit(f"missing {column}"))


AUDITS: dict[str, Audit] = {
    "missing_embedded_art": Audit(lambda: P.flag_is_zero("has_embedded_art") & P.not_broken(), lambda: F.lit("no embedded album art")),
    "missing_folder_art": Audit(lambda: P.flag_is_zero("has_folder_art") & P.not_broken(), lambda: F.lit("no cover.jpg / folder.png in album folder")),
    "missing_all_art": Audit(lambda: P.flag_not_set("has_embedded_art") & P.flag_not_set("has_folder_art") & P.not_broken(), lambda: F.lit("no embedded art AND no folder art")),
    "missing_artist": _missing("artist"),
    "missing_album": _missing("album"),
    "missing_title": _missing("title"),
    "missing_label": _missing("label"),
    "missing_year": _missing("year"),
    "unknown_artist_literal": Audit(lambda: P.placeholder("artist", schema.AUDIT_PLACEHOLDERS) & P.not_broken(), _quoted("placeholder artist: ", "artist")),
    "track_no_in_title": Audit(lambda: P.starts_like_filename("title") & P.not_broken(), _quoted("title looks like a filename: ", "title")),
    "odd_year": Audit(lambda: P.odd_year("year", LAST_YEAR) & P.not_broken(), _quoted("odd year: ", "year"), ("year",)),
    "suspected_transcode": Audit(lambda: F.col("transcode_suspected") == 1, lambda: F.concat(F.lit("suspected transcode: "), F.coalesce("transcode_notes", F.lit("")))),
    "lossless_no_bit_depth": Audit(
        lambda: (F.col("lossless") == 1) & F.col("bit_depth").isNull() & P.not_broken(), lambda: F.concat(F.lit("lossless codec ("), F.col("codec"), F.lit(") but no bit_depth")), ("codec", "path")
    ),
}
COLUMNS = ("path", "artist", "album", "codec")


def audit(files: DataFrame, key: str) -> DataFrame:
    """The rows of one audit with their reason, unordered."""
    one = AUDITS[key]
    return files.where(one.where()).select(*COLUMNS, one.reason().alias("reason"))


def ordered(files: DataFrame, key: str) -> DataFrame:
    """The same in the audit's order, for a report."""
    one = AUDITS[key]
    if key == "suspected_transcode":
        return files.where(one.where()).orderBy(F.desc("transcode_confidence"), "path").select(*COLUMNS, one.reason().alias("reason"))
    return files.where(one.where()).orderBy(*one.order, "path").select(*COLUMNS, one.reason().alias("reason"))


def audit_all(files: DataFrame) -> DataFrame:
    """A row for each audit that a file fails: one scan, no shuffle."""
    hits = F.array(*(F.when(a.where(), F.struct(F.lit(k).alias("audit_key"), a.reason().alias("reason"))) for k, a in AUDITS.items()))
    return files.select(*COLUMNS, F.explode(F.array_compact(hits)).alias("hit")).select("hit.audit_key", *COLUMNS, "hit.reason")


def summary(files: DataFrame) -> DataFrame:
    """(audit_key, n), of every audit, found nothing included."""
    counts = files.agg(*(F.count_if(a.where()).alias(k) for k, a in AUDITS.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("audit_key"), F.col(k).alias("n")) for k in AUDITS))).alias("x")).select("x.*")


def samples(files: DataFrame, n: int = 5) -> DataFrame:
    """Count and the first n paths of each audit that finds something.

    Ranks are taken within hashes of the paths first, so that no task sorts all rows of an audit.
    """
    rows = audit_all(files).withColumn("part", F.pmod(F.xxhash64("path"), F.lit(64)))
    part = Window.partitionBy("audit_key", "part").orderBy("path")
    least = rows.withColumn("rank", F.row_number().over(part)).withColumn("few", F.when(F.col("rank") <= n, F.col("path")))
    counts = least.groupBy("audit_key").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("few")), 1, n).alias("few"))
    return counts.select("audit_key", "n", F.array_join("few", "; ").alias("sample"))


def broken_counts(files: DataFrame) -> DataFrame:
    """Nine counts of defects in one scan; the placeholder and transcode counts take broken rows too."""
    nb = P.not_broken()
    counts = {f"missing_{c}": P.missing_tag(c) & nb for c in ("artist", "album", "title", "label", "year")}
    counts |= {
        "placeholder_artist": P.placeholder("artist", schema.SUMMARY_PLACEHOLDERS),
        "title_like_filename": P.starts_like_filename("title") & nb,
        "suspected": F.col("transcode_suspected") == 1,
        "any_bad": P.any_bad(),
    }
    return files.agg(*(F.count_if(c).alias(k) for k, c in counts.items()))


def bad_folders(files: DataFrame, placeholders: tuple[str, ...], limit: int = 50) -> DataFrame:
    """The first folders, in alphabetical order, that hold files to be tagged anew."""
    junk = P.is_missing("artist") | P.is_missing("album") | P.is_missing("title") | P.placeholder("artist", placeholders) | P.starts_like_filename("title")
    return files.where(P.not_broken() & junk).select(parent(P.preferred_path()).alias("folder")).where("folder <> ''").distinct().orderBy("folder").limit(limit)


def deepest_first(files: DataFrame) -> DataFrame:
    """folder, depth: every folder of files, in the order in which emptied ones can be removed."""
    folders = files.select(parent("path").alias("folder")).distinct()
    return folders.withColumn("depth", F.size(F.split("folder", "/"))).orderBy(F.desc("depth"), "folder")
