"""Plans of what would be moved, renamed or put aside: tables only, nothing is touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonoteca.functions.text import basename, blank_to_null, normalise_track, normalise_year, parent, safe_part, split_version, stem, strip, suffix
from fonoteca.operators.naming import numbered
from fonoteca.operators.predicates import confirmed_lossy, not_broken, unchecked_lossless


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" - ", *(F.nullif(p, F.lit("")) for p in parts))


def pretty_name(star: str = "✰", ripped_by: str = "") -> Column:
    """'✰ [ NN. Artist - Title - (version) - Album - Year - CODEC] Ripped By X.ext'; null without artist or title."""
    artist, title, version = strip("artist"), split_version("title"), split_version("title")["version"]
    codec = F.upper(strip("codec"))
    codec = F.when(codec == "", F.upper(F.regexp_replace(suffix("path"), r"^\.", ""))).otherwise(codec)
    rest = _joined(
        safe_part(artist, "Unknown Artist"),
        safe_part(title["clean"], "Untitled"),
        F.when(version != "", F.concat(F.lit("("), safe_part(version, ""), F.lit(")"))).otherwise(""),
        safe_part("album", ""),
        normalise_year("year"),
        codec,
    )
    track = normalise_track("track_number")
    bracket = F.concat(F.when(track != "", F.concat(F.lit("[ "), track, F.lit(". "))).otherwise("["), rest, F.lit("]"))
    whole = F.concat_ws(" ", *([F.lit(star)] if star else []), bracket, *([F.concat(F.lit("Ripped By "), safe_part(F.lit(ripped_by), ""))] if ripped_by else []))
    ext = F.when(suffix("path") == "", ".flac").otherwise(suffix("path"))
    return F.when((artist != "") & (strip("title") != ""), F.concat(safe_part(whole, "Untitled Track", illegal=""), ext))


def rename_plan(files: DataFrame, ripped_by: str = "") -> DataFrame:
    """path, target in the same folder; targets that collide, or that files have, are numbered."""
    named = files.withColumn("name", pretty_name(ripped_by=ripped_by)).where("name IS NOT NULL")
    return numbered(named.select("path", F.concat(parent("path"), F.lit("/"), F.col("name")).alias("target")), "target", "path", files.select("path"))


def destination(root: str, self_released: Column | None = None, single: Column | None = None) -> Column:
    """Where a file belongs: broken ones flat, mixes by name, others by artist; needs a column album_type."""
    ext = F.lower(suffix("path"))
    album, year, track = safe_part("album", "Unknown Album"), normalise_year("year"), normalise_track("track_number")
    title = safe_part("title", safe_part(stem("path"), "Unknown Title"))
    number = F.coalesce(blank_to_null("catalog_number"), F.lit(""))
    number = F.when(number != "", safe_part(number, "")).otherwise("")
    mix = F.col("album_type") == "mix"
    artist = safe_part("artist", "Unknown Artist")
    owner_name = safe_part(F.coalesce(blank_to_null("albumartist"), F.col("artist")), "Unknown Artist")
    kind = F.when(mix, "mix").when(single if single is not None else F.lit(False), "single").otherwise("album")
    owner = safe_part(_joined(number, year, F.when(mix, album).otherwise(owner_name)), "Unknown")
    name = safe_part(F.when(mix, _joined(track, artist, title)).otherwise(_joined(track, title)), "Unknown Track")
    base = F.when(self_released & ~mix, f"{root}/Self-Released/").otherwise(f"{root}/") if self_released is not None else F.lit(f"{root}/")
    return F.when(F.col("status") == "broken", F.concat(F.lit(f"{root}/Broken/"), basename("path"))).otherwise(F.concat(base, owner, F.lit("/"), kind, F.lit("/"), name, ext))


def move_plan(files: DataFrame, types: DataFrame, key: str, root: str) -> DataFrame:
    """path, target of the files that are not there yet, no two alike and none the path of a file; types has (key, album_type)."""
    plan = files.join(types, key, "left").withColumn("album_type", F.coalesce("album_type", F.lit("solo"))).select("path", destination(root).alias("target"))
    return numbered(plan, "target", "path", files.select("path")).where("path <> target")


def quarantine_plan(files: DataFrame, root: str = "/quarantine") -> DataFrame:
    """path, target of files confirmed to be of a lossy source."""
    return files.where(confirmed_lossy()).select("path", F.concat(F.lit(f"{root}/"), basename("path")).alias("target"))


def reencode_plan(files: DataFrame) -> DataFrame:
    """path, target, note of the same files turned into what they are."""
    note = F.concat(F.coalesce("transcode_notes", F.lit("")), F.lit("; re-encoded"))
    return files.where(confirmed_lossy()).select("path", F.concat(parent("path"), F.lit("/"), stem("path"), F.lit(".mp3")).alias("target"), note.alias("note"))


def check_plan(files: DataFrame) -> DataFrame:
    """Lossless files that no spectral check has seen."""
    return files.where(unchecked_lossless()).select("path", "codec")


def cover_plan(files: DataFrame) -> DataFrame:
    """Folders none of whose files has art beside it."""
    return files.where(not_broken()).groupBy(parent("path").alias("folder")).agg(F.max(F.coalesce("has_folder_art", F.lit(0))).alias("has")).where("has = 0").select("folder")


def tag_plan(files: DataFrame, found: DataFrame, key: str, fields: list[str], only_missing: bool = True) -> DataFrame:
    """A row for each tag that would be written: key, field, value."""
    met = files.join(found.select(key, *(F.col(f).alias(f"new_{f}") for f in fields)), key)
    hits = [F.when((F.coalesce(F.col(f"new_{f}"), F.lit("")) != "") & (blank_to_null(f).isNull() | F.lit(not only_missing)), F.struct(F.lit(f).alias("field"), F.col(f"new_{f}").cast("string").alias("value"))) for f in fields]
    return met.select(key, F.explode(F.array_compact(F.array(*hits))).alias("x")).select(key, "x.*")
