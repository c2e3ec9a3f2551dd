"""Decisions about groups of files: majorities, roll-ups, kinds of albums and folders.

Groups are reduced by aggregations in two steps (values first, then groups), so a group of any size is
combined before it is shuffled and none is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonoteca import schema
from fonoteca.functions.detection import compilation_match, looks_like_dj_set, normalise_query, title_case, unofficial_marker
from fonoteca.functions.text import Text, basename, blank_to_null, broken_reason, col, group, is_unknown_tag, lenient_int, parent, split_primary, strip, suffix


def majority(files: DataFrame, keys: list[str], column: str, barred: tuple[str, ...] = ()) -> DataFrame:
    """keys, value, votes, values: the commonest value that is no placeholder, of equals the first in order."""
    value = strip(column)
    fit = files.where(~is_unknown_tag(column) & (~F.lower(value).isin(*barred) if barred else F.lit(True)))
    counts = fit.groupBy(*keys, value.alias("value")).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"), F.max("n").alias("votes"), F.count("*").alias("n_values"))


def album_label(files: DataFrame, keys: list[str], fallback: str = "Unknown Label") -> DataFrame:
    """One label a group, self-release names aside; `fallback` where no row has one."""
    won = majority(files, keys, "label", schema.SELF_RELEASE_LABELS)
    return files.select(*keys).distinct().join(won, keys, "left").select(*keys, F.coalesce("value", F.lit(fallback)).alias("label"), F.coalesce("n_values", F.lit(0)).alias("n_values"))


def reconcile(files: DataFrame, column: str, only_missing: bool = True, resolve_conflicts: bool = True) -> DataFrame:
    """path, old and new value of the rows that the majority of their folder and album would change.

    Groups of one file and blank or placeholder albums are left alone; without resolve_conflicts so are
    groups with more than one value.
    """
    keyed = files.where(~is_unknown_tag("album")).withColumn("folder", parent("path"))
    keys = ["folder", "album"]
    won = majority(keyed, keys, column)
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    won = won.join(sizes, keys).where(F.lit(True) if resolve_conflicts else F.col("n_values") == 1)
    met = keyed.join(won.select(*keys, "value"), keys)
    blank = is_unknown_tag(column)
    changed = blank if only_missing else blank | (strip(column) != F.col("value"))
    return met.where(changed).select("path", F.col(column).alias("old"), F.col("value").alias("new"))


def album_type(records: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """key, album_type (solo or mix): a various-artists tag, a mix word in the name, or diverse artists."""
    cols = set(records.columns)
    various = F.lower(F.trim("albumartist")).isin(*schema.VARIOUS_ARTISTS) if "albumartist" in cols else F.lit(False)
    mixed = F.lower("album").rlike("|".join(schema.MIX_KEYWORDS)) if "album" in cols else F.lit(False)
    artist = F.lower(blank_to_null("artist"))
    counts = records.groupBy(key, artist.alias("a")).agg(F.count("*").alias("n"), F.max(F.coalesce(various, F.lit(False))).alias("various"), F.max(F.coalesce(mixed, F.lit(False))).alias("mixed"))
    named = F.col("a").isNotNull()
    facts = counts.groupBy(key).agg(F.max("various").alias("various"), F.max("mixed").alias("mixed"), F.max(F.when(named, F.col("n"))).alias("most"), F.sum(F.when(named, F.col("n"))).alias("all"))
    diverse = F.coalesce(1 - F.col("most") / F.col("all") >= threshold, F.lit(False))
    return facts.select(key, F.when(F.col("various") | F.col("mixed") | diverse, "mix").otherwise("solo").alias("album_type"))


def rollup(tracks: DataFrame, key: str, *order: str) -> DataFrame:
    """Facts of an album: first values in order, sets of artists, total duration and size, tracks."""
    first = lambda c: F.min_by(blank_to_null(c), F.when(blank_to_null(c).isNotNull(), F.struct(*order))).alias(c)
    return tracks.groupBy(key).agg(
        first("title"),
        first("label"),
        F.min("year").alias("first_year"),
        F.array_join(F.array_sort(F.collect_set("artist")), "; ").alias("artists"),
        F.sum(F.coalesce("duration_seconds", F.lit(0.0))).alias("seconds"),
        F.bround(F.sum(F.coalesce("size_bytes", F.lit(0.0))), 2).alias("size"),
        F.count("*").alias("n_tracks"),
    )


# What goes with music in a folder, and what does not.
COMPANIONS = ".jpg .jpeg .png .webp .bmp .tiff .tif .gif .log .txt .md .nfo .cue .accurip .sfv .m3u .m3u8 .pls .cuesheet .xml .json .yaml .yml".split()
NOT_MUSIC = (
    ".pdf .epub .mobi .azw .azw3 .djvu .doc .docx .odt .rtf .pages .zip .rar .7z .tar .gz .bz2 .xz .tar.gz .tgz .tbz .iso .bin .mp4 .mkv .avi .mov .webm .flv .wmv .exe .msi .dmg .pkg .deb .rpm "
    ".apk .ipa .appimage .py .js .html .css .c .cpp .h .java .rs .go .xls .xlsx .csv .ods .ppt .pptx .odp .torrent .part .crdownload .aria2"
).split()
AUDIO = ".flac .mp3 .m4a .ogg .opus .wav .aiff .ape .wv .alac .aac .wma .mpc .tta .dsf .dff".split()


def folder_profile(listing: DataFrame) -> DataFrame:
    """Counts of the kinds of files in each folder."""
    ext = F.lower(suffix("name"))
    kind = F.when(ext.isin(AUDIO), "audio").when(ext.isin(NOT_MUSIC), "non_music").when(ext.isin(COMPANIONS), "companion").otherwise("other")
    counts = [F.count_if(kind == k).alias(f"n_{k}") for k in ("audio", "companion", "non_music", "other")]
    return listing.groupBy("folder").agg(*counts, F.sum("size_bytes").alias("size_bytes"))


def folder_kind(profile: DataFrame, junk_from: int = 3, few_audio: int = 2) -> DataFrame:
    audio, junk = F.col("n_audio"), F.col("n_non_music") + F.col("n_other")
    kind = (
        F.when(audio > few_audio, "music")
        .when((audio == 0) & (junk >= junk_from), "random_crap")
        .when(audio == 0, "empty_or_trivial")
        .when(F.col("n_non_music") >= 2, "orphan_bonus")
        .otherwise("music")
    )
    return profile.withColumn("kind", kind)


def normalised(c: Text) -> Column:
    """Lower case, without accents and with single spaces; the fold of accents is a UDF of its own."""
    from fonoteca.functions.udfs import fold

    return F.regexp_replace(strip(F.lower(fold(F.coalesce(col(c), F.lit(""))))), r"(?U)\s+", " ")


def self_release(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, self_released, why: a marker, a label that says so, or a label named as the artist."""
    marked = F.lit(False)
    for c in ("release_status", "release_type"):
        if c in files.columns:
            marked = marked | F.coalesce(F.lower(strip(c)).isin(*schema.SELF_RELEASE_MARKERS), F.lit(False))
    by_mark = files.groupBy(*keys).agg(F.max(marked).alias("marked"))

    def commonest(value: Column, name: str) -> DataFrame:
        counts = files.where(value.isNotNull()).groupBy(*keys, value.alias("v")).agg(F.count("*").alias("n"))
        return counts.groupBy(*keys).agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(name))

    label = commonest(F.nullif(strip("label"), F.lit("")), "label")
    artist = commonest(F.coalesce(blank_to_null("albumartist"), blank_to_null("artist")), "artist")
    met = by_mark.join(label, keys, "left").join(artist, keys, "left").withColumns({"l": normalised("label"), "a": normalised("artist")})
    says = (F.col("l") != "") & F.col("l").isin(*schema.SELF_RELEASE_LABELS)
    same = (F.col("l") != "") & (F.col("l") == F.col("a"))
    why = F.when(F.col("marked"), "marker").when(says, "label is a self-release marker").when(same, "label matches artist").otherwise("")
    return met.select(*keys, (why != "").alias("self_released"), why.alias("why"))


def _modal(files: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    counts = files.where(F.coalesce(value, F.lit("")) != "").groupBy(*keys, value.alias("v")).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(
        F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(name), F.max("n").alias(f"{name}_most"), F.sum("n").alias(f"{name}_all"), F.count("*").alias(f"{name}_kinds")
    )


def classify_albums(files: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """keys, kind, confidence, reason, album_artist: ordered rules, then five signals of diversity.

    Ties between equally common artists go to the first in order.
    """
    dj = looks_like_dj_set("duration_seconds", "title", "album", "comment")
    year = group(strip("year"), r"^(\d{4})", 1).try_cast("int")
    named = group(strip("title"), r"(?U)^(.+?)\s+[-–—]\s+(.+)$", 1)
    candidate = F.lower(strip(named))
    parsed = F.when((F.length(candidate).between(2, 60)) & ~candidate.rlike("^[0-9]+$"), candidate)
    facts = files.groupBy(*keys).agg(
        F.min("album").alias("album_name"),
        F.count("*").alias("n"),
        F.count_if(dj).alias("dj"),
        (F.max(year) - F.min(year)).alias("spread"),
        F.count(year).alias("years"),
        F.count(parsed).alias("parsed"),
        F.countDistinct(parsed).alias("parsed_kinds"),
    )
    albumartist = _modal(files, keys, F.lower(F.trim("albumartist")), "aa")
    primary = _modal(files, keys, F.lower(split_primary("artist")), "pa")
    f = facts.join(albumartist, keys, "left").join(primary, keys, "left")
    c = F.col
    share = F.when(c("pa_all") >= 2, 1 - c("pa_most") / c("pa_all"))
    many = c("pa_kinds") >= 5
    some = (c("pa_kinds") >= 3) & ~many & (share >= 0.5)
    low = share >= threshold
    wide = (c("years") >= 3) & (c("spread") >= 8)
    curator = c("aa").isNotNull() & ~c("aa").isin(*schema.VARIOUS_ARTISTS) & (c("aa") != c("pa")) & (c("pa_kinds") >= 2)
    titles = (c("n") >= 3) & (c("parsed") >= 0.6 * c("n")) & (c("parsed_kinds") >= 3)
    no = F.lit(False)
    signals = {
        "many_distinct_primaries": F.coalesce(many & share.isNotNull(), no),
        "moderate_distinct_primaries": F.coalesce(some, no),
        "low_modal_share": F.coalesce(low, no),
        "wide_year_spread": F.coalesce(wide, no),
        "curator_album_artist": F.coalesce(curator, no),
        "title_field_holds_artist": F.coalesce(titles, no),
    }
    f = f.withColumns(signals)
    count = sum((c(s).cast("int") for s in signals), F.lit(0))
    strong = c("many_distinct_primaries") | c("wide_year_spread") | c("curator_album_artist") | c("title_field_holds_artist")
    unofficial, compilation = unofficial_marker("album_name"), compilation_match("album_name")
    various = c("aa").isin(*schema.VARIOUS_ARTISTS)
    kept = F.when(c("aa").isNotNull() & ~various, title_case(c("aa"))).otherwise("Various Artists")
    verdict = lambda kind, sure, reason, artist: F.struct(F.lit(kind).alias("kind"), sure.alias("confidence"), reason.alias("reason"), artist.alias("album_artist"))
    nobody, va = F.lit(""), F.lit("Various Artists")
    sure = F.least(F.lit(0.95), F.bround(F.lit(0.65) + 0.1 * count, 2))
    rule = (
        F.when(unofficial != "", verdict("unofficial", F.lit(0.9), F.concat(F.lit("marker "), unofficial), nobody))
        .when((c("n") == 1) & (c("dj") == 1), verdict("dj_set", F.lit(0.8), F.lit("single long file or DJ marker"), nobody))
        .when((c("n") >= 2) & (c("dj") >= c("n") / 2), verdict("dj_set", F.lit(0.6), F.lit("half of the files look like DJ sets"), nobody))
        .when(various, verdict("mix", F.lit(0.95), F.lit("album artist is various artists"), va))
        .when(compilation != "", verdict("mix", F.lit(0.85), F.concat(F.lit("name matches "), compilation), kept))
        .when(strong | (count >= 2), verdict("mix", sure, F.concat_ws(", ", *(F.when(c(s), F.lit(s)) for s in signals)), F.when(c("curator_album_artist"), title_case(c("aa"))).otherwise(va)))
        .otherwise(verdict("solo", F.lit(0.5), F.lit("no signal of a compilation"), nobody))
    )
    return f.select(*keys, rule.alias("r"), normalise_query("album_name").alias("query")).select(*keys, "r.*", "query")


def mark_broken(files: DataFrame) -> DataFrame:
    """path, old and new status of the rows whose status their tags would change; no shuffle."""
    status, comment = F.lower(F.trim(F.coalesce("status", F.lit("")))), F.lower(F.coalesce("comment", F.lit("")))
    bad = broken_reason() != ""
    other = comment.rlike("|".join(schema.OTHER_REASONS))
    new = F.when(status.isin(*schema.PRESERVED_STATUSES), None).when(bad & (status != "broken"), "broken").when(~bad & (status == "broken") & ~other, "ok")
    return files.withColumn("new_status", new).where("new_status IS NOT NULL").select("path", "status", "new_status")


def siblings(files: DataFrame) -> DataFrame:
    """path, album: for rows without an album, the one that most rows of their folder and artist have."""
    keyed = files.withColumn("folder", parent("path"))
    won = majority(keyed.where(~is_unknown_tag("artist")), ["folder", "artist"], "album")
    return keyed.where(is_unknown_tag("album")).join(won, ["folder", "artist"]).select("path", F.col("value").alias("album"))


def complete_albums(files: DataFrame, fields: tuple[str, ...] = ("year", "label", "genre")) -> DataFrame:
    """Albums all of whose rows have all the fields: those that a fetch may skip."""
    full = F.lit(True)
    for f in fields:
        full = full & ~F.coalesce(is_unknown_tag(f), F.lit(True))
    return files.where(blank_to_null("album").isNotNull()).groupBy("artist", "album").agg(F.bool_and(full).alias("full")).where("full").select("artist", "album")


def duplicates(files: DataFrame, order: str = "path") -> DataFrame:
    """path, duplicate_of: all but the first row of each content hash; a null hash is no duplicate.

    The first is an aggregate that is combined before the shuffle; a window would gather a hash in a task.
    """
    known = files.where("content_hash IS NOT NULL")
    first = known.groupBy("content_hash").agg(F.min(F.struct(F.col(order).alias("o"), "path")).alias("f"), F.count("*").alias("n")).where("n > 1").select("content_hash", F.col("f.path").alias("duplicate_of"))
    return known.join(first, "content_hash").where("path <> duplicate_of").select("path", "duplicate_of")


def track_order(c: Text) -> Column:
    """The number before a slash; what is no number comes last."""
    return F.coalesce(F.trim(F.element_at(F.split(F.coalesce(col(c), F.lit("")), "/"), 1)).try_cast("int"), F.lit(9999))


def folder_art(listing: DataFrame, names: tuple[str, ...] = ("cover.jpg", "folder.jpg", "front.jpg", "cover.png", "folder.png")) -> DataFrame:
    """folder, art: the best-named picture of each folder; an exact name beats a prefix, an earlier name a later."""
    name = F.lower(basename("name"))
    score = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        score = F.when(name == n, 100 - i).when(F.startswith(name, F.lit(n.rsplit(".", 1)[0])) & name.rlike(r"\.(jpe?g|png)$"), F.coalesce(score, F.lit(50 - i))).otherwise(score)
    return listing.withColumn("score", score).where("score IS NOT NULL").groupBy("folder").agg(F.max_by("name", F.struct("score", "name")).alias("art"))


def year_of(c: Text) -> Column:
    return lenient_int(F.substring(col(c), 1, 4))
