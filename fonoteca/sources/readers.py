"""Readers: directory listings, content hashes, tag maps, cue sheets, structured data in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fonoteca.functions.text import basename, group, parent, strip, suffix
from fonoteca.operators.groups import AUDIO

#: Names under which containers keep a tag, first hit wins. Fixed values.
TAG_ALIASES: dict[str, tuple[str, ...]] = {
    "artist": ("artist", "TPE1", "©ART", "Author"),
    "albumartist": ("albumartist", "album artist", "TPE2", "aART", "WM/AlbumArtist"),
    "album": ("album", "TALB", "©alb", "WM/AlbumTitle"),
    "title": ("title", "TIT2", "©nam", "Title"),
    "track_number": ("tracknumber", "track", "TRCK", "trkn", "WM/TrackNumber"),
    "disc_number": ("discnumber", "disc", "TPOS", "disk", "WM/PartOfSet"),
    "year": ("year", "date", "TDRC", "TYER", "©day", "WM/Year"),
    "date": ("originaldate", "date", "TDOR", "TDRC"),
    "genre": ("genre", "TCON", "©gen", "WM/Genre"),
    "label": ("label", "publisher", "organization", "TPUB", "WM/Publisher", "©pub"),
    "catalog_number": ("catalognumber", "catalog#", "TXXX:CATALOGNUMBER", "WM/CatalogNo"),
    "isrc": ("isrc", "TSRC", "TXXX:ISRC"),
    "barcode": ("barcode", "TXXX:BARCODE"),
    "composer": ("composer", "TCOM", "©wrt", "WM/Composer"),
    "lyricist": ("lyricist", "TEXT"),
    "producer": ("producer", "TXXX:PRODUCER"),
    "comment": ("comment", "COMM::eng", "COMM", "©cmt", "WM/Comments"),
    "musicbrainz_trackid": ("musicbrainz_trackid", "TXXX:MusicBrainz Release Track Id"),
    "musicbrainz_albumid": ("musicbrainz_albumid", "TXXX:MusicBrainz Album Id"),
    "musicbrainz_artistid": ("musicbrainz_artistid", "TXXX:MusicBrainz Artist Id"),
    "musicbrainz_albumartistid": ("musicbrainz_albumartistid", "TXXX:MusicBrainz Album Artist Id"),
    "discogs_release_id": ("discogs_release_id", "TXXX:DISCOGS_RELEASE_ID"),
    "bpm": ("bpm", "TBPM", "tmpo", "TXXX:BPM", "WM/BeatsPerMinute"),
    "musical_key": ("initialkey", "initial_key", "TKEY", "TXXX:INITIALKEY", "TXXX:initialkey", "TXXX:KEY"),
    "mood": ("mood", "TMOO", "TXXX:MOOD"),
    "compilation": ("compilation", "TCMP", "cpil", "TXXX:COMPILATION"),
    "replaygain_track_gain": ("replaygain_track_gain", "TXXX:REPLAYGAIN_TRACK_GAIN", "----:com.apple.iTunes:replaygain_track_gain"),
    "replaygain_track_peak": ("replaygain_track_peak", "TXXX:REPLAYGAIN_TRACK_PEAK"),
    "replaygain_album_gain": ("replaygain_album_gain", "TXXX:REPLAYGAIN_ALBUM_GAIN"),
    "replaygain_album_peak": ("replaygain_album_peak", "TXXX:REPLAYGAIN_ALBUM_PEAK"),
    "encodedby": ("encodedby", "TENC", "©too"),
    "encodersettings": ("encodersettings", "encoder_settings", "TSSE", "encoder"),
    "website": ("website", "WOAR", "URL"),
    "copyright": ("copyright", "TCOP", "cprt"),
    "license": ("license", "TXXX:LICENSE"),
    "albumartistsort": ("albumartistsort", "TSO2", "soaa"),
    "artistsort": ("artistsort", "TSOP", "soar"),
    "albumsort": ("albumsort", "TSOA", "soal"),
    "titlesort": ("titlesort", "TSOT", "sonm"),
    "composersort": ("composersort", "TSOC", "soco"),
    "artists": ("artists", "TXXX:ARTISTS"),
    "totaltracks": ("totaltracks", "TXXX:TOTALTRACKS"),
    "totaldiscs": ("totaldiscs", "TXXX:TOTALDISCS"),
    "discsubtitle": ("discsubtitle", "TSST"),
    "originaldate": ("originaldate", "TDOR", "TXXX:originaldate"),
    "originalyear": ("originalyear", "TXXX:originalyear"),
    "originalalbum": ("originalalbum", "TOAL"),
    "originalartist": ("originalartist", "TOPE"),
    "originalfilename": ("originalfilename", "TOFN"),
    "asin": ("asin", "TXXX:ASIN"),
    "musicbrainz_recordingid": ("musicbrainz_recordingid", "TXXX:MusicBrainz Track Id", "UFID:http://musicbrainz.org"),
    "musicbrainz_workid": ("musicbrainz_workid", "TXXX:MusicBrainz Work Id"),
    "musicbrainz_releasegroupid": ("musicbrainz_releasegroupid", "TXXX:MusicBrainz Release Group Id"),
    "arranger": ("arranger", "TXXX:ARRANGER", "TIPL"),
    "conductor": ("conductor", "TPE3"),
    "director": ("director", "TXXX:DIRECTOR"),
    "djmixer": ("djmixer", "TXXX:DJMIXER"),
    "engineer": ("engineer", "TXXX:ENGINEER", "TIPL:engineer"),
    "mixer": ("mixer", "TXXX:MIXER", "TIPL:mix"),
    "remixer": ("remixer", "TPE4"),
    "writer": ("writer", "TXXX:Writer"),
    "work": ("work", "TXXX:WORK", "©wrk"),
    "showmovement": ("showmovement", "shwm"),
    "movement": ("movement", "MVNM", "©mvn"),
    "movementnumber": ("movementnumber", "MVIN", "©mvi"),
    "movementtotal": ("movementtotal", "TXXX:MOVEMENTTOTAL"),
    "subtitle": ("subtitle", "TIT3"),
    "lyrics": ("lyrics", "USLT", "©lyr"),
    "syncedlyrics": ("syncedlyrics", "SYLT"),
    "release_type": ("releasetype", "TXXX:MusicBrainz Album Type"),
    "release_status": ("releasestatus", "TXXX:MusicBrainz Album Status"),
    "country": ("releasecountry", "TXXX:RELEASECOUNTRY"),
    "language": ("language", "TLAN"),
    "script": ("script", "TXXX:SCRIPT"),
    "media_format": ("media", "TMED"),
    "acoustid_id": ("acoustid_id", "TXXX:Acoustid Id"),
    "acoustid_fingerprint": ("acoustid_fingerprint", "TXXX:Acoustid Fingerprint"),
}
HEAD = 65536


def listing(spark: SparkSession, root: str, least_bytes: int = 0, hidden: bool = False) -> DataFrame:
    """path, folder, name, ext, size_bytes, mtime, is_audio of the files under root; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    path = F.regexp_replace("path", "^file:(//)?", "")
    rows = f.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("double").alias("mtime"))
    rows = rows.withColumns({"folder": parent("path"), "name": basename("path"), "ext": F.lower(suffix("path"))}).withColumn("is_audio", F.col("ext").isin(AUDIO))
    shown = rows.where(F.col("size_bytes") >= least_bytes)
    return shown if hidden else shown.where(~F.col("path").rlike(r"/\."))


def audio_folders(files: DataFrame) -> DataFrame:
    """folder, n_files and size of the folders that hold audio."""
    return files.where("is_audio").groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"))


def extras(files: DataFrame, junk: tuple[str, ...] = ("thumbs.db", "desktop.ini", ".ds_store"), only: tuple[str, ...] | None = None) -> DataFrame:
    """What goes with the audio of a folder: all but junk, or the given endings."""
    rows = files.where(~F.col("is_audio") & ~F.lower("name").isin(*junk))
    return rows.where(F.col("ext").isin(*only)) if only else rows


def content_hash(content: Column, length: Column, whole: bool = False) -> Column:
    """Of the length, the first and, of more than two of them, the last 64 KiB; or of the length and all of the content."""
    if whole:
        return F.sha1(F.concat(length.cast("string").cast("binary"), content))
    tail = F.when(length > 2 * HEAD, F.substring(content, -HEAD, HEAD)).otherwise(F.lit(b""))
    return F.sha1(F.concat(length.cast("string").cast("binary"), F.substring(content, 1, HEAD), tail))


def hashed(spark: SparkSession, root: str) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), content_hash(F.col("content"), F.col("length")).alias("content_hash"))


def resolved_tags(raw: DataFrame, tags: str = "tags") -> DataFrame:
    """Columns of the catalogue from a map of raw tags; names are matched whatever their case."""
    low = F.transform_keys(F.col(tags), lambda k, _: F.lower(k))
    found = {c: F.coalesce(*(F.nullif(F.trim(F.element_at(low, F.lower(F.lit(a)))), F.lit("")) for a in names)) for c, names in TAG_ALIASES.items()}
    return raw.select(*(c for c in raw.columns if c != tags), *(v.alias(c) for c, v in found.items()))


def cue_sheets(texts: DataFrame, text: str = "value") -> DataFrame:
    """audio_filename, title and performer of each sheet's head."""
    head = F.substring(F.col(text), 1, 8192)
    quoted = lambda word, more="": strip(group(head, rf'(?im)^\s*{word}\s+"([^"]+)"{more}', 1))
    return texts.select("*", quoted("FILE", r"\s+(?:WAVE|MP3|AIFF|FLAC|APE)").alias("audio_filename"), quoted("TITLE").alias("title"), quoted("PERFORMER").alias("performer"))


def read_cue_sheets(spark: SparkSession, root: str) -> DataFrame:
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.cue").select("value", "_metadata.file_path")
    return cue_sheets(texts.select(F.regexp_replace("file_path", "^file:(//)?", "").alias("path"), "value")).drop("value")


def orphan_cues(cues: DataFrame, files: DataFrame) -> DataFrame:
    """Sheets whose audio is not beside them."""
    there = files.select(F.col("folder").alias("f"), F.col("name").alias("n"))
    return cues.join(there, (parent("path") == F.col("f")) & (F.col("audio_filename") == F.col("n")), "left_anti")


def json_ld(pages: DataFrame, html: str = "html") -> DataFrame:
    """The first structured-data block of each page, its name and its date."""
    block = group(html, r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    return pages.withColumn("ld", F.nullif(block, F.lit(""))).withColumns({"name": F.get_json_object("ld", "$.name"), "published": F.get_json_object("ld", "$.datePublished")})


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """title and language of each page."""
    return pages.select("page_id", group(html, r"(?is)<title>(.*?)</title>", 1).alias("title"), group(html, r'(?is)<html[^>]*lang="([^"]*)"', 1).alias("lang"))
