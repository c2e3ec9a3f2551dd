"""The catalogue's vocabulary: statuses, placeholder lists and the types of the columns that are not text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values. Each operator keeps its own placeholder list; they differ on purpose.
AUDIT_PLACEHOLDERS = ("unknown artist", "unknown", "various", "various artists", "[unknown artist]", "unknownartist", "n/a", "na", "untagged")
SUMMARY_PLACEHOLDERS = ("unknown artist", "unknown", "various artists", "va", "v.a.", "n/a", "untagged")
FOLDER_PLACEHOLDERS = ("unknown artist", "unknown", "various", "n/a", "untagged")
ANY_PLACEHOLDERS = ("unknown artist", "unknown", "various artists", "va")
UNKNOWN_TAGS = ("", "unknown", "unknown artist", "unknown album", "unknown title", "<unknown>", "untitled", "n/a", "none", "(none)", "no artist", "no album", "tba", "tbd", "track", "audio track")
UNSAFE_QUERIES = (*UNKNOWN_TAGS, "[unknown]", "[unknown artist]", "[unknown album]")
SELF_RELEASE_LABELS = ("", "unknown label", "no label", "[no label]", "(no label)", "not on label", "self-released", "self released", "self release", "selfreleased", "independent", "unsigned", "n/a", "none", "(none)", "diy")
SELF_RELEASE_MARKERS = ("self-released", "selfreleased", "independent", "unsigned")
VARIOUS_ARTISTS = ("various artists", "various", "va", "v.a.", "v/a")
MIX_KEYWORDS = ("mix", "compilation", "presents", "selected by", " dj ", "mixed by", "essential mix", "podcast")
LOSSLESS = ("flac", "alac", "ape", "wv", "wave", "aiff", "trueaudio", "dsf", "dff")
LOSSY = ("mp3", "m4a", "opus", "vorbis", "musepack", "asf")
REQUIRED_TAGS = ("artist", "album", "title")
#: Statuses that the re-evaluation of broken rows leaves alone, in both spellings.
PRESERVED_STATUSES = ("duplicate", "orphan", "quarantine", "quarantined")
#: Comments that say a row is broken for another reason than its tags.
OTHER_REASONS = ("copy error", "path build error", "fake-flac", "metadata error", "quarantine")
LABEL_ALIASES = {
    "bit music": "Bit Music",
    "bit music s.a.": "Bit Music",
    "bit music, s.a.": "Bit Music",
    "bit music spain": "Bit Music",
    "max music": "Max Music",
    "max music records": "Max Music",
    "vale music": "Vale Music",
    "vale music s.l.": "Vale Music",
}

#: Columns that are not text. Flags are 0, 1 or null (not checked), so they stay integers.
TYPES: dict[str, T.DataType] = {
    **dict.fromkeys(("size_bytes", "embedded_art_size_bytes"), T.LongType()),
    **dict.fromkeys(
        "bitrate sample_rate channels bit_depth lossless has_embedded_art embedded_art_count has_folder_art transcode_checked transcode_suspected media_track_count totaldiscs totaltracks".split(),
        T.IntegerType(),
    ),
    **dict.fromkeys("mtime duration_seconds transcode_cutoff_hz transcode_confidence ripper_confidence".split(), T.DoubleType()),
}


def conformed(df: DataFrame, known: tuple[str, ...] | None = None) -> DataFrame:
    """df with the catalogue's types; columns outside `known` (all, if not given) are left out."""
    return df.select(*(F.col(c).cast(TYPES.get(c, T.StringType())).alias(c) for c in df.columns if known is None or c in known))

# How much a field matters to who reads of it; the least number comes first.
FIELD_IMPORTANCE = {
    "albumart": 0, "cover": 0, "cover_art": 0,
    "album": 1, "title": 2, "artist": 3, "albumartist": 4, "track_number": 5, "disc_number": 6, "year": 7, "genre": 8,
    "label": 10, "catalog_number": 11, "country": 12, "release_type": 13, "release_status": 14, "media_format": 15, "originaldate": 16, "originalyear": 17, "barcode": 18,
    "composer": 20, "producer": 21, "remixer": 22, "djmixer": 23, "arranger": 24, "conductor": 25, "engineer": 26, "mixer": 27, "lyricist": 28, "writer": 29,
    "bpm": 30, "musical_key": 31, "isrc": 32, "asin": 33, "language": 34, "script": 35, "packaging": 36,
    "mb_genres": 40, "tags": 41, "annotation": 42, "aliases": 43, "url_relations": 44, "website": 45, "copyright": 46, "license": 47,
    "mb_release_id": 60, "musicbrainz_albumid": 61, "musicbrainz_releasegroupid": 62, "musicbrainz_albumartistid": 63, "musicbrainz_artistid": 64, "musicbrainz_recordingid": 65,
    "musicbrainz_labelid": 66, "musicbrainz_workid": 67, "musicbrainz_composerid": 68, "musicbrainz_originalalbumid": 69, "musicbrainz_originalartistid": 70,
    "discogs_release_id": 71, "discogs_master_id": 72, "acoustid_id": 73, "acoustid_fingerprint": 74,
}
#: The place of fields that are not listed.
UNLISTED = 50
