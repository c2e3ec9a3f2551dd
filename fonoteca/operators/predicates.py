"""Row predicates of the catalogue. A null status passes no `status <> ...` test, as in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fonoteca import schema
from fonoteca.functions.text import Text, col, is_missing, lenient_int

TAGS = ("artist", "album", "title", "label", "year", "albumartist", "genre", "track_number")
#: Two digits first and a hyphen anywhere later, over line ends too.
DIGITS_FIRST = r"(?s)^[0-9][0-9].*-"


def not_broken() -> Column:
    return F.col("status") != "broken"


def missing_tag(column: str) -> Column:
    if column not in TAGS:
        raise ValueError(f"no audited tag: {column}")
    return is_missing(column)


def placeholder(column: Text, values: tuple[str, ...]) -> Column:
    return F.lower(F.trim(col(column))).isin(*values)


def starts_like_filename(column: Text) -> Column:
    return col(column).rlike(DIGITS_FIRST)


def flag_is_zero(column: Text) -> Column:
    """Checked and found absent; a null is not checked."""
    return col(column).isNotNull() & (col(column) == 0)


def flag_not_set(column: Text) -> Column:
    return F.coalesce(col(column), F.lit(0)) == 0


def odd_year(column: Text, last: int) -> Column:
    """Neither blank nor from 1900 to `last`, by the number at the front of its first four characters."""
    year = lenient_int(F.substring(col(column), 1, 4))
    return ~is_missing(column) & ((year < 1900) | (year > last))


def year_between(column: Text, first: str, last: str) -> Column:
    """By text, as years are kept."""
    return F.substring(col(column), 1, 4).between(first, last)


def contains(column: Text, part: str) -> Column:
    """Substring search without regard to case; % and _ in `part` are wildcards."""
    return col(column).ilike(f"%{part}%")


def confirmed_lossy() -> Column:
    notes, confidence = F.col("transcode_notes"), F.col("transcode_confidence")
    sure = F.coalesce(F.startswith(notes, F.lit("vamp:lossy:")), F.lit(False)) | F.coalesce(confidence >= 0.9, F.lit(False))
    return (F.col("transcode_suspected") == 1) & sure & ~F.col("status").isin("quarantined", "broken")


def unchecked_lossless(codecs: tuple[str, ...] = ("flac", "alac", "ape", "wv", "wave", "aiff", "trueaudio")) -> Column:
    return F.col("codec").isin(*codecs) & not_broken() & flag_not_set("transcode_checked")


def any_bad() -> Column:
    """Any of eight defects, of rows that are not broken already."""
    missing = [is_missing(c) for c in ("artist", "album", "title", "label", "year")]
    defects = [*missing, placeholder("artist", schema.ANY_PLACEHOLDERS), starts_like_filename("title"), F.col("transcode_suspected") == 1]
    either = defects[0]
    for d in defects[1:]:
        either = either | d
    return not_broken() & F.coalesce(either, F.lit(False))


def preferred_path() -> Column:
    return F.coalesce(F.nullif("organised_path", F.lit("")), "path")


def under(path: Text, root: str) -> Column:
    return F.startswith(col(path), F.lit(root.rstrip("/") + "/"))
