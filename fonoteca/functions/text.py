r"""Text functions of the catalogue as Column expressions: all stay inside the JVM.

Patterns carry (?U) where they must treat letters and spaces beyond ASCII as such. Null counts as ''.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fonoteca import schema

Text = str | Column


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Text) -> Column:
    """null for '' and for spaces alone."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def strip(c: Text) -> Column:
    """Without white space of any kind on either side; TRIM takes only spaces."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def group(c: Text, pattern: str, n: int) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), pattern, n)


def found(c: Text, pattern: str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(pattern)


def parent(path: Text) -> Column:
    return F.regexp_replace(col(path), "/[^/]*$", "")


def basename(path: Text) -> Column:
    return F.substring_index(col(path), "/", -1)


def suffix(path: Text) -> Column:
    """With its dot; '' for none and for dot files."""
    return group(basename(path), r"(?s)^.+(\.[^.]+)$", 1)


def stem(path: Text) -> Column:
    return F.regexp_replace(basename(path), r"(?s)(?<=.)\.[^.]+$", "")


def lenient_int(c: Text) -> Column:
    """The integer at the front, 0 if there is none: what a dynamically typed cast gives."""
    return F.coalesce(group(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0))


def is_missing(c: Text) -> Column:
    return col(c).isNull() | (F.trim(col(c)) == "")


def is_unknown_tag(c: Text) -> Column:
    return F.lower(strip(c)).isin(*schema.UNKNOWN_TAGS)


def safe_query(artist: Text, album: Text) -> Column:
    return ~F.lower(strip(artist)).isin(*schema.UNSAFE_QUERIES) & ~F.lower(strip(album)).isin(*schema.UNSAFE_QUERIES)


def broken_reason(*tags: str) -> Column:
    """'artist, album missing', or '' for a row that has all its required tags."""
    missing = F.concat_ws(", ", *(F.when(is_unknown_tag(t), F.lit(t)) for t in (tags or schema.REQUIRED_TAGS)))
    return F.when(missing == "", "").otherwise(F.concat(missing, F.lit(" missing")))


def normalise_year(c: Text) -> Column:
    year = group(c, r"(?U)\b(\d{4})\b", 1)
    return F.when(year.try_cast("int").between(1900, 2100), year).otherwise("")


def padded(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def normalise_track(c: Text) -> Column:
    """'5', '5/12', '01.05' and 'Track 5' as two digits or more."""
    s = strip(F.element_at(F.split(F.element_at(F.split(F.coalesce(col(c), F.lit("")), "/"), 1), r"\."), -1))
    digits = group(s, r"(\d+)", 1)
    return F.when(digits == "", "").otherwise(padded(digits))


def or_else(c: Column, fallback: str | Column) -> Column:
    """fallback for ''; c stands once in the expression, however long it is."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.get(F.transform(F.array(c), lambda x: F.when(x == "", other).otherwise(x)), F.lit(0))


def clean_name(c: Text, fallback: str = "Unknown") -> Column:
    """Parts split at ; | & and comma, each once whatever its case, joined by ' & '."""
    parts = F.transform(F.split(strip(c), r"(?U)\s*;\s*|\s*\|\s*|\s+&\s+|,\s+"), strip)
    new = lambda seen, p: (p != "") & ~F.exists(seen, lambda q: F.lower(q) == F.lower(p))
    first = F.aggregate(parts, F.array().cast("array<string>"), lambda seen, p: F.when(new(seen, p), F.array_append(seen, p)).otherwise(seen))
    joined = F.array_join(first, " & ")
    return or_else(joined, fallback) if fallback else joined


ILLEGAL = '<>:"/\\|?*\0'


def safe_part(c: Text, fallback: str | Column = "Unknown", illegal: str = ILLEGAL, longest: int = 200) -> Column:
    """A string made fit to be one part of a path."""
    s = clean_name(c, "")
    s = F.translate(s, illegal, "_" * len(illegal)) if illegal else s
    s = F.regexp_replace(F.regexp_replace(s, "_{2,}", "_"), r"(?U)\s{2,}", " ")
    s = F.regexp_replace(s, r"^[ ._]+|[ ._]+$", "")
    s = F.regexp_replace(F.left(s, F.lit(longest)), r"[ ._]+$", "")
    return s if isinstance(fallback, str) and not fallback else or_else(s, fallback)


# Words that mark a bracket at a title's end as the name of a version.
_VERSION = (
    r"(?iU)\s*[\(\[]\s*((?:(?:original|extended|radio|club|dub|vip|remastered?|remaster|remix|edit|mix|version|"
    r"feat|featuring|ft|with|vs|live|acoustic|instrumental|acapella|bonus|cd|disc|\d{4})[^\)\]]*|"
    r"[^\)\]]*(?:mix|remix|edit|version|feat\.?|ft\.?|remaster)[^\)\]]*))\s*[\)\]]\s*$"
)


def split_version(title: Text) -> Column:
    """struct<clean, version> of a title that ends in a bracket naming its version."""
    whole = strip(title)
    clean = strip(F.regexp_replace(whole, _VERSION, ""))
    ok = whole.rlike(_VERSION) & (clean != "")
    return F.struct(F.when(ok, clean).otherwise(whole).alias("clean"), F.when(ok, strip(group(whole, _VERSION, 1))).otherwise("").alias("version"))


def split_primary(artist: Text) -> Column:
    """Without guests: 'feat. X', 'with X', '& X' and 'and X'."""
    s = strip(artist)
    for pattern in (r"(?iU)\s+(feat(?:uring)?\.?|ft\.?)\s+.*$", r"(?iU)\s+with\s+.*$", r"(?U)\s+&\s+.*$", r"(?iU)\s+and\s+.*$"):
        s = F.regexp_replace(s, pattern, "")
    return strip(s)


# Fixed values, in the order in which they are tried.
_SEPARATORS = (r"\s+featuring\s+", r"\s+presents\s+", r"\s+feat\.?\s+", r"\s+ft\.?\s+", r"\s+with\s+", r"\s+vs\.?\s+", r"\s+x\s+", r"\s*&\s*", r"\s*;\s*", r"\s*\|\s*", r"\s*,\s*")


def primary_artist(artist: Text) -> Column:
    """What stands before the first separator, by their order, that has something before it; null for blanks."""
    s = strip(artist)
    heads = [F.nullif(strip(F.when(s.rlike("(?iU)" + p), F.element_at(F.split(s, "(?iU)" + p, 2), 1))), F.lit("")) for p in _SEPARATORS]
    return F.coalesce(*heads, F.nullif(s, F.lit("")))


def normalise_label(label: Text) -> Column:
    """The name that an alias stands for, else the label without white space around."""
    pairs = F.create_map(*(F.lit(x) for pair in schema.LABEL_ALIASES.items() for x in pair))
    return F.coalesce(F.element_at(pairs, F.lower(strip(label))), strip(label))


def is_lossless(codec: Text) -> Column:
    return F.when(col(codec).isin(*schema.LOSSLESS), 1).when(col(codec).isin(*schema.LOSSY), 0)


def duration_text(seconds: Text) -> Column:
    """M:SS, or H:MM:SS from an hour on, of seconds rounded."""
    s = F.bround(F.coalesce(col(seconds), F.lit(0.0))).cast("long")
    short = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(short)


def size_text(size: Text) -> Column:
    """'512 B', '1.5 KB', ... of a number of bytes."""
    c = F.coalesce(col(size), F.lit(0)).cast("double")
    steps = [(1024.0**k, name) for k, name in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"))]
    sized = reduce(lambda acc, x: acc.when(c >= x[0], F.concat(F.format_string("%.1f", F.bround(c / x[0], 1)), F.lit(f" {x[1]}"))), steps[1:], F.when(c >= steps[0][0], F.concat(F.format_string("%.1f", F.bround(c / steps[0][0], 1)), F.lit(" TB"))))
    return sized.otherwise(F.concat(c.cast("long").cast("string"), F.lit(" B")))


def field_importance(field: Text) -> Column:
    """How early a field is told of; what follows a '=' does not count."""
    known = F.create_map(*(F.lit(x) for pair in schema.FIELD_IMPORTANCE.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.substring_index(col(field), "=", 1)), F.lit(schema.UNLISTED))


def by_importance(fields: Column) -> Column:
    """An array of fields, those that matter most first, equal ones in order of their names."""
    keyed = F.transform(fields, lambda f: F.struct(field_importance(f).alias("n"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda x: x["f"])
