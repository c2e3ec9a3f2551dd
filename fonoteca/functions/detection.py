r"""Recognition of releases by their names: compilations, series, catalogue numbers, DJ sets, rippers.

The word lists and patterns are fixed values; a pattern is searched for as a whole alternation, so a
column is read once. (?iU) ignores case and takes letters and spaces of all scripts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from fonoteca.functions.text import Text, col, found, group, strip

# Fixed values.
COMPILATIONS = (
    r"\bdj\s+\w+\s+(presents?|mix|set)\b",
    r"\bmixed\s+by\b",
    r"\b(continuous|non[\s-]?stop|nonstop)\s+mix\b",
    r"\b(megamix|mega\s+mix|big\s+mix|club\s+mix\s+vol)\b",
    r"\bmashup\b",
    r"\bessential\s+mix\b",
    r"\bpodcast\s*\d*\b",
    r"\b(radio|broadcast)\s+show\b",
    r"\bsessions?\s+\d{2,4}\b",
    r"\b(various\s+artists?|v\.?a\.?)\b",
    r"\bcompilation\b",
    r"\bbest\s+(of|hits|selection|songs?|tracks?|collection|album|eurobeat)\b",
    r"\bgreatest\s+hits\b",
    r"\bnow\s+that'?s\s+what\s+i\s+call\b",
    r"\b(presents?|selected\s+by|curated\s+by|chosen\s+by)\b",
    r"\bthe\s+very\s+best\s+of\b",
    r"\b(top|hot)\s+\d{2,3}\b",
    r"\bclub\s+(classics|anthems|nation)\b",
    r"\b(decade|retrospective|anthology)\b",
    r"\b(hits|best|classics|collection|selection|anthology|compilation|years?)\b[^a-z]{0,15}\b\d{4}[\s-]+\d{4}\b",
    r"\b\d{4}[\s-]+\d{4}\b[^a-z]{0,15}\b(hits|best|classics|collection|selection)\b",
    r"\b(super\s+)?eurobeat\b",
    r"\binitial\s+d\b",
    r"\b(dance\s+dance\s+revolution|ddr)\b",
    r"\bbemani\b",
    r"\b(touhou|fate|vocaloid)\b",
    r"\b(ost|o\.s\.t\.?|original\s+soundtrack)\b",
    r"\bbgm\s+collection\b",
    r"\banime\s+(songs?|hits|collection)\b",
    r"\b(vol(ume)?|pt\.?|part)\.?\s*\d+\b",
    r"\b(disc|cd)\s*\d+\s+of\s+\d+\b",
    r"~.+~",
    r"\b\d+(st|nd|rd|th)?\s+anniversary\b",
    r"\b(20|30|40|50|60)\s*years?\s+(of|in)\b",
    r"\bfeat(uring)?\.\s+various\b",
)
UNOFFICIAL = (
    "[unofficial]", "(unofficial)", "[bootleg]", "(bootleg)", "[fan made]", "(fan made)", "[fanmade]", "(fanmade)", "[unreleased]",
    "(unreleased)", "[demo]", "(demo)", "[white label]", "(white label)", "[promo only]", "[bandcamp exclusive]", "[soundcloud rip]",
)
EDITIONS = (
    r"\s*\(deluxe\s+(edition|version)\)\s*",
    r"\s*\[deluxe\s+(edition|version)\]\s*",
    r"\s*\(expanded\s+(edition|version)\)\s*",
    r"\s*\(special\s+edition\)\s*",
    r"\s*\(remastered?(\s+\d{4})?\)\s*",
    r"\s*\(\d{4}\s+remaster(ed)?\)\s*",
    r"\s*\(anniversary\s+edition\)\s*",
    r"\s*\(bonus\s+track\s+version\)\s*",
    r"\s*\(with\s+bonus\s+tracks?\)\s*",
    r"\s*\(explicit\)\s*",
    r"\s*\(clean\)\s*",
    r"\s*\(international\s+version\)\s*",
    r"\s*\(japan(ese)?\s+(version|edition)\)\s*",
    r"\s*\(uk\s+(version|edition)\)\s*",
    r"\s*\(us\s+(version|edition)\)\s*",
    r"\s*[-(\[]\s*disc\s*\d+(\s+of\s+\d+)?\s*[)\]]?\s*$",
    r"\s*[-(\[]\s*cd\s*\d+(\s+of\s+\d+)?\s*[)\]]?\s*$",
    r"\s*\[\s*hd\s*\]\s*",
    r"\s*\(mp3\s+\d+kbps\)\s*",
)
#: Wave dashes and full-width signs, and what they become.
WIDE, NARROW = "〜～~　！？：｛｝", "    !?:()"
SERIES = (
    r"^(.*?(?:sound\s+pack|sample\s+pack))\s*[:#\-]?\s*(?:#|vol(?:ume)?\.?\s*|no\.?\s*)?(\d{1,4})\s*$",
    r"^(.+?(?:session|podcast|radio\s+show|episode|mix\s+series))\s*(?:[:#]\s*)?(\d{0,4})\s*$",
    r"^((?:\w+\s+){1,5}\w+)\s+(?:vol(?:ume)?\.?|#|no\.?)\s*(\d{1,4})\s*$",
)
SERIES_PREFIXES = (
    "dancemania", "now that's what i call", "now thats what i call", "ministry of sound", "trance nation", "hed kandi", "global underground",
    "ibiza annual", "bonzai progressive", "fabriclive", "back to mine", "essential mix", "this is house", "in the mix", "soulseekerz", "uk garage",
    "drum & bass arena", "drum and bass arena", "ram nation", "hospitality presents", "hospital records presents", "metalheadz presents",
    "ministry magazine", "kiss in ibiza", "cream ibiza", "godskitchen",
)
DJ_MARKERS = (
    "mixed by", "continuous mix", "nonstop mix", "non-stop mix", "live set", "live @", "live at", "radio show", "podcast", "session #",
    "session no", "essential mix", "boiler room", "bbc radio 1", "dj set", "dj-set",
)
CATALOGUE = r"[\[\(]\s*([A-Za-z][A-Za-z&\-\s]{1,20}?)\s+(\d{1,6}[A-Za-z]{0,3})\s*[\]\)]"
#: Patterns of titles that hold more than a title; groups: track, artist, title, version, extra.
TITLES = (
    (r"^\s*(\d{1,3})[\.\)\-]\s+(.+?)\s*[-–]\s*(.+?)(?:\s*\(([^)]+)\))?(?:\s*\[([^\]]+)\])?\s*$", (1, 2, 3, 4, 5), 0.95),
    (r"^\s*(.+?)\s+[-–]\s+(.+?)(?:\s*\(([^)]+)\))?\s*$", (0, 1, 2, 3, 0), 0.75),
    (r"^\s*(\d{1,3})\s*[-\.\)]\s+(.+?)\s*$", (1, 0, 2, 0, 0), 0.55),
)
FOLDERS = (
    (r"^(.+?)\s+[-–—]\s+(.+?)\s*[\(\[](?:19|20)\d{2}[\)\]]\s*$", 1, 2),
    (r"^(.+?)\s+[-–—]\s+(.+?)\s*$", 1, 2),
    (r"^(.+?)\s*[\(\[](?:19|20)\d{2}[\)\]]\s*$", 0, 1),
)
FILENAMES = (r"^\d{1,3}\s*[\.\-]?\s+(.+?)\s+[-–—]\s+(.+?)\s*$", r"^(.+?)\s+[-–—]\s+(.+?)\s*$")
ROOT_FOLDERS = ("music", "flac", "mp3", "audio", "downloads", "media", "library")
#: Software that made a rip, in the order in which it is looked for.
RIPPERS = (
    ("Exact Audio Copy", (r"Exact Audio Copy\s+V?([\w\d\.\s]+?)(?:from|on|\n|\s{2,})", r"\bEAC\s+extraction\b", r"exactaudiocopy\.de")),
    ("X Lossless Decoder", (r"X\s*Lossless\s*Decoder\s+version\s+(\S+)", r"\bXLD\s+version\b")),
    ("dBpoweramp", (r"dBpoweramp\s+(?:CD\s+Ripper\s+)?(?:Release\s+)?([\d\.]+)", r"dBpoweramp Music Converter")),
    ("fre:ac", (r"\bfre:ac\s+v?([\d\.]+)", r"BonkEnc")),
    ("CUERipper", (r"CUERipper\s+v?([\d\.]+)",)),
    ("Whipper", (r"\bwhipper\s+([\d\.]+)", r"morituri")),
    ("RipIt", (r"\bRipIt\s+([\d\.]+)",)),
    ("Max", (r"\bMax (?:CD Ripper )?([\d\.]+)\s+\(",)),
    ("iTunes", (r"\bcom\.apple\.iTunes\b", r"\biTunNORM\b", r"iTunes\s+([\d\.]+)")),
    ("foobar2000", (r"foobar2000\s+v?([\d\.]+)",)),
    ("LAME", (r"\bLAME\s*([\d\.]+)", r"\bLAME3\.(\d+)")),
    ("Nero AAC", (r"Nero\s+AAC\s+([\d\.]+)", r"\bNero\s+AAC\s+codec\b")),
    ("FAAC", (r"\bFAAC\b", r"libfaac")),
    ("QAAC", (r"\bqaac\b", r"CoreAudio AAC")),
    ("FFmpeg", (r"\bLavf(?:\d+\.\d+\.\d+)?\b", r"\bLavc\d+\.\d+\.\d+\b", r"FFmpeg(?:\s+(\S+))?")),
    ("SoX", (r"\bSoX\s+([\d\.]+)",)),
    ("libFLAC", (r"reference\s+libFLAC\s+([\d\.]+)", r"libFLAC\s+([\d\.]+)")),
    ("Sound Forge", (r"Sound Forge\s+(?:Pro\s+)?([\d\.]+)",)),
    ("Audacity", (r"Audacity\s+([\d\.]+)",)),
    ("WavePack", (r"WavPack\s+([\d\.]+)",)),
    ("Xing", (r"\bXing\b",)),
    ("Fraunhofer", (r"Fraunhofer",)),
)
FLAGS = "(?iU)"


def compilation_match(album: Text) -> Column:
    """The part of an album's name that marks a compilation or mix; '' for none."""
    return group(album, FLAGS + "|".join(COMPILATIONS), 0)


def unofficial_marker(album: Text) -> Column:
    """The first marker, in list order, of a release that no shop lists; '' for none."""
    low = F.lower(F.coalesce(col(album), F.lit("")))
    return F.coalesce(*(F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in UNOFFICIAL), F.lit(""))


def normalise_query(name: Text) -> Column:
    """A name as outside indexes know it: no wide signs, markers, editions and edge punctuation."""
    s = F.translate(F.coalesce(col(name), F.lit("")), WIDE, NARROW)
    s = F.regexp_replace(s, "(?i)" + "|".join(re.escape(m) for m in UNOFFICIAL), "")
    s = F.regexp_replace(s, FLAGS + "|".join(EDITIONS), " ")
    s = strip(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.regexp_replace(F.regexp_replace(s, r"(?U)[\s\-_\.,;:]+$", ""), r"(?U)^[\s\-_\.,;:]+", "")


def catalogue_number(text: Text) -> Column:
    """struct<label, number> of a bracketed catalogue number, null for none and for years."""
    label, number = F.trim(group(text, CATALOGUE, 1)), group(text, CATALOGUE, 2)
    ok = found(text, CATALOGUE) & (F.length(label) >= 2) & ~F.coalesce(number.try_cast("int").between(1900, 2099) & number.rlike("^[0-9]+$"), F.lit(False))
    return F.when(ok, F.struct(label.alias("label"), number.alias("number")))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital, as in \"Now That'S What\"."""
    parts = F.split(F.lower(c), r"(?U)(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 20))), "")


def compilation_series(album: Text) -> Column:
    """struct<name, issue> by the patterns in order, then by known prefixes; null for none."""
    a = strip(album)
    out = F.lit(None).cast("struct<name:string,issue:string>")
    low = F.lower(a)
    prefix = F.coalesce(*(F.when(F.startswith(low, F.lit(p)), F.lit(p)) for p in SERIES_PREFIXES))
    out = F.when(prefix.isNotNull(), F.struct(title_case(prefix).alias("name"), F.lit("").alias("issue"))).otherwise(out)
    for pattern in reversed(SERIES):
        name = F.regexp_replace(strip(group(a, FLAGS + pattern, 1)), "[:,#-]+$", "")
        out = F.when(a.rlike(FLAGS + pattern) & (name != ""), F.struct(name.alias("name"), group(a, FLAGS + pattern, 2).alias("issue"))).otherwise(out)
    return out


def parse_title(title: Text, filename: Text | None = None) -> Column:
    """struct<track, artist, title, version, extra, confidence>; a blank title is read from the file's name."""
    given = strip(title)
    name = F.coalesce(col(filename), F.lit("")) if filename is not None else F.lit("")
    whole = F.when(given == "", name).otherwise(given)
    names = ("track", "artist", "title", "version", "extra")
    empty = F.lit("")
    out = F.struct(empty.alias("track"), empty.alias("artist"), whole.alias("title"), empty.alias("version"), empty.alias("extra"), F.lit(0.0).alias("confidence"))
    for pattern, places, sure in reversed(TITLES):
        parts = [(strip(group(whole, "(?U)" + pattern, p)) if p else empty).alias(n) for n, p in zip(names, places)]
        out = F.when(whole.rlike("(?U)" + pattern), F.struct(*parts, F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def title_looks_like_filename(title: Text, path: Text) -> Column:
    from fonoteca.functions.text import stem

    t = F.coalesce(col(title), F.lit(""))
    seps = F.regexp_count(t, F.lit(" - ")) + F.regexp_count(t, F.lit("_")) + F.regexp_count(t, F.lit(r"\."))
    return (t != "") & (F.coalesce(col(path), F.lit("")) != "") & ((strip(t) == strip(stem(path))) | ((seps >= 3) & (F.length(t) > 30)))


def looks_like_dj_set(duration: Text, *texts: Text) -> Column:
    """45 minutes or more, or a marker in any of the texts."""
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(col(t), F.lit("")) for t in texts)))
    marked = hay.rlike("|".join(re.escape(m) for m in DJ_MARKERS))
    return (F.coalesce(col(duration), F.lit(0.0)) >= 2700) | marked


def quick_check(album: Text) -> Column:
    """How an album is to be looked for: skipped, as various artists, by series or by catalogue number."""
    marker, series, number, hit = unofficial_marker(album), compilation_series(album), catalogue_number(album), compilation_match(album)
    skip = marker != ""
    series, number = F.when(~skip, series), F.when(~skip, number)
    note = F.concat_ws(
        "; ",
        F.when(series.isNotNull(), F.concat(F.lit("compilation series '"), series["name"], F.lit("'"), F.when(series["issue"] != "", F.concat(F.lit(" #"), series["issue"])).otherwise(""))),
        F.when(number.isNotNull(), F.concat(F.lit("catalogue: "), number["label"], F.lit(" "), number["number"])),
        F.when(~skip & (hit != ""), F.concat(F.lit("compilation pattern matched: '"), hit, F.lit("'"))),
    )
    return F.struct(
        skip.alias("skip"),
        (~skip & (series.isNotNull() | (hit != ""))).alias("various_artists"),
        series["name"].alias("series"),
        series["issue"].alias("issue"),
        number["label"].alias("catalogue_label"),
        number["number"].alias("catalogue_number"),
        normalise_query(album).alias("query"),
        note.alias("note"),
    )


def recover_from_path(path: Text) -> Column:
    """struct<artist, album, title>: what the names of a file and its folders tell, '' for nothing."""
    from fonoteca.functions.text import basename, parent, stem

    folder, grand, name = basename(parent(path)), basename(parent(parent(path))), stem(path)
    artist, album, hit = F.lit(""), F.lit(""), F.lit(False)
    for pattern, a, b in reversed(FOLDERS):
        here = folder.rlike("(?U)" + pattern)
        artist = F.when(here, strip(group(folder, "(?U)" + pattern, a)) if a else F.lit("")).otherwise(artist)
        album = F.when(here, strip(group(folder, "(?U)" + pattern, b))).otherwise(album)
        hit = hit | here
    bare = ~hit & (folder != "") & ~folder.contains(" - ") & ~folder.contains(" – ")
    album = F.when(bare, folder).otherwise(album)
    artist = F.when(bare & (grand != "") & ~F.lower(grand).isin(*ROOT_FOLDERS), grand).otherwise(artist)
    of_name, title = F.lit(""), F.lit("")
    for pattern in reversed(FILENAMES):
        here = name.rlike("(?U)" + pattern)
        of_name = F.when(here, strip(group(name, "(?U)" + pattern, 1))).otherwise(of_name)
        title = F.when(here, strip(group(name, "(?U)" + pattern, 2))).otherwise(title)
    return F.struct(F.when(artist != "", artist).otherwise(of_name).alias("artist"), album.alias("album"), title.alias("title"))


def ripper(text: Text, boost: float = 0.0) -> Column:
    """struct<software, version, confidence> of the first signature found; 0.25 more for a log."""
    t = F.coalesce(col(text), F.lit(""))
    out = F.struct(F.lit("").alias("software"), F.lit("").alias("version"), F.lit(0.0).alias("confidence"))
    for software, patterns in reversed(RIPPERS):
        for pattern in reversed(patterns):
            version = strip(F.coalesce(group(t, FLAGS + pattern, 1), F.lit(""))) if re.compile(pattern).groups else F.lit("")
            hit = F.struct(F.lit(software).alias("software"), version.alias("version"), F.lit(round(min(1.0, 0.7 + boost), 2)).alias("confidence"))
            out = F.when(t.rlike(FLAGS + pattern), hit).otherwise(out)
    return out


#: Cutoffs in Hz below which a file looks like one of a lossy source, how sure that is, and what is noted. Fixed values.
CUTOFFS = (
    (14000, 0.95, "hard cutoff at %.0f Hz — likely MP3 ≤96 kbps source"),
    (16500, 0.90, "hard cutoff at %.0f Hz — likely MP3 128 kbps source"),
    (18500, 0.75, "cutoff at %.0f Hz — likely MP3 160-192 kbps source"),
    (19800, 0.55, "cutoff at %.0f Hz — possible MP3 224-256 kbps or AAC source"),
)


def cutoff_verdict(cutoff_hz: Text, sample_rate: Text, mean_db: Text | None = None) -> Column:
    """struct<suspected, confidence, notes> of a spectral cutoff; silence (below -90 dB) is never suspected."""
    c, nyquist = col(cutoff_hz), col(sample_rate) / 2
    shown = F.bround(c.cast("double"), 0)
    verdict = lambda suspected, sure, note: F.struct(F.lit(suspected).alias("suspected"), F.lit(sure).alias("confidence"), (note if isinstance(note, Column) else F.format_string(note, shown)).alias("notes"))
    rate = F.concat(F.format_string("cutoff at %.0f Hz (sample rate ", shown), col(sample_rate).cast("int").cast("string"), F.lit(" Hz)"))
    out = (
        F.when(nyquist <= 21000, verdict(False, 0.0, rate))
        .when(c < 20500, verdict(True, 0.3, "borderline cutoff at %.0f Hz — possible 320 kbps source or band-limited master"))
        .otherwise(verdict(False, 0.05, "cutoff at %.0f Hz — consistent with lossless"))
    )
    for most, sure, note in reversed(CUTOFFS):
        out = F.when(c < most, verdict(True, sure, note)).otherwise(out)
    if mean_db is not None:
        out = F.when(col(mean_db) < -90, verdict(False, 0.0, F.lit("window too quiet for reliable analysis"))).otherwise(out)
    return out
