"""Where a rip comes from: software by logs and tags, rippers by ranked evidence, findings of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fonoteca.functions.detection import ripper
from fonoteca.functions.text import Text, col

# Software of which it is known whether it keeps all of the sound.
LOSSLESS_SOFTWARE = ("Exact Audio Copy", "X Lossless Decoder", "dBpoweramp", "CUERipper", "Whipper", "libFLAC", "WavPack")
LOSSY_SOFTWARE = ("LAME", "Nero AAC", "FAAC", "QAAC", "Xing", "Fraunhofer")
#: Where tags name software, in the order in which they are asked, and the tags of each place. Fixed values.
TAG_SOURCES = (
    ("encodedby_tag", ("encodedby", "tenc")),
    ("encoder_info", ("encoder_info",)),
    ("encodersettings", ("encodersettings", "encoder_settings", "tsse")),
    ("comment_tag", ("comment",)),
    ("vendor_string", ("vendor",)),
    ("encoder_tag", ("encoder",)),
    ("tool_tag", ("tool",)),
)

# Parts of tag names, of vendor strings and of encoder tags that tell a ripper, and how surely.
TAG_MARKS = (
    ("accurateripresult", "dBpoweramp", "high"),
    ("accurateripdiscid", "dBpoweramp", "high"),
    ("xld_estimated_duration", "XLD", "high"),
    ("encodercomment", "EAC (possibly)", "medium"),
    ("cuesheet", "CUE-based ripper", "low"),
)
VENDOR_MARKS = (
    (("xld",), "XLD", "high"),
    (("dbpoweramp", "dbpower"), "dBpoweramp", "high"),
    (("eac", "exact audio copy"), "EAC", "high"),
    (("flake",), "Flake encoder", "high"),
    (("reference libflac",), "(libFLAC-based ripper)", "low"),
)
ENCODER_MARKS = (
    (("foobar",), "foobar2000", "high"),
    (("dbpoweramp", "dbpower"), "dBpoweramp", "high"),
    (("xld",), "XLD", "high"),
    (("eac", "exact audio copy"), "EAC", "high"),
    (("rubyripper",), "Rubyripper", "high"),
    (("morituri",), "Morituri", "high"),
    (("whipper",), "Whipper", "high"),
)
RANKS = {"high": 3, "medium": 2, "low": 1}


def _first_value(tags: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.try_element_at(tags, F.lit(n)), F.lit("")) for n in names), F.lit(""))


def rip_detection(log: Text, tags: Column) -> Column:
    """struct<software, version, source, confidence, lossless, settings>: a log says it best, then the tags in order.

    tags is a map of lower-cased names. A hit counts 0.7; 0.25 more in a log, 0.1 more in a vendor string or an
    encoder's facts, 0.1 less in a comment. lossless is null for software of either kind.
    """
    places = F.array(F.struct(F.lit("log_file").alias("source"), F.coalesce(col(log), F.lit("")).alias("text")), *(F.struct(F.lit(s).alias("source"), _first_value(tags, n).alias("text")) for s, n in TAG_SOURCES))
    settings = F.substring(_first_value(tags, ("encodersettings", "encoder_settings", "tsse")), 1, 200)

    def judged(p: Column) -> Column:
        hit, source = ripper(p["text"]), p["source"]
        sure = F.when(source == "log_file", F.lit(0.7 + 0.25)).when(source.isin("vendor_string", "encoder_info"), F.lit(0.7 + 0.1)).when(source == "comment_tag", F.lit(0.7 - 0.1)).otherwise(0.7)
        lossless = F.when(hit["software"].isin(*LOSSLESS_SOFTWARE), True).when(hit["software"].isin(*LOSSY_SOFTWARE), False)
        return F.struct(
            hit["software"].alias("software"), hit["version"].alias("version"), source.alias("source"), sure.alias("confidence"), lossless.alias("lossless"), F.when(source == "log_file", "").otherwise(settings).alias("settings")
        )

    hits = F.filter(F.transform(F.filter(places, lambda p: p["text"] != ""), judged), lambda h: h["software"] != "")
    none = F.struct(F.lit("").alias("software"), F.lit("").alias("version"), F.lit("").alias("source"), F.lit(0.0).alias("confidence"), F.lit(None).cast("boolean").alias("lossless"), F.lit("").alias("settings"))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), none)


def _candidate(tool: str, sure: str) -> Column:
    return F.struct(F.lit(tool).alias("tool"), F.lit(sure).alias("confidence"), F.lit(RANKS[sure]).alias("rank"))


def _marked(text: Column, marks: tuple) -> Column:
    """The candidate of the first mark in a text, null for none."""
    low, out = F.lower(text), F.lit(None)
    for parts, tool, sure in reversed(marks):
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = F.when(hit, _candidate(tool, sure)).otherwise(out)
    return out


def identify_ripper(vendor: Text, tags: Column) -> Column:
    """struct<tool, confidence, evidence>: the surest of what vendor string, tag names and encoder tag say, '' for nothing.

    tags is a map from names as they are to values. Evidence is in the order in which it is looked for, and of
    equally sure tools the first one found counts.
    """
    vendor = F.coalesce(col(vendor), F.lit(""))
    names = F.map_keys(F.coalesce(tags, F.create_map().cast("map<string,string>")))
    low = F.transform(names, F.lower)
    encoder_name = F.try_element_at(F.filter(names, lambda n: F.lower(n) == "encoder"), F.lit(1))
    encoder = F.coalesce(F.try_element_at(tags, encoder_name), F.lit(""))
    first_with = lambda mark: F.try_element_at(F.filter(low, lambda n: n.contains(mark)), F.lit(1))
    with_mark = [(first_with(mark), tool, sure) for mark, tool, sure in TAG_MARKS]
    candidates = F.array_compact(F.array(_marked(vendor, VENDOR_MARKS), *(F.when(n.isNotNull(), _candidate(t, s)) for n, t, s in with_mark), _marked(encoder, ENCODER_MARKS)))
    evidence = F.array_compact(
        F.array(
            F.when(vendor != "", F.concat(F.lit("vendor: "), vendor)),
            *(F.concat(F.lit("tag '"), n, F.lit(f"' present (→ {t})")) for n, t, _ in with_mark),
            F.when(encoder != "", F.concat(F.lit("encoder: "), encoder)),
        )
    )
    nobody = F.struct(F.lit("").alias("tool"), F.lit("").alias("confidence"), F.lit(0).alias("rank"))
    best = F.aggregate(candidates, nobody, lambda b, c: F.when(c["rank"] > b["rank"], c).otherwise(b))
    return F.struct(best["tool"].alias("tool"), best["confidence"].alias("confidence"), evidence.alias("evidence"))


#: Fewer samples than this say nothing about the low bytes.
LEAST_SAMPLES = 1000


def audio_findings(codec: Text, bit_depth: Text, sample_rate: Text, ripped: Column, samples: Text, silent_share: Text, deep: bool = True, decoder: bool = True) -> Column:
    """struct<skip_reason, fake_hires, findings>; findings are structs of code, level and text, in order.

    ripped is what identify_ripper gives, samples how many of 24 bits were read, silent_share the share of
    them with a zero low byte. Without a codec the header could not be read; where `deep` or `decoder` is
    false, only the header counts, and the reason says so.
    """
    bits, rate = F.coalesce(col(bit_depth), F.lit(0)), F.coalesce(col(sample_rate), F.lit(0))
    finding = lambda code, level, text: F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))
    header = F.when((bits == 16) & (rate == 44100), finding("cd_format", "info", "16-bit 44.1 kHz — standard CD format")).when(
        (bits >= 24) & (rate >= 88200), finding("hires_claim", "info", F.concat(bits.cast("string"), F.lit("-bit "), F.format_string("%.1f", rate / 1000), F.lit(" kHz — claims hi-resolution audio (verify with deep analysis)")))
    )
    unread = "couldn't read header (corrupt or unsupported format?)"
    share = F.coalesce(col(silent_share), F.lit(0.0))
    percent = F.format_string("%.1f%%", share * 100)
    enough = F.coalesce(col(samples), F.lit(0)) >= LEAST_SAMPLES
    fake = (bits >= 24) & enough & (share >= 0.95)
    low = (
        F.when(bits < 24, F.lit(None))
        .when(~enough, finding("bit_depth_check", "info", "too little data decoded"))
        .when(share >= 0.95, finding("fake_hires_lowbits", "alarm", F.concat(percent, F.lit(" of samples have a zero low byte — bottom 8 bits are silent, file is 16-bit upsampled"))))
        .when(share >= 0.5, finding("bit_depth_check", "info", F.concat(percent, F.lit(" zero low bytes — suspicious but inconclusive (could be quiet passages)"))))
        .otherwise(finding("bit_depth_check", "info", F.concat(F.lit("only "), percent, F.lit(" zero low bytes — genuine 24-bit content"))))
    )
    named = F.when(ripped["tool"] != "", finding("ripper_id", "info", F.concat(ripped["tool"], F.lit(" ("), ripped["confidence"], F.lit(" confidence)"))))
    if not deep:
        rest, reason, fake = [], "deep analysis disabled (header-only mode)", F.lit(False)
    elif not decoder:
        rest, reason, fake = [finding("no_ffmpeg", "warn", "install ffmpeg for spectral / sample-level analysis")], "ffmpeg not installed — header-only mode", F.lit(False)
    else:
        rest, reason = [named, low], ""
    missing = F.coalesce(col(codec), F.lit("")) == ""
    return F.struct(
        F.when(missing, unread).otherwise(reason).alias("skip_reason"),
        (~missing & fake).alias("fake_hires"),
        F.when(missing, F.array(finding("unreadable", "warn", unread))).otherwise(F.array_compact(F.array(header, *rest))).alias("findings"),
    )
