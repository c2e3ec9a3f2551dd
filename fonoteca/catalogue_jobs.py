"""Queries of the catalogue's longer jobs: free names, running averages, look-ups, providers, streams, counts kept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fonoteca import schema, tables
from fonoteca.catalogue_queries import FILES_CTE, ORACLES, QUERIES, listed, numbered_sql, register, table  # noqa: F401
from fonoteca.functions import detection, origin, text, udfs
from fonoteca.operators import counts, groups, match, naming, scans, signals
from fonoteca.sources import adapters, lookups, providers
from fonoteca.streaming import stream

# Free names: many files of a folder want one name, some of whose numbers are taken.
_FOLDER = "regexp_replace(path, '/[^/]*$', '')"
_WANTED = (
    f"SELECT path, concat({_FOLDER}, CASE file_id % 4 WHEN 0 THEN '/Track.flac' WHEN 1 THEN concat('/Track (', cast(file_id % 5 AS STRING), ').flac') "
    f"WHEN 2 THEN concat('/', cast(file_id AS STRING), '.flac') ELSE '/Song.flac' END) AS target FROM {{0}}"
)
_THERE = "SELECT concat('/lib/', source, '/', lang, CASE doc_id % 3 WHEN 0 THEN '/Song.flac' ELSE concat('/Track (', cast(n_chars % 9 AS STRING), ').flac') END) AS name FROM {0} WHERE doc_id % 3 < 2"


def unique_targets(spark: SparkSession, d: str) -> DataFrame:
    plan = spark.sql(_WANTED.format("{f}"), f=adapters.files(spark, d))
    return naming.numbered(plan, "target", "path", spark.sql(_THERE.format("{d}"), d=table(spark, d, "documents")))


register("unique_targets", unique_targets, FILES_CTE.rstrip() + ", " + numbered_sql(_WANTED.format("files").replace("STRING", "VARCHAR"), _THERE.format("documents").replace("STRING", "VARCHAR")) + " SELECT * FROM free")

# An average by elapsed time, after every event.
register(
    "smoothed_by_time",
    lambda spark, d: scans.decayed(table(spark, d, "events").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), "user_id", "seconds", "value", 86400.0, "event_id").select("event_id", F.round("smoothed", 6).alias("smoothed")),
    "WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value, lag(epoch_us(ts) / 1e6) OVER w AS before, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "b AS (SELECT *, value * CASE WHEN i = 1 THEN 1.0 ELSE 1 - exp((before - t) / 86400.0) END AS brought FROM e) "
    "SELECT x.event_id, round(sum(y.brought * exp((y.t - x.t) / 86400.0)), 6) AS smoothed FROM b x JOIN b y ON x.user_id = y.user_id AND y.i <= x.i GROUP BY x.event_id",
)


# Many keys at once, in a table laid out for them.
def bulk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The files with the content of a file whose id is divisible by 100."""
    files = adapters.files(spark, d).select("path", "content_hash", "file_id")
    path = tables.new_path(spark, "laid-out")
    lookups.lay_out(files, path, "content_hash")
    return lookups.look_up(spark, path, "content_hash", files.where("file_id % 100 = 0"), ["path", "content_hash"])


register("bulk_lookup", bulk_lookup, FILES_CTE + "SELECT path, content_hash FROM files WHERE content_hash IN (SELECT content_hash FROM files WHERE file_id % 100 = 0)")
register(
    "find_by_hash",
    lambda spark, d: lookups.wanted(adapters.files(spark, d), "content_hash", table(spark, d, "documents").where("doc_id = 7").select(F.md5("text").alias("content_hash"))).select("path"),
    FILES_CTE + "SELECT path FROM files WHERE content_hash = (SELECT md5(text) FROM documents WHERE doc_id = 7)",
)

# Providers: what each knows, asked for with filters that reach its index.
_KNOWN = (
    "SELECT CASE event_type WHEN 'view' THEN 'discogs' WHEN 'click' THEN 'musicbrainz' WHEN 'purchase' THEN 'deezer' ELSE 'itunes' END AS provider, user_id AS album_id, concat('Artist ', cast(user_id % 6 AS STRING)) AS artist, "
    "CASE WHEN user_id % 10 = 3 THEN 'Untitled' ELSE concat('Album ', cast(user_id AS STRING)) END AS album, value * 10 AS score, event_id AS ord, "
    "CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('value ', cast(event_id % 50 AS STRING)) END AS label, cast(1960 + event_id % 60 AS STRING) AS year FROM {0}"
)


def provider_search(spark: SparkSession, d: str) -> DataFrame:
    """The confidence gate over what three of the providers know of the albums, from a score of 50 on."""
    rows = spark.sql(_KNOWN.format("{e}"), e=table(spark, d, "events"))
    index = tables.new_path(spark, "providers")
    providers.write_index(rows, index)
    asked = providers.asked(spark, index, rows.select("album_id", "artist", "album").distinct(), ["discogs", "musicbrainz", "deezer"])
    return match.confidence_gate(asked.where("score >= 50"), "album_id")


register(
    "provider_search",
    provider_search,
    f"WITH known AS ({_KNOWN.format('events').replace('STRING', 'VARCHAR')}), fit AS (SELECT * FROM known WHERE provider IN ('discogs', 'musicbrainz', 'deezer') AND score >= 50 AND lower(album) NOT IN ({listed(schema.UNSAFE_QUERIES)})), "
    "ranked AS (SELECT *, row_number() OVER w AS i, lead(score) OVER w AS second FROM fit WINDOW w AS (PARTITION BY album_id, provider ORDER BY score DESC, ord)) "
    "SELECT album_id, provider, score AS top, second, CASE WHEN score < 80 THEN 'low' WHEN score - second < 5 THEN 'ambiguous' ELSE 'confident' END AS verdict FROM ranked WHERE i = 1",
)

# A stream of listed files, of which only new and changed ones go on.
_SEEN = "SELECT path, cast(size_bytes AS BIGINT) AS size_bytes, cast(1000 + file_id AS DOUBLE) AS mtime FROM {0} WHERE file_id IN (SELECT doc_id FROM {1})"
_LISTED = "SELECT path, cast(size_bytes + CASE WHEN file_id % 8 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size_bytes, cast(1000 + file_id + CASE file_id % 6 WHEN 1 THEN 0.5 WHEN 2 THEN 2.0 ELSE 0.0 END AS DOUBLE) AS mtime FROM {0}"


def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """The listing as a stream of files, against the catalogue as the state it begins with; run to its end and read back."""
    files = adapters.files(spark, d)
    drop, out, checkpoint = (tables.new_path(spark, k) for k in ("listed", "changed", "checkpoint"))
    spark.sql(_LISTED.format("{f}"), f=files).repartition(4, "path").write.parquet(drop)
    listed_now = spark.readStream.schema("path string, size_bytes long, mtime double").option("maxFilesPerTrigger", 2).parquet(drop)
    with stream.state_store(spark):
        changed = stream.changed_only(listed_now, spark.sql(_SEEN.format("{f}", "{known}"), f=files, known=table(spark, d, "labels")))
        changed.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("path string, size_bytes long, mtime double, change string").parquet(out).select("path", "change")


register(
    "stream_changes",
    stream_changes,
    FILES_CTE.rstrip() + f", seen AS ({_SEEN.format('files', 'labels')}), listed AS ({_LISTED.format('files')}) SELECT l.path, CASE WHEN s.path IS NULL THEN 'new' ELSE 'refreshed' END AS change FROM listed l LEFT JOIN seen s ON l.path = s.path "
    "WHERE s.path IS NULL OR s.size_bytes <> l.size_bytes OR abs(s.mtime - l.mtime) >= 1.0",
)

# Counts of roots that are kept, and counted again where a root's time moved.
_ROOTED = "SELECT concat('/lib/', source) AS root, concat('/lib/', source, '/', lang, '/', cast(doc_id % 40 AS STRING)) AS folder, concat(cast(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.flac' WHEN 1 THEN '.mp3' ELSE '.jpg' END) AS name FROM {0}"
_MOVED = "ascii(right(root, 1)) % 2 = 0"


def cached_counts(spark: SparkSession, d: str) -> DataFrame:
    """Roots of one kind have grown since they were counted; the others' counts are kept as they are."""
    rows = spark.sql(_ROOTED.format("{d}"), d=table(spark, d, "documents"))
    path = tables.new_path(spark, "listing")
    rows.write.partitionBy("root").parquet(path)
    listing = spark.read.parquet(path)
    roots = rows.select("root").distinct().withColumn("mtime", F.lit(500.0))
    before = counts.counted(rows.where(f"NOT ({_MOVED}) OR folder NOT LIKE '%7'")).withColumn("mtime", F.expr(f"CASE WHEN {_MOVED} THEN 499.0 ELSE 500.05 END")).withColumn("cached_at", F.lit(1000.0))
    return counts.refreshed(before, roots, listing, 2000.0).select("root", "file_count", "folder_count")


register("cached_counts", cached_counts, f"WITH l AS ({_ROOTED.format('documents').replace('STRING', 'VARCHAR')}) SELECT root, count(*) FILTER (WHERE name LIKE '%.flac' OR name LIKE '%.mp3') AS file_count, count(DISTINCT folder) AS folder_count FROM l GROUP BY root")

# Where rips come from.
_RIPS = (
    "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'XLD 2023' WHEN 2 THEN 'dBpower x' WHEN 3 THEN 'Exact Audio Copy 1.6' WHEN 4 THEN 'Flake#0.11' WHEN 5 THEN 'reference libFLAC 1.3.4' ELSE source END AS vendor, "
    "CASE doc_id % 6 WHEN 0 THEN 'AccurateRipResult' WHEN 1 THEN 'EncoderComment' WHEN 2 THEN 'CUESHEET' WHEN 3 THEN 'xld_estimated_duration' WHEN 4 THEN 'AccurateRipDiscID' ELSE 'GENRE' END AS name1, "
    "CASE doc_id % 5 WHEN 0 THEN 'cuesheet2' WHEN 1 THEN 'My encodercomment' ELSE 'ARTIST' END AS name2, CASE doc_id % 3 WHEN 0 THEN 'ENCODER' WHEN 1 THEN 'Encoder' ELSE 'other' END AS name3, "
    "CASE doc_id % 11 WHEN 0 THEN 'foobar2000 1.6' WHEN 1 THEN 'dBpoweramp 17' WHEN 2 THEN 'xld' WHEN 3 THEN 'EAC' WHEN 4 THEN 'RubyRipper' WHEN 5 THEN 'morituri' WHEN 6 THEN 'Whipper 0.10' WHEN 7 THEN '' ELSE lang END AS value3, "
    "CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'flac' END AS codec, CASE doc_id % 4 WHEN 0 THEN 16 WHEN 3 THEN 32 ELSE 24 END AS bits, CASE doc_id % 5 WHEN 0 THEN 44100 WHEN 1 THEN 96000 WHEN 2 THEN 88200 WHEN 3 THEN 192000 ELSE 48000 END AS rate, "
    "n_chars AS samples, doc_id % 101 / 100.0D AS share FROM {0}"
)


def _ripped(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_RIPS.format("{d}"), d=table(spark, d, "documents"))
    tags = F.create_map(F.col("name1"), F.lit("1"), F.col("name2"), F.lit("2"), F.col("name3"), F.col("value3"))
    return rows.withColumn("r", origin.identify_ripper("vendor", tags))


def _marks_sql(text: str, marks: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({text}), {listed((p,))})' for p in parts)} THEN {{'tool': {listed((tool,))}, 'rank': {origin.RANKS[sure]}}}" for parts, tool, sure in marks) + " END"


_NAMES = "[lower(name1), lower(name2), lower(name3)]"
_HITS = [f"list_filter({_NAMES}, lambda n: contains(n, '{mark}'))[1]" for mark, _, _ in origin.TAG_MARKS]
_RIP_CTE = (
    f"WITH rips AS ({_RIPS.format('documents').replace('100.0D', '100.0::DOUBLE')}), said AS (SELECT *, CASE WHEN lower(name3) = 'encoder' THEN value3 ELSE '' END AS encoder FROM rips), "
    "found AS (SELECT *, list_filter([" + _marks_sql("vendor", origin.VENDOR_MARKS) + ", " + ", ".join(f"CASE WHEN {h} IS NOT NULL THEN {{'tool': '{t}', 'rank': {origin.RANKS[s]}}} END" for h, (_, t, s) in zip(_HITS, origin.TAG_MARKS)) + ", " + _marks_sql("encoder", origin.ENCODER_MARKS) + "], lambda c: c IS NOT NULL) AS cs, "
    "list_filter([CASE WHEN vendor <> '' THEN 'vendor: ' || vendor END, " + ", ".join(f"'tag ''' || {h} || ''' present (→ {t})'" for h, (_, t, _) in zip(_HITS, origin.TAG_MARKS)) + ", CASE WHEN encoder <> '' THEN 'encoder: ' || encoder END], lambda e: e IS NOT NULL) AS evidence FROM said), "
    "best AS (SELECT *, coalesce(list_filter(cs, lambda c: c.rank = 3)[1].tool, list_filter(cs, lambda c: c.rank = 2)[1].tool, list_filter(cs, lambda c: c.rank = 1)[1].tool, '') AS tool, "
    "CASE list_max(list_transform(cs, lambda c: c.rank)) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE '' END AS confidence FROM found) "
)
register(
    "identify_ripper",
    lambda spark, d: _ripped(spark, d).select("doc_id", "r.tool", "r.confidence", F.array_join("r.evidence", "; ").alias("evidence")),
    _RIP_CTE + "SELECT doc_id, tool, confidence, array_to_string(evidence, '; ') AS evidence FROM best",
)
register(
    "audio_findings",
    lambda spark, d: _ripped(spark, d).select("doc_id", origin.audio_findings("codec", "bits", "rate", F.col("r"), "samples", "share").alias("a")).select("doc_id", F.posexplode("a.findings").alias("place", "f")).select("doc_id", "place", "f.*"),
    _RIP_CTE + ", parts AS (SELECT doc_id, CASE WHEN codec = '' THEN [{'code': 'unreadable', 'level': 'warn', 'text': 'couldn''t read header (corrupt or unsupported format?)'}] ELSE list_filter(["
    "CASE WHEN bits = 16 AND rate = 44100 THEN {'code': 'cd_format', 'level': 'info', 'text': '16-bit 44.1 kHz — standard CD format'} WHEN bits >= 24 AND rate >= 88200 THEN {'code': 'hires_claim', 'level': 'info', 'text': printf('%d-bit %.1f kHz — claims hi-resolution audio (verify with deep analysis)', bits, rate / 1000.0)} END, "
    "CASE WHEN tool <> '' THEN {'code': 'ripper_id', 'level': 'info', 'text': tool || ' (' || confidence || ' confidence)'} END, "
    "CASE WHEN bits < 24 THEN NULL WHEN samples < 1000 THEN {'code': 'bit_depth_check', 'level': 'info', 'text': 'too little data decoded'} WHEN share >= 0.95 THEN {'code': 'fake_hires_lowbits', 'level': 'alarm', 'text': printf('%.1f%% of samples have a zero low byte — bottom 8 bits are silent, file is 16-bit upsampled', share * 100)} "
    "WHEN share >= 0.5 THEN {'code': 'bit_depth_check', 'level': 'info', 'text': printf('%.1f%% zero low bytes — suspicious but inconclusive (could be quiet passages)', share * 100)} ELSE {'code': 'bit_depth_check', 'level': 'info', 'text': printf('only %.1f%% zero low bytes — genuine 24-bit content', share * 100)} END], lambda x: x IS NOT NULL) END AS fs FROM best), "
    "places AS (SELECT doc_id, fs, unnest(range(1, len(fs) + 1)) AS i FROM parts) SELECT doc_id, cast(i - 1 AS INTEGER) AS place, fs[i].code AS code, fs[i].level AS level, fs[i].text AS text FROM places",
)
_SOFT = (
    "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN concat('Exact Audio Copy V1.', cast(doc_id % 7 AS STRING), ' from 2016') WHEN 1 THEN 'X Lossless Decoder version 20230104' WHEN 2 THEN 'whipper 0.9.0' ELSE '' END AS log, "
    "CASE doc_id % 5 WHEN 0 THEN 'LAME 3.100' WHEN 1 THEN 'by Lavf58.29.100' ELSE '' END AS encodedby, CASE doc_id % 7 WHEN 0 THEN 'Nero AAC 1.5' WHEN 1 THEN lang ELSE '' END AS tsse, "
    "CASE doc_id % 4 WHEN 0 THEN concat('ripped with Audacity 2.', cast(doc_id % 3 AS STRING)) ELSE source END AS comment, CASE doc_id % 6 WHEN 0 THEN 'reference libFLAC 1.3.4' ELSE '' END AS vendor, CASE doc_id % 8 WHEN 0 THEN 'SoX 14.4' WHEN 1 THEN 'Xing' ELSE '' END AS encoder FROM {0}"
)
_SIGNED = "CASE " + " ".join(f"WHEN regexp_matches(t, {listed((p,))}, 'i') THEN '{name}'" for name, patterns in detection.RIPPERS for p in patterns) + " END"
_VERSIONED = "CASE " + " ".join(f"WHEN regexp_matches(t, {listed((p,))}, 'i') THEN " + (f"trim(regexp_extract(t, {listed((p,))}, 1, 'i'))" if re.compile(p).groups else "''") for _, patterns in detection.RIPPERS for p in patterns) + " END"
register(
    "rip_software",
    lambda spark, d: spark.sql(_SOFT.format("{d}"), d=table(spark, d, "documents"))
    .select("doc_id", origin.rip_detection("log", F.create_map(*(x for c in ("encodedby", "tsse", "comment", "vendor", "encoder") for x in (F.lit(c), F.col(c))))).alias("r"))
    .select("doc_id", "r.software", "r.version", "r.source", F.round("r.confidence", 6).alias("confidence"), "r.lossless"),
    f"WITH s AS ({_SOFT.format('documents').replace('STRING', 'VARCHAR')}), places AS (SELECT doc_id, unnest([{{'o': 1, 'source': 'log_file', 't': log, 'sure': 0.95}}, {{'o': 2, 'source': 'encodedby_tag', 't': encodedby, 'sure': 0.7}}, {{'o': 3, 'source': 'encodersettings', 't': tsse, 'sure': 0.7}}, {{'o': 4, 'source': 'comment_tag', 't': comment, 'sure': 0.6}}, "
    "{'o': 5, 'source': 'vendor_string', 't': vendor, 'sure': 0.8}, {'o': 6, 'source': 'encoder_tag', 't': encoder, 'sure': 0.7}]) AS p FROM s), "
    f"hits AS (SELECT doc_id, o, source, sure, {_SIGNED} AS software, {_VERSIONED} AS version FROM (SELECT doc_id, p.o AS o, p.source AS source, p.t AS t, p.sure AS sure FROM places)), "
    "first AS (SELECT doc_id, min(o) AS o FROM hits WHERE software IS NOT NULL GROUP BY 1) "
    f"SELECT s.doc_id, coalesce(software, '') AS software, coalesce(version, '') AS version, coalesce(source, '') AS source, coalesce(sure::DOUBLE, 0) AS confidence, CASE WHEN software IN ({listed(origin.LOSSLESS_SOFTWARE)}) THEN true WHEN software IN ({listed(origin.LOSSY_SOFTWARE)}) THEN false END AS lossless "
    "FROM s LEFT JOIN first f ON s.doc_id = f.doc_id LEFT JOIN hits h ON h.doc_id = f.doc_id AND h.o = f.o",
)

# Measures of files.
_LINES = (
    "concat_ws(chr(10), CASE event_id % 3 WHEN 0 THEN 'header' WHEN 1 THEN '' ELSE concat('f,0.0,1,x', cast(event_id AS STRING), ',Lossy') END, "
    "CASE event_id % 5 WHEN 0 THEN 'a,b' WHEN 1 THEN concat('  f,0.0,80.05,', cast(event_id % 100 / 100.0{d} AS STRING), ', Lossless ') WHEN 2 THEN concat('f,0.0,80.05,', cast(event_id % 100 / 100.0{d} AS STRING), ',Lossy') WHEN 3 THEN 'f,0.0,80.05,1.0,none' ELSE event_type END, "
    "CASE WHEN event_id % 7 < 4 THEN concat('g,0.0,80.05,', cast(value / 100 AS STRING), ',Original') ELSE 'end' END)"
)
register(
    "verdict_texts",
    lambda spark, d: table(spark, d, "events").select("event_id", signals.verdict_line(F.expr(_LINES.format(d="D"))).alias("v")).select("event_id", "v.verdict", F.round("v.confidence", 6).alias("confidence")),
    f"WITH t AS (SELECT event_id, list_filter(list_transform(string_split({_LINES.format(d='::DOUBLE').replace('STRING', 'VARCHAR')}, chr(10)), lambda x: string_split(trim(x), ',')), lambda p: len(p) >= 5 AND try_cast(p[-2] AS DOUBLE) IS NOT NULL)[1] AS p FROM events), "
    "l AS (SELECT event_id, p, try_cast(p[-2] AS DOUBLE) AS c, lower(trim(p[-1])) AS label FROM t) SELECT event_id, CASE WHEN p IS NULL THEN 'unknown' WHEN label LIKE '%lossy%' THEN 'lossy' WHEN label LIKE '%original%' OR label LIKE '%lossless%' THEN 'original' ELSE '' END AS verdict, "
    "round(CASE WHEN p IS NULL THEN 0 WHEN label LIKE '%lossy%' THEN c WHEN label LIKE '%original%' OR label LIKE '%lossless%' THEN 1 - c ELSE 0 END, 6) AS confidence FROM l",
)
_SPECTRA = "SELECT event_id, cast(event_id * 37 % 23000 AS DOUBLE) + 0.25 AS hz, CASE event_id % 3 WHEN 0 THEN 44100 WHEN 1 THEN 32000 ELSE 96000 END AS rate, CASE WHEN event_id % 10 = 0 THEN -100.0 ELSE -value END AS level FROM {0}"
register(
    "cutoff_notes",
    lambda spark, d: spark.sql(_SPECTRA.format("{e}"), e=table(spark, d, "events")).select("event_id", detection.cutoff_verdict("hz", "rate", "level").alias("v")).select("event_id", "v.*"),
    f"SELECT event_id, level >= -90 AND (hz < 19800 OR (hz < 20500 AND rate / 2 > 21000)) AS suspected, CASE WHEN level < -90 THEN 0 WHEN hz < 14000 THEN 0.95 WHEN hz < 16500 THEN 0.9 WHEN hz < 18500 THEN 0.75 WHEN hz < 19800 THEN 0.55 WHEN rate / 2 <= 21000 THEN 0 WHEN hz < 20500 THEN 0.3 ELSE 0.05 END::DOUBLE AS confidence, "
    "CASE WHEN level < -90 THEN 'window too quiet for reliable analysis' WHEN hz < 14000 THEN 'hard ' ELSE CASE WHEN hz >= 16500 AND (hz < 19800 OR hz >= 20500 OR rate / 2 <= 21000) THEN '' WHEN hz < 16500 THEN 'hard ' ELSE 'borderline ' END END "
    "|| CASE WHEN level < -90 THEN '' ELSE printf('cutoff at %.0f Hz', hz) || CASE WHEN hz < 14000 THEN ' — likely MP3 ≤96 kbps source' WHEN hz < 16500 THEN ' — likely MP3 128 kbps source' WHEN hz < 18500 THEN ' — likely MP3 160-192 kbps source' WHEN hz < 19800 THEN ' — possible MP3 224-256 kbps or AAC source' "
    f"WHEN rate / 2 <= 21000 THEN printf(' (sample rate %d Hz)', rate) WHEN hz < 20500 THEN ' — possible 320 kbps source or band-limited master' ELSE ' — consistent with lossless' END END AS notes FROM ({_SPECTRA.format('events')})",
)
_VALUES = "CASE event_id % 7 WHEN 0 THEN props WHEN 1 THEN concat('[', cast(event_id AS STRING), ', \"', event_type, '\", null, 0, \"\", false, true]') WHEN 2 THEN cast(value AS STRING) WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END WHEN 4 THEN concat('\"', event_type, '\"') WHEN 5 THEN cast(event_id AS STRING) ELSE 'null' END"
register(
    "tag_texts",
    lambda spark, d: table(spark, d, "events").select("event_id", udfs.stringified(F.parse_json(F.expr(_VALUES))).alias("text")),
    f"WITH j AS (SELECT event_id, cast({_VALUES.replace('STRING', 'VARCHAR')} AS JSON) AS j FROM events) SELECT event_id, CASE json_type(j) WHEN 'NULL' THEN '' WHEN 'BOOLEAN' THEN CASE WHEN j::VARCHAR = 'true' THEN '1' ELSE '0' END WHEN 'VARCHAR' THEN j->>'$' "
    "WHEN 'ARRAY' THEN array_to_string(list_transform(list_filter(from_json(j, '[\"JSON\"]'), lambda x: x::VARCHAR NOT IN ('null', '0', '\"\"', 'false')), lambda x: CASE WHEN x::VARCHAR = 'true' THEN '1' ELSE x->>'$' END), '; ') "
    "WHEN 'OBJECT' THEN '{' || array_to_string(list_transform(list_sort(json_keys(j)), lambda k: '\"' || k || '\": ' || (j->k)::VARCHAR), ', ') || '}' ELSE j::VARCHAR END AS text FROM j",
)
_MIXES = "SELECT file_id, artist, albumartist, concat('Album ', cast(file_id % 40 AS STRING), CASE file_id % 40 WHEN 1 THEN ' Mixed By X' WHEN 2 THEN ' Podcast' WHEN 3 THEN ' a DJ set' WHEN 4 THEN ' Selected by Y' WHEN 5 THEN ' compilation' WHEN 6 THEN ' presents Z' WHEN 7 THEN ' Mix' WHEN 8 THEN ' Djs' ELSE '' END) AS album FROM {0}"
register(
    "album_type_named",
    lambda spark, d: groups.album_type(spark.sql(_MIXES.format("{f}"), f=adapters.files(spark, d)).withColumn("albumartist", F.lit(None).cast("string")).withColumn("artist", F.lit("One")), "album"),
    FILES_CTE.rstrip() + f", m AS ({_MIXES.format('files').replace('STRING', 'VARCHAR')}) SELECT DISTINCT album, CASE WHEN " + " OR ".join(f"contains(lower(album), '{k}')" for k in schema.MIX_KEYWORDS) + " THEN 'mix' ELSE 'solo' END AS album_type FROM m",
)
_FIELDS = ("year", "musicbrainz_albumid", "zzz", "bpm", "album", "aaa", "genre", "label", "mood", "acoustid_id")
register(
    "fields_by_importance",
    lambda spark, d: adapters.files(spark, d).select("file_id", F.array_join(text.by_importance(F.array_compact(F.array(*(F.when(F.col("file_id") % (i + 2) != 0, F.concat(F.lit(f + "="), F.col("file_id").cast("string"))) for i, f in enumerate(_FIELDS))))), " ").alias("fields")),
    FILES_CTE.rstrip() + ", ranks AS (SELECT unnest([" + ", ".join(f"'{f}'" for f in _FIELDS) + "]) AS f, unnest([" + ", ".join(str(schema.FIELD_IMPORTANCE.get(f, 50)) for f in _FIELDS) + f"]) AS r, unnest(range(2, {len(_FIELDS) + 2})) AS m) "
    "SELECT file_id, coalesce(string_agg(f || '=' || cast(file_id AS VARCHAR), ' ' ORDER BY r, f), '') AS fields FROM files LEFT JOIN ranks ON file_id % m <> 0 GROUP BY file_id",
)
