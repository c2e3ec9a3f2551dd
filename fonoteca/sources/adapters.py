"""The catalogue's tables, made from the driver's, by SQL that Spark and an oracle both run."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

#: Line items that a task of their joins gets, about.
ROWS = 500_000

FILES = """
SELECT
  d.doc_id AS file_id,
  concat('/lib/', d.source, '/', d.lang, '/', cast(d.doc_id AS STRING), '.flac') AS path,
  d.n_chars AS size_bytes,
  md5(d.text) AS content_hash,
  CASE WHEN d.doc_id % 10 = 0 THEN NULL WHEN d.doc_id % 10 = 1 THEN '  '
       WHEN d.doc_id % 10 = 2 THEN 'Unknown Artist' ELSE concat('Artist ', cast(d.doc_id % 6 AS STRING)) END AS artist,
  CASE WHEN d.doc_id % 7 = 0 THEN 'Various Artists' WHEN d.doc_id % 7 = 1 THEN NULL
       ELSE concat('Artist ', cast(d.doc_id % 6 AS STRING)) END AS albumartist,
  CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE concat('Album ', d.source) END AS album,
  CASE WHEN d.doc_id % 9 = 0 THEN concat('0', cast(d.doc_id % 9 + 1 AS STRING), ' - Song') WHEN d.doc_id % 23 = 0 THEN ''
       ELSE concat('Song ', cast(d.doc_id AS STRING)) END AS title,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE concat('Label ', cast(d.doc_id % 3 AS STRING)) END AS label,
  CASE WHEN d.doc_id % 13 = 0 THEN '0000' WHEN d.doc_id % 17 = 0 THEN ' ' WHEN d.doc_id % 29 = 0 THEN '19a2'
       ELSE concat(cast(1985 + d.doc_id % 40 AS STRING), '-06-01') END AS year,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE concat('Genre ', cast(d.doc_id % 4 AS STRING)) END AS genre,
  concat(cast(d.doc_id % 14 + 1 AS STRING), CASE WHEN d.doc_id % 3 = 0 THEN '/14' ELSE '' END) AS track_number,
  CASE WHEN d.doc_id % 11 = 0 THEN concat('CAT ', cast(d.doc_id AS STRING)) END AS catalog_number,
  CASE WHEN d.doc_id % 12 = 0 THEN 'copy error: disk' WHEN d.doc_id % 12 = 1 THEN 'nice' END AS comment,
  cast(d.n_chars AS DOUBLE) / 10 AS duration_seconds,
  CASE d.lang WHEN 'en' THEN 'flac' WHEN 'fr' THEN 'mp3' WHEN 'de' THEN 'ape' ELSE 'opus' END AS codec,
  CASE WHEN d.lang IN ('en', 'de') THEN 1 ELSE 0 END AS lossless,
  CASE WHEN d.lang = 'en' AND d.doc_id % 5 <> 0 THEN 16 END AS bit_depth,
  CASE WHEN d.doc_id % 3 = 0 THEN 0 WHEN d.doc_id % 3 = 1 THEN 1 END AS has_embedded_art,
  CASE WHEN d.doc_id % 4 = 0 THEN 0 WHEN d.doc_id % 4 = 1 THEN 1 END AS has_folder_art,
  CASE WHEN d.doc_id % 2 = 0 THEN 1 WHEN d.doc_id % 5 = 0 THEN 0 END AS transcode_checked,
  CASE WHEN d.doc_id % 31 = 0 THEN 1 ELSE 0 END AS transcode_suspected,
  CASE WHEN d.doc_id % 62 = 0 THEN 0.95 WHEN d.doc_id % 31 = 0 THEN 0.55 END AS transcode_confidence,
  CASE WHEN d.doc_id % 93 = 0 THEN 'vamp:lossy:0.990' WHEN d.doc_id % 31 = 0 THEN 'hard cutoff' END AS transcode_notes,
  CASE WHEN d.doc_id % 6 = 0 THEN concat('/out/', d.lang, '/', cast(d.doc_id AS STRING), '.flac') WHEN d.doc_id % 6 = 1 THEN '' END AS organised_path,
  CASE WHEN d.doc_id % 4 = 1 THEN '2024-05-01 10:00:00' END AS organised_at,
  CASE WHEN d.doc_id % 8 = 1 THEN '2024-06-01 10:00:00' ELSE '2024-04-01 10:00:00' END AS last_seen,
  CASE WHEN l.quality = 0 THEN 'broken' WHEN l.toxic = 1 THEN 'quarantined'
       WHEN l.quality = 1 THEN 'imported' WHEN d.doc_id % 2 = 0 THEN 'indexed' END AS status
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

#: A track a line item: albums are orders, artists are suppliers.
TRACKS = """
SELECT l.l_orderkey AS album_id, l.l_linenumber AS track, cast(l.l_suppkey AS STRING) AS artist, l.l_quantity AS duration_seconds,
       l.l_extendedprice AS size_bytes, p.p_name AS title, substr(cast(o.o_orderdate AS STRING), 1, 4) AS year, p.p_brand AS label
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

#: Candidates of outside sources: an album is a user, a source an event type.
CANDIDATES = """
SELECT user_id AS album_id, event_type AS provider, value AS score, event_id AS ord,
       CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('value ', cast(event_id % 50 AS STRING)) END AS label,
       concat(cast(1960 + event_id % 60 AS STRING)) AS year
FROM {events}
"""

#: Files of a folder, as a directory listing gives them.
LISTING = """
SELECT concat('/lib/', d.source, '/', d.lang, '/', cast(d.doc_id % 40 AS STRING)) AS folder, d.n_chars AS size_bytes,
       concat(cast(d.doc_id AS STRING), CASE d.doc_id % 9 WHEN 0 THEN '.flac' WHEN 1 THEN '.jpg' WHEN 2 THEN '.pdf' WHEN 3 THEN '.zip'
         WHEN 4 THEN '.mp3' WHEN 5 THEN '.log' WHEN 6 THEN '.exe' WHEN 7 THEN '.dat' ELSE '' END) AS name
FROM {documents} d
"""


def bare(sql: str) -> str:
    """The SQL over tables of their own names, for an oracle."""
    for name in ("documents", "labels", "lineitem", "part", "orders", "events"):
        sql = sql.replace("{" + name + "}", name)
    return sql


def _run(spark: SparkSession, sf_dir: str, sql: str, tasks: int = 0, keys: dict[str, str] | None = None, merged: str = "") -> DataFrame:
    """The SQL over the tables of a folder; those that have a key are dealt out by it to so many tasks, and the merged one joins there."""
    names = [n for n in ("documents", "labels", "lineitem", "part", "orders", "events") if "{" + n + "}" in sql]
    read = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    dealt = {n: read[n].repartition(tasks, key) for n, key in (keys or {}).items()}
    return spark.sql(sql, **(read | {n: df.hint("merge") if n == merged else df for n, df in dealt.items()}))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, FILES)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks, by album. Rows of few bytes take many times these in sorts and hash maps, so by bytes a task would
    get too many: of many line items, tasks are as many as their rows ask for, and the line items follow the tables
    that they are joined with. Orders are merged, never sent to tasks: what works on albums then finds the line items
    dealt out by album into these tasks, and no task by bytes."""
    tasks = ceil(spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() / ROWS)
    if tasks <= spark.sparkContext.defaultParallelism:
        return _run(spark, sf_dir, TRACKS)
    return _run(spark, sf_dir, TRACKS, max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), {"part": "p_partkey", "orders": "o_orderkey"}, "orders")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, CANDIDATES)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, LISTING)
