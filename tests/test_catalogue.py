"""Operators on small frames: nulls, blanks, ties, and the properties that keyed changes must have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fonoteca import schema
from fonoteca.operators import audits, browse, console, groups, match, merge, reports, stats
from fonoteca.plans import paths
from fonoteca.sources import readers
from fonoteca.streaming import stream

FILES = "path string, artist string, albumartist string, album string, title string, label string, year string, genre string, track_number string, status string, codec string, lossless int, bit_depth int, has_embedded_art int, has_folder_art int, transcode_suspected int, transcode_confidence double, transcode_notes string, comment string, duration_seconds double, size_bytes long, content_hash string, organised_path string, catalog_number string"


def file(path, **given):
    row = dict.fromkeys(x.split()[0] for x in FILES.split(", "))
    row |= {"path": path, "artist": "A", "album": "B", "title": "T", "label": "L", "year": "1999", "status": "indexed", "codec": "flac", "lossless": 1, "size_bytes": 10} | given
    return tuple(row.values())


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        file("/a/1.flac", artist=None),
        file("/a/2.flac", artist="  ", has_embedded_art=0, has_folder_art=0),
        file("/a/3.flac", artist="Unknown Artist", has_embedded_art=1),
        file("/a/4.flac", title="01 - x", year="0000", status="broken"),
        file("/a/5.flac", title="01 - x\ny", year="19a2"),
        file("/a/6.flac", title="2 - x", year=None, status=None),
        file("/a/7.flac", title="\t", label="", transcode_suspected=1, transcode_confidence=0.9, transcode_notes="cut"),
        file("/a/8.flac", transcode_suspected=1, transcode_notes="vamp:lossy:0.99", status="quarantined"),
    ]
    return spark.createDataFrame(rows, FILES)


def found(df, column="path"):
    return sorted(r[column] for r in df.collect())


def test_audits(files):
    hits = {k: [p[3] for p in found(audits.audit(files, k))] for k in audits.AUDITS}
    assert hits["missing_artist"] == ["1", "2"] and hits["unknown_artist_literal"] == ["3"]
    assert hits["track_no_in_title"] == ["5"] and hits["odd_year"] == ["5"]
    assert hits["missing_embedded_art"] == ["2"] and hits["missing_label"] == ["7"] and hits["missing_title"] == []
    assert hits["suspected_transcode"] == ["7", "8"]
    long = audits.audit_all(files)
    assert {(r["audit_key"], r["path"][3]) for r in long.collect()} == {(k, p) for k, v in hits.items() for p in v}
    assert {r["audit_key"]: r["n"] for r in audits.summary(files).collect()} == {k: len(v) for k, v in hits.items()}
    assert [r["path"] for r in audits.ordered(files, "suspected_transcode").collect()] == ["/a/7.flac", "/a/8.flac"]
    with pytest.raises(ValueError):
        audits.P.missing_tag("bpm")


def test_counts(files):
    assert stats.total(files).first()["n"] == 8
    assert {r["status"]: r["n"] for r in stats.status_histogram(files).collect()} == {"indexed": 5, "broken": 1, "unknown": 1, "quarantined": 1}
    row = audits.broken_counts(files).first()
    assert row["missing_artist"] == 2 and row["placeholder_artist"] == 1 and row["suspected"] == 2


MAJORITIES = [(["W"] * 8 + [None] * 2, "W"), (["W"] * 7 + ["R"] * 3, "W"), (["W"] * 5 + ["R"] * 5, "R"), ([None, "", " ", "n/a"], None), (["Unknown"] + ["x"], "x")]


@pytest.mark.parametrize("labels,want", MAJORITIES)
def test_majority(spark, labels, want):
    df = spark.createDataFrame([file(f"/a/{i}.flac", label=v) for i, v in enumerate(labels)], FILES)
    got = groups.majority(df.repartition(3), ["album"], "label").collect()
    assert ([r["value"] for r in got] or [None]) == [want]
    assert groups.album_label(df, ["album"]).first()["label"] == (want or "Unknown Label")


def test_reconcile_is_idempotent(spark):
    df = spark.createDataFrame([file(f"/a/{i}.flac", label=v) for i, v in enumerate(["W", "W", "", None, "R"])] + [file("/b/1.flac", label=None)], FILES)
    fixes = groups.reconcile(df, "label")
    assert {(r["path"], r["new"]) for r in fixes.collect()} == {("/a/2.flac", "W"), ("/a/3.flac", "W")}
    assert groups.reconcile(df, "label", resolve_conflicts=False).count() == 0
    after = df.join(fixes.select("path", "new"), "path", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
    assert groups.reconcile(after, "label").count() == 0
    assert found(groups.reconcile(df, "label", only_missing=False)) == ["/a/2.flac", "/a/3.flac", "/a/4.flac"]


def test_album_types(spark):
    rows = [("solo", "x", None), ("solo", "x", None), ("solo", "y", None), ("half", "x", None), ("half", "y", None), ("tag", "x", "Various Artists"), ("tag", "x", None), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, artist string, albumartist string")
    assert {r["k"]: r["album_type"] for r in groups.album_type(df, "k").collect()} == {"solo": "solo", "half": "mix", "tag": "mix", "none": "solo"}


def test_album_classes(spark):
    rows = [file(f"/v/{i}.flac", album="V", artist=f"A{i}") for i in range(6)] + [file(f"/s/{i}.flac", album="S") for i in range(3)]
    rows += [file("/u/1.flac", album="U [bootleg]"), file("/d/1.flac", album="D", duration_seconds=4000.0), file("/w/1.flac", album="W", albumartist="various artists"), file("/b/1.flac", album="Best of X", albumartist="dj foo")]
    got = {r["album"][0]: (r["kind"], r["confidence"], r["album_artist"]) for r in groups.classify_albums(spark.createDataFrame(rows, FILES), ["album"]).collect()}
    assert got["V"][0] == "mix" and got["S"] == ("solo", 0.5, "") and got["U"][0] == "unofficial" and got["D"] == ("dj_set", 0.8, "")
    assert got["W"] == ("mix", 0.95, "Various Artists") and got["B"] == ("mix", 0.85, "Dj Foo")


def test_mark_broken(spark):
    rows = [
        file("/1", artist=None),
        file("/2", artist=None, status="duplicate"),
        file("/3", status="broken"),
        file("/4", status="broken", comment="Copy error: x"),
        file("/5", artist=None, status="quarantined"),
        file("/6"),
        file("/7", title="untitled", status=None),
    ]
    got = {r["path"]: r["new_status"] for r in groups.mark_broken(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {"/1": "broken", "/3": "ok", "/7": "broken"}


def test_duplicates_keep_the_first(spark):
    df = spark.createDataFrame([file("/2", content_hash="h"), file("/1", content_hash="h"), file("/3", content_hash="h"), file("/4"), file("/5")], FILES)
    assert {(r["path"], r["duplicate_of"]) for r in groups.duplicates(df).collect()} == {("/2", "/1"), ("/3", "/1")}


@pytest.mark.parametrize("a,c,n,o,kind", [(3, 0, 9, 9, "music"), (0, 5, 2, 1, "random_crap"), (0, 9, 1, 1, "empty_or_trivial"), (1, 0, 2, 0, "orphan_bonus"), (2, 9, 1, 5, "music")])
def test_folder_kinds(spark, a, c, n, o, kind):
    df = spark.createDataFrame([("f", a, c, n, o)], "folder string, n_audio int, n_companion int, n_non_music int, n_other int")
    assert groups.folder_kind(df).first()["kind"] == kind


def test_self_release(spark):
    rows = [file("/1", album="x", label="Not On Label"), file("/2", album="y", label="Björk", artist="bjork"), file("/3", album="z", label="Warp"), file("/4", album="w", label=None)]
    got = {r["album"]: r["self_released"] for r in groups.self_release(spark.createDataFrame(rows, FILES), ["album"]).collect()}
    assert got == {"x": True, "y": True, "z": False, "w": False}


GATES = [([], None), ([79.9], "low"), ([80.0], "confident"), ([95.2, 93.5], "ambiguous"), ([96.4, 80.0], "confident"), ([90.0, 90.0], "ambiguous")]


@pytest.mark.parametrize("scores,want", GATES)
def test_gate(spark, scores, want):
    df = spark.createDataFrame([(1, "p", s, i) for i, s in enumerate(scores)], "k int, provider string, score double, ord long")
    got = [r["verdict"] for r in match.confidence_gate(df, "k").collect()]
    assert got == ([want] if want else [])


@pytest.mark.parametrize("values,want", [([128, 127, 128], 128), ([120, 150], 135), ([1, 1, 2, 2], 1), ([], None), ([0], 0), ([None, 7], 7)])
def test_consensus(spark, values, want):
    df = spark.createDataFrame([(1, v) for v in values], "k int, v int")
    assert [r["consensus"] for r in match.consensus(df, "k", "v").collect()] == ([want] if want is not None else [])


def test_best_values_break_ties_by_order(spark):
    rows = [(1, "a", 90.0, 1, "X", ""), (1, "b", 90.0, 2, "Y", "1990"), (1, "c", 10.0, 3, "", "1991")]
    df = spark.createDataFrame(rows, "k int, provider string, score double, ord long, label string, year string").repartition(3)
    row = match.merged(df, "k", ["label", "year"]).first()
    assert (row["label"], row["year"], row["ids"]) == ("X", "1990", {"a": 1, "b": 2, "c": 3})


def test_upsert(spark):
    old = spark.createDataFrame([("a", "x", "o1", "t0"), ("b", "y", None, "t0")], "path string, title string, original_path string, last_seen string")
    new = spark.createDataFrame([("a", None, "o9"), ("b", "z", "o2"), ("c", "w", "o3")], "path string, title string, original_path string")
    once = merge.upsert(old, new, "path", now="t1")
    rows = {r["path"]: tuple(r)[1:] for r in once.collect()}
    assert rows == {"a": (None, "o1", "t1"), "b": ("z", "o2", "t1"), "c": ("w", "o3", "t1")}
    assert sorted(map(tuple, merge.upsert(once, new, "path", now="t1").collect())) == sorted(map(tuple, once.collect()))


def test_commit_rekey_delete_changes(spark):
    lib = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size_bytes long")
    ses = spark.createDataFrame([(None, "b"), (3, "c")], "size_bytes long, path string")
    assert sorted(map(tuple, merge.commit(lib, ses, "path").collect()), key=str) == [("a", 1), ("b", None), ("c", 3)]
    assert tuple(merge.commit_counts(lib, ses, "path").first()) == (2, 3, 1)
    moves = spark.createDataFrame([("a", "b")], "old_key string, new_key string")
    assert list(map(tuple, merge.rekey(lib, moves, "path").collect())) == [("b", 1)]
    assert found(merge.delete(lib, ses, "path")) == ["a"]
    listing = spark.createDataFrame([("a", 1), ("b", 5), ("n", 1)], "path string, size_bytes long")
    assert {r["path"]: r["change"] for r in merge.changes(lib, listing).collect()} == {"a": "unchanged", "b": "refreshed", "n": "new"}


def test_browse(files):
    assert found(browse.filtered(files, browse.Filters(text="unknown"))) == ["/a/3.flac"]
    assert browse.page(files, browse.Filters(), 2, 3).count() == 3 and browse.pages(0, 50) == 1 and browse.pages(101, 50) == 3
    assert browse.described(browse.Filters(artist="x")) == "artist='x'"
    plan = browse.top(files, browse.Filters())._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE f",
        "INSERT INTO f VALUES (1)",
        "WITH t AS (SELECT 1) DELETE FROM f",
        "WITH t AS (SELECT 1 AS a) INSERT INTO f SELECT * FROM t",
        "",
        "SET x = 1",
        "CREATE TABLE t AS SELECT 1",
        "SELECT 1; DROP TABLE f",
    ],
)
def test_console_refuses(spark, sql):
    with pytest.raises(Exception):
        console.query(spark, sql, {})


def test_console_runs_queries(spark, files):
    sql = "WITH t AS (SELECT codec, count(*) AS n FROM files GROUP BY ROLLUP (codec) HAVING count(*) > 0) SELECT * FROM t WHERE n IN (SELECT max(n) FROM t) ORDER BY n"
    assert console.query(spark, sql, {"files": files}).count() == 2
    assert console.query(spark, "SELECT * FROM range(1000)", {}).count() == 500


def test_plans(spark):
    rows = [
        file("/in/1.flac", title="Song (Live)", track_number="1/9", album_type="x") if False else file("/in/1.flac", title="Song (Live)", track_number="1/9"),
        file("/in/2.flac", title="Song (Live)", track_number="1"),
        file("/in/3.flac", artist=""),
        file("/in/4.flac", status="broken", title="AC/DC"),
    ]
    df = spark.createDataFrame(rows, FILES)
    named = {r["path"]: r["target"] for r in paths.rename_plan(df, ripped_by="me").collect()}
    assert named["/in/1.flac"] == "/in/✰ [ 01. A - Song - (Live) - B - 1999 - FLAC] Ripped By me.flac"
    assert named["/in/2.flac"].endswith(" (2).flac") and "/in/3.flac" not in named
    types = spark.createDataFrame([("B", "solo")], "album string, album_type string")
    moved = {r["path"]: r["target"] for r in paths.move_plan(df, types, "album", "/lib").collect()}
    assert moved["/in/1.flac"] == "/lib/1999 - A/album/01 - Song (Live).flac" and moved["/in/4.flac"] == "/lib/Broken/4.flac"
    assert moved["/in/2.flac"] == "/lib/1999 - A/album/01 - Song (Live) (2).flac"


def test_reports(files, tmp_path):
    for fmt in reports.FORMATS:
        reports.dump(audits.audit(files, "missing_artist"), str(tmp_path / fmt), fmt)
    assert files.sparkSession.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError):
        reports.dump(files, str(tmp_path / "x"), "xml")
    assert reports.dump_all(files, str(tmp_path / "all")).count() == len(audits.AUDITS)
    assert "#EXTINF:0,Unknown Artist - T" in [r["entry"].split("\n")[0] for r in reports.playlist(files).collect()]


def test_readers(spark, tmp_path):
    (tmp_path / "al" / ".h").mkdir(parents=True)
    (tmp_path / "al" / "a.flac").write_bytes(b"x" * 10)
    (tmp_path / "al" / "cover.jpg").write_bytes(b"y")
    (tmp_path / "al" / ".h" / "z.mp3").write_bytes(b"z")
    (tmp_path / "al" / "a.cue").write_text('PERFORMER "P"\nTITLE "T"\nFILE "a.flac" WAVE\n')
    (tmp_path / "al" / "b.cue").write_text('FILE "gone.flac" WAVE\n')
    listing = readers.listing(spark, str(tmp_path))
    assert found(listing, "name") == ["a.cue", "a.flac", "b.cue", "cover.jpg"]
    assert readers.audio_folders(listing).first()["n_files"] == 1
    assert found(readers.extras(listing, only=(".jpg",)), "name") == ["cover.jpg"]
    cues = readers.read_cue_sheets(spark, str(tmp_path))
    assert {(r["audio_filename"], r["performer"]) for r in cues.collect()} == {("a.flac", "P"), ("gone.flac", "")}
    assert found(readers.orphan_cues(cues, listing))[0].endswith("b.cue")
    import hashlib

    hashes = {r["path"].rsplit("/", 1)[1]: r["content_hash"] for r in readers.hashed(spark, str(tmp_path)).collect()}
    assert hashes["a.flac"] == hashlib.sha1(b"10" + b"x" * 10).hexdigest()
    raw = spark.createDataFrame([("p", {"TPE1": " A ", "title": "", "TIT2": "T"})], "path string, tags map<string,string>")
    row = readers.resolved_tags(raw).first()
    assert (row["artist"], row["title"], row["album"]) == ("A", "T", None)


def test_stream_upserts_and_resumes(spark, tmp_path):
    kind = "path string, title string, seen int"
    src, table, ckpt = (str(tmp_path / x) for x in ("in", "table", "ckpt"))
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], kind).write.parquet(src)
    run = lambda: stream.merged_into(stream.arrivals(spark, src, spark.createDataFrame([], kind).schema), table, "path", "seen", ckpt).awaitTermination()
    run()
    spark.createDataFrame([("a", "2", 2), ("c", "1", 1)], kind).write.mode("append").parquet(src)
    run()
    assert {(r["path"], r["title"]) for r in stream.current(spark, table).collect()} == {("a", "2"), ("b", "1"), ("c", "1")}


def test_stream_first_seen(spark, tmp_path):
    rows = [("h", "2024-01-01 00:00:00", 1), ("h", "2024-01-01 00:01:00", 2), ("g", "2024-01-01 00:02:00", 3)]
    spark.createDataFrame(rows, "content_hash string, t string, i int").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = stream.arrivals(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = stream.first_seen(s, "t").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r["content_hash"] for r in spark.table("firsts").collect()) == ["g", "h"]


def test_eta_and_schema(spark):
    assert match.eta(60, {"a": 1.0, "b": 3.0}) == {"best": 1.0, "likely": 0.6 + 1.6, "worst": 8.0}
    df = schema.conformed(spark.createDataFrame([("5", "1", "x")], "size_bytes string, lossless string, extra string"), ("size_bytes", "lossless"))
    assert dict(df.dtypes) == {"size_bytes": "bigint", "lossless": "int"}


def test_fuzzy_match_loses_no_pair(spark):
    """Against all pairs, for short, long and repeated names and for thresholds with and without the longer grams."""
    import difflib
    import random

    own = random.Random(2)
    word = lambda: "".join(own.choice("abcde") for _ in range(own.randint(1, 6)))
    names = [" ".join(word() for _ in range(own.randint(1, 7))) for _ in range(120)]
    for name in names[:60]:
        chars = list(name)
        for _ in range(own.randint(1, 3)):
            chars[own.randrange(len(chars))] = own.choice("abcde ")
        names.append("".join(chars))
    names += [names[0], names[0].upper(), "é" + names[3], "", None]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    keyed = {r["id"]: r["k"] for r in df.select("id", match.match_key("name").alias("k")).collect()}
    for least in (0.95, 0.9, 0.7):
        got = {(r["query_id"], r["candidate"], r["n"], r["similarity"]) for r in match.fuzzy(df.where("id % 2 = 0"), df, "name", least).collect()}
        counts = {}
        for k in keyed.values():
            counts[k] = counts.get(k, 0) + 1
        score = lambda a, b: 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
        want = {(i, k, n, round(s, 6)) for i, a in keyed.items() if i % 2 == 0 and a for k, n in counts.items() if k and (s := round(score(a, k), 6)) >= least}
        assert got == want, least


def test_plans_of_names_stay_small(spark):
    """A name is built from nested parts; each is bound once, so the plan does not multiply them."""
    files = spark.createDataFrame([("/a/b.flac", *[None] * 6)], "path string, artist string, title string, album string, year string, track_number string, codec string")
    plan = paths.rename_plan(files)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000, len(plan)
