"""Free names, averages by time, look-ups, providers, streams, kept counts, statistics, origins: against plain Python."""

from __future__ import annotations

import json
import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fonoteca import tables
from fonoteca.functions import detection, origin, text, udfs
from fonoteca.operators import counts, merge, naming, scans, signals
from fonoteca.sources import lookups, providers, readers
from fonoteca.streaming import stream


def leaves(plan):
    """The leaf nodes of an executed plan, those of adaptive stages included."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return leaves(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return leaves(plan.plan())
    below = plan.children()
    return [x for i in range(below.size()) for x in leaves(below.apply(i))] or [plan]


def rows_scanned(df) -> int:
    df.collect()
    return sum(x.metrics().apply("numOutputRows").value() for x in leaves(df._jdf.queryExecution().executedPlan()) if "Scan" in x.getClass().getSimpleName())


# Free names.
def named(spark, wanted, existing=()):
    plan = spark.createDataFrame([(f"p{i:03d}" if isinstance(w, str) or w is None else w[0], w if isinstance(w, str) or w is None else w[1]) for i, w in enumerate(wanted)], "path string, target string")
    return {r["path"]: r["target"] for r in naming.numbered(plan, "target", "path", spark.createDataFrame([(e,) for e in existing], "name string")).collect()}


def test_numbers_jump_over_names_that_are_wanted(spark):
    assert named(spark, ["/A.flac", "/A.flac", "/A (2).flac"]) == {"p000": "/A.flac", "p001": "/A (3).flac", "p002": "/A (2).flac"}


def test_numbers_jump_over_names_that_exist(spark):
    got = named(spark, ["/A.flac"] * 4, ["/A.flac", "/A (2).flac", "/A (4).flac", "/A (03).flac", "/A (5).mp3"])
    assert [got[k] for k in sorted(got)] == ["/A (3).flac", "/A (5).flac", "/A (6).flac", "/A (7).flac"]


def test_names_kept_and_missing(spark):
    got = named(spark, [("/A", "/A"), "/A", None, "/.hidden", "/.hidden", "/d.x/B", "/d.x/B"])
    assert got == {"/A": "/A", "p001": "/A (2)", "p002": None, "p003": "/.hidden", "p004": "/.hidden (2)", "p005": "/d.x/B", "p006": "/d.x/B (2)"}
    assert named(spark, []) == {}


@pytest.mark.parametrize("bucket", [1 << 16, 3])
def test_names_are_unique_in_buckets_of_any_size(spark, monkeypatch, bucket):
    monkeypatch.setattr(naming, "BUCKET", bucket)
    pick = random.Random(bucket)
    names = ["/A.flac", "/A (2).flac", "/A (7).flac", "/B", "/B (2) (2)", "/B (2)"]
    wanted = [pick.choice(names[:1] * 6 + names) for _ in range(60)]
    existing = ["/A (3).flac", "/A (5).flac", "/A (6).flac", "/B", *(f"/A ({i}).flac" for i in range(20, 40))]
    got = named(spark, wanted, existing)
    assert len(set(got.values())) == len(wanted) and not set(got.values()) & set(existing)
    for i, w in enumerate(wanted):
        stem, dot, ext = w.rpartition(".") if "." in w else (w, "", "")
        assert got[f"p{i:03d}"] == w or re.fullmatch(re.escape(stem) + r" \(\d+\)" + re.escape(dot + ext), got[f"p{i:03d}"])
    # No number is left out: each is taken by someone.
    numbers = sorted(int(re.fullmatch(r"/A \((\d+)\)\.flac", x)[1]) for x in {*got.values(), *existing} if re.fullmatch(r"/A \(\d+\)\.flac", x))
    assert numbers[: wanted.count("/A.flac")] == list(range(2, 2 + wanted.count("/A.flac")))


# Averages.
def test_average_by_elapsed_time_is_that_of_a_loop(spark):
    pick, tau = random.Random(5), 10.0
    rows = [(pick.choice(["a", "b"]), t, pick.uniform(-5, 1000), i) for i, t in enumerate(sorted([pick.uniform(0, 40) for _ in range(60)] + [pick.uniform(5000, 90000) for _ in range(60)] + [1e6, 1e6, 1e6 + 449, 1e6 + 501]))]
    want, state = {}, {}
    for k, t, x, i in rows:
        if k in state:
            before, y = state[k]
            alpha = 1 - math.exp(-(t - before) / tau)
            y = alpha * x + (1 - alpha) * y
        else:
            y = x
        state[k], want[i] = (t, y), y
    odd = [(None, 1.0, 1.0, -1), ("a", None, 1.0, -2), ("a", 1.0, None, -3)]
    df = spark.createDataFrame(rows + odd, "k string, t double, x double, i int")
    got = {r["i"]: r["smoothed"] for r in scans.decayed(df, "k", "t", "x", tau, "i").collect()}
    assert all(got[i] is None for i in (-1, -2, -3)) and len(got) == len(rows) + 3
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)


def test_running_sums_do_not_depend_on_buckets(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id"), (F.col("id") % 7).alias("w"))
    whole = {r["id"]: r["s"] for r in scans.running_sum(df, ["k"], F.lit(0), F.col("w"), ["id"], "s").collect()}
    parts = {r["id"]: r["s"] for r in scans.running_sum(df, ["k"], F.expr("id div 8"), F.col("w"), ["id"], "s").collect()}
    assert whole == parts == {i: sum(j % 7 for j in range(i + 1) if j % 3 == i % 3) for i in range(200)}


# Look-ups.
def test_look_up_skips_what_the_keys_cannot_be_in(spark):
    df = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("h"), "id")
    path = tables.new_path(spark)
    lookups.lay_out(df, path, "h", n_files=4, rows_a_page=100)
    keys = df.where("id % 2000 = 0").select("h").union(spark.createDataFrame([("no such",), (None,)], "h string"))
    assert sorted(r["id"] for r in lookups.look_up(spark, path, "h", keys).collect()) == list(range(0, 20000, 2000))
    assert sorted(r["id"] for r in lookups.look_up(spark, path, "h", keys, ["id"], most=3).collect()) == list(range(0, 20000, 2000))
    with lookups._pushed_lists(spark, 100):
        assert rows_scanned(lookups.wanted(spark.read.parquet(path), "h", keys)) <= 20000 * 0.2


def test_long_lists_of_keys_do_not_overflow_the_scan(spark):
    df = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("h"), "id")
    path = tables.new_path(spark)
    lookups.lay_out(df, path, "h", n_files=2)
    for n in (lookups.PIECE - 1, lookups.PIECE, lookups.PIECE + 1, 3 * lookups.PIECE, 9000):
        assert sorted(r["id"] for r in lookups.look_up(spark, path, "h", df.where(f"id < {n}"), ["id"]).collect()) == list(range(n))
    assert lookups.look_up(spark, path, "h", df.where("id < 0")).isEmpty()


# Providers.
def test_providers_get_the_filters(spark):
    rows = [("discogs", 1, "A", "One", 90.0, 1, "x", "1999"), ("deezer", 1, "A", "One", 70.0, 2, "y", "1999"), ("itunes", 2, "B", "Two", 95.0, 3, None, None), (None, 3, "C", "Three", 1.0, 4, "", "")]
    index = tables.new_path(spark)
    providers.write_index(spark.createDataFrame(rows, providers.SCHEMA), index)
    providers.register(spark)
    known = spark.read.format("providers").option("path", index).load()
    assert {r["ord"] for r in known.collect()} == {1, 2, 3}
    some = known.where("provider IN ('discogs', 'deezer') AND score >= 80 AND album_id = 1")
    assert [r["ord"] for r in some.collect()] == [1]
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    pushed = re.search(r"PushedFilters: \[(.*?)\]\n", plan)[1]
    assert "provider" in pushed and "score" in pushed and "album_id" in pushed
    reader = providers.IndexReader(index, ["discogs", "itunes"], ["provider", "score"])
    assert list(reader.pushFilters([providers.EqualTo(("provider",), "itunes"), providers.GreaterThanOrEqual(("score",), 1.0)])) == [] and [p.provider for p in reader.partitions()] == ["itunes"]
    asked = providers.asked(spark, index, spark.createDataFrame([(1, "A", "One"), (2, "B", "Unknown Album")], "album_id long, artist string, album string"), ["discogs", "itunes"])
    assert [r["ord"] for r in asked.collect()] == [1]
    assert [r[0] for r in spark.createDataFrame([("discogs",), ("acoustid",), ("else",)], "p string").select(providers.provider_order("p")).collect()] == [0, 5, 6]


# Streams.
def test_a_stream_started_again_emits_changes_only(spark):
    schema = "path string, size_bytes long, mtime double"
    drop, checkpoint, out = (tables.new_path(spark) for _ in range(3))
    catalogue = spark.createDataFrame([("a", 1, 10.0), ("b", 2, 10.0), ("n", 1, None)], schema)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(drop)
        with stream.state_store(spark):
            changed = stream.changed_only(spark.readStream.schema(schema).parquet(drop), catalogue)
            changed.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"], r["change"]) for r in spark.read.parquet(out).collect())

    first = run([("a", 1, 10.5), ("b", 3, 10.0), ("c", 5, 1.0), ("n", 1, 1.0), ("d", None, None)])
    assert first == [("b", "refreshed"), ("c", "new"), ("d", "new"), ("n", "refreshed")]
    batch = {r["path"]: r["change"] for r in merge.changes(catalogue.where("path < 'n'"), spark.createDataFrame([("a", 1, 10.5), ("b", 3, 10.0), ("c", 5, 1.0)], schema)).collect()}
    assert {p: c for p, c in batch.items() if c != "unchanged"} == {p: c for p, c in first if p in batch}
    again = run([("b", 3, 10.2), ("c", 5, 9.0), ("e", 1, 1.0)])
    assert again == sorted(first + [("c", "refreshed"), ("e", "new")])


def test_a_bucket_of_paths_is_one_read_and_one_write_of_state():
    calls, kept, clock = [], {}, [0]

    class State:
        get = staticmethod(lambda: (calls.append("get"), kept.get("v"))[1])
        update = staticmethod(lambda v: (calls.append("update"), kept.update(v=v)))

    class Handle:
        getValueState = staticmethod(lambda *args: State)

    class Times:
        getCurrentProcessingTimeInMs = staticmethod(lambda: clock[0])

    def run(paths, mtime, keep_ms=None):
        taker = stream.Changed(1.0, keep_ms)
        taker.init(Handle)
        part = pd.DataFrame({"path": paths, "size_bytes": 1, "mtime": mtime})
        return [r for out in taker.handleInputRows((3,), iter([part[:400], part[400:]]), Times) for r in out.itertuples(index=False)]

    paths = [*(f"p{i}" for i in range(999)), None]
    assert [r.change for r in run(paths, 1.0)] == ["new"] * 1000 and calls == ["get", "update"]
    assert run(paths, 1.9) == [] and calls[2:] == ["get"]
    assert [(r.path, r.change) for r in run([None, "p7", "p7", "q"], 2.0)] == [(None, "refreshed"), ("p7", "refreshed"), ("q", "new")]
    kept.clear()
    run(["a", "b"], 1.0, keep_ms=100)
    clock[0] = 60
    run(["b"], 9.0, keep_ms=100)
    clock[0] = 120
    assert [(r.path, r.change) for r in run(["a", "b"], 9.0, keep_ms=100)] == [("a", "new")]


# Kept counts.
def test_counts_kept_equal_counts_made_after_each_change(spark):
    rows = [(f"r{i % 4}", f"/r{i % 4}/{i % 6}", f"{i}.{['flac', 'mp3', 'jpg'][i % 3]}") for i in range(60)]
    frame = lambda x: spark.createDataFrame(x, "root string, folder string, name string")
    roots = lambda times: spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(times)], "root string, mtime double")
    facts = lambda df: {r["root"]: (r["file_count"], r["folder_count"]) for r in df.collect()}
    cache = counts.refreshed(spark.createDataFrame([], "root string, mtime double, cached_at double, file_count long, folder_count long"), roots([1.0] * 4), frame(rows), 100.0)
    times = [1.0] * 4
    for step, root in enumerate((2, 0, 3)):
        cache = tables.written(cache)
        rows = rows + [(f"r{root}", f"/r{root}/new{step}", "x.flac")]
        times[root] += 1
        path = tables.new_path(spark)
        frame(rows).write.partitionBy("root").parquet(path)
        listing = spark.read.parquet(path)
        assert [r["root"] for r in counts.stale(cache, roots(times), 200.0 + step).collect()] == [f"r{root}"]
        cache = counts.refreshed(cache, roots(times), listing, 200.0 + step)
        assert facts(cache) == facts(counts.counted(frame(rows)))
    cache = tables.written(cache)
    assert rows_scanned(lookups.wanted(listing, "root", counts.stale(cache, roots([9.0, *times[1:]]), 300.0))) == sum(r[0] == "r0" for r in rows)
    assert counts.stale(cache, roots([t + 0.05 for t in times]), 300.0).isEmpty()
    assert counts.stale(cache, roots(times), 300.0 + counts.GOOD_FOR).count() == 4


def test_statistics_change_a_join(spark):
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled", "spark.sql.cbo.planStats.enabled", "spark.sql.statistics.histogram.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "20000")
        for t in ("left_files", "right_files"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
            spark.range(30000).select("id", F.md5(F.col("id").cast("string")).alias("h")).write.option("path", tables.new_path(spark)).saveAsTable(t)
        plan = lambda: spark.sql("SELECT * FROM left_files l JOIN right_files r ON l.id = r.id WHERE r.id < 20")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan()
        for t in ("left_files", "right_files"):
            merge.analysed(spark, t, "id", "h")
        assert "BroadcastHashJoin" in plan()
    finally:
        for t in ("left_files", "right_files"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
        for n, v in before.items():
            spark.conf.set(n, v)


# Origins.
def ripped(spark, vendor, tags):
    row = spark.createDataFrame([(vendor, tags)], "vendor string, tags map<string,string>").select(origin.identify_ripper("vendor", F.col("tags")).alias("r")).first()["r"]
    return row["tool"], row["confidence"], row["evidence"]


def test_identify_ripper(spark):
    assert ripped(spark, None, None) == ("", "", [])
    assert ripped(spark, "reference libFLAC 1.3", {"CueSheet": "x"}) == ("(libFLAC-based ripper)", "low", ["vendor: reference libFLAC 1.3", "tag 'cuesheet' present (→ CUE-based ripper)"])
    assert ripped(spark, "reference libFLAC", {"EncoderComment": "x", "Encoder": "Whipper 1"}) == ("Whipper", "high", ["vendor: reference libFLAC", "tag 'encodercomment' present (→ EAC (possibly))", "encoder: Whipper 1"])
    assert ripped(spark, "XLD", {"ENCODER": "foobar2000"})[:2] == ("XLD", "high")
    assert ripped(spark, "what", {"ENCODER": ""}) == ("", "", ["vendor: what"])


def found(spark, codec="flac", bits=24, rate=96000, tool="", samples=5000, share=0.1, **how):
    df = spark.createDataFrame([(codec, bits, rate, (tool, "high" if tool else ""), samples, share)], "codec string, bits int, rate int, r struct<tool:string,confidence:string>, samples int, share double")
    a = df.select(origin.audio_findings("codec", "bits", "rate", F.col("r"), "samples", "share", **how).alias("a")).first()["a"]
    return a["skip_reason"], a["fake_hires"], [(f["code"], f["level"], f["text"]) for f in a["findings"]]


def test_audio_findings(spark):
    hires = ("hires_claim", "info", "24-bit 96.0 kHz — claims hi-resolution audio (verify with deep analysis)")
    unread = "couldn't read header (corrupt or unsupported format?)"
    assert found(spark, codec=None) == (unread, False, [("unreadable", "warn", unread)])
    assert found(spark, bits=16, rate=44100) == ("", False, [("cd_format", "info", "16-bit 44.1 kHz — standard CD format")])
    assert found(spark, deep=False) == ("deep analysis disabled (header-only mode)", False, [hires])
    assert found(spark, decoder=False) == ("ffmpeg not installed — header-only mode", False, [hires, ("no_ffmpeg", "warn", "install ffmpeg for spectral / sample-level analysis")])
    assert found(spark, tool="XLD", share=0.987)[1:] == (True, [hires, ("ripper_id", "info", "XLD (high confidence)"), ("fake_hires_lowbits", "alarm", "98.7% of samples have a zero low byte — bottom 8 bits are silent, file is 16-bit upsampled")])
    assert found(spark, share=0.5)[2][1] == ("bit_depth_check", "info", "50.0% zero low bytes — suspicious but inconclusive (could be quiet passages)")
    assert found(spark, rate=48000, samples=999)[2] == [("bit_depth_check", "info", "too little data decoded")]
    assert found(spark, bits=None, rate=None) == ("", False, [])


def test_rip_detection_by_tags(spark):
    def of(log, tags):
        r = spark.createDataFrame([(log, tags)], "log string, tags map<string,string>").select(origin.rip_detection("log", F.col("tags")).alias("r")).first()["r"]
        return r["software"], r["source"], round(r["confidence"], 6), r["lossless"], r["settings"]

    assert of("Exact Audio Copy V1.3 from 2016", {"encoder": "LAME 3.100"}) == ("Exact Audio Copy", "log_file", 0.95, True, "")
    assert of(None, {"vendor": "reference libFLAC 1.3.4", "encoder": "LAME 3.100"}) == ("libFLAC", "vendor_string", 0.8, True, "")
    assert of("", {"comment": "LAME 3.100", "tsse": "-V0"}) == ("LAME", "comment_tag", 0.6, False, "-V0")
    assert of("", {"tool": "SoX 14.4", "encodedby": ""}) == ("SoX", "tool_tag", 0.7, None, "")
    assert of("nothing", {}) == ("", "", 0.0, None, "")


def test_verdict_lines(spark):
    def of(t):
        v = spark.createDataFrame([(t,)], "t string").select(signals.verdict_line("t").alias("v")).first()["v"]
        return v["verdict"], v["confidence"]

    assert of("f,0,80,0.9,Lossy\nf,0,80,0.2,Original") == ("lossy", 0.9)
    assert of("head\r\n  f,0,80,x,Lossy\nf,0,80,0.2, Lossless ") == ("original", 0.8)
    assert of("f,0,80,1,none\nf,0,80,1,Lossy") == ("", 0.0)
    assert of("nothing") == of(None) == of("") == ("unknown", 0.0)


def test_tag_texts(spark):
    def plain(v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return "1" if v else "0"
        if isinstance(v, list):
            return "; ".join(plain(x) for x in v if x)
        return json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, dict) else str(v)

    values = [None, True, False, 0, 7, 1.5, 27.0, 1e-7, 1e20, "é; x", "", [], [1, "a", None, 0, "", False, True, [2, [], ["b", None]], {"b": 1, "a": ["ü"]}], {"z": {"y": None, "x": [True]}, "a": "é"}]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "i int, j string")
    got = {r["i"]: r["t"] for r in df.select("i", udfs.stringified(F.parse_json("j")).alias("t")).collect()}
    assert got == {i: plain(v) for i, v in enumerate(values)}


def test_fields_and_tag_names(spark):
    got = spark.range(1).select(text.by_importance(F.array(*map(F.lit, ("bpm=174", "zzz", "album", "acoustid_id", "aaa", "albumart")))).alias("f")).first()["f"]
    assert got == ["albumart", "album", "bpm=174", "aaa", "zzz", "acoustid_id"]
    tags = {"WM/AlbumTitle": "Album", "catalog#": "LAB 1", "©pub": "Label", "COMM::eng": "c", "TXXX:BPM": "120", "TPUB": " "}
    row = readers.resolved_tags(spark.createDataFrame([(tags,)], "tags map<string,string>")).first()
    assert (row["album"], row["catalog_number"], row["label"], row["comment"], row["bpm"], row["artist"]) == ("Album", "LAB 1", "Label", "c", "120", None)


def test_cutoff_notes(spark):
    df = spark.createDataFrame([(13999.5, 44100, -20.0), (20000.0, 44100, -20.0), (20000.0, 32000, -20.0), (21000.0, 96000, -20.0), (100.0, 44100, -95.0)], "c double, r int, m double")
    got = [tuple(r["v"]) for r in df.select(detection.cutoff_verdict("c", "r", "m").alias("v")).collect()]
    assert got == [
        (True, 0.95, "hard cutoff at 14000 Hz — likely MP3 ≤96 kbps source"),
        (True, 0.3, "borderline cutoff at 20000 Hz — possible 320 kbps source or band-limited master"),
        (False, 0.0, "cutoff at 20000 Hz (sample rate 32000 Hz)"),
        (False, 0.05, "cutoff at 21000 Hz — consistent with lossless"),
        (False, 0.0, "window too quiet for reliable analysis"),
    ]
