from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fonoteca.llm import common, decontaminate, quality
from fonoteca.llm.common import materialise, read

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = read(spark, SF, "documents")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF))
        assert docs.columns == names, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_stages_match_brute_force(spark):
    """Scores of all documents, and every document against every item, decide alike."""
    docs = read(spark, SF, "documents")
    model = quality.fit(docs, read(spark, SF, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = dict(zip(texts, model.score([quality.features(t.encode()) for t in texts.values()])))
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= quality.ACCEPT}
    block = decontaminate.Block([(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()])
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, SF)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in texts.items() if not block.find(t)}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty and a long text, repeated rows and ids, and columns named as those that operators add."""
    own = random.Random(4)
    word = lambda: "".join(own.choice("aeiourstln") for _ in range(own.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").limit(8).collect()]
    rows = [(i, t, "en", "a", 1, "x", "x", "x") for i, t in enumerate(good)]
    rows += [(0, good[0], "en", "a", 1, "x", "x", "x"), (None, good[1], None, None, None, None, None, None), (None, good[2] + " more", None, None, None, None, None, None)]
    rows += [(20, None, None, None, None, None, None, None), (21, "", None, None, None, None, None, None), (22, prose(60_000), "en", "b", 1, "x", "x", "x"), (1, good[3], "en", "b", 1, "x", "x", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, __hits string").repartition(3)


def test_stages_take_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, odd.where("false"), SF)
        assert empty.columns == odd.columns and empty.count() == 0, name
        docs = materialise(stage(spark, docs, SF))
        assert docs.columns == odd.columns and docs.count() > 0, name
        if name == "minhash near-dedup":
            assert max(Counter(r["text"] for r in docs.where("length(text) > 0").collect()).values()) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, odd.where("false"), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).agg(F.sum("length")).first()[0] > 0


def test_near_dedup_keeps_rows_of_null_ids(spark, odd):
    """A null id is no reason to go: of each group of copies one row stays, whatever the ids."""
    kept = corpus_pipeline.minhash_near_dedup(spark, odd, SF).collect()
    texts = {r["text"] for r in odd.collect() if r["text"]}
    assert len([r for r in kept if r["text"]]) == len(texts) - 1  # the text with one more word is a near copy


def test_run_leaves_only_what_the_result_needs(spark):
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    common.sweep(spark)
    before = len(list(folder.glob("table-*")))
    corpus_pipeline.run(spark, SF).collect()
    assert len(list(folder.glob("table-*"))) - before <= 7
    common.sweep(spark)
    assert len(list(folder.glob("table-*"))) == before


@pytest.mark.parametrize("named", [("__text", "__score", "__predicted"), ("__tkey", "__key", "__id"), ("__k1", "__k2", "k1"), ("__kinds", "__spans", "others"), ("uid", "a.b", "tick`s")])
def test_stages_take_columns_of_any_name(spark, named):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(["password = abcdefgh12345678 " + "some words of a text that goes on " * 20, "other words " * 40, "other words " * 40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in named})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got.collect() for c in named), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 3
