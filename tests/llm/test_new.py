"""Exact dedup, collocations and hard negatives on odd rows, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fonoteca.llm import exact, negatives, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)


# Exact dedup.
def brute_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = max(ids, default=None)
        out.append((i, hashlib.sha256((t or "").encode()).hexdigest(), keep, len(by[t or ""]), i == keep))
    return Counter(out)


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.length(t).cast("string"), lambda t: F.lit("same")])
def test_exact_groups(spark, monkeypatch, digest):
    monkeypatch.setattr(exact, "HOT_ROWS", 5)
    pick = random.Random(3)
    rows = [(i, pick.choice(["a", "b", "", None, "é", "é", "A", "a ", "x" * 300_000])) for i in range(120)] + [(500, "hot")] * 30 + [(None, "a"), (None, "only"), (None, "only")]
    df = docs_of(spark, [(i, t, "en") for i, t in rows]).repartition(7).withColumns({c: F.lit(9) for c in ("digest", "hot", "salt", "row", "keep_id", "n_texts", "t")})
    got = exact.groups(df, digest).collect()
    by_text = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    want = brute_groups(rows)
    if digest is exact.sha256:
        assert Counter(tuple(r) for r in got) == want and {r["digest"] for r in got} == by_text
    strip = lambda c: Counter((i, k, n, kept) for (i, _, k, n, kept), m in c.items() for _ in range(m))
    assert strip(Counter(tuple(r) for r in got)) == strip(want)


def test_exact_unique(spark):
    rows = [(1, "a", "en"), (2, "a", "en"), (2, "a", "en"), (None, "b", "en"), (None, "b", "en"), (3, None, None), (4, "", "de")]
    df = docs_of(spark, rows).withColumn("digest", F.lit("x"))
    got = exact.unique(df)
    assert got.columns == df.columns and sorted((r["doc_id"] or -1, r["text"]) for r in got.collect()) == [(-1, "b"), (2, "a"), (4, "")]
    assert exact.groups(docs_of(spark, [])).count() == 0 == exact.unique(docs_of(spark, [])).count()


# Collocations.
def brute_collocations(rows, least, most):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for t, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        common = {p: a for p, a in counts.items() if a >= least}
        inside = {p[i:j] for p in common for i in range(len(p)) for j in range(i + 1, len(p) + 1) if (i, j) != (0, len(p)) and common[p] >= counts[p[i:j]]}
        rows_of = []
        for p, a in common.items():
            if len(p) > 1 and p not in inside:
                s, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows_of.append((s, a, " ".join(p), l, r))
        rows_of.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows_of[:most])]
    return sorted(out)


def test_collocations(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 400)
    monkeypatch.setattr(phrases, "MERGED", 50)
    pick = random.Random(11)
    words = ["New", "york", "CITY", "é", "a", "a", "b c", "x-y", "'t"]
    text = lambda: "".join(pick.choice(words) + pick.choice([" ", "  ", "\t", ". ", ", ", "\n", " ", " ", "\x0b"]) for _ in range(pick.randrange(60)))
    rows = [(text(), pick.choice(["en", "en", "de", None])) for _ in range(150)] + [(None, "en"), ("", "xx"), (" .\n", "en"), ("new york city " * 500, "en"), ("a " * 3000, "de"), ("É É. É É\r" * 40, "fr")]
    df = spark.createDataFrame([(t, lang, 1, 2) for t, lang in rows], "text string, lang string, rank int, shard int").repartition(5)
    for least, most in ((20, 2000), (100, 3)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least, most).collect())
        assert got == brute_collocations(rows, least, most) and got
    assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r, n = 9 * 10**12, 9 * 10**12 + 7, 10**13 + 1, 3 * 10**15
    found = spark.createDataFrame([("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)], "lang string, phrase string, size int, f long")
    row = phrases.scored(found, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row["score"] == 1000 * a * n // (l * r)


@pytest.mark.parametrize("seed", range(3))
def test_intervals_of_a_suffix_array(seed):
    pick = np.random.default_rng(seed)
    tokens = np.append(pick.integers(0, 4, 400), 0).astype(np.int32)
    array = phrases.suffixes(tokens, 5)
    for n in range(1, 6):
        want = Counter(tuple(w) for i in range(len(tokens) - n + 1) if (w := tokens[i : i + n]).all())
        where, count = phrases.intervals(*array, n)
        assert {tuple(tokens[i : i + n]): c for i, c in zip(where, count)} == want


# Hard negatives.
def brute_negatives(rows, every=100, shift=7, labels=10, first=5):
    live = {}
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            y = (y + 1) % labels if i % shift == 0 else y
            live[i] = min(live.get(i, (99, ())), (y, tuple(int(np.floor(256 * float(x))) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in (i for i in live if i % every == 0):
        scored = sorted((-dot(live[a][1], v), i, y) for i, (y, v) in live.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == live[a][0]][:first]:
            fits = [(t, i) for t, i, y in scored if y != live[a][0] and 80 * -s <= 100 * -t <= 100 * -s][:first]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 2.0**14, 2.0**20])
def test_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(negatives, "ROWS", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    pick = np.random.default_rng(8)
    centres = pick.normal(size=(6, 5))
    rows = [(i, [float(x) for x in np.float32(scale * (centres[pick.integers(6)] + pick.normal(size=5) * 0.3))], int(pick.integers(3))) for i in range(700)]
    rows += [(700 + i, rows[5][1], i % 3) for i in range(60)]  # ties
    rows += [(1000, None, 1), (1100, [1.0, None, 1.0, 1.0, 1.0], 1), (1200, [1.0, float("nan"), 1.0, 1.0, 1.0], 1), (1300, [1.0, float("inf"), 0.0, 0.0, 0.0], 1), (1400, rows[1][1], None), (None, rows[1][1], 1)]
    rows += [(1500, [], 1), (1600, rows[3][1][:3], 2), (300, rows[300][1], rows[300][2]), (1700, [0.0] * 5, 1), (1800, rows[9][1], 77)]
    df = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id long, embedding array<float>, label int, q string").repartition(6)
    got = sorted(tuple(r) for r in negatives.mined(df).collect())
    assert got == brute_negatives(rows) and len(got) > 50


def test_negatives_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.8, 0.0], 2), (3, [-1.0, 0.0], 2)]
    assert [tuple(r) for r in negatives.mined(spark.createDataFrame(rows, schema)).collect()] == brute_negatives(rows) == []
    rows[0] = (0, [1.0, 0.0], 0)  # its label is shifted to 1
    assert [tuple(r) for r in negatives.mined(spark.createDataFrame(rows, schema)).collect()] == brute_negatives(rows) == [(0, 1, 1, 2, 58880, 52224 - 52224 % 256)]
    for n in (0, 1):
        assert negatives.mined(spark.createDataFrame(rows[:n], schema)).count() == 0
    assert negatives.mined(spark.createDataFrame(rows[1:], schema)).count() == 0


def test_products_are_exact():
    a, b = np.array([[1 << 27, -(1 << 27)]]), np.array([[(1 << 27) + 1, 3]])
    assert negatives.products(a, b).tolist() == [[(1 << 27) * ((1 << 27) + 1) - 3 * (1 << 27)]]
    assert negatives.products(np.array([[1 << 40]]), np.array([[1 << 22]])).tolist() == [[1 << 62]]
    with pytest.raises(OverflowError):
        negatives.products(np.array([[1 << 40]]), np.array([[1 << 24]]))
