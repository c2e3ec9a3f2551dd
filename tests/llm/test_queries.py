"""The registered opN_ queries over whole tables, against brute force written from what they are to return."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fonoteca.llm import packing, queries
from tests.llm.test_operators import brute_components, brute_pii, joined, sha, shingle_sets

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name, texts):
    """The rows of a query by doc_id; every document has exactly one."""
    rows = queries.QUERIES[name](spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(texts.keys())
    return {r["doc_id"]: r for r in rows}


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def test_op1(spark, texts):
    for i, r in rows_of(spark, "op1_secret_scans", texts).items():
        t = texts[i]
        a = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        k = [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        h = [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (len(a), len(k), len(h), sha(joined(a + k + h)))
        assert set(joined(a + k + h).split(",")) <= set(r["spans"].split(","))


def test_op2(spark, texts):
    """Folds and marks are exact; held-out documents are told apart."""
    rows = rows_of(spark, "op2_quality_classifier", texts)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(rows[i]["score"], q) for i, q in labels if i in rows and rows[i]["held_out"] and q is not None]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert good and bad
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9


def test_op6(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = queries.QUERIES["op6_packing"](spark, SF).toPandas()
    assert set(got.doc_id) == set(texts)
    for i, g in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], dtype="<u4")
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids) and set(g.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(g.start, g.length, g.ids_crc32))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert got.length.sum() / (4096 * got.sequence_id.nunique()) > 0.95
    # Every full window holds each source's share but for a quantum or two.
    shares = got.groupby("source").length.sum() / got.length.sum()
    held = got.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0).sort_index().iloc[:-1]
    assert (held - 4096 * shares).abs().to_numpy().max() <= 2 * packing.QUANTUM


def test_op7(spark, texts):
    sets = shingle_sets(texts, 3)
    want = brute_components(sets, 85)
    assert any(want[i] != i for i in want)
    for i, r in rows_of(spark, "op7_near_dedup", texts).items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), want[i], i == want[i])


def test_op8(spark, texts):
    for i, r in rows_of(spark, "op8_pii", texts).items():
        found = brute_pii(texts[i])
        base = joined([(s, n, e, k) for n, (k, v) in enumerate(found.items()) for s, e in v])
        assert [r[f"n_{k}"] for k in found] == [len(v) for v in found.values()] and r["base_sha256"] == sha(base)
        assert not base or set(base.split(",")) <= set(r["spans"].split(","))


def test_op9(spark, texts):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [*t.encode().lower().split(), b" "] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    rows = rows_of(spark, "op9_class_lm", texts)
    for i, r in rows.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens[i]), rel_tol=1e-9)
    assert sum(r["score"] for r in rows.values() if r["held_out"]) > sum(r["base_score"] for r in rows.values() if r["held_out"])


def test_op10(spark, texts):
    rows = rows_of(spark, "op10_quality_rules", texts)
    for i, r in rows.items():
        words, lines = words_of(texts[i]), [x for x in texts[i].split("\n") if words_of(x)]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {j for at in range(len(words) - 2) if windows[tuple(words[at : at + 3])] > 1 for j in (at, at + 1, at + 2)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in texts[i]), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {q: [rows[i]["kept"] for i in labels if labels[i] == q and i in rows] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.8 and np.mean(kept[0]) < 0.2
