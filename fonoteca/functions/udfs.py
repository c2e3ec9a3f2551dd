"""The few functions that Spark has no built-in for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import difflib
import json
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return texts.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings, 0 to 1; it depends on their order and is no metric."""
    return pd.Series([0.0 if not x or not y else 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.StructType().add("cutoff_hz", T.DoubleType()).add("mean_db", T.DoubleType()))
def spectral_cutoff(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """The highest frequency within 80 dB of the peak, and the mean level, of windowed samples."""
    out = []
    for s, r in zip(samples, rate):
        x = np.asarray(s if s is not None else [], dtype=float)
        if len(x) < 2:
            out.append((0.0, -200.0))
            continue
        level = 20 * np.log10(np.abs(np.fft.rfft(x * np.hanning(len(x)))) + 1e-12)
        above = np.flatnonzero(level > level.max() - 80)
        out.append((float(above[-1] * r / len(x)), float(20 * np.log10(np.sqrt(np.mean(x**2)) + 1e-10))))
    return pd.DataFrame(out, columns=["cutoff_hz", "mean_db"])


def tag_value(value: object) -> str:
    """A decoded JSON value as the text of a tag."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, list):
        return "; ".join(tag_value(v) for v in value if v)
    return json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, dict) else str(value)


@F.pandas_udf(T.StringType())
def _tag_values(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else tag_value(json.loads(t)))


def stringified(value: F.Column) -> F.Column:
    """The text of a tag from a VARIANT: '' for null, 1 or 0 for a boolean, a list's values but empty ones joined by '; ',
    an object as JSON with sorted keys, each nested in the other to any depth. A number with a fraction looks as a
    double does, nested ones as the VARIANT shows them. Only numbers with a fraction, lists and
    objects leave the JVM."""
    kind = F.schema_of_variant(value)
    plain = F.when(value.isNull() | (kind == "VOID"), "").when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "1").otherwise("0")).when(kind.isin("STRING", "BIGINT"), F.try_variant_get(value, "$", "string"))
    fraction = kind.rlike("^(DECIMAL|DOUBLE|FLOAT)")
    text = F.when(fraction, F.try_variant_get(value, "$", "double").cast("string")).otherwise(F.to_json(value))
    return F.coalesce(plain, _tag_values(F.when(plain.isNull(), text)))


def match_key(c: str) -> F.Column:
    """Folded, lower-cased, without punctuation, single-spaced."""
    clean = F.regexp_replace(F.lower(fold(F.coalesce(F.col(c), F.lit("")))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(clean, r"(?U)\s+", " "))
