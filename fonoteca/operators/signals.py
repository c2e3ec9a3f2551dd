"""Measures of audio and of runs: silent low bytes, verdict lines, smoothed rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fonoteca.functions.text import Text, col


def low_byte_share(samples: DataFrame, key: str, sample: str, least: float = 0.95, doubtful: float = 0.5) -> DataFrame:
    """key, share, verdict: how many of the integer samples have a zero low byte; 'fake', 'suspicious' or 'genuine'."""
    share = F.avg((F.col(sample).bitwiseAND(F.lit(255)) == 0).cast("double"))
    verdict = F.when(F.col("share") >= least, "fake").when(F.col("share") >= doubtful, "suspicious").otherwise("genuine")
    return samples.groupBy(key).agg(share.alias("share")).withColumn("verdict", verdict)


def verdict_line(text: Text) -> Column:
    """struct<verdict, confidence> of the first line 'path,start,duration,value,label' whose value is a number.

    A lossy label has its value, an original or lossless one what is left to 1, as its value is 0 for sure. Any
    other label has verdict '' and confidence 0; where no line is of the form, the verdict is 'unknown'.
    """
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), r"\r\n|[\n\r\x0B\f]"), lambda x: F.split(F.trim(x), ","))
    value_of = lambda p: F.try_element_at(p, F.lit(-2)).try_cast("double")
    parts = F.try_element_at(F.filter(lines, lambda p: (F.size(p) >= 5) & value_of(p).isNotNull()), F.lit(1))
    value, label = value_of(parts), F.lower(F.trim(F.try_element_at(parts, F.lit(-1))))
    said = lambda verdict, sure: F.struct(F.lit(verdict).alias("verdict"), sure.alias("confidence"))
    return (
        F.when(parts.isNull(), said("unknown", F.lit(0.0)))
        .when(label.contains("lossy"), said("lossy", value))
        .when(label.contains("original") | label.contains("lossless"), said("original", 1 - value))
        .otherwise(said("", F.lit(0.0)))
    )


def smoothed(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """key, smoothed: the exponential moving average after the last row, which begins at the first one's value.

    As a weighted sum: the last row weighs alpha, each one before it (1 - alpha) times as much, and the
    first what is left, so the rows of a key are ranked but never gathered.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1
    rows = rows.withColumn("back", back).withColumn("all", F.count("*").over(Window.partitionBy(key)))
    weight = F.pow(F.lit(1 - alpha), F.col("back")) * F.when(F.col("back") == F.col("all") - 1, 1.0).otherwise(alpha)
    return rows.groupBy(key).agg(F.sum(weight * F.col(value)).alias("smoothed"))
