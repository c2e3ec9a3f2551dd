"""Filters, pages and exports of the catalogue."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fonoteca.functions.text import basename
from fonoteca.operators.predicates import contains, year_between

SEARCHED = ("artist", "album", "title", "label")
SHOWN = ("path", "artist", "album", "title", "label", "year", "genre", "codec", "duration_seconds", "size_bytes", "track_number", "status")


@dataclass(frozen=True)
class Filters:
    artist: str = ""
    album: str = ""
    title: str = ""
    label: str = ""
    genre: str = ""
    codec: str = ""
    status: str = ""
    first_year: str = ""
    last_year: str = ""
    text: str = ""

    def predicate(self, searched: tuple[str, ...] = SEARCHED) -> Column:
        found = F.lit(True)
        for f in ("artist", "album", "title", "label", "genre", "codec"):
            if value := getattr(self, f):
                found = found & contains(f, value)
        if self.status:
            found = found & (F.col("status") == self.status)
        if self.first_year or self.last_year:
            found = found & year_between("year", self.first_year or "0000", self.last_year or "9999")
        if self.text:
            either = F.lit(False)
            for c in searched:
                either = either | F.coalesce(contains(c, self.text), F.lit(False))
            found = found & either
        return found


def filtered(files: DataFrame, filters: Filters, searched: tuple[str, ...] = SEARCHED) -> DataFrame:
    return files.where(filters.predicate(searched))


def page(files: DataFrame, filters: Filters, number: int = 1, size: int = 50) -> DataFrame:
    """A page by artist, album and path, of the columns shown."""
    return filtered(files, filters, (*SEARCHED, "catalog_number")).orderBy("artist", "album", "path").offset((number - 1) * size).limit(size).select(*shown(files))


def pages(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def top(files: DataFrame, filters: Filters, n: int = 500) -> DataFrame:
    """The first n by artist, album and track as text; the plan takes them without a full sort."""
    return filtered(files, filters).orderBy("artist", "album", "track_number", "path").limit(n).select(*shown(files))


def shown(files: DataFrame) -> list[str]:
    return [c for c in SHOWN if c in files.columns]


def display(files: DataFrame) -> DataFrame:
    """filename, m:ss and MB of each file, as lists show them."""
    s = F.floor(F.coalesce("duration_seconds", F.lit(0.0))).cast("long")
    length = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return files.select("path", basename("path").alias("filename"), length.alias("dur"), F.bround(F.col("size_bytes") / 1048576, 1).alias("mb"))


def count(files: DataFrame, filters: Filters) -> DataFrame:
    return filtered(files, filters).agg(F.count("*").alias("n"))


def described(filters: Filters) -> str:
    return ", ".join(f"{f.name}={getattr(filters, f.name)!r}" for f in fields(filters) if getattr(filters, f.name)) or "all"
