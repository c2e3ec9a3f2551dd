"""Providers of facts about albums, as a data source: a partition a provider, asked for what a query filters by.

What a provider knows is a table, its index, partitioned by provider as Spark writes it: no network is used.
`spark.read.format("providers").option("path", index)` reads it once `register` has run; filters of equality,
membership and least score are pushed to the index, and a filter on provider leaves the others out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition

from fonoteca.functions.text import Text, safe_query
from fonoteca.tables import sent_whole


@dataclass(frozen=True)
class Provider:
    id: str
    name: str
    requires_auth: bool
    seconds_between: float


# The order in which providers count, and how often each may be asked.
PROVIDERS = (
    Provider("discogs", "Discogs", True, 1.05),
    Provider("musicbrainz", "MusicBrainz", False, 1.05),
    Provider("deezer", "Deezer", False, 0.3),
    Provider("bandcamp", "Bandcamp", False, 1.5),
    Provider("itunes", "iTunes", False, 3.0),
    Provider("acoustid", "AcoustID", True, 0.35),
)
SCHEMA = "provider string, album_id long, artist string, album string, score double, ord long, label string, year string"


def provider_order(provider: Text, providers: tuple[Provider, ...] = PROVIDERS) -> Column:
    """The place of a provider among them, the last place and more for others."""
    out = F.lit(len(providers))
    for i, p in reversed(list(enumerate(providers))):
        out = F.when((F.col(provider) if isinstance(provider, str) else provider) == p.id, i).otherwise(out)
    return out


def write_index(rows: DataFrame, path: str) -> None:
    """A provider's rows in a folder of its own, sorted by album, so that pages of other albums are skipped."""
    known = rows.where("provider IS NOT NULL")
    known.repartition("provider", F.pmod(F.xxhash64("album_id"), F.lit(16))).sortWithinPartitions("album_id").write.partitionBy("provider").mode("overwrite").parquet(path)


class Asked(InputPartition):
    def __init__(self, provider: str):
        self.provider = provider


class IndexReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], columns: list[str]):
        self.path, self.names, self.columns = path, names, columns
        self.pushed: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ())
            if isinstance(f, (EqualTo, In, GreaterThanOrEqual)) and len(name) == 1 and name[0] in self.columns:
                value = list(f.value) if isinstance(f, In) else f.value
                if name[0] == "provider" and not isinstance(f, GreaterThanOrEqual):
                    self.names = [n for n in self.names if n in (value if isinstance(f, In) else [value])]
                else:
                    self.pushed.append(({EqualTo: "=", In: "in", GreaterThanOrEqual: ">="}[type(f)], name[0], value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Asked(n) for n in self.names]

    def read(self, partition: Asked):
        import pyarrow as pa
        import pyarrow.dataset as ds

        where = None
        for op, name, value in self.pushed:
            field = ds.field(name)
            part = field == value if op == "=" else field.isin(value) if op == "in" else field >= value
            where = part if where is None else where & part
        own = [c for c in self.columns if c != "provider"]
        folder = f"{self.path.removeprefix('file:').replace('///', '/', 1)}/provider={partition.provider}"
        try:
            index = ds.dataset(folder, format="parquet")
        except FileNotFoundError:  # a provider that knows nothing
            return
        for batch in index.to_batches(columns=own, filter=where):
            columns = {**dict(zip(own, batch.columns)), "provider": pa.array([partition.provider] * batch.num_rows, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.columns], names=self.columns)


class ProviderSource(DataSource):
    """Options: path of the index, providers (names by commas; all known ones if not given)."""

    @classmethod
    def name(cls) -> str:
        return "providers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        names = [n for n in self.options.get("providers", "").split(",") if n] or [p.id for p in PROVIDERS]
        return IndexReader(self.options["path"], names, schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Makes the format known and lets Spark hand filters to it."""
    sent_whole(__name__)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderSource)


def asked(spark: SparkSession, index: str, queries: DataFrame, providers: list[str]) -> DataFrame:
    """What the providers know of the albums asked for; placeholders are never asked for.

    queries: album_id, artist, album; the join is by id, after the filters that can be pushed.
    """
    register(spark)
    known = spark.read.format("providers").option("path", index).option("providers", ",".join(providers)).load()
    fit = queries.where(safe_query("artist", "album")).select("album_id").distinct()
    return known.join(fit, "album_id", "left_semi")
