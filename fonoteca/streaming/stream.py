"""The catalogue fed by a stream of files: resumed by checkpoint, merged by key, deduplicated by hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from fonoteca.operators.merge import latest, upsert
from fonoteca.tables import sent_whole


def arrivals(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """Records as their files appear; their number need not be known."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def first_seen(stream: DataFrame, time: str, late: str = "1 hour", key: str = "content_hash") -> DataFrame:
    """The first record of each hash; state is kept for `late` only."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def merged_into(stream: DataFrame, table: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Upserts each batch into a Parquet table, written beside it under the batch's number.

    A batch that is run again writes the same folder again, so a failure loses and doubles nothing.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        changes = latest(batch, key, order)
        before = previous(spark, table, n)
        after = upsert(before, changes, key) if before is not None else changes
        after.write.mode("overwrite").parquet(f"{table}/v={n}")

    return started(stream, step, checkpoint)


def started(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def previous(spark: SparkSession, table: str, n: int) -> DataFrame | None:
    """The newest version before n, through the file system that holds the table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    before = [v for v in (int(x[2:]) for x in names if x.startswith("v=")) if v < n]
    return spark.read.parquet(f"{table}/v={max(before)}") if before else None


def current(spark: SparkSession, table: str) -> DataFrame | None:
    return previous(spark, table, 1 << 62)


#: Paths share so many keys of state: a call reads and writes a bucket of paths at once, as each call costs milliseconds.
BUCKETS = 1024


class Changed(StatefulProcessor):
    """Keeps the size and the time of each path of a bucket, and lets through what is new or differs from them."""

    def __init__(self, drift: float, keep_ms: int | None):
        self.drift, self.keep_ms = drift, keep_ms

    def init(self, handle) -> None:
        self.kept = handle.getValueState("bucket", "paths array<string>, sizes array<long>, mtimes array<double>, since array<long>", self.keep_ms)

    def _load(self, timerValues) -> None:
        self.now = timerValues.getCurrentProcessingTimeInMs() if self.keep_ms else 0
        rows = zip(*(self.kept.get() or ()))
        self.seen = {path: rest for path, *rest in rows if not self.keep_ms or rest[2] + self.keep_ms > self.now}
        self.moved = False

    def _save(self) -> None:
        if self.moved:
            self.kept.update((list(self.seen), *(list(c) for c in zip(*self.seen.values()))))

    def _take(self, path, size, mtime) -> str:
        before = self.seen.get(path)
        if before is not None and before[0] == size and before[1] is not None and mtime is not None and abs(before[1] - mtime) < self.drift:
            return "unchanged"
        self.seen[path], self.moved = (size, mtime, self.now), True
        return "new" if before is None else "refreshed"

    def _taken(self, part: pd.DataFrame) -> list[tuple]:
        plain = lambda name, kind: [None if pd.isna(x) else kind(x) for x in part[name].tolist()]
        rows = zip(plain("path", str), plain("size_bytes", int), plain("mtime", float))
        return [(*row, kind) for row in rows if (kind := self._take(*row)) != "unchanged"]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load(timerValues)
        out = [row for part in rows for row in self._taken(part)]
        self._save()
        if out:
            yield pd.DataFrame(out, columns=["path", "size_bytes", "mtime", "change"])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._load(timerValues)
        self._taken(initialState)
        self._save()


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed state of this kind needs, for the streams started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def changed_only(stream: DataFrame, catalogue: DataFrame | None = None, drift: float = 1.0, keep_ms: int | None = None) -> DataFrame:
    """path, size_bytes, mtime, change (new or refreshed): files of the stream that differ from what was seen of them.

    stream and catalogue have path, size_bytes, mtime; the catalogue is what a first run begins with. The state,
    keyed by buckets of paths, is in the checkpoint, so a stream that is started again goes on from what it had seen;
    a batch reads a bucket that it has paths of, and writes it if one of them changed. `keep_ms` lets go of paths
    that have not changed for so long. A size or a time that is null differs from all.
    """
    sent_whole(__name__)
    columns = [F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).alias("bucket"), "path", "size_bytes", "mtime"]
    initial = {} if catalogue is None else {"initialState": catalogue.select(*columns).groupBy("bucket")}
    return stream.select(*columns).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Changed(drift, keep_ms),
        outputStructType="path string, size_bytes long, mtime double, change string",
        outputMode="Update",
        timeMode="ProcessingTime" if keep_ms else "None",
        **initial,
    )
