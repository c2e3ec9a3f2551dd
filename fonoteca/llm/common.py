"""Helpers shared by the corpus operators: reading, Arrow maps over texts, cutting lineage."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "__text"
#: Texts are handed to the Python side of an operator in runs of about this many bytes.
RUN_BYTES = 4 << 20
#: Paths of the tables written so far.
_tables: list[str] = []
#: What a Python worker keeps over the tasks of one operator.
_kept: dict[object, object] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is named in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fonoteca-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    A lost executor costs only the tasks it ran: what is read back comes from shared storage.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, written; the tables that making it left behind are deleted."""
    before = len(_tables)
    result = materialise(make())
    for path in _tables[before:-1]:
        drop(spark, path)
    _tables[before:-1] = []
    return result


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that this process has written with materialise; results built on them must have been used."""
    while _tables:
        drop(spark, _tables.pop())


def kept(name: object, make: Callable[[], object]):
    """What make() gives, kept by this Python worker for the next tasks that ask for it by name, until tasks of others run."""
    if name not in _kept:
        give_up()
        _kept[name] = make()
    return _kept[name]


def give_up() -> None:
    """Frees what this Python worker has kept; tasks that need memory of their own begin with it."""
    _kept.clear()


#: The columns of documents by which operators know them.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that returns the columns of its documents, for documents with columns of any names.

    Columns that are not known ones go through it as one struct, so that none has a name that it uses.
    """

    @functools.wraps(stage)
    def through(docs: DataFrame, *args, **named) -> DataFrame:
        others = [c for c in docs.columns if c not in KNOWN]
        if not others:
            return stage(docs, *args, **named)
        quoted = lambda c: "`" + c.replace("`", "``") + "`"
        own = [c for c in docs.columns if c in KNOWN]
        packed = docs.select(*own, F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others))).alias("others"))
        done = stage(packed, *args, **named)
        return done.select(*(F.col(c) if c in KNOWN else F.col("others")[f"c{others.index(c)}"].alias(c) for c in docs.columns))

    return through


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; the folds of the labelled and the held-out rows come from it."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    fields: str,
    make: Callable[[], Callable[[list[bytes]], list[list]]],
) -> DataFrame:
    """Columns keep of df, and the columns that make()(texts) computes, in one Arrow pass.

    Texts arrive as UTF-8 bytes, null as b"". make runs once a task, so that a function can hold
    tables; it returns one list a field. Row order and row count stay, nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    source = df.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(TEXT))
    out = T.StructType(source.schema.fields[:-1] + T._parse_datatype_string(fields).fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        function = make()
        for batch in batches:
            for part in runs(batch):
                columns = function(part.column(len(keep)).to_pylist())
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(c, type=arrow.field(len(keep) + i).type) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, out)


def runs(batch: pa.RecordBatch, column: str = TEXT, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about most bytes; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    sizes, begin, total = pc.binary_length(batch.column(column)).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)


def words_of(text: bytes) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+: bytes.split() cuts at exactly these six characters."""
    return text.split()


def lower_ascii(text: bytes) -> bytes:
    """A-Z to lower case and nothing else."""
    return text.lower()
