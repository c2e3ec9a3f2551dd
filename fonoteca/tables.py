"""Tables written between the steps of a job, in the folder that the driver and the executors share."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is named in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fonoteca-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def new_path(spark: SparkSession, kind: str = "table") -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: its steps run once, and a lost executor costs its tasks only."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_whole(module: str) -> None:
    """From now on what a module defines is sent to Python workers as it is, not by name: those that plan a data
    source or begin a stream's state do not see the files that a session has added."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
