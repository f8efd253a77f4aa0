"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the control characters 9 to 13.
WORD_BREAK = r"[\x20\x09-\x0D]+"


_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where a session on one machine names none, as in tests, a temporary folder is set once and kept; on a cluster
    a folder of the driver would be of no use, so that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return named or current.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder; they outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the reader over it.

    Unlike a checkpoint the reader knows its size, so the planner chooses joins by it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table that written() returned as df, once all that was made from it is written itself."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written.remove(df.written_to)


def discard(spark: SparkSession) -> int:
    """Delete the tables that written() left, once the results made from them are stored; how many there were."""
    n = len(_written)
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, _written):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written.clear()
    return n


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def text_or_empty(column="text"):
    return F.coalesce(F.col(column), F.lit(""))
