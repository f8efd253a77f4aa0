"""Files of a folder tree with name and relative folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text with fewer visible characters than this is taken for a picture.
PICTURE_BELOW = 15


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, spark.checkpoint.dir; on one machine a temporary one will do."""
    context = spark.sparkContext
    said = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not said and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(said or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return said or current.get()


_left: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which discard() deletes."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _left.append(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder; its size is known, so small ones are sent to joins whole."""
    path = scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete what scratch() and kept() left, once the results made from it are stored; how many folders there were."""
    n = len(_left)
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, _left):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _left.clear()
    return n


def named(df: DataFrame, root: str) -> DataFrame:
    """name and folder, relative to the root, of a frame with a path column."""
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    rest = F.regexp_replace(path, f"^.*?{root.strip('/')}/", "") if root.strip("/") else path
    return df.withColumns({"name": F.regexp_extract(rest, r"([^/]*)$", 1), "folder": F.regexp_replace(rest, r"/?[^/]*$", "")})


def listing(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """Binary files below the root; content is read only where it is asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return named(rows, root)


def is_picture(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < PICTURE_BELOW
