"""Incremental ingestion: each run takes the files that came since the last one, or whose content changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import file_date, folder_date, period
from ..operators.reports import KEY
from ..operators.store import ReportStore
from ..sources.files import named

#: The period of files that nothing dates.
UNDATED = "undated"


def new_files(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """A stream of text files; the checkpoint remembers which were seen, by path, not by content."""
    stream = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    plain = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))  # the path comes as a URL
    return named(stream.select(F.col("value").alias("text"), plain.alias("path")), root)


def filed(rows: DataFrame) -> DataFrame:
    """Each file's day by name, then by folder; the period follows."""
    day = F.coalesce(file_date(F.col("name")), folder_date(F.col("folder")))
    return rows.withColumn("day", day).withColumn("period", period(F.col("day")))


def run_once(rows: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Take what is there in micro-batches and stop; sink gets each batch."""
    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def into_store(root: str, schema: str, source: str, report_type: str = "D") -> Callable[[DataFrame, int], None]:
    """A sink that appends each batch to the report store below root exactly once, however often a batch is sent.

    The batch's number is published with its rows, in one version, so a repeated one finds itself applied.
    """

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"report_type": F.lit(report_type), "period": F.coalesce("period", F.lit(UNDATED))})
        store = ReportStore(batch.sparkSession, root, schema)
        store.change(rows, lambda old: old.drop("base").unionByName(rows.select(*[c for c in old.columns if c != "base"])), source, number)

    return sink


def with_digest(files: DataFrame, content: str) -> DataFrame:
    return files.withColumn("digest", F.sha2(F.col(content), 256))


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found files (file, folder, digest) that are new or differ from what is known, with changed telling which.

    known may hold several revisions of a file; the one of the highest seq counts. A file that goes back to an older
    content has changed too.
    """
    last = known.groupBy(*KEY).agg(F.max_by("digest", "seq").alias("_digest"))
    rows = found.join(last, KEY, "left").where(F.col("_digest").isNull() | (F.col("_digest") != F.col("digest")))
    return rows.withColumn("changed", F.col("_digest").isNotNull()).drop("_digest")
