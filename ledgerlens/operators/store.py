"""The report store as files: versions of a table whose (report_type, period) partitions are replaced whole.

    root/data/<batch>/report_type=M/period=05.2026/...   rows, in buckets of folder and base file
    root/versions/<number>.json                          which folder holds each partition, and what was applied

A change reads only the partitions that it touches, writes their new content beside the old one, and publishes the next
version by a rename that fails if another writer was first; then it starts again from that writer's version. A job that is
lost before the rename leaves the version as it was, and its files are never read. A change that names its source and
number is applied once, however often it is tried. Versions list partitions, so they grow with periods and not with rows.

Readers see one version as a catalogue table with those partitions, so filters and joins on type and period list and read
only what they need, and joins on folder and base need no shuffle of the store.

Defined cases: a store that was never written is empty; a partition that loses its last row leaves the version; equal
keys in one change are taken by seq, the last one wins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .reports import REPORT, with_base

BUCKETS = 8
BUCKETED_BY = ["folder", "base"]


class Conflict(Exception):
    """Another writer published the version first."""


def path_of(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def file_system(spark: SparkSession, name: str):
    return path_of(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list[str]:
    fs = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path_of(spark, folder))) if fs.exists(path_of(spark, folder)) else []


class ReportStore:
    """A store below root; rows have seq, file, folder, report_type, period and the columns of schema besides."""

    def __init__(self, spark: SparkSession, root: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        fields = [f for f in StructType.fromDDL(schema).fields if f.name not in (*REPORT, "base")]
        self.columns = [f.name for f in fields]
        self.ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    # -- versions

    def version(self) -> dict[str, Any]:
        """The newest version: number, folders by "type/period", and the last number applied by source."""
        names = [n for n in listed(self.spark, f"{self.root}/versions") if n.endswith(".json")]
        if not names:
            return {"number": 0, "partitions": {}, "applied": {}}
        at = path_of(self.spark, f"{self.root}/versions/{names[-1]}")
        stream = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: dict[str, Any]) -> None:
        """Write a version under its number, or raise Conflict if there is one."""
        jvm, folder = self.spark._jvm, f"{self.root}/versions"
        fs = file_system(self.spark, folder)
        fs.mkdirs(path_of(self.spark, folder))
        draft, final = path_of(self.spark, f"{folder}/.{uuid.uuid4().hex}"), path_of(self.spark, f"{folder}/{version['number']:020d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(version, sort_keys=True).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        never_over = self.spark.sparkContext._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, never_over)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                raise Conflict(version["number"]) from None
            raise

    # -- reading

    def _catalogue(self, location: str, partitions: dict[str, str]) -> str:
        name = f"report_store_{uuid.uuid4().hex}"
        keys = ", ".join(f"`{c}`" for c in BUCKETED_BY)
        self.spark.sql(
            f"CREATE TABLE {name} ({self.ddl}, base STRING, report_type STRING, period STRING) USING parquet PARTITIONED BY (report_type, period) CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )
        said = [f"PARTITION (report_type = '{k.split('/', 1)[0]}', period = '{k.split('/', 1)[1]}') LOCATION '{self.root}/{folder}'" for k, folder in partitions.items()]
        for i in range(0, len(said), 500):
            self.spark.sql(f"ALTER TABLE {name} ADD {' '.join(said[i : i + 500])}")
        return name

    def rows(self, version: dict[str, Any] | None = None) -> DataFrame:
        """All rows of a version, the newest by default; filter by report_type and period to read less."""
        version = version or self.version()
        return self.spark.table(self._catalogue(f"{self.root}/data", version["partitions"]))

    def of(self, wanted: Iterable[str], version: dict[str, Any]) -> DataFrame:
        """The rows of some partitions."""
        return self.rows(version | {"partitions": {k: f for k, f in version["partitions"].items() if k in set(wanted)}})

    # -- writing

    def change(self, touched: DataFrame, made: Callable[[DataFrame], DataFrame], source: str | None = None, number: int | None = None, tries: int = 5) -> int:
        """Replace the partitions of touched (report_type, period) by made(their rows); the version after it.

        A change of a source is applied only if its number is above the last one.
        """
        wanted = sorted(f"{r.report_type}/{r.period}" for r in touched.select(*REPORT).distinct().collect())  # one for each period
        for _ in range(tries):
            version = self.version()
            if source is not None and number <= version["applied"].get(source, -1):
                return version["number"]
            batch = f"data/{version['number'] + 1:08d}-{uuid.uuid4().hex}"
            written = self._write(made(self.of(wanted, version)), batch)
            partitions = {k: f for k, f in version["partitions"].items() if k not in wanted} | written
            applied = version["applied"] | ({source: number} if source is not None else {})
            try:
                self.publish({"number": version["number"] + 1, "partitions": partitions, "applied": applied})
            except Conflict:
                continue
            return version["number"] + 1
        raise Conflict(f"{tries} tries")

    def _write(self, rows: DataFrame, batch: str) -> dict[str, str]:
        """Write rows in buckets, one file for each partition and bucket; the folders of the partitions."""
        name = self._catalogue(f"{self.root}/{batch}", {})
        rows = with_base(rows).select(*self.columns, "base", *REPORT)
        rows.repartition(self.buckets, *BUCKETED_BY).write.insertInto(name)
        self.spark.sql(f"DROP TABLE {name}")
        jvm = self.spark._jvm
        plain = lambda s: jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(s)
        out = {}
        for kind in listed(self.spark, f"{self.root}/{batch}"):
            for period in listed(self.spark, f"{self.root}/{batch}/{kind}") if kind.startswith("report_type=") else ():
                out[f"{plain(kind.partition('=')[2])}/{plain(period.partition('=')[2])}"] = f"{batch}/{kind}/{period}"
        return out

    def vacuum(self) -> int:
        """Delete batches that the newest version does not name, those of lost jobs too; how many. No writer may be at work."""
        used = {f.split("/")[1] for f in self.version()["partitions"].values()}
        stale = [b for b in listed(self.spark, f"{self.root}/data") if b not in used]
        for b in stale:
            file_system(self.spark, self.root).delete(path_of(self.spark, f"{self.root}/data/{b}"), True)
        return len(stale)
