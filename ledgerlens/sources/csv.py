"""Report rows as semicolon CSV: a byte-order mark, CRLF lines, quotes only where a field needs them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = {"sep": ";", "header": True, "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
MARK = "\ufeff"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted fields may hold line breaks; a byte-order mark is skipped; an absent text, or one of a missing column, is empty."""
    rows = spark.read.schema(schema).options(**OPTIONS, enforceSchema=True, encoding="UTF-8").csv(path)
    return rows.fillna("", [c for c, kind in rows.dtypes if kind == "string"])


def field(c: Column) -> Column:
    said = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(said.rlike('[;"\n\r]'), F.concat(F.lit('"'), F.replace(said, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(said)


def write(df: DataFrame, path: str) -> None:
    """Every file has the mark and the header; a NULL is written as an empty text, and line breaks in fields stay as they are."""
    header = MARK + ";".join(df.columns)

    def headed(batches):
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    lines = df.select(F.concat_ws(";", *[field(F.col(f"`{c}`")) for c in df.columns]).alias("value"))
    lines.mapInArrow(headed, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)
