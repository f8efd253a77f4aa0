"""Ledger workbooks (spreadsheets as zipped XML) as ledger lines.

Files are read by Spark's binary reader, so any store will do; each is unpacked in its task, row by row. The first
sheet's second row names the columns and data begin in the third.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import serial_date
from ..functions.text import absent, tax_id

#: Rows above the header, and rows handed on at once.
SKIPPED, BATCH = 1, 2_000
#: Bytes of a sheet that is parsed at once.
SMALL = 1 << 20
# The ledger's columns by the names they have in a sheet.
COLUMNS = {"orig": "ORIG", "nf": "NF", "entity": "ENTIDADE", "category": "TIPO", "branch": "FILIAL", "entity_code": "CD_ENTID"}
MONEY = {"header_cents": "VL_TOTAL_CAB", "item_cents": "VL_ITEM"}
DATES = {"issue_date": "DT_EMISSAO", "entry_date": "DT_LANCAMENTO", "due_date": "DT_VENCIMENTO", "paper_date": "DATA"}


@lru_cache(1 << 10)
def local(tag: str) -> str:
    return tag.rpartition("}")[2]


@lru_cache(1 << 16)
def column_number(place: str) -> int:
    """A cell's column, of a place such as AB12, from zero."""
    n = 0
    for c in re.match("[A-Z]+", place)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def cell_rows(content: bytes) -> Iterator[tuple[int, dict[int, str]]]:
    """(row from zero, cells by column) of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                strings.append("".join(t.text or "" for t in item.iter() if local(t.tag) == "t"))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not sheets:
            return
        with book.open(sheets[0]) as sheet:
            # a small sheet is parsed at once, a large one row by row
            small = book.getinfo(sheets[0]).file_size <= SMALL
            rows = (row for part in ElementTree.parse(sheet).getroot() if local(part.tag) == "sheetData" for row in part) if small else (e for _, e in ElementTree.iterparse(sheet))
            for row in rows:
                if local(row.tag) != "row":
                    continue
                cells = {}
                for cell in row:
                    value, kind = next((x.text for x in cell if local(x.tag) == "v"), None), cell.get("t")
                    if kind == "s" and value is not None:
                        value = strings[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(x.text or "" for x in cell.iter() if local(x.tag) == "t")
                    if value is not None:
                        cells[column_number(cell.get("r"))] = value
                yield int(row.get("r")) - 1, cells
                row.clear()


def sheet_rows(spark: SparkSession, root: str, pattern: str = "*.xlsx") -> DataFrame:
    """(path, row, cells): the data rows of all workbooks below root."""
    return unpacked(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root))


def unpacked(files: DataFrame) -> DataFrame:
    """(path, row, cells): the data rows of workbooks (path, content), each a map from header to value as written."""

    def run(batches):
        kind = pa.map_(pa.string(), pa.string())
        paths, numbers, rows = [], [], []

        def made():
            done = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(numbers, pa.int64()), pa.array(rows, kind)], names=["path", "row", "cells"])
            paths.clear(), numbers.clear(), rows.clear()
            return done

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                header: dict[int, str] = {}
                for n, cells in cell_rows(content.as_py()):
                    if n == SKIPPED:
                        header = {k: v.strip() for k, v in cells.items()}
                    elif n > SKIPPED and cells:
                        paths.append(path)
                        numbers.append(n)
                        rows.append([(header[k], v) for k, v in cells.items() if k in header])
                    if len(rows) >= BATCH:
                        yield made()
        if rows:
            yield made()

    return files.select("path", "content").mapInArrow(run, "path string, row bigint, cells map<string,string>")


def ledger_lines(rows: DataFrame) -> DataFrame:
    """Ledger lines of sheet rows; seq is the row. A value that is no number counts as nothing, a date that is none is absent."""
    said = lambda name: absent(F.trim(F.element_at("cells", name)))
    cents = lambda c: F.coalesce((F.round(c.try_cast("double") * 100)).cast("bigint"), F.lit(0))

    def day(c: Column) -> Column:
        return F.when(c.try_cast("double") > 0, serial_date(c.try_cast("double")))

    columns = [said(source).alias(name) for name, source in COLUMNS.items()]
    columns += [F.abs(cents(said(source))).alias(name) for name, source in MONEY.items()]
    columns += [cents(said(MONEY["header_cents"])).alias("signed_cents")]
    columns += [day(said(source)).alias(name) for name, source in DATES.items()]
    return rows.select("path", F.col("row").alias("seq"), *columns, tax_id(said(COLUMNS["entity"])).alias("entity_id"))
