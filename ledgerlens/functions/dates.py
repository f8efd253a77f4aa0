"""Dates as Column expressions; text that is no calendar date gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base_file

MONTHS = "Janeiro Fevereiro Março Abril Maio Junho Julho Agosto Setembro Outubro Novembro Dezembro".split()


def serial_date(c: Column) -> Column:
    """A spreadsheet's serial day number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(c).cast("int"))


def made(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def written_date(c: Column) -> Column:
    """Day, month and year with / . or - between; a year of two digits is of this century."""
    pattern = r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})"
    part = [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]
    year = F.when(F.length(part[2]) == 2, F.concat(F.lit("20"), part[2])).otherwise(part[2])
    return F.when(part[0] != "", made(year, part[1], part[0]))


def day_distance(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def period(c: Column) -> Column:
    return F.date_format(c, "MM.yyyy")


def month_name(c: Column) -> Column:
    """Month and year in words, of a period such as 05.2026."""
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.substring(c, 1, 2).cast("int"))
    return F.concat(name, F.lit("/"), F.substring(c, 4, 4))


# Dates in file names and folders, and periods with the lengths of their parts.
FILE_DATES = ((r"(?<!\d)(20\d{2})\.(\d{2})\.(\d{2})(?!\d)", (1, 2, 3)), (r"(?<!\d)(\d{2})\.(\d{2})\.(20\d{2})(?!\d)", (3, 2, 1)))
FOLDER_DATES = ((r"(?:^|/)(\d{4})\.(\d{2})\.(\d{2})(?:/|$)", (1, 2, 3)), (r"(?:^|/)(\d{2})\.(\d{2})\.(\d{4})(?:/|$)", (3, 2, 1)))
PERIODS = ((2, 2, 4), (4, 2, 2), (2, 4), (4, 2))


def first_date(c: Column, shapes) -> Column:
    """The date of the first shape that is found; year, month and day stand in the groups that it names."""
    out = F.lit(None).cast("date")
    for pattern, places in reversed(shapes):
        year, month, day = (F.regexp_extract(c, pattern, i) for i in places)
        out = F.when(year != "", made(year, month, day)).otherwise(out)
    return out


def file_date(c: Column) -> Column:
    """The first YYYY.MM.DD that touches no other digit, else the first DD.MM.YYYY."""
    return first_date(base_file(c), FILE_DATES)


def folder_date(c: Column) -> Column:
    """A whole segment of the path that is YYYY.MM.DD, else one that is DD.MM.YYYY."""
    return first_date(c, FOLDER_DATES)


def flipped(c: Column) -> Column:
    """The parts of a period in reverse order: DD.MM.YYYY and YYYY.MM.DD, MM.YYYY and YYYY.MM; others stay."""
    parts = F.split(c, r"\.")
    shapes = [c.rlike("^" + r"\.".join(rf"\d{{{n}}}" for n in shape) + "$") for shape in PERIODS]
    return F.when(F.greatest(*shapes), F.array_join(F.reverse(parts), ".")).otherwise(c)
