"""The report store: rows keyed by (file, folder) within (report type, period)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_file

KEY = ["file", "folder"]
#: Reports are apart by these.
REPORT = ["report_type", "period"]


def latest(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows and new ones in the order of seq, as if written one after the other.

    A row replaces that of its key. Writing an instalment of a file also removes the whole file's row, and writing the
    whole file its instalments, those written just before included. Rows of other reports stay as they are.
    """
    at = [*REPORT, "folder", "base"]
    fresh = latest(with_base(new), [*REPORT, *KEY])
    whole = F.col("file") == F.col("base")
    writes = fresh.groupBy(*at).agg(F.max(F.when(whole, F.col("seq"))).alias("_whole"), F.max(F.when(~whole, F.col("seq"))).alias("_part"))
    other = F.when(whole, F.col("_part")).otherwise(F.col("_whole"))
    stays = with_base(old).join(writes, at, "left").where(other.isNull()).drop("_whole", "_part")
    stays = stays.join(fresh.select(*at, "file"), [*at, "file"], "left_anti")
    lasts = fresh.join(writes, at, "left").where(other.isNull() | (other < F.col("seq")))
    return stays.select(*old.columns).unionByName(lasts.select(*[c for c in old.columns if c in lasts.columns]))


def with_base(rows: DataFrame) -> DataFrame:
    return rows if "base" in rows.columns else rows.withColumn("base", base_file(F.col("file")))


def posted(old: DataFrame, new: DataFrame, deletions: DataFrame) -> DataFrame:
    """A report sent whole: daily ones replace their period, monthly ones lose the deleted keys and take the new rows by key.

    deletions: (report_type, period, file, folder).
    """
    fresh = latest(new, [*REPORT, *KEY])
    daily = old.where("report_type = 'D'").join(fresh.select(*REPORT).distinct(), REPORT, "left_anti")
    monthly = old.where("report_type <> 'D'").join(deletions.select(*REPORT, *KEY), [*REPORT, *KEY], "left_anti")
    return daily.unionByName(monthly.join(fresh.select(*REPORT, *KEY), [*REPORT, *KEY], "left_anti")).unionByName(fresh)


def purged(rows: DataFrame) -> DataFrame:
    """Without company reports of the old form, whose period names a company too."""
    return rows.where(~((F.col("report_type") == "C") & F.contains("period", F.lit("-"))))


def company_reports(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of all monthly reports that belong to a company, as one company report a month; found: (seq, company_id)."""
    monthly = rows.where("report_type = 'M'").join(found.select("seq", "company_id"), "seq")
    return latest(monthly.withColumn("report_type", F.lit("C")), [*REPORT, *KEY])


def annotated_store(old: DataFrame, new: DataFrame, deletions: DataFrame) -> DataFrame:
    """Annotations by (period, key): the last new one replaces what there was, and deleted keys go before that."""
    at = ["period", "key"]
    fresh = latest(new.where("period <> '' and key <> ''"), at)
    stays = old.join(deletions.select(*at), at, "left_anti").join(fresh.select(*at), at, "left_anti")
    return stays.unionByName(fresh)


def filed_days(files: DataFrame) -> DataFrame:
    """files (day, seq) with undated ones on the first day of the month that most dated ones have; today without any."""
    months = files.where("day is not null").select(F.date_format("day", "yyyy-MM").alias("month"), "seq")
    fallback = predominant_month(months).select(F.to_date(F.concat("month", F.lit("-01"))).alias("_most"))
    return files.crossJoin(F.broadcast(fallback)).withColumn("day", F.coalesce("day", "_most", F.current_date())).drop("_most")


def to_reread(rows: DataFrame, forced: Column) -> DataFrame:
    """Rows that must be read again: with forced reading those whose origin is no answer of a model."""
    return rows.where(forced & ~F.coalesce(F.col("origin").rlike("(?i)(?<![A-Za-z0-9_])IA(?![A-Za-z0-9_])"), F.lit(False)))


def best_by_payload(rows: DataFrame) -> DataFrame:
    """The last row with a payload of each key, else the first row."""
    has = F.col("payload").isNotNull()
    order = Window.partitionBy(*KEY).orderBy(F.desc(has), F.when(has, -F.col("seq")).otherwise(F.col("seq")))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def of_periods(rows: DataFrame, kind: str, periods: list[str]) -> DataFrame:
    """Rows of some periods; on a store partitioned by type and period only those are read."""
    return rows.where((F.col("report_type") == kind) & F.col("period").isin(periods))


def month_days(periods: DataFrame, month: str, year: str) -> DataFrame:
    """Days of a month that have a report, from DD.MM.YYYY or YYYY.MM.DD."""
    p = F.col("period")
    here = periods.where(p.like(f"%.{month}.{year}") | p.like(f"{year}.{month}.%"))
    day = F.when(p.like(f"{year}.%"), F.regexp_extract(p, r"\.(\d{2})$", 1)).otherwise(F.regexp_extract(p, r"^(\d{2})\.", 1))
    return here.select(day.cast("int").alias("day")).distinct()


def predominant_month(rows: DataFrame) -> DataFrame:
    """The month of most rows; of equals the one seen first."""
    counts = rows.groupBy("month").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.agg(F.max_by("month", F.struct("n", -F.col("first"))).alias("month"), F.max("n").alias("n"))


def pending(found: DataFrame, known: DataFrame, cached: DataFrame) -> DataFrame:
    """Found files that the month's report lacks; reusable where any report holds them."""
    left = found.join(known.select(*KEY), KEY, "left_anti")
    return left.join(cached.select(*KEY).distinct().withColumn("reusable", F.lit(True)), KEY, "left").withColumn("reusable", F.coalesce("reusable", F.lit(False)))


def companies_by_name(companies: DataFrame) -> DataFrame:
    """(company_id, name, tax_id, kind, state) in the order of names, as a list shows them."""
    return companies.select("company_id", "name", "tax_id", "kind", "state").orderBy("name", "company_id")


def schedule(times: DataFrame) -> DataFrame:
    """(schedule_id, at): the times of day when folders are read, as HH:MM, once each, the earliest first."""
    at = F.regexp_extract(F.trim("at"), r"^((?:[01]\d|2[0-3]):[0-5]\d)(?::\d{2})?$", 1)
    return times.select("schedule_id", at.alias("at")).where("at <> ''").groupBy("at").agg(F.min("schedule_id").alias("schedule_id")).select("schedule_id", "at").orderBy("at")


def folder_rows(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One pass over a folder: rows read from files, as rows of daily and monthly reports.

    files: (file, folder, day, seq), undated ones without day; rows: (file, folder, due) and others, file with the mark of
    an instalment where it is one. An instalment belongs to the day it is due, any other row to its file's day, and
    undated files to the first day of the month that most dated ones have.
    """
    filed = filed_days(files).select(F.col("file").alias("base"), "folder", "day")
    part = F.col("file") != F.col("base")
    dated = with_base(rows).join(filed, ["base", "folder"]).withColumn("day", F.when(part & F.col("due").isNotNull(), F.col("due")).otherwise(F.col("day"))).drop("base")
    kinds = F.array(F.struct(F.lit("D").alias("report_type"), F.date_format("day", "dd.MM.yyyy").alias("period")), F.struct(F.lit("M").alias("report_type"), F.date_format("day", "MM.yyyy").alias("period")))
    return dated.withColumn("_k", F.explode(kinds)).select("*", "_k.report_type", "_k.period").drop("_k")
