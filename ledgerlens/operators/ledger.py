"""The ledger: item lines to notes, listings, collisions and searches.

Lines carry seq, the order in which the source gives them, since a DataFrame has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import period
from ..functions.predicates import NOT_FISCAL, is_card_entry
from ..functions.text import clean_number, norm


def payable(lines: DataFrame) -> DataFrame:
    """Lines that are payable fiscal documents: origin, card entries, category and period decide."""
    entity = F.coalesce(norm(F.col("entity")), F.lit(""))
    rows = lines.where(norm(F.col("orig")) == "CP").where(~F.coalesce(is_card_entry(F.col("nf"), entity), F.lit(False)))
    rows = rows.where(~F.coalesce(norm(F.col("category")).isin(*NOT_FISCAL), F.lit(False)))
    rows = rows.withColumn("period", period(F.coalesce("entry_date", "issue_date"))).where(F.col("period").isNotNull())
    return rows.withColumns({"entity_norm": entity, "nf_clean": clean_number(F.col("nf"))})


def on_days(rows: DataFrame, days: list[int]) -> DataFrame:
    """Rows entered on one of the days of a month; rows without an entry date never are."""
    return rows.where(F.dayofmonth("entry_date").isin(days))


def notes(lines: DataFrame) -> DataFrame:
    """One note for each (period, nf, entity): its first line's header, the sum and the list of its items.

    One shuffle; the first line is chosen by min_by, so nothing is sorted but a note's own items.
    """
    header = F.struct("nf_clean", "category", "header_cents", "issue_date", "entry_date", "due_date", "branch", *[c for c in ("entity_id",) if c in lines.columns])
    item = F.when(F.col("item_cents") > 0, F.struct("seq", "item_cents"))
    grouped = payable(lines).groupBy("period", "nf", "entity_norm").agg(F.min("seq").alias("seq"), F.min_by(header, "seq").alias("h"), F.sum("item_cents").alias("item_sum"), F.array_sort(F.collect_list(item)).alias("i"))
    return grouped.select("seq", "period", "nf", F.col("entity_norm").alias("entity"), "h.*", "item_sum", F.transform("i", lambda x: x["item_cents"]).alias("items"))


def month_listing(lines: DataFrame, month: str) -> DataFrame:
    """The first line of each (nf, entity) issued in a month; values keep their sign."""
    first = Window.partitionBy("nf", "entity").orderBy("seq")
    rows = lines.where(period(F.col("issue_date")) == month).withColumn("n", F.row_number().over(first))
    return rows.where("n = 1").drop("n")


def collisions(lines: DataFrame, number: Column) -> DataFrame:
    """Numbers that more than one entity uses, by number of entities: sums and counts of lines."""
    per_entity = lines.groupBy(number.alias("nf"), "entity").agg(F.sum("header_cents").alias("cents"), F.count("*").alias("n"))
    every = per_entity.groupBy("nf").agg(F.count("*").alias("entities"), F.sum("cents").alias("cents"), F.sum("n").alias("lines"))
    return every.where("entities > 1").orderBy(F.desc("entities"), "nf")


def search(lines: DataFrame, target: str) -> DataFrame:
    """Lines that hold the target, with why: the number as it stands or cleaned, the entity's code, or a part of its name."""
    reason = F.when((F.col("nf") == target) | (clean_number(F.col("nf")) == target), "number").when(F.col("entity_code") == target, "code").when(F.contains(F.upper("entity"), F.lit(target.upper())), "entity")
    return lines.withColumn("reason", reason).where(F.col("reason").isNotNull())
