"""Matching documents with ledger notes: candidates, one-to-one assignment, fallbacks, consolidation.

Notes carry seq, documents doc_seq; lower numbers choose first. A document is found by its number, its
alternative number or its purchase order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import TOLERANCE, first_words, kind_ok, ledger_kind, names_match, same_entity, value_basis
from ..functions.text import digits, entity_core, norm, norm_company
from .graph import components

#: Characters of a company's name that files are looked up by, and of a name that other names are looked up by.
GRAM, NAME_GRAM = 4, 24


def with_names(df: DataFrame, column: str) -> DataFrame:
    """A name normalised and its core as columns, computed once a row before any join; columns that are there stay."""
    if {f"{column}_name", f"{column}_core"} <= set(df.columns):
        return df
    return df.withColumns({f"{column}_name": norm(F.col(column)), f"{column}_core": entity_core(F.col(column))})


def with_agreement(pairs: DataFrame) -> DataFrame:
    """Value basis, kind and entity agreement of joined notes and documents, which carry with_names()."""
    return pairs.withColumns({
        "basis": value_basis(F.col("cents"), F.col("header_cents"), F.col("item_sum"), F.col("items")),
        "kind_agrees": kind_ok(F.col("kind"), ledger_kind(F.col("category"))),
        "entity_agrees": same_entity(F.col("emitter_name"), F.col("emitter_id"), F.col("entity_name"), F.col("entity_id"), F.col("emitter_core"), F.col("entity_core")),
    })


def document_keys(docs: DataFrame) -> DataFrame:
    """A row for each number that finds a document; via tells which."""
    keys = F.array(F.struct(F.col("nf").alias("key"), F.lit(0).alias("rank")), F.struct(F.col("nf_alt").alias("key"), F.lit(1).alias("rank")), F.struct(F.col("order_nr").alias("key"), F.lit(2).alias("rank")))
    rows = docs.withColumn("k", F.explode(F.filter(keys, lambda k: k["key"].isNotNull())))
    return rows.select(*docs.columns, F.col("k.key").alias("key"), F.col("k.rank").alias("rank"))


def number_pairs(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """Notes and documents of one period that share a number and pass the entity guard, with rank, tier and score.

    Tier 0: the entities agree, or the document names none and its value does not disagree. Tier 1: only
    the value agrees. A note without an entity takes any. Within a tier the better score goes first, then
    the earlier document; availability never changes this order, so it is a fixed list of preferences.
    """
    d = document_keys(with_names(docs, "emitter")).withColumnsRenamed({"nf": "doc_nf", "period": "doc_period"})
    n = with_names(notes, "entity")
    pairs = with_agreement(n.join(d, (n.nf_clean == d.key) & (n.period == d.doc_period)))
    named = F.col("emitter").isNotNull() | F.col("emitter_id").isNotNull()
    value_ok = F.col("basis").isNotNull()
    compatible = F.when(F.coalesce(F.col("entity"), F.lit("")) == "", True).when(named, F.col("entity_agrees")).otherwise((F.coalesce("cents", F.lit(0)) <= 0) | value_ok)
    pairs = pairs.withColumn("tier", F.when(compatible, 0).when(value_ok, 1)).where(F.col("tier").isNotNull())
    pairs = pairs.withColumn("score", F.when(value_ok, 2).otherwise(0) + F.when(F.col("kind_agrees"), 1).otherwise(0))
    return pairs


def number_candidates(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """number_pairs() once a pair, with its best tier and score and what found it."""
    via = F.when(F.min("rank") < 2, "nf").otherwise("ocp").alias("via")
    pairs = number_pairs(notes, docs)
    return pairs.groupBy("seq", "doc_seq", "period").agg(F.min("tier").alias("tier"), F.max("score").alias("score"), via, F.min("basis").alias("basis"))


def preference(*extra: str) -> list[Column]:
    return [F.col("tier"), F.desc("score"), F.when(F.col("via") == "nf", 0).otherwise(1), F.col("doc_seq"), *[F.col(x) for x in extra]]


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Each note's first choice, whoever else wants the document."""
    rank = Window.partitionBy("seq").orderBy(*preference())
    return candidates.withColumn("n", F.row_number().over(rank)).where("n = 1").drop("n")


#: Wishes of a component that one task takes at most.
MOST_WISHES = 1_000_000


def assign(candidates: DataFrame, keep, most: int = MOST_WISHES) -> DataFrame:
    """One document for each note, one note for each document, earlier notes first.

    Notes and documents that are connected by wishes are passed through in order within one task, whatever their
    contention; a component of more than `most` wishes goes by rounds of joins instead. keep() cuts the lineage.
    """
    rank = Window.partitionBy("seq").orderBy(*preference())
    wishes = keep(candidates.withColumn("n", F.row_number().over(rank)))
    at = F.xxhash64(F.lit("note"), "seq")
    of = components(wishes.select(at.alias("a"), F.xxhash64(F.lit("document"), "doc_seq").alias("b")), keep)
    rows = keep(wishes.withColumn("node", at).join(of, "node").drop("node"))
    large = keep(rows.groupBy("component").agg(F.count("*").alias("wishes")).where(F.col("wishes") > most).select("component"))
    small = rows.join(large, "component", "left_anti").groupBy("component").agg(F.collect_list(F.struct("seq", "n", "doc_seq")).alias("wishes")).select("wishes")

    def settle(batches):
        for batch in batches:
            notes, docs = [], []
            for found in batch.column(0):
                taken, served = set(), set()
                for seq, _, doc in sorted((w["seq"], w["n"], w["doc_seq"]) for w in found.as_py()):
                    if seq not in served and doc not in taken:
                        served.add(seq)
                        taken.add(doc)
                        notes.append(seq)
                        docs.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(notes, pa.int64()), pa.array(docs, pa.int64())], names=["seq", "doc_seq"])

    settled = wishes.join(small.mapInArrow(settle, "seq bigint, doc_seq bigint"), ["seq", "doc_seq"]).drop("n")
    if large.isEmpty():
        return settled
    rest = assign_in_rounds(rows.join(large, "component").drop("component"), keep)
    return settled.unionByName(rest.select(*settled.columns))


def assign_in_rounds(wishes: DataFrame, keep) -> DataFrame:
    """The same for wishes numbered by n, without a bound on a component.

    The sequential pass equals deferred acceptance with documents that prefer earlier notes: every free note
    asks for its next choice, a document keeps the earliest asker, the refused ask on. Rounds end when none
    is refused.
    """
    at = keep(wishes.groupBy("seq").agg(F.lit(1).alias("n")))
    while True:
        asked = wishes.join(at, ["seq", "n"])
        held = asked.groupBy("doc_seq").agg(F.min("seq").alias("winner"))
        judged = keep(asked.join(held, "doc_seq").withColumn("won", F.col("seq") == F.col("winner")).drop("winner"))
        if judged.where(~F.col("won")).isEmpty():
            return judged.drop("n", "won")
        at = keep(judged.select("seq", F.when(F.col("won"), F.col("n")).otherwise(F.col("n") + 1).alias("n")))


def first_for_document(pairs: DataFrame, *order: str) -> DataFrame:
    """Each document's first pair, whoever else wants the note."""
    place = Window.partitionBy("doc_seq").orderBy(*order)
    return pairs.withColumn("n", F.row_number().over(place)).where("n = 1").drop("n")


def global_number_pairs(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_seq, seq, rank, tier): notes of any period by number, alternative number, then order."""
    d = document_keys(with_names(docs, "emitter")).withColumnsRenamed({"nf": "doc_nf", "period": "doc_period"})
    n = with_names(notes, "entity")
    pairs = with_agreement(d.join(n, d.key == n.nf_clean))
    named = F.col("emitter").isNotNull() | F.col("emitter_id").isNotNull()
    value_ok = F.col("basis").isNotNull()
    compatible = F.when(named, (F.coalesce(F.col("entity"), F.lit("")) == "") | F.col("entity_agrees")).otherwise((F.coalesce("cents", F.lit(0)) <= 0) | value_ok)
    pairs = pairs.withColumn("tier", F.when(compatible, 0).when(named & value_ok, 1)).where(F.col("tier").isNotNull())
    return pairs.select("doc_seq", "seq", "rank", "tier")


def global_number_match(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """A document's first note of any period by number, alternative number, then order."""
    return first_for_document(global_number_pairs(docs, notes), "rank", "tier", "seq")


def agreeing_documents(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """docs once for each key (kind, key) that finds notes of an agreeing entity: its tax id, and each entity's name that its emitter's matches."""
    names = name_pairs(docs.select(F.col("emitter").alias("name")), notes.select(F.col("entity").alias("name")))
    keys = F.array(F.struct(F.lit("name").alias("by"), F.col("emitter").alias("own")), F.struct(F.lit("id").alias("by"), F.col("emitter_id").alias("own")))
    rows = docs.withColumn("k", F.explode(F.filter(keys, lambda k: k["own"].isNotNull()))).select(*docs.columns, "k.*")
    found = rows.join(names.select(F.lit("name").alias("by"), F.col("a").alias("own"), F.col("b").alias("entity")), ["by", "own"], "left")
    return found.withColumn("key", F.when(F.col("by") == "id", F.col("own")).otherwise(F.col("entity"))).where("key is not null").drop("own", "entity")


#: What of a note decides by day and by value, and whether kinds agree; its number and tax id do not where names match.
KIN_FACTS = ["period", "entity", "category", "header_cents", "item_sum", "items", "entry_date"]


def with_kin(notes: DataFrame) -> DataFrame:
    """Notes with kin_name and kin_id, the least seq of those that are alike in KIN_FACTS, and in their tax id besides."""
    alike = lambda *facts: F.md5(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}).cast("binary"))
    rows = notes.withColumns({"_name": alike(*KIN_FACTS), "_id": alike(*KIN_FACTS, "entity_id")})
    for by in ("name", "id"):
        rows = rows.join(rows.groupBy(f"_{by}").agg(F.min("seq").alias(f"kin_{by}")), f"_{by}")
    return rows.drop("_name", "_id")


def agreeing_notes(notes: DataFrame) -> DataFrame:
    """Notes with an entity once for each of their keys (by, key): the entity's name and its tax id.

    Where with_kin() was taken before, the first of those that are alike by a key stands for them.
    """
    kin = {"kin_name", "kin_id"} <= set(notes.columns)
    first = {by: F.col("seq") == F.col(f"kin_{by}") if kin else F.lit(True) for by in ("name", "id")}
    keys = F.array(*[F.struct(F.lit(by).alias("by"), F.when(first[by], F.col(key)).alias("key")) for by, key in (("name", "entity"), ("id", "entity_id"))])
    rows = notes.where("entity <> ''").withColumn("k", F.explode(F.filter(keys, lambda k: k["key"].isNotNull())))
    return rows.select("*", "k.by", "k.key").drop("k")


def band_pairs(docs: DataFrame, notes: DataFrame, days: int = 3, first: bool = False) -> DataFrame:
    """(doc_seq, seq, by) of documents without number and order: notes of the month entered within some days, entity and value agreeing.

    A document is listed under each day of its band and each entity's name that its emitter's matches, so the join is on
    period, day and entity. For the first notes alone, those that are alike in all of this and in their values are one.
    """
    d = docs.where("nf is null and order_nr is null and doc_date is not null").select("doc_seq", "period", "doc_date", "emitter", "emitter_id", "cents")
    d = agreeing_documents(d, notes).withColumn("day", F.explode(F.sequence(F.date_sub("doc_date", days), F.date_add("doc_date", days))))
    facts = ["period", "by", "key", F.col("entry_date").alias("day"), "header_cents", "item_sum", "items"]
    n = agreeing_notes(notes).select("seq", *facts)
    if first:
        n = n.groupBy(*[c for c in n.columns if c != "seq"]).agg(F.min("seq").alias("seq"))
    pairs = d.join(n, ["period", "by", "key", "day"])
    return pairs.where(value_basis(F.col("cents"), F.col("header_cents"), F.col("item_sum"), F.col("items")).isNotNull()).select("doc_seq", "seq", "by")


def band_match(docs: DataFrame, notes: DataFrame, days: int = 3) -> DataFrame:
    """The first note of each document that has no number at all."""
    return band_pairs(docs.where("nf_alt is null"), notes, days, first=True).groupBy("doc_seq").agg(F.min("seq").alias("seq"))


#: Cents that are looked up together, so that few values have a neighbour within the tolerance elsewhere.
SPAN = 64


def value_entity_pairs(docs: DataFrame, notes: DataFrame, first: bool = False) -> DataFrame:
    """(doc_seq, seq, place, by): notes of an exact value and an agreeing entity.

    Place 0 is in the document's own month, by any value of the note; place 1 in any month, by header. Both are one
    join on month, entity and a span of cents: a note is listed under each of its values, a document under the spans
    that the tolerance touches. For the first notes alone, those of one month, entity and value are one.
    """
    d = docs.where("cents > 0 and (emitter is not null or emitter_id is not null)").select("doc_seq", "period", "emitter", "emitter_id", "cents")
    spans = lambda c: F.array_distinct(F.array(F.floor((c - TOLERANCE) / SPAN), F.floor((c + TOLERANCE) / SPAN)))
    asked = F.concat(
        F.transform(spans(F.col("cents")), lambda s: F.struct(F.lit(0).alias("place"), F.col("period").alias("month"), s.alias("span"))),
        F.array(F.struct(F.lit(1).alias("place"), F.lit("").alias("month"), F.floor(F.col("cents") / SPAN).alias("span"))),
    )
    d = agreeing_documents(d, notes).withColumn("at", F.explode(asked)).select("doc_seq", "by", "key", "cents", "at.*")
    values = F.filter(F.array_distinct(F.concat(F.array("header_cents", "item_sum"), "items")), lambda v: v > 0)
    listed = F.concat(
        F.transform(values, lambda v: F.struct(F.lit(0).alias("place"), F.col("period").alias("month"), v.alias("value"))),
        F.filter(F.array(F.struct(F.lit(1).alias("place"), F.lit("").alias("month"), F.col("header_cents").alias("value"))), lambda x: x["value"] > 0),
    )
    n = agreeing_notes(notes).withColumn("at", F.explode(listed)).select("seq", "by", "key", "at.*")
    if first:
        n = n.groupBy("by", "key", "place", "month", "value").agg(F.min("seq").alias("seq"))
    pairs = d.join(n.withColumn("span", F.floor(F.col("value") / SPAN)), ["by", "key", "place", "month", "span"])
    return pairs.where(F.abs(F.col("cents") - F.col("value")) <= F.when(F.col("place") == 0, TOLERANCE).otherwise(0)).select("doc_seq", "seq", "place", "by")


def value_entity_recovery(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """Documents whose number fails: the first note of an exact value and an agreeing entity."""
    best = value_entity_pairs(docs, notes, first=True).groupBy("doc_seq").agg(F.min(F.struct("place", "seq")).alias("b"))
    return best.select("doc_seq", "b.seq", "b.place")


def note_groups() -> Column:
    """The groups of a note (seq, kin_name, kin_id) that wishes name: itself, those alike by name, those alike by tax id."""
    return F.array(F.col("seq") * 3, F.col("kin_name") * 3 + 1, F.col("kin_id") * 3 + 2)


def fallback_wishes(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_seq, seq, grp, via, wish): all notes (with_kin()) a document may take when the month's numbers fail, in its order of wishes.

    First by number in any period, then by day, then by value and entity. Notes that are alike for a leg are one wish,
    for the group grp of note_groups() whose least note is seq, so many equal notes and documents are no product.
    A group that several legs find is wished once.
    """
    wish = lambda leg, a, b: F.struct(F.lit(leg).alias("leg"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.col("seq"))
    none = F.lit(0)
    grp = (F.col("seq") * 3 + F.when(F.col("by") == "name", 1).otherwise(2)).alias("grp")
    pairs = global_number_pairs(docs, notes).select("doc_seq", "seq", (F.col("seq") * 3).alias("grp"), wish(0, F.col("rank"), F.col("tier")).alias("wish"))
    pairs = pairs.unionByName(band_pairs(docs, notes).select("doc_seq", "seq", grp, wish(1, none, none).alias("wish")))
    pairs = pairs.unionByName(value_entity_pairs(docs, notes).select("doc_seq", "seq", grp, wish(2, F.col("place"), none).alias("wish")))
    best = pairs.groupBy("doc_seq", "seq", "grp").agg(F.min("wish").alias("wish"))
    names = F.array(F.lit("nf-global"), F.lit("date"), F.lit("value-entity"))
    return best.select("doc_seq", "seq", "grp", F.get(names, F.col("wish.leg")).alias("via"), "wish")


def consolidation(bills: DataFrame, notes: DataFrame, most: int = 12) -> DataFrame:
    """The fewest notes of a bill's entity and period, two at least, that add up to it.

    Of an entity's notes the first `most` are tried, each subset by its bits: the fewest members and then the
    lowest number win. A sum may miss by two cents a member and one more. The feature bounds the subsets.
    """
    pool = Window.partitionBy("period", "entity").orderBy("seq")
    members = notes.where("header_cents > 0").withColumn("n", F.row_number().over(pool)).where(F.col("n") <= most)
    grouped = members.groupBy("period", "entity").agg(F.array_sort(F.collect_list(F.struct("seq", "nf", "header_cents"))).alias("pool")).where(F.size("pool") >= 2)
    rows = bills.where("cents > 0").join(grouped, ["period", "entity"])

    @F.pandas_udf("array<int>")
    def places(values: pd.Series, cents: pd.Series) -> pd.Series:
        return pd.Series([fewest(list(v), int(c), False) for v, c in zip(values, cents, strict=True)], dtype=object)

    rows = rows.withColumn("best", places(F.transform("pool", lambda x: x["header_cents"]), "cents")).where(F.col("best").isNotNull())
    chosen = F.transform("best", lambda i: F.get("pool", i)["nf"])
    return rows.select(*bills.columns, F.size("best").alias("members"), F.array_join(chosen, ", ").alias("numbers"))


def fewest(values: list[int], cents: int, forced: bool) -> list[int] | None:
    """Places of the fewest values, two at least, that add up to cents within two each and one; the first is in if forced.

    Of equally few the lowest number in bits wins. All subsets are summed at once.
    """
    sums, sizes = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for v in values:
        sums, sizes = np.concatenate([sums, sums + v]), np.concatenate([sizes, sizes + 1])
    fits = (sizes >= 2) & (np.abs(sums - cents) <= sizes * TOLERANCE + 1)
    if forced:
        fits[::2] = False
    at = np.flatnonzero(fits)
    if not len(at):
        return None
    mask = int(at[np.argmin(sizes[at])])
    return [i for i in range(len(values)) if mask >> i & 1]




def annotated(results: DataFrame, alerts: DataFrame, links: DataFrame) -> DataFrame:
    """Results with false alerts by (period, nf, file, entity) and manual links by (period, nf, entity); absent parts are empty."""

    def noted(rows: DataFrame, notes: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
        said = notes.groupBy(*[F.coalesce(k, F.lit("")).alias(f"_{k}") for k in keys]).agg(F.lit(True).alias("_noted"), *[F.min(c).alias(to) for c, to in values.items()])
        here = rows.withColumns({f"_{k}": F.coalesce(k, F.lit("")) for k in keys})
        return here.join(said, [f"_{k}" for k in keys], "left").drop(*[f"_{k}" for k in keys])

    out = noted(results, alerts, ["period", "nf", "file", "entity"], {"reason": "reason"}).withColumnRenamed("_noted", "false_alert")
    out = noted(out, links, ["period", "nf", "entity"], {"entry": "link_entry"}).withColumnRenamed("_noted", "linked")
    return out.withColumns({"false_alert": F.coalesce("false_alert", F.lit(False)), "linked": F.coalesce("linked", F.lit(False))})


def name_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): the distinct names of two frames (name) that match.

    Two names match only if one holds the other's first words or core, so it holds the first NAME_GRAM characters
    of them: an equi-join of all stretches of a name with the beginnings of the others.
    """
    l, r = (with_names(df.select("name").distinct(), "name").withColumnsRenamed({"name_name": "n", "name_core": "core"}) for df in (left, right))

    def lookups(df: DataFrame) -> DataFrame:
        short = F.array(F.struct(F.lit(0).alias("kind"), first_words(F.col("n")).alias("part")), F.struct(F.lit(1).alias("kind"), F.col("core").alias("part")))
        parts = df.select("name", F.explode(short).alias("s")).where("s.part <> ''")
        return parts.select(F.col("name").alias("short"), "s.kind", F.left("s.part", F.lit(NAME_GRAM)).alias("gram")).distinct()

    def holders(df: DataFrame, lengths: DataFrame) -> DataFrame:
        every = F.array(F.struct(F.lit(0).alias("kind"), F.col("n").alias("part")), F.struct(F.lit(1).alias("kind"), F.col("core").alias("part")))
        parts = df.select("name", F.explode(every).alias("s")).where("s.part <> ''").select("name", "s.*").join(F.broadcast(lengths), "kind").where("length(part) >= length")
        grams = F.expr("array_distinct(transform(sequence(1, length(part) - length + 1), i -> substring(part, i, length)))")
        return parts.select(F.col("name").alias("long"), "kind", F.explode(grams).alias("gram"))

    def found(long: DataFrame, short: DataFrame) -> DataFrame:
        asked = lookups(short)
        lengths = asked.select("kind", F.length("gram").alias("length")).distinct()  # two kinds of NAME_GRAM lengths at most
        return holders(long, lengths).join(asked, ["kind", "gram"]).select("long", "short").distinct()

    pairs = found(l, r).select(F.col("long").alias("a"), F.col("short").alias("b")).union(found(r, l).select(F.col("short").alias("a"), F.col("long").alias("b"))).distinct()
    both = pairs.join(l.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("core").alias("ca")), "a").join(r.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("core").alias("cb")), "b")
    return both.where(names_match(F.col("na"), F.col("nb"), F.col("ca"), F.col("cb"))).select("a", "b")


def company_match(docs: DataFrame, companies: DataFrame) -> DataFrame:
    """Each document's company: the first by id that its tax id, emitter or file name names.

    Tax ids are compared by their digits, names without accents, case and signs. A file name holds a company's
    name at any place, within a longer word too. Three equi-joins: where the file holds the name it has the
    name's first GRAM characters, or a shorter name whole.
    """
    c = companies.select("company_id", "name", digits("tax_id").alias("c_id"), norm_company(F.col("name")).alias("c_name"))
    named = c.where("c_name <> ''").withColumn("gram", F.substring("c_name", 1, GRAM))
    columns = [*docs.columns, "company_id", "name"]
    by_id = docs.withColumn("c_id", digits("emitter_id")).where("c_id <> ''").join(c.where("c_id <> ''"), "c_id")
    by_name = docs.withColumn("c_name", norm_company(F.col("emitter"))).where("c_name <> ''").join(named, "c_name")
    lengths = named.select(F.length("gram").alias("length")).distinct()
    files = docs.withColumn("in_file", norm_company(F.col("file"))).where("in_file <> ''").crossJoin(F.broadcast(lengths))
    # a row for each place, cut by substring(): a list of the distinct grams of each file costs more than the grams that it spares
    places = files.where("length(in_file) >= length").withColumn("at", F.explode(F.sequence(F.lit(1), F.expr("length(in_file) - length + 1"))))
    by_file = places.withColumn("f_gram", F.expr("substring(in_file, at, length)")).join(named, (F.col("f_gram") == F.col("gram")) & F.contains("in_file", "c_name"))
    every = by_id.select(columns).unionByName(by_name.select(columns)).unionByName(by_file.select(columns))
    return every.groupBy("doc_seq").agg(F.min_by(F.struct(*columns), "company_id").alias("r")).select("r.*")
