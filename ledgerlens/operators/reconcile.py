"""The whole reconciliation of a month, in the order of a sequential pass.

Every period is a run of its own over its documents and over all notes:

1. Its notes, by seq, each take the best free document of the month by number. A document worth more than the note may
   be the bill of several: the note, and free notes of the month whose entity matches the emitter. A bill takes them at
   once, so they neither ask later nor can be had by others.
2. Card statements and taxes among the other documents stand by themselves.
3. The remaining documents, by doc_seq, each take the first free note by number in any period, by day, by value and
   entity; it may be a bill in the same way. One without a note may still be the bill of free notes of the month.

What can depend on each other shares a document, a note or the notes of an entity, so the connected components of that
graph are independent, and each is passed through in order within one task. Notes that are alike in all that decides are
one class, as are documents: a class wants classes, and its members go first come, first served, so many equal notes
and documents are one edge and not a product. Step 3 wants groups of notes that are alike by day and value, whatever
their numbers; a note is listed under each of its groups that is wanted. Components come in two turns, one for step 1 and one for step 3.

A component with more facts than `most` is not given to one task. Its first askers are cut off, as many as `most`
allows; what they can touch is bounded by their number, and the rest waits for the next turn.

Defined cases: notes without a number ask for nothing; a note that step 3 takes stays listed as missing a document, since
its own number found none, unless a bill took it; values of nothing or below are no bills; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections import namedtuple
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import period as period_of
from ..functions.predicates import TOLERANCE, is_card_file, is_tax
from .graph import components
from .matching import fallback_wishes, fewest, name_pairs, note_groups, number_pairs, with_agreement, with_kin, with_names

#: Facts of a component that one task takes at most, some 100 bytes each.
MOST = 1_000_000
#: Facts that are unpacked together at most, unless a component alone has more.
UNPACKED = 50_000
#: Notes that a bill chooses from.
POOL = 12
NOTE_FACTS = ["period", "nf_clean", "entity", "entity_id", "category", "header_cents", "item_sum", "items", "entry_date"]
DOC_FACTS = ["period", "nf", "nf_alt", "order_nr", "emitter", "emitter_id", "cents", "kind", "doc_date"]
#: What with_names() adds, written with the rows so that names are normalised once.
DOC_NAMES = ["emitter_name", "emitter_core"]

FACT = "struct<kind:string,id:bigint,cls:bigint,name:string,a:bigint,b:bigint,c:bigint,text:string,basis:string,agrees:boolean,cents:bigint>"
Fact = namedtuple("Fact", ["kind", "id", "cls", "name", "a", "b", "c", "text", "basis", "agrees", "cents"])
SETTLED = "doc_seq bigint, seq bigint, via string, basis string, kind_agrees boolean, taken array<bigint>, numbers string"


def classed(rows: DataFrame, order: str, facts: list[str], keep) -> DataFrame:
    """rows with cls, the least `order` among those that are alike in all facts; rows are made once and written."""
    alike = keep(rows.withColumn("_alike", F.md5(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}).cast("binary"))))
    first = alike.groupBy("_alike").agg(F.min(order).alias("cls"))
    return alike.join(first, "_alike").drop("_alike")


def fact(kind: str, id_: Column, cls: Column, name=None, a=None, b=None, c=None, text=None, basis=None, agrees=None, cents=None) -> Column:
    values = {"kind": F.lit(kind), "id": id_, "cls": cls, "name": name, "a": a, "b": b, "c": c, "text": text, "basis": basis, "agrees": agrees, "cents": cents}
    return F.struct(*[(F.lit(None) if v is None else v).alias(k) for k, v in values.items()]).cast(FACT)


def node(kind: str, *keys) -> Column:
    """A node's number; two nodes of one number only join their components."""
    return F.xxhash64(F.lit(kind), *keys)


# -- one component, in order


class Component:
    """The facts of one component: members of classes in order, what classes want, and which notes a name may bill."""

    def __init__(self, facts: list[Fact]):
        self.docs: dict[int, list[int]] = {}
        self.notes: dict[int, list[int]] = {}
        self.note: dict[int, Fact] = {}
        self.wants: dict[int, dict] = {}
        self.entities: dict[str, list[str]] = {}
        self.of_entity: dict[str, list[int]] = {}
        self.lone: dict[int, str] = {}
        self.cents: dict[int, int] = {}
        self.turn: tuple[int, int] | None = None
        for f in sorted(facts, key=lambda f: (f.kind, f.id, f.cls or 0)):
            kind, cls = f.kind, f.cls
            if kind == "doc":
                self.docs.setdefault(cls, []).append(f.id)
                self.cents[f.id], self.lone[f.id] = f.cents, f.name
            elif kind == "note":
                self.notes.setdefault(cls, []).append(f.id)
                self.note[f.id] = f
                if f.name is not None and (f.cents or 0) > 0:
                    self.of_entity.setdefault(f.name, []).append(f.id)
            elif kind == "want":
                self.wants.setdefault(f.id, {}).setdefault((f.a, f.b, f.c), []).append(f)
            elif kind == "name":
                self.entities.setdefault(f.name, []).append(f.text)
            elif kind == "turn":
                self.turn = (cls, f.id)
        self.used: set[int] = set()
        self.out: list[tuple] = []

    def first_free(self, members: list[int], taken: set[int]) -> int | None:
        """The least free member; those before it are gone for good and leave the list."""
        while members and members[-1] in taken:
            members.pop()
        return members[-1] if members else None

    def pick(self, cls: int, members: dict[int, list[int]], taken: set[int]):
        """The first free member of the best class that cls wants, with the want."""
        groups = self.wants.get(cls, {})
        for place in sorted(groups):
            free = [(m, i) for i, w in enumerate(groups[place]) if (m := self.first_free(members.get(w.cls, []), taken)) is not None]
            if free:
                m, i = min(free)
                return m, groups[place][i]
        return None, None

    def billed(self, name: str | None, cents: int, base: int | None) -> list[int] | None:
        """The notes that a bill stands for, base among them; they are used from now on."""
        if name is None or name not in self.entities:
            return None
        free = heapq.merge(*[self.open_notes(e) for e in self.entities[name]])
        pool = ([] if base is None else [base]) + list(islice((n for n in free if n != base), POOL - (base is not None)))
        if len(pool) < 2:
            return None
        places = fewest([self.note[n].cents or 0 for n in pool], cents, base is not None)
        if places is None:
            return None
        some = [pool[i] for i in places]
        self.used.update(some)
        return some

    def open_notes(self, entity: str) -> Iterator[int]:
        every = self.of_entity.get(entity, [])
        if len(every) > 64 and sum(n in self.used for n in every[:64]) > 32:
            every = self.of_entity[entity] = [n for n in every if n not in self.used]
        return (n for n in every if n not in self.used)

    def settle(self, doc: int, seq: int | None, want: Fact | None, some: list[int] | None) -> None:
        numbers = ", ".join(x for n in some if (x := self.note[n].text)) if some else None
        self.out.append((doc, seq, *((want.text, want.basis, want.agrees) if want else ("consolidated", None, True)), some, numbers))

    def by_notes(self) -> list[tuple]:
        """Notes take documents."""
        gone: set[int] = set()
        for members in self.docs.values():
            members.sort(reverse=True)
        askers = sorted((n, cls) for cls, members in self.notes.items() if cls in self.wants for n in members)
        for n, cls in askers:
            if n in self.used or self.turn and not self.turn[0] <= n <= self.turn[1]:
                continue
            doc, want = self.pick(cls, self.docs, gone)
            if doc is None:
                continue
            gone.add(doc)
            self.used.add(n)
            self.settle(doc, n, want, self.billed(want.name, want.cents, n))
        return self.out

    def by_documents(self) -> list[tuple]:
        """Documents take notes, or bill some."""
        for members in self.notes.values():
            members.sort(reverse=True)
        for doc, cls in sorted((d, cls) for cls, members in self.docs.items() for d in members):
            n, want = self.pick(cls, self.notes, self.used)
            if n is not None:
                self.used.add(n)
                self.settle(doc, n, want, self.billed(want.name, want.cents, n))
            elif (self.cents[doc] or 0) > 0 and (some := self.billed(self.lone[doc], self.cents[doc], None)):
                self.settle(doc, some[0], None, some)
        return self.out


def alone(facts: list[Fact]) -> tuple | None:
    """What becomes of one document and one note with one want between them, the most frequent component by far."""
    doc, note, want = sorted(facts, key=lambda f: f.kind)
    if (doc.kind, note.kind, want.kind) == ("doc", "note", "want") and {want.id, want.cls} == {doc.cls, note.cls}:
        return doc.id, note.id, want.text, want.basis, want.agrees, None, None
    return None


def passed(facts: DataFrame, way: str) -> DataFrame:
    """(doc_seq, seq, via, basis, kind_agrees, taken, numbers) from facts (component, fact), a component in one task."""
    fields = [("doc_seq", pa.int64()), ("seq", pa.int64()), ("via", pa.string()), ("basis", pa.string()), ("kind_agrees", pa.bool_()), ("taken", pa.list_(pa.int64())), ("numbers", pa.string())]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("facts")
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            i = 0
            while i < len(lists):  # some components at a time, column by column, so that few are unpacked at once
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + UNPACKED, "right")) - 1)
                columns = lists.slice(i, j - i).flatten().flatten()
                rows = list(map(Fact._make, zip(*[c.to_pylist() for c in columns], strict=True)))
                out: list[tuple] = []
                for k in range(i, j):
                    own = rows[ends[k] - ends[i] : ends[k + 1] - ends[i]]
                    if len(own) == 3 and (one := alone(own)):
                        out.append(one)
                    else:
                        out += getattr(Component(own), way)()
                i = j
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    grouped = facts.groupBy("component").agg(F.collect_list("fact").alias("facts")).select("facts")
    return grouped.mapInArrow(solve, SETTLED)


def settled(facts: DataFrame, way: str, keep, most: int) -> DataFrame:
    """What passed() gives, with components of more than `most` facts taken in turns."""
    asker, asked = ("note", "doc") if way == "by_notes" else ("doc", "note")
    sizes = facts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).select("component")
    large = keep(sizes)
    if large.isEmpty():
        return passed(facts, way)
    out = passed(facts.join(large, "component", "left_anti"), way)
    rest = keep(facts.join(large, "component"))
    past = large.withColumn("past", F.lit(None).cast("bigint"))
    q = max(1, most // 64)
    # an asker takes one document, or as many notes as a bill has
    takes = q if way == "by_notes" else q * POOL

    def first(rows: DataFrame, n: int, *by: str) -> DataFrame:
        place = Window.partitionBy(*by).orderBy("fact.id")
        return rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= n).select("component", "fact")

    def of(kind: str) -> DataFrame:
        return rest.where(F.col("fact.kind") == kind)

    while True:
        able = of(asker)
        if way == "by_notes":
            able = able.withColumn("cls", F.col("fact.cls")).join(of("want").select("component", F.col("fact.id").alias("cls")).distinct(), ["component", "cls"], "left_semi")
        able = able.join(past, "component").where(F.col("past").isNull() | (F.col("fact.id") > F.col("past")))
        now = keep(first(able, q, "component"))
        if now.isEmpty():
            return out
        ends = now.groupBy("component").agg(F.max("fact.id").alias("id"), F.min("fact.id").alias("a"))
        wants = of("want").withColumn("id", F.col("fact.id")).join(now.select("component", F.col("fact.cls").alias("id")).distinct(), ["component", "id"], "left_semi").select("component", "fact")
        wanted = of(asked).withColumn("cls", F.col("fact.cls")).join(wants.select("component", F.col("fact.cls").alias("cls")).distinct(), ["component", "cls"], "left_semi")
        names = wants.unionByName(now).select("component", F.col("fact.name").alias("name")).where("name is not null").distinct()
        named = of("name").withColumn("name", F.col("fact.name")).join(names, ["component", "name"], "left_semi").select("component", "fact")
        pools = of("note").withColumn("entity", F.col("fact.name")).join(named.select("component", F.col("fact.text").alias("entity")).distinct(), ["component", "entity"], "left_semi")
        parts = [now, wants, named, first(wanted, takes, "component", "cls"), first(pools, (q + 1) * POOL, "component", "entity")]
        parts.append(ends.select("component", fact("turn", F.col("id"), F.col("a")).alias("fact")))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        done = keep(passed(every.distinct(), way))
        out = out.unionByName(done)
        past = keep(past.join(ends.select("component", "id"), "component").select("component", F.col("id").alias("past")))
        notes = done.select(F.explode(F.concat(F.array("seq"), F.coalesce("taken", F.array().cast("array<bigint>")))).alias("id"))
        gone = notes.select(F.lit("note").alias("kind"), "id").union(done.select(F.lit("doc"), "doc_seq")).distinct()
        rest = keep(rest.withColumns({"kind": F.col("fact.kind"), "id": F.col("fact.id")}).join(gone, ["kind", "id"], "left_anti").select("component", "fact"))


# -- the graph of a turn


def joined(facts: list[tuple[DataFrame, Column, Column]], edges: DataFrame, keep) -> DataFrame:
    """(component, fact) of frames, each with a node and a fact of its rows."""
    of = keep(components(edges, keep))
    rows = None
    for df, at, what in facts:
        part = df.select(at.alias("node"), what.alias("fact"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(of, "node").select("component", "fact")


def billing(pairs: DataFrame) -> Column:
    """The name whose notes a match may be the bill of, or NULL."""
    name = F.coalesce(F.nullif(F.col("emitter"), F.lit("")), F.nullif(F.col("entity"), F.lit("")))
    return F.when(F.col("basis").isNull() & (F.col("cents") > F.coalesce("header_cents", F.lit(0)) + TOLERANCE), name)


def pools(bills: DataFrame, notes: DataFrame) -> DataFrame:
    """(period, name, entity): whose free notes the bills (period, name) choose from."""
    able = notes.where("header_cents > 0 and entity <> ''")
    matching = name_pairs(bills.select("name").distinct(), able.select(F.col("entity").alias("name")))
    return bills.distinct().join(matching.withColumnsRenamed({"a": "name", "b": "entity"}), "name").join(able.select("period", "entity").distinct(), ["period", "entity"]).select("period", "name", "entity")


def seated(rows: DataFrame, pool: DataFrame, own: Column, here: Column | None = None) -> DataFrame:
    """rows (period, entity, header_cents) with `at`: the pool of their entity that they can be billed from, else their own node.

    Notes of a pool depend on each other anyway, so they are that one node and no edges.
    """
    keys = pool.select("period", "entity").distinct().withColumn("_pooled", F.lit(True))
    pooled = F.col("_pooled") & (F.col("header_cents") > 0) & (F.lit(True) if here is None else here)
    return rows.join(keys, ["period", "entity"], "left").withColumn("at", F.when(pooled, node("pool", "period", "entity")).otherwise(own)).drop("_pooled")


def by_number(notes: DataFrame, docs: DataFrame, keep, most: int) -> DataFrame:
    """Step 1: notes (cls and NOTE_FACTS) take documents of their month by number."""
    pairs = number_pairs(notes.where("seq = cls"), docs.where("doc_seq = cls"))
    wants = pairs.withColumn("bill", billing(pairs)).groupBy("seq", "doc_seq", "period").agg(
        F.min("tier").alias("tier"), F.max("score").alias("score"), F.when(F.min("rank") < 2, "nf").otherwise("ocp").alias("via"), F.min("basis").alias("basis"), F.max("kind_agrees").alias("agrees"), F.min("bill").alias("bill"), F.max("cents").alias("cents"), F.min("entity").alias("entity"), F.min("header_cents").alias("header_cents"),
    )
    wants = keep(wants)
    pool = keep(pools(wants.where("bill is not null").select("period", F.col("bill").alias("name")), notes))
    at_pool = node("pool", "period", "entity")
    wants = seated(wants, pool, node("note", "seq"))
    edges = wants.select(F.col("at").alias("a"), node("doc", "doc_seq").alias("b"))
    billed = wants.select("period", F.col("bill").alias("name"), "doc_seq").where("name is not null")
    edges = keep(edges.union(billed.join(pool, ["period", "name"]).select(node("doc", "doc_seq"), at_pool)).distinct())
    facts = [
        (seated(notes, pool, node("note", "cls")), F.col("at"), note_fact()),
        (docs, node("doc", "cls"), fact("doc", F.col("doc_seq"), F.col("cls"), cents=F.col("cents"))),
        (wants, F.col("at"), want_fact("seq", "doc_seq", F.col("tier"), -F.col("score"), F.when(F.col("via") == "nf", 0).otherwise(1))),
        (pool, at_pool, name_fact()),
    ]
    return settled(joined(facts, edges, keep), "by_notes", keep, most)


def by_fallback(docs: DataFrame, notes: DataFrame, free: DataFrame, keep, most: int) -> DataFrame:
    """Step 3: the remaining docs (cls and DOC_FACTS) take notes of any period; free are those of their own that step 1 left."""
    some = keep(docs.groupBy("cls").agg(F.min_by(F.struct(*[c for c in docs.columns if c != "cls"]), "doc_seq").alias("d")).select("d.*", "cls"))
    alike = keep(with_kin(notes.where("seq = cls").drop("cls")))
    wishes = fallback_wishes(some.drop("doc_seq").withColumnRenamed("cls", "doc_seq"), alike)
    d = with_names(some.withColumnRenamed("period", "run").drop("doc_seq").withColumnsRenamed({"cls": "doc_seq"}), "emitter")
    n = with_names(alike, "entity").withColumnRenamed("kin_name", "family")
    pairs = with_agreement(wishes.join(d.drop("nf", "nf_alt"), "doc_seq").join(n, "seq"))
    wants = keep(pairs.select("run", "period", "doc_seq", "grp", "family", "wish", "via", "basis", F.col("kind_agrees").alias("agrees"), "cents", "entity", "header_cents", billing(pairs).alias("bill")))
    lone = some.where("cents > 0 and emitter <> ''").select("period", F.col("emitter").alias("name"), "cls")
    bills = wants.where("bill is not null").select(F.col("run").alias("period"), F.col("bill").alias("name"), F.col("doc_seq").alias("cls")).unionByName(lone)
    pool = keep(pools(bills.select("period", "name"), free))
    at_pool = node("pool", "period", "entity")
    at_note = node("note", "run", "family")
    edges = seated(wants, pool, at_note, F.col("run") == F.col("period")).select(node("doc", "doc_seq").alias("a"), F.col("at").alias("b"))
    edges = keep(edges.union(bills.join(pool, ["period", "name"]).select(node("doc", "cls"), at_pool)).distinct())
    # the wanted groups' classes; all groups of a note lie in one family, those that are alike by name
    wanted = wants.select("run", F.col("period").alias("of"), "grp", "family").distinct()
    wanted = keep(wanted.join(alike.select(F.col("seq").alias("cls"), F.explode(note_groups()).alias("grp")), "grp"))
    own = free.join(wanted.where("run = of and grp % 3 <> 0"), "cls").drop("cls").withColumnRenamed("grp", "cls")
    # of a family of another month no more can be taken than documents want it
    asking = wants.where("run <> period").select("run", "family", "doc_seq").distinct().join(docs.groupBy(F.col("cls").alias("doc_seq")).agg(F.count("*").alias("n")), "doc_seq")
    asking = asking.groupBy("run", "family").agg(F.sum("n").alias("most"))
    place = F.row_number().over(Window.partitionBy("run", "grp").orderBy("seq"))
    away = notes.join(wanted.where("run <> of").join(asking, ["run", "family"]), "cls").withColumn("place", place).where(F.col("place") <= F.col("most")).drop("cls").withColumnRenamed("grp", "cls")
    least = alike.select(F.col("seq").alias("cls"), F.col("kin_name").alias("family"))
    every = free.join(least, "cls").withColumns({"run": F.col("period"), "cls": F.col("cls") * 3})
    facts = [
        (docs, node("doc", "cls"), fact("doc", F.col("doc_seq"), F.col("cls"), name=F.when(F.col("emitter") != "", pool_name("period", "emitter")), cents=F.col("cents"))),
        (seated(every, pool, at_note), F.col("at"), note_fact()),
        (seated(own, pool, at_note), F.col("at"), note_fact(pooled=False)),
        (away, at_note, note_fact(pooled=False)),
        (wants, node("doc", "doc_seq"), want_fact("doc_seq", "grp", F.col("wish.leg"), F.col("wish.a"), F.col("wish.b"), period="run")),
        (pool, at_pool, name_fact()),
    ]
    return settled(joined(facts, edges, keep), "by_documents", keep, most)


def pool_name(period: str, name: str) -> Column:
    return F.concat_ws("\0", period, name)


def note_fact(pooled: bool = True) -> Column:
    return fact("note", F.col("seq"), F.col("cls"), name=pool_name("period", "entity") if pooled else None, text=F.col("nf"), cents=F.col("header_cents"))


def want_fact(asker: str, asked: str, a: Column, b: Column, c: Column, period: str = "period") -> Column:
    bill = F.when(F.col("bill").isNotNull(), pool_name(period, "bill"))
    return fact("want", F.col(asker), F.col(asked), name=bill, a=a, b=b, c=c, text=F.col("via"), basis=F.col("basis"), agrees=F.col("agrees"), cents=F.col("cents"))


def name_fact() -> Column:
    return fact("name", F.lit(None), F.lit(None), name=pool_name("period", "name"), text=pool_name("period", "entity"))


# -- all of it


def reconciled(notes: DataFrame, docs: DataFrame, keep, most: int = MOST) -> DataFrame:
    """(period, doc_seq, seq, via, basis, kind_agrees, members, status): what became of every document and note of each period.

    A match has a note and a document: via is nf or ocp (step 1), nf-global, date or value-entity (step 3), or consolidated
    for a bill without a note of its own, whose seq is its first member. members are the numbers that a bill stands for.
    Status: ok; differs, if value or kind do; other month, if step 3 found a note issued in another month and neither side
    is due in this one. Documents alone are card, tax or no note, notes alone no document. A note has due_date and
    issue_date and a document due_date if there are such columns.
    """
    has = lambda df, c, kind="date": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    n = notes.select("seq", "nf", *NOTE_FACTS, has(notes, "issue_date").alias("issue_date"), has(notes, "due_date").alias("due_date"))
    n = keep(classed(with_names(n, "entity"), "seq", NOTE_FACTS, keep))
    d = docs.select("doc_seq", "file", *DOC_FACTS, has(docs, "due_date").alias("due_date"))
    d = with_names(d, "emitter")
    d = keep(classed(d.withColumn("apart", F.when(is_card_file(F.col("file")), "card").when(is_tax(F.col("kind"), F.col("nf"), F.col("emitter"), F.col("file")), "tax")), "doc_seq", DOC_FACTS, keep))
    first = keep(by_number(n, d.select("doc_seq", "cls", *DOC_FACTS, *DOC_NAMES), keep, most))
    rest = d.join(first.select("doc_seq"), "doc_seq", "left_anti")
    plain = keep(rest.where("apart is null"))
    spent = first.select(F.explode(F.concat(F.array("seq"), F.coalesce("taken", F.array().cast("array<bigint>")))).alias("seq")).distinct()
    free = keep(n.join(spent, "seq", "left_anti"))
    # the least remaining document speaks for its class, whatever the least of all was
    later = keep(by_fallback(plain.select("doc_seq", "cls", *DOC_FACTS, *DOC_NAMES), n, free, keep, most))
    matches = first.withColumn("step", F.lit(1)).unionByName(later.withColumn("step", F.lit(3)))
    about = n.select("seq", F.coalesce(period_of(F.col("issue_date")), "period").alias("issued"), period_of(F.col("due_date")).alias("note_due"))
    run = d.select("doc_seq", "period", "cents", period_of(F.col("due_date")).alias("doc_due"))
    rows = matches.join(run, "doc_seq").join(about, "seq")
    differs = (F.col("via") != "consolidated") & ((F.col("basis").isNull() & (F.col("cents") > 0) & F.col("numbers").isNull()) | ~F.coalesce("kind_agrees", F.lit(True)))
    due_here = F.coalesce(F.col("doc_due") == F.col("period"), F.lit(False)) | F.coalesce(F.col("note_due") == F.col("period"), F.lit(False))
    other = (F.col("step") == 3) & (F.col("via") != "consolidated") & (F.col("issued") != F.col("period")) & ~due_here
    found = rows.select("period", "doc_seq", "seq", "via", "basis", "kind_agrees", F.col("numbers").alias("members"), F.when(differs, "differs").when(other, "other month").otherwise("ok").alias("status"))
    blank = {"basis": F.lit(None).cast("string"), "kind_agrees": F.lit(None).cast("boolean"), "members": F.lit(None).cast("string")}
    none = F.lit(None).cast("string")
    alone = rest.join(later.select("doc_seq"), "doc_seq", "left_anti").select("period", "doc_seq", F.lit(None).cast("bigint").alias("seq"), none.alias("via"), F.coalesce("apart", F.lit("no note")).alias("status")).withColumns(blank)
    # a note is missing in its own month, whatever documents of other months took it for
    billed = later.where("taken is not null").join(run, "doc_seq").select("period", F.explode("taken").alias("seq"))
    missing = free.join(billed, ["period", "seq"], "left_anti").select("period", F.lit(None).cast("bigint").alias("doc_seq"), "seq", none.alias("via"), F.lit("no document").alias("status")).withColumns(blank)
    return found.unionByName(alone).unionByName(missing)
