"""Every query of the document-to-ledger operators against its SQL, and worked cases of single rules."""

import datetime
import io
import math
import random
import re
import zipfile
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import dates, predicates, text
from ledgerlens.operators import classify, extract, graph, ledger, matching, reconcile, reports, store
import ledgerlens.plans.documents  # noqa: F401  registers its queries
from ledgerlens.plans.catalogue import ORACLE_SQL, QUERIES, STATUSES, keep
from ledgerlens.sources import csv, files, workbook
from ledgerlens.streaming import ingest

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def shown(rows, columns):
    place = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(repr([plain(row[i]) for i in place]) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert shown(got.collect(), got.columns) == shown(found.fetchall(), columns)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_assignment_equals_the_sequential_pass(spark):
    rows = [(r.seq, r.doc_seq, r.tier, r.score, r.via) for r in QUERIES["number_candidates"](spark, SMALL).collect()]
    # contention: many notes want few documents
    rows += [(10**9 + n, d, (n + d) % 2, (n * d) % 3, "nf") for n in range(40) for d in range(-1 - n % 7, -12, -1)]
    df = spark.createDataFrame(rows, "seq long, doc_seq long, tier int, score int, via string")
    taken, want = set(), {}
    for seq in sorted({r[0] for r in rows}):
        for r in sorted((r for r in rows if r[0] == seq), key=lambda r: (r[2], -r[3], r[4] != "nf", r[1])):
            if r[1] not in taken:
                taken.add(r[1])
                want[seq] = r[1]
                break
    for most in (matching.MOST_WISHES, 20):  # the crowd goes by rounds where 20 wishes are the most
        got = matching.assign(df, keep, most)
        assert got.columns == df.columns and {r.seq: r.doc_seq for r in got.collect()} == want


def test_summary_adds_up(spark):
    """Each status against the rows, and the rows against the tables."""
    counts = {r.status: r.n for r in QUERIES["reconcile_summary"](spark, SMALL).collect()}
    rows = QUERIES["reconcile_rows"](spark, SMALL).collect()
    assert {r.doc_seq for r in rows} - {None} == {r.doc_seq for r in QUERIES["filename_extract"](spark, SMALL).collect()}
    assert len({r.doc_seq for r in rows if r.doc_seq is not None}) == sum(r.doc_seq is not None for r in rows)
    want = Counter(x for r in rows for x in (r.via, r.status, "bill" if r.members else None) if x)
    assert counts == {s: want[s] for s in STATUSES}


@pytest.mark.parametrize(
    ("doc", "header", "items", "want"),
    [(10000, 10002, [], "header"), (133360, 400000, [], "instalment 3x"), (10000, 30000, [10000, 20000], "item"), (30000, 99999, [10000, 20000], "items"), (0, 0, [], None), (None, 5, [], None), (10000, 250000, [], None), (8250, 150000, [], None)],
)
def test_value_basis(spark, doc, header, items, want):
    arr = F.array(*[F.lit(v).cast("bigint") for v in items]) if items else F.array().cast("array<bigint>")
    assert one(spark, predicates.value_basis(F.lit(doc).cast("bigint"), F.lit(header).cast("bigint"), F.lit(sum(items)).cast("bigint"), arr)) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("ALFA", "ALFA REDES S.A. 02.328.280/0001-97", True), ("Alfa  Beta Gama", "ALFA BETA GAMA LTDA", True), ("ALFA", "BETA", False), ("", "BETA", False), (None, "BETA", False)],
)
def test_names(spark, a, b, want):
    assert one(spark, predicates.names_match(F.lit(a).cast("string"), F.lit(b))) == want


@pytest.mark.parametrize(
    ("name", "number", "emitter", "day"),
    [
        ("2026.05.15, ACME CORP, NF 0012.pdf", "12", "ACME CORP", "2026-05-15"),
        ("037.DOC- 1780,00 - 202605.15. ACME. NF 22.pdf", "22", "ACME", None),
        ("006.DOC- 72,66-2026-05-17- ACME - NF 3.pdf", "3", "ACME", None),
        ("NAME . 503843.pdf", "503843", None, None),
        ("NAME 12.pdf", None, None, None),
    ],
)
def test_file_names(spark, name, number, emitter, day):
    row = spark.createDataFrame([(name,)], "f string").select(text.number_in_file(F.col("f")).alias("n"), text.emitter_in_file(F.col("f")).alias("e"), dates.file_date(F.col("f")).cast("string").alias("d")).first()
    assert (row.n, row.e, row.d) == (number, emitter, day)


@pytest.mark.parametrize(
    ("page", "emitter", "want"),
    [("DANFE emitido para a Prefeitura", "PREFEITURA DE X", "NF"), ("Rua do Estado de Minas, nota fiscal", "ACME", "NF"), ("sem marca", "Governo", "IMPOSTO"), (None, None, "Não identificado"), ("", None, "Não identificado")],
)
def test_kinds(spark, page, emitter, want):
    df = spark.createDataFrame([(page, emitter)], "t string, e string")
    assert df.select(classify.classified(F.col("t"), F.col("e"))["kind"].alias("k")).first().k == want


def test_notes_of_items_and_of_an_empty_ledger(spark):
    schema = "seq long, orig string, nf string, entity string, category string, header_cents long, item_cents long, issue_date date, entry_date date, due_date date, branch string"
    rows = [(i, "CP", "NF007", "Alfa  Ltda", "FATURA", 30000, 10000, None, None, None, "1") for i in range(3)]
    df = spark.createDataFrame(rows, schema).withColumn("issue_date", F.lit("2026-05-04").cast("date"))
    note = ledger.notes(df).first()
    assert (note.header_cents, note.item_sum, note["items"], note.nf_clean, note.entity) == (30000, 30000, [10000] * 3, "7", "ALFA LTDA")
    assert ledger.notes(spark.createDataFrame([], schema)).collect() == []


def test_bill_of_three_notes(spark):
    notes = spark.createDataFrame([(i, "p", "e", str(i), c) for i, c in enumerate([10000, 10432, 10400, 7])], "seq long, period string, entity string, nf string, header_cents long")
    bills = spark.createDataFrame([("p", "e", 30832), ("p", "e", 5)], "period string, entity string, cents long")
    assert [(r.cents, r.members, r.numbers) for r in matching.consolidation(bills, notes).collect()] == [(30832, 3, "0, 1, 2")]


def test_companies_by_normalised_names(spark):
    """Accents, case, signs, names inside a longer word, names shorter than a gram, ids by digits."""
    companies = spark.createDataFrame([(1, "São Paulo", None), (2, "Santander", None), (3, "OI", None), (4, "Alfa & Beta", "02.328.280/0001-97"), (5, "-", None), (6, None, "1")], "company_id long, name string, tax_id string")
    docs = [(1, "SAO PAULO", None, "x.pdf"), (2, None, None, "GRUPOSANTANDER.pdf"), (3, None, None, "nota são-paulo 1.pdf"), (4, None, None, "fatura oi.pdf"), (5, "alfa beta", None, "y.pdf"), (6, None, "02328280000197", "z.pdf"), (7, "-", None, "-.pdf"), (8, None, "", "santand er"), (9, None, None, None), (10, "OI", None, "santander")]
    got = matching.company_match(spark.createDataFrame(docs, "doc_seq long, emitter string, emitter_id string, file string"), companies)
    assert {r.doc_seq: r.company_id for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 3, 5: 4, 6: 4, 10: 2}


def test_instalments_replace_a_file(spark):
    schema = "report_type string, period string, file string, folder string, seq long"
    old = spark.createDataFrame([("M", "05", "x.pdf", "f", 1), ("M", "05", "y.pdf", "f", 2), ("M", "05", "x.pdf", "g", 3), ("M", "04", "x.pdf", "f", 7), ("C", "05", "x.pdf", "f", 8)], schema)
    new = spark.createDataFrame([("M", "05", "x.pdf#p1", "f", 4), ("M", "05", "x.pdf#p2", "f", 5), ("M", "05", "x.pdf#p2", "f", 6)], schema)
    assert sorted(r.seq for r in reports.upserted(old, new).collect()) == [2, 3, 4, 6, 7, 8]


def test_posted_reports(spark):
    """A daily report is replaced whole; a monthly one loses deleted rows and takes the others by key, instalments or not."""
    schema = "report_type string, period string, file string, folder string, seq long"
    old = spark.createDataFrame([("D", "01", "a", "f", 1), ("D", "02", "a", "f", 2), ("M", "05", "a", "f", 3), ("M", "05", "b", "f", 4), ("M", "05", "c", "f", 5), ("M", "04", "b", "f", 6)], schema)
    new = spark.createDataFrame([("D", "01", "z", "f", 7), ("M", "05", "c", "f", 8), ("M", "05", "a#p1", "f", 9)], schema)
    gone = spark.createDataFrame([("M", "05", "b", "f")], "report_type string, period string, file string, folder string")
    assert sorted(r.seq for r in reports.posted(old, new, gone).collect()) == [2, 3, 6, 7, 8, 9]


def test_annotation_store(spark):
    schema = "period string, key string, reason string, seq long"
    old = spark.createDataFrame([("05", "a", "x", 1), ("05", "b", "x", 2), ("04", "a", "x", 3)], schema)
    new = spark.createDataFrame([("05", "a", "y", 4), ("05", "a", "z", 5), ("05", "", "no", 6), (None, "c", "no", 7)], schema)
    gone = spark.createDataFrame([("05", "b"), ("04", "b")], "period string, key string")
    assert {(r.period, r.key, r.reason) for r in reports.annotated_store(old, new, gone).collect()} == {("05", "a", "z"), ("04", "a", "x")}


def test_annotations_of_other_months_do_not_count(spark):
    rows = spark.createDataFrame([(1, "05", "7", "f", None), (2, "05", None, "f", "e")], "id long, period string, nf string, file string, entity string")
    alerts = spark.createDataFrame([("05", "7", "f", "", "a"), ("04", "7", "f", None, "b"), ("03", "", "f", "e", "c"), ("05", "", "f", "e", "d"), ("05", None, "f", "e", "e")], "period string, nf string, file string, entity string, reason string")
    links = spark.createDataFrame([("05", "", "e", "in"), ("04", "7", "", "in")], "period string, nf string, entity string, entry string")
    assert {(r.id, r.false_alert, r.reason, r.linked) for r in matching.annotated(rows, alerts, links).collect()} == {(1, True, "a", False), (2, True, "d", True)}


# -- the whole reconciliation against a sequential pass


def plain_norm(s):
    return " ".join((s or "").upper().split())


def plain_core(s):
    s = plain_norm(s)
    for p in (rf"\b{text.TAX_ID}\b", rf"\b{text.PERSON_ID}\b", rf"\b(?:{text.CORE_NOISE})\b", r"[.,/\-]"):
        s = re.sub(p, " ", s)
    return " ".join(s.split())


def plain_names(a, b):
    a, b = plain_norm(a), plain_norm(b)
    if not a or not b:
        return False
    wa, wb = (" ".join(x.split(" ")[:3]) for x in (a, b))
    ca, cb = plain_core(a), plain_core(b)
    return a == b or wa == wb or wb in a or wa in b or bool(ca and cb and (ca in cb or cb in ca))


def plain_entity(d, n):
    return (d["emitter_id"] is not None and d["emitter_id"] == n["entity_id"]) or plain_names(d["emitter"], n["entity"])


def plain_exact(c, n):
    return "header" if n["header_cents"] > 0 and abs(c - n["header_cents"]) <= 2 else "items" if n["item_sum"] > 0 and abs(c - n["item_sum"]) <= 2 else "item" if any(abs(c - v) <= 2 for v in n["items"]) else None


def plain_basis(c, n):
    c, h = c or 0, n["header_cents"]
    if c <= 0:
        return None
    if found := plain_exact(c, n):
        return found
    even = [k for k in range(2, 25) if abs(c * k - h) * 10 <= k * 15 + 20]
    if h > c and even:
        return f"instalment {even[0]}x"
    k = (h * 2 + c) // (c * 2)
    return f"instalment {k}x" if h * 2 > c * 3 and 2 <= k <= 24 and abs(h - k * c) * 100 <= c else None


def plain_kind(d, n):
    k, want = plain_norm(d["kind"]), predicates.KINDS.get(plain_norm(n["category"]))
    return not want or not k or want == "*" or k == want or k == "NÃO IDENTIFICADO" or (k in ("NF", "NFS") and want in ("NF", "NFS", "FATURA"))


def plain_subset(pool, cents, forced):
    best = None
    for mask in range(1, 1 << len(pool)):
        some = [n for i, n in enumerate(pool) if mask >> i & 1]
        if len(some) >= 2 and (not forced or mask & 1) and abs(sum(n["header_cents"] for n in some) - cents) <= 2 * len(some) + 1 and (best is None or len(some) < len(best)):
            best = some
    return best


def plain_reconciled(notes, docs):
    """A run for each period: note by note, document by document, with bills formed in between."""
    notes, docs = sorted(notes, key=lambda n: n["seq"]), sorted(docs, key=lambda d: d["doc_seq"])
    out = set()
    for run in sorted({x["period"] for x in notes + docs}):
        plain_run(run, [n for n in notes if n["period"] == run], notes, [d for d in docs if d["period"] == run], out)
    return out


def plain_run(run, own, notes, docs, out):
    keys = lambda d: [k for k in (d["nf"], d["nf_alt"], d["order_nr"]) if k is not None]
    named = lambda d: d["emitter"] is not None or d["emitter_id"] is not None
    month = lambda day: day and f"{day.month:02d}.{day.year}"
    gone, used, billed, missing = set(), set(), set(), []

    def bill(cents, name, base):
        if cents <= 0 or not name:
            return None
        pool = [n for n in own if n["header_cents"] > 0 and n["seq"] not in used and n["seq"] not in billed and n["entity"] and plain_names(name, n["entity"])]
        pool = (([base] if base else []) + pool)[:12]
        some = plain_subset(pool, cents, bool(base)) if len(pool) > 1 else None
        if some:
            used.update(n["seq"] for n in some)
            billed.update((n["period"], n["seq"]) for n in some)
        return some

    def match(d, n, via, later):
        gone.add(d["doc_seq"])
        used.add(n["seq"])
        basis, cents, some = plain_basis(d["cents"], n), d["cents"] or 0, None
        if cents > 0 and not basis and cents > n["header_cents"] + 2:
            some = bill(cents, d["emitter"] or n["entity"], n)
        differs = cents > 0 and not basis and not some or not plain_kind(d, n)
        other = later and (month(n["issue_date"]) or n["period"]) != run and run not in (month(d["due_date"]), month(n["due_date"]))
        numbers = ", ".join(x["nf"] for x in some if x["nf"]) if some else None
        out.add((run, d["doc_seq"], n["seq"], via, basis, plain_kind(d, n), numbers, "differs" if differs else "other month" if other else "ok"))

    for n in own:
        if n["seq"] in used:
            continue
        found = [(d, "nf" if n["nf_clean"] in (d["nf"], d["nf_alt"]) else "ocp") for d in docs if d["doc_seq"] not in gone and n["nf_clean"] is not None and n["nf_clean"] in keys(d)]
        if n["entity"]:
            good = [(d, how) for d, how in found if (plain_entity(d, n) if named(d) else (d["cents"] or 0) <= 0 or plain_basis(d["cents"], n))]
            found = good or [x for x in found if plain_basis(x[0]["cents"], n)]
        found.sort(key=lambda x: (x[1] != "nf", x[0]["doc_seq"]))
        best = None
        for d, how in found:
            score = 2 * bool(plain_basis(d["cents"], n)) + plain_kind(d, n)
            if best is None or score > best[2]:
                best = (d, how, score)
        if best:
            match(best[0], n, best[1], False)
        else:
            missing.append(n)
    for d in docs:
        if d["doc_seq"] in gone:
            continue
        alone = lambda status: out.add((run, d["doc_seq"], None, None, None, None, None, status))  # noqa: B023, E731
        if re.search(r"\bCC\s?\d{2,}\b|\bCART[ÃA]O\s+DE\s+CR[ÉE]DITO\b", (d["file"] or "").upper()):
            alone("card")
            continue
        if d["kind"] == "IMPOSTO" or re.match(r"90[34]9\d\d$", d["nf"] or "") or re.search("GOVERNO|PREFEITURA", (d["emitter"] or "").upper()) or re.search(r"\bGOVERNO\b", (d["file"] or "").upper()):
            alone("tax")
            continue
        pick, how, free, cents = None, None, [n for n in notes if n["seq"] not in used], d["cents"] or 0
        for key in keys(d):
            here = [n for n in free if n["nf_clean"] == key]
            if named(d):
                here = [n for n in here if not n["entity"] or plain_entity(d, n)] or [n for n in here if plain_basis(cents, n)]
            elif cents > 0:
                here = [n for n in here if plain_basis(cents, n)]
            if here:
                pick, how = here[0], "nf-global"
                break
        if not pick and d["nf"] is None and d["order_nr"] is None and d["doc_date"] is not None:
            here = [n for n in free if n["period"] == run and n["entity"] and abs((n["entry_date"] - d["doc_date"]).days) <= 3 and plain_entity(d, n) and plain_basis(cents, n)]
            pick, how = (here[0], "date") if here else (None, None)
        if not pick and named(d) and cents > 0:
            here = [n for n in free if n["entity"] and plain_entity(d, n) and plain_exact(cents, n)]
            here = [n for n in here if n["period"] == run] + [n for n in here if n["header_cents"] == cents]
            pick, how = (here[0], "value-entity") if here else (None, None)
        if pick:
            match(d, pick, how, True)
        elif d["emitter"] and cents > 0 and (some := bill(cents, d["emitter"], None)):
            out.add((run, d["doc_seq"], some[0]["seq"], "consolidated", None, True, ", ".join(x["nf"] for x in some if x["nf"]), "ok"))
        else:
            alone("no note")
    out |= {(run, None, n["seq"], None, None, None, None, "no document") for n in missing if (run, n["seq"]) not in billed}


def crowded(r, count):
    """Notes and documents of few numbers, names, days and values, so that most want the same."""
    names = ["ALFA REDES LTDA", "ALFA", "BETA S.A.", "GAMA COMERCIO", "", "DELTA 02.328.280/0001-97"]
    day = lambda: datetime.date(2026, 5, r.randrange(1, 9))
    notes, docs = [], []
    for i in range(count):
        items = [r.choice([1000, 2000, 3000, 4500]) for _ in range(r.randrange(1, 4))]
        notes.append({"seq": i, "period": r.choice(["05.2026", "06.2026"]), "nf": str(r.randrange(12)), "nf_clean": r.choice([str(r.randrange(1, 12)), None]), "entity": r.choice(names), "entity_id": r.choice([None, None, "1", "2"]), "category": r.choice(["FATURA", "NOTA FISCAL RFB", "X"]), "header_cents": r.choice([sum(items), 1000, 2000, 6000]), "item_sum": sum(items), "items": items, "entry_date": day(), "issue_date": r.choice([None, day(), datetime.date(2026, 4, 3)]), "due_date": r.choice([None, day(), datetime.date(2026, 6, 3)])})
        docs.append({"doc_seq": i, "period": r.choice(["05.2026", "06.2026"]), "nf": r.choice([None, str(r.randrange(1, 15)), "903912"]), "nf_alt": r.choice([None, None, str(r.randrange(1, 12))]), "order_nr": r.choice([None, None, str(r.randrange(1, 12))]), "emitter": r.choice([None, "ALFA", "BETA", "GAMA", "DELTA", "PREFEITURA"]), "emitter_id": r.choice([None, None, "1", "2"]), "cents": r.choice([None, 0, 1000, 2000, 3000, 5000, 6000, 8000, 500, 9000]), "kind": r.choice(["NF", "FATURA", "IMPOSTO", None, "NFS"]), "doc_date": r.choice([day(), None]), "file": r.choice(["a.pdf", "CC 278.pdf", "b.pdf", "c.pdf", "GOVERNO x.pdf"]), "due_date": r.choice([None, None, day()])})
    return notes, docs


NOTE_SCHEMA = "seq long, period string, nf string, nf_clean string, entity string, entity_id string, category string, header_cents long, item_sum long, items array<long>, entry_date date, issue_date date, due_date date"
DOC_SCHEMA = "doc_seq long, period string, nf string, nf_alt string, order_nr string, emitter string, emitter_id string, cents long, kind string, doc_date date, file string, due_date date"
ROW = ("period", "doc_seq", "seq", "via", "basis", "kind_agrees", "members", "status")


def run_reconciled(spark, notes, docs, most=reconcile.MOST, cut=keep):
    tuples = lambda rows, schema: [tuple(x.get(c.split()[0]) for c in schema.split(", ")) for x in rows]
    got = reconcile.reconciled(spark.createDataFrame(tuples(notes, NOTE_SCHEMA), NOTE_SCHEMA), spark.createDataFrame(tuples(docs, DOC_SCHEMA), DOC_SCHEMA), cut, most).collect()
    rows = {tuple(r[c] for c in ROW) for r in got}
    assert len(got) == len(rows)
    return rows


@pytest.mark.parametrize(("seed", "count", "most"), [(1, 70, reconcile.MOST), (2, 160, reconcile.MOST), (3, 90, 64)])
def test_reconciliation_equals_the_sequential_pass(spark, seed, count, most):
    notes, docs = crowded(random.Random(seed), count)
    want = plain_reconciled(notes, docs)
    assert run_reconciled(spark, notes, docs, most) == want
    assert {x[3] for x in want} >= {"nf", "value-entity", None} and {x[7] for x in want} >= {"card", "tax", "ok", "differs", "other month", "no document"} and any(x[6] for x in want)


def note(seq, nf, entity, cents, **more):
    return {"seq": seq, "period": "05.2026", "nf": nf, "nf_clean": nf, "entity": entity, "category": "X", "header_cents": cents, "item_sum": cents, "items": [cents], "entry_date": datetime.date(2026, 5, 4), "entity_id": None, "issue_date": None, "due_date": None} | more


def doc(seq, nf, emitter, cents, **more):
    return {"doc_seq": seq, "period": "05.2026", "nf": nf, "nf_alt": None, "order_nr": None, "emitter": emitter, "emitter_id": None, "cents": cents, "kind": "NF", "doc_date": None, "file": "a.pdf", "due_date": None} | more


def test_a_bill_takes_its_notes_at_once(spark):
    """The first document is the bill of both notes, so the second finds none; names need only match."""
    notes = [note(1, "1", "ALFA LTDA", 10000), note(2, "2", "ALFA LTDA", 20000)]
    docs = [doc(1, "1", "ALFA", 30000), doc(2, "2", "ALFA", 20000)]
    want = {("05.2026", 1, 1, "nf", None, True, "1, 2", "ok"), ("05.2026", 2, None, None, None, None, None, "no note")}
    assert plain_reconciled(notes, docs) == run_reconciled(spark, notes, docs) == want
    notes = [note(1, "1", "ALFA REDES LTDA", 10000), note(2, "2", "ALFA", 20000)]
    docs = [doc(1, "7", "ALFA", 30000)]
    want = {("05.2026", 1, 1, "consolidated", None, True, "1, 2", "ok")}
    assert plain_reconciled(notes, docs) == run_reconciled(spark, notes, docs) == want


def test_many_equal_contenders_need_no_more_rounds(spark):
    """Equal notes and documents are one class each; the number of written tables does not grow with theirs."""

    def rounds(count):
        cuts = []
        notes = [note(i, "1", "ALFA", 500) for i in range(count)] + [note(10_000 + i, None, "BETA", 700) for i in range(count)]
        docs = [doc(i, "1", "ALFA", 500) for i in range(count)] + [doc(10_000 + i, None, "BETA", 700) for i in range(count + 5)]
        rows = run_reconciled(spark, notes, docs, cut=lambda df: cuts.append(1) or keep(df))
        pairs = [(x[1], x[2]) for x in rows if x[1] is not None and x[2] is not None]
        assert sorted(pairs) == [(i, i) for i in range(count)] + [(10_000 + i, 10_000 + i) for i in range(count)]
        return len(cuts)

    assert rounds(1000) == rounds(3)


def test_reconciliation_of_nothing(spark):
    notes, docs = crowded(random.Random(4), 8)
    assert run_reconciled(spark, [], []) == set()
    for some in ((notes, []), ([], docs)):
        assert run_reconciled(spark, *some) == plain_reconciled(*some)


def test_fewest_members_equal_trying_all():
    r = random.Random(9)
    for _ in range(300):
        values, cents, forced = [r.randrange(0, 60) for _ in range(r.randrange(2, 10))], r.randrange(10, 200), r.random() < 0.5
        want = plain_subset([{"header_cents": v, "i": i} for i, v in enumerate(values)], cents, forced)
        assert matching.fewest(values, cents, forced) == (want and [x["i"] for x in want])


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_a_walk(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(25 + seed * 8)] + [(100 + i, 101 + i) for i in range(40)] + [(200, i) for i in range(201, 240)] + [(7, 7)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert dict(graph.components(spark.createDataFrame(edges, "a long, b long"), keep).collect()) == least


REPORT_SCHEMA = "seq bigint, file string, folder string, payload string, report_type string, period string"


def plain_upserts(rows):
    """Rows (seq, file, folder, payload, type, period) written one after the other."""
    left = {}
    for r in rows:
        base = re.sub(r"#p\d+$", "", r[1])
        at = lambda file: (r[4], r[5], file, r[2])  # noqa: B023, E731
        if base != r[1]:
            left.pop(at(base), None)
        else:
            for key in [k for k in left if (k[0], k[1], k[3]) == (r[4], r[5], r[2]) and k[2].startswith(f"{r[1]}#p")]:
                del left[key]
        left[at(r[1])] = r
    return sorted(left.values())


def report_rows(r, n, start=0):
    return [(start + i, r.choice("ab") + ".pdf" + r.choice(["", "#p1", "#p2"]), r.choice("fg"), f"x{i}", r.choice("MD"), r.choice(["05.2026", "06.2026", "07.2026"])) for i in range(n)]


@pytest.fixture
def report_store(spark, tmp_path):
    return store.ReportStore(spark, f"file://{tmp_path}", REPORT_SCHEMA, buckets=4)


def stored_rows(kept):
    return sorted(tuple(r[c] for c in ("seq", "file", "folder", "payload", "report_type", "period")) for r in kept.rows().collect())


def upsert(spark, kept, rows, *once):
    new = spark.createDataFrame(rows, REPORT_SCHEMA)
    return kept.change(new, lambda old: reports.upserted(old, new), *once)


def test_a_store_holds_what_was_written_in_order(spark, report_store):
    r, every = random.Random(5), []
    assert report_store.rows().collect() == []
    for k in range(3):
        rows = report_rows(r, 25, 100 * k)
        every += rows
        assert upsert(spark, report_store, rows) == k + 1
        assert stored_rows(report_store) == plain_upserts(every)


def test_lost_jobs_and_other_writers(spark, report_store, monkeypatch):
    rows, more, other = ([(i, f"{i}.pdf", "f", "x", "M", p)] for i, p in ((1, "05.2026"), (2, "05.2026"), (3, "06.2026")))
    upsert(spark, report_store, rows)
    before = stored_rows(report_store)

    def lost(_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # the rows are written and the version never is
        m.setattr(report_store, "publish", lost)
        with pytest.raises(RuntimeError):
            upsert(spark, report_store, more)
    assert stored_rows(report_store) == before
    assert report_store.vacuum() == 1 and stored_rows(report_store) == before
    real, tried = report_store.publish, []

    def second(version):  # another writer is first, once
        if not tried:
            tried.append(1)
            upsert(spark, store.ReportStore(spark, report_store.root, REPORT_SCHEMA, 4), other)
        real(version)

    monkeypatch.setattr(report_store, "publish", second)
    assert upsert(spark, report_store, more) == 3
    assert stored_rows(report_store) == plain_upserts(rows + other + more)


def test_a_numbered_change_is_applied_once(spark, report_store):
    rows = [(1, "1.pdf", "f", "x", "M", "05.2026")]
    append = lambda: report_store.change(new, lambda old: old.drop("base").unionByName(new), "stream", 7)
    new = spark.createDataFrame(rows, REPORT_SCHEMA)
    assert [append(), append()] == [1, 1] and stored_rows(report_store) == rows
    gone = report_store.change(new, lambda old: old.where("false"))
    assert gone == 2 and stored_rows(report_store) == [] and report_store.version()["partitions"] == {}


def test_store_reads_are_pruned_and_joins_need_no_shuffle_of_it(spark, report_store):
    upsert(spark, report_store, report_rows(random.Random(6), 60))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    some = report_store.rows().where("report_type = 'M' and period = '05.2026'")
    assert some.inputFiles() and all("report_type=M/period=05.2026" in f for f in some.inputFiles())
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    try:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.requireAllClusterKeysForCoPartition", "false")):
            spark.conf.set(k, v)
        keys = spark.range(5).select(F.chr(F.lit(102) + F.col("id") % 2).alias("folder"), F.concat(F.col("id").cast("string"), F.lit(".pdf")).alias("base"))
        said = plan(report_store.rows().join(keys, ["folder", "base"], "left_anti"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "Bucketed: true" in said and said.count("Exchange hashpartitioning") == 1


MARK_TEXTS = [
    "consórcio x", "cota de consorcio", "DACTE", "CTE 1", "CT-e 1", "MDF-E 5", "mdfe", "conhecimento de transporte", "transporte rodoviario de cargas", "DARF", "arrecadacao de receitas federais", "guia da previdência social",
    "FGTS digital", "guia do FGTS", "GFD", "DARF-simples", "danfe", "documento auxiliar da nota fiscal eletroni", "documento auxiliar do conhecimento", "natureza da operação", "NFS-e", "NFSE", "nota fiscal de serviço eletrônica",
    "nota fiscal eletronica de servicos", "guia", "INSS", "GPS", "nota fiscal de serviços", "fatura", "nota fiscal", "recibo", "recibos", "xDARFx", "", None, "nosso numero", "ficha de compensação", "cedente", "linha digitável", "pagador", "beneficiário", "expresso", "transportadora", "logística", "rodoviário", "transportes",
]


def test_kept_tables_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(files, "_left", [])
    kept = files.kept(spark.range(3))
    assert kept.count() == 3 and files.discard(spark) == 1 and files.discard(spark) == 0
    with pytest.raises(Exception, match="FileNotFound|does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        kept.agg(F.sum("id")).collect()


def test_hints_lose_no_mark(spark):
    """Every pattern alone, with and without its hints, over texts that hold each of its forms."""
    texts = spark.createDataFrame([(t and f"a {t} b",) for t in MARK_TEXTS], "t string").select(text.norm_ascii(F.col("t")).alias("t"))
    columns = [c for i, p in enumerate(classify.HINTS) for c in (classify.holds(F.col("t"), p).alias(f"h{i}"), F.col("t").rlike(p).alias(f"p{i}"))]
    seen = set()
    for r in texts.select("t", *columns).collect():
        for i in range(len(classify.HINTS)):
            assert r[f"h{i}"] == r[f"p{i}"], (r.t, i)
            if r[f"p{i}"]:
                seen.add(i)
    assert seen == set(range(len(classify.HINTS)))


def test_cut_payload(spark):
    assert one(spark, extract.repaired(F.lit('{"rows":[{"k": 1},{"k": 2},{"k'))) == '{"rows":[{"k": 1},{"k": 2}]}'
    assert one(spark, extract.json_text(F.lit("no json"))) is None


def test_reports_as_csv(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 'say "x"'), ("line\nbreak", None), (" b ", ""), ("plain", "ção")], "file string, note string")
    csv.write(df.coalesce(1), str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*")
    assert part.read_bytes().decode() == '\ufefffile;note\r\n"a;b";"say ""x"""\r\n"line\nbreak";\r\n b ;\r\nplain;ção\r\n'
    assert {tuple(r) for r in csv.read(spark, str(tmp_path / "r"), "file string, note string").collect()} == {("a;b", 'say "x"'), ("line\nbreak", ""), (" b ", ""), ("plain", "ção")}


def book(rows, shared):
    """A workbook of one sheet; strings are shared, in line or plain."""
    strings, cells = [], []
    for n, row in enumerate(rows, start=1):
        out = []
        for k, v in enumerate(row):
            place = f"{chr(65 + k)}{n}"
            if isinstance(v, str) and shared:
                strings.append(v)
                out.append(f'<c r="{place}" t="s"><v>{len(strings) - 1}</v></c>')
            elif isinstance(v, str):
                out.append(f'<c r="{place}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif v is not None:
                out.append(f'<c r="{place}"><v>{v}</v></c>')
        cells.append(f'<row r="{n}">{"".join(out)}</row>')
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{''.join(cells)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>{''.join(f'<si><r><t>{s}</t></r></si>' for s in strings)}</sst>")
    return data.getvalue()


def test_ledger_workbooks(spark, tmp_path):
    head = ["ORIG", "NF", "ENTIDADE", "VL_TOTAL_CAB", "VL_ITEM", "DT_EMISSAO", "DT_LANCAMENTO", "TIPO"]
    rows = [["Title"], head, ["CP", "NF007", "Alfa 02.328.280/0001-97", -300.0, 100.1, 46146, 46150.5, "FATURA"], ["CP", 8, "Beta", "n/a", None, "x", None, "FATURA"], [], ["CR", "9", "Gama", 5, 5, 46146, None, "X"]]
    for i, shared in enumerate((True, False)):
        (tmp_path / f"b{i}.xlsx").write_bytes(book(rows, shared))
    (tmp_path / "empty.xlsx").write_bytes(book([], True))
    lines = workbook.ledger_lines(workbook.sheet_rows(spark, str(tmp_path)))
    got = sorted((r.path[-7:], r.seq, r.orig, r.nf, r.entity_id, r.header_cents, r.signed_cents, r.item_cents, str(r.issue_date), str(r.entry_date)) for r in lines.collect())
    want = [(2, "CP", "NF007", "02328280000197", 30000, -30000, 10010, "2026-05-04", "2026-05-08"), (3, "CP", "8", None, 0, 0, 0, "None", "None"), (5, "CR", "9", None, 500, 500, 500, "2026-05-04", "None")]
    assert got == [(f"b{i}.xlsx", *w) for i in (0, 1) for w in want]
    notes = ledger.notes(lines.where("path like '%b0.xlsx'")).collect()
    assert [(n.nf_clean, n.period, n.header_cents, n.entity_id) for n in notes] == [("7", "05.2026", 30000, "02328280000197")]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a" / "2026.05.04").mkdir(parents=True)
    for name in ("a/2026.05.04/x.PDF", "a/y.pdf", "a/z.txt"):
        (tmp_path / name).write_bytes(b"x")
    rows = files.listing(spark, str(tmp_path)).select("name", "folder", dates.folder_date(F.col("folder")).cast("string").alias("day")).collect()
    assert sorted(tuple(r) for r in rows) == [("x.PDF", "a/2026.05.04", "2026-05-04"), ("y.pdf", "a", None)]
    assert one(spark, files.is_picture(F.lit(" ab c \n"))) and not one(spark, files.is_picture(F.lit("a text of some length")))


def test_ingestion_takes_new_files_only(spark, tmp_path):
    root, seen = tmp_path / "in", []
    (root / "05").mkdir(parents=True)
    (root / "05" / "2026.05.04 , ACME , NF 1.txt").write_text("one")

    def sink(batch, _):
        seen.extend((r.name, r.folder, r.period, r.text) for r in batch.collect())

    for _ in range(2):
        ingest.run_once(ingest.filed(ingest.new_files(spark, str(root))), str(tmp_path / "check"), sink)
    assert seen == [("2026.05.04 , ACME , NF 1.txt", "05", "05.2026", "one")]
    (root / "05" / "later.txt").write_text("two")
    ingest.run_once(ingest.filed(ingest.new_files(spark, str(root))), str(tmp_path / "check"), sink)
    assert [x[3] for x in seen] == ["one", "two"]


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["nf", "entities", "cents", "lines"]
