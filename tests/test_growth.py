"""Work that must not grow with the square of a group: rows that joins make, and results that stay the same."""

from datetime import date

from ledgerlens.operators import matching

NOTE = "seq bigint, nf_clean string, period string, entity string, entity_id string, category string, header_cents bigint, item_sum bigint, items array<bigint>, entry_date date"
DOC = "doc_seq bigint, nf string, nf_alt string, order_nr string, emitter string, emitter_id string, cents bigint, kind string, doc_date date, period string"


def nodes(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    else:
        yield plan
        kids = plan.children()
        for i in range(kids.size()):
            yield from nodes(kids.apply(i))


def most_joined(df):
    """Rows of df, and the most rows that one of its joins made."""
    rows = df.collect()
    joins = [p.metrics().apply("numOutputRows").value() for p in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in p.getClass().getSimpleName()]
    return rows, max(joins)


def crowd(spark, n, cents=500):
    """n documents without numbers and n notes of one day and value: half of them of one name each, half of one name and 14-digit ids."""
    day = date(2026, 5, 10)
    name = lambda i: f"FIRM NUMBER{i:05d}" if i % 2 else "COMMON HOUSE"
    notes = [(i, str(i), "05.2026", name(i) + " LTDA", f"{i:014d}" if i % 4 == 0 else None, "FATURA", cents, cents, [cents], day) for i in range(n)]
    docs = [(i, None, None, None, name(i), None, cents, "FATURA", day, "05.2026") for i in range(n)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(notes, NOTE)


def test_days_are_joined_within_entities(spark):
    docs, notes = crowd(spark, 400)
    rows, most = most_joined(matching.band_match(docs, notes))
    assert {r.doc_seq: r.seq for r in rows} == {i: i if i % 2 else 0 for i in range(400)}
    assert most <= 4000


def test_values_are_joined_within_entities(spark):
    docs, notes = crowd(spark, 400)
    rows, most = most_joined(matching.value_entity_recovery(docs, notes))
    assert {r.doc_seq: (r.place, r.seq) for r in rows} == {i: (0, i if i % 2 else 0) for i in range(400)}
    assert most <= 4000


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_workbooks_are_not_made_group_by_group(spark):
    import __spark_entry__

    assert "FlatMapGroups" not in plan_of(__spark_entry__.queries()["workbook_lines"](spark, "/root/testdata/sf0.001"))


def test_answers_are_not_parsed_again_for_each_use(spark):
    from ledgerlens.operators import payload

    rows = spark.createDataFrame([(1, "a.pdf", '{"tipo": "NF"}')], "doc_seq bigint, file string, answer string")
    local = spark.createDataFrame([(1, "a.pdf", "RECIBO", None, None, 5)], "doc_seq bigint, file string, kind string, number string, due string, cents bigint")
    plan = plan_of(payload.answer_rows(rows, "answer", local))
    assert not [line for line in plan.splitlines() if "from_json" in line and "Filter" in line]


def test_rows_of_one_name_go_to_many_tasks(spark, tmp_path):
    import __spark_entry__

    spark.range(0, 40000, 100).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, 500, 100).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    df = __spark_entry__.queries()["entity_core_match"](spark, str(tmp_path))
    tasks = df.rdd.glom().map(len).collect()
    assert sum(tasks) == 400 * 5
    assert max(tasks) < 400


def test_marks_within_invented_prose_do_not_count(spark, tmp_path):
    import __spark_entry__

    prose = ["o inss da", "CT-E recibo", "lorem", "darf", "Danfe", "inß", None, "Prefeitura"]
    docs = [(i, t) for i in range(8) for t in prose]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.kind, r.origin) for r in __spark_entry__.queries()["classify_text"](spark, str(tmp_path)).collect()}
    assert found == {(0, "Não identificado", "none"), (1, "NF", "strong"), (2, "RECIBO", "weak"), (3, "IMPOSTO", "weak"), (4, "NFS", "strong"), (5, "FATURA", "weak"), (6, "CONSORCIO", "strong"), (7, "IMPOSTO", "emitter")}


def test_notes_of_a_pool_are_one_node_and_no_edges(spark):
    from ledgerlens.operators import reconcile
    from ledgerlens.sources.files import kept

    day, edges = date(2026, 5, 10), []
    notes = [(i, str(i), str(i), "05.2026", "ALFA LTDA", None, "FATURA", 100 + i, 100 + i, [100 + i], day) for i in range(40)]
    docs = [(1, "a.pdf", "0", None, None, "ALFA", None, 100 + 101, "FATURA", day, "05.2026")]

    def keep(df):
        out = kept(df)
        if set(out.columns) == {"a", "b"}:
            edges.append(out.count())
        return out

    rows = reconcile.reconciled(spark.createDataFrame(notes, NOTE.replace("nf_clean", "nf string, nf_clean", 1)), spark.createDataFrame(docs, DOC.replace("nf string", "file string, nf string", 1)), keep).collect()
    assert [(r.doc_seq, r.seq, r.members) for r in rows if r.doc_seq is not None] == [(1, 0, "0, 1")]
    assert sum(r.status == "no document" for r in rows) == 38
    assert edges and max(edges) <= 4


def test_items_are_not_dealt_again_by_customer(spark):
    from ledgerlens.plans.inputs import ledger_lines

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = ledger_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        dealt = [p for p in nodes(plan) if p.getClass().getSimpleName() == "ShuffleExchangeExec" and "custkey" in p.outputPartitioning().toString()]
        assert dealt and not [p for p in dealt if "l_extendedprice" in p.output().toString()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_files_are_looked_up_by_place(spark):
    """No list of grams is built and made distinct for each file; a name that stands in a file twice is one hit."""
    companies = spark.createDataFrame([(1, "Ana Ana", None), (2, "OI", None)], "company_id long, name string, tax_id string")
    docs = spark.createDataFrame([(1, None, None, "ANA ANA ANA ANA.pdf"), (2, None, None, "oi oi"), (3, None, None, "o"), (4, "OI", "", "ana")], "doc_seq long, emitter string, emitter_id string, file string")
    found = matching.company_match(docs, companies)
    assert sorted((r.doc_seq, r.company_id) for r in found.collect()) == [(1, 1), (2, 2), (4, 2)]
    assert "array_distinct" not in plan_of(found) and "transform(" not in plan_of(found)


def test_equal_notes_and_documents_of_other_numbers_are_no_product(spark):
    """Documents and notes of one day, value and name, but of numbers and tax ids of their own; each takes the first note left."""
    from ledgerlens.operators import reconcile
    from ledgerlens.sources.files import kept

    day, sizes, count = date(2026, 5, 10), [], 60
    notes = [(i, str(i), str(i), p, "ALFA LTDA", f"{i:014d}" if i % 4 == 0 else None, "FATURA", 500, 500, [500], day) for i, p in enumerate(["05.2026", "06.2026"] * (count // 2))]
    docs = [(i, f"{i}.pdf", f"9{i:03d}", None, None, "ALFA", f"{i:014d}" if i % 8 == 0 else None, 500, "FATURA", day, "05.2026") for i in range(count)]

    def keep(df):
        out = kept(df)
        sizes.append(out.count())
        return out

    rows = reconcile.reconciled(spark.createDataFrame(notes, NOTE.replace("nf_clean", "nf string, nf_clean", 1)), spark.createDataFrame(docs, DOC.replace("nf string", "file string, nf string", 1)), keep).collect()
    order = [*range(0, count, 2), *range(1, count, 2)]
    assert [(r.doc_seq, r.seq, r.via) for r in sorted(rows, key=lambda r: (r.doc_seq is None, r.doc_seq)) if r.doc_seq is not None] == [(i, n, "value-entity") for i, n in enumerate(order)]
    assert max(sizes) <= 8 * count
