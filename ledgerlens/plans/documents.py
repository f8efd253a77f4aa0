"""Operators on payloads, reports and files as queries over the supplied tables, with the SQL that gives the same rows."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.predicates import is_card_file, is_tax
from ..operators import classify, extract, payload, reports
from ..operators.store import ReportStore
from ..sources import csv, workbook
from ..sources.files import kept, scratch
from ..streaming import ingest
from .catalogue import STORE_SQL, query, store
from .inputs import DOCS_SQL, documents, read

PAYER_WORD, PAYER_ROOT = "PAGADORA", "12345678"

#: What a payload says, by key; SQL and query build it by the same rules. A NULL key is not in the payload.
SAID = {
    "Nº da NF-e": "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '—' WHEN 2 THEN '000' || CAST(k AS {s}) END",
    "Nº do CT-e": "CASE k % 3 WHEN 0 THEN 'CT ' || CAST(k + 7 AS {s}) END",
    "Ordem de Compra": "CASE k % 4 WHEN 0 THEN 'OC-00' || CAST(k AS {s}) END",
    "Razão social emitente": "CASE k % 7 WHEN 0 THEN 'Pagadora X' WHEN 1 THEN '' WHEN 2 THEN lower(c_name) END",
    "Nome fantasia": "CASE k % 7 WHEN 1 THEN 'Loja  ' || CAST(k AS {s}) END",
    "CNPJ emitente": "CASE k % 6 WHEN 0 THEN '12.345.678/0001-97' WHEN 1 THEN '02.328.280/0001-97' END",
    "Valor total": "CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN 'R$ 1.234,56' WHEN 2 THEN NULL ELSE CAST(k AS {s}) || ',50' END",
    "Data de vencimento": "CASE k % 9 WHEN 0 THEN '—' WHEN 1 THEN '10/05/2026' END",
    "Parcela": "CASE k % 2 WHEN 0 THEN '1/2' END",
}
FILE = "'2026.04.' || {pad} || ' , ' || upper(c_name) || ' , NF ' || CAST(k AS {s}) || '.pdf'"
REPORT_ID = "CASE k % 11 WHEN 0 THEN '11.222.333/0001-44' END"


def spoken(dialect: str) -> dict[str, str]:
    return {key: rule.format(s=dialect) for key, rule in SAID.items()}


DOC_ROWS_SQL = "rows_ AS (SELECT *, " + ", ".join(f"CASE WHEN k % 10 <> 3 THEN {rule} END AS v{i}" for i, rule in enumerate(spoken("VARCHAR").values())) + f", {FILE.format(s='VARCHAR', pad=chr(39) + '0' + chr(39) + ' || CAST(k % 9 + 1 AS VARCHAR)')} AS file, {REPORT_ID} AS report_id FROM (SELECT o_orderkey AS k, c_name FROM orders JOIN customer ON o_custkey = c_custkey))"


def report_rows(spark, sf_dir):
    """Orders as report rows (k, c_name, file, payload, tax_id); a tenth has no payload."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), "c_name")
    said = F.to_json(F.struct(*[F.expr(rule).alias(key) for key, rule in spoken("STRING").items()]))
    file = F.expr(FILE.format(s="STRING", pad="'0' || CAST(k % 9 + 1 AS STRING)"))
    return rows.select("k", "c_name", file.alias("file"), F.when(F.col("k") % 10 != 3, said).alias("payload"), F.expr(REPORT_ID).alias("tax_id"))


@query(f"""WITH {DOC_ROWS_SQL},
read_ AS (SELECT *, regexp_replace(coalesce(nullif(v0, ''), v1, ''), '\\D', '', 'g') AS n, regexp_replace(coalesce(v2, ''), '\\D', '', 'g') AS o, coalesce(nullif(v3, ''), v4, upper(c_name)) AS e, regexp_replace(coalesce(v5, report_id, ''), '\\D', '', 'g') AS t FROM rows_),
num AS (SELECT *, CASE WHEN n <> '' THEN nullif(ltrim(n, '0'), '') ELSE coalesce(nullif(ltrim(CAST(k AS VARCHAR), '0'), ''), '0') END AS nf, coalesce(nullif(ltrim(CAST(k AS VARCHAR), '0'), ''), '0') AS f FROM read_)
SELECT k AS doc_seq, nf, CASE WHEN nf IS DISTINCT FROM f THEN f END AS nf_alt, CASE WHEN o <> '' THEN nullif(ltrim(o, '0'), '') END AS order_nr,
  CASE WHEN NOT regexp_matches(upper(e), '\\bPAGADORA\\b') THEN upper(regexp_replace(e, ' +', ' ', 'g')) END AS emitter, CASE WHEN t <> '' AND t[1:8] <> '12345678' THEN t END AS emitter_id,
  CASE WHEN v6 = 'R$ 1.234,56' THEN 123456 WHEN v6 <> '' THEN k * 100 + 50 END AS cents, CASE WHEN v7 = '10/05/2026' THEN v7 END AS due,
  CASE WHEN v8 IS NOT NULL AND v7 = '10/05/2026' THEN DATE '2026-05-10' ELSE CAST('2026-04-0' || CAST(k % 9 + 1 AS VARCHAR) AS DATE) END AS day,
  coalesce(v7 = '10/05/2026', FALSE) AS due_in_period FROM num""")
def document_fields(spark, sf_dir):
    """Fields of report rows whose payload says them, leaves them blank, or is missing."""
    rows = payload.document_fields(report_rows(spark, sf_dir), PAYER_WORD, PAYER_ROOT)
    return rows.select(F.col("k").alias("doc_seq"), "nf", "nf_alt", "order_nr", "emitter", "emitter_id", "cents", "due", "day", payload.due_in(F.col("due"), F.lit("05.2026")).alias("due_in_period"))


@query("""SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS seq,
CASE WHEN l_linenumber % 3 > 0 AND l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%d.%m.%Y') END AS due_day, CASE l_linenumber % 4 WHEN 0 THEN 'Nº do CT-e' WHEN 1 THEN 'Número do documento' ELSE 'Nº da NF-e' END AS number_key,
left('word ' || l_returnflag || ' ' || l_linestatus, 6) AS cut FROM lineitem""")
def instalment_dues(spark, sf_dir):
    """Days of rows that are instalments, the key of their number by kind, and texts cut to a length."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    rows = read(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_orderkey") * 1000 + F.row_number().over(place))
    line = F.col("l_linenumber")
    said = F.to_json(F.struct(F.date_format("l_shipdate", "dd/MM/yyyy").alias("Data de vencimento"), F.when(line % 2 == 0, "1/2").alias("Parcela")))
    file = F.concat(F.lit("x.pdf"), F.when(line % 3 > 0, F.concat(F.lit("#p"), line.cast("string"))).otherwise(""))
    kind = F.when(line % 4 == 0, "CTE").when(line % 4 == 1, "IMPOSTO").otherwise("NF")
    shown = F.concat_ws(" ", F.lit(" word"), "l_returnflag", "l_linestatus")
    return rows.select("seq", payload.due_day(payload.instalment_due(file, said)).alias("due_day"), payload.number_key(kind).alias("number_key"), payload.cut(shown, 6).alias("cut"))


PARTS_SQL = "parts AS (SELECT l_orderkey AS k, l_linenumber AS n, strftime(l_shipdate, '%d/%m/%Y') AS due, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber % 3 AS VARCHAR) ELSE '' END AS own, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS place FROM lineitem), firsts AS (SELECT *, row_number() OVER (PARTITION BY k, CASE WHEN own <> '' THEN 'n' || own ELSE 'd|' || due || '|' || CAST(cents AS VARCHAR) END ORDER BY place) AS r FROM parts)"


def answered(spark, sf_dir):
    """(k, file, answer): full readings of orders with their items as instalments; a ninth says nothing of use."""
    i = read(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    part = lambda x: F.struct(F.date_format(x["l_shipdate"], "dd/MM/yyyy").alias("vencimento"), F.round(x["l_extendedprice"], 2).cast("decimal(18,2)").cast("string").alias("valor"), F.when(x["l_linenumber"] % 2 == 0, (x["l_linenumber"] % 3).cast("string")).otherwise("").alias("nossoNumero"))
    parts = i.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(item)), part).alias("parcelas"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice").join(parts, "k", "left")
    k = F.col("k")
    text_of = k.cast("string")
    said = F.struct(
        F.when(k % 4 == 0, " nf ").when(k % 4 == 1, "FATURA").when(k % 4 == 2, "Boleto").alias("tipo"), F.when(k % 3 == 0, F.concat(F.lit(" Firm "), text_of)).alias("emitente"), F.when(k % 5 == 0, "02.328.280/0001-97").otherwise("123").alias("cnpj"),
        F.concat(F.lit("Nº 00"), text_of).alias("numeroDocumento"), F.when(k % 6 == 0, "OC 0").alias("ordemCompra"), F.when(k % 7 == 0, "n/a").otherwise(F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")).alias("valorTotal"), F.when(k % 8 > 0, F.col("parcelas")).alias("parcelas"),
    )
    nothing = F.when(k % 2 == 0, "no reading").otherwise('{"tipo": "?", "parcelas": []}')
    return o.select("k", F.concat(text_of, F.lit(".pdf")).alias("file"), F.when(k % 9 == 0, nothing).otherwise(F.concat(F.lit("Here: "), F.to_json(said))).alias("answer"))


ANSWER_SQL = f"""{PARTS_SQL}, counted AS (SELECT k, count(*) AS c, min(due) FILTER (WHERE r = 1) AS one FROM firsts WHERE r = 1 GROUP BY k),
said AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'NF' WHEN 1 THEN 'FATURA' ELSE '' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'Firm ' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS emitter, CASE WHEN o_orderkey % 5 = 0 THEN '02328280000197' ELSE '' END AS tax_id,
ltrim(CAST(o_orderkey AS VARCHAR), '0') AS number, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS cents, CASE WHEN o_orderkey % 8 > 0 THEN coalesce(c, 0) ELSE 0 END AS n_parts, one FROM orders LEFT JOIN counted ON k = o_orderkey WHERE o_orderkey % 9 <> 0)"""  # every ninth order's answer holds no reading


@query(f"""WITH {ANSWER_SQL} SELECT o_orderkey AS doc_seq, coalesce(kind, '') AS kind, coalesce(emitter, '') AS emitter, coalesce(tax_id, '') AS tax_id, coalesce(number, '') AS number, '' AS order_nr, coalesce(cents, 0) AS cents, coalesce(n_parts > 1, FALSE) AS in_parts, CAST(coalesce(n_parts, 0) AS INTEGER) AS n_parts FROM orders LEFT JOIN said ON k = o_orderkey""")
def answer_clean(spark, sf_dir):
    """Full readings made regular: known kinds, digits, amounts, distinct instalments; answers without a reading are empty."""
    rows = answered(spark, sf_dir).select("k", payload.answers(F.col("answer")).alias("a"))
    text_of = lambda c: F.coalesce(f"a.{c}", F.lit("")).alias(c)
    return rows.select(F.col("k").alias("doc_seq"), *[text_of(c) for c in ("kind", "emitter", "tax_id", "number", "order_nr")], F.coalesce("a.cents", F.lit(0)).alias("cents"), F.coalesce("a.in_parts", F.lit(False)).alias("in_parts"), F.when(F.col("a.parts").isNotNull(), F.size("a.parts")).otherwise(0).alias("n_parts"))


@query(f"""WITH {ANSWER_SQL}, numbered AS (SELECT k, due, cents, row_number() OVER (PARTITION BY k ORDER BY place) AS i FROM firsts WHERE r = 1)
SELECT s.k AS doc_seq, CAST(s.k AS VARCHAR) || '.pdf' || CASE WHEN n_parts > 1 THEN '#p' || CAST(i AS VARCHAR) ELSE '' END AS file, CASE WHEN kind = '' THEN 'Não identificado' ELSE kind END AS kind, nullif(number, '') AS number, CASE WHEN n_parts > 1 THEN p.due WHEN n_parts = 1 THEN one END AS due, nullif(CASE WHEN n_parts > 1 AND p.cents > 0 THEN p.cents ELSE s.cents END, 0) AS cents, 'answer' AS origin
FROM said s LEFT JOIN numbered p ON p.k = s.k AND n_parts > 1 WHERE kind <> '' OR emitter <> '' OR number <> '' OR n_parts > 0
UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '.pdf', 'RECIBO', NULL, NULL, CAST(round(o_totalprice * 100) AS BIGINT), 'local' FROM orders LEFT JOIN said ON k = o_orderkey WHERE o_orderkey % 9 = 0 OR (kind = '' AND emitter = '' AND number = '' AND n_parts = 0)""")
def answer_rows(spark, sf_dir):
    """Readings as report rows, one an instalment; where a reading is of no use the local row stays."""
    rows = answered(spark, sf_dir).withColumnRenamed("k", "doc_seq")
    local = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_seq"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file"), F.lit("RECIBO").alias("kind"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("due"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return payload.answer_rows(rows, "answer", local, keep=kept)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Firm ' || CAST(o_orderkey AS VARCHAR) END AS emitter, CASE o_orderkey % 3 WHEN 0 THEN '02.328.280/0001-97' WHEN 1 THEN '123.456.789-09' ELSE '' END AS emitter_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Fazenda Boa' ELSE 'Fazenda Sitiozinho' END AS farm,
coalesce(n, 0) AS items, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS cents FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey""")
def summary_notes(spark, sf_dir):
    """Short readings: null words as names, ids of either kind and none, items without a description, totals that are none."""
    i = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_linenumber") % 3 == 0, " null").otherwise("part").alias("descricao"))).alias("itens"))
    o = read(spark, sf_dir, "orders").join(i, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    who = F.struct(F.when(k % 5 == 0, "n/a").otherwise(F.concat(F.lit("Firm "), k.cast("string"), F.lit(" - null"))).alias("razaoSocial"), F.when(k % 3 == 0, "02.328.280/0001-97").when(k % 3 == 1, "123.456.789-09").otherwise("12 34").alias("cnpj"))
    to = F.struct(F.when(k % 2 == 0, "Sítio Boa").otherwise("Fazenda Sitiozinho").alias("razaoSocial"))
    said = F.to_json(F.struct(F.array(F.struct(k.cast("string").alias("numero"), who.alias("emitente"), to.alias("destinatario"), "itens", F.when(k % 7 == 0, "none").otherwise(F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")).alias("totalNF"))).alias("notas")))
    rows = o.select("o_orderkey", F.explode(payload.summary_notes(said)).alias("n"))
    return rows.select("o_orderkey", "n.emitter", "n.emitter_id", payload.farm_name(F.col("n.recipient")).alias("farm"), F.size("n.items").cast("bigint").alias("items"), "n.cents")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'NFS' WHEN 1 THEN 'Não identificado' WHEN 2 THEN 'Não identificado' ELSE 'Não identificado' END AS kind, CASE event_id % 4 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' ELSE 'baixa' END AS confidence,
CASE event_id % 3 WHEN 0 THEN 'numero_cte=' || CAST(event_id AS VARCHAR) WHEN 1 THEN 'valor=9' ELSE '' END AS fields FROM events""")
def answer_kinds(spark, sf_dir):
    """Classifiers' answers with known kinds, unknown ones and none, and answers cut to the fields of a kind."""
    e = read(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    said = F.when(k % 4 == 0, 'So: {"category": "NFS", "confidence": "alta"}').when(k % 4 == 1, '{"category": "Não identificado", "confidence": "media"}').when(k % 4 == 2, '{"category": "Carta", "confidence": "alta"}').otherwise("none")
    fields = F.concat(F.lit('{"numero_cte": "'), k.cast("string"), F.lit('", "valor": "9", "other": "x", "serie": null}'))
    kind = F.when(k % 3 == 0, "CTE").when(k % 3 == 1, "RECIBO").otherwise("CARTA")
    shown = F.array_join(F.transform(F.map_entries(payload.typed_fields(fields, kind)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return e.select("event_id", payload.kind_answer(said).alias("a"), shown.alias("fields")).select("event_id", "a.*", "fields")


@query("SELECT page_id, CAST(least(6, page_id % 9) AS INTEGER) AS n, CASE WHEN page_id % 9 > 0 THEN 'image/jpeg' END AS first FROM pages")
def answer_pictures(spark, sf_dir):
    """Lists of up to eight valid data URIs, others between them; six are taken."""
    k = F.col("page_id")
    good = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when(i <= k % 9, F.concat(F.lit("data:image/jpg;base64,"), F.base64(i.cast("string").cast("binary")))).otherwise("data:text/plain,x"))
    rows = read(spark, sf_dir, "pages").select("page_id", payload.pictures(F.concat(F.array(F.lit("data:image/gif;base64,AA==")), good)).alias("p"))
    return rows.select("page_id", F.size("p").alias("n"), F.get("p", 0)["media_type"].alias("first"))


@query(f"""WITH {DOCS_SQL} SELECT doc_seq, CASE doc_seq % 4 WHEN 0 THEN 'CUSTOMER' WHEN 1 THEN CASE WHEN NOT regexp_matches(CAST(doc_seq AS VARCHAR), '^20\\d{{2}}') THEN 'FIRM' END WHEN 2 THEN 'MS CONSORCIO' ELSE 'GUIA' END AS emitter, doc_seq % 31 = 0 AS card,
(doc_seq % 23 = 0 OR coalesce(regexp_matches(doc_nf, '^90[34]9\\d{{2}}$'), FALSE)) AS tax, CASE doc_seq % 3 WHEN 0 THEN DATE '2026-05-04' WHEN 1 THEN DATE '2026-06-07' END AS folder_day,
CASE WHEN doc_seq % 5 = 0 THEN CAST(substr(lpad(CAST(doc_seq AS VARCHAR), 11, '0'), 1, 3) || '.' || substr(lpad(CAST(doc_seq AS VARCHAR), 11, '0'), 4, 3) || '.' || substr(lpad(CAST(doc_seq AS VARCHAR), 11, '0'), 7, 3) || '-' || substr(lpad(CAST(doc_seq AS VARCHAR), 11, '0'), 10, 2) AS VARCHAR) END AS shown_id,
CASE WHEN doc_seq % 2 = 0 THEN '02.328.280/0001-97' END AS labelled FROM docs""")
def file_marks(spark, sf_dir):
    """What file names, folders and ids tell: emitter before a mark, cards, taxes, days of folders, written forms.

    A number that begins like a year is taken for the date, so no emitter is left behind it.
    """
    d = documents(spark, sf_dir)
    k, number = F.col("doc_seq"), F.col("doc_seq").cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("2026.05.04. Customer. NF "), number)).when(k % 4 == 1, F.concat(F.lit("037.DOC- 1.780,00 - Firm - RCB "), number)).when(k % 4 == 2, "04.05.2026 MS Consórcio G712 C2950 BOL 3.pdf").otherwise("2026. GUIA.pdf")
    folder = F.when(k % 3 == 0, "a/2026.05.04/b").when(k % 3 == 1, "07.06.2026").otherwise("x2026.05.04")
    page = F.when(k % 2 == 0, "Emissor CNPJ: 02.328.280/0001-97").otherwise("CNPJ 12")
    return d.select(
        "doc_seq", text.emitter_by_marks(name).alias("emitter"), is_card_file(F.col("file")).alias("card"), is_tax(F.col("kind"), F.col("nf"), F.col("emitter"), F.col("file")).alias("tax"), dates.folder_date(folder).alias("folder_day"),
        text.masked_id(F.when(k % 5 == 0, F.lpad(number, 11, "0"))).alias("shown_id"), text.labelled_tax_id(page).alias("labelled"),
    )


@query("""SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 44, '7') AS access_key, 'VENDA DE MERCADORIA' AS nature, '12345' AS order_nr, CAST(doc_id + 1000 AS VARCHAR) AS cte, '02.328.280/0001-97' AS cte_id, 'DARF' AS slip, '10/05/2026' AS due FROM documents""")
def parse_other_fields(spark, sf_dir):
    """Key, nature and order of product invoices, and the fields of transport documents and tax slips, before whole texts."""
    docs = read(spark, sf_dir, "documents")
    key = F.concat_ws(" ", *[F.substring(F.lpad(F.col("doc_id").cast("string"), 44, "7"), 1 + 4 * i, 4) for i in range(11)])
    rest = F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))
    invoice = F.concat(F.lit("Chave "), key, F.lit(" | Natureza da operação: Venda de mercadoria | Ordem de compra: 12345 |"), rest)
    transport = F.concat(F.lit("Nº do CT-e: "), (F.col("doc_id") + 1000).cast("string"), F.lit(" CNPJ: 02.328.280/0001-97"), rest)
    slip = F.concat(F.lit("DARF Data de vencimento: 10/05/2026 Valor total: R$ 12,00"), rest)
    rows = docs.select("doc_id", classify.product_fields(invoice).alias("f"), classify.fields(transport, "CTE").alias("c"), classify.fields(slip, "IMPOSTO").alias("s"))
    return rows.select("doc_id", "f.access_key", F.trim(F.regexp_replace("f.nature", " .$", "")).alias("nature"), "f.order_nr", F.col("c.number").alias("cte"), F.col("c.emitter_id").alias("cte_id"), "s.slip", "s.due")


@query(f"""WITH {DOCS_SQL}, most AS (SELECT date_trunc('month', doc_date) AS m FROM docs WHERE doc_seq % 5 <> 0 GROUP BY 1 ORDER BY count(*) DESC, min(doc_seq) LIMIT 1)
SELECT doc_seq, CASE WHEN doc_seq % 5 = 0 THEN CAST((SELECT m FROM most) AS DATE) ELSE doc_date END AS day FROM docs""")
def undated_files(spark, sf_dir):
    """Files without a date go to the first day of the month that most files have."""
    d = documents(spark, sf_dir).select("doc_seq", F.when(F.col("doc_seq") % 5 != 0, F.col("doc_date")).alias("day"), F.col("doc_seq").alias("seq"))
    return reports.filed_days(d).select("doc_seq", "day")


def typed_store(spark, sf_dir):
    """The report store with rows of all three kinds of reports."""
    return store(spark, sf_dir).withColumn("report_type", F.when(F.col("seq") % 7 == 0, "C").when(F.col("seq") % 3 == 0, "M").otherwise("D"))


TYPED_SQL = f"{STORE_SQL}, typed AS (SELECT *, CASE WHEN seq % 7 = 0 THEN 'C' WHEN seq % 3 = 0 THEN 'M' ELSE 'D' END AS report_type FROM rows_)"


@query(f"""WITH {TYPED_SQL}, fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_type, period, file, folder ORDER BY seq DESC) AS n FROM typed WHERE seq % 50 = 0) WHERE n = 1)
SELECT seq, report_type FROM typed o WHERE seq % 50 <> 0 AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.report_type = o.report_type AND f.period = o.period AND (f.report_type = 'D' OR (f.file = o.file AND f.folder = o.folder)))
AND NOT (report_type <> 'D' AND EXISTS (SELECT 1 FROM typed g WHERE g.seq % 11 = 0 AND g.report_type = o.report_type AND g.period = o.period AND g.file = o.file AND g.folder = o.folder)) UNION ALL SELECT seq, report_type FROM fresh""")
def report_post(spark, sf_dir):
    """Daily reports sent whole, monthly ones with deletions."""
    rows = typed_store(spark, sf_dir)
    return reports.posted(rows.where("seq % 50 <> 0"), rows.where("seq % 50 = 0"), rows.where("seq % 11 = 0")).select("seq", "report_type")


@query(f"""WITH {TYPED_SQL} SELECT seq FROM (SELECT *, CASE WHEN seq % 14 = 0 THEN CAST(seq % 3 AS VARCHAR) || '-' || period ELSE period END AS p FROM typed) WHERE NOT (report_type = 'C' AND contains(p, '-'))""")
def report_purge(spark, sf_dir):
    rows = typed_store(spark, sf_dir)
    period = F.when(F.col("seq") % 14 == 0, F.concat((F.col("seq") % 3).cast("string"), F.lit("-"), "period")).otherwise(F.col("period"))
    return reports.purged(rows.withColumn("period", period)).select("seq")


@query(f"""WITH {TYPED_SQL} SELECT seq, period, file, company_id FROM (SELECT *, seq % 4 AS company_id, row_number() OVER (PARTITION BY period, file, folder ORDER BY seq DESC) AS n FROM typed WHERE report_type = 'M' AND seq % 4 > 0) WHERE n = 1""")
def company_reports(spark, sf_dir):
    """Rows of monthly reports that belong to a company, gathered as company reports by month."""
    rows = typed_store(spark, sf_dir)
    return reports.company_reports(rows, rows.where("seq % 4 > 0").select("seq", (F.col("seq") % 4).alias("company_id"))).select("seq", "period", "file", "company_id")


@query(f"""WITH {TYPED_SQL}, notes AS (SELECT seq, period, folder || '|' || file AS key FROM typed), old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, key ORDER BY seq DESC) AS n FROM notes WHERE seq % 2 = 0) WHERE n = 1),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, key ORDER BY seq DESC) AS n FROM notes WHERE seq % 10 = 1) WHERE n = 1)
SELECT seq, period, key FROM fresh UNION ALL SELECT seq, period, key FROM old o WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.period = o.period AND f.key = o.key) AND NOT EXISTS (SELECT 1 FROM notes g WHERE g.seq % 13 = 0 AND g.period = o.period AND g.key = o.key)""")
def annotation_store(spark, sf_dir):
    """Annotations with new ones and deletions applied."""
    rows = store(spark, sf_dir).select("seq", "period", F.concat("folder", F.lit("|"), "file").alias("key"))
    old = reports.latest(rows.where("seq % 2 = 0"), ["period", "key"])
    return reports.annotated_store(old, rows.where("seq % 10 = 1"), rows.where("seq % 13 = 0")).select("seq", "period", "key")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 1")
def forced_reread(spark, sf_dir):
    """Rows whose origin is not a model's answer are read again when that is forced."""
    origin = F.when(F.col("event_id") % 3 == 0, "parser").when(F.col("event_id") % 3 == 1, "lida por ia (2)")
    rows = read(spark, sf_dir, "events").select("event_id", origin.alias("origin"))
    return reports.to_reread(rows, F.lit(True)).select("event_id")


@query("SELECT turn AS place, conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 6")
def first_pages(spark, sf_dir):
    """The first six parts of each document, in order; conversations stand for documents of several pages."""
    return payload.first_pages(read(spark, sf_dir, "conversations"), "conv_id", "turn").select(F.col("turn").alias("place"), "conv_id", "text")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '  blank before' ELSE event_type || '; \"' || coalesce(props, '') || '\"' || chr(10) || 'x' END AS note, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS kind FROM events")
def csv_roundtrip(spark, sf_dir):
    """Report rows with separators, quotes, blanks and line breaks, written as semicolon CSV and read back; absent is empty."""
    note = F.when(F.col("event_id") % 5 == 0, "  blank before").otherwise(F.concat("event_type", F.lit('; "'), F.coalesce("props", F.lit("")), F.lit('"\nx')))
    rows = read(spark, sf_dir, "events").select("event_id", note.alias("note"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).when(F.col("event_id") % 2 == 0, "").alias("kind"))
    path = scratch(spark, "report")
    csv.write(rows, path)
    return csv.read(spark, path, "event_id bigint, note string, kind string")


@query("SELECT n_name AS text, strftime(DATE '2026-01-01' + CAST(n_nationkey AS INTEGER), '%m.%Y') AS period, CAST(DATE '2026-01-01' + CAST(n_nationkey AS INTEGER) AS DATE) AS day FROM nation")
def stream_ingest(spark, sf_dir):
    """One file a nation, dated by its name, taken by a stream that runs twice over the same folder and writes a table."""
    path = scratch(spark, "ingest")
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("n_nationkey").cast("int")), "yyyy.MM.dd")
    files = read(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.concat(day, F.lit(" , X , NF 1.txt")).alias("name"))
    files.write.partitionBy("name").text(f"{path}/in")

    schema = "text string, file string, folder string, day date"
    once = ingest.into_store(f"{path}/store", schema, "ingest")

    def sink(batch, number):
        rows = batch.select("text", F.col("name").alias("file"), "folder", "day", "period")
        for _ in range(2):
            once(rows, number)

    for _ in range(2):
        rows = ingest.new_files(spark, f"{path}/in", "*.txt").withColumn("folder", F.regexp_replace("folder", ".*name=", ""))
        ingest.run_once(ingest.filed(rows.withColumn("name", F.url_decode(F.replace("folder", F.lit("+"), F.lit("%2B"))))), f"{path}/seen", sink)
    return ReportStore(spark, f"{path}/store", schema).rows().select(F.trim(F.regexp_replace("text", "\n", "")).alias("text"), "period", "day")


@query("""WITH found AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END AS content FROM documents), known AS (SELECT doc_id, arg_max(content, seq) AS content FROM (SELECT doc_id, coalesce(text, '') AS content, 2 AS seq FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'old', CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 1 END FROM documents WHERE doc_id % 5 <> 0) GROUP BY 1)
SELECT f.doc_id, sha256(f.content) AS digest, k.doc_id IS NOT NULL AS changed FROM found f LEFT JOIN known k USING (doc_id) WHERE k.doc_id IS NULL OR k.content <> f.content""")
def changed_files(spark, sf_dir):
    """Files whose content is new: a fifth was never read, a third was edited, and a seventh had another revision last."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file"), F.lit("f").alias("folder"), F.coalesce("text", F.lit("")).alias("text"))
    found = ingest.with_digest(docs.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), "content")
    old = docs.where("doc_id % 5 <> 0")
    known = ingest.with_digest(old, "text").withColumn("seq", F.lit(2)).unionByName(ingest.with_digest(old.withColumn("text", F.lit("old")), "text").withColumn("seq", F.when(F.col("doc_id") % 7 == 0, 3).otherwise(1)))
    return ingest.changed(found.select("doc_id", "file", "folder", "digest"), known.select("file", "folder", "digest", "seq")).select("doc_id", "digest", "changed")


CARDS_SQL = """c AS (SELECT o_custkey AS owner, o_orderkey AS card, 'Card ' || o_orderstatus AS label FROM orders), place AS (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS seq FROM lineitem),
r AS (SELECT l_orderkey AS card, CASE l_linenumber % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'PARCELAMENTOS' WHEN 2 THEN 'PAGAMENTO E DEMAIS CRÉDITOS' ELSE 'DESPESAS' END AS section, CASE l_linenumber % 4 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS so, seq, l_linenumber % 5 <> 3 AS valid, strftime(l_shipdate, '%d/%m') AS day, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) / 100 AS DECIMAL(18,2)) AS amount FROM place),
s AS (SELECT owner, card, label || CASE WHEN row_number() OVER (PARTITION BY owner, label ORDER BY card) > 1 THEN ' (' || CAST(row_number() OVER (PARTITION BY owner, label ORDER BY card) AS VARCHAR) || ')' ELSE '' END AS sheet FROM c WHERE card IN (SELECT card FROM r))"""


@query(f"""WITH {CARDS_SQL}, rows_ AS (SELECT card, 0 AS so, 0 AS k, NULL AS seq, 'Data|Descrição|Parcela|Valor (R$)' AS cells FROM s UNION ALL SELECT DISTINCT card, so, 0, CAST(NULL AS BIGINT), '── ' || section || ' ──|||' FROM r WHERE section <> 'other'
UNION ALL SELECT card, so, 1, seq, day || '|row||' || CAST(amount AS VARCHAR) FROM r WHERE section <> 'other' AND valid)
SELECT card, sheet, row_number() OVER (PARTITION BY owner, card ORDER BY so, k, seq) AS line, seq, cells FROM rows_ JOIN s USING (card)""")
def card_sheets(spark, sf_dir):
    """Each card's sheet with its header and a row before each section; every fifth entry has no text."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    names = F.array(F.lit("other"), F.lit("instalments"), F.lit("payments"), F.lit("expenses"))
    n = F.col("l_linenumber")
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("card"), F.get(names, (n % 4).cast("int")).alias("section"), (F.col("l_orderkey") * 1000 + F.row_number().over(place)).alias("seq"), F.when(n % 5 == 3, " ").otherwise("row").alias("text"), F.date_format("l_shipdate", "dd/MM").alias("date"), F.lit("").alias("part"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    cards = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("card"), F.concat(F.lit("Card "), F.col("o_orderstatus")).alias("label"))
    return extract.card_sheets(cards.join(items, "card"), "card", "label").select("card", "sheet", "line", "seq", F.array_join("cells", "|").alias("cells"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'CTE' WHEN 1 THEN 'RECIBO' WHEN 2 THEN 'RECIBO' WHEN 4 THEN 'NF' ELSE 'Não identificado' END AS kind, CASE doc_id % 5 WHEN 0 THEN 'DACTE confirmado' WHEN 1 THEN 'RECIBO' WHEN 2 THEN 'RECIBO' WHEN 4 THEN 'DANFE' END AS evidence,
CASE doc_id % 5 WHEN 0 THEN 'reading' WHEN 1 THEN 'weak' WHEN 2 THEN 'weak' WHEN 4 THEN 'strong' ELSE 'none' END AS origin, doc_id % 5 IN (0, 2, 3) AS "read", CASE doc_id % 5 WHEN 0 THEN length(coalesce(text, '')) + 34 WHEN 1 THEN length(coalesce(text, '')) + 25 WHEN 2 THEN 14 WHEN 3 THEN 6 ELSE length(coalesce(text, '')) + 23 END AS chars FROM documents""")
def analyzed_documents(spark, sf_dir):
    """Documents with readings of their pictures: a carrier's confirmed, one without a reading, pictures that tell a kind or none, a strong mark that stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    case = F.col("doc_id") % 5
    said = F.concat(F.when(case < 2, "Recibo Transportadora 1: ").when(case == 4, "DANFE, Transportadora: ").otherwise(""), "text")
    reading = F.when(case == 0, "DACTE 17").when(case == 2, "Recibo 1234567").when(case == 3, "lorem ").when(case == 4, "CT-e 5")
    rows = docs.select("doc_id", classify.analyzed(said, F.lit(None).cast("string"), case.isin(2, 3), reading).alias("a"))
    return rows.select("doc_id", "a.kind", "a.evidence", "a.origin", "a.read", F.length("a.text").cast("bigint").alias("chars"))


@query("SELECT n_nationkey AS company_id, n_name AS name, CAST(n_nationkey AS VARCHAR) AS tax_id, 'C' AS kind, 'SP' AS state FROM nation ORDER BY name, company_id")
def companies_listing(spark, sf_dir):
    return reports.companies_by_name(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("tax_id"), F.lit("C").alias("kind"), F.lit("SP").alias("state")))


@query("SELECT min(event_id) AS schedule_id, strftime(ts, '%H:%M') AS \"at\" FROM events WHERE event_id % 10 <> 3 GROUP BY 2 ORDER BY 2")
def schedule_listing(spark, sf_dir):
    """Times of day, with or without seconds; every tenth is none."""
    k = F.col("event_id")
    at = F.when(k % 10 == 3, "25:00").when(k % 2 == 0, F.date_format("ts", "HH:mm:ss")).otherwise(F.concat(F.lit(" "), F.date_format("ts", "HH:mm")))
    return reports.schedule(read(spark, sf_dir, "events").select(k.alias("schedule_id"), at.alias("at")))


SHEET = ("ORIG", "NF", "ENTIDADE", "VL_TOTAL_CAB", "VL_ITEM", "DT_EMISSAO", "TIPO")


def as_workbook(rows) -> bytes:
    """One customer's lines as a workbook of one sheet: a title, the header, a row for each line."""
    cell = lambda place, v: f'<c r="{place}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{place}"><v>{v}</v></c>'
    xml = "".join(f'<row r="{n}">' + "".join(cell(f"{chr(65 + k)}{n}", v) for k, v in enumerate(line)) + "</row>" for n, line in enumerate([("Ledger",), SHEET, *rows], start=1))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{xml}</sheetData></worksheet>')
    return data.getvalue()


def workbooks(batches):
    """Workbooks (path, content) of owners with their lines in order."""
    for batch in batches:
        made = [as_workbook([tuple(line.values()) for line in lines.as_py()]) for lines in batch.column("lines")]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, pa.binary())], names=["path", "content"])


@query("""SELECT CAST(o_custkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) + 1 AS seq, 'CP' AS orig, CAST(o_orderkey AS VARCHAR) AS nf, 'Firm & Co ' || CAST(o_custkey AS VARCHAR) AS entity,
CAST(round(o_totalprice * 100) AS BIGINT) AS header_cents, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS signed_cents, CAST(round(l_extendedprice * 100) AS BIGINT) AS item_cents, CAST(o_orderdate AS DATE) AS issue_date, 'FATURA' AS category FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def workbook_lines(spark, sf_dir):
    """Ledger lines written as one workbook a customer and read from it; a quarter of the headers and half of the items are negative."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
    items = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("o_orderkey")
    line = F.struct(
        F.lit("CP").alias("orig"), k.cast("string").alias("nf"), F.concat(F.lit("Firm & Co "), F.col("o_custkey").cast("string")).alias("entity"),
        (F.col("o_totalprice") * F.when(k % 4 == 0, -1).otherwise(1)).cast("double").alias("header"), (F.col("l_extendedprice") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)).cast("double").alias("item"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).alias("serial"), F.lit("FATURA").alias("category"),
    )
    owners = items.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("lines"))
    files = owners.select("path", F.transform("lines", lambda x: x["line"]).alias("lines")).mapInArrow(workbooks, "path string, content binary")
    return workbook.ledger_lines(workbook.unpacked(files)).select("path", "seq", "orig", "nf", "entity", "header_cents", "signed_cents", "item_cents", "issue_date", "category")


@query("""WITH files AS (SELECT o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) || '.pdf' AS file, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders),
most AS (SELECT strftime(day, '%Y-%m') AS m FROM files WHERE day IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(seq) LIMIT 1),
filed AS (SELECT seq, file, coalesce(day, CAST(m || '-01' AS DATE)) AS day FROM files, most),
parts AS (SELECT l_orderkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS n, CASE WHEN l_linenumber <> 2 THEN CAST(l_shipdate AS DATE) END AS due FROM lineitem WHERE l_orderkey % 4 = 0),
rows_ AS (SELECT file || '#p' || CAST(n AS VARCHAR) AS file, coalesce(due, day) AS day FROM filed JOIN parts USING (seq) UNION ALL SELECT file, day FROM filed WHERE seq NOT IN (SELECT seq FROM parts))
SELECT file, 'D' AS report_type, strftime(day, '%d.%m.%Y') AS period FROM rows_ UNION ALL SELECT file, 'M', strftime(day, '%m.%Y') FROM rows_""")
def folder_run(spark, sf_dir):
    """A folder's files as report rows: undated ones by the month of most, instalments by their own due dates, some of them without."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    files = o.select(k.alias("seq"), F.concat(k.cast("string"), F.lit(".pdf")).alias("file"), F.lit("f").alias("folder"), F.when(k % 13 != 0, F.to_date("o_orderdate")).alias("day"))
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    parts = read(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("seq"), F.row_number().over(place).cast("string").alias("n"), F.when(F.col("l_linenumber") != 2, F.to_date("l_shipdate")).alias("due"))
    read_rows = files.join(parts, "seq", "left").select(F.concat("file", F.coalesce(F.concat(F.lit("#p"), "n"), F.lit(""))).alias("file"), "folder", "due")
    return reports.folder_rows(files, read_rows).select("file", "report_type", "period")
